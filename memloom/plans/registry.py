"""Every query of the library by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregates, records, retrieval, scoring, similarity, temporal, text
from . import formulas, special
from .dialect import Op
from .views import VIEWS, load

OPS: list[Op] = [*aggregates.OPS, *scoring.OPS, *temporal.OPS, *retrieval.OPS, *similarity.OPS, *text.OPS, *records.OPS]


def _query(op: Op) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(*load(spark, sf_dir, *op.frames))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {op.name: _query(op) for op in OPS} | special.QUERIES | formulas.QUERIES


def oracle_sql() -> dict[str, str]:
    own = {op.name: op.oracle(VIEWS) for op in OPS}
    for name, (view, sql) in (special.ORACLE | formulas.ORACLE).items():
        shell = Op(name, "SELECT 1 FROM x", tuple(view.split(","))).oracle(VIEWS)
        own[name] = sql.replace("{views}", shell[len("WITH ") : shell.rindex(" SELECT 1 FROM x")])
    return own
