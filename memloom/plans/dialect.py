"""Operators as SQL templates over named frames, and their twins for the oracle.

``@name`` in a template is an input frame or a parameter. ``#fn(args)`` is one
of the few functions that the two engines spell differently.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: The fixed clock of all queries.
NOW = "TIMESTAMP '2024-02-01 00:00:00'"

_SPELL = {
    "us": ("unix_micros(CAST({0} AS TIMESTAMP))", "epoch_us({0})"),
    "dow": ("weekday({0})", "(isodow({0}) - 1)"),
    "joined": ("array_join(array_sort(collect_set({0})), ',')", "coalesce(array_to_string(list_sort(list(DISTINCT {0})), ','), '')"),
    "tokens": ("filter(split(lower({0}), '[ \\t\\n\\r]+'), x -> x <> '')", "list_filter(string_split_regex(lower({0}), '[ \\t\\n\\r]+'), lambda x: x <> '')"),
    "words": ("regexp_extract_all(lower({0}), '[\\\\p{{L}}\\\\p{{N}}_]+', 0)", "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"),
    "size": ("CAST(size({0}) AS BIGINT)", "CAST(len({0}) AS BIGINT)"),
    "percentile": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "distinct": ("array_distinct({0})", "list_distinct({0})"),
    "common": ("CAST(size(array_intersect({0}, {1})) AS BIGINT)", "CAST(len(list_intersect({0}, {1})) AS BIGINT)"),
    "has": ("array_contains({0}, {1})", "list_contains({0}, {1})"),
    "dot": ("aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (a, z) -> a + z)", "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"),
    "hours": ("timestampadd(HOUR, {1}, {0})", "({0} + to_hours({1}))"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "like": ("({0} RLIKE '{1}')", "regexp_matches({0}, '{1}')"),
    "hits": ("CAST(size(regexp_extract_all({0}, '{1}', 0)) AS BIGINT)", "CAST(len(regexp_extract_all({0}, '{1}')) AS BIGINT)"),
    "sub": ("regexp_replace({0}, '{1}', '{2}')", "regexp_replace({0}, '{1}', '{2}', 'g')"),
    "ordered": ("array_join(transform(array_sort(collect_list(struct({0} AS o, {1} AS v))), x -> x.v), ',')", "string_agg({1}, ',' ORDER BY {0})"),
    "span": ("sequence({0}, {1})", "generate_series({0}, {1})"),
    "each": ("explode({0})", "unnest({0})"),
    "bytes": ("CAST(octet_length({0}) AS BIGINT)", "CAST(octet_length(encode({0})) AS BIGINT)"),
}


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """The comma-separated arguments that end with the parenthesis opened before start."""
    depth, quote, out, last = 1, False, [], start
    for i in range(start, len(text)):
        c = text[i]
        if c == "'":
            quote = not quote
        elif quote:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                out.append(text[last:i].strip())
                return out, i + 1
        elif c == "," and depth == 1:
            out.append(text[last:i].strip())
            last = i + 1
    raise ValueError("unbalanced parenthesis")


def spell(sql: str, engine: int) -> str:
    """Replace every ``#fn(...)`` for Spark (0) or the oracle (1), inner ones too."""
    while m := re.search(r"#(\w+)\(", sql):
        args, end = _arguments(sql, m.end())
        form = _SPELL[m[1]][engine]
        if m[1] in ("like", "hits", "sub"):
            args = [args[0], *(a.strip("'") for a in args[1:])]
            if engine == 0:
                args = [args[0], *(a.replace("\\", "\\\\") for a in args[1:])]
        sql = sql[: m.start()] + form.format(*args) + sql[end:]
    parts = sql.split("'")  # a decimal literal outside quotes is a double in both engines
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", x) for x in parts[::2]]
    return "'".join(parts)


def bind(sql: str, names: dict[str, object]) -> str:
    return re.sub(r"@(\w+)", lambda m: str(names.get(m[1], m[0])), sql)


@dataclass
class Op:
    """An operator: a template, the frames it reads and its parameters' defaults."""

    name: str
    sql: str
    frames: tuple[str, ...]
    doc: str = ""
    params: dict[str, object] = field(default_factory=dict)

    def __call__(self, *frames: DataFrame, **params: object) -> DataFrame:
        """Apply to frames, given in the order of ``frames``."""
        spark = frames[0].sparkSession
        views = {name: f"_{name}_{uuid.uuid4().hex}" for name in self.frames}
        for frame, view in zip(frames, views.values(), strict=True):
            frame.createOrReplaceTempView(view)
        try:
            return spark.sql(spell(bind(self.sql, {"now": NOW} | self.params | params | views), 0))
        finally:
            for view in views.values():
                spark.catalog.dropTempView(view)

    def oracle(self, views: dict[str, str], recursive: bool = False) -> str:
        """The twin: the same template after common table expressions for the frames."""
        need: list[str] = []

        def add(name: str) -> None:
            for other in re.findall(r"@(\w+)", views[name]):
                if other in views:
                    add(other)
            if name not in need:
                need.append(name)

        for name in self.frames:
            add(name)
        with_ = ", ".join(f"{n} AS ({bind(views[n], {'now': NOW} | {v: v for v in views})})" for n in need)
        body = bind(self.sql, {"now": NOW} | self.params | {n: n for n in self.frames}).strip()
        if m := re.match(r"WITH (RECURSIVE )?", body):
            return spell(f"WITH {m[1] or ''}{with_}, {body[m.end():]}", 1)
        return spell(f"WITH {with_} {body}", 1)
