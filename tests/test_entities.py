"""Entities: a text is spared a pattern only if it cannot match."""

import random
import re
from re import _constants as c
from re import _parser as parser

from pyspark.sql import functions as F

from memloom.operators import understanding as und


def made(parts, rng):
    """A text that matches a parsed pattern."""
    out = ""
    for op, x in parts:
        if op is c.LITERAL:
            out += chr(x)
        elif op is c.NOT_LITERAL:
            out += "q"
        elif op is c.IN:
            kind, y = rng.choice([i for i in x if i[0] is not c.NEGATE])
            negated = x[0][0] is c.NEGATE
            out += "q" if negated else chr(rng.randint(*y)) if kind is c.RANGE else chr(y) if kind is c.LITERAL else {c.CATEGORY_SPACE: " ", c.CATEGORY_DIGIT: "7"}[y]
        elif op is c.MAX_REPEAT:
            low, high, inner = x
            out += "".join(made(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 2))))
        elif op is c.SUBPATTERN:
            out += made(x[-1], rng)
        elif op is c.BRANCH:
            out += made(rng.choice(x[1]), rng)
    return out


def test_every_pattern_still_finds_what_it_matches(spark):
    rng = random.Random(5)
    texts = [before + made(parser.parse(p), rng) + after for _, p in und.ENTITIES for _ in range(120) for before, after in (("so ", ", ok"), ("x", "y"), ("", ""))]
    texts += ["٠٠٠٠ years", "in ١٢-١٢-٢٠", "", None, "the iPhone and C++x, B.Sx M.B.Ax", "éGo Goé Go_ Go"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    typed = lambda t: lambda x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    every = F.concat(*[F.transform(und._all("text", p), typed(t)) for t, p in und.ENTITIES])
    rows = docs.where("text IS NOT NULL").select("id", F.explode(every).alias("e")).where("length(trim(e.text)) >= 2")
    want = {tuple(r) for r in rows.select("id", "e.type", und.canonical(F.col("e.type"), F.col("e.text"))).collect()}
    got = [tuple(r) for r in und.entities(docs).collect()]
    assert len(want) > 3000 and len(got) == len(set(got)) and set(got) == want


def test_patterns_wait_for_what_they_need(spark):
    plan = und.entities(spark.createDataFrame([(1, "a")], "id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("CASE WHEN[^?]*?THEN regexp_extract_all", plan)) >= 20
    # and is searched once: by each pattern, and for capitals
    assert plan.count("regexp_extract_all") == len(und.ENTITIES) + 1
