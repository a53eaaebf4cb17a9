"""Secret scans (operator 4), in DataFrame functions alone.

Base spans come from three patterns. Further spans come from two character
Markov models: one of random strings, one of ordinary identifiers, both bigram
models trained on labelled samples. Every run of key-like characters of a
minimum length is scored by the difference of its log-likelihoods, and so are
its segments between separators, as ordinary text joined to a secret would hide
it. A run or segment whose ratio passes a threshold, that lies in no longer one
and touches no base span, is a span of kind ``markov``.

Positions are code points, end exclusive. They follow from the lengths of the
pieces between matches, so no user code runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LEAST = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}"
#: Separators at which a run is cut into segments, each by itself and together.
CUTS = ("=", "/", "-", "_", "[=/]", "[_-]", "[=/_-]")
#: Log-likelihood ratio, in nats in all and per character, from which a run or segment is a secret.
THRESHOLD, PER_CHARACTER = 16.0, 1.0
_SPAN = "array<struct<s:int,k:int,e:int>>"


def _positions(text: Column, pattern: str, spans) -> Column:
    """Spans of the matches; ``spans`` maps a match's gap and text, its start and its end to an array of spans."""
    between = F.split(text, pattern, -1)
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, pair):
        s = acc["at"] + F.length(pair["g"])
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], spans(pair, s, e)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(match)), match, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _kept(keep, kind: int):
    """The whole match as a span of ``kind`` if ``keep`` says so."""
    return lambda p, s, e: F.when(keep(p), F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))).otherwise(F.array().cast(_SPAN))


def _segments(run: Column) -> Column:
    """(at, t) of a run and of its segments that are long enough, each once."""
    none = F.array().cast("array<struct<at:int,t:string>>")

    def step(acc, t):
        one = F.array(F.struct(acc["at"].alias("at"), t.alias("t")))
        return F.struct((acc["at"] + F.length(t) + 1).alias("at"), F.when(F.length(t) >= RUN_LEAST, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    cuts = [F.aggregate(F.split(run, cut, -1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]) for cut in CUTS]
    return F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("at"), run.alias("t"))), *cuts))


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda p: F.length(F.regexp_extract(p["m"], ASSIGN, 2)) >= ASSIGN_LEAST
    every = lambda p: F.lit(True)
    return {"assign": _positions(text, ASSIGN, _kept(value, 0)), "access": _positions(text, ACCESS, _kept(every, 1)), "hex": _positions(text, HEX, _kept(every, 2))}


def _bigrams(token: Column) -> Column:
    """Numbers of a run's character pairs, from 1; a character outside the alphabet counts as its last."""
    code = F.transform(F.split(token, ""), lambda c: F.coalesce(F.nullif(F.position(c, F.lit(ALPHABET)), F.lit(0)), F.lit(len(ALPHABET))))
    n = F.size(code)
    return F.zip_with(F.slice(code, F.lit(1), n - 1), F.slice(code, F.lit(2), n - 1), lambda a, b: (a - 1) * len(ALPHABET) + b)


class MarkovModel:
    """Log-likelihood ratio of each character pair, random against ordinary."""

    def __init__(self, ratio: list[float]):
        self.ratio = ratio

    def score(self, token: Column) -> Column:
        table = F.array(*[F.lit(x) for x in self.ratio])
        return F.aggregate(_bigrams(token), F.lit(0.0), lambda acc, g: acc + F.element_at(table, g))


def train(samples: DataFrame, token_col: str = "token", random_col: str = "random", smoothing: float = 0.5) -> MarkovModel:
    """Fit both models on labelled tokens (``random_col`` boolean).

    The counts are at most two for each pair of the alphabet's characters,
    whatever the size of the sample. Null tokens and labels are skipped.
    """
    pairs = samples.where(F.length(token_col) >= 2).where(F.col(random_col).isNotNull()).select(F.col(random_col).alias("r"), F.explode(_bigrams(F.col(token_col))).alias("g"))
    size = len(ALPHABET)
    table = {True: [smoothing] * size * size, False: [smoothing] * size * size}
    for r, g, n in pairs.groupBy("r", "g").count().collect():
        table[r][g - 1] += n
    log = {}
    for label, counts in table.items():
        rows = [sum(counts[a * size : (a + 1) * size]) for a in range(size)]
        log[label] = [math.log(c / rows[k // size]) for k, c in enumerate(counts)]
    return MarkovModel([a - b for a, b in zip(log[True], log[False], strict=True)])


_WORDS = "get set user name index value file path list item count total first last start end time date page next load save read write open close data base table row column key type text line code test case main init config option result error message event handler server client request response query model view controller service factory manager helper util common public private static final string number array object function method class module package import export default version build release debug info level status state event trace log cache queue thread pool buffer stream socket host port address".split()


def labelled_samples(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strings: int = 4000, ordinary_docs: int = 1000) -> DataFrame:
    """(token, random): ``strings`` pseudo-random strings in each of four
    alphabets, as many identifiers joined from common words and digit strings,
    and the letter runs of the ``ordinary_docs`` documents of the smallest id
    hash. Both bounds are parameters of this training sample only."""
    n = spark.range(strings).withColumn("x", F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256))
    cut = lambda c: F.substring(c, F.lit(1), (F.lit(RUN_LEAST) + F.col("id") % 25).cast("int"))
    b64 = F.base64(F.unhex("x"))
    random = n.select(F.explode(F.array(cut(F.col("x")), cut(b64), cut(F.translate(b64, "+/=", "ab")), cut(F.upper(F.translate(b64, "+/=", "XY"))))).alias("token"), F.lit(True).alias("random"))
    words = F.array(*[F.lit(w) for w in _WORDS])
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_WORDS))) + 1).cast("int"))
    four = [pick(k) for k in range(4)]
    shapes = [F.concat_ws("_", *four), F.concat_ws("-", *four), F.concat(four[0], *[F.initcap(w) for w in four[1:]]), F.upper(F.concat_ws("_", *four[:3])), F.concat_ws("/", *four), F.concat(*four), F.concat(F.concat_ws("_", *four[:3]), F.lit("_"), (F.col("id") % 100).cast("string")), F.regexp_replace("x", "[a-f]", ""), F.concat_ws("-", F.lit("2024"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")), F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), 24)]
    ordinary = n.select(F.explode(F.array(*shapes)).alias("token"), F.lit(False).alias("random"))
    ids = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i")).orderBy(F.xxhash64("i"), "i").limit(ordinary_docs).distinct()
    # the ids are bounded by ordinary_docs, and only they pass through one task
    prose = docs.join(F.broadcast(ids), docs[id_col] == ids["i"], "left_semi").select(F.explode(F.regexp_extract_all(text_col, F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    return random.union(ordinary).union(prose)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of every text, one row per input row.

    Result: the id column, the ``extra`` columns, ``base`` and ``spans``, arrays
    of (s, k, e) sorted by start, then kind (k is a position in KINDS). A null
    text counts as empty. Equal rows give equal rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = base_spans(text)
    out = docs.select(F.col(id_col), *extra, text.alias("_text"), F.concat(*kinds.values()).alias("_base"))
    runs = F.regexp_extract_all("_text", F.lit(RUN), F.lit(0))
    secret = lambda m: model.score(m) >= F.greatest(F.lit(THRESHOLD), PER_CHARACTER * F.length(m))
    passing = lambda m: F.filter(_segments(m), lambda x: secret(x["t"]))
    found = lambda p, s, e: F.transform(passing(p["m"]), lambda x: F.struct((s + x["at"]).alias("s"), F.lit(3).alias("k"), (s + x["at"] + F.length(x["t"])).alias("e")))
    out = out.withColumn("_likely", F.exists(runs, lambda m: F.size(passing(m)) > 0))
    out = out.withColumn("_all", F.when(F.col("_likely"), _positions(F.col("_text"), RUN, found)).otherwise(F.array().cast(_SPAN)))
    inside = lambda x, y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])
    out = out.withColumn("_found", F.filter("_all", lambda x: ~F.exists("_all", lambda y: inside(x, y))))
    new = F.filter("_found", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return out.select(id_col, *extra, F.array_sort("_base").alias("base"), F.array_sort(F.concat("_base", new)).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the base spans' sha256, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)
