"""Importance, decay, health, quality, temperature and storage tiers, as column expressions.

Every operator takes a frame of memories and needs the columns its docstring
names. Ages and idle times are days; ``days`` and ``idle_days`` are whole days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Half-lives in days by memory type, 30 for all others.
HALF_LIVES = {"preference": 90.0, "goal": 60.0, "fact": 30.0, "event": 14.0, "context": 30.0, "habit": 90.0}
DECAYS = ("linear", "exponential", "logarithmic", "step", "hybrid")
# Number of memory types, as two generations of the store health count them.
N_TYPES, N_TYPES_OLD = 9, 6
# Words whose presence ages a text.
OUTDATED = ("currently", "now", "today", "this year", "this month", "recently", "latest", "new", "upcoming")
# Words that raise or lower importance, and texts that carry none.
HIGH = ("goal", "important", "critical", "must", "always", "never", "hate", "love")
MEDIUM = ("prefer", "like", "want", "need", "usually", "often")
LOW = ("maybe", "might", "sometimes", "occasionally")
TRIVIAL = ("hi", "hello", "ok", "yes", "no", "yeah", "sure")


def _cases(value: Column, table: dict[str, float], other: float) -> Column:
    return reduce(lambda acc, kv: acc.when(value == kv[0], kv[1]), list(table.items())[1:], F.when(value == next(iter(table)), next(iter(table.values())))).otherwise(other)


def _words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _any(text: str | Column, parts: tuple[str, ...]) -> Column:
    """Does the lower-cased text hold any of the parts."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in parts])


def decayed(kind: str, min_importance: float = 1.0, boost: float = 0.5, confidence_weight: float = 0.3) -> Column:
    """Importance after decay, of ``age``, ``idle``, ``type``, ``importance``,
    ``access_count`` and ``confidence``. Accesses raise the factor, to one at
    most; confidence scales the result around one half; it has a floor."""
    half, age = _cases(F.col("type"), HALF_LIVES, 30.0), F.col("age")
    exponential = F.pow(F.lit(0.5), age / half)
    recent = F.exp(-F.col("idle") / (half / 2)) * F.least(F.col("access_count") / 10.0, F.lit(1.0)) * 0.3
    factor = {
        "linear": F.greatest(F.lit(0.0), 1 - age / (half * 2)),
        "exponential": exponential,
        "logarithmic": F.when(age <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.ln(1 + age) / F.ln(1 + half * 2))),
        "step": F.when(age < half, 1.0).when(age < half * 2, 0.75).when(age < half * 3, 0.5).when(age < half * 4, 0.25).otherwise(0.1),
        "hybrid": F.when(F.col("access_count") > 0, F.least(exponential + recent, F.lit(1.0))).otherwise(exponential),
    }[kind]
    lifted = F.least(factor + F.least(F.col("access_count") * boost, F.lit(3.0)) * 0.1, F.lit(1.0))
    factor = F.when(F.col("access_count") > 0, lifted).otherwise(factor)
    return F.greatest(F.col("importance") * factor * (1 + (F.col("confidence") - 0.5) * (2 * confidence_weight)), F.lit(min_importance))


def decay(memories: DataFrame) -> DataFrame:
    """Decayed importance of each memory under all five functions."""
    return memories.select("id", *[F.round(decayed(k), 9).alias(k) for k in DECAYS])


def decay_statistics(memories: DataFrame, kind: str = "exponential") -> DataFrame:
    """By user: memories, those whose importance changed, the loss in all and on
    average over all, and those that lost more than a tenth."""
    x = memories.select("user_id", "importance", (F.col("importance") - decayed(kind)).alias("lost"))
    share = F.when(F.col("importance") > 0, F.col("lost") / F.col("importance")).otherwise(0.0)
    return x.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("lost") != 0).cast("long")).alias("updated"),
        F.round(F.sum("lost"), 6).alias("total_decay"),
        F.round(F.sum("lost") / F.count(F.lit(1)), 8).alias("avg_decay"),
        F.sum((share > 0.1).cast("long")).alias("significant"),
    )


def heuristic_importance(memories: DataFrame) -> DataFrame:
    """Importance from 1 to 10, of ``text`` and ``type``: the first class of words
    that a text has counts, capitals or an exclamation mark add one."""
    words = _words("text")
    has = lambda xs: F.arrays_overlap(words, F.array(*map(F.lit, xs)))
    score = (
        F.lit(5.0)
        + F.when((F.length("text") < 5) | F.lower("text").isin(*TRIVIAL), -3.0).otherwise(0.0)
        + F.when(has(HIGH), 2.0).when(has(MEDIUM), 1.0).when(has(LOW), -0.5).otherwise(0.0)
        + F.when(F.col("text").rlike(r"[\p{Lu}!]"), 1.0).otherwise(0.0)
        + F.when(F.length("text") > 100, 0.5).otherwise(0.0)
        + F.when(F.col("type").isin("preference", "goal"), 1.0).when(F.col("type") == "context", 0.5).otherwise(0.0)
    )
    return memories.select("id", F.greatest(F.lit(1.0), F.least(F.lit(10.0), score)).alias("importance"))


def _percent(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def stale_evidence(stale_days: int = 180) -> Column:
    """Additive confidence that a memory is stale: age, no access, little importance, dated text."""
    dated = F.col("text").rlike(r"\b(?:19|20)\d{2}\b") | _any("text", OUTDATED)
    parts = [((F.col("age") > stale_days), 0.3), ((F.col("access_count") == 0) & (F.col("days") > 90), 0.3), ((F.col("importance") < 3) & (F.col("days") > 60), 0.2), (dated, 0.2)]
    return reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in parts])


def stale(memories: DataFrame, stale_days: int = 180) -> DataFrame:
    """Memories with any evidence of being stale, and how much."""
    return memories.select("id", F.col("days").alias("age_days"), F.round(F.least(F.lit(1.0), stale_evidence(stale_days)), 7).alias("confidence")).where("confidence > 0")


def store_health(memories: DataFrame, stale_days: int = 180) -> DataFrame:
    """Health of each user's store from 0 to 100: quality, diversity, freshness,
    coverage, duplication (texts alike but for case and outer blanks) and staleness."""
    m = memories.withColumn("_k", F.lower(F.trim("text")))
    kinds = m.groupBy("user_id", "type").count().withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("user_id")))
    entropy = kinds.groupBy("user_id").agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(float(N_TYPES))) * 100).alias("entropy"), F.count(F.lit(1)).alias("kinds"))
    tags = m.select("user_id", F.explode(F.array("tag1", "tag2")).alias("t")).groupBy("user_id").agg(F.countDistinct("t").alias("n_tags_all"))
    copies = m.groupBy("user_id", "_k").count().groupBy("user_id").agg(F.sum(F.col("count") - 1).alias("copies"))
    base = m.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg("importance") * 10 * 0.4 + F.avg("confidence") * 100 * 0.4 + _percent((F.col("n_tags") > 0) | (F.col("n_meta") > 0) | F.col("has_entities")) * 0.2).alias("quality"),
        F.least(F.lit(100.0), F.sqrt(F.var_pop(F.length("text"))) / 10).alias("spread"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), _percent(F.col("days") <= 30) * 0.4 + (100 - F.least(F.lit(100.0), F.avg("days") / 3.65)) * 0.4 + _percent(F.col("access_count") > 0) * 0.2)).alias("freshness"),
        _percent(F.col("has_entities")).alias("entities"),
        (100 - _percent(stale_evidence(stale_days) > 0)).alias("staleness"),
    )
    x = base.join(entropy, "user_id").join(tags, "user_id").join(copies, "user_id")
    x = x.select(
        "user_id", "quality", (F.col("entropy") * 0.7 + F.col("spread") * 0.3).alias("diversity"), "freshness",
        (F.least(F.lit(100.0), F.col("n_tags_all") * 5.0) * 0.4 + F.col("kinds") / float(N_TYPES) * 100 * 0.4 + F.col("entities") * 0.2).alias("coverage"),
        (100 - F.col("copies") / F.col("n") * 100).alias("duplication"), "staleness",
    )
    parts = ["diversity", "freshness", "coverage", "duplication", "staleness"]
    health = F.col("quality") * 0.25 + sum(F.col(c) * 0.15 for c in parts)
    return x.select("user_id", *[F.round(c, 6).alias(c) for c in ("quality", *parts)], F.round(health, 6).alias("health"))


def recommendations(health: DataFrame) -> DataFrame:
    """Advice on each user's store from the result of ``store_health``, in order, joined by semicolons."""
    rules = [(F.col("health") < 50, "overall low"), (F.col("health") > 80, "excellent"), (F.col("quality") < 60, "improve quality"), (F.col("diversity") < 60, "diversify"), (F.col("freshness") < 60, "refresh"), (F.col("coverage") < 60, "expand coverage"), (F.col("duplication") < 70, "merge duplicates"), (F.col("staleness") < 70, "review stale")]
    return health.select("user_id", F.array_join(F.array_compact(F.array(*[F.when(c, t) for c, t in rules])), ";").alias("advice"))


def store_health_by_use(memories: DataFrame, diverse_over: int = 50) -> DataFrame:
    """Second store health by user: freshness, diversity, consistency, coverage, the
    status they give, and engagement. Text diversity is one less the mean token
    Jaccard of all pairs among a user's first ``diverse_over`` memories (a fixed
    part of the operator: pairs of all would grow with the square)."""
    fresh = F.least(50 * F.exp(-F.col("days") / 90.0) + 50 * F.exp(-F.col("idle_days") / 60.0) + F.least(F.col("access_count") * 2.0, F.lit(20.0)), F.lit(100.0))
    full = 25.0 * ((F.col("n_tags") > 0).cast("double") + (F.col("n_meta") > 0).cast("double") + (F.length("text") > 10).cast("double") + F.col("type").isNotNull().cast("double"))
    base = memories.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(fresh).alias("freshness"),
        F.avg(F.col("confidence") * 100 * 0.4 + F.col("importance") * 10 * 0.3 + full * 0.3).alias("consistency"),
        F.countDistinct("type").alias("kinds"),
        (F.max("days") - F.min("days")).alias("range"),
        F.least(F.avg("access_count") * 10, F.lit(100.0)).alias("access"),
        (_percent(F.col("idle_days") < 7) * 0.3).alias("recent"),
    )
    tags = memories.select("user_id", F.explode(F.array("tag1", "tag2")).alias("t")).groupBy("user_id").agg(F.countDistinct("t").alias("n_tags_all"))
    first = memories.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("id"))).where(F.col("_r") <= diverse_over).select("user_id", "_r", F.array_distinct(_words("text")).alias("w"))
    other = first.select(F.col("user_id").alias("u2"), F.col("_r").alias("r2"), F.col("w").alias("w2"))
    both = F.size(F.array_intersect("w", "w2"))
    pairs = first.join(other, (F.col("user_id") == F.col("u2")) & (F.col("_r") < F.col("r2"))).groupBy("user_id").agg(F.avg(both / (F.size("w") + F.size("w2") - both)).alias("alike"))
    x = base.join(tags, "user_id").join(pairs, "user_id", "left")
    many = F.col("n") > 1
    x = x.select(
        "user_id", "freshness",
        (F.col("kinds") / float(N_TYPES_OLD) * 100 * 0.3 + F.least(F.col("n_tags_all") / F.col("n") * 100, F.lit(100.0)) * 0.3 + F.coalesce((1 - F.col("alike")) * 100, F.lit(50.0)) * 0.4).alias("diversity"),
        "consistency",
        (F.col("kinds") / float(N_TYPES_OLD) * 100 * 0.3 + F.when(many, F.least(F.col("range") / 30.0 * 100, F.lit(100.0))).otherwise(50.0) * 0.3 + F.least(F.col("n") * 1.0, F.lit(100.0)) * 0.4).alias("coverage"),
        F.least(F.col("access") + F.col("recent"), F.lit(100.0)).alias("engagement"),
    )
    health = F.col("freshness") * 0.3 + F.col("diversity") * 0.25 + F.col("consistency") * 0.25 + F.col("coverage") * 0.2
    cols = ("freshness", "diversity", "consistency", "coverage", "engagement")
    return x.select("user_id", *[F.round(c, 6).alias(c) for c in cols], F.round(health, 6).alias("health"), _status(health).alias("status"))


def _status(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").when(score >= 40, "poor").otherwise("critical")


def _quality() -> tuple[Column, Column]:
    """Quality from 0 to 100, and the issues, of one memory."""
    n = F.length("text")
    tokens = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    ends = n - F.length(F.translate("text", ".!?", ""))
    repeats = (F.size(tokens) > 0) & (F.size(F.array_distinct(tokens)) / F.size(tokens) < 0.5)
    complete = F.when(n >= 100, 40).when(n >= 50, 30).when(n >= 10, 20).otherwise(10) + F.when(F.col("n_tags") >= 3, 30).when(F.col("n_tags") >= 1, 20).otherwise(0) + F.when(F.col("n_meta") >= 3, 30).when(F.col("n_meta") >= 1, 20).otherwise(10)
    clear = F.lit(80.0) - F.when(n < 20, 30).when(n < 50, 15).otherwise(0) + F.when(ends > 0, 10).otherwise(0) + F.when(ends > 2, 10).otherwise(0) - F.when(repeats, 20).otherwise(0)
    fresh = F.when(F.col("idle") < 0, 100.0).otherwise(100 * F.pow(F.lit(0.5), F.col("idle") / 30.0))
    score = 0.25 * F.least(complete, F.lit(100)) + 0.2 * F.greatest(F.lit(0.0), F.least(clear, F.lit(100.0))) + 0.2 * fresh + 0.2 * F.col("confidence") * 100 + 0.15 * F.col("importance") * 10
    issues = F.array_compact(F.array(*[F.when(c, t) for c, t in [(F.col("idle") > 90, "stale"), (F.col("confidence") < 0.5, "low_confidence"), (F.col("importance") < 3, "low_importance"), (n < 10, "incomplete"), ((F.col("n_tags") == 0) & (F.col("n_meta") == 0), "orphaned")]]))
    return score, issues


def quality(memories: DataFrame) -> DataFrame:
    """Quality of each memory: completeness, clarity, freshness, confidence and importance, and its issues."""
    score, issues = _quality()
    return memories.select("id", F.round(score, 7).alias("quality"), F.array_join(issues, ",").alias("issues"))


def store_quality(memories: DataFrame) -> DataFrame:
    """Third store health by user: half the mean quality, less penalties for
    groups of copies and stale memories (20 at most each), more for topics (10 at most)."""
    score, issues = _quality()
    m = memories.select("user_id", score.alias("q"), (F.col("idle") > 90).alias("stale"), F.lower(F.trim("text")).alias("k"), F.array("tag1", "tag2").alias("tags"))
    groups = m.groupBy("user_id", "k").count().groupBy("user_id").agg(F.sum((F.col("count") > 1).cast("long")).alias("clusters"))
    topics = m.select("user_id", F.explode("tags").alias("t")).groupBy("user_id").agg(F.countDistinct("t").alias("topics"))
    base = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean"), F.sum((F.col("q") >= 70).cast("long")).alias("healthy"), F.sum(F.col("stale").cast("long")).alias("stale"))
    x = base.join(groups, "user_id").join(topics, "user_id")
    health = F.greatest(F.lit(0.0), F.col("mean") * 0.5 - F.least(F.col("clusters") / F.col("n") * 100, F.lit(20.0)) - F.least(F.col("stale") / F.col("n") * 100, F.lit(20.0)) + F.least(F.col("topics") * 1.0, F.lit(10.0)))
    return x.select("user_id", "n", "healthy", "stale", "clusters", "topics", F.round("mean", 6).alias("mean_quality"), F.round(health, 6).alias("health"), _status(health).alias("status"))


def topic_coverage(memories: DataFrame) -> DataFrame:
    """By user and tag: count, quality, recency, the five most frequent words of over
    three letters (ties by the word) and a coverage score of 100 at most."""
    t = memories.select("user_id", F.explode(F.array_distinct(F.array("tag1", "tag2"))).alias("topic"), "confidence", "idle", "text")
    base = t.groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("n"), (F.avg("confidence") * 100).alias("q"), F.avg("idle").alias("r"))
    words = t.select("user_id", "topic", F.explode(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+")).alias("w")).where(F.length("w") > 3).groupBy("user_id", "topic", "w").count()
    first = words.withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "topic").orderBy(F.col("count").desc(), "w"))).where("_r <= 5")
    top = first.groupBy("user_id", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "w"))), lambda x: x["w"]), ",").alias("keywords"))
    score = F.least(F.least(F.col("n") * 5.0, F.lit(50.0)) + F.col("q") * 0.3 + F.greatest(F.lit(0.0), 20 - F.col("r") / 30), F.lit(100.0))
    return base.join(top, ["user_id", "topic"], "left").select("user_id", "topic", "n", F.round("q", 6).alias("quality"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.round(score, 6).alias("coverage"))


def provenance_quality(memories: DataFrame) -> DataFrame:
    """Specificity, verifiability, completeness, clarity and relevance of a memory, and their mean."""
    n = F.length("text")
    parts = {
        "specificity": (F.least(F.lit(1.0), n / 200.0), 0.25),
        "verifiability": (F.when(F.col("has_entities"), 0.8).otherwise(0.5), 0.2),
        "completeness": (F.least(F.lit(1.0), F.col("n_meta") / 5.0), 0.25),
        "clarity": (F.when(n < 10, 0.3).when(n > 500, 0.7).otherwise(0.9), 0.15),
        "relevance": ((F.least(F.lit(1.0), F.col("access_count") / 10.0) + F.col("importance") / 10.0) / 2, 0.15),
    }
    return memories.select("id", *[F.round(c, 9).alias(k) for k, (c, _) in parts.items()], F.round(sum(c * w for c, w in parts.values()), 9).alias("overall"))


def temperature(memories: DataFrame, half_life: float = 30.0) -> DataFrame:
    """Temperature from 0 to 100 of accesses a day, recency and importance, and the
    tier that age, accesses and temperature ask for: rules in order, then cuts."""
    age = F.greatest("age", F.lit(0.001))
    t = 0.4 * F.least(F.col("access_count") / age * 100, F.lit(100.0)) + 0.3 * F.pow(F.lit(0.5), F.col("idle") / half_life) * 100 + 0.3 * F.least(F.col("importance") / 10.0, F.lit(1.0)) * 100
    x = memories.select("id", age.alias("a"), F.col("access_count").alias("n"), t.alias("t"))
    tier = F.expr("""CASE WHEN a > 365 AND (n < 2 OR t < 10) THEN 'hibernated' WHEN a > 365 AND t < 30 THEN 'archived'
        WHEN a > 90 AND (n < 3 OR t < 20) THEN 'archived' WHEN a > 90 AND t < 40 THEN 'cold'
        WHEN a > 30 AND t < 30 THEN 'cold' WHEN a > 30 AND t < 60 THEN 'warm'
        WHEN a <= 7 AND (n > 10 OR t > 70) THEN 'hot'
        WHEN t >= 70 THEN 'hot' WHEN t >= 50 THEN 'warm' WHEN t >= 30 THEN 'cold' ELSE 'archived' END""")
    return x.select("id", F.round("t", 8).alias("temperature"), tier.alias("tier"))


def _storage(days: Column) -> Column:
    return F.when(days < 30, 0).when(days < 90, 1).when(days < 365, 2).otherwise(3)


def migrate_tiers(memories: DataFrame) -> DataFrame:
    """Moves between storage tiers (0 hot, 1 warm, 2 cold, 3 frozen) by user: the
    current tier follows the days since the last access, the target grants a bonus
    of up to 60 days for importance and accesses."""
    bonus = F.floor((F.col("importance") / 10.0 + F.least(F.lit(1.0), F.col("access_count") / 100.0)) * 30)
    x = memories.select("user_id", _storage(F.col("idle_days")).alias("now"), _storage(F.col("idle_days") - bonus).alias("to"))
    moved = lambda c: F.sum(c.cast("long"))
    return x.groupBy("user_id").agg(*[moved((F.col("to") > F.col("now")) & (F.col("to") == k)).alias(f"to_{n}") for k, n in enumerate(("hot", "warm", "cold", "frozen")) if k], moved(F.col("to") < F.col("now")).alias("promoted"), moved(F.col("to") == F.col("now")).alias("kept"))


def tier_texts(memories: DataFrame) -> DataFrame:
    """The text as kept in the warm tier (500 characters), the cold one (two
    sentences, or 200 characters) and the frozen one (type and 100 characters)."""
    s = F.split("text", r"\. ")
    warm = F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("..."))).otherwise(F.col("text"))
    cold = F.when(F.size(s) > 2, F.concat(F.array_join(F.slice(s, 1, 2), ". "), F.lit("."))).otherwise(F.substring("text", 1, 200))
    return memories.select("id", warm.alias("warm"), cold.alias("cold"), F.concat(F.lit("["), F.col("type"), F.lit("] "), F.substring("text", 1, 100), F.lit("...")).alias("frozen"))
