"""Facts in texts: categories by pattern, time from what stands around, quality, conversations, related facts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Category, pattern (either case), words before the fact, groups of the fact, group of its entity.
PATTERNS = [
    ("employment", r"\b(?:work|works|working|worked)\s+(?:at|for)\s+([A-Z][A-Za-z\s&]+)", "works at {0}"),
    ("employment", r"\b(?:employed|employee)\s+(?:at|by)\s+([A-Z][A-Za-z\s&]+)", "employed at {0}"),
    ("occupation", r"\b(?:I am|I\'m|is)\s+(?:a|an)\s+([a-z\s]+(?:engineer|developer|designer|manager|analyst|scientist|teacher|doctor|lawyer|consultant))", "is a {0}"),
    ("location", r"\b(?:live|lives|living|lived)\s+in\s+([A-Z][A-Za-z\s]+)", "lives in {0}"),
    ("location", r"\b(?:from|based in)\s+([A-Z][A-Za-z\s]+)", "from {0}"),
    ("education", r"\b(?:studied|studying|study)\s+([a-z\s]+)\s+at\s+([A-Z][A-Za-z\s]+)", "studied {0} at {1}"),
    ("education", r"\b(?:graduated|degree)\s+(?:from|in)\s+([A-Z][A-Za-z\s]+)", "graduated from {0}"),
    ("skill", r"\b(?:know|knows|skilled in|proficient in|expert in)\s+([A-Za-z\s,]+)", "skilled in {0}"),
    ("preference", r"\b(?:love|loves|like|likes|prefer|prefers|enjoy|enjoys)\s+([a-z\s]+)", "likes {0}"),
    ("goal", r"\b(?:want to|plan to|planning to|goal is to|aiming to)\s+([a-z\s]+)", "wants to {0}"),
]
# Patterns (either case) of the time of a fact, in order of precedence.
TIMES = [
    ("present", r"\b(?:currently|now|today|these days|at present)\b"),
    ("present", r"\b(?:am|is|are)\b"),
    ("past", r"\b(?:was|were|had|used to|previously|formerly|in the past)\b"),
    ("past", r"\b(?:yesterday|last week|last month|last year|ago)\b"),
    ("future", r"\b(?:will|going to|planning to|next week|next month|next year|soon|tomorrow)\b"),
    ("start_date", r"\b(?:started|began|joined|since)\s+(?:in\s+)?(\d{4}|[A-Z][a-z]+\s+\d{4})\b"),
    ("end_date", r"\b(?:ended|finished|left|until)\s+(?:in\s+)?(\d{4}|[A-Z][a-z]+\s+\d{4})\b"),
]
# Relevance of the categories that patterns find, and those that raise confidence.
RELEVANCE = {"employment": 0.9, "occupation": 0.9, "education": 0.85, "skill": 0.85, "goal": 0.8, "preference": 0.7, "location": 0.65}
TRUSTED = ("employment", "occupation", "education", "skill")
AROUND, CONFIDENCE = 50, 0.85


def extract(docs: DataFrame) -> DataFrame:
    """(id, category, fact, entity, temporal, temporal_type, start) of every fact, the first
    of equal ones of a text (but for case). ``temporal`` is a year within 50 characters, ''
    without one or without a word of time. Positions need matches, so this is a pass in Python."""
    patterns = [(c, re.compile(p, re.IGNORECASE), say) for c, p, say in PATTERNS]
    times = [(k, re.compile(p, re.IGNORECASE)) for k, p in TIMES]
    year = re.compile(r"\b(\d{4})\b")

    def of(text: str):
        seen = set()
        for category, pattern, say in patterns:
            for m in pattern.finditer(text):
                groups = [g.strip() for g in m.groups()]
                fact = say.format(*groups)
                if (category, fact.lower()) in seen:
                    continue
                seen.add((category, fact.lower()))
                around = text[max(0, m.start() - AROUND) : m.end() + AROUND]
                kind = next((k for k, p in times if p.search(around)), None)
                when = year.search(around) if kind else None
                yield category, fact, groups[-1], when.group(1) if when else "", kind or "present", m.start()

    def run(batches):
        for pdf in batches:
            rows = [(i, *found) for i, t in zip(pdf.id, pdf.text, strict=True) for found in of(t or "")]
            yield pd.DataFrame(rows, columns=["id", "category", "fact", "entity", "temporal", "temporal_type", "start"])

    return docs.select("id", "text").mapInPandas(run, "id long, category string, fact string, entity string, temporal string, temporal_type string, start long")


def with_quality(facts: DataFrame) -> DataFrame:
    """Facts with specificity, verifiability, completeness, clarity, relevance, their
    weighted mean and a confidence raised by it."""
    n = F.size(F.split(F.trim("fact"), r"\s+"))
    has, dated = F.col("entity") != "", F.col("temporal") != ""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in RELEVANCE.items() for x in kv]), F.col("category"))
    x = facts.withColumns({
        "specificity": F.least(F.lit(1.0), n / 20.0 + F.when(has, 0.2).otherwise(0.0)),
        "verifiability": F.when(has, 0.4).otherwise(0.0) + F.when(dated, 0.3).otherwise(0.0) + 0.3,
        "completeness": F.lit(0.3 + 0.2 + 0.15) + F.when(has, 0.2).otherwise(0.0) + F.when(dated, 0.15).otherwise(0.0),
        "clarity": F.when(n < 3, 0.5).when(n > 30, 0.7).otherwise(1.0),
        "relevance": weight * CONFIDENCE,
    })
    x = x.withColumn("quality", F.col("specificity") * 0.2 + F.col("verifiability") * 0.25 + F.col("completeness") * 0.25 + F.col("clarity") * 0.15 + F.col("relevance") * 0.15)
    sure = F.least(F.lit(1.0), CONFIDENCE + F.col("quality") * 0.15 + F.when(has, 0.03).otherwise(0.0) + F.when(dated, 0.05).otherwise(0.0) + F.when(F.col("category").isin(*TRUSTED), 0.05).otherwise(0.0))
    return x.withColumn("confidence", sure)


def turns_of(transcripts: DataFrame) -> DataFrame:
    """(id, turn, text) of transcripts: a line that begins with User:, Assistant: or System:
    begins a turn and loses the mark, other lines that are not blank go on with it."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.struct(x.rlike("^(User|Assistant|System):").cast("int").alias("b"), F.regexp_replace(x, r"^(?:User|Assistant|System):\s*", "").alias("t")))
    at = transcripts.where(F.col("text").isNotNull()).select("id", F.posexplode(marked).alias("p", "x")).select("id", "p", "x.b", "x.t")
    run = F.sum("b").over(Window.partitionBy("id").orderBy("p"))
    spoken = at.withColumn("turn", run).where("t <> ''")
    return spoken.groupBy("id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), " ").alias("text"))


def related(facts: DataFrame) -> DataFrame:
    """Each fact with the other facts of its text and entity, sorted, joined by semicolons."""
    groups = facts.groupBy("id", "entity").agg(F.collect_set("fact").alias("_all"))
    return facts.join(groups, ["id", "entity"]).withColumn("related", F.array_join(F.array_sort(F.array_except("_all", F.array("fact"))), ";")).drop("_all")
