"""Rule-based understanding of texts: entities, relations, types, topics, turns, routing, conflicts, inference.

Patterns use ``(?U)``: word characters, digits and blanks are Unicode's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut, stage
from .grouppairs import product

# Patterns of typed entities; the first group of a match is the entity.
ENTITIES = [
    ("person", r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b"),
    ("person", r"\b((?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+)\b"),
    ("organization", r"\b([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:Inc|Corp|LLC|Ltd|Company|University|College|Institute|Foundation))\b"),
    ("organization", r"\b((?:Google|Microsoft|Amazon|Apple|Facebook|Meta|Tesla|Netflix|Uber|Airbnb|Spotify|GitHub|LinkedIn))\b"),
    ("location", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+(?:California|New York|Texas|Florida|Illinois|Washington|Massachusetts|Colorado|Oregon|Virginia))\b"),
    ("location", r"\b((?:San Francisco|New York City|Los Angeles|Chicago|Boston|Seattle|Austin|Denver|Portland|Miami|NYC))\b"),
    ("location", r"\b([A-Z][a-z]+\s+(?:City|State|Country|County|Province))\b"),
    ("date", r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b"),
    ("date", r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b"),
    ("date", r"\b(\d{4})\b"),
    ("date", r"\b((?:yesterday|today|tomorrow|last\s+week|next\s+month))\b"),
    ("skill", r"\b(Python|Java|JavaScript|TypeScript|C\+\+|Ruby|Go|Rust|Swift|Kotlin|PHP|SQL|HTML|CSS)\b"),
    ("skill", r"\b(machine\s+learning|artificial\s+intelligence|data\s+science|deep\s+learning|NLP|computer\s+vision)\b"),
    ("product", r"\b(iPhone|iPad|MacBook|Android|Windows|Linux|AWS|Azure|GCP)\b"),
    ("email", r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"),
    ("phone", r"\b(\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b"),
    ("phone", r"\b(\d{3}-\d{3}-\d{4})\b"),
    ("url", r"\b(https?://[^\s]+)\b"),
    ("url", r"\b(www\.[^\s]+\.[a-z]{2,})\b"),
    ("language", r"\b(Python|Java|JavaScript|TypeScript|C\+\+|C#|Ruby|Go|Rust|Swift|Kotlin|PHP|Scala|R|MATLAB|Perl|Shell|Bash)\b"),
    ("framework", r"\b(React|Angular|Vue|Django|Flask|FastAPI|Spring|Express|Rails|Laravel|TensorFlow|PyTorch|Keras|Scikit-learn)\b"),
    ("tool", r"\b(Docker|Kubernetes|Git|Jenkins|GitHub|GitLab|Jira|Confluence|VS Code|IntelliJ|Eclipse|PyCharm|Postman|Tableau|PowerBI)\b"),
    ("industry", r"\b(Finance|Healthcare|Technology|Education|Retail|Manufacturing|Consulting|Banking|Insurance|Real\s+Estate|E-commerce|Gaming)\b"),
    ("degree", r"\b((?:Bachelor|Master|PhD|Doctorate|Associate)\s+(?:of\s+)?(?:Science|Arts|Engineering|Business|Medicine)?)\b"),
    ("degree", r"\b(B\.?S\.?|M\.?S\.?|Ph\.?D\.?|M\.?B\.?A\.?|B\.?A\.?)\b"),
    ("certification", r"\b(AWS\s+Certified|Google\s+Cloud\s+Professional|Microsoft\s+Certified|Cisco\s+Certified|PMP|Scrum\s+Master|CFA|CPA)\b"),
]
# For patterns of ENTITIES by place, runs of letters from a capital on; a text without any of them has no match.
CAPITALS = {
    1: "Mr Mrs Ms Dr Prof",
    2: "Inc Corp LLC Ltd Company University College Institute Foundation",
    3: "Google Microsoft Amazon Apple Facebook Meta Tesla Netflix Uber Airbnb Spotify GitHub LinkedIn",
    4: "California New Texas Florida Illinois Washington Massachusetts Colorado Oregon Virginia",
    5: "San New Los Chicago Boston Seattle Austin Denver Portland Miami NYC",
    6: "City State Country County Province",
    8: "January February March April May June July August September October November December",
    11: "Python Java JavaScript TypeScript C Ruby Go Rust Swift Kotlin PHP SQL HTML CSS",
    13: "Phone Pad MacBook Android Windows Linux AWS Azure GCP",
    19: "Python Java JavaScript TypeScript C Ruby Go Rust Swift Kotlin PHP Scala R MATLAB Perl Shell Bash",
    20: "React Angular Vue Django Flask FastAPI Spring Express Rails Laravel TensorFlow PyTorch Keras Scikit",
    21: "Docker Kubernetes Git Jenkins GitHub GitLab Jira Confluence VS IntelliJ Eclipse PyCharm Postman Tableau PowerBI",
    22: "Finance Healthcare Technology Education Retail Manufacturing Consulting Banking Insurance Real E Gaming",
    23: "Bachelor Master PhD Doctorate Associate",
    24: "B BS M MS Ph PhD MB MBA BA",
    25: "AWS Google Microsoft Cisco PMP Scrum CFA CPA",
}
# The same for patterns that need digits, or a part.
DIGITS, HOLDS = (7, 9, 15, 16), {14: "@", 17: "http", 18: "www."}
# Relation, types of its ends, pattern (either case) with the two ends as groups.
RELATIONS = [
    ("works_at", "person", "organization", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:works?|working|employed)\s+(?:at|for)\s+([A-Z][A-Za-z\s&]+)"),
    ("located_in", "person", "location", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:lives?|living|based)\s+in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"),
    ("studied_at", "person", "organization", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:studied|graduated)\s+(?:at|from)\s+([A-Z][A-Za-z\s]+(?:University|College))"),
    ("located_in", "organization", "location", r"\b([A-Z][A-Za-z\s]+)\s+(?:is\s+)?(?:located|based)\s+in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"),
]
# Patterns (either case) of memory types; the types in order of precedence.
TYPES = {
    "fact": [r"\bmy name is\b", r"\bi'?m\s+\w+", r"\bcall me\b", r"\bi am\b", r"\bmy (job|work|position|role|title)\b", r"\bi (work|study|live)\b", r"\bmy (age|birthday|birth)\b", r"\bi (have|own|possess)\b", r"\bmy (address|email|phone|number)\b", r"\bi (was born|graduated|studied)\b", r"\bmy (family|parents|siblings|children)\b"],
    "preference": [r"\bi (like|love|enjoy|adore)\b", r"\bi (hate|dislike|detest)\b", r"\bmy favorite\b", r"\bi prefer\b", r"\bi'?d rather\b", r"\bi don'?t like\b", r"\bi appreciate\b", r"\bi fancy\b", r"\bi'?m fond of\b", r"\bi can'?t stand\b", r"\bi think .+ is (good|bad|great|terrible|amazing)\b"],
    "goal": [r"\bi want to\b", r"\bi plan to\b", r"\bmy goal is\b", r"\bi hope to\b", r"\bi aim to\b", r"\bi intend to\b", r"\bi wish to\b", r"\bi'?d like to\b", r"\bi need to\b", r"\bi (should|must|have to)\b", r"\bi will\b", r"\bi'?m going to\b", r"\bmy (dream|aspiration|ambition)\b", r"\bsomeday i\b"],
    "habit": [r"\bi (usually|always|often|regularly|frequently|typically)\b", r"\bevery (day|week|month|morning|night|evening)\b", r"\bi tend to\b", r"\bmy routine\b", r"\bi never\b", r"\bi rarely\b", r"\bi sometimes\b", r"\bi (habit|custom|practice)\b", r"\bon (mondays|tuesdays|wednesdays|thursdays|fridays|saturdays|sundays)\b", r"\beach (day|week|month|year)\b"],
    "event": [r"\b(yesterday|tomorrow)\b", r"\blast (week|month|year|night)\b", r"\bnext (week|month|year)\b", r"\b\d+ (days?|weeks?|months?|years?) ago\b", r"\b(happened|occurred|took place)\b", r"\b(meeting|appointment|event|conference)\b", r"\bon (january|february|march|april|may|june|july|august|september|october|november|december)\b", r"\bat \d+:\d+\b", r"\bwhen i (was|went|saw|met|did)\b", r"\bwhile i was\b", r"\bi (met|saw|attended|went to)\b"],
}
# Patterns of lower-cased texts by category, in order of precedence among equals.
CATEGORIES = {
    "goal": [r"\b(want to|plan to|planning to|goal|aim|trying to|working towards)\b", r"\b(will|going to)\b"],
    "preference": [r"\b(love|like|prefer|enjoy|favorite|hate|dislike)\b", r"\b(i want|i need|i wish)(?! to)\b"],
    "fact": [r"\b(is|are|was|were|has|have)\b", r"\b(work at|works at|working at|live in|lives in|living in)\b", r"\b(name is|age is|from|born in)\b"],
    "habit": [r"\b(always|usually|often|regularly|every day|daily|weekly)\b", r"\b(routine|habit|practice)\b"],
    "event": [r"\b(happened|occurred|went to|attended|visited)\b", r"\b(yesterday|last week|last month|on)\b"],
}
# Topics in order of precedence, and the parts of words that speak for them.
TOPICS = {
    "work": "work job career office colleague project meeting deadline",
    "personal": "family friend hobby home personal relationship",
    "health": "health exercise fitness diet medical doctor wellness",
    "food": "food restaurant cuisine meal cooking eating drink",
    "travel": "travel trip vacation hotel flight destination visit",
    "shopping": "buy purchase shopping store product price order",
    "entertainment": "movie music game show watch listen play",
    "learning": "learn study course book education skill knowledge",
    "technology": "software app computer phone tech digital code",
    "finance": "money bank payment budget invest financial cost",
}
# Pairs of contradicting parts, and parts that state an age.
CONTRADICTIONS = [("love", "hate"), ("like", "dislike"), ("enjoy", "don't enjoy"), ("prefer", "don't prefer"), ("allergic to", "not allergic"), ("can eat", "cannot eat"), ("yes", "no"), ("always", "never"), ("vegetarian", "not vegetarian"), ("vegan", "not vegan")]
AGES = ("age", "years old", "born in")
# Words that route a query to preferences or facts, and that tell its intent.
PREFERENCE_WORDS = "prefer like love hate dislike want need goal wish hope usually always never habit routine".split()
FACT_WORDS = "live work born studied graduated married located happened event visited traveled bought sold".split()
RECENT_TOKENS = "recently recent latest today yesterday now current currently last just new newest updated".split()
LIKING_TOKENS = "prefer preference like likes love loves favorite favourite enjoy enjoys want wanted".split()
# Groups of synonyms, and words that do not count for likeness.
SYNONYMS = ["love like enjoy adore prefer fond", "hate dislike detest loathe", "work job career employment position", "want need desire wish goal", "always usually often regularly frequently"]
STOP_WORDS = "i a the is am are was were be been being have has had do does did will would could should at on in to for of and or but not really very quite just so too also".split()
# How a turn begins or reads if it is a question, command, acknowledgement or clarification, and what it speaks of.
QUESTION = "what who where when why how is are can could would should".split()
COMMAND = ("please", "let's", "we should", "you should", "can you", "could you")
ACKNOWLEDGMENT = ("ok", "okay", "yes", "no", "sure", "right", "i see", "got it", "understood")
CLARIFICATION = ("i mean", "in other words", "to clarify", "what i meant")
POSITIVE = "good great excellent happy love thanks wonderful".split()
NEGATIVE = "bad terrible awful hate wrong problem issue".split()
ACTION = ("will", "going to", "need to", "should", "must", "have to", "todo", "to-do", "action:", "task:", "by", "deadline")
DECISION = ("decided", "decision", "agreed", "will go with", "chose", "selected", "picking", "final answer")


def _all(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def _parts(text: Column, parts) -> Column:
    """How many of the parts the text holds."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in parts])


def _words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical(kind: Column, text: Column) -> Column:
    """The canonical name of an entity of a kind."""
    t = _squeezed(text)
    replaced = lambda *pairs: reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, t)
    return (
        F.when(kind == "person", F.initcap(F.regexp_replace(t, r"^(?i:Mr|Mrs|Ms|Dr|Prof)\.?\s+", "")))
        .when(kind == "organization", replaced(("Inc.", "Inc"), ("Corp.", "Corp"), ("Ltd.", "Ltd")))
        .when(kind == "location", replaced(("NYC", "New York City"), ("SF", "San Francisco"), ("LA", "Los Angeles")))
        .when(kind == "email", F.lower(t))
        .when(kind == "url", F.replace(F.regexp_replace(t, "/+$", ""), F.lit("http://"), F.lit("https://")))
        .when(kind == "phone", F.regexp_replace(t, r"[^\d+]", ""))
        .otherwise(t)
    )


def entities(docs: DataFrame) -> DataFrame:
    """(id, type, name) of every entity that a pattern finds, each once a text; names of under two characters are none."""
    def typed(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text"))

    # most texts lack what most patterns need, so the text is searched for that once, not by each pattern
    capitals, digits = F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]*"), F.lit(0)), F.col("text").rlike(r"(?U)\d[-/]\d|\d{3}")
    marked = docs.where(F.col("text").isNotNull()).select("id", "text", F.array_distinct(capitals).alias("_capitals"), digits.alias("_digits"))
    needs = {k: F.arrays_overlap("_capitals", F.array(*map(F.lit, words.split()))) for k, words in CAPITALS.items()}
    needs |= {k: F.col("_digits") for k in DIGITS} | {k: F.contains("text", F.lit(part)) for k, part in HOLDS.items()}
    none = F.array().cast("array<string>")
    matches = [F.when(needs[k], _all("text", p)).otherwise(none) if k in needs else _all("text", p) for k, (_, p) in enumerate(ENTITIES)]
    found = F.concat(*[F.transform(m, typed(t)) for m, (t, _) in zip(matches, ENTITIES, strict=True)])
    # explode would have all patterns searched a second time, by a filter on the number of matches that Spark puts before it
    rows = marked.select("id", F.explode_outer(found).alias("e")).where(F.length(F.trim("e.text")) >= 2)
    return rows.select("id", F.col("e.type").alias("type"), canonical(F.col("e.type"), F.col("e.text")).alias("name")).distinct()


def relations(docs: DataFrame) -> DataFrame:
    """(id, relation, source, target) of every match of the relations' patterns."""
    def named(relation: str):
        return lambda x: F.struct(F.lit(relation).alias("r"), F.trim(x["a"]).alias("a"), F.trim(x["b"]).alias("b"))

    found = [F.transform(F.arrays_zip(_all("text", "(?i)" + p).alias("a"), _all("text", "(?i)" + p, 2).alias("b")), named(r)) for r, _, _, p in RELATIONS]
    rows = docs.where(F.col("text").isNotNull()).select("id", F.explode(F.concat(*found)).alias("e"))
    return rows.select("id", F.col("e.r").alias("relation"), F.col("e.a").alias("source"), F.col("e.b").alias("target"))


def _hits(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike("(?Ui)" + p).cast("int") for p in patterns])


def classify(docs: DataFrame) -> DataFrame:
    """The memory type by the first list of patterns with a hit, and by the list with
    most hits (the earlier of equals) with a confidence of .3, .6, .8 or 1."""
    x = docs.select("id", *[_hits(F.coalesce("text", F.lit("")), ps).alias(k) for k, ps in TYPES.items()])
    first = reduce(lambda acc, k: acc.when(F.col(k) > 0, k), list(TYPES)[1:], F.when(F.col("fact") > 0, "fact")).otherwise("context")
    most = F.greatest(*TYPES)
    best = reduce(lambda acc, k: acc.when(F.col(k) == most, k), list(TYPES), F.when(most == 0, "context"))
    return x.select("id", first.alias("type"), best.alias("surest"), F.when(most == 0, 0.3).when(most == 1, 0.6).when(most == 2, 0.8).otherwise(1.0).alias("confidence"))


def categorise(docs: DataFrame) -> DataFrame:
    """The category whose patterns have most hits, the earlier of equals; the given type without any."""
    x = docs.select("id", "type", *[_hits(F.coalesce("text", F.lit("")), ps).alias("_" + k) for k, ps in CATEGORIES.items()])
    most = F.greatest(*["_" + k for k in CATEGORIES])
    return x.select("id", reduce(lambda acc, k: acc.when(F.col("_" + k) == most, k), list(CATEGORIES), F.when(most == 0, F.col("type"))).alias("category"))


def topic(docs: DataFrame) -> DataFrame:
    """The topic that most parts speak for, the earlier of equals; without any the most
    frequent word of four letters or more, the earliest of equals; else general."""
    low = F.lower(F.coalesce("text", F.lit("")))
    x = docs.select("id", low.alias("t"), *[_parts(low, ps.split()).alias("_" + k) for k, ps in TOPICS.items()])
    most = F.greatest(*["_" + k for k in TOPICS])
    words = _all("t", r"\b([a-z]{4,})\b")
    counted = F.transform(F.array_distinct(words), lambda w: F.struct(F.size(F.filter(words, lambda v: v == w)).alias("n"), (-F.array_position(words, w)).alias("p"), w.alias("w")))
    named = reduce(lambda acc, k: acc.when(F.col("_" + k) == most, k), list(TOPICS), F.when(most == 0, F.coalesce(F.array_max(counted)["w"], F.lit("general"))))
    return x.select("id", named.alias("topic"))


def turn_kind(turns: DataFrame) -> DataFrame:
    """Type, sentiment, capitalised names, action and decision flags of each turn of a conversation."""
    text = F.coalesce("text", F.lit(""))
    low = F.trim(F.lower(text))
    begins = lambda xs: reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in xs])
    good, bad = _parts(F.lower(text), POSITIVE), _parts(F.lower(text), NEGATIVE)
    kind = F.when(F.contains(text, F.lit("?")) | begins(QUESTION), "question").when(begins(COMMAND), "command").when(low.isin(*ACKNOWLEDGMENT), "acknowledgment").when(_parts(low, CLARIFICATION) > 0, "clarification").otherwise("statement")
    names = F.array_except(_all(text, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 0), F.array(*map(F.lit, ("I", "The", "A", "An", "This", "That", "These", "Those"))))
    return turns.select(
        "conv_id", "turn", kind.alias("kind"),
        F.when(good > bad, "positive").when(bad > good, "negative").when(good > 0, "mixed").otherwise("neutral").alias("sentiment"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("names"),
        (_parts(F.lower(text), ACTION) > 0).alias("is_action"), (_parts(F.lower(text), DECISION) > 0).alias("is_decision"),
    )


def route(queries: DataFrame) -> DataFrame:
    """The collections a query goes to: a word matches a keyword if either begins with the other."""
    words = F.array_distinct(_words("text"))
    has = lambda keys: F.exists(words, lambda w: F.exists(F.array(*map(F.lit, keys)), lambda k: w.startswith(k) | k.startswith(w)))
    x = queries.select("id", has(PREFERENCE_WORDS).alias("p"), has(FACT_WORDS).alias("f"))
    return x.select("id", F.when(F.col("p") & ~F.col("f"), "prefs").when(F.col("f") & ~F.col("p"), "facts").otherwise("both").alias("route"))


def intent_weights(queries: DataFrame) -> DataFrame:
    """Weights of similarity, rerank, recency and importance: recency doubles for queries
    of the present, importance grows by half for queries of liking."""
    tokens = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != "")
    has = lambda keys: F.arrays_overlap(tokens, F.array(*map(F.lit, keys)))
    return queries.select("id", F.lit(0.55).alias("w_sim"), F.lit(0.2).alias("w_rerank"), F.when(has(RECENT_TOKENS), 0.3).otherwise(0.15).alias("w_recency"), F.when(has(LIKING_TOKENS), 0.1 * 1.5).otherwise(0.1).alias("w_importance"))


def time_window(queries: DataFrame) -> DataFrame:
    """Days to look back: by what the query says, else by its user's memories of the last week."""
    low = F.lower("text")
    has = lambda *ps: _parts(low, ps) > 0
    n = F.sum((F.col("days") <= 7).cast("int")).over(Window.partitionBy("user_id"))
    recent = F.when(n > 20, 7).when(n > 10, 14).when(n > 5, 30).otherwise(90)
    days = F.when(has("today", "now", "current"), 7).when(has("recent", "lately", "this week"), 14).when(has("this month", "past month"), 30).when(has("this year", "past year"), 365).when(has("ever", "always", "all time"), 3650).otherwise(recent)
    sure = F.when(has("today", "now", "current"), 0.9).when(has("recent", "lately", "this week", "this month", "past month"), 0.85).when(has("this year", "past year"), 0.8).when(has("ever", "always", "all time"), 0.9).otherwise(0.6)
    return queries.select("id", days.alias("window_days"), sure.alias("confidence"))


def _distinct_texts(memories: DataFrame, *by: str) -> DataFrame:
    """Equal texts of a group are one class: (class id, members, words)."""
    return memories.groupBy(*by, "text").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("members"))


#: Classes of a user in a part at least and at most, parts of a user in between; and classes that are compared at once.
PART, PART_MOST, PARTS, TOGETHER = 512, 500_000, 16, 512


def _likeness(left: pa.Table, right: pa.Table | None, least: float) -> Iterator[pa.RecordBatch]:
    """Alike pairs of the classes of two parts of a user, or of those of one (``right`` is none)."""
    classes = left if right is None else pa.concat_tables([left, right])
    classes = classes.combine_chunks()
    ids, members, g = (classes[c].to_numpy() for c in ("cls", "members", "g"))
    low = classes["low"].to_pylist()
    w = classes["w"].combine_chunks()
    word = w.flatten().dictionary_encode().indices.to_numpy()
    size = w.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    touched = np.array([bin(k).count("1") for k in range(1 << len(SYNONYMS))])
    chunks = lambda start, stop: [(s, min(s + TOGETHER, stop)) for s in range(start, stop, TOGETHER)]
    first = chunks(0, len(left))
    second = first if right is None else chunks(len(left), len(classes))
    for s, e in first:
        for p, q in second:
            if right is None and p < s:
                continue
            vocab, at = np.unique(np.concatenate([word[ends[s] - size[s] : ends[e - 1]], word[ends[p] - size[p] : ends[q - 1]]]), return_inverse=True)
            n = size[s:e].sum()
            x, y = np.zeros((e - s, len(vocab)), np.float32), np.zeros((q - p, len(vocab)), np.float32)
            x[np.repeat(np.arange(e - s), size[s:e]), at[:n]] = 1
            y[np.repeat(np.arange(q - p), size[p:q]), at[n:]] = 1
            both = (x @ y.T).astype(np.float64)
            na, nb = size[s:e, None], size[None, p:q]
            like = np.minimum(both / (na + nb - both) + 0.2 * touched[g[s:e, None] & g[None, p:q]], 1.0)
            pair = ids[s:e, None] != ids[None, p:q]
            if right is None and p == s:
                pair = np.triu(pair, 1)
            # all words of a text that another holds are words of that one, but for the first and the last
            held = pair & (like < 0.8) & (both >= np.minimum(na, nb) - 2)
            for i, j in zip(*(k.tolist() for k in np.nonzero(held)), strict=True):
                if low[s + i] in low[p + j] or low[p + j] in low[s + i]:
                    like[i, j] = 0.8
            i, j = np.nonzero(pair & (like >= least - 1e-6))
            if len(i):
                o, u = i + s, j + p
                flip = ids[o] > ids[u]
                a, b = np.where(flip, u, o), np.where(flip, o, u)
                yield pa.record_batch([classes["user_id"].combine_chunks().take(pa.array(a)), *map(pa.array, (ids[a], ids[b], members[a], members[b], like[i, j]))], ["user_id", "a", "b", "n_a", "n_b", "s"])


def _users(least: float):
    """Rows by user, parts ``i`` <= ``j`` and side: what a task compares is one pair of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(held)
            n = int(rows["side"].to_numpy().sum())
            if key[1] == key[2]:
                yield from _likeness(rows, None, least)
            elif 0 < n < len(rows):
                yield from _likeness(rows.slice(0, len(rows) - n), rows.slice(len(rows) - n), least)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])] if keys else []
            found = []
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if held and keys[s] != key:
                    found += close()
                    held = []
                key = keys[s]
                held.append(rows.slice(s, e - s))
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
        if held:
            yield from close()

    return run


def lexical_likeness(memories: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of different texts of a user that are alike: token Jaccard without stop
    words, .2 more for each group of synonyms that both touch, .8 at least if one
    holds the other, 1 at most. Equal texts are one class, named by its least id, with
    its number of members.

    All classes of a user meet in one task; those of a user with over ``PART`` in parts, at most ``PARTS`` up to
    eight million classes, each pair of parts in a task. So only classes are shuffled, never pairs."""
    groups = [F.array(*map(F.lit, g.split())) for g in SYNONYMS]
    words = F.array_except(_words("text"), F.array(*map(F.lit, STOP_WORDS)))
    cls = _distinct_texts(memories.where("user_id IS NOT NULL"), "user_id").where((F.size(words) > 0) & F.col("cls").isNotNull())
    cls = stage(cls, "texts")
    n = F.count(F.lit(1))
    parts = F.greatest(F.least(F.lit(PARTS), F.ceil(n / PART)), F.ceil(n / PART_MOST)).cast("int")
    # at most one row for PART classes, so it is broadcast
    wide = cls.groupBy("user_id").agg(n.alias("n"), parts.alias("parts")).where(F.col("n") > PART).select("user_id", "parts")
    placed = cls.join(F.broadcast(wide), "user_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("user_id", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "cls", "members", "text")
    met = met.repartition("user_id", "i", "j").sortWithinPartitions("user_id", "i", "j", "side").select("*", words.alias("w"))
    touches = reduce(lambda a, b: a + b, [F.when(F.arrays_overlap(g, F.col("w")), 1 << k).otherwise(0) for k, g in enumerate(groups)])
    rows = met.select("user_id", "i", "j", "side", F.col("cls").cast("long").alias("cls"), "members", F.lower("text").alias("low"), "w", touches.cast("int").alias("g"))
    kind = memories.schema["user_id"].dataType.simpleString()
    found = rows.mapInArrow(_users(least), f"user_id {kind}, a long, b long, n_a long, n_b long, s double")
    return found.select("user_id", "a", "b", "n_a", "n_b", F.round("s", 9).alias("s")).where(F.col("s") >= least)


# Parts that deny, and opposite parts, of a text that may replace another.
NEGATIONS = ("don't", "dont", "doesn't", "doesnt", "didn't", "didnt", "not", "no", "never", "no longer", "used to", "changed", "different", "instead", "stopped", "quit", "avoid", "dislike", "hate")
OPPOSITES = [(("love", "like", "enjoy", "prefer"), ("hate", "dislike", "avoid")), (("work", "working"), ("quit", "left", "fired", "unemployed")), (("live", "lives"), ("moved", "relocated"))]


def smart_update(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """What to do with a new text beside an old one, and by how much the old memory's
    confidence changes: skip, update, merge or keep both.

    Pairs: id, old, new, idle_days and confidence of the old memory."""
    old, new = F.lower("old"), F.lower("new")
    w1, w2 = F.array_distinct(_words(F.trim("old"))), F.array_distinct(_words(F.trim("new")))
    s = F.when(F.trim(old) == F.trim(new), 1.0).when((F.size(w1) == 0) | (F.size(w2) == 0), 0.0).otherwise(F.size(F.array_intersect(w1, w2)) / F.size(F.array_union(w1, w2)))
    denies = lambda t: _parts(t, NEGATIONS) > 0
    has = lambda t, xs: _parts(t, xs) > 0
    opposed = reduce(lambda a, b: a | b, [(has(old, p) & has(new, n)) | (has(old, n) & has(new, p)) for p, n in OPPOSITES])
    clash = (denies(old) != denies(new)) | opposed
    longer = F.length("new") > F.length("old") * 1.2
    fresh = (F.col("idle_days") < 7) & (F.col("confidence") > 0.8)
    x = pairs.select("id", s.alias("s"), clash.alias("clash"), longer.alias("longer"), fresh.alias("fresh"), F.contains(new, old).alias("expands"), F.contains(old, new).alias("within"))
    near, related = F.col("s") > threshold, F.col("s") > 0.6
    action = (
        F.when(F.col("s") > 0.95, "skip")
        .when(near & ~F.col("longer"), "skip").when(near & F.col("expands"), "update").when(near & F.col("within"), "skip").when(near, "merge")
        .when(related & F.col("clash") & F.col("fresh"), "skip").when(related & F.col("clash"), "update").otherwise("keep_both")
    )
    change = F.when(F.col("s") > 0.95, 0.1).when(near & (~F.col("longer") | (F.col("within") & ~F.col("expands"))), 0.05).when(~near & related & F.col("clash") & F.col("fresh"), -0.1).otherwise(0.0)
    return x.select("id", F.round("s", 9).alias("s"), action.alias("action"), change.alias("change"))


def conflicts(memories: DataFrame, similarity: float = 0.75, least: float = 0.85) -> DataFrame:
    """Pairs of a user's memories of one type, alike by the cosine of their word sets,
    that contradict: one holds a part, the other its opposite (.85), or both state an
    age and are over a year apart (.9). ``a`` is the earlier id."""
    m = memories.select("user_id", "type", "id", "us", "confidence", "importance", F.lower("text").alias("low"), F.array_distinct(_words("text")).alias("w"))
    # what a text says: (number of the contradiction, side), or (-1, 0) for an age; sides of opposite sign meet
    said = [F.when(F.contains("low", F.lit(part)), F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"))) for i, pair in enumerate(CONTRADICTIONS) for part, side in zip(pair, (1, -1), strict=True)]
    said.append(F.when(_parts(F.col("low"), AGES) > 0, F.struct(F.lit(-1).alias("i"), F.lit(0).alias("side"))))
    keys = m.select("user_id", "type", "id", F.explode(F.array_compact(F.array(*said))).alias("k")).select("user_id", "type", "id", "k.i", "k.side")
    other = keys.select(F.col("user_id").alias("u2"), F.col("type").alias("t2"), F.col("id").alias("id2"), F.col("i").alias("i2"), (-F.col("side")).alias("s2"))
    met = keys.join(other, (F.col("user_id") == F.col("u2")) & (F.col("type") == F.col("t2")) & (F.col("i") == F.col("i2")) & (F.col("side") == F.col("s2")) & (F.col("id") != F.col("id2")))
    met = met.groupBy(F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b")).agg(F.max(F.col("i") >= 0).alias("direct"), F.max(F.col("i") < 0).alias("aged"))
    own = ("id", "us", "confidence", "importance", "w")
    a, b = m.select(*[F.col(c).alias(c + "_a") for c in own]), m.select(*[F.col(c).alias(c + "_b") for c in own])
    pairs = met.join(a, "id_a").join(b, "id_b")
    cosine = F.size(F.array_intersect("w_a", "w_b")) / F.sqrt(F.size("w_a") * F.size("w_b"))
    aged = F.col("aged") & (F.abs(F.col("us_a") - F.col("us_b")) > 31_557_600_000_000)
    kind = F.when(F.col("direct"), "direct_contradiction").when(aged, "temporal_inconsistency")
    x = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round(cosine, 9).alias("s"), kind.alias("kind"), F.when(F.col("direct"), 0.85).when(aged, 0.9).alias("confidence"), "us_a", "us_b", "confidence_a", "confidence_b", "importance_a", "importance_b")
    return x.where((F.col("s") >= similarity) & (F.col("confidence") >= least))


def resolve(found: DataFrame) -> DataFrame:
    """The survivor of each conflict by time (the first of equals), by confidence and by importance (both then by time)."""
    later = F.when(F.col("us_b") > F.col("us_a"), F.col("b")).otherwise(F.col("a"))
    by = lambda c: F.when(F.col(c + "_b") > F.col(c + "_a"), F.col("b")).when(F.col(c + "_a") > F.col(c + "_b"), F.col("a")).otherwise(later)
    return found.select("a", "b", later.alias("by_time"), by("confidence").alias("by_confidence"), by("importance").alias("by_importance"))


def beliefs(memories: DataFrame, found: DataFrame, penalty: float = 0.5, least: float = 0.3) -> DataFrame:
    """Confidence of every memory after a penalty for each of its conflicts; below ``least`` it is contradicted."""
    n = found.select(F.explode(F.array("a", "b")).alias("_i")).groupBy("_i").agg(F.count(F.lit(1)).alias("n"))
    x = memories.select("id", "confidence").join(n, F.col("id") == F.col("_i"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("confidence") * F.pow(F.lit(1 - penalty), F.coalesce("n", F.lit(0)))).alias("c"))
    return x.select("id", "n", F.round("c", 9).alias("confidence"), F.when((F.col("n") > 0) & (F.col("c") < least), "contradicted").otherwise("active").alias("state"))


def propagate(held: DataFrame, support: DataFrame, penalty: float = 0.5, least: float = 0.3) -> DataFrame:
    """One step along support (source, target): a belief loses a quarter for each of its
    supports that is contradicted; below ``least`` it is suspended."""
    lost = support.join(held.where("state = 'contradicted'").select(F.col("id").alias("source")), "source", "left_semi").groupBy("target").agg(F.count(F.lit(1)).alias("lost"))
    x = held.where("state = 'active'").join(lost, F.col("id") == F.col("target")).select("id", "lost", (F.col("confidence") * F.pow(F.lit(1 - penalty * 0.5), F.col("lost"))).alias("c"))
    return x.select("id", "lost", F.round("c", 9).alias("confidence"), F.when(F.col("c") < least, "suspended").otherwise("active").alias("state"))


def infer(edges: DataFrame, together: int | None = None) -> DataFrame:
    """Facts (src, dst, rule, confidence) that follow from two edges, an inverse edge or a shared place.

    All entities of a place are paired, which grows with the square of a place; with ``together``, the first so
    many by id. Each fact is there once: only pairs of entities of several places can repeat, so only these are compared."""
    a, b = edges.select("src", F.col("dst").alias("mid"), F.col("relation").alias("r1")), edges.select(F.col("src").alias("mid"), "dst", F.col("relation").alias("r2"))
    # First relation, second relation, rule, confidence.
    rules = [("works_at", "located_in", "works_at_location_inference", 0.7), ("studied_at", "located_in", "studied_at_location_inference", 0.7), ("manages", "works_at", "manages_works_at_inference", 0.7), ("knows", "works_at", "knows_organization_inference", 0.5), ("part_of", "part_of", "part_of_transitive", 0.65)]
    rule = reduce(lambda acc, x: acc.when((F.col("r1") == x[0]) & (F.col("r2") == x[1]), F.struct(F.lit(x[2]).alias("rule"), F.lit(x[3]).alias("confidence"))), rules[1:], F.when((F.col("r1") == rules[0][0]) & (F.col("r2") == rules[0][1]), F.struct(F.lit(rules[0][2]).alias("rule"), F.lit(rules[0][3]).alias("confidence"))))
    two = a.where(F.col("r1").isin(*{x[0] for x in rules})).join(b.where(F.col("r2").isin(*{x[1] for x in rules})), "mid").select("src", "dst", rule.alias("x")).where("x is not null").select("src", "dst", "x.rule", "x.confidence")
    founder = edges.where("relation = 'founded_by'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("founded_by_inverse").alias("rule"), F.lit(0.8).alias("confidence"))
    at = edges.where("relation = 'located_in'").select("src", "dst").distinct()
    if together is not None:
        at = at.withColumn("_r", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("_r") <= together)
    at = at.where("src IS NOT NULL AND dst IS NOT NULL").withColumnRenamed("src", "id")
    at = stage(at.join(at.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("spread")), "id"), "places")
    alone, spread = (at.where(c).select("dst", "id") for c in ("NOT spread", "spread"))
    met = product(alone, alone, "dst").where("a < b").select("a", "b").union(product(alone, spread, "dst").select(F.least("a", "b"), F.greatest("a", "b")))
    met = met.union(product(spread, spread, "dst").where("a < b").select("a", "b").distinct())
    near = met.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("co_location_inference").alias("rule"), F.lit(0.4).alias("confidence"))
    return two.union(founder).distinct().union(near)


def fired_intents(intents: DataFrame, contexts: DataFrame, now_us: int) -> DataFrame:
    """Pending intents that fire: by context (any keyword, or the pattern, in a text of
    their user, either case) or by time (due, and within the window). A recurring intent
    is pending again with its next time while occurrences are left and it has not
    expired; others are triggered. Pending ones past their expiry are expired.

    Intents: id, user_id, trigger (event, time or hybrid), keywords array, pattern,
    due_us, until_us, every_us, remaining, expires_us. Contexts: user_id, text.
    """
    texts = contexts.select(F.col("user_id").alias("_u"), F.lower("text").alias("_t")).distinct()
    keyed = intents.where(F.col("trigger").isin("event", "hybrid") & F.col("keywords").isNotNull()).select("id", "user_id", F.explode("keywords").alias("_k"))
    by_word = keyed.join(texts, (F.col("user_id") == F.col("_u")) & F.contains("_t", F.lower("_k"))).select("id")
    patterned = intents.where(F.col("trigger").isin("event", "hybrid") & F.col("pattern").isNotNull()).select("id", "user_id", "pattern")
    by_pattern = patterned.join(texts, (F.col("user_id") == F.col("_u")) & F.expr("regexp_like(_t, concat('(?i)', pattern))")).select("id")
    hit = by_word.union(by_pattern).distinct().select(F.col("id").alias("_i"))
    due = F.col("trigger").isin("time", "hybrid") & (F.col("due_us") <= now_us) & (F.col("until_us").isNull() | (F.col("until_us") >= now_us))
    x = intents.join(hit, F.col("id") == F.col("_i"), "left").withColumn("fired", F.col("_i").isNotNull() | F.coalesce(due, F.lit(False)))
    left = F.col("remaining") - 1
    upcoming = F.lit(now_us) + F.col("every_us")
    again = F.col("every_us").isNotNull() & (F.col("remaining").isNull() | (left > 0)) & (F.col("expires_us").isNull() | (upcoming < F.col("expires_us")))
    late = ~F.col("fired") & F.coalesce(F.col("expires_us") < now_us, F.lit(False))
    return x.select(
        "id", "fired",
        F.when(late, "expired").when(~F.col("fired") | again, "pending").otherwise("triggered").alias("status"),
        F.when(F.col("fired") & again, upcoming).otherwise(F.col("due_us")).alias("due_us"),
        F.when(F.col("fired") & F.col("every_us").isNotNull(), left).otherwise(F.col("remaining")).alias("remaining"),
    )


def effective_permission(namespaces: DataFrame, grants: DataFrame, requests: DataFrame) -> DataFrame:
    """The permission of each request (path, user_id): the namespace's own (owner, explicit,
    read if public), else the first of its ancestors from the root down, if it inherits.

    Namespaces: path, owner_id, is_public, inherits. Grants: path, user_id, permission.
    """
    asked = requests.select(F.col("path").alias("asked"), F.col("user_id").alias("asker")).distinct()
    parts = F.split("asked", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("at")))
    steps = asked.select("asked", "asker", F.explode(up).alias("s")).select("asked", "asker", "s.depth", "s.at")
    known = namespaces.select(F.col("path").alias("at"), "owner_id", "is_public", "inherits")
    given = grants.select(F.col("path").alias("gp"), F.col("user_id").alias("gu"), "permission")
    x = steps.join(known, "at").join(given, (F.col("gp") == F.col("at")) & (F.col("gu") == F.col("asker")), "left")
    own = F.when(F.col("owner_id") == F.col("asker"), "owner").otherwise(F.coalesce("permission", F.when(F.col("is_public"), F.lit("read"))))
    itself = F.col("at") == F.col("asked")
    x = x.select("asked", "asker", "depth", own.alias("p"), itself.alias("itself"), "inherits")
    best = x.groupBy("asked", "asker").agg(F.max(F.when(F.col("itself"), F.col("p"))).alias("mine"), F.max(F.when(F.col("itself"), F.col("inherits"))).alias("inherits"), F.min_by("p", F.when(F.col("p").isNotNull() & ~F.col("itself"), F.col("depth"))).alias("theirs"))
    out = asked.join(best, ["asked", "asker"], "left")
    # a namespace that does not exist grants nothing, whatever its path's ancestors say
    return out.select(F.col("asked").alias("path"), F.col("asker").alias("user_id"), F.coalesce("mine", F.when(F.col("inherits"), F.col("theirs")), F.lit("none")).alias("permission"))


#: Parts of a product of places and members, about; from there on parts grow.
PRODUCTS = 512


def effective_permission_of_groups(namespaces: DataFrame, grants: DataFrame, places: DataFrame, members: DataFrame, rows: int = 20_000_000) -> DataFrame:
    """The same for every member of a group on every place of it, where requests are that product.

    What the ancestors give depends on a place's parent and the member alone, so it is found once for
    each of these; the product itself is then one join, salted to about ``rows`` rows a part (more from some ``PRODUCTS`` parts
    on, so that what is sent stays small beside the product) and never shuffled.
    Places: grp, path (a path is of one group). Members: grp, user_id. Others as above.
    """
    leaf = places.select("grp", "path").where("grp IS NOT NULL AND path IS NOT NULL").distinct()
    asker = members.select("grp", F.col("user_id").alias("asker")).where("grp IS NOT NULL").distinct()
    known, given = namespaces.select("path", "owner_id", "is_public", "inherits").distinct(), grants.select(F.col("path").alias("gp"), F.col("user_id").alias("gu"), "permission")
    parts = F.split("path", "/")
    leaf = leaf.select("grp", "path", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"))

    # from the root down, the first ancestor that gives the member anything
    chain = F.split("parent", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(chain)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(chain, F.lit(1), i), "/").alias("at")))
    above = leaf.select("grp", "parent").distinct().select("grp", "parent", F.explode(up).alias("s")).select("grp", "parent", "s.depth", "s.at").join(known.withColumnRenamed("path", "at"), "at")
    steps = above.join(asker, "grp").join(given, (F.col("gp") == F.col("at")) & (F.col("gu") == F.col("asker")), "left")
    own = F.when(F.col("owner_id") == F.col("asker"), "owner").otherwise(F.coalesce("permission", F.when(F.col("is_public"), F.lit("read"))))
    theirs = steps.select("grp", "parent", "asker", F.struct("depth", own.alias("p")).alias("p")).where("p.p IS NOT NULL").groupBy("grp", "parent", "asker").agg(F.min("p").alias("p")).select("grp", "parent", "asker", F.col("p.p").alias("theirs"))

    # what members are granted on the places themselves, by member
    direct = leaf.select("grp", "path", "parent").join(given, F.col("gp") == F.col("path")).groupBy("grp", "parent", F.col("gu").alias("asker"), "path").agg(F.max("permission").alias("permission"))
    direct = direct.groupBy("grp", "parent", "asker").agg(F.map_from_entries(F.collect_list(F.struct("path", "permission"))).alias("direct"))
    key = ["grp", "parent", "asker"]
    each = asker.join(leaf.select("grp", "parent").distinct(), "grp").select(*key, F.lit(True).alias("member"))
    each = each.unionByName(theirs, True).unionByName(direct, True).groupBy(*key).agg(F.max("member").alias("member"), F.max("theirs").alias("theirs"), F.first("direct", True).alias("direct")).where("member").drop("member")

    counted = lambda df, name: df.groupBy("grp", "parent").agg(F.count(F.lit(1)).alias(name))
    sizes = stage(counted(leaf, "n_places").join(counted(asker.join(leaf.select("grp", "parent").distinct(), "grp"), "n_members"), ["grp", "parent"]), "sizes")
    total = sizes.agg(F.sum(F.col("n_places").cast("double") * F.col("n_members"))).first()[0] or 0
    # both sides are dealt, so that members sent for each part of the places and places sent for each part of the members are about as many
    parts = F.ceil(F.col("n_places").cast("double") * F.col("n_members") / max(rows, total / PRODUCTS))
    wide = F.least(parts, F.ceil(F.sqrt(parts * F.col("n_members") / F.col("n_places"))))
    salts = sizes.select("grp", "parent", wide.cast("int").alias("xs"), F.ceil(parts / wide).cast("int").alias("ys"))
    tasks = int(min(4 * PRODUCTS, 2 * (salts.agg(F.sum(F.col("xs").cast("long") * F.col("ys"))).first()[0] or 0) + 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["grp", "parent", "x", "y"]
    each = each.join(salts, ["grp", "parent"]).withColumn("x", own("asker", "xs")).withColumn("y", every("ys")).drop("xs", "ys")
    space = leaf.join(known.withColumn("exists", F.lit(True)), "path", "left").join(salts, ["grp", "parent"]).withColumn("y", own("path", "ys")).withColumn("x", every("xs")).drop("xs", "ys")
    # what needs a place or a member alone is found before the product
    free = F.when(F.col("exists") & F.col("is_public"), "read").when(~F.coalesce(F.col("exists") & F.col("inherits"), F.lit(False)), "none")
    space = space.select(*cell, "path", "owner_id", F.coalesce("exists", F.lit(False)).alias("exists"), free.alias("free"))
    each = each.select(*cell, "asker", "direct", F.coalesce("theirs", F.lit("none")).alias("theirs"))
    # a stated number of tasks, as Spark would judge it by the bytes that go into the product
    met = space.repartition(tasks, *cell).join(each.repartition(tasks, *cell), cell)
    granted = F.when(F.col("direct").isNotNull() & F.col("exists"), F.col("direct")[F.col("path")])
    return met.select("path", F.col("asker").alias("user_id"), F.when(F.col("owner_id") == F.col("asker"), "owner").otherwise(F.coalesce(granted, "free", "theirs")).alias("permission"))


def distances(edges: DataFrame, start: int) -> DataFrame:
    """(v, depth): fewest directed hops from a node. Each round extends the frontier by
    nodes not seen before, so the rounds are as many as the longest of the paths."""
    nodes = edges.select(F.col("src").alias("u"), F.col("dst").alias("w")).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "v int, depth int")
    depth = 0
    while True:
        front = seen.where(F.col("depth") == depth).select(F.col("v").alias("u"))
        new = nodes.join(front, "u", "left_semi").select(F.col("w").alias("v")).distinct().join(seen, "v", "left_anti")
        after = cut(seen.union(new.select("v", F.lit(depth + 1).alias("depth"))))
        if after.where(F.col("depth") == depth + 1).isEmpty():
            return after
        seen, depth = after, depth + 1
