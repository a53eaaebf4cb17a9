"""Record keeping: conditions, clones, metadata, anonymised texts, imports, lineage, access, sessions, graph scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import health

# Patterns of a lower-cased conversation by the type of memory that their group is.
EXTRACTED = [
    ("preference", r"(?:i|user) (?:prefer|like|love|hate|dislike|enjoy|want)s?\s+(.+)"),
    ("preference", r"(?:my|user's) (?:favorite|preferred)\s+(.+)"),
    ("goal", r"(?:i|user) (?:want to|plan to|will|goal is to|aim to|trying to)\s+(.+)"),
    ("goal", r"(?:my|user's) goal is\s+(.+)"),
    ("fact", r"(?:i|user) (?:live in|work at|am from|studied at|graduated from|am a)\s+(.+)"),
    ("fact", r"(?:my|user's) (?:name is|job is|work is)\s+(.+)"),
    ("context", r"(?:looking for|searching for|need|want)\s+(.+)"),
    ("context", r"(?:interested in|curious about)\s+(.+)"),
]
# Names of technologies that mark a session's subject.
TECHNOLOGY = r"\b(Python|JavaScript|TypeScript|Java|Go|Rust|TensorFlow|PyTorch|React|Vue|Angular|Docker|Kubernetes|AWS|Azure|GCP)\b"
# Mail addresses, telephone and social security numbers, masked in this order.
PERSONAL = [(r"\b[\w.-]+@[\w.-]+\.\w+\b", "[EMAIL]"), (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"), (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]")]


def holds(field: Column, operator: str, expected) -> Column:
    """One condition of a trigger: eq, gt, lt, contains or matches; a null field fails, as does another operator."""
    text = field.cast("string")
    found = {"eq": lambda: field == expected, "gt": lambda: field.cast("double") > float(expected), "lt": lambda: field.cast("double") < float(expected), "contains": lambda: F.contains(text, F.lit(str(expected))), "matches": lambda: text.rlike(str(expected))}.get(operator)
    return F.coalesce(found(), F.lit(False)) if found else F.lit(False)


def fired(memories: DataFrame, triggers: dict[str, list[tuple[str, str, object]]]) -> DataFrame:
    """(id, triggers) of each memory: the triggers whose conditions (field, operator,
    value) all hold, comma-joined; a trigger without conditions always fires. A
    condition on a list of tags holds if the list has the value."""

    def one(field: str, operator: str, value) -> Column:
        if operator == "contains" and isinstance(memories.schema[field].dataType.jsonValue(), dict):
            return F.coalesce(F.array_contains(field, value), F.lit(False))
        return holds(F.col(field), operator, value)

    names = [F.when(reduce(lambda a, b: a & b, [one(*c) for c in conditions], F.lit(True)), F.lit(name)) for name, conditions in triggers.items()]
    return memories.select("id", F.array_join(F.array_compact(F.array(*names)), ",").alias("triggers"))


def clones(memories: DataFrame, now: Column, metadata: dict[str, str] | None = None, add: tuple[str, ...] = (), remove: tuple[str, ...] = (), user: int | None = None) -> DataFrame:
    """A copy of each memory (with metadata map and tags array): a new id, the time
    ``now``, metadata overlaid and naming the original, tags added, then removed."""
    over = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv], F.lit("cloned_from"), F.col("id").cast("string"))
    kept = F.map_filter("metadata", lambda k, _: ~k.isin(*(metadata or {}), "cloned_from"))
    tags = F.array_except(F.array_union("tags", F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>"))
    return memories.withColumns({"metadata": F.map_concat(kept, over), "tags": tags, "created_at": now, "user_id": F.col("user_id") if user is None else F.lit(user), "id": F.concat(F.lit("mem_"), F.sha2(F.col("id").cast("string"), 256).substr(1, 32))})


def merged_metadata(memories: DataFrame, over: dict[str, str], gone: tuple[str, ...] = ()) -> DataFrame:
    """Metadata with values set and keys removed."""
    kept = F.map_filter("metadata", lambda k, _: ~k.isin(*over, *gone))
    return memories.withColumn("metadata", F.map_concat(kept, F.create_map(*[F.lit(x) for kv in over.items() for x in kv])))


def spelled(m: str | Column) -> Column:
    """A map as text, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


def payload(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The first {...} block of a text column, parsed by a schema; all null if there is none or it is no JSON."""
    block = F.regexp_extract(F.coalesce(column, F.lit("")), r"(?s)\{.*\}", 0)
    return rows.withColumn("_p", F.from_json(block, schema)).select("*", "_p.*").drop("_p", column)


def anonymised(docs: DataFrame) -> DataFrame:
    """Texts with personal data masked."""
    return docs.select("id", reduce(lambda t, p: F.regexp_replace(t, "(?U)" + p[0], p[1]), PERSONAL, F.col("text")).alias("text"))


def combined(a: str, b: str) -> Column:
    """Two texts as one: the longer if it holds the other, else both as sentences."""
    return F.when(F.contains(b, a), F.col(b)).when(F.contains(a, b), F.col(a)).otherwise(F.concat_ws(". ", a, b))


def combined_texts(memories: DataFrame, *by: str) -> DataFrame:
    """A group's texts as one, each text (but for case and outer blanks) once, in order of time and id."""
    m = memories.withColumn("_k", F.lower(F.trim("text")))
    first = m.groupBy(*by, "_k").agg(F.min(F.struct("us", "id", "text")).alias("f"))
    return first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["text"]), ". ").alias("text"))


def extracted(docs: DataFrame) -> DataFrame:
    """(id, type, text, importance) of memories that the patterns find in lower-cased
    texts: three characters or more, marks at the end cut off. Of one pattern, the same
    text of a document is there as often as it is found."""
    low = F.lower("text")

    def typed(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x).alias("text"))

    found = F.concat(*[F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), typed(k)) for k, p in EXTRACTED])
    rows = docs.where(F.col("text").isNotNull()).select("id", F.explode(found).alias("e")).where(F.length("e.text") >= 3)
    rows = rows.select("id", F.col("e.type").alias("type"), F.regexp_replace("e.text", r"[.,!?]+$", "").alias("text"))
    numbered = rows.withColumn("key", F.struct("id", "type", "text"))
    scored = health.heuristic_importance(numbered.select(F.col("key").alias("id"), "text", "type").distinct())
    return numbered.join(scored.withColumnRenamed("id", "k2"), F.col("key") == F.col("k2")).select("id", "type", "text", "importance")


def session_boundaries(memories: DataFrame, idle_us: int = 1_800_000_000, least: float = 0.3) -> DataFrame:
    """(id, boundary) of each memory of a user in time: ``idle`` after a long pause,
    ``topic`` if it names technologies of which under ``least`` were named before it
    since the last pause, else ``none``."""
    order = Window.partitionBy("user_id").orderBy("us", "id")
    m = memories.select("user_id", "id", "us", F.array_distinct(F.regexp_extract_all("text", F.lit("(?U)" + TECHNOLOGY), F.lit(1))).alias("now"))
    m = m.withColumn("pause", F.coalesce((F.col("us") - F.lag("us").over(order) > idle_us).cast("int"), F.lit(0)))
    m = m.withColumn("run", F.sum("pause").over(order))
    # the technologies are few, so are the names that a run has met
    met = Window.partitionBy("user_id", "run").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("before", F.array_distinct(F.flatten(F.collect_set("now").over(met))))
    share = F.size(F.array_intersect("now", "before")) / F.size("now")
    return m.select("id", F.when(F.col("pause") == 1, "idle").when((F.size("now") > 0) & (F.size("before") > 0) & (share < least), "topic").otherwise("none").alias("boundary"))


def imported(old: DataFrame, new: DataFrame, strategy: str = "merge", user: int | None = None) -> DataFrame:
    """An import (id, user_id, importance, tags array, metadata map) into a store.

    On equal ids ``skip`` keeps the old record, ``replace`` takes the new one, and
    ``merge`` takes the greater importance, the tags of both and the old metadata
    overlaid by the new. ``state`` tells kept, skipped, replaced, merged or added.
    """
    new = new.withColumn("user_id", F.col("user_id") if user is None else F.lit(user))
    cols = ["user_id", "importance", "tags", "metadata"]
    o, n = old.select("id", F.struct(*cols).alias("o")), new.select("id", F.struct(*cols).alias("n"))
    x = o.join(n, "id", "full_outer")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    over = F.map_concat(F.map_filter("o.metadata", lambda k, _: ~F.array_contains(F.map_keys("n.metadata"), k)), "n.metadata")
    merge = F.struct(F.col("o.user_id").alias("user_id"), F.greatest("o.importance", "n.importance").alias("importance"), F.array_union("o.tags", "n.tags").alias("tags"), over.alias("metadata"))
    taken = {"skip": F.col("o"), "replace": F.col("n"), "merge": merge}[strategy]
    state = {"skip": "skipped", "replace": "replaced", "merge": "merged"}[strategy]
    x = x.select("id", F.when(both, taken).otherwise(F.coalesce("o", "n")).alias("r"), F.when(both, state).when(F.col("o").isNotNull(), "kept").otherwise("added").alias("state"))
    return x.select("id", "r.*", "state")


def lineage(parents: DataFrame) -> DataFrame:
    """(node, root, generations) of every descendant in a table of (parent, child): its
    ancestors without parents, and the fewest steps up to each. Each round doubles the steps:
    of those beyond it only ancestors at exactly that many are kept, so a chain has one row a node,
    and rounds follow the logarithm of its length. Walks longer than there are nodes are cycles."""
    edges = cut(parents.where("parent <> child").select("parent", "child").distinct())
    below = edges.select(F.col("child").alias("up")).distinct()
    nodes, steps = below.count(), 1
    front = edges.select(F.col("child").alias("node"), F.col("parent").alias("up")).withColumn("n", F.lit(1))
    inner = below.withColumn("more", F.lit(True))
    front = cut(front.join(inner, "up", "left").select("node", "up", "n", F.coalesce("more", F.lit(False)).alias("more")))
    while steps <= nodes and not front.where("more").isEmpty():
        on = front.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("n").alias("m"), F.col("more").alias("goes"))
        further = front.where("more").select("node", "up", "n").join(on, "up").select("node", F.col("far").alias("up"), (F.col("n") + F.col("m")).alias("n"), F.col("goes").alias("more"))
        front = cut(front.where("NOT more").union(further).groupBy("node", "up", "more").agg(F.min("n").alias("n")).select("node", "up", "n", "more"))
        steps *= 2
    return front.where("NOT more").select("node", F.col("up").alias("root"), F.col("n").alias("generations"))


def accessible(memories: DataFrame, agents: DataFrame, grants: DataFrame, agent: int, now_us: int) -> DataFrame:
    """Memories that an agent may read: without an owner, its own, public ones of its
    user, and shared ones whose owner has granted it a permission that is active and
    not expired.

    Memories: id, user_id, agent_id, visibility. Agents: agent_id, user_id. Grants:
    grantor, grantee, active, expires_us.
    """
    me = agents.where(F.col("agent_id") == agent).select(F.col("user_id").alias("u")).distinct()
    given = grants.where((F.col("grantee") == agent) & F.col("active") & (F.col("expires_us").isNull() | (F.col("expires_us") > now_us))).select("grantor").distinct()
    free = memories.where(F.col("agent_id").isNull() | (F.col("agent_id") == agent))
    other = memories.where(F.col("agent_id").isNotNull() & (F.col("agent_id") != agent))
    public = other.where("visibility = 'public'").join(me, F.col("user_id") == F.col("u"), "left_semi")
    shared = other.where("visibility = 'shared'").join(given, F.col("agent_id") == F.col("grantor"), "left_semi")
    return free.union(public).union(shared).select("id")


def graph_scores(queries: DataFrame, edges: DataFrame, owned: DataFrame) -> DataFrame:
    """(qid, id, score) of the memories within two hops of a query's entities: for each
    entity its confidence times the weights along the way over one more than the
    hops (the best way of the fewest hops), the greatest of all entities, only the
    user's own memories, divided by the query's best.

    Queries: qid, user_id, entity, confidence. Edges: src, dst, weight. Owned: id, user_id.
    """
    one = queries.join(edges, F.col("entity") == F.col("src")).select("qid", "user_id", "entity", F.col("dst").alias("id"), "confidence", "weight", F.lit(1).alias("hops"))
    far = one.select("qid", "user_id", "entity", F.col("id").alias("mid"), "confidence", F.col("weight").alias("w1")).join(edges, F.col("mid") == F.col("src")).select("qid", "user_id", "entity", F.col("dst").alias("id"), "confidence", (F.col("w1") * F.col("weight")).alias("weight"), F.lit(2).alias("hops"))
    none = queries.select("qid", "user_id", "entity", F.col("entity").alias("id"), "confidence", F.lit(1.0).alias("weight"), F.lit(0).alias("hops"))
    near = Window.partitionBy("qid", "entity", "id").orderBy("hops", F.col("weight").desc())
    ways = none.union(one).union(far).withColumn("_r", F.row_number().over(near)).where("_r = 1")
    best = ways.groupBy("qid", "user_id", "id").agg(F.max(F.col("confidence") * F.col("weight") / (1 + F.col("hops"))).alias("s"))
    mine = best.join(owned.select(F.col("id").alias("i2"), F.col("user_id").alias("u2")), (F.col("id") == F.col("i2")) & (F.col("user_id") == F.col("u2")), "left_semi")
    return mine.select("qid", "id", F.round(F.col("s") / F.max("s").over(Window.partitionBy("qid")), 9).alias("score"))


def context_text(memories: DataFrame, k: int = 10) -> DataFrame:
    """A numbered list of each user's ``k`` most important memories, ties by id."""
    order = Window.partitionBy("user_id").orderBy(F.col("importance").desc(), "id")
    top = memories.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    line = F.concat(F.col("_r").cast("string"), F.lit(". ["), F.col("type"), F.lit("] "), F.col("text"))
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def linked(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (src, dst, relation, weight, at) after new ones are added: an edge needs both
    its nodes, and of each ordered pair the last one by ``at`` stays, new before old."""
    n = nodes.select(F.col("id").alias("_n"))
    sound = new.join(n, F.col("src") == F.col("_n"), "left_semi").join(n, F.col("dst") == F.col("_n"), "left_semi")
    every = edges.withColumn("_new", F.lit(0)).unionByName(sound.withColumn("_new", F.lit(1)))
    last = every.groupBy("src", "dst").agg(F.max_by(F.struct("relation", "weight", "at"), F.struct("_new", "at", "relation", "weight")).alias("_r"))
    return last.select("src", "dst", "_r.*")


def lineage_records(merged: DataFrame, refined: DataFrame, inferred: DataFrame, resolved: DataFrame) -> DataFrame:
    """(kind, memory, parents, note) of every derived memory, parents in order.

    Merged: memory, parents. Refined: memory, parent. Inferred: memory, parents, rule,
    confidence. Resolved: memory (the winner), a, b, strategy."""
    ids = lambda c: F.array_join(F.sort_array(c).cast("array<string>"), ",")
    return (
        merged.select(F.lit("merged").alias("kind"), F.col("memory").cast("string").alias("memory"), ids(F.col("parents")).alias("parents"), F.concat(F.lit("Merged "), F.size("parents").cast("string"), F.lit(" memories")).alias("note"))
        .union(refined.select(F.lit("refined"), F.col("memory").cast("string"), F.col("parent").cast("string"), F.lit("Memory refined")))
        .union(inferred.select(F.lit("inferred"), F.col("memory").cast("string"), ids(F.col("parents")), F.concat(F.lit("Inferred by "), F.col("rule"), F.lit(" at "), F.col("confidence").cast("string"))))
        .union(resolved.select(F.lit("resolved"), F.col("memory").cast("string"), ids(F.array("a", "b")), F.concat(F.lit("Conflict resolved by "), F.col("strategy"))))
    )
