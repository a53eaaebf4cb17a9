"""Numbers worked out by hand from the definitions, and brute force in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from memloom.operators import facts, health, keeping
from memloom.operators import understanding as und
from memloom.plans.views import load


def memories(spark, *rows):
    """Memories from dictionaries; what is not given has a plain value."""
    plain = {"id": 1, "user_id": 1, "us": 0, "age": 0.0, "idle": 0.0, "type": "fact", "importance": 5.0, "confidence": 0.5, "access_count": 0, "tag1": "a", "tag2": "b", "n_tags": 0, "n_meta": 0, "has_entities": False, "text": "some text"}
    full = [plain | {"id": i} | r for i, r in enumerate(rows)]
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    frame = spark.createDataFrame([tuple(r[k] for k in plain) for r in full], ", ".join(f"{k} {kinds[type(v)]}" for k, v in plain.items()))
    return frame.withColumns({"days": F.floor("age"), "idle_days": F.floor("idle")})


def test_decay_by_hand(spark):
    # half-life 30: one half-life old, 3 accesses lift .5 to .65, confidence .6 scales by 1.06
    r = health.decay(memories(spark, {"importance": 7.0, "confidence": 0.6, "access_count": 3, "age": 30.0, "idle": 15.0})).first()
    assert r.exponential == pytest.approx(7 * 0.65 * 1.06)
    assert r.linear == pytest.approx(7 * 0.65 * 1.06)
    assert r.logarithmic == pytest.approx(7 * (1 - math.log(31) / math.log(61) + 0.15) * 1.06)
    assert r.step == pytest.approx(7 * 0.9 * 1.06)
    assert r.hybrid == pytest.approx(7 * (0.5 + math.exp(-1) * 0.3 * 0.3 + 0.15) * 1.06)
    # the factor is one at most, the floor is one, without accesses nothing is lifted
    top, floor = health.decay(memories(spark, {"importance": 8.0, "access_count": 20}, {"importance": 2.0, "age": 400.0, "type": "event"})).orderBy("id").collect()
    assert top.exponential == pytest.approx(8.0) and floor.exponential == 1.0 and floor.step == 1.0


def test_decay_statistics_by_hand(spark):
    got = health.decay_statistics(memories(spark, {"importance": 8.0, "age": 30.0}, {"importance": 4.0})).first()
    assert (got.n, got.updated, got.total_decay, got.avg_decay, got.significant) == (2, 1, 4.0, 2.0, 1)


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [("ok", "fact", 2.0), ("my goal is to run", "goal", 8.0), ("i like tea", "fact", 6.0), ("maybe later", "context", 5.0), ("Never again!", "fact", 8.0), ("a" * 101, "event", 5.5), ("unlikely", "fact", 5.0)],
)
def test_importance_by_hand(spark, text, kind, want):
    assert health.heuristic_importance(memories(spark, {"text": text, "type": kind})).first().importance == want


def test_stale_by_hand(spark):
    rows = [{"age": 181.0, "importance": 2.0, "text": "in 1999"}, {"age": 91.0, "access_count": 1}, {"age": 10.0, "text": "what is new"}, {"age": 100.0}]
    got = {r.id: r.confidence for r in health.stale(memories(spark, *rows)).collect()}
    assert got == {0: 1.0, 2: 0.2, 3: 0.3}


def test_quality_by_hand(spark):
    text = "A sentence. Another one! And a third? " + "x" * 70
    r = health.quality(memories(spark, {"text": text, "n_tags": 3, "n_meta": 1, "idle": 30.0, "confidence": 0.8, "importance": 6.0}, {"text": "hi hi hi", "idle": 91.0, "importance": 1.0, "confidence": 0.4})).orderBy("id").collect()
    assert r[0].quality == pytest.approx(0.25 * 90 + 0.2 * 100 + 0.2 * 50 + 0.2 * 80 + 0.15 * 60) and r[0].issues == ""
    assert r[1].quality == pytest.approx(0.25 * 20 + 0.2 * 30 + 0.2 * 100 * 0.5 ** (91 / 30) + 0.2 * 40 + 0.15 * 10)
    assert r[1].issues == "stale,low_confidence,low_importance,incomplete,orphaned"


def test_temperature_by_hand(spark):
    rows = [{"age": 5.0, "access_count": 11, "importance": 1.0, "idle": 5.0}, {"age": 400.0, "access_count": 1, "idle": 400.0}, {"age": 100.0, "access_count": 50, "idle": 30.0, "importance": 10.0}, {"age": 20.0, "access_count": 20, "importance": 10.0}]
    got = {r.id: (r.temperature, r.tier) for r in health.temperature(memories(spark, *rows)).collect()}
    assert got[0] == (pytest.approx(40 + 30 * 0.5 ** (1 / 6) + 3), "hot") and got[1][1] == "hibernated"
    assert got[2] == (pytest.approx(0.4 * 50 + 15 + 30), "warm") and got[3] == (pytest.approx(100.0), "hot")


def test_store_health_by_hand(spark):
    got = health.store_health(memories(spark, {"age": 10.0, "n_tags": 1, "text": "same"}, {"age": 10.0, "type": "goal", "text": "Same "})).first()
    assert got.quality == pytest.approx(20 + 20 + 10)
    assert got.diversity == pytest.approx(0.7 * 100 / math.log2(9) + 0.3 * 0.05)
    assert got.freshness == pytest.approx(40 + 0.4 * (100 - 10 / 3.65)) and got.coverage == pytest.approx(0.4 * 10 + 0.4 * 200 / 9)
    assert got.duplication == 50 and got.staleness == 100


def test_storage_tiers_by_hand(spark):
    rows = [{"idle": 95.0}, {"idle": 95.0, "importance": 10.0, "access_count": 100}, {"idle": 40.0, "importance": 5.0}]
    got = health.migrate_tiers(memories(spark, *rows)).first()
    assert (got.to_warm, got.promoted, got.kept) == (0, 3, 0)
    kept = health.tier_texts(memories(spark, {"text": "One. Two. Three."}, {"text": "y" * 600})).orderBy("id").collect()
    assert kept[0].cold == "One. Two." and kept[1].warm == "y" * 500 + "..." and kept[1].cold == "y" * 200 and kept[0].frozen == "[fact] One. Two. Three...."


def test_entities_against_plain_python(spark, sf):
    def name(kind, text):
        c = " ".join(text.split())
        if kind == "person":
            c = re.sub(r"^(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+", "", c, flags=re.IGNORECASE).title()
        if kind == "organization":
            c = c.replace("Inc.", "Inc").replace("Corp.", "Corp").replace("Ltd.", "Ltd")
        if kind == "location":
            c = c.replace("NYC", "New York City").replace("SF", "San Francisco").replace("LA", "Los Angeles")
        c = c.lower() if kind == "email" else c.rstrip("/").replace("http://", "https://") if kind == "url" else re.sub(r"[^\d+]", "", c) if kind == "phone" else c
        return c.strip()

    docs = load(spark, sf, "doc")[0].select("id", "text").union(load(spark, sf, "note")[0].select(F.col("id") + 10**6, "text"))
    want = {(r.id, t, name(t, m.group(1))) for r in docs.collect() for t, p in und.ENTITIES for m in re.finditer(p, r.text) if len(m.group(1).strip()) >= 2}
    assert want and {tuple(r) for r in und.entities(docs).collect()} == want
    assert und.entities(spark.createDataFrame([(1, None), (2, "")], "id long, text string")).count() == 0


def test_names_of_turns_against_plain_python(spark, sf):
    common = {"I", "The", "A", "An", "This", "That", "These", "Those"}
    turns = load(spark, sf, "turns")[0]
    want = {(r.conv_id, r.turn): ",".join(sorted(set(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", r.text)) - common)) for r in turns.collect()}
    assert {(r.conv_id, r.turn): r.names for r in und.turn_kind(turns).collect()} == want


def test_conflict_cases(spark):
    texts = ["I love my old coffee cup", "I hate my old coffee cup", "I love my old coffee cup", "the train left", "I am 30 years old", "I am 31 years old"]
    year = 366 * 86_400_000_000
    rows = [{"text": t, "us": year if i == 5 else i, "type": "goal" if i == 2 else "fact", "confidence": 0.5 + i / 10} for i, t in enumerate(texts)]
    m = memories(spark, *rows)
    got = {(r.a, r.b): r.kind for r in und.conflicts(m).collect()}
    assert got == {(0, 1): "direct_contradiction", (4, 5): "temporal_inconsistency"}
    assert {(r.a, r.by_time, r.by_confidence) for r in und.resolve(und.conflicts(m)).collect()} == {(0, 1, 1), (4, 5, 5)}
    held = und.beliefs(m, und.conflicts(m))
    assert {r.id: (r.confidence, r.state) for r in held.collect()}[0] == (0.25, "contradicted")
    support = spark.createDataFrame([(0, 3), (0, 2), (1, 3)], "source long, target long")
    assert {(r.id, r.confidence, r.state) for r in und.propagate(held, support).collect()} == {(3, 0.6, "active"), (2, 0.525, "active")}


def test_inference_rules(spark):
    edges = [(1, 2, "works_at"), (2, 3, "located_in"), (4, 1, "manages"), (5, 1, "knows"), (2, 6, "founded_by"), (7, 8, "part_of"), (8, 9, "part_of"), (10, 3, "located_in"), (11, 10, "studied_at")]
    got = {tuple(r) for r in und.infer(spark.createDataFrame(edges, "src int, dst int, relation string")).collect()}
    assert got == {(1, 3, "works_at_location_inference", 0.7), (11, 3, "studied_at_location_inference", 0.7), (4, 2, "manages_works_at_inference", 0.7), (5, 2, "knows_organization_inference", 0.5), (6, 2, "founded_by_inverse", 0.8), (7, 9, "part_of_transitive", 0.65), (2, 10, "co_location_inference", 0.4)}


def test_routes_and_windows(spark):
    rows = [(1, "what habits do I have", 1, 100), (2, "where do I live", 1, 100), (3, "favorite place I lived in", 1, 100), (4, "zzz", 1, 100)]
    q = spark.createDataFrame(rows, "id long, text string, user_id long, days long")
    assert {r.id: r.route for r in und.route(q).collect()} == {1: "prefs", 2: "facts", 3: "facts", 4: "both"}
    asked = spark.createDataFrame([(1, "latest news I like", 1, 1), (2, "this year", 1, 1), (3, "forever", 1, 1), (4, "plain", 1, 1)], "id long, text string, user_id long, days long")
    assert und.intent_weights(asked).where("id = 1").first()[3:] == (0.3, pytest.approx(0.15))
    assert {r.id: r.window_days for r in und.time_window(asked).collect()} == {1: 90, 2: 365, 3: 3650, 4: 90}


def test_intents_fire_recur_and_expire(spark):
    day, now = 86_400_000_000, 10**15
    rows = [
        (1, 1, "event", ["coffee"], None, None, None, None, None, None),
        (2, 1, "event", None, "T.a", None, None, day, 2, None),
        (3, 1, "time", ["coffee"], None, now - 1, now + 1, day, 1, None),
        (4, 1, "time", None, None, now - 1, now - 1, None, None, now - 1),
        (5, 2, "event", ["coffee"], None, None, None, None, None, now + day),
        (6, 1, "hybrid", ["zz"], None, now, None, day, None, now + day),
    ]
    intents = spark.createDataFrame(rows, "id long, user_id long, trigger string, keywords array<string>, pattern string, due_us long, until_us long, every_us long, remaining long, expires_us long")
    said = spark.createDataFrame([(1, "Coffee, or TEA?")], "user_id long, text string")
    got = {r.id: (r.fired, r.status, r.remaining) for r in und.fired_intents(intents, said, now).collect()}
    assert got == {1: (True, "triggered", None), 2: (True, "pending", 1), 3: (True, "triggered", 0), 4: (False, "expired", None), 5: (False, "pending", None), 6: (True, "triggered", None)}


def test_permissions_walk_from_the_root(spark):
    spaces = spark.createDataFrame([("a", 1, False, True), ("a/b", 2, True, True), ("a/b/c", 3, False, True), ("a/b/d", 3, False, False)], "path string, owner_id long, is_public boolean, inherits boolean")
    grants = spark.createDataFrame([("a", 7, "write"), ("a/b", 7, "admin"), ("a/b/c", 8, "admin")], "path string, user_id long, permission string")
    asked = spark.createDataFrame([(p, u) for p in ("a/b/c", "a/b/d", "a/b/x") for u in (1, 3, 7, 8, 9)], "path string, user_id long")
    got = {(r.path, r.user_id): r.permission for r in und.effective_permission(spaces, grants, asked).collect()}
    assert [got["a/b/c", u] for u in (1, 3, 7, 8, 9)] == ["owner", "owner", "write", "admin", "read"]
    assert [got["a/b/d", u] for u in (1, 3, 7, 8, 9)] == ["none", "owner", "none", "none", "none"]
    assert all(got["a/b/x", u] == "none" for u in (1, 3, 7, 8, 9))


def test_conditions_of_triggers(spark):
    rows = spark.createDataFrame([(1, 9.0, "coffee", ["a"]), (2, None, None, None)], "id long, importance double, text string, tags array<string>")
    triggers = {"none": [], "gt": [("importance", "gt", 8)], "lt": [("importance", "lt", 8)], "eq": [("text", "eq", "coffee")], "part": [("text", "contains", "off")], "tag": [("tags", "contains", "a")], "re": [("text", "matches", "^c.*e$")], "odd": [("text", "near", 1)], "two": [("importance", "gt", 1), ("text", "eq", "tea")]}
    got = {r.id: r.triggers for r in keeping.fired(rows, triggers).collect()}
    assert got == {1: "none,gt,eq,part,tag,re", 2: "none"}


def test_personal_data_is_masked_in_order(spark):
    rows = spark.createDataFrame([(1, "bob.o@ex-1.example.org or 555-123-4567, 5551234567 and 123-45-6789"), (2, None), (3, "é@x.fr")], "id long, text string")
    assert {r.id: r.text for r in keeping.anonymised(rows).collect()} == {1: "[EMAIL] or [PHONE], [PHONE] and [SSN]", 2: None, 3: "[EMAIL]"}


def test_memories_in_conversations(spark):
    rows = spark.createDataFrame([(1, "I love jazz!"), (2, "My name is Bo.\nI want to sleep"), (3, None), (4, "need it")], "id long, text string")
    got = {(r.id, r.type, r.text) for r in keeping.extracted(rows).collect()}
    assert got == {(1, "preference", "jazz"), (2, "fact", "bo"), (2, "preference", "to sleep"), (2, "goal", "sleep"), (2, "context", "to sleep")}


def test_session_boundaries(spark):
    minute = 60_000_000
    rows = [(1, 0, "Python and Docker"), (2, minute, "Docker again"), (3, 2 * minute, "now React, Vue, Go, Rust"), (4, 3 * minute, "plain"), (5, 90 * minute, "back"), (6, 91 * minute, "React")]
    m = spark.createDataFrame([(1, i, t, x) for i, t, x in rows], "user_id long, id long, us long, text string")
    assert {r.id: r.boundary for r in keeping.session_boundaries(m).collect()} == {1: "none", 2: "none", 3: "topic", 4: "none", 5: "idle", 6: "none"}


def test_imports_by_strategy(spark):
    kind = "id long, user_id long, importance double, tags array<string>, metadata map<string,string>"
    old = spark.createDataFrame([(1, 1, 5.0, ["a"], {"x": "1", "y": "2"}), (2, 1, 9.0, ["a"], {})], kind)
    new = spark.createDataFrame([(1, 7, 4.0, ["b", "a"], {"x": "3"}), (3, 7, 1.0, [], {})], kind)
    got = {s: {r.id: (r.user_id, r.importance, r.tags, r.metadata, r.state) for r in keeping.imported(old, new, s, user=4).collect()} for s in ("skip", "replace", "merge")}
    assert got["merge"] == {1: (1, 5.0, ["a", "b"], {"x": "3", "y": "2"}, "merged"), 2: (1, 9.0, ["a"], {}, "kept"), 3: (4, 1.0, [], {}, "added")}
    assert got["skip"][1] == (1, 5.0, ["a"], {"x": "1", "y": "2"}, "skipped") and got["replace"][1] == (4, 4.0, ["b", "a"], {"x": "3"}, "replaced")


def test_lineage_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (9, 3), (4, 5), (5, 4), (4, 6)], "parent long, child long")
    assert {tuple(r) for r in keeping.lineage(edges).collect()} == {(2, 1, 1), (3, 1, 1), (3, 9, 1)}


def test_graph_scores_by_hand(spark):
    q = spark.createDataFrame([(1, 5, 10, 0.8), (1, 5, 11, 0.4)], "qid long, user_id long, entity long, confidence double")
    e = spark.createDataFrame([(10, 20, 0.5), (20, 30, 0.5), (10, 30, 0.1), (11, 20, 1.0), (30, 40, 1.0)], "src long, dst long, weight double")
    owned = spark.createDataFrame([(20, 5), (30, 5), (40, 5), (10, 6)], "id long, user_id long")
    # 20: max(.8 * .5, .4) / 2; 30: one hop of weight .1 is fewer than two of .25, from 11 there are two of .5
    got = {r.id: r.score for r in keeping.graph_scores(q, e, owned).collect()}
    assert got == pytest.approx({20: 1.0, 30: max(0.8 * 0.1 / 2, 0.4 * 0.5 / 3) / 0.2, 40: 0.8 * 0.1 / 3 / 0.2})


def test_facts_and_their_quality(spark):
    text = "John works at Acme since 2019. He likes green tea. He LIKES green tea." + " x" * 60 + " lived in Paris"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "id long, text string")
    got = {(r.category, r.fact): r for r in facts.extract(docs).collect()}
    assert {k: (r.entity, r.temporal, r.temporal_type) for k, r in got.items()} == {
        ("employment", "works at Acme since"): ("Acme since", "2019", "start_date"),
        ("location", "lives in Paris"): ("Paris", "", "present"),
        ("preference", "likes green tea"): ("green tea", "2019", "start_date"),
    }
    assert text[got["location", "lives in Paris"].start :].startswith("lived in Paris")
    r = facts.with_quality(facts.extract(docs)).where("category = 'employment'").first()
    quality = 0.2 * (4 / 20 + 0.2) + 0.25 * 1.0 + 0.25 * 1.0 + 0.15 + 0.15 * 0.9 * 0.85
    assert r.quality == pytest.approx(quality) and r.confidence == 1.0
    two = spark.createDataFrame([(1, "a", "E"), (1, "b", "E"), (1, "c", "F"), (2, "a", "E")], "id long, fact string, entity string")
    assert {(r.id, r.fact): r.related for r in facts.related(two).collect()} == {(1, "a"): "b", (1, "b"): "a", (1, "c"): "", (2, "a"): ""}


def test_turns_of_transcripts(spark):
    rows = spark.createDataFrame([(1, "User: hi\n\n there\nAssistant:  yes\nSystem:\nok"), (2, "no marks\nat all"), (3, None)], "id long, text string")
    assert sorted((r.id, r.text) for r in facts.turns_of(rows).collect()) == [(1, "hi there"), (1, "ok"), (1, "yes"), (2, "no marks at all")]


def test_permissions_of_groups_equal_those_of_each_request(spark):
    spaces = spark.createDataFrame([("a", 1, False, True), ("a/b", 2, True, True), ("a/b/c", 3, False, True), ("a/b/d", 3, False, False), ("e", 9, True, True)], "path string, owner_id long, is_public boolean, inherits boolean")
    grants = spark.createDataFrame([("a", 7, "write"), ("a/b", 7, "admin"), ("a/b/c", 8, "admin"), ("a/b/c", 8, "read"), ("e/f", 7, "write")], "path string, user_id long, permission string")
    places = spark.createDataFrame([(1, p) for p in ("a/b/c", "a/b/d", "a/b/x", "a/b/c")] + [(2, "e/f"), (2, "e"), (None, "a")], "grp int, path string")
    members = spark.createDataFrame([(g, u) for g in (1, 2, 2) for u in (1, 3, 7, 8, 9)], "grp int, user_id long")
    asked = places.join(members, "grp").select("path", "user_id")
    want = {tuple(r) for r in und.effective_permission(spaces, grants, asked).collect()}
    for rows in (1, 10**6):
        got = und.effective_permission_of_groups(spaces, grants, places, members, rows)
        found = [tuple(r) for r in got.collect()]
        assert set(found) == want and len(found) == len(want)


def test_lineage_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = keeping.cut
    monkeypatch.setattr(keeping, "cut", lambda df: rounds.append(1) or cut(df))
    # a chain of 40, and a diamond whose ways up differ in length
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 103), (100, 103), (200, 103)], "parent long, child long")
    got = {tuple(r) for r in keeping.lineage(edges).collect()}
    assert got == {(i, 0, i) for i in range(1, 41)} | {(101, 100, 1), (102, 100, 2), (103, 100, 1), (103, 200, 1)}
    assert len(rounds) < 12


def test_inference_pairs_all_entities_of_a_place_once(spark):
    # 700 entities at a place, of which two share others, and one that is at two places
    edges = [(i, 1, "located_in") for i in range(700)] + [(i, p, "located_in") for i in (5, 9) for p in (2, 3)] + [(699, 4, "located_in"), (800, 4, "located_in"), (1, 1, "located_in"), (None, 1, "located_in")]
    found = [tuple(r) for r in und.infer(spark.createDataFrame(edges, "src int, dst int, relation string")).collect()]
    want = {(a, b) for a in range(700) for b in range(a + 1, 700)} | {(699, 800)}
    assert {(a, b) for a, b, rule, _ in found if rule == "co_location_inference"} == want
    assert len(found) == len(set(found)) == len(want)
    few = und.infer(spark.createDataFrame(edges, "src int, dst int, relation string"), together=3)
    assert {(r.src, r.dst) for r in few.where("dst < 700").collect()} <= {(0, 1), (0, 2), (1, 2), (5, 9)}


def test_lineage_is_of_all_entities_of_a_place(spark, tmp_path):
    from memloom.plans import registry

    spark.read.parquet("/root/testdata/sf0.1/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    for table in ("events", "nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    edges = {(r.src, r.dst) for r in load(spark, str(tmp_path), "relation")[0].where("relation = 'located_in'").collect()}
    places = {}
    for src, dst in edges:
        places.setdefault(dst, set()).add(src)
    assert max(map(len, places.values())) > 50
    want = {f"{a}>{b}" for x in places.values() for a in x for b in x if a < b}
    got = registry.queries()["prv1"](spark, str(tmp_path)).where("note LIKE 'Inferred by co_location%'").select("memory").collect()
    assert {r.memory for r in got} == want and len(got) == len(want)
    assert "<= 50" not in registry.oracle_sql()["prv1"] and "<= 50" in registry.oracle_sql()["gra9"]


def test_permissions_of_a_large_group_are_dealt_to_many_tasks(spark, monkeypatch):
    spaces = spark.range(1, 301).selectExpr("concat('a/', id) AS path", "id AS owner_id", "id % 4 = 0 AS is_public", "CASE WHEN id % 5 > 0 THEN id % 3 > 0 END AS inherits").union(spark.sql("SELECT 'a', 7L, false, true"))
    grants = spark.range(1, 300).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE concat('a/', id) END AS path", "id AS user_id", "CASE WHEN id % 3 > 0 THEN 'write' ELSE 'admin' END AS permission")
    places, members = spark.range(1, 310).selectExpr("1 AS grp", "concat('a/', id) AS path"), spark.range(1, 401).selectExpr("1 AS grp", "id AS user_id")
    want = {tuple(r) for r in und.effective_permission(spaces, grants, places.join(members, "grp").select("path", "user_id")).collect()}
    for products in (512, 5):
        monkeypatch.setattr(und, "PRODUCTS", products)
        got = und.effective_permission_of_groups(spaces, grants, places, members, 1000)
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 309 * 400 and sum(map(bool, sizes)) >= (50 if products == 512 else 3)
        assert {tuple(r) for r in got.collect()} == want
