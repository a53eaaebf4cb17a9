"""Likeness of a user's texts: what one holds of another, users in parts, against brute force."""

import re

from memloom.operators import understanding as und

WORDS = "cat concatenate love like enjoy hate work job want always often the a tea green Ünïcode k1 k2 x".split()


def by_hand(rows, least):
    cls, stop, groups = {}, set(und.STOP_WORDS), [set(g.split()) for g in und.SYNONYMS]
    for i, u, t in rows:
        if u is not None and t is not None:
            cls.setdefault((u, t), []).append(i)
    found = {}
    for (ua, ta), ia in cls.items():
        for (ub, tb), ib in cls.items():
            x, y = (set(re.findall(r"\w+", t.lower())) - stop for t in (ta, tb))
            if ua == ub and min(ia) < min(ib) and x and y:
                s = min(1.0, len(x & y) / len(x | y) + 0.2 * sum(bool(x & g) and bool(y & g) for g in groups))
                s = max(s, 0.8) if ta.lower() in tb.lower() or tb.lower() in ta.lower() else s
                if round(s, 9) >= least:
                    found[ua, min(ia), min(ib)] = (len(ia), len(ib), round(s, 9))
    return found


def texts(n):
    made = [" ".join(WORDS[(i * k + i // 7) % len(WORDS)] for k in range(1, 2 + i % 5)) for i in range(n)]
    return [(i, i % 2 if i % 31 else None, t) for i, t in enumerate(made)] + [(9001, 5, "cat"), (9002, 5, "concatenate"), (9003, 5, "the"), (9004, 6, None), (9005, 6, "")]


def test_a_text_within_a_word_of_another_and_users_in_parts(spark, monkeypatch):
    rows = texts(300)
    frame = spark.createDataFrame(rows, "id long, user_id long, text string")
    want = by_hand(rows, 0.5)
    assert want[5, 9001, 9002] == (1, 1, 0.8)
    for part in (und.PART, 20):
        monkeypatch.setattr(und, "PART", part)
        got = [((r.user_id, r.a, r.b), (r.n_a, r.n_b, r.s)) for r in und.lexical_likeness(frame, 0.5).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_pairs_are_not_shuffled(spark):
    plan = und.lexical_likeness(spark.createDataFrame(texts(40), "id long, user_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    # only classes and the few users with many travel: no join of keys, no pairs made distinct
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 1
