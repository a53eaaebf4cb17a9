"""Prefix tries, license notices and collocations against brute force, and their edge cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from memloom.llm import collocations, license_scan, prefix_trie
from memloom.llm.sql import ORACLE


def trie_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("block", [4096, 3])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "né", "", None])) for c in range(60) for t in [None, *range(rng.randint(0, 14))]]
    rows += [(7, t, "user", "again") for t in range(40)] + [(8, 1, "user", "b")] * 3 + [(None, 1, "user", "x"), (4001, 0, "user", "far")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, d int")
    assert plain(prefix_trie.trie(frame)) == trie_by_hand(rows)


def test_trie_of_one_long_conversation_and_of_nothing(spark):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(5, t, "user", "same") for t in range(700)]
    assert plain(prefix_trie.trie(spark.createDataFrame(rows, kinds).repartition(5))) == trie_by_hand(rows)
    # conversations whose every turn is replaced by nothing end in the root
    rows = [(c, 0, "user", "x") for c in range(1, 3000) if c % 5]
    assert plain(prefix_trie.trie(spark.createDataFrame(rows, kinds))) == trie_by_hand(rows)
    assert prefix_trie.trie(spark.createDataFrame([], kinds)).count() == 0


def test_collocations_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH_BYTES", 2000)
    rng = random.Random(3)
    word = lambda: rng.choice(["new", "york", "City", "the", "of", "É", "é", "end less"])
    texts = [" ".join(word() + rng.choice(["", "", "", ".", "\n", "\t", ", ", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, rng.choice(["en", "fr", None, "und"])) for i, t in enumerate(texts)] + [(1, None, "en"), (None, "", None), (2, "...", "xx")] + [(3, "twin peaks here", "en")] * 12
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n long, piece string")
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang"])
    documents["lang"], documents["text"] = documents["lang"].astype(object), documents["text"].astype(object)
    db = duckdb.connect()
    db.register("documents", documents)
    twin = db.execute(ORACLE["op13_collocations"]).df()
    mine = collocations.mine(frame).toPandas()[twin.columns]
    assert len(mine) > 50 and set(mine.lang) == {"en", "fr", "und"}
    assert sorted(mine.itertuples(index=False, name=None)) == sorted(twin.itertuples(index=False, name=None))
    few = collocations.mine(frame, top=3)
    assert few.where("rank > 3").count() == 0 and few.count() == 9
    assert collocations.mine(frame.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def notices_by_hand(words):
    """Notices of which some run of words is within the allowed edits."""
    found = set()
    for i, (_, head, body, edits) in enumerate(license_scan.NOTICES):
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                run = " ".join(words[a:b])
                if len(run) > len(head) + len(body) + edits:
                    break
                if run.startswith(head) and abs(len(run) - len(head) - len(body)) <= edits and distance(run[len(head) :], body) <= edits:
                    found.add(i)
    return found


def test_notices_equal_brute_force():
    scanner, rng = license_scan.Scanner(), random.Random(1)
    hits = 0
    for trial in range(160):
        label, head, body, edits = license_scan.NOTICES[trial % len(license_scan.NOTICES)]
        spoiled = list(head + body)
        for _ in range(rng.randint(0, edits + 1)):
            at = rng.randrange(len(spoiled))
            spoiled[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "é", " "])
        norm, _ = license_scan.normal(f"Some words, {''.join(spoiled)}. {rng.choice(['Permit license!', 'limit license', 'apaches', ''])}")
        words = norm.split(" ")
        mine = scanner.fuzzy(norm)
        want = {license_scan.NOTICES[i][0] for i in notices_by_hand(words)}
        assert {s[0] for s in mine} == want, norm
        for _, first, last, made, allowed in mine:
            run = " ".join(words[first : last + 1])
            assert made <= allowed and any(run.startswith(h) and distance(run[len(h) :], b) <= made for _, h, b, _ in license_scan.NOTICES)
        hits += bool(want)
    assert hits > 80


def base_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_query_equals_brute_force_and_edge_cases(spark):
    rng = random.Random(2)
    bits = "cc by CC-BY mit license License apache gnu general public é GNU\u00a0x , . \n cc by".split(" ")
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    rows += [(1, None), (2, ""), (None, "MIT License"), (3, "mit licence"), (3, "mit licence"), (4, "it license; limit license"), (5, "x" * 300_000 + " the GNU Generl Public Licence " + "y " * 200_000)]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, spans string")
    got = license_scan.digest(license_scan.scan(frame))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.collect()), key=key) == sorted(((d, *base_by_hand(t)) for d, t in rows), key=key)
    by_id = {r.doc_id: r for r in got.where("doc_id in (3, 4, 5) and n_base = 0").collect()}
    assert by_id[3].labels == "mit" and by_id[3].score == 0.5 and by_id[3].spans == "mit:0:1:1"
    assert by_id[4].labels == "" and by_id[4].score == 0
    assert by_id[5].labels == "gpl" and by_id[5].spans == "gpl:2:5:2"
    assert license_scan.scan(frame.limit(0)).count() == 0
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got.where("n_base > 0").collect())


def test_jaccard_candidates_must_fit_around_a_shared_shingle(spark):
    """A 5-gram at the start of one prefix and at the end of the other leaves too little for a link."""
    import numpy as np

    from memloom.llm import jaccard_join

    def row(c, at):
        grams = np.arange(26) + 1000 * c
        grams[at] = 7
        return c, 100, 1, grams.astype(np.int64).tobytes(), np.packbits(np.zeros(26, bool)).tobytes()

    none = spark.createDataFrame([], "node long, label long")
    for places, pairs in (((0, 25), 0), ((0, 14), 1), ((25, 25), 1), ((3, 20), 0)):
        prefixes = spark.createDataFrame([row(c, at) for c, at in enumerate(places, 1)], "c long, n long, l int, grams binary, hot binary")
        assert jaccard_join._postings(prefixes, none)[0].count() == pairs


def test_jaccard_candidates_share_early_shingles(spark):
    """Of two sets of 100, 86 are shared by a link: five of the first 19 places are, those from place 19 on do not count."""
    import numpy as np

    from memloom.llm import jaccard_join

    def row(c, shared):
        grams = np.arange(30) + 1000 * c
        grams[shared] = shared
        return c, 100, 5, grams.astype(np.int64).tobytes(), np.packbits(np.zeros(30, bool)).tobytes()

    none = spark.createDataFrame([], "node long, label long")
    for shared, pairs in ((range(19, 30), 0), (range(14, 19), 1), (range(15, 30), 0)):
        prefixes = spark.createDataFrame([row(c, list(shared)) for c in (1, 2)], "c long, n long, l int, grams binary, hot binary")
        assert jaccard_join._postings(prefixes, none)[0].count() == pairs


def test_jaccard_early_shingles_lose_no_pair():
    import numpy as np

    from memloom.llm import jaccard_join

    rng = np.random.default_rng(4)
    order = jaccard_join.Order(rng.integers(0, 40, jaccard_join.sketch_size(0)))
    met = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64))
        kept = a[rng.random(len(a)) < rng.choice([0.8, 0.9])]
        b = np.unique(np.append(kept, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)))
        both = len(kept)
        if not both or 100 * both < 75 * (len(a) + len(b) - both):
            continue
        met += 1
        (ga, ma, _), (gb, mb, _) = order.prefix(a), order.prefix(b)
        m, least = min(ma, mb), -(-75 * (len(a) + len(b)) // 175)
        assert len(np.intersect1d(ga[: len(a) - least + m], gb[: len(b) - least + m])) >= m
    assert met > 100


def test_masked_lm_encodes_texts_once(spark, monkeypatch):
    """Encoded texts lie as words do, and the query's scores are those of training and scoring from texts."""
    import numpy as np

    from memloom.llm import masked_lm

    texts = ["alpha beta unseen", "", "beta", None]
    ids_of = masked_lm.Ids([b"alpha", b"beta"])
    raw = [np.array([ids_of[w] for w in masked_lm.words_of(t or "")], "<u2").tobytes() for t in texts]
    for got, want in zip(masked_lm.laid_out(raw), ids_of.texts([t or "" for t in texts]), strict=True):
        assert got.tolist() == want.tolist()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 9)], "doc_id long, text string").coalesce(1)
    cuts = []
    real = masked_lm.encoded
    monkeypatch.setattr(masked_lm, "encoded", lambda *a: cuts.append(1) or real(*a))
    once = {r.doc_id: (r.n_tokens, round(r.score, 4)) for r in masked_lm.train_and_score(docs).collect()}
    assert len(cuts) == 1
    assert once == {r.doc_id: (r.n_tokens, round(r.score, 4)) for r in masked_lm.score(docs, masked_lm.train(docs)).collect()}


def test_masked_lm_counts_byte_pairs_of_words():
    import numpy as np

    from memloom.llm import masked_lm

    words, n = [b"a", b"ab", "né".encode(), b"bab"], [3, 5, 1, 10**9]
    want = np.zeros(257 * 257 + masked_lm.ENDINGS, np.int64)
    for w, k in zip(words, n, strict=True):
        want[257 * 257 + masked_lm.ending(w)] += k
        for a, b in zip([256, *reversed(w)], [*reversed(w), 256], strict=True):
            want[a * 257 + b] += k
    assert masked_lm.spelling(words, np.array(n)).tolist() == want.tolist()
