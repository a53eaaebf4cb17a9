"""Brute-force twins, exact round trips, held-out accuracy, and the edge cases
that every operator defines: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from memloom.llm import byte_bpe, chat_format, decontaminate, jaccard_join, language_id, masked_lm, queries, secret_scan, token_files, toxicity, vector_topk
from memloom.llm.common import HashIndex, stage_path
from memloom.llm.components import connected

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, score double, ids string, n long, k string, set string"
EMPTY = ["", None, " ", "\n"]


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, 1.0, "x", 7, "y", "z") for d, t in rows], DOCS)


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randint(0, 40)) for _ in range(n))


def test_hash_index_is_exact():
    rng = np.random.default_rng(0)
    keys = rng.choice(1 << 40, 5000, replace=False).astype(np.uint64)
    index = HashIndex(keys, np.arange(5000))
    assert (index.get(keys) == np.arange(5000)).all()
    assert (index.get(keys + np.uint64(1 << 50)) == -1).all()


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 ---------------------------------------------------------------------------


def test_toxicity_learns_and_keeps_edge_cases(spark):
    rows = [(i, prose(i) + (" you worthless moron" if i % 3 == 0 else "")) for i in range(240)]
    labels = [(i, int(i % 3 == 0)) for i in range(160)] + [(None, 1), (5, None), (9999, 1)]
    extra = [(900 + i, t) for i, t in enumerate(EMPTY)] + [(0, rows[0][1]), (None, "moron")]
    docs = frame(spark, rows + extra)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.score, r.predicted))
        assert 0 <= r.score <= 1
    assert all(by[i][0][1] == int(i % 3 == 0) for i in range(160, 240))
    assert len(by[0]) == 2 and by[0][0] == by[0][1]
    assert by[900] == by[901]


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, [(1, "a")]), none)
    assert toxicity.score(frame(spark, [(1, "a")]), model).first().predicted == 0
    assert toxicity.score(frame(spark, []), model).count() == 0


# 2 ---------------------------------------------------------------------------


def tiktoken_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library():
    rng, own, library = random.Random(3), byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), tiktoken_encoding()
    pool = [chr(c) for c in [*range(256), 0x300, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x660]]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice("abest  '\n") for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["", "abcab" * 400, "a" * 3000, "<|endoftext|>"]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode("utf-8", "surrogatepass")


def test_byte_bpe_frame(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 20000)]
    got = byte_bpe.encode_documents(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    library = tiktoken_encoding()
    assert len(got) == 6 and all(r.round_trip for r in got)
    for r, (_, text) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), [rows[i] for i in (0, 1, 2, 3, 5, 4)], strict=True):
        want = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        assert bytes(r.ids) == want and r.ids_sha256 == hashlib.sha256(want).hexdigest()
    assert byte_bpe.encode_documents(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# 3 ---------------------------------------------------------------------------


def test_masked_lm_scores_every_token(spark):
    rows = [(i, prose(i, 60)) for i in range(60)] + [(100, None), (101, ""), (102, "zzz qqq"), (None, "alpha")]
    docs = frame(spark, rows)
    words, parameters = masked_lm.train(docs, stride=2)
    net, ids_of = masked_lm.WindowNet(parameters), masked_lm.Ids(words)
    got = {r.doc_id: r for r in masked_lm.score(docs, (words, parameters)).collect()}
    assert len(got) == len(rows)
    for d, text in rows[:5]:
        ids, owner = ids_of.texts([text])
        total = 0.0
        for at in np.flatnonzero(owner == 0):  # one token at a time, softmax in the open
            h = np.tanh(net.bias + sum(net.side[k][ids[at + s]] for k, s in enumerate(masked_lm.SIDES)))
            g, w = divmod(int(ids[at]), masked_lm.GROUPS)
            for logits, hit in ((h @ net.group + net.group_bias, g), (h @ net.word[g] + net.word_bias[g], w)):
                total += float(logits[hit]) - np.log(np.exp(logits.astype(np.float64)).sum())
        assert got[d].n_tokens == len(text.split()) and got[d].score == pytest.approx(total, rel=1e-4)
    assert got[100].score == 0 and got[100].n_tokens == 0 and got[100].per_token is None
    untrained = {r.doc_id: r.score for r in masked_lm.score(docs, (words, masked_lm.WindowNet().all)).collect()}
    assert sum(got[d].score for d, _ in rows[:60]) > sum(untrained[d] for d, _ in rows[:60])
    assert masked_lm.score(frame(spark, []), masked_lm.train(frame(spark, []))).count() == 0


def test_masked_lm_gradient():
    rng = np.random.default_rng(1)
    net, ids = masked_lm.WindowNet(), rng.integers(0, masked_lm.VOCABULARY, 40)
    at = np.arange(2, 38)
    g = net.gradient(ids, at)
    for k in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 12, replace=False):
        up, down = masked_lm.WindowNet(net.all.copy()), masked_lm.WindowNet(net.all.copy())
        up.all[k] += 1e-2
        down.all[k] -= 1e-2
        slope = -(up.log_probability(ids, at).mean() - down.log_probability(ids, at).mean()) / 2e-2
        assert slope == pytest.approx(float(g[k]), rel=0.05, abs=2e-4)


def test_masked_lm_trains_on_every_position_once():
    ids, owner = masked_lm.Ids([b"alpha", b"beta"]).texts([prose(1, 300), "", prose(2, 300), "alpha"])
    rounds = [masked_lm.share(ids, owner, turn, masked_lm.STRIDE) for turn in range(masked_lm.ROUNDS)]
    assert sorted(np.concatenate(rounds)) == np.flatnonzero(owner >= 0).tolist()
    assert all(len(r) for r in rounds)


def test_masked_lm_tells_words_of_a_class_apart(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"{a}{b}{c}ing" for a in "bcdfgklmnprst" for b in "aeiou" for c in "bdgklmnprst"]  # one class
    rows = [(i, " ".join([f"{a}{b}" for a in "bcdfghklmnprst" for b in "aeiouwxyzcdfgh"] * 3 + rng.choices(words[:80], range(80, 0, -1), k=60))) for i in range(40)]
    tail = words[:80]
    monkeypatch.setattr(masked_lm, "LISTED", 250)  # in the driver, where the lists are cut
    monkeypatch.setattr(masked_lm, "HEAD", 150)
    words_, parameters = masked_lm.train(frame(spark, rows), rounds=1)
    text = "ba be bi bo {} ca ce ci co"
    n = collections.Counter(" ".join(t for _, t in rows).split())
    often, seldom, gibberish = max(tail, key=lambda w: n[w]), min(tail, key=lambda w: n[w] or 999), "qxqzqqing"
    got = {r.doc_id: r.score for r in masked_lm.score(frame(spark, list(enumerate(map(text.format, (often, seldom, gibberish))))), (words_, parameters)).collect()}
    assert got[0] > got[1] > got[2]
    assert got[0] - got[1] == pytest.approx(words_.log_within(often.encode()) - words_.log_within(seldom.encode()), rel=1e-4)


def test_masked_lm_word_probabilities_of_a_class_sum_to_one():
    rng = np.random.default_rng(3)
    pairs = np.zeros((257, 257))
    pairs[256, [97, 98]], pairs[np.ix_([97, 98], [97, 98])], pairs[[97, 98], 256] = 1e9, rng.integers(1, 9, (2, 2)) * 1e8, 2e9
    rest = rng.integers(0, 50, masked_lm.ENDINGS)
    found = masked_lm.Vocabulary([b"a"], {b"a": 90, b"ab": 30, b"bbb": 7}, rest, pairs)
    total = np.zeros(masked_lm.ENDINGS)
    import itertools

    for n in range(1, 15):  # other bytes have no weight to speak of
        for w in map(bytes, itertools.product(b"ab", repeat=n)):
            if w != b"a":
                total[masked_lm.ending(w)] += np.exp(found.log_within(w))
    met = {masked_lm.ending(bytes(w)) for n in (1, 2, 3) for w in itertools.product(b"ab", repeat=n)}
    for c in met:
        assert total[c] == pytest.approx(1, abs=0.02) or c == masked_lm.ending(b"a")


# 4 ---------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_scan_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", " = ", ": ", "=", '"', "'", " ", "é", "😀", "AKIA", "ABCDEFGH0123456789", "deadbeef" * 3, "0123456789abcdef", "abc", "x_tok", "en:", "hello", "\n", ".", "AKIAAKIA"]
    blob = base64.b64encode(hashlib.sha256(b"7").digest()).decode()
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(1000, "secret=token:abcdefgh"), (1001, None), (1002, ""), (1003, "the key is " + blob + " ok"), (1004, "Donaudampfschifffahrtsgesellschaftskapitaen and get_user_name_from_database"), (1003, "the key is " + blob + " ok"), (None, "password=abcdef1"), (1005, "=" * 500 + "-" * 500)]
    docs = frame(spark, rows)
    model = secret_scan.train(secret_scan.labelled_samples(spark, docs))
    found = secret_scan.scan(docs, model, extra=("text",)).withColumn("clean", secret_scan.redact(F.col("text"), F.col("spans"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(x) for x in r.base] == base_spans(r.text), r.text
        assert set(r.base) <= set(r.spans)
        if r.text is not None:
            want, at = "", 0
            for s, _, e in (tuple(x) for x in r.spans):
                want += r.text[at:s] + "[SECRET]" if s >= at else ""
                at = max(at, e)
            assert r.clean == want + r.text[at:]
    by = {r.doc_id: r for r in found}
    assert [(x.s, x.e) for x in by[1003].spans] == [(11, 11 + len(blob))]
    assert not by[1004].spans and not by[1005].spans and not by[1001].spans
    digest = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs, model)).collect()}
    assert digest[1002].base_sha256 == hashlib.sha256(b"").hexdigest() and digest[1002].spans == ""
    assert digest[None].n_assign == 1 and digest[None].spans == "assign:0:16"
    assert secret_scan.scan(frame(spark, []), model).count() == 0


def test_secret_scan_finds_secrets_joined_to_ordinary_text(spark):
    rng = random.Random(6)
    alphabets = ["abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    keys = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (16, 20) for _ in range(12)]
    names = ["", "PROD_SERVICE_KEY=", "config/production/service_account/private_key=", "backup-archive-server-name-"]
    rows = [(1000 * j + i, name + key) for j, name in enumerate(names) for i, key in enumerate(keys)] + [(-1, names[2] + "get_user_name_from_database/index")]
    docs = frame(spark, rows)
    got = {r.doc_id: {(x.s, x.e) for x in r.spans} for r in secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_samples(spark, docs))).collect()}
    alone = [i for i, key in enumerate(keys) if (0, len(key)) in got[i]]
    assert len(alone) >= 0.9 * len(keys) and not got[-1]
    for j, name in enumerate(names[1:], 1):
        for i in alone:
            assert any(s <= len(name) and e == len(name) + len(keys[i]) for s, e in got[1000 * j + i]), name + keys[i]


# 5 ---------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [None, (0, 100), (0, 0)])
def test_decontaminate(spark, limits, monkeypatch):
    if limits:  # the benchmark's side is too large to broadcast
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limits[0])
        monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", limits[1])
    item = "The train from Berlin covers 340 km in 4 hours and then stops for 20 minutes before going on to the coast"
    changed = item.replace("Berlin", "Madrid").replace("340", "512").replace("4 hours", "6 hours")
    clash = changed.replace("stops for 20", "stops for 6 and 20").replace("20 minutes", "20 minutes")
    repeated = "a b c d 5 e f g 5 h i j k l m n"
    rows = [(1, "Intro text here. " + item + ". More text."), (2, prose(2) + " " + changed), (3, prose(3)), (4, None), (5, ""), (1, item), (6, "a b c d 7 e f g 7 h i j k l m n"), (7, "a b c d 7 e f g 8 h i j k l m n"), (8, " ".join(item.split()[:10])), (None, item)]
    got = {r.doc_id: r for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame([(10, item, 1), (11, "too short", 1), (12, None, 1), (13, repeated, 1), (None, item, 1)], "item_id long, text string, words int")).collect()}
    assert set(got) == {1, 2, 6, None} and clash
    assert got[1].items == [10] and not got[1].changed
    assert got[2].items == [10] and got[2].changed
    assert got[6].items == [13] and got[6].changed  # both fives became seven; in 7 they differ
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, rows), none).count() == 0
    assert decontaminate.contaminated(frame(spark, []), spark.createDataFrame([(10, item)], "item_id long, text string")).count() == 0


def test_decontaminate_loses_no_copies(spark):
    apart = "Take 3 red cups and fill each of them with fresh water from the old well behind our house until only 3 remain on the shelf near the door"
    table = "12 15 18 21 24 27 30 33 36 39 42 45 48 51"
    short, item = "what is the capital of France", "4 7 sum 9 2 product 8 1 5 total 6 6 3 2 5"
    rows = [(1, prose(1) + ". " + apart.replace("only 3", "only 5")), (2, "see " + table + " end"), (3, "So " + short + " then"), (4, "what is the capital of Spain"), (5, table.replace("27", "28").replace("39", "38")), (6, prose(2)), (7, item), (8, item.replace("9", "7", 1))]
    items = [(1, apart), (2, table), (3, short), (4, item), (5, "... !")]
    got = {r.doc_id: r for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {d: r["items"] for d, r in got.items()} == {1: [1], 2: [2], 3: [3], 7: [4]}
    assert got[1].covered >= 13 and not got[2].changed and got[3].covered == 6 and not got[3].changed


def test_decontaminate_meets_names_of_other_lengths(spark):
    item = "Every morning the ferry from New York to Boston carries 30 crates of fresh fish past the old lighthouse"
    rows = [(1, item.replace("New York", "Rome").replace("Boston", "Los Angeles Bay")), (2, item.replace("New York", "Rome").replace("fresh fish", "red wine"))]
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r["items"], r.changed) for r in got] == [(1, [7], True)]


# 6 ---------------------------------------------------------------------------


def test_token_files(spark):
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    rows = [(5, "Hello WORLD's end"), (-3, "É ½ Σίσυφος <|endoftext|>"), (2, "hello <|endoftext|> world<|STARTOFTEXT|><|startoftext|>"), (9, None), (7, ""), (7, "twice"), (None, "gone"), (11, "word " * 5000)]
    folder = stage_path(spark, "tokens")
    manifest = token_files.write(frame(spark, rows), WORD_BPE, folder, end_id=2, docs_per_file=2)
    got = token_files.read(manifest, folder).orderBy("start").collect()
    want = sorted((d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows if d is not None)
    assert manifest.count() > 1
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.doc_id, ids) in want and r.start == start and r.n_tokens == len(ids)
        start += len(ids)
    crc = {(r.start, r.ids_crc32) for r in token_files.digest(token_files.read(manifest, folder)).collect()}
    assert crc == {(r.start, zlib.crc32(bytes(r.ids))) for r in got}
    none = stage_path(spark, "tokens")
    assert token_files.read(token_files.write(frame(spark, []), WORD_BPE, none, end_id=2), none).count() == 0


def test_word_encoder_equals_the_library():
    own, library, rng = token_files.WordEncoder(WORD_BPE), tokenizers.Tokenizer.from_file(WORD_BPE), random.Random(2)
    pool = ["<|endoftext|>", "<|startoftext|>"] + [chr(c) for c in [*range(256), 0x300, 0x301, 0x2028, 0x180E, 0x4E00, 0x130, 0x3A3, 0x212A, 0x1E9E, 0x1C4, 0x660, 0x2160]]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("abest  '_") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text, raw in zip(texts, own.encode_many(texts), strict=True):
        assert np.frombuffer(raw, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


# 7 ---------------------------------------------------------------------------


def test_viterbi_against_all_paths():
    import itertools

    rng = random.Random(4)
    truth = [chat_format.transcript([("system", "be brief"), ("user", "what is it\nand why"), ("assistant", "It is so.\nBecause.")] * 2, s) for s in range(5)]
    counts = collections.Counter()
    for text, states in truth:
        s = [chat_format.STATES.index(x) for x in states]
        for a, (_, f, _) in zip(s, chat_format.lines_of(text), strict=True):
            counts.update(("o", a, v) for v in f)
        counts["s", s[0], ""] += 1
        counts.update(("t", a, str(b)) for a, b in itertools.pairwise(s))
    hmm = chat_format.Hmm(dict(counts))
    for _ in range(20):
        features = [rng.choice([f for text, _ in truth for _, f, _ in chat_format.lines_of(text)]) for _ in range(4)]

        def value(path, features=features):
            return hmm.start[path[0]] + sum(hmm.move[a, b] for a, b in itertools.pairwise(path)) + sum(hmm.seen[v][s] for s, f in zip(path, features, strict=True) for v in f)

        best = max(value(p) for p in itertools.product(range(len(chat_format.STATES)), repeat=4))
        assert value(hmm.viterbi(features)) == pytest.approx(best)
    assert hmm.parse("") == ([], False) and hmm.viterbi([]) == []


def test_chat_format_recovers_held_out_roles(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op7_chat_format(spark, sf).collect()}
    truth = {r.conv_id: r.roles for r in table.groupBy("conv_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), ',')").alias("roles")).collect()}
    held = [c for c in got if got[c].held_out]
    assert held and sum(got[c].roles == truth[c] for c in held) >= 0.9 * len(held)
    odd = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, None, None, None), (None, 3, "robot", ""), (3, 700, "system", "late")], "conv_id long, turn long, role string, text string")
    raw = chat_format.transcripts(odd)
    assert sorted((r.c or 0, r.part) for r in raw.collect()) == [(0, 0), (1, 0), (2, 0), (3, 2)]
    hmm = chat_format.train(raw)
    blank = spark.createDataFrame([(1, 0, None, 3), (2, 0, " \n ", 3), (None, 0, "", 3)], "c long, part long, text string, chat int")
    assert chat_format.format_chats(blank, hmm).where("n_turns = 0 and chat = ''").count() == 3
    assert {r.c: r.n_turns for r in chat_format.format_chats(raw.where("c is not null"), hmm).collect()}[1] == 2  # a repeated row is a repeated turn
    empty = chat_format.transcripts(odd.limit(0))
    assert chat_format.format_chats(empty, chat_format.train(empty)).count() == 0


def test_parts_of_a_long_conversation_make_one_chat(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT", 3)
    rng = random.Random(12)
    said = ["what is it?", "It is so.\nBecause it was.", "one\n\ntwo\n\n\nthree", "", "why", "A: not a mark of mine", "x" * 30_000]
    rows = [(c, n, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(said)) for c in range(12) for n in range(rng.choice([1, 7, 40]))]
    rows += [(None, n, "user", "hm") for n in range(5)]
    raw = chat_format.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    table = spark.createDataFrame([tuple(r) for r in raw] + [(50, 0, "", ""), (50, 1, "User: hi", ""), (50, 2, " ", "")], "c long, part long, text string, truth string")
    hmm = chat_format.train(table.where("c <> 50"))
    whole, chats, turns = collections.defaultdict(list), collections.defaultdict(str), collections.Counter()
    for r in table.orderBy("c", "part").collect():
        whole[r.c].append(r.text)
    for r in chat_format.format_chats(table, hmm).orderBy("c", "part").collect():
        chats[r.c] += r.chat
        turns[r.c] += r.n_turns
    for c, texts in whole.items():
        found, _ = hmm.parse("\n".join(x for x in texts if x.strip()))
        assert chats[c] == chat_format.render(found) and turns[c] == len(found)


def test_transcripts_keep_what_is_said(spark):
    said = [("system", "be brief"), ("user", "para one\n\npara two"), ("assistant", ""), ("user", "Q: is this mine?"), ("tool", "1\n2"), ("assistant", "a line\n\n\nanother")]
    # below a heading line, a turn that begins like a mark cannot be told from a marked turn
    heard = [(r, t.removeprefix("Q: ")) for r, t in said]
    made = [chat_format.transcript(heard if s == 3 else said, s) for s in (0, 1, 2, 3)]
    rows = [(k, 0, t, " ".join(str(chat_format.STATES.index(x)) for x in truth)) for k, (t, truth) in enumerate(made)]
    hmm = chat_format.train(spark.createDataFrame(rows, "c long, part long, text string, truth string"))
    for k, (text, _) in enumerate(made):
        assert hmm.parse(text)[0] == (heard if k == 3 else said)


# 8 ---------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = language_id.pieces_of(PIECES)
    rng = np.random.default_rng(3)
    model = language_id.Model(PIECES, ["a", "b"], rng.random((len(pieces), 2)) / 100, 1e-7)
    number = {t: i for i, t in enumerate(pieces.texts)}

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, min(len(word), pieces.longest) + 1):
            p = model.prob[number[word[:k]]] if word[:k] in number else np.zeros(2)
            total += (np.maximum(p, model.floor) if k == 1 else p) * brute(word[k:])
        return total

    assert len(pieces) > 31_000 and pieces.longest == max(map(len, pieces.texts)) > 8  # the vocabulary is not cut
    for word in ["▁the", "▁straße", "▁zq界x", "a", "▁international", max(pieces.texts, key=len)]:
        whole = model.forward([word], len(word))[2][len(word)][0]
        assert whole == pytest.approx(brute(word))
        assert np.log(model._forward_long(word)[1]).sum(0) == pytest.approx(np.log(whole))
        use, long = np.zeros((len(pieces), 2)), np.zeros((len(pieces), 2))
        model.expected([word], len(word), np.array([[2.0, 3.0]]), use)
        model._expected_long(word, np.array([2.0, 3.0]), long)
        assert long == pytest.approx(use)
    endless = "▁" + "international" * 3000
    assert np.isfinite(np.log(model._forward_long(endless)[1]).sum(0)).all()
    assert model.score_many([endless[1:] + " a"])[0] == pytest.approx(np.log(model._forward_long(endless)[1]).sum(0) + np.log(brute("▁a")))
    # expected uses, weighted by length, cover every character once
    use = np.zeros((len(pieces), 2))
    model.expected(["▁the"], 4, np.ones((1, 2)), use)
    assert (use.T @ np.array([len(t) for t in pieces.texts])) == pytest.approx([4, 4])


def test_language_id(spark, sf):
    got = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] >= 0.95 and held[1] > 20
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the house and the tree"), (4, "the house and the tree"), (5, "a" * 50_000)]
    docs = spark.createDataFrame([(d, t, "en" if d % 2 else "de", 0.5) for d, t in rows], "doc_id long, text string, lang string, score double")
    model = language_id.train(docs, PIECES)
    out = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, model).collect())
    assert [x[1] for x in out[:3]] == ["und"] * 3 and out[3] == out[4] and out[5][1] in ("en", "de")
    assert language_id.identify(docs, language_id.train(docs.limit(0), PIECES)).where("lang_pred = 'und'").count() == 6
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert {r.doc_id for r in language_id.recognised(docs, model, 0.0).collect()} == {4, 5}


# 9 ---------------------------------------------------------------------------


def test_vector_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(20)]  # one vector many times
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (None, rows[1][1]), (305, [1.0, 2.0]), (306, [2.0, 1.0]), (0, rows[0][1])]
    table = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, score int")
    vectors = vector_topk.integer_vectors(table)
    got = collections.defaultdict(list)
    for r in vector_topk.top_k(vectors, vectors.where("id % 50 = 0 or id = 305"), k=5, query_block=2, candidate_block=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 50 == 0 or i == 305]:
        scores = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert vector_topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_bounds_hold_and_few_exact_vectors_are_read():
    rng = np.random.default_rng(4)
    v, q = rng.integers(-(10**5), 10**5, (3000, 16)), rng.integers(-(10**5), 10**5, (7, 16))
    low = v.min(0)
    width = np.maximum(1, (v.max(0) - low + vector_topk.CELLS) // vector_topk.CELLS)
    assert width.min() > 1
    cells = (v - low) // width
    assert cells.max() < vector_topk.CELLS
    a, b, half = 2 * q * width, (q * (2 * low + width - 1)).sum(1), (np.abs(q) * (width - 1)).sum(1)
    exact = q @ v.T
    assert (np.abs(2 * exact - (a @ cells.T + b[:, None])) <= half[:, None]).all()
    at, c, mid = vector_topk.scan_block(a, b, half, np.full(7, -1), cells, np.arange(3000), 5)
    assert (mid == (a @ cells.T + b[:, None])[at, c]).all() and len(at) < 7 * 100
    for k in range(7):
        assert set(np.argsort(-exact[k])[:5]) <= set(c[at == k])
    with pytest.raises(ValueError, match="too large"):
        vector_topk.scan_block(a * 2**40, b, half, np.full(7, -1), cells, np.arange(3000), 5)


# 10 --------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def mutated(text, rng, share):
    return " ".join(x + "q" if rng.random() < share else x for x in text.split())


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join_against_brute_force(spark, small, monkeypatch):
    if small:  # every posting list is long, families span blocks, stars start again
        monkeypatch.setattr(jaccard_join, "LIST", 3)
        monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
        monkeypatch.setattr(jaccard_join, "FEW", 5)
    rng = random.Random(8)
    texts = [prose(s, rng.choice([3, 6, 40, 120])) for s in range(30)]
    texts += [mutated(texts[k % 6], rng, rng.choice([0.0, 0.01, 0.03, 0.05])) for k in range(60)]
    texts += [texts[3] + " " + prose(500 + k, 60) for k in range(15)]  # a passage that many share
    texts += ["one two", "ONE  two", "one two three", "", None, "\n", "É é", "é é"]
    rows = [(rng.randint(0, 10**6) * 1000 + i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_edge_cases(spark):
    assert jaccard_join.link(frame(spark, [])).count() == 0
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(frame(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c\td e f"), (None, "a b c d e f"), (7, None)])).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 2, None), (7, 0, 7)], key=str)
    assert len(jaccard_join.shingles("x" * 200_000 + " y z")) == 1


def test_multi_match_prefixes_lose_no_pair():
    rng = np.random.default_rng(9)
    order = jaccard_join.Order(rng.integers(0, 40, jaccard_join.sketch_size(0)))
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.choice(base, n))
        b = np.unique(np.where(rng.random(len(a)) < 0.12, rng.integers(0, 1 << 63, len(a)).astype(np.uint64), a))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 75 * (len(a) + len(b) - inter):
            continue
        (ga, ma, _), (gb, mb, _) = order.prefix(a), order.prefix(b)
        m = min(ma, mb)
        la, lb = jaccard_join.levels(len(a), len(ga)), jaccard_join.levels(len(b), len(gb))
        assert len(np.intersect1d(ga[la <= m], gb[lb <= m])) >= m
