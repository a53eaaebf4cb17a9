"""N-gram Jaccard join (operator 10) with adaptive multi-match prefixes.

Documents are sets of word 5-grams; two link when their Jaccard similarity is
at least 0.75. The join is exact up to collisions of 64-bit hashes.

1. One pass hashes every document's set. Equal sets are one class, known by a
   64-bit hash of the set; copies are never expanded into pairs. The same pass
   counts 5-grams in a sketch, sized by the corpus; it orders them and estimates
   costs, no link depends on its errors.
2. Each class orders its 5-grams from rare to frequent (by the sketch) and keeps
   a prefix: with size n, overlap a = ceil(0.75 n) needed and l matches asked
   for, the first n - a + l of them. Two linked sets share at least l 5-grams of
   these prefixes. Every class picks the l for which the estimated cost of
   scanning postings and verifying candidates is least; a pair must then share
   the smaller of its two l within the prefixes of that length, cut to what two sets
   of their sizes need: of sizes n and n', and o the overlap of a link, the first n - o + l.
3. Near copies first: the few 5-grams of least hash in every prefix meet, each
   list's classes are compared with the least of them that shares two of these
   5-grams, and links found so make groups. This finds most links of most groups
   at a cost in proportion to the classes; it need not find all.
4. All prefixes meet by 5-gram. A list whose classes are of one group yields
   nothing; one of moderate length the pairs across groups that pass the length,
   match and place conditions (what stands before and after the 5-gram can make up
   the overlap); a long one only yields stars, so nothing grows with the
   square of a group's size. If many classes are on stars, the join starts again
   among these alone: their sketch is emptier, so it tells more 5-grams apart, and
   classes that share a passage but little else leave the stars.
5. Pairs and stars together connect classes into families. Families are
   verified exactly, in blocks of bounded size: a matrix product over the
   5-grams two blocks share gives all overlaps at once, and only the links'
   components leave the task. The components of all links are the result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, mix64, slices, stage, stage_path
from .components import connected

WORDS = 5
#: Jaccard threshold in hundredths.
PERCENT = 75
#: The sketch has a slot for so many 5-grams of the corpus, and 2 to the power of these at least and at most.
GRAMS_A_SLOT, SKETCH_BITS, CHUNK = 64, (22, 24), 1 << 15
#: A 5-gram whose count surely exceeds this makes a star; so does a longer posting list than LIST.
HOT, LIST = 256, 32
#: A hot 5-gram's list is dealt to so many tasks.
SALTS = 512
#: 5-grams of a prefix that look for near copies first, and how many of them two must share.
EARLY, EARLY_SHARED = 8, 2
#: Members of a group's first comparison that one task takes with the same centre.
SPOKES = 1024
MAX_MATCHES = 48
#: The last place in a prefix that is told from later ones.
PLACES = (1 << 20) - 1
#: Candidates that a 5-gram of no noticeable count is expected to bring.
EXPECTED = 0.1
#: A block of a family holds about so many documents and 5-grams at most.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 1_000_000
#: Classes on long posting lists that are verified in blocks at once; more are first joined again among themselves.
FEW = 4096

_SPAN = 1 << 16
_ODD = 0xD6E8FEB86659FD93
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW = np.full(_SPAN + 1, _ODD, np.uint64)
_INV = np.full(_SPAN + 1, pow(_ODD, -1, 1 << 64), np.uint64)
_POW[0] = _INV[0] = 1
_POW, _INV = np.cumprod(_POW, dtype=np.uint64), np.cumprod(_INV, dtype=np.uint64)
_PLACE = mix64(np.arange(11, 11 + WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: polynomial in its bytes, mixed."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.empty(len(words), np.uint64)
    end = np.cumsum(size)
    i = 0
    while i < len(words):
        start = end[i] - size[i]
        j = int(np.searchsorted(end, start + _SPAN, side="right"))
        if j == i:  # one word longer than the span
            out[i] = int.from_bytes(hashlib.blake2b(words[i], digest_size=8).digest(), "little")
            i += 1
            continue
        raw = np.frombuffer(b"".join(words[i:j]), np.uint8)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * _POW[: len(raw)], dtype=np.uint64)])
        first = end[i:j] - size[i:j] - start
        out[i:j] = (total[first + size[i:j]] - total[first]) * _INV[first]
        i = j
    return mix64(out)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words count as one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six white characters
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(len(h), WORDS)):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(mix64(total))


def set_hash(s: np.ndarray) -> int:
    """Of a set of hashes; 0 stands for the empty set only."""
    if not len(s):
        return 0
    total = int(mix64(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
    return int(mix64(np.array([total ^ (len(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)], np.uint64)).view(np.int64)[0]) or 1


def needed(n: int) -> int:
    return -(-n * PERCENT // 100)


def levels(n: int, length: int) -> np.ndarray:
    """For each 5-gram of a prefix of a set of n, the number of matches from which on the prefix has it."""
    return np.maximum(1, np.arange(length) - (n - needed(n)) + 1)


def _slots(s: np.ndarray, slots: int) -> np.ndarray:
    return (s >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def sketch_size(chars: int) -> int:
    """Slots for texts of so many characters in all, six to a word."""
    return 1 << min(max(SKETCH_BITS[0], (chars // (6 * GRAMS_A_SLOT)).bit_length()), SKETCH_BITS[1])


def _rows(batches, likely: np.ndarray | None):
    """Batches of (d, t); with a bitmap over hashed ids, the rows that it has."""
    for batch in batches:
        if likely is not None:
            keep = np.flatnonzero(likely[_id_slots(np.asarray(batch.column(0).fill_null(0)), len(likely))])
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
        yield batch


def _first_pass(docs: DataFrame, likely: np.ndarray | None, slots: int) -> tuple[DataFrame, DataFrame]:
    """(d, n, c, h) for every document, and the sketch's chunks by task."""
    names = ["kind", "d", "n", "c", "h", "chunk", "counts"]

    def run(batches):
        sketch = np.zeros(slots, np.uint8)
        known: set[int] = set()
        for batch in _rows(batches, likely):
            sizes, classes = [], []
            for _, texts in slices(batch, "t"):
                for text in texts:
                    s = shingles(text)
                    c = set_hash(s)
                    sizes.append(len(s))
                    classes.append(c)
                    if c not in known:
                        if len(known) >= 200_000:
                            known.clear()
                        known.add(c)
                        at = _slots(s, slots)
                        sketch[at] = np.minimum(sketch[at], 254) + 1
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), batch.column(2), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if sketch.any():
            parts = sketch.reshape(-1, CHUNK)
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), *[pa.nulls(n, pa.int64())] * 4, pa.array(np.arange(n, dtype=np.int32)), pa.array([zlib.compress(p, 1) for p in parts], pa.binary())], names=names)

    spark = docs.sparkSession
    both = docs.select("d", "t", F.xxhash64("t").alias("h")).mapInArrow(run, "kind int, d long, n long, c long, h long, chunk int, counts binary")
    path = stage_path(spark, "sets")
    both.write.partitionBy("kind").parquet(path)
    read = spark.read.schema("d long, n long, c long, h long, chunk int, counts binary, kind int").parquet(path)
    return read.where("kind = 0").select("d", "n", "c", "h"), read.where("kind = 1").select("chunk", "counts")


def add_chunks(chunks: DataFrame, size: int) -> np.ndarray:
    """Sum the tasks' byte arrays chunk by chunk on the executors; one array comes back."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_buffer()), np.uint8).astype(np.uint32)
                total[k] = total[k] + part if k in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(size, np.uint32)
    for k, raw in chunks.repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect():
        part = np.frombuffer(raw, np.uint32)
        out[k * len(part) : (k + 1) * len(part)] += part
    return out


class Order:
    """The order of 5-grams and the choice of prefixes, from the sketch."""

    def __init__(self, sketch: np.ndarray):
        # above the mean only: half of the rare 5-grams keep a count of zero, enough to fill most prefixes,
        # and those in a few documents more than others already come late
        noise = np.uint32(sketch.sum(dtype=np.int64) // len(sketch))
        self.extra = np.minimum(np.where(sketch > noise, sketch - noise, 0), 65535).astype(np.uint16)

    def prefix(self, s: np.ndarray):
        """(5-grams, matches l, is it hot) of a set."""
        extra = self.extra[_slots(s, len(self.extra))]
        order = np.lexsort((s, np.log2(extra + 1.0).astype(np.int8)))
        a = needed(len(s))
        base = len(s) - a
        most = min(MAX_MATCHES, a)
        candidates = np.cumsum(extra[order] + EXPECTED)
        tries = np.arange(1, most + 1)
        # a longer prefix costs its own rows and postings; of its candidates, one in `tries` at most is left to verify
        matches = int(np.argmin(tries + candidates[base + tries - 1] * (1 + len(s) / 8 / tries))) + 1
        take = order[: base + matches]
        return s[take], matches, extra[take] >= HOT


def _prefixes(docs: DataFrame, order: Order, likely: np.ndarray | None) -> DataFrame:
    """(c, n, l, grams, hot) of every class: the 5-grams of its prefix in order."""

    def run(batches):
        known: set[int] = set()
        for batch in _rows(batches, likely):
            for _, texts in slices(batch, "t"):
                rows = []
                for text in texts:
                    s = shingles(text)
                    c = set_hash(s)
                    if not len(s) or c in known:
                        continue
                    if len(known) >= 200_000:
                        known.clear()
                    known.add(c)
                    grams, matches, hot = order.prefix(s)
                    rows.append((c, len(s), matches, grams.tobytes(), np.packbits(hot).tobytes()))
                if rows:
                    c, n, m, grams, hot = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int32()), pa.array(grams, pa.binary()), pa.array(hot, pa.binary())], names=["c", "n", "l", "grams", "hot"])

    found = docs.mapInArrow(run, "c long, n long, l int, grams binary, hot binary")
    # a class that two tasks hold has two equal rows: the lists drop the second
    return stage(found, "prefixes")


def _each(batches):
    """(c, n, l, grams, hot, k) of the rows of a prefix table; k is c where it is not given."""
    for batch in batches:
        c, n, m = (np.asarray(batch.column(i)).tolist() for i in range(3))
        k = batch.column(5).to_pylist() if batch.num_columns > 5 else c
        for i, (grams, hot) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
            g = np.frombuffer(grams.as_buffer(), np.int64)
            yield c[i], n[i], m[i], g, np.unpackbits(np.frombuffer(hot.as_buffer(), np.uint8), count=len(g)).astype(bool), c[i] if k[i] is None else k[i]


def _full(rows, names: list[str], types: list, size: int = 500_000):
    """Arrow batches of about ``size`` rows from tuples of equally long arrays."""
    held, n = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= size:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _near_copies(prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes to compare first: b shares ``EARLY_SHARED`` of the
    ``EARLY`` least-hashed 5-grams of the prefixes with a, the least of their lists."""

    def run(batches):
        def rows():
            for c, n, _, grams, hot, _ in _each(batches):
                take = n - needed(n) + 1
                least = np.argsort(grams[:take].view(np.uint64) * np.uint64(_ODD), kind="stable")[:EARLY]
                yield grams[least], np.full(len(least), c), np.where(hot[least], c & SALTS - 1, -1)

        yield from _full(rows(), ["g", "c", "salt"], [np.int64, np.int64, np.int16])

    rows = prefixes.mapInArrow(run, "g long, c long, salt short")
    part = rows.withColumn("a", F.min("c").over(Window.partitionBy("g", "salt")))
    parts = part.where("salt >= 0").select("g", "a").distinct()  # SALTS rows a 5-gram at most
    joined = parts.withColumn("m", F.min("a").over(Window.partitionBy("g"))).select(F.col("m").alias("a"), F.col("a").alias("b"))
    spokes = part.select("a", F.col("c").alias("b")).union(joined).where("a <> b")
    return spokes.groupBy("a", "b").count().where(F.col("count") >= EARLY_SHARED).select("a", "b")


def _linked_spokes(docs: DataFrame, spokes: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that link. Each centre's set meets its
    members' sets, so the work grows with the pairs; large stars are dealt out."""
    spokes = stage(spokes, "spokes")
    wide = spokes.groupBy("a").count().where(F.col("count") > SPOKES).select(F.col("a").alias("h"), F.floor(F.col("count") / SPOKES + 1).alias("parts"))
    dealt = spokes.join(wide, F.col("a") == F.col("h"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).alias("s"))
    members = dealt.select("a", "s", F.lit(True).alias("member"), F.col("b").alias("c"))
    ends = members.union(members.select("a", "s", F.lit(False).alias("member"), F.col("a").alias("c")).distinct())
    rows = _with_sets(docs, stage(ends.join(classes.select("c", "rep"), "c"), "spokes")).select("a", "s", "member", "c", "set")

    def run(batches):
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, member, c, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4), strict=True):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member:
                    centre = s.copy()
                    continue
                at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                both = int((centre[at] == s).sum())
                if 100 * both >= PERCENT * (len(centre) + len(s) - both):
                    found.append((a, c))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return rows.repartition("a", "s").sortWithinPartitions("a", "s", "member").mapInArrow(run, "a long, b long")


def _postings(prefixes: DataFrame, group: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of groups with a candidate pair of classes, and star rows (g, k):
    the groups on a long list. ``group`` has the group (label) of the classes (node)
    that have one; any other class is a group of its own."""

    def emit(batches):
        def rows():
            for c, n, m, grams, hot, k in _each(batches):
                level = levels(n, len(grams))
                yield grams, np.full(len(grams), c), n << 36 | np.minimum(np.arange(len(grams)), PLACES) << 16 | m << 8 | level, np.where(hot, c & SALTS - 1, -1), np.full(len(grams), 0 if k == c else k)

        yield from _full(rows(), ["g", "c", "p", "salt", "k"], [np.int64, np.int64, np.int64, np.int16, np.int64])

    names = ["kind", "a", "b", "ka", "kb", "m", "w"]

    def rows(kind, a, b, ka, kb, m, w):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (a, b, ka, kb)), pa.array(m.astype(np.int32)), pa.array(w.astype(np.int64))], names=names)

    def meet(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        pairs: list[np.ndarray] = []
        waiting = 0

        def flush():
            both = np.concatenate(pairs, axis=1)
            o = np.lexsort((both[1], both[0]))
            both = both[:, o]
            new = np.concatenate([[True], (both[0, 1:] != both[0, :-1]) | (both[1, 1:] != both[1, :-1])])
            at = np.flatnonzero(new)
            return rows(0, *both[:, at], np.diff(np.append(at, both.shape[1])))

        def groups(g, c, p, salt, k):
            keep = np.ones(len(g), bool)
            keep[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            g, c, p, salt, k = g[keep], c[keep], p[keep], salt[keep], k[keep]
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            size = np.diff(np.append(start, len(g)))
            hot = salt[start] >= 0  # other tasks hold the rest of its list
            across = np.minimum.reduceat(k, start) < np.maximum.reduceat(k, start) if len(g) else hot
            star = np.repeat(hot | (size > LIST) & across, size)
            out = None
            if star.any():  # each group of a list once
                listed = np.unique(np.stack([g[star], k[star]]), axis=1)
                none = np.zeros(listed.shape[1], np.int64)
                out = rows(1, listed[0], none, listed[1], none, none, none)
            found = []
            for n in range(2, LIST + 1):
                at = start[(size == n) & ~hot & across]
                i, j = np.triu_indices(n, 1)
                for s in range(0, len(at), max(1, 400_000 // len(i))):
                    part = at[s : s + max(1, 400_000 // len(i)), None]
                    x, y = (part + i).ravel(), (part + j).ravel()
                    px, py = p[x], p[y]
                    nx, ny = px >> 36, py >> 36
                    ix, iy = px >> 16 & PLACES, py >> 16 & PLACES
                    # one for the 5-gram itself, and at most the shorter stretch before and the shorter one after it
                    most = 1 + np.minimum(ix, iy) + np.minimum(nx - ix, ny - iy) - 1
                    m = np.minimum(px >> 8 & 255, py >> 8 & 255)
                    # at most n - least 5-grams of a set are not shared, so m of its first n - least + m are;
                    # where one match is asked for (few pairs), the whole prefix counts
                    least = -(-PERCENT * (nx + ny) // (100 + PERCENT))
                    early = (m == 1) | (ix < nx - least + m) & (iy < ny - least + m)
                    level = np.maximum(px & 255, py & 255)
                    ok = (k[x] != k[y]) & (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)) & (level <= m) & early & (most >= least)
                    if ok.any():
                        found.append(np.stack([c[x][ok], c[y][ok], k[x][ok], k[y][ok], m[ok]]))
            return out, found

        for batch in batches:
            new = [np.asarray(batch.column(i)).astype(np.int64) for i in range(5)]
            if not len(new[0]):
                continue
            new[4] = np.where(new[4] == 0, new[1], new[4])
            cols = [np.concatenate(x) for x in zip(held, new, strict=True)]
            # the last 5-gram may go on in the next batch; rows of a hot one need not be held
            other = np.flatnonzero(cols[0] != cols[0][-1])
            cut = len(cols[0]) if cols[3][-1] >= 0 else int(other[-1]) + 1 if len(other) else 0
            held = [x[cut:] for x in cols]
            if cut:
                out, found = groups(*(x[:cut] for x in cols))
                if out is not None:
                    yield out
                pairs += found
                waiting += sum(x.shape[1] for x in found)
                if waiting > 400_000:
                    yield flush()
                    pairs, waiting = [], 0
        if len(held[0]):
            out, found = groups(*held)
            if out is not None:
                yield out
            pairs += found
        if pairs:
            yield flush()

    spark = prefixes.sparkSession
    named = prefixes.join(group.select(F.col("node").alias("c"), F.col("label").alias("k")), "c", "left").select("c", "n", "l", "grams", "hot", "k")
    dealt = named.mapInArrow(emit, "g long, c long, p long, salt short, k long").repartition("g", "salt").sortWithinPartitions("g", "c")
    path = stage_path(spark, "candidates")
    dealt.mapInArrow(meet, "kind int, a long, b long, ka long, kb long, m int, w long").write.partitionBy("kind").parquet(path)
    read = spark.read.schema("a long, b long, ka long, kb long, m int, w long, kind int").parquet(path)
    pairs = read.where("kind = 0").groupBy("a", "b").agg(F.sum("w").alias("w"), F.first("m").alias("m"), F.first("ka").alias("ka"), F.first("kb").alias("kb")).where("w >= m")
    return pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b")), read.where("kind = 1").select(F.col("a").alias("g"), F.col("ka").alias("k"))


def _spread(stars: DataFrame) -> DataFrame:
    """(a, b) from each list of several groups: its least group, any other one."""
    centre = stars.groupBy("g").agg(F.min("k").alias("b"), F.max("k").alias("high")).where("b < high").select(F.col("g").alias("h"), "b")
    return stars.join(centre, F.col("g") == F.col("h")).where("k <> b").select(F.col("k").alias("a"), "b").distinct()


def _local_links(left: list, right: list, same: bool) -> list[tuple[int, int]]:
    """Links between two blocks of (id, set) as edges to each component's smallest id."""
    docs = left if same else left + right
    size = np.fromiter((len(s) for _, s in docs), np.int64, len(docs))
    ids = np.fromiter((d for d, _ in docs), np.int64, len(docs))
    grams, place, count = np.unique(np.concatenate([s for _, s in docs]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(docs)), size)
    keep = count[place] > 1
    owner, place = owner[keep], shared[place[keep]]
    total = int(shared[-1]) + 1 if len(grams) else 0
    cut = len(docs) if same else len(left)
    overlap = np.zeros((cut, cut if same else len(right)), np.float32)
    o = np.argsort(place, kind="stable")
    owner, place = owner[o], place[o]
    step = max(256, 16_000_000 // max(1, len(docs)))
    for s in range(0, total, step):
        a, b = np.searchsorted(place, [s, s + step])
        table = np.zeros((len(docs), min(step, total - s)), np.float32)
        table[owner[a:b], place[a:b] - s] = 1
        overlap += table[:cut] @ (table[:cut] if same else table[cut:]).T
    rows, cols = size[:cut, None], (size if same else size[cut:])[None, :]
    linked = 100 * overlap.astype(np.float64) >= PERCENT * (rows + cols - overlap)
    if same:
        np.fill_diagonal(linked, False)
    x, y = np.nonzero(linked)
    if not same:
        y = y + cut
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    while True:  # smallest label over links, then over labels
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        if (new == label).all():
            break
        label = new
    by_rank = np.sort(ids, kind="stable")
    return [(int(d), int(by_rank[k])) for d, k in zip(ids, label, strict=True) if d != by_rank[k]]


def _verify(blocks: DataFrame) -> DataFrame:
    """Links of (f, i, j, right, d, set) rows as star edges (a, b)."""

    def run(batches):
        key, sides = None, ([], [])

        def close():
            edges = _local_links(sides[0], sides[1], key[1] == key[2]) if key and (len(sides[0]) + len(sides[1])) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            f, i, j, right, d = (np.asarray(batch.column(k)).tolist() if k != 3 else batch.column(k).to_pylist() for k in range(5))
            for k, raw in enumerate(batch.column(5)):
                if (f[k], i[k], j[k]) != key:
                    if key:
                        yield close()
                    key, sides = (f[k], i[k], j[k]), ([], [])
                sides[right[k]].append((d[k], np.frombuffer(raw.as_buffer(), np.uint64).copy()))
        if key:
            yield close()

    return blocks.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of all documents.

    Result, one row per input row: ``doc_id`` long, ``n_shingles`` long (the size
    of the set) and ``component_id`` long (the smallest id reachable by links,
    its own included). A document without words, or of null text, is linked
    with nothing, its component is its own id. Rows that repeat an id get a row
    each, of the same component if their texts link. The id column must be an
    integer; rows of null id are linked with nothing. Two more columns tell rows
    of one id apart: ``text_hash`` long (Spark's xxhash64 of the text) and
    ``group_key`` long, one value for each component.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    slots = sketch_size(docs.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0])
    table, chunks = _first_pass(docs, None, slots)
    classes = table.where("n > 0 and d is not null").groupBy("c").agg(F.min("d").alias("rep"), F.first("n").alias("n"))
    prefixes = _prefixes(docs.where("d is not null"), Order(add_chunks(chunks, slots)), None)
    group = stage(connected(_linked_spokes(docs, _near_copies(prefixes), classes)), "groups")
    of = classes.join(group, F.col("c") == F.col("node"), "left").select("c", "rep", "n", F.coalesce("label", "c").alias("k"))
    pairs, stars = _postings(prefixes, group)
    drop_stage(prefixes)
    found, before = [pairs], None
    spokes = stage(_spread(stars), "stars")
    while True:
        starred = of.join(spokes.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k", "left_semi")
        n = starred.count()
        if n <= FEW or before is not None and n > before // 2:
            break
        before = n
        likely = _bitmap(starred.select("rep"))
        again = _prefixes(docs.where("d is not null"), Order(add_chunks(_first_pass(docs, likely, slots)[1], slots)), likely)
        pairs, stars = _postings(again, group)
        found.append(pairs)
        spokes = stage(_spread(stars), "stars")
    enough = spokes
    for more in found:
        enough = enough.union(more)
    family = connected(enough)

    # the families' members, and the blocks they fall into
    members = stage(of.join(family, F.col("node") == F.col("k")).select(F.col("label").alias("f"), "c", "rep", "n"), "members")
    size = members.groupBy("f").agg((F.floor(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_GRAMS)) + 1).cast("int").alias("k"), F.count(F.lit(1)).alias("of")).where("of > 1").withColumnRenamed("f", "f2")
    placed = members.join(size, F.col("f") == F.col("f2")).select("f", "c", "rep", "k", F.pmod(F.xxhash64("c"), F.col("k")).cast("int").alias("i"))
    own = _with_sets(docs, stage(placed, "placed"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    blocks = own.select("f", "i", "c", "set", other).select("f", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), (F.col("i") > F.col("o")).alias("right"), F.col("c").alias("d"), "set")
    component = stage(connected(_verify(blocks).union(group.select("node", "label"))), "components")
    least = component.join(classes, F.col("node") == F.col("c")).groupBy("label").agg(F.min("rep").alias("component_id")).withColumnRenamed("label", "l2")
    named = component.join(least, F.col("label") == F.col("l2")).select(F.col("node").alias("c2"), "component_id", "label")
    first = classes.join(named, F.col("c") == F.col("c2"), "left").select(F.col("c").alias("c2"), F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "c").alias("group_key"))
    out = table.join(first, (F.col("c") == F.col("c2")) & (F.col("n") > 0) & F.col("d").isNotNull(), "left")
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "d").alias("component_id"), F.col("h").alias("text_hash"), F.coalesce("group_key", "c").alias("group_key"))


def _bitmap(wanted: DataFrame, bits: int = 1 << 20) -> np.ndarray:
    """A bitmap of fixed size over hashed ids, made on the executors."""

    def mark(batches):
        seen = np.zeros(bits, np.uint8)
        for batch in batches:
            seen[_id_slots(np.asarray(batch.column(0)), bits)] = 1
        parts = seen.reshape(-1, CHUNK)
        used = [k for k in range(len(parts)) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[k], 1) for k in used], pa.binary())], names=["chunk", "counts"])

    return add_chunks(wanted.mapInArrow(mark, "chunk int, counts binary"), bits) > 0


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted``, which has classes (c, rep), with the classes' sets: the bitmap
    over ids spares the texts of most other documents the way, the join decides."""
    likely = _bitmap(wanted.select("rep"))

    def run(batches):
        seen: set = set()
        for batch in _rows(batches, likely):
            ids = iter(batch.column(0).to_pylist())
            rows = []
            for _, texts in slices(batch, "t"):
                for text, d in zip(texts, ids):  # noqa: B905
                    s = shingles(text)
                    row = d, set_hash(s)
                    if row not in seen:  # a repeated row
                        rows.append((*row, s.tobytes()))
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(row)
            d, c, sets = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(c, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "c", "set"])

    found = docs.where("d is not null").mapInArrow(run, "rep long, c long, set binary")
    # both sides grow with the input: the same join at every size
    return found.join(wanted.hint("merge"), ["rep", "c"])


def _id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)
