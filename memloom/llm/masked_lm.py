"""LM scoring by masked pseudo-likelihood (operator 3).

A bidirectional window network predicts every token from the two tokens on its
left and the two on its right; a document's score is the sum of the tokens'
conditional log-probabilities.

Tokens are words: lower-cased ASCII, punctuation cut off, digits alike. The
softmax is hierarchical, on three levels. An outcome of the network is one of the
corpus's most frequent words or, for every other word, one of a fixed number of
classes by its ending; outcomes stand in groups, and the network predicts the group,
then the outcome within it. Below a class, log p(word | class) is added from the corpus's counts. The ``LISTED`` most
frequent words have counts of their own; the rest of a class is shared out by a
byte model, counted on those rarer words and scaled to sum to one over the words
of the class that are not listed, so unseen words have a probability as well. Training is data-parallel, in
numpy: in every round each task starts from the same parameters, runs Adam over
a fixed share of the positions of every document it holds, another share in each
round and all positions in the end, and the tasks' parameters are averaged,
weighted by their positions, so how rows are dealt to tasks has a small part in the
parameters. Word counts and parameters are gathered from all documents, so both grow with the corpus; only
the listed words, the byte model and the averaged parameters, all of bounded
size, reach the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, mix64, slices, stage

#: Outcomes of the network: so many groups of as many.
GROUPS = 32
VOCABULARY, ENDINGS, HIDDEN, SIDES = GROUPS * GROUPS, 64, 32, (-2, -1, 1, 2)
#: Words that are outcomes of their own, besides the edge of a text and the classes.
HEAD = VOCABULARY - 1 - ENDINGS
#: A task trains on one position of this many, other ones in each round: all positions in as many rounds.
STRIDE, ROUNDS, BATCH = 2, 2, 4096
#: Words with a count of their own, those of the network included; scale of the classes of counts.
LISTED, _FINE = 65_536, 64
CACHE_WORDS = 300_000
#: How an encoded text holds an outcome, and bytes of encoded texts that are taken at once.
_ID, SLICE = np.dtype("<u2"), 320_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class Vocabulary(list):
    """The network's words, and p(word | ending class) of all others.

    ``counts`` are the listed words' counts, ``rest`` the counts of unlisted
    words by class, ``pairs`` the byte pairs of unlisted words, read from the
    end: pairs[a, b] counts byte b before byte a; 256 is the border on both sides.
    """

    def __init__(self, words: list[bytes], counts: dict[bytes, int], rest: np.ndarray, pairs: np.ndarray):
        super().__init__(words)
        own = set(words)
        listed = {w: n for w, n in counts.items() if w not in own}
        used = np.array([*sorted(set(_TABLE) - {32}), 256])
        step = np.zeros((257, 257))
        step[np.ix_(used, used)] = pairs[np.ix_(used, used)] + 0.5
        step[256, 256] = 0  # no word is empty
        total = step.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.step = np.log(np.divide(step, total, out=np.zeros_like(step), where=total > 0)).tolist()
        # the byte model's share of each class, without listed words
        share = self._class_shares(used[:-1])
        for w in counts.keys() | own:
            share[ending(w)] -= np.exp(self.spelled(w))
        seen = rest.astype(np.float64) + 1
        for w, n in listed.items():
            seen[ending(w)] += n
        self.listed = {w: float(np.log(n / seen[ending(w)])) for w, n in listed.items()}
        self.unlisted = (np.log((rest + 1) / seen) - np.log(np.maximum(share, 1e-12))).tolist()
        self.within = {w: 0.0 for w in words} | self.listed

    def __reduce__(self):
        return _restored, (list(self), self.__dict__)

    def _class_shares(self, used: np.ndarray) -> np.ndarray:
        """The byte model's probability of all words of each class."""
        p = np.exp(np.array(self.step))
        out = np.zeros(ENDINGS)
        for a in used:  # the last byte
            out[ending(bytes([a]))] += p[256, a] * p[a, 256]
            for b in used:
                two = p[256, a] * p[a, b]
                out[ending(bytes([b, a]))] += two * p[b, 256]
                three = [ending(bytes([c, b, a])) for c in used]
                out += np.bincount(three, two * p[b, used], ENDINGS)
        return out

    def spelled(self, word: bytes) -> float:
        """Log-probability of the word in the byte model."""
        total, last = 0.0, 256
        for b in reversed(word):
            total += self.step[last][b]
            last = b
        return total + self.step[last][256]

    def log_within(self, word: bytes) -> float:
        """log p(word | class); 0 for a word that the network predicts itself."""
        found = self.within.get(word)
        return self.unlisted[ending(word)] + self.spelled(word) if found is None else found


def _restored(words: list[bytes], state: dict) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    out.extend(words)
    out.__dict__.update(state)
    return out


class Within(dict):
    """Log p(word | class) of the words met, as many as ``CACHE_WORDS``."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.within)
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(self.vocabulary.within)
        found = self[word] = self.vocabulary.log_within(word)
        return found


class Ids(dict):
    """Word to id; 0 is the edge of a text, then the ending classes, then the vocabulary."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__({w: 1 + ENDINGS + i for i, w in enumerate(vocabulary)})
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update({w: 1 + ENDINGS + i for i, w in enumerate(self.vocabulary)})
        found = self[word] = 1 + ending(word)
        return found

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row with edges between the texts, and each id's text (-1: edge)."""
        return self.rows([words_of(text) for text in texts])

    def rows(self, cut: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        edge = max(map(abs, SIDES))
        ids, owner = [np.zeros(edge, np.int64)], [np.full(edge, -1)]
        for k, words in enumerate(cut):
            ids += [np.fromiter(map(self.__getitem__, words), np.int64, len(words)), np.zeros(edge, np.int64)]
            owner += [np.full(len(words), k), np.full(edge, -1)]
        return np.concatenate(ids), np.concatenate(owner)


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials relative to each column's top (in place), and the tops."""
    top = logits.max(0)
    logits -= top
    return np.exp(logits, out=logits), top


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities, a column each, in place."""
    p, _ = _exponentials(logits)
    p *= 1 / p.sum(0)
    return p


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """The log of each column's sum of exponentials; spoils the logits."""
    p, top = _exponentials(logits)
    return top + np.log(p.sum(0))


def _logits(h: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One column a position: what is done for all outcomes of a position runs along memory."""
    out = weight.T @ h.T
    out += bias[:, None]
    return out


class WindowNet:
    """One table of hidden contributions per side, tanh, softmax over groups and within each."""

    def __init__(self, parameters: np.ndarray | None = None):
        sizes = [len(SIDES) * VOCABULARY * HIDDEN, HIDDEN, HIDDEN * GROUPS, GROUPS, GROUPS * HIDDEN * GROUPS, VOCABULARY]
        if parameters is None:
            rng = np.random.default_rng(17)
            parameters = np.concatenate([rng.normal(0, 0.1, n) if n > VOCABULARY else np.zeros(n) for n in sizes])
        self.all = parameters.astype(np.float32)
        parts = np.split(self.all, np.cumsum(sizes)[:-1])
        self.side, self.bias = parts[0].reshape(len(SIDES), VOCABULARY, HIDDEN), parts[1]
        self.group, self.group_bias = parts[2].reshape(HIDDEN, GROUPS), parts[3]
        self.word, self.word_bias = parts[4].reshape(GROUPS, HIDDEN, GROUPS), parts[5].reshape(GROUPS, GROUPS)

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = self.side[0].take(ids[at + SIDES[0]], axis=0)
        h += self.bias
        for k, d in enumerate(SIDES[1:], 1):
            h += self.side[k].take(ids[at + d], axis=0)
        return np.tanh(h, out=h)

    @staticmethod
    def _by_group(ids: np.ndarray, at: np.ndarray):
        """The positions in order of their outcomes' groups: (order, group, place in it, first of each group)."""
        group, place = np.divmod(ids[at], GROUPS)
        order = np.argsort(group.astype(np.uint8), kind="stable")  # small types are sorted by digits
        group = group[order]
        return order, group, place[order], np.searchsorted(group, np.arange(GROUPS + 1))

    def log_probability(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for s in range(0, len(at), 16_384):
            order, group, place, first = self._by_group(ids, at[s : s + 16_384])
            h = self.hidden(ids, at[s : s + 16_384][order])
            row = np.arange(len(order))
            logits = _logits(h, self.group, self.group_bias)
            found = logits[group, row]
            found -= _log_sum(logits)
            for g in range(GROUPS):
                a, b = first[g], first[g + 1]
                if a < b:
                    logits = _logits(h[a:b], self.word[g], self.word_bias[g])
                    found[a:b] += logits[place[a:b], row[: b - a]]
                    found[a:b] -= _log_sum(logits)
            out[s + order] = found
        return out

    def gradient(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        order, group, place, first = self._by_group(ids, at)
        at, n, row = at[order], len(at), np.arange(len(at))
        h = self.hidden(ids, at)
        out = WindowNet(np.zeros_like(self.all))
        p = _softmax(_logits(h, self.group, self.group_bias))
        p[group, row] -= 1
        out.group[:], out.group_bias[:] = (p @ h).T, p.sum(1)
        back = p.T @ self.group.T
        for g in range(GROUPS):
            a, b = first[g], first[g + 1]
            if a < b:
                p = _softmax(_logits(h[a:b], self.word[g], self.word_bias[g]))
                p[place[a:b], row[: b - a]] -= 1
                out.word[g], out.word_bias[g] = (p @ h[a:b]).T, p.sum(1)
                back[a:b] += p.T @ self.word[g].T
        back *= 1 - h * h
        out.bias[:] = back.sum(0)
        for k, d in enumerate(SIDES):
            near = ids[at + d]
            order = np.argsort(near.astype(np.uint16), kind="stable")
            near = near[order]
            first = np.flatnonzero(np.diff(near, prepend=-1))
            out.side[k][near[first]] = np.add.reduceat(back.take(order, axis=0), first, axis=0)
        out.all /= n
        return out.all


def share(ids: np.ndarray, owner: np.ndarray, turn: int, stride: int = STRIDE) -> np.ndarray:
    """The positions of round ``turn``: one of ``stride``, disjoint from those of the next ``stride`` - 1 rounds."""
    at = np.flatnonzero(owner >= 0)
    # by the words around and the place in the text, so that rounds split every text
    first = np.flatnonzero(np.diff(owner[at], prepend=-1))  # of each text
    key = mix64((ids[at] * 65537 + ids[at - 1] * 257 + ids[at + 1] + at - np.repeat(first, np.diff(first, append=len(at)))).astype(np.uint64))
    return at[key % np.uint64(stride) == turn % stride]


def spelling(words: list[bytes], n: np.ndarray) -> np.ndarray:
    """Byte pairs of words that occur ``n`` times each, read from the end (see ``Vocabulary``), then counts by ending class."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    after = np.append(flat[1:], 256)
    after[end - 1] = 256
    key = [after * 257 + flat, flat[end - size] * 257 + 256, 257 * 257 + np.fromiter(map(ending, words), np.int64, len(words))]
    return np.bincount(np.concatenate(key), np.concatenate([np.repeat(n, size), n, n]), 257 * 257 + ENDINGS).astype(np.int64)


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The most frequent words of all documents, ties by the word's bytes, and the
    counts behind p(word | class)."""

    def run(batches):
        def rows(counts):
            items = list(counts.items())
            for i in range(0, len(items), 50_000):
                own = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.binary()), pa.array([n for _, n in own], pa.int64())], names=["w", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for _, texts in slices(batch, text_col):
                for text in texts:
                    counts.update(words_of(text))
                if len(counts) > CACHE_WORDS:
                    yield from rows(counts)
                    counts.clear()
        yield from rows(counts)

    counted = stage(docs.select(text_col).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log("n") * _FINE)
    least, room = 0, LISTED
    for x, n in sorted(map(tuple, counted.groupBy(level.alias("x")).count().collect()), reverse=True):  # a few thousand classes of counts
        room -= n
        if room < 0:
            least = x + 1
            break
    listed = {bytes(w): n for w, n in counted.where(level >= least).collect()}  # LISTED rows at most
    head = sorted(listed, key=lambda w: (-listed[w], w))[:HEAD]

    def spell(batches):
        tally = np.zeros(257 * 257 + ENDINGS, np.int64)
        for batch in batches:
            if batch.num_rows:
                tally += spelling(batch.column(0).to_pylist(), np.asarray(batch.column(1)))
        k = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(tally[k])], names=["k", "n"])

    flat = np.zeros(257 * 257 + ENDINGS, np.int64)
    for k, n in counted.where(level < least).mapInArrow(spell, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        flat[k] = n
    drop_stage(counted)
    return Vocabulary(head, listed, flat[257 * 257 :], flat[: 257 * 257].reshape(257, 257))


def encoded(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``ids`` binary (the words' outcomes, two bytes each) and ``within`` double
    (the sum of log p(word | class)) of every text: training and scoring need no more of it."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        id_of, within = Ids(words).__getitem__, Within(words).__getitem__
        for batch in batches:
            ids, sums = [], []
            for _, texts in slices(batch, text_col):
                for text in texts:
                    cut = words_of(text)
                    ids.append(np.fromiter(map(id_of, cut), _ID, len(cut)).tobytes())
                    sums.append(sum(map(within, cut)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sums, pa.float64())], names=[id_col, "ids", "within"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, within double")


def laid_out(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``Ids.rows``, from the texts' encoded ids."""
    edge = max(map(abs, SIDES))
    n = np.fromiter(map(len, raw), np.int64, len(raw)) // _ID.itemsize
    own = np.repeat(np.arange(len(raw)), n)
    at = np.arange(len(own)) + edge * (own + 1)
    ids, owner = np.zeros(len(own) + edge * (len(raw) + 1), np.int64), np.full(len(own) + edge * (len(raw) + 1), -1)
    ids[at], owner[at] = np.frombuffer(b"".join(raw), _ID), own
    return ids, owner


def _runs(batch: pa.RecordBatch):
    """Runs of rows of encoded texts, of bounded size."""
    for _, raw in slices(batch, "ids", SLICE):
        yield [x or b"" for x in raw]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> tuple[Vocabulary, np.ndarray]:
    """(vocabulary, parameters) of a network fitted on all documents."""
    words = vocabulary(docs, text_col)
    table = stage(encoded(docs, words, id_col, text_col), "outcomes")
    parameters = _fitted(table, rounds, stride)
    drop_stage(table)
    return words, parameters


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` by a network fitted on the same documents; their words are looked up once for all rounds."""
    words = vocabulary(docs, text_col)
    table = stage(encoded(docs, words, id_col, text_col), "outcomes")
    return _scored(table, _fitted(table, ROUNDS, STRIDE), id_col)


def _fitted(table: DataFrame, rounds: int, stride: int) -> np.ndarray:
    """Parameters of a network fitted on all encoded texts."""
    parameters = WindowNet().all
    chunk = 8192

    for turn in range(rounds):

        def run(batches, start=parameters, turn=turn):
            net = WindowNet(start.copy())
            m, v, t, seen = np.zeros_like(net.all), np.zeros_like(net.all), 0, 0
            for batch in batches:
                for raw in _runs(batch):
                    ids, owner = laid_out(raw)
                    at = share(ids, owner, turn, stride)
                    for s in range(0, len(at), BATCH):
                        g = net.gradient(ids, at[s : s + BATCH])
                        t += 1
                        m *= 0.9
                        m += 0.1 * g
                        v *= 0.99
                        v += 0.01 * np.square(g, out=g)
                        np.sqrt(v, out=g)
                        g *= 1 / np.sqrt(1 - 0.99**t)
                        g += 1e-8
                        np.divide(m, g, out=g)
                        g *= 0.01 / (1 - 0.9**t)
                        net.all -= g
                        seen += len(at[s : s + BATCH])
            if seen:
                parts = np.append(net.all, np.zeros(-len(net.all) % chunk, np.float32)).reshape(-1, chunk)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([seen] * len(parts), pa.int64())], names=["k", "x", "n"])

        def average(batches):
            total: dict[int, np.ndarray] = {}
            count: Counter = Counter()
            for batch in batches:
                for k, x, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    part = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) * n
                    total[k] = total[k] + part if k in total else part
                    count[k] += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(total[k] / count[k]).tobytes() for k in total], pa.binary())], names=["k", "x"])

        local = table.select("ids").mapInArrow(run, "k int, x binary, n long")
        merged = parameters.copy()
        for k, x in local.repartition("k").mapInArrow(average, "k int, x binary").collect():
            part = np.frombuffer(x, np.float64)
            stop = min(len(merged), (k + 1) * chunk)
            merged[k * chunk : stop] = part[: stop - k * chunk]
        parameters = merged
    return parameters


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pseudo-log-likelihood of every text.

    Result, one row per input row: the id column, ``n_tokens`` long, ``score``
    double (the sum of conditional log-probabilities, in nats; 0 for a null
    text or one without words) and ``per_token`` double (null without words).
    """
    words, parameters = model
    return _scored(encoded(docs, words, id_col, text_col), parameters, id_col)


def _scored(table: DataFrame, parameters: np.ndarray, id_col: str) -> DataFrame:
    kind = table.schema[0].dataType.simpleString()

    def run(batches):
        net = WindowNet(parameters)
        for batch in batches:
            count, total = [], []
            for raw in _runs(batch):
                ids, owner = laid_out(raw)
                at = np.flatnonzero(owner >= 0)
                own = owner[at]
                count.append(np.bincount(own, minlength=len(raw)))
                total.append(np.bincount(own, net.log_probability(ids, at), len(raw)))
            n = np.concatenate(count) if count else np.zeros(0, np.int64)
            s = (np.concatenate(total) if total else np.zeros(0)) + np.asarray(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(s), pa.array(s / np.maximum(n, 1), mask=n == 0)], names=[id_col, "n_tokens", "score", "per_token"])

    return table.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, score double, per_token double")
