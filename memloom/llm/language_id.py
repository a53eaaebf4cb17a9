"""Language identification (operator 8): segmentation-marginalised unigrams.

Each language is a unigram model over the pieces of a fixed public vocabulary.
The probability of a word is the sum, over all its segmentations into pieces,
of the product of the piece probabilities; a forward pass over character
positions computes it. A text scores the sum of its words' log-probabilities.
The piece probabilities are fitted by expectation-maximisation on labelled
text: the expected use of each piece comes from the same forward pass and its
backward twin.

Words are runs of letters, lower-cased, with the vocabulary's word-start mark
in front. Words of equal length are worked on side by side; those of over
``LONG`` characters one by one, with the pass rescaled on its way, so that
neither memory nor the range of numbers bounds a word's length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, mix64, slices, smallest

MARK = "▁"
#: Beyond so many characters a word's probability could leave the range of doubles.
LONG = 32
#: Words whose scores a worker keeps; when more are known, it starts again.
CACHE_WORDS = 250_000
#: Characters of words that are worked on at once.
_CELLS = 100_000
_WORDS = regex.compile(r"\p{L}+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """All pieces of the vocabulary that stand for text, by hash."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [t for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i) and (t := model.id_to_piece(i))]
        self.longest = max(map(len, self.texts))
        keys = np.zeros(len(self.texts), np.uint64)
        for n in range(1, self.longest + 1):
            own = [i for i, t in enumerate(self.texts) if len(t) == n]
            if own:
                keys[own] = _hashes(_codes([self.texts[i] for i in own], n), 0, n)
        self.index = HashIndex(keys, np.arange(len(keys)))

    def __len__(self) -> int:
        return len(self.texts)

    def table(self, words: list[str], n: int) -> list[list[np.ndarray]]:
        """[end][length - 1]: id of the piece of that length that ends there (-1: none)."""
        codes = _codes(words, n)
        out: list[list[np.ndarray]] = [[]]
        for end in range(1, n + 1):
            out.append([self.index.get(_hashes(codes, end - k, end)) for k in range(1, min(self.longest, end) + 1)])
        return out

    def along(self, word: str) -> np.ndarray:
        """(end, length - 1) of one word: id of the piece of that length that ends there (-1: none)."""
        n = len(word)
        out = np.full((n + 1, self.longest), -1, np.int32)
        codes = _codes([word], n)[0]
        for k in range(1, min(self.longest, n) + 1):
            out[k:, k - 1] = self.index.get(_hashes(np.lib.stride_tricks.sliding_window_view(codes, k), 0, k))
        return out


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)


def _hashes(codes: np.ndarray, start: int, end: int) -> np.ndarray:
    h = np.full(len(codes), end - start, np.uint64)
    for c in range(start, end):
        h = h * _BASE + codes[:, c] + np.uint64(1)
    return mix64(h)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def words_of(text: str) -> list[str]:
    """Lower-cased letter runs with the word-start mark."""
    return [MARK + w for w in _WORDS(text.lower())]


class Model:
    """Languages and their piece probabilities (pieces x languages).

    A character that no piece covers counts as a piece of the floor probability.
    """

    def __init__(self, path: str, languages: list[str], prob: np.ndarray, floor: float):
        self.path, self.languages, self.prob, self.floor = path, languages, prob, floor
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def __getstate__(self):
        return {"path": self.path, "languages": self.languages, "prob": self.prob, "floor": self.floor}

    def __setstate__(self, state):
        self.__init__(**state)

    def _grid(self, words: list[str], n: int):
        """Piece ids and, row for row, probabilities; a lone character always has one."""
        ids = pieces_of(self.path).table(words, n)
        padded = np.vstack([self.prob, np.zeros((1, len(self.languages)))])
        probs = [[padded[i] for i in row] for row in ids]
        for row in probs[1:]:
            row[0] = np.maximum(row[0], self.floor)
        return ids, probs

    def forward(self, words: list[str], n: int):
        ids, probs = self._grid(words, n)
        alpha = [np.ones((len(words), len(self.languages)))]
        for end in range(1, n + 1):
            a = alpha[end - 1] * probs[end][0]
            for k in range(2, len(probs[end]) + 1):
                a += alpha[end - k] * probs[end][k - 1]
            alpha.append(a)
        return ids, probs, alpha

    def expected(self, words: list[str], n: int, counts: np.ndarray, into: np.ndarray) -> None:
        """Add each piece's expected number of uses; counts: words x languages."""
        ids, probs, alpha = self.forward(words, n)
        beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [np.ones_like(alpha[0])]
        for end in range(n, 0, -1):
            for k in range(1, len(probs[end]) + 1):
                beta[end - k] += probs[end][k - 1] * beta[end]
        scale = counts / alpha[n]
        for end in range(1, n + 1):
            for k, i in enumerate(ids[end], 1):
                hit = np.flatnonzero(i >= 0)
                use = alpha[end - k][hit] * probs[end][k - 1][hit] * beta[end][hit] * scale[hit]
                for c in range(use.shape[1]):
                    into[:, c] += np.bincount(i[hit], use[:, c], len(into))

    def _forward_long(self, word: str):
        """Of one word of any length: piece ids, forward values each divided by all
        scales up to it, and the scales."""
        ids, padded = pieces_of(self.path).along(word), np.vstack([self.prob, np.zeros((1, len(self.languages)))])
        n, most = len(word), ids.shape[1]
        alpha, scale = np.zeros((n + 1 + most, len(self.languages))), np.ones((n + 1, len(self.languages)))
        alpha[most] = 1  # in front stand zeros, for pieces that would begin before the word
        for end in range(1, n + 1):
            p = padded[ids[end]]
            p[0] = np.maximum(p[0], self.floor)
            before = alpha[end + most - 1 : end - 1 : -1]
            a = (p * before).sum(0)
            # each value is relative to the one before: earlier ones are rescaled as the window moves on
            scale[end] = a
            alpha[end : end + most] /= a
            alpha[end + most] = 1
        return ids, scale

    def _expected_long(self, word: str, counts: np.ndarray, into: np.ndarray) -> None:
        ids, scale = self._forward_long(word)
        padded = np.vstack([self.prob, np.zeros((1, len(self.languages)))])
        n, most = len(word), ids.shape[1]
        logs = np.cumsum(np.log(scale), axis=0)
        beta = np.zeros((n + 1, len(self.languages)))  # times the forward value at the same place, over the word's probability
        beta[n] = 1
        for end in range(n, 0, -1):
            k = min(most, end)
            p = padded[ids[end, :k]]
            p[0] = np.maximum(p[0], self.floor)
            use = np.exp(logs[end - k : end][::-1] - logs[end]) * p * beta[end]
            beta[end - k : end] += use[::-1]
            hit = np.flatnonzero(ids[end, :k] >= 0)
            np.add.at(into, ids[end, hit], use[hit] * counts)

    def learn(self, words: list[str]) -> None:
        """Score words that are not known yet."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        found = []
        for n, own in by_length.items():
            step = max(256, _CELLS // n) if n <= LONG else 1
            for s in range(0, len(own), step):
                part = own[s : s + step]
                found.append(np.log(self.forward(part, n)[2][n]) if n <= LONG else np.log(self._forward_long(part[0])[1]).sum(0)[None])
                at = len(self.known)
                self.known.update(zip(part, range(at, at + len(part))))
        if found:
            self.rows = np.vstack([self.rows, *found])

    def score_many(self, texts: list[str]) -> list[np.ndarray | None]:
        """Log-probability of each text in each language; None without a letter."""
        cut = [words_of(t) for t in texts]
        new: set[str] = set()
        for words in cut:
            new.update(words)
        new.difference_update(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.rows = self.rows[:0]
            new = set().union(*cut)
        self.learn(sorted(new))
        get = self.known.__getitem__
        return [self.rows[np.fromiter(map(get, words), np.int64, len(words))].sum(0) if words else None for words in cut]


def train(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 400, rounds: int = 4, smoothing: float = 0.1) -> Model:
    """Fit a model on labelled rows.

    A bounded sample is used: for each language the ``per_language`` rows of the
    smallest hash of id and text. Rows of null language are skipped; the number
    of languages is taken to be small. Word counts of the sample are gathered
    by Spark, EM runs in numpy on the driver. Without any labelled row the
    model has no language and every text is undetermined.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.xxhash64(F.col(id_col), F.length(text_col))
    ranked = rows.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), order.alias("h"), F.col(id_col).alias("i"))
    ids = smallest(ranked.select("l", "h", "i").distinct(), "l", ["h", "i"], per_language)

    def words(batches):
        for batch in batches:
            for i, texts in slices(batch, "t"):
                for k, text in enumerate(texts):
                    own = words_of(text)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i + k].as_py()] * len(own), pa.string()), pa.array(own, pa.string())], names=["l", "w"])

    # ids holds at most per_language rows for each language: a proven bound
    sample = ranked.join(F.broadcast(ids), ["l", "h", "i"], "left_semi")
    counted = sample.select("l", "t").mapInArrow(words, "l string, w string").groupBy("l", "w").count().collect()
    languages = sorted({r[0] for r in counted})
    vocabulary: dict[str, np.ndarray] = {}
    for lang, word, n in counted:
        vocabulary.setdefault(word, np.zeros(len(languages)))[languages.index(lang)] = n
    size = len(pieces_of(path))
    model = Model(path, languages, np.full((size, len(languages)), 1.0 / size), 1e-7)
    groups: dict[int, list[str]] = {}
    for w in sorted(vocabulary):
        groups.setdefault(len(w), []).append(w)
    for _ in range(rounds if languages else 0):
        use = np.zeros_like(model.prob)
        for n, own in groups.items():
            step = max(256, _CELLS // n) if n <= LONG else 1
            for s in range(0, len(own), step):
                part = own[s : s + step]
                if n > LONG:
                    model._expected_long(part[0], vocabulary[part[0]], use)
                else:
                    model.expected(part, n, np.array([vocabulary[w] for w in part]), use)
        use += smoothing
        model.prob = use / use.sum(0)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every text.

    Result, one row per input row: the id column, ``lang_pred`` string and
    ``score`` double, the posterior probability of the prediction under equal
    priors. A null text, a text without a letter, or a model without languages
    gives ``und`` and 0. Ties go to the smaller language code.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for _, texts in slices(batch, text_col):
                for x in model.score_many(texts) if model.languages else [None] * len(texts):
                    if x is None:
                        langs.append("und")
                        scores.append(0.0)
                    else:
                        best = int(x.argmax())
                        langs.append(model.languages[best])
                        scores.append(float(1 / np.exp(np.minimum(x - x[best], 0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language of posterior
    ``least`` or more; without any learned language, those with a letter."""

    def run(batches):
        for batch in batches:
            keep = []
            for _, texts in slices(batch, text_col):
                for t, x in zip(texts, model.score_many(texts) if model.languages else [None] * len(texts), strict=True):
                    keep.append(bool(_WORDS(t)) if x is None else float(1 / np.exp(np.minimum(x - x.max(), 0)).sum()) >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
