"""Byte-level BPE encoding and decoding (operator 2).

A text is cut by the public split pattern; each piece is merged by rank with a
segment tree over its byte positions. Leaf ``i`` holds the rank of the pair
that starts at live token ``i`` (or infinity) together with ``i``, an inner
node the minimum of its children, so the root is the leftmost pair of minimum
rank. A merge changes the pairs of the merged token and of its live neighbours
only: three point updates of logarithmic cost. The trees of many different
pieces of similar length are rows of one array and are merged side by side.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import HashIndex, slices

#: Pieces whose ids a worker keeps; when more are known, it starts again.
CACHE_PIECES = 350_000
_NONE = np.iinfo(np.int64).max


class ByteBpe:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # Rust's \s is the White_Space property; this module's also takes four control characters
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")).findall
        # the same for texts of ASCII only, where the quicker standard module does
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII).findall
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(i)
        self.pairs = HashIndex(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(rank))
        self.known: dict[str, bytes] = {}

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values: (rank, position) in one integer; infinity where no merge exists."""
        rank = self.pairs.get(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).astype(np.int64)
        return np.where((rank >= 0) & (right >= 0), rank << 32 | at, _NONE)

    def _merge(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Ids of pieces of 2 to ``size`` (a power of two) bytes."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        token = np.full((n, size + 1), -1, np.int64)  # the last column stands for "no token"
        token[row, col] = self.byte_ids[flat]
        after = np.minimum(np.arange(1, size + 2), length[:, None])
        after[after == length[:, None]] = size
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        before[:, 0] = size
        tree = np.full((n, 2 * size), _NONE)
        inner = col < length[row] - 1
        r, c = row[inner], col[inner]
        tree[r, size + c] = self._leaf(token[r, c], token[r, c + 1], c)
        level = size
        while level > 1:
            half = tree[:, level : 2 * level]
            tree[:, level // 2 : level] = np.minimum(half[:, ::2], half[:, 1::2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            i = root & 0xFFFFFFFF
            j = after[live, i]
            k = after[live, j]
            token[live, i] = root >> 32
            token[live, j] = -1
            after[live, i] = k
            before[live, k] = np.where(k < size, i, size)
            p = before[live, i]
            mine = self._leaf(token[live, i], np.where(k < size, token[live, k], -1), i)
            theirs = np.where(p < size, self._leaf(token[live, p], token[live, i], p), _NONE)
            self._update(tree, live, size + j, np.full(len(live), _NONE))
            self._update(tree, live, size + i, mine)
            held = p < size
            self._update(tree, live[held], size + p[held], theirs[held])
            live = live[tree[live, 1] < _NONE]
        out = token[:, :size]
        kept = out >= 0
        return np.split(out[kept].astype("<u4"), np.cumsum(kept.sum(1))[:-1])

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        tree[rows, at] = value
        size = tree.shape[1] // 2
        while size > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            size >>= 1

    def _learn(self, pieces: list[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            else:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, group in groups.items():
            step = max(1, 400_000 // size)
            for s in range(0, len(group), step):
                part = group[s : s + step]
                for (piece, _), ids in zip(part, self._merge([raw for _, raw in part], size), strict=True):
                    self.known[piece] = ids.tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [(self.split_ascii if t.isascii() else self.split)(t) for t in texts]
        new: set[str] = set().union(*cut)
        new.difference_update(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = set().union(*cut)
        self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every text.

    Result, one row per input row: the id column, ``n_tokens`` long, ``ids``
    binary (little-endian unsigned 32-bit; null unless ``keep_ids``),
    ``ids_sha256`` and ``decoded_sha256`` string, ``round_trip`` boolean (the
    decoded bytes are the text's). A null or empty text has no tokens. The rank
    file must be readable on every executor.
    """
    kind = docs.select(id_col).schema[0]
    schema = f"`{id_col}` {kind.dataType.simpleString()}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            n_tokens, ids, a, b, same = [], [], [], [], []
            for _, texts in slices(batch, text_col):
                for text, raw in zip(texts, bpe.encode_many(texts), strict=True):
                    back = bpe.decode(np.frombuffer(raw, "<u4").tolist())
                    n_tokens.append(len(raw) // 4)
                    ids.append(raw if keep_ids else None)
                    a.append(hashlib.sha256(raw).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
