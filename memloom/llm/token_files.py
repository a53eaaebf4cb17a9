"""Token-ID / binary output (operator 6): flat integer files with 64-bit offsets.

Format, in one folder of the shared storage:

* ``NNNNN.ids``: the token ids of a run of documents, flat, little-endian,
  unsigned, 2 bytes each if the vocabulary fits, else 4;
* ``NNNNN.idx``: n + 1 unsigned 64-bit offsets in tokens from the file's start,
  then n signed 64-bit document ids.

The files together hold all documents in ascending id order. A file's base,
the number of tokens before it, is the prefix sum of the files' totals, so a
document's global start is base + offset. Files are written under a name of
the attempt and then renamed, so a repeated task leaves whole files only.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Words whose ids a worker keeps; when more are known, it starts again.
CACHE_WORDS = 600_000
# The vocabulary file cuts texts by 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+ (a fixed
# value). The forms below match the same where none of the odd characters occurs: those on whose
# case or class the libraries differ, and numbers that are no digits. Texts with them go to the
# tokenizer whole, as do texts that seem to name a special token.
_CUT_ASCII = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+").findall
_CUT = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+").findall
_ODD_ASCII = re.compile(r"[\x1c-\x1f]|<\|").search
_ODD = regex.compile(r"[\x1c-\x1f\x85İΣ\u180e\p{No}\p{Nl}]|<\|").search


class WordEncoder:
    """Ids of whole texts from a tokenizer file that treats each pre-token alone.

    Texts are normalised and cut here, each different pre-token is encoded once
    by the tokenizers library, and a text's ids are its pre-tokens' ids in a row.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        # for pre-tokens, which are normalised and cut already; a text that may hold a special token never comes here
        self.merger = tokenizers.Tokenizer.from_file(path)
        self.merger.encode_special_tokens = True
        self.merger.normalizer = None
        self.merger.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def _learn(self, words: list[str]) -> None:
        for s in range(0, len(words), 1000):
            part = words[s : s + 1000]
            found = self.merger.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(found.ids, self.dtype), np.array(found.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(len(part)), side="right")
            raw, width, start = ids.tobytes(), ids.itemsize, 0
            for word, end in zip(part, (ends * width).tolist(), strict=True):
                self.words[word] = raw[start:end]
                start = end

    @staticmethod
    def _cut(text: str) -> list[str] | None:
        """Pre-tokens of a text; None if the tokenizer had better see it whole."""
        if text.isascii():
            return None if _ODD_ASCII(text) else _CUT_ASCII(text.lower())
        return None if _ODD(text) else _CUT(unicodedata.normalize("NFC", text).lower())

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        new: set[str] = set().union(*(c for c in cut if c))
        new.difference_update(self.words)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = set().union(*(c for c in cut if c))
        self._learn(list(new))
        get = self.words.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _files(uri: str):
    """The file system and path of a shared folder given as URI or local path."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", docs_per_file: int = 20_000) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files.

    Returns the manifest, one row per file: ``file`` int, ``n_docs``, ``n_tokens``
    and ``base`` long. A null text counts as empty; rows with a null id are not
    written; rows of equal id stand next to each other, in the order of their
    ids' bytes. The id column must be an integer. Documents are dealt to files
    by id ranges, whose bounds come from quantiles of the id column alone.
    """
    spark = docs.sparkSession
    dtype = encoder(tokenizer_path).dtype
    ids = docs.select(F.col(id_col).cast("long").alias("d")).where("d is not null")
    n = ids.count()
    n_files = max(1, -(-n // docs_per_file))
    bounds = sorted(set(ids.approxQuantile("d", [i / n_files for i in range(1, n_files)], 0.25 / n_files))) if n_files > 1 else []
    edges = np.array(bounds, np.float64)

    def encode(batches):
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            out = [raw + end for _, texts in slices(batch, "t") for raw in enc.encode_many(texts)]
            file = np.searchsorted(edges, np.asarray(batch.column(0)), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(file), batch.column(0), pa.array(out, pa.binary())], names=["file", "d", "ids"])

    def put(batches):
        fs, top = _files(folder)
        attempt = uuid.uuid4().hex
        state: dict = {"file": None}

        def close():
            if state["file"] is None:
                return None
            state["out"].close()
            sizes = np.array(state["sizes"], np.uint64)
            starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)])
            name = f"{top}/{state['file']:05d}"
            with fs.open_output_stream(f"{name}.idx.{attempt}") as f:
                f.write(starts.astype("<u8").tobytes() + np.array(state["docs"], "<i8").tobytes())
            for end in ("ids", "idx"):
                fs.move(f"{name}.{end}.{attempt}", f"{name}.{end}")
            return state["file"], len(sizes), int(starts[-1])

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array([done[0]], pa.int32()), pa.array([done[1]], pa.int64()), pa.array([done[2]], pa.int64())], names=["file", "n_docs", "n_tokens"])

        width = np.dtype(dtype).itemsize
        for batch in batches:
            for file, d, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                file = file.as_py()
                if file != state["file"]:
                    if done := close():
                        yield rows(done)
                    fs.create_dir(top, recursive=True)
                    state = {"file": file, "out": fs.open_output_stream(f"{top}/{file:05d}.ids.{attempt}"), "sizes": [], "docs": []}
                raw = raw.as_buffer()
                state["out"].write(raw)
                state["sizes"].append(len(raw) // width)
                state["docs"].append(d.as_py())
        if done := close():
            yield rows(done)

    encoded = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).where("d is not null").mapInArrow(encode, "file int, d long, ids binary")
    dealt = encoded.repartition(len(bounds) + 1, "file").sortWithinPartitions("file", "d", "ids")
    manifest = dealt.mapInArrow(put, "file int, n_docs long, n_tokens long")
    path = stage_path(spark, "manifest")
    manifest.write.parquet(path)
    # a row for each file of docs_per_file documents: the running sum sees these alone, in one task
    return spark.read.schema(manifest.schema).parquet(path).withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


class TokenFile:
    """A pair of files, memory-mapped where the storage is a mounted folder."""

    def __init__(self, folder: str, file: int, dtype: str):
        fs, top = _files(folder)
        name = f"{top}/{file:05d}"
        if isinstance(fs, pafs.LocalFileSystem):
            index = np.memmap(f"{name}.idx", "<u8", "r")
            empty = os.path.getsize(f"{name}.ids") == 0
            self.ids = np.zeros(0, dtype) if empty else np.memmap(f"{name}.ids", dtype, "r")
        else:
            index = np.frombuffer(fs.open_input_file(f"{name}.idx").readall(), "<u8")
            self.ids = np.frombuffer(fs.open_input_file(f"{name}.ids").readall(), dtype)
        n = (len(index) - 1) // 2
        self.starts, self.docs = index[: n + 1], index[n + 1 :].view("<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[int(self.starts[k]) : int(self.starts[k + 1])]


def read(manifest: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """Documents from the files: ``doc_id``, ``start``, ``n_tokens`` long and
    ``ids`` binary (little-endian unsigned 32-bit). Files are dealt to as many
    tasks as there are files; within a file documents are in its order."""
    n_files = manifest.count()

    def get(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TokenFile(folder, file, dtype)
                for s in range(0, len(tokens), 256):
                    own = range(s, min(s + 256, len(tokens)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(tokens.docs[s : s + 256])),
                        pa.array([base + int(tokens.starts[k]) for k in own], pa.int64()),
                        pa.array([len(tokens[k]) for k in own], pa.int64()),
                        pa.array([tokens[k].astype("<u4").tobytes() for k in own], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])

    # a number that is given is kept: adaptive execution would put so small a table into one task
    return manifest.select("file", "base").repartition(max(1, n_files), "file").mapInArrow(get, "doc_id long, start long, n_tokens long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """The documents of ``read`` with ``ids_crc32`` in place of the ids."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
