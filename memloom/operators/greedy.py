"""Operators whose order of steps is their meaning: one user's rows at a time, in
Arrow batches. A user's rows are few; users are spread over the cluster."""

from __future__ import annotations

import difflib
import gzip

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchored_windows(mem: DataFrame, hours: float = 4.0) -> DataFrame:
    """WIN4: a memory joins the open window if within ``hours`` of its start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "id"])
        start, window, out = None, -1, []
        for us in pdf.us:
            if start is None or us - start > hours * 3.6e9:
                start, window = us, window + 1
            out.append(window)
        return pd.DataFrame({"user_id": pdf.user_id, "id": pdf.id, "win": out})

    return mem.select("user_id", "id", "us").groupBy("user_id").applyInPandas(run, "user_id long, id long, win long")


def interval_patterns(mem: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """WIN6, TMP4: gaps between memories fall into the first group within the
    tolerance of its first member."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gaps = np.diff(pdf.sort_values(["us", "id"]).us.to_numpy()) / 3.6e9
        groups: list[list[float]] = []
        for g in gaps:
            for own in groups:
                if abs(g - own[0]) <= tolerance * own[0]:
                    own.append(g)
                    break
            else:
                groups.append([g])
        kept = [(k, len(x), round(float(np.mean(x)), 6)) for k, x in enumerate(groups) if len(x) >= 3]
        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]] * len(kept), "grp": [k[0] for k in kept], "n": [k[1] for k in kept], "hours": [k[2] for k in kept]})

    return mem.select("user_id", "id", "us").groupBy("user_id").applyInPandas(run, "user_id long, grp long, n long, hours double")


def budget(mem: DataFrame, tokens: int = 60) -> DataFrame:
    """WIN15, RET14: by descending score, take what fits; what does not is skipped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score=pdf.importance * pdf.confidence).sort_values(["score", "id"], ascending=[False, True])
        left, keep = tokens, []
        for n in pdf.text.str.len() // 4 + 1:
            keep.append(n <= left)
            left -= n if n <= left else 0
        return pdf.loc[keep, ["user_id", "id"]]

    return mem.select("user_id", "id", "importance", "confidence", "text").groupBy("user_id").applyInPandas(run, "user_id long, id long")


def _units(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors at length 1, without a copy per row."""
    rows = rows.sort_by("id").combine_chunks()
    v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return rows["id"].to_numpy(), v


def _best(v: np.ndarray, of: np.ndarray, among: np.ndarray, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For each row ``of``, its most similar other row ``among`` (ascending; the first of equals) and the similarity.
    Products are made ``cells`` numbers at a time, so memory does not follow their square."""
    best, top = np.full(len(of), -1), np.full(len(of), -np.inf)
    step, others = max(1, cells // max(1, len(among))), v[among]
    for at in range(0, len(of), step):
        own = of[at : at + step]
        s = np.round(v[own] @ others.T, 12)
        place = np.minimum(np.searchsorted(among, own), len(among) - 1)
        mine = np.flatnonzero(among[place] == own)
        s[mine, place[mine]] = -np.inf
        to = s.argmax(axis=1)
        best[at : at + step], top[at : at + step] = among[to], s[np.arange(len(own)), to]
    return best, top


def _mutual(best: np.ndarray, top: np.ndarray, alive: np.ndarray, least: float) -> np.ndarray:
    """Pairs (i < j) that are each other's best and similar enough; at least the best of all, if that is."""
    i = alive[(top[alive] >= least)]
    if not len(i):
        return np.zeros((0, 2), int)
    i = i[(best[best[i]] == i) & (i < best[i])]
    first = alive[top[alive].argmax()]
    pair = sorted((int(first), int(best[first])))
    taken = np.isin(i, pair) | np.isin(best[i], pair)
    return np.vstack([np.column_stack([i[~taken], best[i[~taken]]]), [pair]])


def star_clusters(vec: DataFrame, least: float = 0.3) -> DataFrame:
    """SIM6: a seed absorbs the later rows that are similar to it; not transitive.

    Rows of a label come in order of id, a batch at a time; only the seeds are kept."""

    def run(batches):
        held, ids, seeds = None, [], np.zeros((0, 0))
        for batch in batches:
            labels, own = batch.column("label").to_pylist(), batch.column("id").to_numpy()
            vectors, out = batch.column("v").to_pylist(), []
            at = 0
            while at < len(own):
                end = next((k for k in range(at, min(at + 512, len(own))) if (labels[k], len(vectors[k])) != (labels[at], len(vectors[at]))), min(at + 512, len(own)))
                if (labels[at], len(vectors[at])) != held:
                    held, ids, seeds = (labels[at], len(vectors[at])), [], np.zeros((0, len(vectors[at])))
                v = np.array(vectors[at:end], dtype=np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                near = v @ seeds.T >= least
                seed = np.where(near.any(axis=1), near.argmax(axis=1), -1) if len(ids) else np.full(len(v), -1)
                within, old = v @ v.T >= least, len(ids)
                for i in np.flatnonzero(seed < 0):
                    if seed[i] < 0:
                        free = (seed < 0) & within[i]
                        free[:i] = False
                        free[i] = True
                        seed[free] = len(ids)
                        ids.append(own[at + i])
                if len(ids) > old:
                    fresh = np.array([np.flatnonzero(seed == k)[0] for k in range(old, len(ids))])
                    seeds = np.vstack([seeds, v[fresh]])
                out.extend(ids[k] for k in seed)
                at = end
            yield pa.record_batch([pa.array(labels, pa.int32()), pa.array(own), pa.array(out, pa.int64())], ["label", "id", "seed"])

    dealt = vec.select("label", "id", "v").repartition("label").sortWithinPartitions("label", F.size("v"), "id")
    return dealt.mapInArrow(run, "label int, id long, seed long")


def agglomerative(vec: DataFrame, least: float = 0.1) -> DataFrame:
    """SIM11: average linkage, until no two clusters are similar enough.

    The mean similarity of two clusters is the product of their mean vectors. A merged cluster is no
    closer to another than the closer of its parts was, so all pairs that are each other's best are merged
    at once, and only rows whose best is gone look again."""

    def run(rows: pa.Table) -> pa.Table:
        ids, v = _units(rows)
        size, owner, alive = np.ones(len(ids)), np.arange(len(ids)), np.arange(len(ids))
        best, top = _best(v, alive, alive)
        while len(alive) > 1 and len(pairs := _mutual(best, top, alive, least)):
            i, j = pairs.T
            v[i] = (size[i, None] * v[i] + size[j, None] * v[j]) / (size[i] + size[j])[:, None]
            size[i] += size[j]
            owner[j] = i
            alive = np.setdiff1d(alive, j)
            stale = alive[np.isin(alive, i) | np.isin(best[alive], pairs)]
            if len(alive) > 1:
                best[stale], top[stale] = _best(v, stale, alive)
        while (owner[owner] != owner).any():
            owner = owner[owner]
        return pa.table([pa.array([rows["label"][0].as_py()] * len(ids), pa.int32()), pa.array(ids), pa.array(ids[owner])], ["label", "id", "cluster"])

    return vec.select("label", "id", "v").groupBy("label").applyInArrow(run, "label int, id long, cluster long")


def disjoint_merges(vec: DataFrame, least: float = 0.25) -> DataFrame:
    """SIM14: the most similar pair first, each row in one pair at most.

    Pairs that are each other's best among the free rows are what that order takes; only rows whose best was
    taken look again."""

    def run(rows: pa.Table) -> pa.Table:
        ids, v = _units(rows)
        alive, out = np.arange(len(ids)), []
        best, top = _best(v, alive, alive)
        while len(alive) > 1 and len(pairs := _mutual(best, top, alive, least)):
            out.append((ids[pairs[:, 0]], ids[pairs[:, 1]], top[pairs].max(axis=1)))
            alive = np.setdiff1d(alive, pairs)
            # a row without a partner now has none later
            alive = alive[top[alive] >= least]
            stale = alive[np.isin(best[alive], pairs)]
            if len(alive) > 1:
                best[stale], top[stale] = _best(v, stale, alive)
        a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (ids[:0], ids[:0], np.zeros(0))
        return pa.table([pa.array([rows["label"][0].as_py()] * len(a), pa.int32()), pa.array(a), pa.array(b), pa.array(np.round(s + 0.05, 6))], ["label", "a", "b", "confidence"])

    return vec.select("label", "id", "v").groupBy("label").applyInArrow(run, "label int, a long, b long, confidence double")


def reconcile(mem: DataFrame) -> DataFrame:
    """SIM17: by confidence, a memory goes if one kept before it contradicts it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "us", "id"], ascending=[False, False, True])
        kept, out = set(), []
        for id_, a, b in zip(pdf.id, pdf.tag1, pdf.tag2, strict=True):
            other = {"purchase": "error", "error": "purchase"}.get(a)
            if other and (other, b) in kept:
                continue
            kept.add((a, b))
            out.append(id_)
        return pd.DataFrame({"user_id": pdf.user_id.iloc[0], "id": out})

    return mem.select("user_id", "id", "us", "tag1", "tag2", "confidence").groupBy("user_id").applyInPandas(run, "user_id long, id long")


def sequence_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """STR8: Ratcliff/Obershelp similarity of two text columns."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(difflib.SequenceMatcher(None, p or "", q or "").ratio(), 6) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("ratio", ratio(a, b))


def compressed(mem: DataFrame) -> DataFrame:
    """LIF4: gzip of each text and whether it comes back whole."""

    @F.pandas_udf("string")
    def state(x: pd.Series) -> pd.Series:
        return pd.Series(["ok" if gzip.decompress(gzip.compress((t or "").encode(), mtime=0)) == (t or "").encode() else "broken" for t in x])

    return mem.select("id", state("text").alias("state"))


def assembled_context(mem: DataFrame, tokens: int = 80, least: float = 0.5, similar: float = 0.9) -> DataFrame:
    """RET14: drop low relevance, then near duplicates of what is kept, then what
    the token budget has no room for; every dropped row has its reason."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(score=0.8 * pdf.confidence * pdf.importance / 10 + 0.2 / (1 + pdf.age / 30)).sort_values(["score", "id"], ascending=[False, True])
        left, kept, out = tokens, [], []
        for id_, score, text in zip(pdf.id, pdf.score, pdf.text, strict=True):
            words = set(text.lower().split())
            if score < least:
                out.append((id_, "low_relevance"))
            elif any(min(len(text), len(t)) >= 0.5 * max(len(text), len(t)) and len(words & w) >= similar * len(words | w) for t, w in kept):
                out.append((id_, "duplicate"))
            elif len(text) // 4 + 1 > left:
                out.append((id_, "budget"))
            else:
                left -= len(text) // 4 + 1
                kept.append((text, words))
                out.append((id_, "kept"))
        return pd.DataFrame({"user_id": pdf.user_id.iloc[0], "id": [x[0] for x in out], "state": [x[1] for x in out]})

    return mem.select("user_id", "id", "importance", "confidence", "age", "text").groupBy("user_id").applyInPandas(run, "user_id long, id long, state string")


def migrated(vec: DataFrame) -> DataFrame:
    """MIG1: every vector re-encoded, here to unit length, batch by batch."""

    def run(batches):
        for pdf in batches:
            v = np.stack(pdf.v.to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
            norm = np.sqrt((v * v).sum(1))
            yield pd.DataFrame({"id": pdf.id, "norm": np.round(norm, 6), "first": np.round(v[:, 0] / np.maximum(norm, 1e-12), 6)})

    return vec.select("id", "v").mapInPandas(run, "id long, norm double, first double")


def pruned_text(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """CMP4: the share of a text's words that scores best, in the order of the text."""

    def score(w: str) -> float:
        return len(w) + 3 * w[:1].isupper() + 4 * any(c.isdigit() for c in w)

    @F.pandas_udf("string")
    def prune(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = (t or "").split()
            keep = sorted(sorted(range(len(words)), key=lambda k: (-score(words[k]), k))[: int(len(words) * share)])
            out.append(" ".join(words[k] for k in keep))
        return pd.Series(out)

    return docs.select("id", prune("text").alias("text"))
