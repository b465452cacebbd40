"""Semantic and hybrid chunking: greedy merging of similar segments or chunks, document by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folium.functions.vectors import Embedder, hashing_embedder

COLUMNS = ["doc_id", "chunk_no", "chunk_id", "text", "length", "semantic", "hybrid"]
CHUNKS = "chunk_no int, chunk_id string, text string, length int, semantic boolean, hybrid boolean"


def _schema(rows: DataFrame) -> str:
    return f"doc_id {dict(rows.dtypes)['doc_id']}, {CHUNKS}"


class _Cosines:
    """Rows of the cosines of all pairs, each computed when it is asked for: memory follows the texts, not their pairs."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit

    def __getitem__(self, i: int) -> np.ndarray:
        return self.unit @ self.unit[i]


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    m = np.asarray(vectors, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def merge_segments(types: list[str], texts: list[str], cos: np.ndarray | _Cosines, threshold: float, cap: float, header_cap: float | None) -> list[list[int]]:
    """Headers first gather what is like them, then the rest gathers within the size cap."""
    used, out = [False] * len(texts), []
    for header_turn in (True, False):
        for i, kind in enumerate(types):
            if used[i] or (kind == "header") != header_turn:
                continue
            used[i], group, size = True, [i], len(texts[i])
            for j in np.flatnonzero(cos[i] >= threshold).tolist():
                if used[j]:
                    continue
                limit = header_cap if header_turn else cap
                if limit is not None and size + len(texts[j]) > limit:
                    continue
                used[j] = True
                group.append(j)
                size += len(texts[j])
            out.append(sorted(group))
    return out


#: Characters of finished chunks that a worker hands on at a time.
YIELD_CHARS = 4_000_000


def _of_documents(documents: DataFrame, schema: str, chunk: Callable[[list[str], list[str]], list[str]], semantic: bool) -> DataFrame:
    """``doc_id, types, texts``, a row a document -> its chunks; many documents make one table, not each its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = [], 0
            for doc_id, types, texts in zip(batch["doc_id"], batch["types"], batch["texts"], strict=True):
                found += [(doc_id, n, f"chunk_{n}", t, len(t), semantic, not semantic) for n, t in enumerate(chunk(list(types), list(texts)), 1)]
                held += sum(map(len, texts))
                if held >= YIELD_CHARS:
                    yield pd.DataFrame(found, columns=COLUMNS)
                    found, held = [], 0
            if found:
                yield pd.DataFrame(found, columns=COLUMNS)

    return documents.mapInPandas(run, schema)


def semantic_chunks(segmented: DataFrame, embedder: Embedder | None = None, threshold: float = 0.65, longest: int = 1000, scanned: bool = False) -> DataFrame:
    """``doc_id, segments`` -> chunks of segments that are alike; a document is the unit of work."""
    encode = embedder or hashing_embedder()
    limit = max(0.45, threshold - 0.15) if scanned else threshold
    cap = min(1.2 * longest, 1200) if scanned else 1.5 * longest

    def chunk(types: list[str], texts: list[str]) -> list[str]:
        groups = merge_segments(types, texts, _Cosines(_unit(encode(pd.Series(texts)))), limit, cap, 0.8 * longest if scanned else None)
        return ["\n\n".join(texts[i] for i in g) for g in groups]

    whole = segmented.groupBy("doc_id").agg(F.filter(F.flatten(F.collect_list("segments")), lambda s: s["length"] >= 5).alias("s")).where("size(s) > 0")
    return _of_documents(whole.select("doc_id", F.col("s.type").alias("types"), F.col("s.text").alias("texts")), _schema(segmented), chunk, True)


def hybrid_chunks(chunks: DataFrame, embedder: Embedder | None = None, threshold: float = 0.65, longest: int = 1000, scanned: bool = False) -> DataFrame:
    """Chunks by size (doc_id, chunk_no, text) merged with later ones that are alike, within the size cap."""
    encode = embedder or hashing_embedder()
    limit = max(0.5, threshold - 0.1) if scanned else threshold
    cap = (1.2 if scanned else 1.5) * longest

    def chunk(_: list[str], texts: list[str]) -> list[str]:
        cos, used, out = _Cosines(_unit(encode(pd.Series(texts)))), [False] * len(texts), []
        for i in range(len(texts)):
            if used[i]:
                continue
            group, size = [texts[i]], len(texts[i])
            for j in np.flatnonzero(cos[i] >= limit).tolist():
                if j > i and not used[j] and size + len(texts[j]) <= cap:
                    used[j] = True
                    group.append(texts[j])
                    size += len(texts[j])
            out.append("\n\n".join(group))
        return out

    whole = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("s"))
    return _of_documents(whole.select("doc_id", F.array().cast("array<string>").alias("types"), F.col("s.text").alias("texts")), _schema(chunks), chunk, False)


#: Vectors of a block: an eighth of their group within these bounds.  Two blocks meet in one piece of work.
BLOCK_ROWS = (2048, 16384)
#: Rows of a block multiplied at a time.
TILE_ROWS = 512


def similar_pairs(vectors: DataFrame, threshold: float, group: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pairs of one group (a document, a cell) whose cosine reaches the threshold, smaller key first.

    A group is dealt into blocks, and every two blocks meet in one piece of work: a product of matrices in single
    precision finds pairs near the threshold, and their cosines are then summed in double precision, element by
    element as SQL does.  A piece holds two blocks and one tile of products, whatever the size of its group.
    """
    kinds = dict(vectors.dtypes)
    named = vectors.select(F.col(group).alias("g"), F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    given = named.where("g IS NOT NULL AND k IS NOT NULL AND v IS NOT NULL").where(~F.exists("v", F.isnull)).withColumn("size", F.size("v"))
    least, most = BLOCK_ROWS
    sizes = given.groupBy("g", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("n") / 8)))).cast("int"))
    pieces = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    spread = int(min(4000, max(pieces, vectors.sparkSession.sparkContext.defaultParallelism)))
    own = given.join(sizes.select("g", "size", "blocks"), ["g", "size"]).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["g", "size", "i", "j"]
    met = other.select("g", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "v")
    dealt = met.repartition(spread, *unit).sortWithinPartitions(*unit)

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot, left, right = (np.zeros(len(a)) for _ in range(3))
        for d in range(a.shape[1]):
            x, y = a[:, d], b[:, d]
            dot, left, right = dot + x * y, left + x * x, right + y * y
        length = np.sqrt(left) * np.sqrt(right)
        return np.where((length > 0) | np.isnan(length), dot / length, -np.inf)

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not rows["size"].iloc[0]:
            return
        first = (rows["own"] == rows["i"]).to_numpy()
        m, k, same = np.stack(rows["v"].to_numpy()), rows["k"].to_numpy(), rows["i"].iloc[0] == rows["j"].iloc[0]
        near = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
        a, b = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        right, slack = near[b].T.copy(), max(1e-4, 2e-7 * m.shape[1])
        for start in range(0, len(a), TILE_ROWS):
            x, y = np.nonzero(~(near[a[start : start + TILE_ROWS]] @ right < threshold - slack))
            x += start
            if same:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 100_000):
                i, j = a[x[at : at + 100_000]], b[y[at : at + 100_000]]
                cos = exact(m[i], m[j])
                kept = ~(cos < threshold) & (k[i] != k[j])
                i, j, cos = i[kept], j[kept], cos[kept]
                swap = (k[i] > k[j]).astype(bool)
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield pd.DataFrame({group: rows["g"].to_numpy()[i], "a_id": k[i], "b_id": k[j], "cosine": cos})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        with np.errstate(all="ignore"):
            for batch in batches:
                if not len(batch):
                    continue
                names = [batch[c].to_numpy() for c in unit]
                new = np.any([(n[1:] != n[:-1]).astype(bool) for n in names], axis=0)
                cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
                for start, end in zip(cuts, cuts[1:], strict=False):
                    part = batch.iloc[start:end]
                    if held and any(held[0][c].iloc[0] != part[c].iloc[0] for c in unit):
                        yield from pairs(pd.concat(held))
                        held = []
                    held.append(part)
            if held:
                yield from pairs(pd.concat(held))

    return dealt.mapInPandas(run, f"`{group}` {kinds[group]}, a_id {kinds[key]}, b_id {kinds[key]}, cosine double")
