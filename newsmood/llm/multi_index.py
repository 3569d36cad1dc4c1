"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are lifted so that the largest inner product is the smallest angle (an extra coordinate fills every vector up to the
largest norm), rotated by a rotation learned on a bounded sample (iterative quantisation), and cut to sign bits. A code's
bits are split into PARTS substrings, each with an index from value to codes. If two codes differ in at most r bits, then by
pigeonhole one of the first r % PARTS + 1 substrings differs in at most r // PARTS bits or another one in less; probing all such values of
every substring's index retrieves every code within r. Retrieved vectors are reranked by their exact inner product.

The radius is set per query: the angle of the k-th best vector found so far tells how many bits its code may differ by, with
MARGIN standard deviations on top; the radius grows to that and probing is repeated until it suffices.

All vectors are indexed, in blocks of BLOCK vectors; queries come in blocks of QUERIES. Each pair of blocks is a task, which returns k rows
per query; the best k of all blocks are taken. Only the rotation is broadcast.

Edge cases: null or zero vectors, vectors with null or non-finite components, with another than the most frequent dimension, and rows
without id take no part. All rows with the query's id are its own. Equal scores are ordered by id; rows that repeat a candidate stay
separate candidates. A query with fewer than k candidates gets all of them. Empty input gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmood.llm.common import stage

BITS = 64
PARTS = 5
SAMPLE = 20_000
BLOCK = 8192
QUERIES = 4096
MARGIN = 1.0
#: The first radius tried, and the next one if it finds too few.
NEAR, FAR = 8, 26
EDGES = [round(BITS * i / PARTS) for i in range(PARTS + 1)]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id`, `v` (array of doubles) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(sizes.select("d")), F.size("v") == F.col("d")).select("vec_id", "v")  # one row


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors of length 1 with one more coordinate; inner products with lifted queries keep their order."""
    scaled = x / norm
    return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))[:, None]])


def learn(sample: np.ndarray, rounds: int = 30) -> dict:
    """Centre and rotation(s) that give BITS bits, by iterative quantisation of the lifted sample."""
    centre = sample.mean(axis=0)
    x = sample - centre
    d = x.shape[1]
    draw = np.random.default_rng(7)
    turns = []
    while sum(t.shape[1] for t in turns) < BITS:
        take = min(d, BITS - sum(t.shape[1] for t in turns))
        _, _, axes = np.linalg.svd(x.T @ x)
        projected = x @ axes[:take].T
        rotation = np.linalg.qr(draw.normal(size=(take, take)))[0]
        for _ in range(rounds):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(signs.T @ projected)
            rotation = (u @ w).T
        turns.append(axes[:take].T @ rotation)
    return {"centre": centre, "turn": np.hstack(turns)}


def codes(lifted: np.ndarray, model: dict) -> np.ndarray:
    bits = (lifted - model["centre"]) @ model["turn"] >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _masks(width: int) -> list[np.ndarray]:
    """By number of bits: all values of `width` bits that have so many or fewer, the lighter ones first."""
    out, values = [], []
    for n in range(width + 1):
        values += [sum(1 << i for i in c) for c in combinations(range(width), n)]
        out.append(np.array(values, np.int64))
    return out


class Index:
    """Substring indexes over an array of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = []
        for lo, hi in zip(EDGES, EDGES[1:]):
            keys = self._part(codes, lo, hi)
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << (hi - lo)) + 1))
            self.parts.append((lo, hi, order, starts))
        self.masks = {w: _masks(w) for w in {hi - lo for lo, hi in zip(EDGES, EDGES[1:])}}

    @staticmethod
    def _part(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((codes >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes that differ in at most `radius` bits."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        share, more = divmod(radius, PARTS)
        seen = np.zeros(len(self.codes), bool)
        for k, (lo, hi, order, starts) in enumerate(self.parts):
            reach = min(hi - lo, share if k <= more else share - 1)
            if reach < 0:
                continue
            keys = self._part(np.array([code], np.uint64), lo, hi)[0] ^ self.masks[hi - lo][reach]
            first, n = starts[keys], starts[keys + 1] - starts[keys]
            full = n > 0
            first, n = first[full], n[full]
            if len(n):
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                seen[order[at]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def radius_for(cosine: float) -> int:
    """Bits by which codes of vectors at this cosine differ, with the margin."""
    share = float(np.arccos(np.clip(cosine, -1, 1))) / np.pi
    return min(BITS, int(np.ceil(BITS * share + MARGIN * np.sqrt(BITS * share * (1 - share)))))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, model: dict, k: int):
    """(query id, id, score) arrays: the k best of this block found for each query."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    index = Index(codes(lift(x, model["norm"]), model))
    lengths = np.sqrt((q * q).sum(axis=1))
    unit = np.hstack([q / lengths[:, None], np.zeros((len(q), 1))])
    wanted = codes(unit, model)
    out_q, out_id, out_s = [], [], []
    for i in range(len(q)):
        radius, scores, near = NEAR, np.zeros(0), np.zeros(0, np.int64)
        while True:
            near = index.within(wanted[i], radius)
            near = near[ids[near] != query_ids[i]]
            # A fixed order of additions: equal vectors get equal scores.
            scores = (x[near] * q[i]).sum(axis=1)
            if len(near) < k:
                need = FAR if radius < FAR else BITS
            else:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                need = radius_for(kth / (lengths[i] * model["norm"]))
            if radius >= min(need, BITS):
                break
            radius = min(need, BITS)
        if len(near) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            near, scores = near[scores >= kth], scores[scores >= kth]
        best = np.lexsort((ids[near], -scores))[:k]
        out_q.append(np.full(len(best), query_ids[i]))
        out_id.append(ids[near][best])
        out_s.append(scores[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out_q, np.int64), join(out_id, np.int64), join(out_s, np.float64)


def nearest(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERIES,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest found of every row for which `is_query` (a Column) holds."""
    marked = stage(usable(vectors, id_col, vector_col), "vectors")
    n = marked.count()
    share = min(1.0, sample / max(1, n))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    norm = marked.agg(F.max(F.sqrt(squares))).first()[0] or 1.0
    picked = marked.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))
    rows = picked.select("v").toArrow()
    sampled = _matrix(rows["v"]) if len(rows) else np.ones((1, 1))
    model = {**learn(lift(sampled, norm)), "norm": norm}
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    blocks = max(1, -(-n // block))
    queries = marked.where(is_query)
    query_blocks = max(1, -(-queries.count() // query_block))
    number = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    base = marked.select(number(blocks, 1).alias("block"), every(query_blocks).alias("part"), "vec_id", "v")
    asked = queries.select(every(blocks).alias("block"), number(query_blocks, 2).alias("part"), "vec_id", "v")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(left) and len(right):
            found = search_block(
                left["vec_id"].to_numpy(), _matrix(left["v"]), right["vec_id"].to_numpy(), _matrix(right["v"]), shared.value, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found))))

    keys = ("block", "part")
    partial = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
