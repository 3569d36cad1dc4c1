"""Counting keys over a corpus and bringing the counts back to the texts.

Documents are dealt into chunks of about equal bytes by a hash of their id. A chunk is a task's unit of work: it gets its keys
(hashes of n-grams or of byte strings) as sorted arrays without repeats, and sends one packed array per bucket, a bucket being
a range of the key space. A bucket adds up what all chunks sent and returns to each of them the totals of its keys, in the
order sent. So a key moves once per chunk, not once per occurrence, however often it occurs: no key is hot.

The answers and the documents of a chunk meet again by a cogroup on the chunk.

Chunks and buckets both grow with the corpus, so a packed array holds fewer keys the larger the corpus is: with 8 MB chunks some
hundred at 50 GB, and about one at 10 TB, where a larger CHUNK_BYTES pays (a task needs some 25 times as much memory). Empty
arrays are not sent, so it never costs more than one row per key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import whole_text

CHUNK_BYTES = 8_000_000
SENT = "bucket int, chunk int, kind int, keys binary, more binary"
ANSWERED = "chunk int, bucket int, kind int, totals binary"
SENT_NAMES = ["bucket", "chunk", "kind", "keys", "more"]


def dealt(docs: DataFrame, id_col: str, text_col: str, apart=None, chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(`chunk`, `doc_id`, `text` (bytes), `apart`; number of chunks). Rows for which `apart` holds get chunks of their own."""
    text = whole_text(F.col(text_col)).cast("binary")
    apart = F.lit(False) if apart is None else apart
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    chunks = max(1, -(-size // (chunk_bytes or CHUNK_BYTES)))
    number = F.pmod(F.xxhash64(F.col(id_col), F.crc32(text)), F.lit(chunks)).cast("int")
    rows = docs.select(
        (number + F.when(apart, chunks).otherwise(0)).cast("int").alias("chunk"),
        F.col(id_col).alias("doc_id"), text.alias("text"), apart.alias("apart"))
    return rows, chunks


def bucket_edges(buckets: int) -> np.ndarray:
    """Lower ends of the buckets' key ranges."""
    return np.array([((1 << 64) * i) // buckets for i in range(buckets)], np.uint64)


#: Bytes of a count within one chunk, and of a total over all chunks.
IN_CHUNK, TOTAL = 4, 8


def planes(numbers: np.ndarray, width: int = IN_CHUNK) -> bytes:
    """Unsigned numbers of `width` bytes, all lowest bytes first: mostly small numbers compress well this way."""
    return np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data: bytes, width: int = IN_CHUNK) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}")[:, 0]


def narrow(keys: np.ndarray, edge: np.uint64, buckets: int) -> bytes:
    """Keys of a bucket in 5 bytes each: the 40 highest bits below what the bucket says already."""
    shift = np.uint64(max(0, 64 - (buckets.bit_length() - 1) - 40))
    return np.ascontiguousarray(((keys - edge) >> shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_narrow(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def split(keys: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of the sorted keys, empty buckets left out."""
    bounds = np.append(np.searchsorted(keys, edges), len(keys))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), slice(bounds[b], bounds[b + 1])


def table(names: list[str], rows: list[tuple], schema: str) -> pa.Table:
    """An Arrow table of `rows` with the int and binary columns of `schema`."""
    kinds = [pa.binary() if kind.endswith("binary") else pa.int32() for kind in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})


class Levels:
    """Sorted key arrays with counts, in levels of geometrically growing size.

    A new array is a level of its own; two levels of one size class are merged into the next, so there are logarithmically many and a
    key is moved logarithmically often. A lookup scans every level once.
    """

    BASE = 1 << 12

    def __init__(self):
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Takes in sorted keys without repeats."""
        size = self._class(len(keys))
        while size in self.levels:
            keys, counts = _merge(*self.levels.pop(size), keys, counts)
            size = self._class(len(keys))
        self.levels[size] = keys, counts

    def _class(self, n: int) -> int:
        return max(1, n // self.BASE).bit_length()

    def totals(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, over all levels."""
        out = np.zeros(len(keys), np.int64)
        for level, counts in self.levels.values():
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            out[hit] += counts[at[hit]]
        return out


def _merge(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a, b])
    order = np.argsort(keys, kind="stable")  # two sorted runs: one linear merge
    keys, counts = keys[order], np.concatenate([n, m])[order]
    first = np.append(True, keys[1:] != keys[:-1])
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(keys) else counts


def per_chunk(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work` on the documents of every chunk."""
    return rows.groupBy("chunk").applyInArrow(lambda t: work(t), schema)


def with_answers(rows: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work` on the documents of every chunk and the answers to it."""
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: work(a, b), schema)
