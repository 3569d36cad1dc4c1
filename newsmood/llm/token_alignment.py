"""Alignment of two tokenizers' tokens, with counts of linked ids by external spill counting.

A text is encoded by a byte-level BPE (A) and a sentencepiece BPE (B), both over a space and the text. Two tokens are linked if their byte ranges
overlap; between two neighbouring ends of tokens of either side lies exactly one link. The count of an id pair is the number of documents
that hold it linked; what is best for an A id is its pairs' highest count in the whole corpus.

Counting is external. A task collects records (pair, document, links), one per document and different pair, until a run holds `run_records` of them, sorts
them side-major (A id, then B id), parts them by radix (A id modulo `parts`) and compresses every part with zstd. For each part a run also has its
pairs with their number of documents, so that what is merged is counted once already and no id is hot. These are merged by heap, `fan_in` runs at a time,
until one run per part is left: the heap gives the A ids of all runs in order, counts of the same pair add up, and when an A id is complete so is
its maximum. The merged counts then meet the records of `fan_in` runs at a time, and contributions stream back: per run, part and document
the links with a best count and the sum of counts, as compressed arrays; then they are added up per run and put to its documents.

What a task holds: one run while it is collected (run_records x 12 bytes, and the documents of one batch); `fan_in` counted parts in a merge; the counts of one
part, which are bounded by the two vocabularies and not by the corpus, and one part of one run at a time when contributions are made. Runs and counts are
written tables, so lost executors only cost their own tasks.

Edge cases: null and empty texts have no tokens: zeros and ''. So has a text whose tokens of either side do not give back the bytes of space and text
(for instance one that holds U+2581). Ids may be null or repeat: one row per input row, each row a document of its own. Special tokens' strings
are plain text. Texts are encoded whole; a very long one takes memory in proportion to its own length. No documents: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsmood.llm.common import stage, whole_text

RUN_RECORDS = 2_000_000
PARTS = 64
FAN_IN = 128
#: Fixed value: how byte-level BPE splits text before its merges.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents are aligned together until they hold so many bytes.
_BYTES = 1 << 20
_NO_TOKENS = (0, 0, 0, 0, "")


class Pair:
    """Two tokenizers and the lengths in bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        # The merges of a byte-level BPE are in the order of their ids, so the vocabulary is all that the faster of the two encoders needs.
        described = json.loads(Path(a_path).read_text())
        special = {t["content"] for t in described["added_tokens"]}
        letter = _byte_letters()
        ranks = {bytes(letter[c] for c in token): number for token, number in described["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for token, number in ranks.items():
            self.a_bytes[number] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # Text of an id with what follows it in a group: next id of its side, other side, next group.
        self.a_text, self.b_text = ([[f"{i}{end}" for i in range(len(x))] for end in ",|;"] for x in (self.a_bytes, self.b_bytes))

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where the bytes of either side are not those of space and text."""
        a_ids = [self.a.encode_ordinary(" " + t) for t in texts]
        b_ids = self.b.encode(texts, num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        out = []
        for text, a, b in zip(texts, a_ids, b_ids):
            whole = b" " + text.encode()
            same = text and b"".join([a_bytes[i] for i in a]) == whole and b"".join([b_bytes[i] for i in b]) == whole
            out.append((a, b) if same else ([], []))
        return out


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others as the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def align(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tokenizations of the same bytes: ends of tokens (A, B), and per link the place of its A and B token."""
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    ends = np.union1d(a_ends, b_ends)
    return a_ends, b_ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
    """The groups between common ends, `a1,a2|b1;a3|b2,b3`."""
    a_last, b_last = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
    a_part = [pair.a_text[end][i] for i, end in zip(a.tolist(), a_last.astype(np.int8).tolist())]
    b_part = [pair.b_text[end][i] for i, end in zip(b.tolist(), (2 * b_last.astype(np.int8)).tolist())]
    order = np.argsort(np.concatenate([2 * (np.cumsum(a_last) - a_last), 2 * (np.cumsum(b_last) - b_last) + 1]), kind="stable")
    tokens = a_part + b_part
    return "".join([tokens[i] for i in order.tolist()])[:-1]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd block; sorted unsigned numbers are better given as differences."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    shape = np.frombuffer(raw, "<u4", 2 * n, 4).tolist()
    out, at = [], 4 + 8 * n
    for size, width in zip(shape[::2], shape[1::2]):
        out.append(np.frombuffer(raw, f"<u{width}", size, at))
        at += size * width
    return out


def _steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


class _Run:
    """Records of one run while they are collected."""

    def __init__(self, number: int):
        self.number, self.documents, self.records = number, 0, 0
        self.pairs: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, pairs: np.ndarray) -> None:
        """The links of the next document."""
        pairs, links = np.unique(pairs, return_counts=True)
        self.pairs.append(pairs)
        self.owners.append(np.full(len(pairs), self.documents, np.uint32))
        self.links.append(links.astype(np.uint32))
        self.documents += 1
        self.records += len(pairs)

    def parts(self, parts: int, b_size: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, records, counted pairs) of every part with records."""
        pairs = np.concatenate(self.pairs)
        order = np.lexsort((pairs, pairs // b_size % parts))
        pairs, owners, links = pairs[order], np.concatenate(self.owners)[order], np.concatenate(self.links)[order]
        edges = np.searchsorted(pairs // b_size % parts, np.arange(parts + 1))
        for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if lo < hi:
                different, documents = np.unique(pairs[lo:hi], return_counts=True)
                yield (part, _packed(_steps(different), documents.astype(np.uint32), owners[lo:hi], links[lo:hi]),
                       _packed(_steps(different), documents.astype(np.uint64)))


def runs(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, parts: int, run_records: int) -> DataFrame:
    """One pass over the texts: a row per document (`part` null: `run`, `place`, `doc_id`, figures) and per run and part (`records`, `counted`)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType
    names = ["run", "part", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "records", "counted"]
    types = [pa.int64(), pa.int32(), pa.int64(), to_arrow_type(kind), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        b_size = len(pair.b_bytes)
        number_type = np.uint32 if len(pair.a_bytes) * b_size < 1 << 32 else np.uint64
        run = _Run(TaskContext.get().partitionId() << 32)

        def table(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def spill() -> Iterator[pa.RecordBatch]:
            if run.records:
                for part, records, counted in run.parts(parts, b_size):
                    yield table([(run.number, part, None, None, None, None, None, None, None, records, counted)])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.binary_length(texts).to_pylist()
            first = 0
            while first < len(ids):
                last, total = first, 0
                while last < len(ids) and (last == first or total + sizes[last] <= _BYTES):
                    total += sizes[last]
                    last += 1
                found = []
                for doc_id, (a, b) in zip(ids[first:last], pair.encode(texts.slice(first, last - first).to_pylist())):
                    figures, pairs = _NO_TOKENS, np.zeros(0, number_type)
                    if a:
                        a, b = np.array(a, np.int64), np.array(b, np.int64)
                        a_ends, b_ends, of_a, of_b = align(a, b, pair.a_sizes, pair.b_sizes)
                        pairs = (a[of_a] * b_size + b[of_b]).astype(number_type)
                        text = group_texts(pair, a, b, a_ends, b_ends)
                        figures = (len(a), len(b), text.count(";") + 1, len(pairs), hashlib.sha256(text.encode()).hexdigest())
                    found.append((run.number, None, run.documents, doc_id, *figures, None, None))
                    run.add(pairs)
                    if run.records >= run_records:
                        yield table(found)
                        yield from spill()
                        found, run = [], _Run(run.number + 1)
                yield table(found)
                first = last
        yield from spill()

    schema = f"run long, part int, place long, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, records binary, counted binary"
    return rows.mapInArrow(collect, schema)


def merge_counts(inputs: list[bytes], b_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs in order, documents of each) of several counted runs: a heap gives the A ids, counts of the same pair add up."""
    pairs, counts, edges = [], [], []
    heap: list[tuple[int, int, int]] = []
    for k, data in enumerate(inputs):
        steps, documents = _unpacked(data)
        own = np.cumsum(steps, dtype=np.uint64)
        sides = own // np.uint64(b_size)
        starts = np.flatnonzero(np.diff(sides, prepend=np.uint64(1 << 63)))
        pairs.append(own)
        counts.append(documents)
        edges.append((sides[starts].tolist(), [*starts.tolist(), len(own)]))
        if len(own):
            heappush(heap, (edges[k][0][0], k, 0))
    out_pairs, out_counts = [], []
    while heap:
        side, some_pairs, some_counts = heap[0][0], [], []
        while heap and heap[0][0] == side:
            _, k, at = heappop(heap)
            sides, starts = edges[k]
            some_pairs.append(pairs[k][starts[at]: starts[at + 1]])
            some_counts.append(counts[k][starts[at]: starts[at + 1]])
            if at + 1 < len(sides):
                heappush(heap, (sides[at + 1], k, at + 1))
        # One A id is complete for these runs.
        different, place = np.unique(np.concatenate(some_pairs), return_inverse=True)
        total = np.zeros(len(different), np.uint64)
        np.add.at(total, place, np.concatenate(some_counts))
        out_pairs.append(different)
        out_counts.append(total)
    return (np.concatenate(out_pairs), np.concatenate(out_counts)) if out_pairs else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Groups of neighbouring rows that agree in their first `keys` columns; only one batch is held."""
    each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(each, key=lambda row: row[:keys])


def counts(counted: DataFrame, b_size: int, fan_in: int) -> DataFrame:
    """`part`, `counted`: the pairs of a part with their documents in the corpus, one row per part, from `run`, `part`, `counted`."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, run), rows in _by_group(batches, 2):
            pairs, documents = merge_counts([data for *_, data in rows], b_size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.array([_packed(_steps(pairs), documents)], pa.binary())], names=["part", "run", "counted"])

    level, runs_left = counted.select("part", "run", "counted"), counted.select("run").distinct().count()
    while True:
        runs_left = max(1, -(-runs_left // fan_in))
        grouped = level.select("part", _dealt("run", runs_left).alias("run"), "counted")
        dealt = grouped.repartition("part", "run").sortWithinPartitions("part", "run")
        level = stage(dealt.mapInArrow(merge, "part int, run long, counted binary"), "alignment-counts")
        if runs_left == 1:
            return level.select("part", "counted")


def _dealt(run: str, groups: int) -> Column:
    """The group of a run, about as many runs in each."""
    return F.pmod(F.xxhash64(run), F.lit(groups)).cast("long")


def _best(pairs: np.ndarray, documents: np.ndarray, b_size: int) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; pairs are side-major, so an A id's pairs lie together."""
    if not len(pairs):
        return np.zeros(0, bool)
    sides = pairs // np.uint64(b_size)
    starts = np.flatnonzero(np.diff(sides, prepend=np.uint64(1 << 63)))
    most = np.maximum.reduceat(documents, starts)
    return documents == np.repeat(most, np.diff([*starts, len(pairs)]))


def contributions(records: DataFrame, total: DataFrame, b_size: int, fan_in: int) -> DataFrame:
    """`run`, `sums`: per run and part the documents with their links of best count and sums of counts.

    The counts of a part go to every `fan_in` of its runs, so no part is hot.
    """
    groups = max(1, -(-records.select("run").distinct().count() // fan_in))
    grouped = records.select("part", _dealt("run", groups).alias("group"), "run", "records")
    wanted = grouped.select("part", "group").distinct().join(total, "part").select("part", "group", F.lit(None).cast("long").alias("run"), F.col("counted").alias("records"))
    dealt = wanted.union(grouped).repartition("part", "group").sortWithinPartitions("part", "group", F.asc_nulls_first("run"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, 2):
            steps, documents = _unpacked(next(rows)[3])
            pairs = np.cumsum(steps, dtype=np.uint64)
            best = _best(pairs, documents, b_size)
            for *_, run, data in rows:
                steps, sizes, owners, links = _unpacked(data)
                place = np.repeat(np.searchsorted(pairs, np.cumsum(steps, dtype=np.uint64)), sizes)
                who, at = np.unique(owners, return_inverse=True)
                sums = np.zeros((2, len(who)), np.uint64)
                np.add.at(sums[0], at, links * best[place].astype(np.uint64))
                np.add.at(sums[1], at, links * documents[place])
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([_packed(_steps(who), sums[0], sums[1])], pa.binary())], names=["run", "sums"])

    return dealt.select("part", "group", "run", "records").mapInArrow(add, "run long, sums binary")


def alignments(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", *,
    parts: int = PARTS, run_records: int = RUN_RECORDS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`."""
    b_size = _pair(a_path, b_path).b.get_piece_size()
    spilled = stage(runs(docs, a_path, b_path, id_col, text_col, parts, run_records), "alignment-runs")
    documents, slices = spilled.where("part IS NULL"), spilled.where("part IS NOT NULL")
    total = counts(slices.select("part", "run", "counted"), b_size, fan_in)
    sums = contributions(slices.select("part", "run", "records"), total, b_size, fan_in)
    figures = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = documents.schema["doc_id"].dataType
    nothing = [F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in figures]
    both = sums.select("run", F.lit(-1).cast("long").alias("place"), "sums", *nothing).union(documents.select("run", "place", F.lit(None).cast("binary"), *figures))
    dealt = both.repartition("run").sortWithinPartitions("run", "place")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string()]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, 1):
            added = np.zeros((2, 0), np.uint64)
            out: list[tuple] = []
            for _, place, data, *figures in rows:
                if place < 0:
                    steps, best, count = _unpacked(data)
                    who = np.cumsum(steps, dtype=np.int64)
                    if who[-1] >= added.shape[1]:
                        added = np.pad(added, ((0, 0), (0, int(who[-1]) + 1 - added.shape[1])))
                    added[0, who] += best
                    added[1, who] += count
                    continue
                best, count = added[:, place].tolist() if place < added.shape[1] else (0, 0)
                out.append((*figures[:5], best, count, figures[5]))
                if len(out) >= 10_000:
                    yield _table(out)
                    out = []
            yield _table(out)

    def _table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string"
    return dealt.mapInArrow(put, schema)
