"""Removal of long repeated byte strings with counts of content-defined anchors, in place of suffix arrays.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else in the corpus.

Suffixes are sampled by content: of the GRAM-byte strings inside a window of `length` bytes, the one with the smallest hash (the
rightmost of equals) is the window's anchor. Equal windows have their anchor at the same offset, so a repeated window is found by its
anchor's suffix. A chunk of documents (`chunks`) gives, per range of hashes, a table of its anchors' hashes with counts,
without positions or order of text. A range adds the tables of all chunks to a family whose levels of one size class are merged into the
next, and then looks totals up; the family ends with its task, so no index is kept for later documents.

1. An anchor that no other suffix shares covers windows that occur once.
2. An anchor whose suffixes all have the same surroundings (the bytes of all windows that it is the anchor of) covers windows that all
   repeat.
3. Only anchors whose suffixes differ in their surroundings, that is at the ends of matches, are looked at window by window:
   their windows' hashes go through a second family.

Anchors are the smallest hashes of their windows, so their hashes are mixed again before the key space is cut into ranges.
A key moves once per chunk however often it occurs in it, and groups of copies of any size cost their chunks one key each. Strings are compared by
64-bit hashes of their bytes, after their anchors' 64-bit hashes have met.

Edge cases: null text counts as empty (0 bytes, nothing removed, the digest of no bytes). Texts shorter than `length` have no window. Repeated rows
remove each other: every occurrence of a repeated string goes, as the strings are judged on the input. Ids may be null or repeat: one row per
input row. Very long texts are read in pieces that overlap by `length`; nothing is cut. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsmood.llm import chunks
from newsmood.llm.chunks import Levels

LENGTH = 200
GRAM = 64
#: A task may look at every window of a chunk, so chunks are small. Suffixes are far fewer than bytes: a range of them serves several chunks.
CHUNK_BYTES, CHUNKS_PER_RANGE = 4_000_000, 8
#: Bytes looked at together.
SPAN = 1 << 20
SUFFIX, WINDOW = 0, 1
#: What is known of an anchor: nothing repeats, all its windows repeat, or they must be looked at.
ONCE, ALL, SOME = 0, 1, 2

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Strings:
    """Hashes of substrings of a byte array, by prefix sums of a polynomial modulo 2^64."""

    UP, DOWN = _powers(_BASE, SPAN + 4096), _powers(_INVERSE, SPAN + 4096)

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.UP[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """The hash of every substring of `length` bytes."""
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.DOWN[:n])

    def some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.DOWN[starts])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def windows(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a text: (first window, runs' first windows, runs' ends, their anchors' hashes, their surroundings' hashes).

    A run is a stretch of windows with one anchor; positions count from the piece's first window.
    """
    for base in range(0, max(0, len(data) - length + 1), SPAN):
        part = data[base: base + SPAN + length - 1]
        strings = _Strings(part)
        grams = strings.all(GRAM)
        # The position in the low bits breaks ties: the rightmost of equal hashes is the smallest.
        places = np.uint64((1 << 21) - 1) - np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least((grams & ~np.uint64((1 << 21) - 1)) | places, length - GRAM + 1)
        anchor = ((1 << 21) - 1) - (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        ends = np.append(first[1:], len(anchor))
        at = anchor[first]
        around = strings.some(first, ends + length - 1) ^ _mixed((at - first).astype(np.uint64) + np.uint64(1))
        # Anchors have small hashes, so they are mixed again: ranges of them are then about equally full.
        yield base, first, ends, _mixed(grams[at] + np.uint64(_BASE)), around


def _texts(docs: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in docs["text"].to_pylist()]


def _anchors(docs: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    grams, arounds = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for data in _texts(docs):
        for _, _, _, gram, around in windows(data, length):
            grams.append(gram)
            arounds.append(around)
    return np.concatenate(grams), np.concatenate(arounds)


def _own(gram: np.ndarray, around: np.ndarray) -> np.ndarray:
    """One key for a suffix with its surroundings."""
    return _mixed(gram + np.uint64(0x632BE59BD9B4E019)) ^ around


def _suffix_array(docs: pa.Table, length: int):
    """(gram, key with surroundings, count) of the chunk's different suffixes, in the order of grams."""
    gram, around = _anchors(docs, length)
    order = np.lexsort((around, gram))
    gram, around = gram[order], around[order]
    first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (around[1:] != around[:-1]))) if len(gram) else np.zeros(0, np.int64)
    return gram[first], _own(gram[first], around[first]), np.diff(np.append(first, len(gram)))


def _window_keys(docs: pa.Table, length: int, looked_at) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, first window, first position of the run, keys) for the runs that `looked_at(gram, around)` picks."""
    for i, data in enumerate(_texts(docs)):
        for base, first, ends, gram, around in windows(data, length):
            runs = np.flatnonzero(looked_at(gram, around))
            if not len(runs):
                continue
            part = data[base: base + SPAN + length - 1]
            strings = _Strings(part)
            counts = ends[runs] - first[runs]
            starts = np.repeat(first[runs] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            keys = _mixed(strings.some(starts, starts + length) ^ np.repeat(gram[runs], counts))
            yield i, base, starts, keys


def _statuses(docs: pa.Table, answers: pa.Table, length: int):
    """Function from (gram, around) to ONCE, ALL or SOME, and one that says whether the surroundings themselves repeat."""
    gram, own, _ = _suffix_array(docs, length)
    rows = [(b, t) for k, b, t in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist()) if k == SUFFIX]
    flags = np.frombuffer(b"".join(t for _, t in sorted(rows, key=lambda r: r[0])), np.uint8)
    order = np.argsort(own, kind="stable")
    sorted_own, sorted_flags = own[order], flags[order]

    def flags_of(g: np.ndarray, a: np.ndarray) -> np.ndarray:
        return sorted_flags[np.searchsorted(sorted_own, _own(g, a))]

    return flags_of


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept` (the remaining bytes) of every whole text."""
    rows, number = chunks.dealt(docs, id_col, text_col, chunk_bytes=CHUNK_BYTES)
    suffix_edges = chunks.bucket_edges(-(-number // CHUNKS_PER_RANGE))
    window_edges = chunks.bucket_edges(number)
    kind_of_id = rows.schema["doc_id"].dataType.simpleString()

    def send_suffixes(docs: pa.Table) -> pa.Table:
        chunk = docs["chunk"][0].as_py()
        gram, own, count = _suffix_array(docs, length)
        out = [(b, chunk, SUFFIX, gram[p].astype("<u8").tobytes() + own[p].astype("<u8").tobytes(), chunks.planes(count[p]))
               for b, p in chunks.split(gram, suffix_edges)]
        return chunks.table(chunks.SENT_NAMES, out, chunks.SENT)

    def meet_suffixes(sent: pa.Table) -> pa.Table:
        bucket = sent["bucket"][0].as_py()
        grams, owns, batches = Levels(), Levels(), []
        for chunk, keys, more in zip(sent["chunk"].to_pylist(), sent["keys"].to_pylist(), sent["more"].to_pylist()):
            gram, own = np.frombuffer(keys, "<u8").reshape(2, -1)
            count = chunks.from_planes(more).astype(np.int64)
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            grams.add(gram[first], np.add.reduceat(count, first))
            order = np.argsort(own)
            owns.add(own[order], count[order])
            batches.append((chunk, gram, own))
        out = []
        for chunk, gram, own in batches:
            order = np.argsort(own)
            with_own = np.empty(len(own), np.int64)
            with_own[order] = owns.totals(own[order])
            with_gram = grams.totals(gram)
            flags = np.where(with_gram == 1, ONCE, np.where(with_gram == with_own, ALL, SOME)).astype(np.uint8)
            out.append((chunk, bucket, SUFFIX, flags.tobytes()))
        return chunks.table(["chunk", "bucket", "kind", "totals"], out, chunks.ANSWERED)

    def send_windows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return chunks.table(chunks.SENT_NAMES, [], chunks.SENT)
        chunk, flags = docs["chunk"][0].as_py(), _statuses(docs, answers, length)
        found = [keys for _, _, _, keys in _window_keys(docs, length, lambda g, a: flags(g, a) == SOME)]
        unique, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        out = [(b, chunk, WINDOW, unique[p].astype("<u8").tobytes(), chunks.planes(count[p])) for b, p in chunks.split(unique, window_edges)]
        return chunks.table(chunks.SENT_NAMES, out, chunks.SENT)

    def meet_windows(sent: pa.Table) -> pa.Table:
        bucket, family = sent["bucket"][0].as_py(), Levels()
        batches = [(c, np.frombuffer(k, "<u8"), chunks.from_planes(m)) for c, k, m in zip(
            sent["chunk"].to_pylist(), sent["keys"].to_pylist(), sent["more"].to_pylist())]
        for _, keys, count in batches:
            family.add(keys, count.astype(np.int64))
        out = [(chunk, bucket, WINDOW, np.packbits(family.totals(keys) > 1).tobytes() + len(keys).to_bytes(8, "little")) for chunk, keys, _ in batches]
        return chunks.table(["chunk", "bucket", "kind", "totals"], out, chunks.ANSWERED)

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["n_bytes", "n_removed", "n_spans"]
        if not len(docs):
            return pa.table({"doc_id": docs["doc_id"], **{n: pa.array([], pa.int64()) for n in names}, "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.binary())})
        flags, texts = _statuses(docs, answers, length), _texts(docs)
        parts = [(b, t) for k, b, t in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist()) if k == WINDOW]
        again = [np.unpackbits(np.frombuffer(t[:-8], np.uint8), count=int.from_bytes(t[-8:], "little")).astype(bool) for _, t in sorted(parts, key=lambda r: r[0])]
        again = np.concatenate(again) if again else np.zeros(0, bool)
        # Coverage by counting where covered stretches start and end.
        change = [np.zeros(len(t) + 1, np.int32) for t in texts]
        for i, data in enumerate(texts):
            for base, first, ends, gram, around in windows(data, length):
                every = flags(gram, around) == ALL
                np.add.at(change[i], base + first[every], 1)
                np.add.at(change[i], base + ends[every] + length - 1, -1)
        looked = list(_window_keys(docs, length, lambda g, a: flags(g, a) == SOME))
        unique = np.unique(np.concatenate([k for *_, k in looked])) if looked else np.zeros(0, np.uint64)
        for i, base, starts, keys in looked:
            hit = starts[again[np.searchsorted(unique, keys)]] + base
            np.add.at(change[i], hit, 1)
            np.add.at(change[i], hit + length, -1)
        columns = [[], [], [], [], []]
        for data, delta in zip(texts, change):
            gone = np.cumsum(delta[:-1]) > 0
            kept = data[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            for column, value in zip(columns, (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        return pa.table({"doc_id": docs["doc_id"], **{n: pa.array(c, k) for n, c, k in zip([*names, "kept_sha256", "kept"], columns, kinds)}})

    suffixes = chunks.per_chunk(rows, send_suffixes, chunks.SENT).groupBy("bucket").applyInArrow(lambda t: meet_suffixes(t), chunks.ANSWERED)
    edge = chunks.with_answers(rows, suffixes, send_windows, chunks.SENT).groupBy("bucket").applyInArrow(lambda t: meet_windows(t), chunks.ANSWERED)
    out = f"doc_id {kind_of_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return chunks.with_answers(rows, suffixes.unionByName(edge), remove, out)
