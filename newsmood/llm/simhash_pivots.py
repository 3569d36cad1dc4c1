"""SimHash near-duplicates found with tables of distances to reference fingerprints (pivots).

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints are one node; the work is on distinct ones.

The distance to a fixed pivot changes by at most r between two fingerprints that differ in r bits. Pivots come in families:
the members of family j lie inside block j of the bits, so their coordinates change only by bits that differ there. With b blocks and
r = 3, two fingerprints that are linked agree in all coordinates of at least b - 3 families. Every choice of b - 3 families is a
table whose key is those coordinates; equal keys make a cell, and linked fingerprints share a cell of at least one table. Inside a cell, pairs
whose coordinates differ by more than 3 at any of the spread-out pivots are discarded, and the rest is verified
bit by bit. b grows with the number of distinct fingerprints, so that cells stay small; it never changes the result.

A cell gives the links of a spanning forest, not its pairs: a search visits the members, compares each only with the members not yet
reached, and keeps the link that reached it. So a dense group of near copies costs about its size.

Edge cases: null and empty text and text of white space have fingerprint 0, which links like any other. Fewer words than a
shingle make one shingle of all words. Repeated shingles count as often as they occur. Equal rows share a fingerprint. The
component of a row is the smallest id in it; null ids take no part in the minimum (null if a component has no other).
Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import join_groups, stage, whole_text
from newsmood.llm.components import components

SEED = 42
RADIUS = 3
#: Pivots per family, and pivots over all bits.
FAMILY = 8
SPREAD = 16

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the shingles of `text`: bit i is set if it is set in more than half of their hashes."""
    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = ends - [len(w) for w in words]
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    array = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(array), 65_536):
        bits = np.unpackbits(array[at: at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(array), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`doc_id`, `fp` (the 64 bits as a signed long) of every whole text; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).cast("binary").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks_for(n: int) -> int:
    """Number of blocks: the keys of b - 3 of b blocks have about as many values as there are fingerprints, 25 bits at least."""
    b = 5
    while 64 * (b - RADIUS) / b < np.log2(max(n, 1)) and b < 16:
        b += 1
    return b


def block_masks(b: int) -> list[int]:
    edges = [round(64 * i / b) for i in range(b + 1)]
    return [((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def pivots(b: int) -> tuple[np.ndarray, np.ndarray]:
    """(families: b x FAMILY pivots inside their block, spread: SPREAD pivots over all bits), from a fixed seed."""
    draw = np.random.default_rng(64)
    any_bits = draw.integers(0, 1 << 64, (b, FAMILY), np.uint64, endpoint=False)
    masks = np.array(block_masks(b), np.uint64)[:, None]
    return any_bits & masks, draw.integers(0, 1 << 64, SPREAD, np.uint64, endpoint=False)


def coordinates(fps: np.ndarray, families: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Per fingerprint and family, its distances to the family's pivots inside the block, packed into one number."""
    packed = np.zeros((len(fps), len(masks)), np.uint64)
    for i in range(families.shape[1]):
        distance = np.bitwise_count((fps[:, None] & masks) ^ families[None, :, i]).astype(np.uint64)
        packed = (packed << np.uint64(6)) | distance
    return packed


def _cell_links(fps: np.ndarray, spread: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of one cell's fingerprints."""
    table = np.bitwise_count(fps[:, None] ^ spread).astype(np.int8)
    left = np.arange(len(fps))
    links = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            node, front = front[0], front[1:]
            # Pivot filter, then verification of the survivors.
            near = left[(np.abs(table[left] - table[node]) <= RADIUS).all(axis=1)]
            near = near[np.bitwise_count(fps[near] ^ fps[node]) <= RADIUS]
            if len(near):
                links += [(int(fps[node]), int(fps[i])) for i in near]
                left = np.setdiff1d(left, near, assume_unique=True)
                front = np.concatenate([front, near])
    return links


def near_links(distinct: DataFrame) -> DataFrame:
    """Links `a`, `b` between distinct fingerprints (`fp`) whose components are those of all pairs within RADIUS bits."""
    b = blocks_for(distinct.count())
    families, spread = pivots(b)
    masks = np.array(block_masks(b), np.uint64)
    choices = list(combinations(range(b), b - RADIUS))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            packed = coordinates(fps, families, masks)
            for t, choice in enumerate(choices):
                key = np.zeros(len(fps), np.uint64)
                for j in choice:  # a hash of the coordinates; chance meetings are discarded later
                    key = (key ^ packed[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield pd.DataFrame({"table": np.int32(t), "key": key.view(np.int64), "fp": batch["fp"]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def links_of(rows: pd.DataFrame) -> pd.DataFrame:
            fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
            change = (rows["table"].to_numpy()[1:] != rows["table"].to_numpy()[:-1]) | (rows["key"].to_numpy()[1:] != rows["key"].to_numpy()[:-1])
            edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(rows)]])
            found: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(edges) > 1):
                found += _cell_links(fps[edges[k]: edges[k + 1]], spread)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows["table"] == rows["table"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            rest = rows[last]
            if len(rest) < len(rows):
                yield links_of(rows[~last])
        if rest is not None and len(rest):
            yield links_of(rest)

    keyed = distinct.select("fp").mapInPandas(keys, "table int, key long, fp long")
    dealt = keyed.repartition("table", "key").sortWithinPartitions("table", "key", "fp")
    return dealt.mapInPandas(cells, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id` (the smallest id reachable over links)."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    roots = components(near_links(nodes), "a", "b")
    # Fingerprints without a link are their own root.
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, "roots")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = stage(placed.join(smallest, "root").select("fp", "copies", "component_id"), "components")
    return join_groups(prints, of_fp, "fp", "copies", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- groups of similar texts ------------------------------------------------------------------------------------------------------
#
# First the method above: fingerprints within RADIUS bits meet in the tables of pivots, and their links are verified on the whole texts.
# At a similarity of 0.8 fingerprints differ in about ten bits, too many for those tables. What they cannot reach is completed with
# MinHash: cells are made of equal minima of shingle hashes, and two texts of that similarity share one of KEYS minima all
# but surely. Inside a cell every member is tied to the member that it agrees with most in MINIMA further minima, unless both are in one
# group already; such ties are verified on the whole texts. Groups with a failed tie between them make a family, and the whole texts of a
# family are compared between its groups. That is done in blocks of bounded size which give the links of a spanning forest, so no pair
# becomes a row.

KEYS, MINIMA = 8, 128
#: A tie is verified if at least this share of the minima agree; from CLOSE on the search takes it for certain at first.
HOPEFUL, CLOSE = 0.66, 0.9


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The different shingles of a text as sorted hashes (none for a text without words)."""
    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    one = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n = max(1, len(words) - shingle + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        mixed = (mixed ^ one[i: i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles by all shingles; two texts without words are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def _minima(hashes: np.ndarray, n: int) -> np.ndarray:
    draw = np.random.default_rng(5)
    factors = draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    if len(hashes):
        at_once = max(1, (1 << 15) // len(hashes))
        for i in range(0, n, at_once):
            mixed = factors[i: i + at_once, None] * hashes
            mixed ^= mixed >> np.uint64(32)
            out[i: i + at_once] = mixed.min(axis=1)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """`doc_id`, `fp`, `n` (different shingles), `keys` and `minima` (the last byte of MINIMA further minima) of every whole text; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).cast("binary").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, keys, minima = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                least = _minima(hashes, KEYS + MINIMA)
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                prints.append(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])
                sizes.append(len(hashes))
                keys.append(least[:KEYS].view(np.int64))
                minima.append(least[KEYS:].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary())],
                names=["doc_id", "fp", "n", "keys", "minima"])

    return rows.mapInArrow(compute, "doc_id long, fp long, n long, keys array<long>, minima binary")


def _agreement(minima: np.ndarray, sizes: np.ndarray, others: np.ndarray, node: int, similarity: float) -> np.ndarray:
    """Share of minima that `others` have in common with `node`; 0 where the numbers of shingles alone rule the similarity out."""
    agree = (minima[others] == minima[node]).mean(axis=1)
    small, large = np.minimum(sizes[others], sizes[node]), np.maximum(sizes[others], sizes[node])
    agree[small / np.maximum(large, 1) < similarity] = 0
    return agree


def _ties(cell: dict[str, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Ties of one cell: every member with the reached member that it agrees with most, if that is hopeful and of another group."""
    ids, sizes, minima, root = cell["rep"], cell["n"], cell["minima"], cell["root"]
    left = np.arange(1, len(ids))
    best, tied = np.zeros(len(ids)), np.full(len(ids), -1)
    queue, links = [0], []
    tie = lambda a, b: links.append((int(ids[a]), int(ids[b]))) if root[a] != root[b] else None
    while len(left):
        if not queue:
            # None is close: go on with the member that agrees most with those reached.
            node = left[np.argmax(best[left])]
            if tied[node] >= 0:
                tie(tied[node], node)
            left = left[left != node]
            queue.append(node)
            continue
        node = queue.pop()
        agree = _agreement(minima, sizes, left, node, similarity)
        better = (agree > best[left]) & (agree >= HOPEFUL)
        best[left[better]], tied[left[better]] = agree[better], node
        close = left[agree >= CLOSE]
        for i in close:
            tie(node, i)
        queue += close.tolist()
        left = left[agree < CLOSE]
    return links


def _per_cell(met: DataFrame, search: Callable[[dict[str, np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    """The different pairs `a` < `b` that `search` names in the cells (rows of equal `table` and `key`, two at least) of `met`."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def pairs_of(rows: pd.DataFrame) -> pd.DataFrame:
            columns = {c: np.frombuffer(b"".join(rows[c]), np.uint8).reshape(-1, MINIMA) if c == "minima" else rows[c].to_numpy() for c in rows.columns}
            cell = rows[["table", "key"]].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, [len(rows)]])
            out: list[tuple[int, int]] = []
            for lo, hi in zip(edges, edges[1:]):
                if hi - lo > 1:
                    out += search({c: v[lo:hi] for c, v in columns.items()})
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pd.DataFrame({"a": pairs.min(axis=1, initial=np.iinfo(np.int64).max), "b": pairs.max(axis=1, initial=np.iinfo(np.int64).min)})

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows["table"] == rows["table"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            rest = rows[last]
            if len(rest) < len(rows):
                yield pairs_of(rows[~last])
        if rest is not None and len(rest):
            yield pairs_of(rest)

    dealt = met.repartition("table", "key").sortWithinPartitions("table", "key", "rep")
    return dealt.mapInPandas(cells, "a long, b long").distinct()


def _whole_texts(rows: DataFrame, members: DataFrame) -> DataFrame:
    """`rep`, `text` (bytes) of the ids in `members`."""
    texts = rows.join(members, rows["doc_id"] == members["rep"], "left_semi").groupBy("doc_id").agg(F.first("text").alias("text"))
    return stage(texts.select(F.col("doc_id").alias("rep"), whole_text(F.col("text")).cast("binary").alias("text")), "tied-texts")


#: Pairs that are tested against one reading of their left text.
_PER_LEFT = 64


def _tested(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """`pairs` (`a`, `b`) with `similar`: whether the whole texts of `rows` reach the similarity.

    The left text of a pair is that of the member with more pairs; it travels once per _PER_LEFT of them. A task holds one left text's shingles and one batch of rows.
    """
    pairs = stage(pairs, "ties")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    members = stage(ends.groupBy("rep").agg(F.count("*").alias("n")), "tied")
    texts = _whole_texts(rows, members)
    sized = lambda end: members.select(F.col("rep").alias(end), F.col("n").alias(f"n_{end}"))
    turned = pairs.join(sized("a"), "a").join(sized("b"), "b")
    more = F.col("n_a") >= F.col("n_b")
    turned = turned.select("a", "b", F.when(more, F.col("a")).otherwise(F.col("b")).alias("left"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("right"), F.greatest("n_a", "n_b").alias("n"))
    parts = stage(turned.withColumn("part", F.pmod(F.xxhash64("right"), F.ceil(F.col("n") / _PER_LEFT).cast("long"))).drop("n"), "tie-parts")
    lefts = parts.select("left", "part").distinct().join(texts, F.col("left") == F.col("rep"))
    rights = parts.join(texts, F.col("right") == F.col("rep"))
    nothing = F.lit(None).cast("long")
    both = lefts.select("left", "part", nothing.alias("a"), nothing.alias("b"), "text").union(rights.select("left", "part", "a", "b", "text"))
    dealt = both.repartition("left", "part").sortWithinPartitions("left", "part", F.asc_nulls_first("a"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            found = []
            for i in range(len(a)):
                hashes = shingle_hashes(texts[i].as_py(), shingle)
                if a[i] is None:
                    known = hashes
                else:
                    found.append((a[i], b[i], jaccard(known, hashes) >= similarity))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "similar"])

    return stage(dealt.mapInArrow(verify, "a long, b long, similar boolean"), "tested")


#: A part of a family holds about so many texts and shingles; two parts are compared at once.
PART_ROWS, PART_SHINGLES = 1024, 1 << 18


def _block_links(sets: list[np.ndarray], roots: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest between the groups `roots` of a block's members, given as `sets` of shingles.

    Members of different sides are compared; if there is one side only, all are. Each is compared only with members of groups not yet reached.
    """
    across = side.min() != side.max()
    names, group = np.unique(roots, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    # Shingles of two members or more as bits.
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    bit = (np.cumsum(often) - 1)[place][often[place]].astype(np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)[often[place]]
    bits = np.zeros((len(sets), int(often.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))

    unreached, links = np.ones(len(sets), bool), []
    order = np.argsort(group, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(group))[:-1])
    for first in range(len(names)):
        if not unreached[members[first][0]]:
            continue
        unreached[members[first]] = False
        front = members[first].tolist()
        while front:
            node = front.pop()
            others = np.flatnonzero(unreached & (side != side[node]) if across else unreached)
            small, large = np.minimum(sizes[others], sizes[node]), np.maximum(sizes[others], sizes[node])
            others = others[small >= similarity * large - 1]  # one to spare for rounding
            both = np.bitwise_count(bits[others] & bits[node]).sum(axis=1, dtype=np.int64)
            every = sizes[others] + sizes[node] - both
            # As in `jaccard`: two texts without words are equal.
            similar = np.where(every > 0, both / np.maximum(every, 1), 1.0) >= similarity
            for found in np.unique(group[others[similar]]).tolist():
                links.append((int(roots[node]), int(names[found])))
                unreached[members[found]] = False
                front += members[found].tolist()
    return links


def _family_links(members: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links `a`, `b` between the groups (`root`) of each `family` in `members` (`rep`, `n`, `root`, `family`): all that their whole texts give.

    A family is dealt at random over parts of about PART_ROWS texts, and every two parts, or one with itself, are a block; a task holds the shingles of one block.
    """
    members = stage(members.groupBy("rep").agg(*(F.max(c).alias(c) for c in ("n", "root", "family"))), "family-members")
    parts = F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum("n") / PART_SHINGLES)).cast("int")
    families = stage(members.groupBy("family").agg(F.count("*").alias("texts"), parts.alias("parts")), "families")
    placed = join_groups(members, families, "family", "texts", members.count()).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    blocks = placed.join(_whole_texts(rows, members), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "root", "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple | None = None
        sets: list[np.ndarray] = []
        roots: list[int] = []
        side: list[int] = []

        def links() -> pa.RecordBatch:
            found = _block_links(sets, np.array(roots, np.int64), np.array(side), similarity) if sets and (block[1] == block[2] or side[0] != side[-1]) else []
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            family, i, j, part, root = (batch.column(c).to_pylist() for c in range(5))
            for k, here in enumerate(zip(family, i, j)):
                if here != block:
                    if sets:
                        yield links()
                    block, sets, roots, side = here, [], [], []
                sets.append(shingle_hashes(batch.column(5)[k].as_py(), shingle))
                roots.append(root[k])
                side.append(part[k])
        if sets:
            yield links()

    dealt = blocks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "part")
    return stage(dealt.mapInArrow(search, "a long, b long"), "family-links")


def _fingerprint_links(classes: DataFrame) -> DataFrame:
    """Links `a` < `b` between classes (`rep`) whose fingerprints differ in at most RADIUS bits, by the tables of pivots.

    Classes of one fingerprint are tied to the least of them, and that one to those of linked fingerprints.
    """
    nodes = stage(classes.groupBy(F.col("same.fp").alias("fp")).agg(F.min("rep").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    several = nodes.where("n > 1").select("fp", "least")
    equal = classes.select(F.col("same.fp").alias("fp"), "rep").join(several, "fp").where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    end = lambda c: nodes.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c))
    links = near_links(nodes).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    between = links.join(end("a"), "fp_a").join(end("b"), "fp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(between).distinct()


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`node`, `root` after more links (`a`, `b`): only roots are linked anew."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = stage(components(between, "a", "b"), "moved-roots").withColumnsRenamed({"node": "from", "root": "to"})
    kept = roots.join(moved, roots["root"] == moved["from"], "left").select("node", F.coalesce("to", "root").alias("root"))
    # Nodes that had no link before.
    fresh = moved.join(roots, moved["from"] == roots["node"], "left_anti").select(F.col("from").alias("node"), F.col("to").alias("root"))
    return stage(kept.union(fresh), "group-roots")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """`doc_id`, `component_id` (the smallest id reachable over texts that share at least `similarity` of their shingles).

    Texts with the same shingles are one class. Rows without id take no part. A pair is a candidate if its fingerprints meet in a table of pivots and differ in at most
    RADIUS bits, or if it shares a key and HOPEFUL of the minima (a byte of each, which agree by chance in one case of 256); at 0.8 that misses it with a chance of
    0.2^8 and 0.00004, and nothing is lost if others connect it. Ties that connect all candidates are tested on the whole texts; where one fails, all texts of the groups
    that such ties join are compared.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stage(sketches(rows, "doc_id", "text", shingle), "sketches")
    same = F.struct("fp", "n", F.xxhash64("keys", "minima"))
    tagged = found.withColumn("same", same)
    classes = stage(tagged.groupBy("same").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("minima").alias("minima")), "classes")

    tested = _tested(_fingerprint_links(classes), rows, shingle, similarity)
    roots = stage(components(tested.where("similar"), "a", "b"), "group-roots")

    # Only members of cells that others share take their minima along.
    keyed = classes.select("same", F.posexplode("keys").alias("table", "key"))
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").select("table", "key")
    met = keyed.join(shared, ["table", "key"]).join(classes.select("same", "rep", "minima"), "same").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    met = met.select("table", "key", "rep", F.col("same.n").alias("n"), "minima", F.coalesce("root", "rep").alias("root"))
    ties = _tested(_per_cell(met, lambda cell: _ties(cell, similarity)), rows, shingle, similarity)
    if not ties.where("similar").isEmpty():
        roots = _joined_roots(roots, ties.where("similar"))

    # Ties connect every hopeful pair of a cell. So groups without a failed tie to another are settled, and hopeful pairs between others lie within the
    # families that such ties make.
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    failed = ties.where(~F.col("similar")).join(end("a"), "a", "left").join(end("b"), "b", "left")
    families = components(failed.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "a", "b")
    families = stage(families.select(F.col("node").alias("root"), F.col("root").alias("family")), "group-families")
    if not families.isEmpty():
        grouped = classes.select("rep", F.col("same.n").alias("n")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        members = grouped.select("rep", "n", F.coalesce("root", "rep").alias("root")).join(families, "root")
        roots = _joined_roots(roots, _family_links(members, rows, shingle, similarity))

    placed = classes.join(roots, classes["rep"] == roots["node"], "left").select("same", "copies", F.coalesce("root", "rep").alias("component_id"))
    groups = stage(placed, "groups")
    return join_groups(tagged.select("doc_id", "same"), groups, "same", "copies", found.count()).select("doc_id", "component_id")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` with the smallest id of their group of similar texts, with all their columns.

    Rows with a null id stay. Of rows that repeat the kept id, all stay: they are one document.
    """
    found = similar_groups(docs, id_col, text_col, shingle, similarity)
    leave = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__leaving")).distinct()
    return docs.join(leave, docs[id_col] == leave["__leaving"], "left_anti")
