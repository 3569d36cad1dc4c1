"""Packing documents into sequences of equal capacity by Karmarkar-Karp multiway differencing.

A document is its token ids and one end id. Full sequences are cut off its front; they need no packing. The rest is cut into
pieces of at most `piece` ids, which are dealt into blocks by a hash of their document, about `windows` sequences' worth of
ids in a block. Inside a block, differencing spreads the pieces over k = ceil(ids / capacity) windows: every partial partition is
a list of k window sums; the two with the largest spread are merged, largest window of one onto smallest of the other,
until one partition is left. Its windows are nearly equal. If the largest exceeds the capacity, k rises by one and the
block is packed again. So a block wastes little more than one window, whatever the documents' lengths.

Tokenizing is one pass without a shuffle; only narrow piece rows (no text, no ids) are shuffled. The tokenizer treats the words of a text
separately, so ids are remembered per word, in a table of bounded size per worker; words outside it
are tokenized again. Block number and size depend on totals only, never on a key: there are no hot groups.

Edge cases: null or empty text is the end id alone. Repeated rows and equal or null ids are packed as separate documents, told apart by a
row number. A piece never exceeds a sequence. Empty input gives an empty result. Very long texts are tokenized in one task,
span by span of other texts.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import stage, whole_text

CAPACITY = 2048
PIECE = 512
WINDOWS = 256
END_ID = 1
REMEMBERED, YOUNG = 600_000, 100_000


def multiway(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp differencing: indices of `sizes` in `k` lists with nearly equal sums."""
    if not sizes or k <= 1:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    # A partial partition: (-spread, number, windows in use as (sum, items) from large to small). Unused windows are 0.
    heap = [(-size, i, [(size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = a + b
        if len(merged) > k:
            # Opposing order: the smallest windows of b meet the largest of a.
            both = len(merged) - k
            meeting = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - both:], reversed(b[len(b) - both:]))]
            merged = a[: len(a) - both] + b[: len(b) - both] + meeting
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, number, merged))
        number += 1
    windows = [list(_leaves(items)) for _, items in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def _leaves(items) -> Iterator[int]:
    stack = [items]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack.extend(top)
        else:
            yield top


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their number rises from the least possible until every window fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = multiway(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += max(1, k // 256)


class _Ids(dict):
    """Ids of the tokenizer's words as little-endian bytes.

    The tokenizer normalises a text (composition, white space, case) and cuts it into runs of letters, digits, other characters and a few contractions, whose ids
    do not depend on each other. Text of Latin-1 is cut the same way here; other text, for which the tokenizer's tables of letters and marks need not be Python's, is
    only cut at white space. The ids of what is cut are looked up. The first REMEMBERED words stay, later ones are kept in `young`, which is emptied when it has
    YOUNG entries. A text that holds a special token, or a word that Python cuts in another way (it has None for its ids), is tokenized whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        self.young: dict[str, bytes] = {}
        self.special = [t["content"] for t in described["added_tokens"]]
        self.normal = self.tokenizer.normalizer.normalize_str
        suffix = described["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = bool(suffix) and token.endswith(suffix)

    def words(self, text: str) -> list[str] | None:
        """The words of a text of Latin-1, or of other text what lies between white space, with a blank before it; None if it has to be tokenized whole."""
        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return _ASCII_WORDS(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if any(c in text for c in _SEPARATORS) else [" " + chunk for chunk in text.split()]
        return _LATIN_WORDS(text.lower())

    def learn(self, new: set[str]) -> dict[str, bytes | None]:
        """The ids of words that are not remembered; None for words that have none of their own."""
        if len(self.young) > YOUNG:
            self.young.clear()
        found = {w: self.young[w] for w in new if w in self.young}
        odd = lambda w: self.normal(w) != w or (not w.isalpha() and any(c.isalnum() and not c.isdecimal() for c in w))
        changed = {w for w in new if not w.isascii() and w[0] != " " and odd(w)}
        words = [w for w in new if w not in found and w not in changed and w[0] != " "]
        into: dict[str, bytes] = {}
        self._learn_each([w for w in new if w[0] == " " and w not in found], into)
        # Many words at once; their ids are parted at the tokens that end a word.
        groups = [words[i: i + 256] for i in range(0, len(words), 256)]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) != len(group):
                self._learn_each(group, into)
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(group, last):
                into[word] = data[start:end]
                start = end
        (self if len(self) < REMEMBERED else self.young).update(into)
        return found | into | dict.fromkeys(changed)

    def _learn_each(self, words: list[str], into: dict[str, bytes]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            into[word] = np.array(found.ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


#: Fixed value: how the tokenizer cuts normalised text into words, for ASCII and for Latin-1, where nothing is composed. Python takes superior numbers and fractions for
#: letters; words with one are found when they are learned.
_ASCII_WORDS = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\x0b\x0c\ra-z0-9]+").findall
_LATIN_WORDS = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w \t\n\x0b\x0c\r\x85\xa0]|_)+").findall
#: Characters that Python splits at but the tokenizer does not count as white space.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_BUILT: dict[str, _Ids] = {}
#: Words are looked up for so many characters at a time, which bounds what has to be remembered at once.
_SPAN = 1 << 20


def _places_of_none(values: list) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def _document_ids(known: _Ids, texts: list[str]) -> list[bytes]:
    """Ids of whole texts: words are looked up once, and only those that are not remembered are gathered and learned."""
    cut, missing = [], set()
    for text in texts:
        words = known.words(text)
        ids = [] if words is None else list(map(known.get, words))
        holes = _places_of_none(ids)
        missing.update([words[i] for i in holes])
        cut.append((words, ids, holes))
    learned = known.learn(missing)
    out = []
    for text, (words, ids, holes) in zip(texts, cut):
        for i in holes:
            ids[i] = learned[words[i]]
        out.append(known.whole(text) if words is None or None in ids else b"".join(ids))
    return out


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID,
    capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = False,
) -> DataFrame:
    """`doc_id`, `row` (a number per input row), `start`, `length`, `ids_crc32`, `doc_tokens` (and `ids`) per piece."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), whole_text(F.col(text_col)).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _BUILT:
            _BUILT[tokenizer] = _Ids(tokenizer)
        known, end = _BUILT[tokenizer], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(2)
            sizes = pc.binary_length(texts).to_pylist()
            first = 0
            while first < len(sizes):
                last, total = first, 0
                while last < len(sizes) and (last == first or total + sizes[last] <= _SPAN):
                    total += sizes[last]
                    last += 1
                take, starts, lengths, crcs, totals, kept = [], [], [], [], [], []
                for i, ids in enumerate(_document_ids(known, texts.slice(first, last - first).to_pylist()), first):
                    ids += end
                    total = len(ids) // 4
                    at = 0
                    while at < total:
                        n = capacity if total - at >= capacity else min(piece, total - at)
                        part = ids[4 * at: 4 * (at + n)]
                        take.append(i)
                        starts.append(at)
                        lengths.append(n)
                        crcs.append(zlib.crc32(part))
                        totals.append(total)
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                        at += n
                taken = pa.array(take, pa.int64())
                columns = [batch.column(0).take(taken), batch.column(1).take(taken), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
                names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                first = last

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
    windows: int = WINDOWS, with_ids: bool = False, **cut,
) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: each piece lies in one sequence, without gaps from 0."""
    found = stage(pieces(docs, tokenizer, id_col, text_col, capacity=capacity, with_ids=with_ids, **cut), "pieces")
    loose = found.where(F.col("length") < capacity)
    ids = loose.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, -(-ids // (windows * capacity)))
    dealt = loose.withColumn("block", F.pmod(F.xxhash64("row", "doc_id", "start"), F.lit(blocks)).cast("int"))
    full = found.where(F.col("length") >= capacity).withColumns({
        # Full sequences are numbered from -1 downwards, over the staged table.
        "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})

    def arrange(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["row", "start"], ignore_index=True)
        sizes = block["length"].tolist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        number = int(block["block"].iloc[0]) << 32 if len(sizes) else 0
        for w, items in enumerate(pack_block(sizes, capacity)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = number + w, at
                at += sizes[i]
        return block.assign(sequence_id=sequence, offset=offset).drop(columns="block")

    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long"
    schema += (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    packed = dealt.groupBy("block").applyInPandas(arrange, schema)
    return packed.unionByName(full)
