"""Word-piece counts by a linear longest-match automaton, without building the pieces.

The vocabulary of a public tokenizer is put into a trie. Every node has a failure link and the number of pieces
that following the link takes off the front (the "popped" count), so one pass over the characters gives the number of
greedy longest-match pieces: when the next character has no edge, the popped count is added and the link
followed. Nothing is built but the count.

A word is the marker `▁` followed by the characters between white space. A character that no piece begins with counts as
one piece per UTF-8 byte. Counts of words are remembered per worker in a table of bounded size; that is only a
short cut, a word outside it is counted again.

Edge cases: null or empty text and text of white space only have 0 pieces and 0 words. Texts of any length are read whole;
a word of any length takes time in proportion to its length. Ids may be null or repeat: one row per input row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import whole_text

MARK = "▁"
REMEMBERED_WORDS = 300_000


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]


class LongestMatch:
    """Trie with failure links and popped counts over `pieces`."""

    def __init__(self, pieces: list[str]):
        edges: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for char in piece:
                after = edges[node].get(char)
                if after is None:
                    after = edges[node][char] = len(edges)
                    edges.append({})
                    ends.append(False)
                node = after
            ends[node] = node != 0
        # A node that ends a piece pops exactly that piece and restarts. Any other node pops what its parent pops and
        # then reads its last character from where the parent's link leads. -1: no piece is a prefix of the rest.
        link, popped = [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for char, node in edges[parent].items():
                if ends[node]:
                    link[node], popped[node] = 0, 1
                else:
                    at, count = link[parent], popped[parent]
                    while at != -1 and char not in edges[at]:
                        count += popped[at]
                        at = link[at]
                    if at != -1:
                        link[node], popped[node] = edges[at][char], count
                queue.append(node)
        self.edges, self.ends, self.link, self.popped = edges, ends, link, popped
        self._up = {child: (parent, char) for parent, out in enumerate(edges) for char, child in out.items()}

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces of `word`; a character no piece starts with counts its UTF-8 bytes."""
        edges, link, popped = self.edges, self.link, self.popped
        total, node, i, n = 0, 0, 0, len(word)
        while True:
            if i < n and (after := edges[node].get(word[i])) is not None:
                node = after
                i += 1
                continue
            if node == 0:
                if i >= n:
                    return total
                total += len(word[i].encode("utf-8", "surrogatepass"))
                i += 1
            elif link[node] != -1:
                total += popped[node]
                node = link[node]
            else:
                # A character in what was read cannot be covered: cut one piece off and read the rest again.
                read, node = self._path(node), 0
                taken, rest = self._cut(read)
                total += taken
                i -= len(rest)

    def _path(self, node: int) -> str:
        out = []
        while node:
            node, char = self._up[node]
            out.append(char)
        return "".join(reversed(out))

    def _cut(self, read: str) -> tuple[int, str]:
        """One greedy step over `read`: pieces taken, and what is left to read."""
        node, best = 0, 0
        for k, char in enumerate(read, 1):
            node = self.edges[node][char]
            if self.ends[node]:
                best = k
        if best:
            return 1, read[best:]
        return len(read[0].encode("utf-8", "surrogatepass")), read[1:]


class _Counts(dict):
    """Counts of words seen, emptied when it has REMEMBERED_WORDS entries."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        count = self[word] = self.automaton.count(MARK + word)
        return count


_BUILT: dict[str, _Counts] = {}


def _counts(path: str) -> _Counts:
    if path not in _BUILT:
        _BUILT[path] = _Counts(LongestMatch(vocabulary(path)))
    return _BUILT[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_words`, `n_tokens`, `longest_word_tokens` of every whole text; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    key = docs.select(F.col(id_col)).schema[0].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _counts(model_path).__getitem__
        for batch in batches:
            words, tokens, longest = [], [], []
            for text in batch.column(1).to_pylist():
                sizes = list(map(get, text.split()))
                words.append(len(sizes))
                tokens.append(sum(sizes))
                longest.append(max(sizes, default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(longest, pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "longest_word_tokens"],
            )

    return rows.mapInArrow(count, f"doc_id {key.simpleString()}, n_words long, n_tokens long, longest_word_tokens long")
