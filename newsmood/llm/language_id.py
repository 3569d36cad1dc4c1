"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. A language is a distribution over them; a word's probability is the sum
over all ways to cut it into pieces of the product of their probabilities, computed by the forward algorithm; a text's is the product
over its words. The languages' distributions come from the labelled texts by expectation-maximisation: a pass gives every
piece its expected count under the current distribution (forward-backward), starting from equal probabilities.

A word is the marker `▁` and the characters between white space. A character that is no piece has a piece of its own kind, with a
learned probability per language, so every word has a segmentation. A word longer than LONG characters is computed alone, with scaling; no text is
cut. Words repeat, so forward runs once per different word of a batch of texts.

What is gathered: expected counts of at most (languages x vocabulary), summed in each task before the shuffle. The model is broadcast:
languages times vocabulary, whatever the number of texts.

Edge cases: text that is null or has no letter gets `und` with score 0. If nothing is labelled every text gets `und`, score 0. Rows
with null language are not learned from but predicted. Ids may be null or repeat. Very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import fold, stage, whole_text
from newsmood.llm.token_counts import MARK, vocabulary

ROUNDS = 1
LONG = 32
#: Different words that a task holds at once.
TYPES = 300_000
REMEMBERED_WORDS = 300_000
UNKNOWN = "und"
#: Smoothing: so many expected counts are added, spread over the pieces as they occur in all languages.
ADDED = 1000.0
FLOOR = 1e-8

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 18


class Pieces:
    """The vocabulary as a hash table of piece -> number; number `unknown` stands for any other single character."""

    def __init__(self, path: str):
        pieces = vocabulary(path)
        self.number = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.size = self.unknown + 1
        self.longest = max(map(len, pieces))
        hashes = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = ((h + ord(c) + 1) * int(_MIX)) & ((1 << 64) - 1)
            hashes[i] = h
        assert len(np.unique(hashes)) == len(hashes) and hashes.all()
        # Open addressing with linear probing, filled once.
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        for i, h in enumerate(hashes):
            at = int(h >> np.uint64(64 - _SLOT_BITS))
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at], self.keys[at] = i, h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of the hashes, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        at = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        asked = np.arange(len(hashes))
        while len(asked):
            keys = self.keys.take(at)
            hit = np.flatnonzero(keys == hashes[asked])
            out[asked[hit]] = self.slots[at[hit]]
            # An empty slot (key 0) ends the search.
            more = np.flatnonzero((keys != 0) & (keys != hashes[asked]))
            asked, at = asked[more], (at[more] + 1) & (len(self.slots) - 1)
        return out

    def arcs(self, codes: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position: (start, rows, pieces) of the pieces that end there, over a matrix of character codes."""
        n, width = codes.shape
        ending: list[list] = [[] for _ in range(width + 1)]
        with np.errstate(over="ignore"):
            for start in range(width):
                hashes = np.zeros(n, np.uint64)
                for end in range(start + 1, min(width, start + self.longest) + 1):
                    rows = np.flatnonzero(lengths >= end)
                    if not len(rows):
                        break
                    hashes[rows] = (hashes[rows] + codes[rows, end - 1] + np.uint64(1)) * _MIX
                    found = self.find(hashes[rows])
                    if end == start + 1:
                        found[found < 0] = self.unknown
                    hit = found >= 0
                    if hit.any():
                        ending[end].append((start, rows[hit], found[hit]))
        return ending


_BUILT: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _BUILT:
        _BUILT[path] = Pieces(path)
    return _BUILT[path]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(lengths.max(initial=0))), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = flat
    return codes, lengths


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Indices of words of similar length, so that matrices have few empty cells."""
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable").tolist()
    for at in range(0, len(order), 8192):
        yield order[at: at + 8192]


def forward(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probabilities (words x languages); `p` is (pieces x languages)."""
    out = np.zeros((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for part in _by_length([words[i] for i in short]):
        rows = [short[i] for i in part]
        codes, lengths = _matrix([words[i] for i in rows])
        alpha = _alpha(pieces.arcs(codes, lengths), len(rows), codes.shape[1], p)
        out[rows] = np.log(alpha[lengths, np.arange(len(rows))])
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = forward_long(w, pieces, p)
    return out


def _alpha(ending: list, n: int, width: int, p: np.ndarray) -> np.ndarray:
    """Forward sums by position, word and language."""
    alpha = np.zeros((width + 1, n, p.shape[1]))
    alpha[0] = 1.0
    for end in range(1, width + 1):
        for start, rows, found in ending[end]:
            alpha[end][rows] += alpha[start].take(rows, axis=0) * p.take(found, axis=0)
    return alpha


def _long_arcs(word: str, pieces: Pieces, end: int) -> list[tuple[int, int]]:
    found = [(start, pieces.number[word[start:end]]) for start in range(max(0, end - pieces.longest), end) if word[start:end] in pieces.number]
    if not found or found[-1][0] != end - 1:
        found.append((end - 1, pieces.unknown))
    return found


def forward_long(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probabilities of one word of any length; sums are scaled to stay in range."""
    recent, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for end in range(1, len(word) + 1):
        offset = end - len(recent)
        now = sum(recent[start - offset] * p[piece] for start, piece in _long_arcs(word, pieces, end))
        recent = (recent + [now])[-pieces.longest:]
        top = np.max(recent, axis=0)
        scale += np.log(top)
        recent = [r / top for r in recent]
    return np.log(recent[-1]) + scale


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations; `counts` is (words x languages), as is the result (pieces x languages)."""
    out = np.zeros(p.shape)
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for part in _by_length([words[i] for i in short]):
        rows = [short[i] for i in part]
        codes, lengths = _matrix([words[i] for i in rows])
        ending = pieces.arcs(codes, lengths)
        n, width = len(rows), codes.shape[1]
        alpha = _alpha(ending, n, width, p)
        beta = np.zeros_like(alpha)
        share = counts[rows] / alpha[lengths, np.arange(n)]
        beta[lengths, np.arange(n)] = share
        numbers, amounts = [], []
        for end in range(width, 0, -1):
            for start, at, found in ending[end]:
                passed = beta[end].take(at, axis=0) * p.take(found, axis=0)
                numbers.append(found)
                amounts.append(alpha[start].take(at, axis=0) * passed)
                beta[start][at] += passed
        if numbers:
            number, amount = np.concatenate(numbers), np.concatenate(amounts)
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(number, amount[:, k], minlength=len(out))
    for i, w in enumerate(words):
        if len(w) > LONG:
            out += _expected_long(w, counts[i], pieces, p)
    return out


def _expected_long(word: str, count: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected counts of one long word: forward-backward in logarithms."""
    arcs = [_long_arcs(word, pieces, end) for end in range(1, len(word) + 1)]
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    alpha = np.full((len(word) + 1, p.shape[1]), -np.inf)
    alpha[0] = 0
    for end, found in enumerate(arcs, 1):
        alpha[end] = np.logaddexp.reduce([alpha[start] + logs[piece] for start, piece in found], axis=0)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    out = np.zeros(p.shape)
    for end in range(len(word), 0, -1):
        for start, piece in arcs[end - 1]:
            passed = beta[end] + logs[piece]
            out[piece] += np.exp(alpha[start] + passed - alpha[-1]) * count
            beta[start] = np.logaddexp(beta[start], passed)
    return out


def train(labelled: DataFrame, model_path: str, rounds: int = ROUNDS) -> dict:
    """The model from `text`, `lang`: `languages`, `prior`, `p` (pieces x languages)."""
    shares = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row per language
    languages = [r["lang"] for r in shares]
    size = _pieces(model_path).size
    p = np.full((size, max(1, len(languages))), 1.0 / size)
    number = {lang: i for i, lang in enumerate(languages)}
    spark = labelled.sparkSession
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(p)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, p = _pieces(model_path), shared.value
            seen = [Counter() for _ in languages]
            out = np.zeros(p.shape)

            def add():
                words = list(set().union(*seen))
                row = {w: i for i, w in enumerate(words)}
                counts = np.zeros((len(words), len(seen)))
                for k, c in enumerate(seen):
                    counts[np.fromiter(map(row.__getitem__, c), np.int64, len(c)), k] = np.fromiter(c.values(), np.float64, len(c))
                    c.clear()
                out[...] += expected([MARK + w for w in words], counts, pieces, p)

            for batch in batches:
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seen[number[lang]].update(text.split())
                    if sum(map(len, seen)) > TYPES:
                        add()
            add()
            at, k = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(out[at, k])], names=["piece", "language", "n"])

        summed = labelled.select("text", "lang").mapInArrow(count, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        counts = np.zeros(p.shape)
        found = stage(summed, "pieces").toPandas()  # at most vocabulary x languages rows
        counts[found["piece"], found["language"]] = found["n"]
        overall = (counts.sum(axis=1) + 0.01) / (counts.sum() + 0.01 * size)
        p = (counts + ADDED * overall[:, None]) / (counts.sum(axis=0) + ADDED)
        p = np.maximum(p, FLOOR)
    prior = np.array([r["n"] for r in shares], np.float64)
    return {"languages": languages, "prior": prior / max(1.0, prior.sum()), "p": p}


def predict(docs: DataFrame, model: dict, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `lang_pred`, `score` (the probability of that language) of every whole text; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    shared, room = docs.sparkSession.sparkContext.broadcast(model), REMEMBERED_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, model = _pieces(model_path), shared.value
        languages, p = model["languages"], model["p"]
        known: dict[str, int] = {}  # word -> its row of `logs`
        logs = np.zeros((room, len(languages)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [], []
            first = 0
            while first < len(texts):
                last, split, chars = first, [], 0
                while last < len(texts) and (last == first or chars < 1 << 20):
                    split.append(texts[last].split())
                    chars += len(texts[last])
                    last += 1
                fresh = list(set().union(*split).difference(known))
                if len(known) + len(fresh) > len(logs):
                    known.clear()
                    fresh = list(set().union(*split))
                    if len(fresh) > len(logs):  # one text with so many words
                        logs = np.zeros((len(fresh), len(languages)))
                if fresh and languages:
                    logs[len(known): len(known) + len(fresh)] = forward([MARK + w for w in fresh], pieces, p)
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                for text, words in zip(texts[first:last], split):
                    if not languages or not any(c.isalpha() for c in text):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = np.log(model["prior"]) + logs.take(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), axis=0).sum(axis=0)
                    best = int(np.argmax(total))
                    names.append(languages[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                first = last
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return fold(doc_id, 4) == 2


def languages(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score`: learned from the rows that are not held out, predicted for all."""
    labelled = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = predict(docs, train(labelled, model_path, rounds), model_path, id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
