"""Toxicity of texts after noisy-channel deobfuscation.

Disguised words ("1d10t", "i d i o t", "iiidiot", "sc.um") are restored before scoring. The channel model says which letters
an observed character may stand for, and which characters may be dropped (repeats, separators); together they make
a lattice. A character trigram model, counted over all documents, prefers likely spellings, and Viterbi decoding takes the
best path. Words of letters none of which is doubled have one path only and are taken as they are; restored words are added to what was
written, so restoring can only add evidence.

The scorer is fitted on labelled rows. Features of a text are its words, and the stems (first 4 and 5 letters) that
one or several of its different words share, with a share of all its words that grows with the level, so a long text does
not reach a level by its length. Features are hashed into BUCKETS buckets; a bucket weighs the lower confidence bound of its log odds for the toxic
label, if that is clearly positive. A text's evidence is the sum of its TOP largest weights; a monotone curve
fitted on the training rows turns it into a probability.

Bounds: at most about `sample` labelled rows (picked by a hash of their id) are used to fit; their ids are the only broadcast
rows. The model has BUCKETS weights, 28^3 trigrams and CURVE points, whatever the input. There is no shuffle of texts.

Edge cases: null and empty texts have no evidence and get the lowest score of the curve. Without labelled rows of
both kinds every score is the share of toxic rows in training (0 if there is none). A document labelled more than once
counts as toxic if one of its labels says so; null labels are skipped. Repeated rows get one result each; null ids are scored like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import fold, stage, whole_text

BUCKETS = 1 << 18
SAMPLE = 40_000
TOP = 3
#: The curve from evidence to probability has a point every 0.5, up to 30.
CURVE = 61
REMEMBERED_CHUNKS = 200_000
THRESHOLD = 0.7

# The letters that a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "*": "aeiou",
}
# Log probabilities of the channel.
AS_WRITTEN, AS_SIGN, DROP_REPEAT, DROP_SIGN, DROP_SPACE, BREAK = -0.05, -0.9, -0.8, -1.6, -0.4, -2.0

_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$|([@$])\1\1+$")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_N = 28


def _symbols() -> np.ndarray:
    """Byte to symbol: 0 break, 1 to 26 letters, 27 the first byte of any other character."""
    table = np.zeros(256, np.uint8)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[0xC0:] = 27
    return table


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, from all texts; at most 28^3 counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = _symbols(), np.zeros(_N**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for at in range(0, len(text), 1 << 20):
                    raw = np.frombuffer(text[max(0, at - 2): at + (1 << 20)], np.uint8)
                    s = np.concatenate([[0, 0] if at == 0 else [], table[raw[(raw & 0xC0) != 0x80]], [0]]).astype(np.int32)
                    counts += np.bincount(s[:-2] * (_N * _N) + s[1:-1] * _N + s[2:], minlength=_N**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    bytes_only = docs.select(whole_text(F.col(text_col)).cast("binary").alias("text"))
    counts = np.zeros(_N**3)
    for at, n in bytes_only.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    cube = counts.reshape(_N, _N, _N)
    two = cube.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one.sum() + _N)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((cube + 5 * p2) / (cube.sum(2, keepdims=True) + 5))


def _choices(text: str, i: int, spaced: bool) -> list[tuple[str, float]]:
    """What the character at `i` may stand for: a letter, a break (" ") or nothing ("")."""
    c = text[i]
    if c.isalpha():
        out = [(c, AS_WRITTEN)]
        if i and text[i - 1] == c:
            out.append(("", DROP_REPEAT))
        return out
    if c == " " and spaced:
        return [("", DROP_SPACE), (" ", BREAK)]
    out = [(letter, AS_SIGN) for letter in STANDS_FOR.get(c, "")]
    return [*out, ("", DROP_SIGN), (" ", BREAK)]


def decode(text: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest spelling of `text` (lower case) under the channel and the trigram model."""
    symbol = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
    states = {(0, 0): (0.0, None)}
    for i in range(len(text)):
        choices, after = _choices(text, i, spaced), {}
        for (a, b), (score, path) in states.items():
            for c, cost in choices:
                if c == "":
                    key, total, way = (a, b), score + cost, path
                else:
                    s = symbol(c)
                    key, total, way = (b, s), score + cost + model[a, b, s], (path, c)
                if key not in after or after[key][0] < total:
                    after[key] = (total, way)
        states = after
    path = max(((score + model[a, b, 0], path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


class Restorer(dict):
    """Chunk between white space -> what `of_word` says of its written and restored words, remembered for a bounded number of chunks."""

    def __init__(self, model: np.ndarray, of_words):
        super().__init__()
        self.model, self.of_words = model, of_words

    def words(self, chunk: str) -> set[str]:
        low = chunk.lower()
        plain = low.rstrip(".,;:!?")
        if plain.isalpha() and not _DOUBLE.search(plain):
            return {plain}
        found = set(_LETTERS.findall(low))
        core = _EDGE.sub("", low)
        if core and (not core.isalpha() or _DOUBLE.search(core)) and any(c.isalpha() for c in core):
            found.update(decode(core, self.model).split())
        return found

    def spaced(self, text: str) -> set[str]:
        """Words spelled out with white space; runs of one character only are no words."""
        found = set()
        for run in _SPACED.findall(text):
            characters = run.lower().split()
            if len(set(characters)) > 1:
                found.update(decode(" ".join(characters), self.model, spaced=True).split())
        return found

    def __missing__(self, chunk: str):
        if len(self) >= REMEMBERED_CHUNKS:
            self.clear()
        value = self[chunk] = self.of_words(self.words(chunk))
        return value

    def of_text(self, text: str) -> tuple[list, int]:
        """What was found in the text, and its number of different chunks."""
        chunks = set(text.split())
        found = [x for x in map(self.__getitem__, chunks) if x]
        extra = self.spaced(text)
        return found + ([self.of_words(extra)] if extra else []), len(chunks)


def _bases(words: set[str]) -> tuple[tuple[int, int, int], ...]:
    """Per word a number for itself, for its first 4 and for its first 5 letters."""
    digest = xxhash.xxh32_intdigest
    return tuple((digest("w" + w), digest("4" + w[:4]), digest("5" + w[:5])) for w in words if len(w) > 2)


#: Levels of a stem: so many different words, and such a share of all different words.
LEVELS = ((1, 0.0), (2, 0.004), (3, 0.008), (5, 0.016))


def _bucket(base: int, level: int) -> int:
    return (base + level * 0x9E3779B1) % BUCKETS


def _features(found: list, size: int) -> set[int]:
    """The feature buckets of a text with `size` different chunks, of which `found` holds the numbers of their words."""
    words = {word for part in found for word in part}
    stems = Counter(stem for word in words for stem in word[1:])
    out = {_bucket(word[0], 0) for word in words}
    for stem, n in stems.items():
        for level, (least, share) in enumerate(LEVELS, 1):
            if n >= least and n >= share * size:
                out.add(_bucket(stem, level))
    return out


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """`text`, `toxic` of the sampled training rows. The ids of the sample are broadcast: about `sample` rows at most."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stage(marks, "labels")
    share = min(1.0, sample / max(1, marks.count()))
    picked = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("id"), whole_text(F.col(text_col)).alias("text"))
    return rows.join(F.broadcast(picked), rows["id"] == picked["doc_id"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model: `letters` (trigrams), `weights` per bucket, `curve` of probabilities. `docs`: all; `labels`: those to learn from."""
    letters = character_model(docs, text_col)
    train = _labelled(docs, labels, id_col, text_col, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts, rows = Restorer(letters, _bases), np.zeros((2, BUCKETS), np.int32), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = int(toxic > 0)
                rows[kind] += 1
                counts[kind, list(_features(*restorer.of_text(text)))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), *(pa.array(np.append(counts[k, at], rows[k]).astype(np.int64)) for k in (0, 1))],
            names=["at", "clean", "toxic"])

    summed = train.mapInArrow(count, "at int, clean long, toxic long").groupBy("at").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    summed = stage(summed, "features")
    first = summed.where("at = -1").first()
    clean, toxic = (first["clean"], first["toxic"]) if first else (0, 0)
    if not clean or not toxic:
        share = 1.0 if toxic else 0.0
        return {"letters": letters, "weights": np.zeros(BUCKETS, np.float32), "curve": np.full(CURVE, share)}
    odds = F.log((F.col("toxic") + 1) / (toxic + 1)) - F.log((F.col("clean") + 1) / (clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    strong = summed.where("at >= 0 and toxic >= 3").select("at", (odds - 2.5 * error).alias("low")).where("low > 0.7")
    weights = np.zeros(BUCKETS, np.float32)
    for at, low in strong.collect():  # at most BUCKETS rows
        weights[at] = low

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = _evidence({"letters": letters, "weights": weights})
        counts = np.zeros((2, CURVE), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(toxic > 0), min(CURVE - 1, int(2 * evidence(text) + 0.5))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CURVE, dtype=np.int32)), pa.array(counts[0]), pa.array(counts[1])], names=["at", "clean", "toxic"])

    found = np.zeros((2, CURVE))
    for at, c, t in train.mapInArrow(histogram, "at int, clean long, toxic long").groupBy("at").agg(F.sum("clean"), F.sum("toxic")).collect():
        found[:, at] = c, t
    return {"letters": letters, "weights": weights, "curve": monotone(found[0], found[1])}


def monotone(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The non-decreasing probabilities that fit the counts best (pooled neighbours), between 0 and 1."""
    pools: list[list[float]] = []
    for c, t in zip(clean, toxic):
        if c + t == 0:
            if pools:
                pools[-1][2] += 1
            else:
                pools.append([0.0, 0.0, 1])
            continue
        pools.append([t, c + t, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, w2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, pools[-1][2] + w2]
    return np.concatenate([np.full(w, (t + 0.02) / (n + 0.04) if n else 0.0) for t, n, w in pools])


def _evidence(model: dict):
    weights = model["weights"]

    weighty = set(np.flatnonzero(weights).tolist())
    levels = range(1, len(LEVELS) + 1)
    stems: dict[str, bool] = {}

    def stem(kind: str, letters: str) -> bool:
        known = stems.get(kind + letters)
        if known is None:
            if len(stems) >= REMEMBERED_CHUNKS:
                stems.clear()
            base = xxhash.xxh32_intdigest(kind + letters)
            known = stems[kind + letters] = any(_bucket(base, level) in weighty for level in levels)
        return known

    def telling(words: set[str]) -> tuple[tuple[int, int, int], ...]:
        """The words that may add to a weight; most words cannot."""
        return _bases({w for w in words if stem("4", w[:4]) or stem("5", w[:5]) or _bucket(xxhash.xxh32_intdigest("w" + w), 0) in weighty})

    restorer = Restorer(model["letters"], telling)

    def evidence(text: str) -> float:
        found, size = restorer.of_text(text)
        return float(sum(sorted((weights[b] for b in _features(found, size)), reverse=True)[:TOP])) if found else 0.0

    return evidence


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `evidence`, `score` of every whole text; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 1.3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence, curve = _evidence(model), model["curve"]
        for batch in batches:
            found = np.array([evidence(t) for t in batch.column(1).to_pylist()], np.float64)
            p = np.interp(2 * found, np.arange(CURVE), curve)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(p)], names=["doc_id", "evidence", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, evidence double, score double")


def held_out(doc_id):
    """Rows that are never learned from."""
    return fold(doc_id, 3) == 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` (1 from THRESHOLD on), `evidence`."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), id_col, text_col, sample)
    return score(docs, model, id_col, text_col).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def keep_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns; no shuffle of texts."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), id_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = _evidence(model)
        for batch in batches:
            p = [np.interp(2 * evidence(t or ""), np.arange(CURVE), model["curve"]) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x < THRESHOLD for x in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
