"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Tokens are lower-cased (A-Z) words between ASCII white space, and one end token per text. The model is

    p(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1)

with counts from the training texts; v is the token before (a start mark for the first). The weights l depend on the bucket of the
context's frequency, floor(log2(c(v) + 1)). They are learned by expectation-maximisation on held-out counts: one fold of the training texts (DELETED
of FOLDS) is taken out of the counts, and the weights maximise its likelihood under the counts of the others. Scoring uses the
counts of all training texts. V + 1 is the vocabulary with one unknown word, so the score is comparable with the add-one base.

Counts are exact per key (`chunks`): words by 64-bit hashes, pairs by 46-bit hashes or more (40 bits and the bucket). What is gathered grows with
the corpus; the driver gets totals and a histogram of bounded size (context buckets x probability bins).

Edge cases: null and empty texts are the end token alone. With nothing to learn from, N = V = 0: every count is 0 and the
model is uniform over one unknown word (scores 0). If the deleted fold has no text the weights are equal. Ids may be null (they are
hashed as the empty string) or repeat; every row is scored. Very long texts are one document in one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood.llm import chunks
from newsmood.llm.common import fold, stage

FOLDS, HELD_OUT, DELETED = 7, 2, 3
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
WORD, PAIR = 0, 1
#: Bins per octave of the histogram that the weights are learned from.
FINE = 4
OCTAVES = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MASK = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hashes of the token before, first token of each text), the end token included."""
    get = _Hashes().__getitem__
    parts, starts, n = [], np.zeros(len(texts) + 1, np.int64), 0
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        parts.append(np.array([END]))
        n += len(words) + 1
        starts[i + 1] = n
    token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[starts[:-1]] = START
    return token, before, starts


def pair_keys(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    key = (before * np.uint64(0x9E3779B97F4A7C15) + token) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    return key * np.uint64(0xD6E8FEB86659FD93)


def _sums(inverse: np.ndarray, mask: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(inverse[mask], minlength=n)


def _totals(sent: pa.Table, buckets: int) -> pa.Table:
    """What a bucket answers to every chunk that sent it keys."""
    bucket = sent["bucket"][0].as_py()
    chunk, apart = np.array(sent["chunk"]), np.array(sent["chunk"]) >= buckets
    kinds, keys, counts = np.array(sent["kind"]), sent["keys"].to_pylist(), sent["more"].to_pylist()
    out = []
    for kind in (WORD, PAIR):
        at = np.flatnonzero(kinds == kind)
        if not len(at):
            continue
        decoded = [np.frombuffer(keys[i], "<u8") if kind == WORD else chunks.from_narrow(keys[i]) for i in at]
        numbers = [chunks.from_planes(counts[i]).astype(np.int64) for i in at]
        unique, inverse = np.unique(np.concatenate(decoded), return_inverse=True)
        every = np.bincount(inverse, np.concatenate(numbers), len(unique)).astype(np.int64)
        from_apart = np.concatenate([n if a else np.zeros_like(n) for n, a in zip(numbers, apart[at])])
        kept = every - np.bincount(inverse, from_apart, len(unique)).astype(np.int64)
        ends = np.cumsum([len(d) for d in decoded])
        for i, end, d in zip(at, ends, decoded):
            own = inverse[end - len(d): end]
            # A deleted chunk needs the counts without its fold, and then the counts with it.
            asked = every[own] if not apart[i] else np.concatenate([kept[own], every[own]])
            out.append((int(chunk[i]), bucket, kind, chunks.planes(asked, chunks.TOTAL)))
        if kind == WORD:
            real = unique != START
            totals = [every[real].sum(), (every[real] > 0).sum(), kept[real].sum(), (kept[real] > 0).sum()]
            out.append((-1, bucket, kind, np.array(totals, "<i8").tobytes()))
    return chunks.table(["chunk", "bucket", "kind", "totals"], out, chunks.ANSWERED)


def count_keys(rows: DataFrame, buckets: int) -> DataFrame:
    """Job 1: `chunks.ANSWERED` with the counts of every chunk's words and pairs; chunk -1 holds each bucket's totals."""
    edges = chunks.bucket_edges(buckets)

    def send(docs: pa.Table) -> pa.Table:
        chunk = docs["chunk"][0].as_py()
        learned, deleted = (np.array(docs[c].to_pylist(), bool) for c in ("train", "apart"))
        token, before, starts = tokens(docs["text"].to_pylist())
        train = np.repeat(learned, np.diff(starts))
        out = []
        for kind, keys in ((WORD, np.append(token, np.full(int(learned.sum()), START))), (PAIR, pair_keys(before, token))):
            # The start mark is counted once per training text, as the context of its first token.
            mask = np.append(train, np.ones(int(learned.sum()), bool)) if kind == WORD else train
            unique, inverse = np.unique(keys, return_inverse=True)
            counts = _sums(inverse, mask, len(unique))
            for b, part in chunks.split(unique, edges):
                sent = unique[part].astype("<u8").tobytes() if kind == WORD else chunks.narrow(unique[part], edges[b], buckets)
                out.append((b, chunk, kind, sent, chunks.planes(counts[part])))
        del deleted
        return chunks.table(chunks.SENT_NAMES, out, chunks.SENT)

    sent = chunks.per_chunk(rows, send, chunks.SENT)
    return sent.groupBy("bucket").applyInArrow(lambda t: _totals(t, buckets), chunks.ANSWERED)


def _counts_of(docs: pa.Table, answers: pa.Table, half: int | None):
    """(starts, c(w), c(v), c(v, w)) per token of a chunk. `half`: of a deleted chunk, 0 without its fold and 1 with it."""
    token, before, starts = tokens(docs["text"].to_pylist())
    found = []
    kinds, buckets = np.array(answers["kind"]), np.array(answers["bucket"])
    data = answers["totals"].to_pylist()
    for kind, keys in ((WORD, np.append(token, START)), (PAIR, pair_keys(before, token))):
        unique, inverse = np.unique(keys, return_inverse=True)
        at = np.flatnonzero(kinds == kind)
        parts = [chunks.from_planes(data[i], chunks.TOTAL) for i in at[np.argsort(buckets[at])]]
        if half is not None:
            parts = [p[half * (len(p) // 2): (half + 1) * (len(p) // 2)] for p in parts]
        totals = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        if kind == WORD:
            if len(totals) < len(unique):  # no training text here: the start mark was not sent
                totals = np.insert(totals, np.searchsorted(unique, START), 0)
            word = totals[inverse[:-1]]
            context = np.empty_like(word)
            context[1:] = word[:-1]
            found += [word, context]
        else:
            found.append(totals[inverse])
    return starts, *found, token


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context + 1.0)[1] - 1


def _estimates(word, context, pair, n: int, v: int):
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        one = word / n if n else np.zeros(len(word))
    return two, one, 1.0 / (v + 1)


def learn_weights(histogram: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """EM per context bucket. `histogram`: rows (bucket, bin of f2, bin of f1, count); bin 0 is probability 0."""
    value = lambda b: np.where(b > 0, 2.0 ** (-(b - 1) / FINE), 0.0)
    weights = np.full((OCTAVES, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5  # a context never seen has no pairs
    for bucket in np.unique(histogram[:, 0]) if len(histogram) else []:
        rows = histogram[histogram[:, 0] == bucket]
        parts = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), uniform)])
        w = weights[bucket].copy()
        for _ in range(rounds):
            share = w[:, None] * parts
            share = share / share.sum(axis=0) * rows[:, 3]
            # Half a count each: an estimate that the fold never needed keeps some weight for texts that do.
            free = 0.5 * (weights[bucket] > 0)
            w = (share.sum(axis=1) + free) / (rows[:, 3].sum() + free.sum())
        weights[bucket] = w
    return weights


def _first_contexts(context: np.ndarray, starts: np.ndarray, texts: int) -> np.ndarray:
    context[starts[:-1]] = texts
    return context


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` (log10 probabilities) of every whole text."""
    number = fold(F.col(id_col), FOLDS)
    rows, buckets = chunks.dealt(docs, id_col, text_col, apart=number == DELETED)
    key = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("train", fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    answers = stage(count_keys(rows, buckets), "lm-counts")
    totals = np.zeros(4, np.int64)
    for r in answers.where("chunk = -1").select("totals").collect():  # 32 bytes per bucket
        totals += np.frombuffer(bytes(r["totals"]), "<i8")
    n, v, n_kept, v_kept = map(int, totals)
    texts = docs.select((number != HELD_OUT).alias("train"), (number == DELETED).alias("apart")).agg(
        F.count_if("train").alias("all"), F.count_if(F.col("train") & ~F.col("apart")).alias("kept")).first()
    answers = answers.where("chunk >= 0")

    def histogram(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = np.zeros((0, 4), np.int64)
        if len(docs):
            starts, word, context, pair, _ = _counts_of(docs, answers, 0)
            context = _first_contexts(context, starts, texts["kept"])
            two, one, _ = _estimates(word, context, pair, n_kept, v_kept)
            bins = lambda p: np.where(p > 0, np.minimum(np.round(-FINE * np.log2(np.maximum(p, 1e-18))), FINE * OCTAVES - 2) + 1, 0).astype(np.int64)
            size = FINE * OCTAVES
            code = (_bucket(context) * size + bins(two)) * size + bins(one)
            unique, n = np.unique(code, return_counts=True)
            out = np.stack([unique // size**2, unique // size % size, unique % size, n], axis=1)
        return pa.table({c: pa.array(out[:, i]) for i, c in enumerate(("bucket", "two", "one", "n"))})

    apart = chunks.with_answers(rows.where("apart"), answers.where(F.col("chunk") >= buckets), histogram, "bucket long, two long, one long, n long")
    found = apart.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()  # a bounded number of bins
    weights = learn_weights(np.array([tuple(r) for r in found], np.int64).reshape(-1, 4), 1.0 / (v_kept + 1))

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        if len(docs):
            chunk = docs["chunk"][0].as_py()
            starts, word, context, pair, _ = _counts_of(docs, answers, 1 if chunk >= buckets else None)
            context = _first_contexts(context, starts, texts["all"])
            two, one, zero = _estimates(word, context, pair, n, v)
            w = weights[_bucket(context)] if n else np.array([[0.0, 0.0, 1.0]])
            p = w[:, 0] * two + w[:, 1] * one + w[:, 2] * zero
            base = np.log10(word + 1.0) - np.log10(n + 1.0 * (v + 1))
            sums = lambda x: np.add.reduceat(x, starts[:-1])
            columns = [np.diff(starts), sums((word > 0).astype(np.int64)), sums(base), sums(np.log10(p))]
        names = ("n_tokens", "n_known", "base_score", "score")
        return pa.table({"doc_id": docs["doc_id"], **{c: pa.array(x) for c, x in zip(names, columns)}})

    out = chunks.with_answers(rows, answers, score, f"doc_id {key}, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
