"""Trained operators: exact counts, brute-force sums, held-out accuracy, odd rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newsmood.llm import chunks, language_id, lm_scoring, multi_index, toxicity
from tests.conftest import rows
from tests.llm.helpers import ODD, docs, random_texts
from tests.llm.test_near_duplicates import words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# ---- language model ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [12_000_000, 4000])
def test_scores_equal_a_plain_model(spark, monkeypatch, chunk):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk)
    pairs = list(enumerate(ODD + random_texts(120, vocabulary=60), 1)) + [(None, "one"), (4, "one")]
    got = lm_scoring.scores(docs(spark, pairs, clashing=True)).collect()
    texts = [(i, [*words(t), None]) for i, t in pairs]
    kept = lambda i: fold(i, 7) not in (2, 3)
    train = lambda i: fold(i, 7) != 2

    def counts(some):
        one, two, starts = Counter(), Counter(), 0
        for i, w in texts:
            if some(i):
                one.update(w)
                two.update(zip(["<s>", *w], w))
                starts += 1
        return one, two, starts

    def parts(model, before, w):
        one, two, starts = model
        context = starts if before == "<s>" else one[before] if before is not None else 0
        n = sum(one.values())
        return context, (two[before, w] / context if context else 0), one[w] / n, 1 / (len(one) + 1)

    # Weights from the deleted fold by plain EM, on exact probabilities.
    model, seen = counts(kept), {}
    for i, w in texts:
        if fold(i, 7) == 3:
            for before, token in zip(["<s>", *w], w):
                context, *p = parts(model, before, token)
                seen.setdefault(int(math.log2(context + 1)), []).append(p)
    weights = {}
    for bucket, p in seen.items():
        p, x = np.array(p), np.array([1 / 3] * 3 if bucket else [0, 0.5, 0.5])
        for _ in range(60):
            share = p * x
            free = 0.5 * np.array([bool(bucket), True, True])
            x = ((share / share.sum(1, keepdims=True)).sum(0) + free) / (len(p) + free.sum())
        weights[bucket] = x
    model = counts(train)
    one, n = model[0], sum(model[0].values())
    want = {}
    for i, w in texts:
        base = sum(math.log10((one[t] + 1) / (n + len(one) + 1)) for t in w)
        score = 0.0
        for before, token in zip(["<s>", *w], w):
            context, *p = parts(model, before, token)
            bucket = int(math.log2(context + 1))
            score += math.log10(np.dot(weights.get(bucket, [1 / 3] * 3 if bucket else [0, 0.5, 0.5]), p))
        want.setdefault(i, []).append((fold(i, 7) == 2, len(w), sum(one[t] > 0 for t in w), n, base, score))
    assert len(got) == len(pairs)
    for r in got:
        near = [x for x in want[r["doc_id"]] if tuple(r)[1:5] == x[:4]]
        assert any(r["base_score"] == pytest.approx(x[4]) and r["score"] == pytest.approx(x[5], rel=0.05, abs=0.1) for x in near)


def test_totals_beyond_32_bits():
    keys, counts = np.array([5], "<u8").tobytes(), chunks.planes(np.array([3_000_000_000]))
    sent = chunks.table(chunks.SENT_NAMES, [(0, c, lm_scoring.WORD, keys, counts) for c in (0, 1, 2)], chunks.SENT)
    got = {r["chunk"]: bytes(r["totals"]) for r in lm_scoring._totals(sent, 2).to_pylist()}
    assert chunks.from_planes(got[0], 8).tolist() == [9_000_000_000]
    assert chunks.from_planes(got[2], 8).tolist() == [6_000_000_000, 9_000_000_000]


def test_the_model_is_a_distribution():
    """Over the vocabulary and one unknown word the probabilities of a context add up to one."""
    pair, word, n, v = np.array([3, 1, 0, 0]), np.array([5, 2, 3, 0]), 10, 3
    two, one, zero = lm_scoring._estimates(word, np.full(4, 4), pair, n, v)
    w = lm_scoring.learn_weights(np.array([[2, 3, 5, 7], [2, 0, 9, 2]]), zero)[2]
    assert (w[0] * two + w[1] * one + w[2] * zero).sum() == pytest.approx(1) and w.sum() == pytest.approx(1)


def test_nothing_to_score_or_learn(spark):
    assert lm_scoring.scores(docs(spark, [])).count() == 0
    alone = next(i for i in range(1, 99) if fold(i, 7) == 2)
    (got,) = rows(lm_scoring.scores(docs(spark, [(alone, "nothing learned")])))
    assert (got["train_tokens"], got["n_known"], got["n_tokens"], got["base_score"], got["score"]) == (0, 0, 3, 0.0, 0.0)


# ---- language identification -----------------------------------------------------------------------------------------


def segmentations(word, pieces, p):
    """The sum over all segmentations, by listing them."""
    total = np.zeros(p.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[start:k])
                start = k
        parts.append(word[start:])
        numbers = [pieces.number.get(x, pieces.unknown if len(x) == 1 else None) for x in parts]
        if None not in numbers:
            total += np.prod([p[i] for i in numbers], axis=0)
    return total


def test_forward_sums_all_segmentations():
    pieces = language_id._pieces(MODEL)
    p = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T
    some = ["▁the", "▁ther", "▁états", "▁😀x", "▁", "▁abcdefg", "▁éé"]
    got = np.exp(language_id.forward(some, pieces, p))
    for word, value in zip(some, got):
        assert value == pytest.approx(segmentations(word, pieces, p))
    long = "▁" + "water" * 30
    assert np.isfinite(language_id.forward([long], pieces, p)).all()
    monkey = language_id.forward_long("▁the", pieces, p)
    assert np.exp(monkey) == pytest.approx(got[0])


def test_expected_counts_are_derivatives():
    """The expected count of a piece is p times the derivative of the log probability."""
    pieces = language_id._pieces(MODEL)
    p = np.random.default_rng(1).dirichlet(np.ones(pieces.size), 1).T
    some = ["▁there", "▁hé", "▁the" + "re" * 20]
    counts = np.array([[2.0], [1.0], [3.0]])
    got = language_id.expected(some, counts, pieces, p)
    for piece in ("▁the", "re", "▁", "▁there", "h"):
        i = pieces.number[piece]
        up = p.copy()
        up[i] *= 1 + 1e-6
        change = ((language_id.forward(some, pieces, up) - language_id.forward(some, pieces, p)) * counts).sum() / 1e-6
        assert got[i, 0] == pytest.approx(change, abs=1e-3)


def test_forward_sums_lie_by_position():
    """A position's sums of all words lie side by side, which is what a step reads and writes."""
    pieces = language_id._pieces(MODEL)
    p = np.random.default_rng(2).dirichlet(np.ones(pieces.size), 3).T
    some = ["▁the", "▁", "▁abcd", "▁éé"]
    codes, lengths = language_id._matrix(some)
    sums = language_id._alpha(pieces.arcs(codes, lengths), len(some), codes.shape[1], p)
    assert sums.shape == (codes.shape[1] + 1, len(some), 3)
    for i, word in enumerate(some):
        assert sums[len(word), i] == pytest.approx(segmentations(word, pieces, p))


def test_pieces_are_found_by_their_hashes():
    """Every piece, behind others in the same slots too, and nothing else."""
    pieces = language_id._pieces(MODEL)
    filled = np.flatnonzero(pieces.slots >= 0)
    assert (pieces.find(pieces.keys[filled]) == pieces.slots[filled]).all() and len(filled) == pieces.unknown
    near = pieces.keys[filled] + np.uint64(1)
    assert (pieces.find(near[~np.isin(near, pieces.keys)]) == -1).all()


def test_more_words_than_are_remembered(spark, monkeypatch):
    df = docs(spark, [*ODD, *random_texts(60, seed=31, vocabulary=500)])
    key = lambda r: r["doc_id"]
    model = language_id.train(df.where("text is not null").withColumn("lang", F.concat("lang", F.col("doc_id") % 3)), MODEL)
    want = sorted(rows(language_id.predict(df, model, MODEL)), key=key)
    monkeypatch.setattr(language_id, "REMEMBERED_WORDS", 40)
    assert sorted(rows(language_id.predict(df, model, MODEL)), key=key) == want


def test_languages(spark):
    rng = random.Random(0)
    makers = {"aa": ["ka", "lo", "ni", "ta"], "bb": ["sch", "ung", "er", "ein"], "cc": ["éau", "que", "oi", "ment"]}
    data, i = [], 0
    for lang, parts in makers.items():
        for _ in range(60):
            i += 1
            text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 30)))
            data.append((i, text, lang, "s", 1))
    odd = [(1000 + k, t, None, "s", 1) for k, t in enumerate(ODD)] + [(None, "kalo nita", None, "s", 1)]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    got = rows(language_id.languages(df, MODEL))
    truth = {d[0]: d[2] for d in data}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[1000 + k]["lang_pred"] == "und" for k in range(len(ODD))] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert by_id[None]["lang_pred"] == "aa"
    nothing = language_id.languages(df.withColumn("lang", F.lit(None).cast("string")), MODEL)
    assert {(r["lang_pred"], r["score"]) for r in rows(nothing)} == {("und", 0.0)}
    assert language_id.languages(df.limit(0), MODEL).count() == 0


# ---- nearest neighbours --------------------------------------------------------------------------------------------------


def plain_nearest(data, k):
    usable = [(i, np.array(v, np.float64)) for i, v in data if i is not None and v is not None and len(v) == 8
              and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in usable:
        if q % 20 == 0:
            scored = sorted((-float((x * y).sum()), i) for i, y in usable if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_code_search_finds_all_codes_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    codes[:900] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    index = multi_index.Index(codes)
    for radius in (0, 1, 3, 7, 12, 24, 31, 64):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= radius)
        assert index.within(codes[0], radius).tolist() == want.tolist()


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    data = [(i, (centres[i % 12] * rng.uniform(0.2, 3) + 0.1 * rng.normal(size=8)).tolist()) for i in range(1, 900)]
    data += [(2000 + i, centres[0].tolist()) for i in range(300)]  # a third are equal
    odd = [(3000, None), (3020, [0.0] * 8), (3040, [float("nan")] + [1.0] * 7), (3060, [float("inf")] + [1.0] * 7), (3080, [None] + [1.0] * 7), (3100, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("block", F.lit("x"))
    got = {}
    for r in multi_index.nearest(df, F.col("vec_id") % 20 == 0, block=256, query_block=32).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = plain_nearest(data + odd, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    assert all(s == pytest.approx(dict(want[q])[i], abs=1e-12) for q in want for i, s in got[q] if i in dict(want[q]))
    assert got[2000] == want[2000]  # ties in the order of ids


def test_few_candidates_and_none(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in (0, 20, 1, 2)], "vec_id long, embedding array<double>")
    got = multi_index.nearest(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 2), (20, 2, 1), (20, 3, 0)]
    assert multi_index.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ---- toxicity ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spelling(spark):
    plain = ["the idiot said a stupid thing about the moron and the loser", "silly words in a calm sentence", "that is the worst kind of thing"] * 40
    return toxicity.character_model(docs(spark, plain))


@pytest.mark.parametrize(
    ("seen", "meant"), [("1d10t", "idiot"), ("stup!d", "stupid"), ("m0r0n", "moron"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("i-d-i-o-t", "idiot")])
def test_decoding(spelling, seen, meant):
    assert toxicity.decode(seen, spelling) == meant


def test_decoding_is_the_best_path(spelling):
    """Viterbi equals trying all readings."""
    for text in ("1d1o", "s7t", "l0o", "a.b"):
        best = {}
        for reading in itertools.product(*[toxicity._choices(text, i, False) for i in range(len(text))]):
            word = "".join(c for c, _ in reading)
            a = b = 0
            total = sum(cost for _, cost in reading)
            for c in [*word, " "]:
                s = 0 if c == " " else ord(c) - 96
                total += spelling[a, b, s]
                a, b = b, s
            best[word] = max(total, best.get(word, -1e9))
        assert toxicity.decode(text, spelling) == max(best, key=best.get)


def test_spaced_words(spelling):
    restorer = toxicity.Restorer(spelling, lambda words: words)
    assert "idiot" in restorer.spaced("you i d i o t there") and restorer.spaced("a a a a a a") == set()


@pytest.mark.parametrize(("text", "meant"), [("you i  d\ni o t there", "idiot"), ("a b", None), ("so b a d it", "bad")])
def test_gaps_of_any_white_space(spelling, text, meant):
    found = toxicity.Restorer(spelling, lambda words: words).spaced(text)
    assert bool(found) == (meant is not None) and (meant != "idiot" or meant in found)


@pytest.mark.parametrize(("chunk", "meant"), [("stuupid", "stupid"), ("iidiot", "idiot"), ("loserr,", "loser"), ("silly", "silly")])
def test_doubled_letters_are_restored(spelling, chunk, meant):
    assert meant in toxicity.Restorer(spelling, lambda words: words).words(chunk)


def test_toxicity(spark):
    rng = random.Random(1)
    calm = "river stone garden window paper letter music market bridge cloud".split()
    bad = ["grobnak", "vilthar", "snorkup"]
    disguised = {"grobnak": "gr0bn4k", "vilthar": "v.i.l.t.h.a.r", "snorkup": "s n o r k u p"}
    data, labels = [], []
    for i in range(1, 901):
        w = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                word = rng.choice(bad)
                w.insert(rng.randrange(len(w)), disguised[word] if fold(i, 3) == 1 and i % 2 else word)
        data.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    odd = list(enumerate(ODD, 2000)) + [(None, "river"), (2000, "garden")]
    marks = spark.createDataFrame([*labels, (1, 0, None), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, data + odd, clashing=True)
    got = rows(toxicity.toxicity(df, marks))
    assert len(got) == len(data) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] and r["doc_id"] <= 900]
    right = [r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]
    assert sum(right) / len(right) > 0.97
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] is None or r["doc_id"] >= 2000)
    kept = toxicity.keep_rows(df, marks)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if not r["predicted"])


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rows(toxicity.toxicity(docs(spark, ODD), none))} == {0.0}
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


def test_monotone_curve():
    curve = toxicity.monotone(np.array([90, 5, 0, 8, 0, 1]), np.array([10, 5, 0, 2, 0, 9]))
    assert (np.diff(curve) >= 0).all() and 0 < curve[0] < curve[-1] < 1
