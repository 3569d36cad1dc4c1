"""Exact dedup and source mixing against plain versions."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsmood.llm import exact_dedup, mixing
from tests.conftest import rows
from tests.llm.helpers import ODD, docs, random_texts


def plain_report(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in pairs:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"max_words": 1}])
def test_report(spark, sizes):
    """Also with a filter so small that every row is a candidate."""
    texts = ODD + random_texts(200) + ["hot"] * 150 + random_texts(50)
    pairs = list(enumerate(texts, 1)) + [(None, "hot"), (None, "only without id"), (3, " \t\n")]
    got = exact_dedup.report(docs(spark, pairs, clashing=True), **sizes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_report(pairs)


def test_unique_rows_are_not_flagged(spark):
    flagged = exact_dedup.flag_repeats(docs(spark, [f"text {i}" for i in range(500)] + ["twice"] * 2), F.col("text"))
    found = flagged.groupBy("maybe").count().collect()
    counts = {r["maybe"]: r["count"] for r in found}
    assert counts[False] > 450 and counts[True] >= 2


def test_kept_rows_keep_their_columns(spark):
    pairs = [(1, "a"), (2, "b"), (5, "a"), (4, None), (3, ""), (5, "a"), (None, "c")]
    df = docs(spark, pairs, clashing=True)
    kept = exact_dedup.keep_rows(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in rows(kept)), key=repr) == sorted([(2, "b"), (5, "a"), (4, None), (None, "c")], key=repr)


def test_empty(spark):
    assert exact_dedup.report(docs(spark, [])).count() == 0 and exact_dedup.keep_rows(docs(spark, [])).count() == 0


SOURCES = {i: "big" if i <= 300 else "mid" if i <= 400 else "small" for i in range(1, 431)}


@pytest.fixture(scope="module")
def corpus(spark):
    return docs(spark, random_texts(430, seed=3, length=(20, 60)), sources=SOURCES).cache()


def tokens_of(corpus):
    return mixing.source_tokens(corpus, "doc_id", "text", "source")


def test_without_targets_nothing_changes(spark, corpus):
    got = mixing.mix(corpus).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(range(1, 431)) and {r["pass"] for r in got} == {1}


def test_target_entropy_is_met(spark, corpus):
    plan = rows(mixing.weights(tokens_of(corpus), target_entropy=0.9))
    entropy = -sum(r["weight"] * math.log(r["weight"]) for r in plan)
    assert entropy == pytest.approx(0.9 * math.log(3), abs=1e-6) and sum(r["weight"] for r in plan) == pytest.approx(1)
    a = plan[0]["exponent"]
    powers = {r["source"]: r["share"] ** a for r in plan}
    assert all(r["weight"] == pytest.approx(powers[r["source"]] / sum(powers.values())) for r in plan)


@pytest.mark.parametrize(("large", "small", "power"), [
    (136537401957, 6588125533, 0.596), (136917913277, 2619891353, 0.35), (133668158866, 8926304660, 0.533), (136889265147, 2927459097, 0.519)])
def test_large_sources_are_read_whole(spark, monkeypatch, large, small, power):
    monkeypatch.setattr(mixing, "exponent", lambda *_: power)
    tokens = spark.createDataFrame([(1, "a", large), (2, "b", small)], "doc_id long, source string, tokens long")
    assert all(r["budget"] >= r["tokens"] for r in rows(mixing.weights(tokens)))
    cut = rows(mixing.weights(tokens, max_repeats=0.5))
    assert all(r["budget"] <= r["tokens"] * 0.5 + 1 for r in cut)


def test_repetition_limit_is_kept(spark, corpus):
    plan = rows(mixing.weights(tokens_of(corpus), target_entropy=1.0, max_repeats=2.0))
    repeats = [r["budget"] / r["tokens"] for r in plan]
    assert max(repeats) == pytest.approx(2.0, abs=1e-3) and min(repeats) == pytest.approx(1.0)


@pytest.mark.parametrize("budget", [4000, 20_000])
def test_budgets_are_spent_and_not_exceeded(spark, corpus, budget):
    tokens = tokens_of(corpus).cache()
    plan = mixing.weights(tokens, target_entropy=0.95, budget=budget)
    spent = Counter()
    drawn = mixing.draws(tokens, plan, blocks=16).collect()
    for r in drawn:
        spent[r["source"]] += r["tokens"]
    for r in rows(plan):
        # At most one document of every pass may be left out at the cut.
        assert r["budget"] - 60 <= spent[r["source"]] <= r["budget"]
    passes = Counter((r["doc_id"], r["pass"]) for r in drawn)
    assert max(passes.values()) == 1
    full = {s: max((r["pass"] for r in drawn if r["source"] == s)) - 1 for s in spent}
    for doc, source in SOURCES.items():
        assert sum(1 for d, _ in passes if d == doc) >= full[source]


def test_orders_differ_between_passes(spark, corpus):
    drawn = mixing.mix(corpus, target_entropy=1.0, max_repeats=4.0, blocks=16).where("source = 'small'").collect()
    order = lambda p: [b for _, b in sorted({(r["place"], r["block"]) for r in drawn if r["pass"] == p})]
    assert sorted(order(1)) == sorted(order(2)) and order(1) != order(2)


def test_odd_rows(spark):
    pairs = list(enumerate(ODD, 1)) + [(None, "no id"), (2, "again")]
    df = docs(spark, pairs, sources={1: None, 4: None})
    got = mixing.mix(df)
    assert got.count() == len(pairs)
    kept = mixing.mixed_rows(docs(spark, pairs, clashing=True))
    assert kept.count() == len(pairs) and kept.columns[-1] == "score"
    assert mixing.mix(docs(spark, [])).count() == 0


def test_rows_are_repeated_as_drawn(spark, corpus):
    how = {"target_entropy": 1.0, "max_repeats": 1.5}
    drawn = Counter(r["doc_id"] for r in mixing.mix(corpus, **how).collect())
    assert Counter(r["doc_id"] for r in mixing.mixed_rows(corpus, **how).collect()) == drawn and set(drawn) == set(SOURCES)
