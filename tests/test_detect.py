"""Asset detection with a small catalogue of our own."""

import pytest

from newsmood.operators import detect

CATALOGUE = [
    ("kelp", "kelp", False), ("kelp", "sea weed", False), ("tin", "TIN", True), ("bank", "Bank of the Isles", False), ("pair", "KLP/TIN", True),
    ("index", "T&K 40", False), ("dot", "K.L. Corp.", False), ("sign", "$$", False),
]


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame(CATALOGUE, "asset_id string, alias string, is_case_sensitive boolean")


def found(spark, aliases, *texts, **how):
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(texts)], "article_id int, title string, body string")
    out = {i: {} for i in range(len(texts))}
    for r in detect.match_assets(detect.with_sentences(df), aliases, **how).collect():
        out[r.article_id][r.asset_id] = [s.id for s in r.sentences]
    return out


#: A catalogue that is broadcast, and one that is too large for it.
SIZES = pytest.mark.parametrize("how", [{}, {"broadcast_aliases": 0}])


@SIZES
def test_whole_words_case_and_signs(spark, aliases, how):
    cases = {
        "Kelpie races": set(), "KELP, again": {"kelp"}, "Sea  weed on the shore": {"kelp"}, "A tin of fish": set(), "TIN at a high": {"tin"},
        "TINs": set(), "the bank of the isles waits": {"bank"}, "the bank of isles": set(), "KLP/TIN slips": {"pair", "tin"}, "t&k 40 closes": {"index"},
        "T&K 400": set(), "K.L. Corp. sails": {"dot"}, "a $$ b": {"sign"}, "$$$": {"sign"}, "a$$": set(),
    }
    got = found(spark, aliases, *((t, "") for t in cases), **how)
    assert {t: set(got[i]) for i, t in enumerate(cases)} == cases


@SIZES
def test_mentions_and_their_neighbours(spark, aliases, how):
    got = found(
        spark, aliases,
        ("Morning", "One. Two. The kelp came. Four. Five."),
        ("Kelp a", " ".join(f"Kelp {c}." for c in "bcdefgh")),
        ("Kelp", "A. B. C. D. Then kelp. F. G."),
        **how,
    )
    assert got[0]["kelp"] == ["S3", "S4", "S5"]
    assert got[1]["kelp"] == ["S1", "S2", "S3", "S4", "S5", "S6"]
    assert got[2]["kelp"] == ["S1", "S2", "S5", "S6", "S7"]


def test_aliases_far_into_a_sentence_and_a_body(spark, aliases):
    """Nothing is cut before matching, and the evidence is stored whole."""
    sentence, body = "wave " * 120 + "and kelp.", "Calm day. " * 90 + "TIN was loaded."
    df = spark.createDataFrame([(1, "Log", sentence), (2, "Log", body)], "article_id int, title string, body string")
    got = {(r.article_id, r.asset_id): r.sentences for r in detect.mention_rows(df, aliases).collect()}
    assert any(s.text == sentence.strip() for s in got[1, "kelp"])
    assert got[2, "tin"][-1].text == "TIN was loaded."


def test_stored_mentions_are_left_out(spark, aliases):
    df = spark.createDataFrame([(1, "kelp and TIN", "")], "article_id int, title string, body string")
    stored = spark.createDataFrame([(1, "kelp")], "article_id int, asset_id string")
    assert [r.asset_id for r in detect.mention_rows(df, aliases, stored).collect()] == ["tin"]


@SIZES
def test_without_a_limit_nothing_is_left_out(spark, aliases, how):
    text = " ".join(f"Kelp {i}." if i % 3 else "Other words." for i in range(1, 60))
    got = found(spark, aliases, ("Log", text), limit=None, **how)[0]["kelp"]
    assert got == [f"S{i}" for i in range(1, 61)]
    assert len(found(spark, aliases, ("Log", text), limit=9, **how)[0]["kelp"]) == 9


def test_stop_words_do_not_anchor_in_a_large_catalogue(spark):
    """Every alias is met on its rarest word, so an alias with a very common word costs as little as any other."""
    aliases = spark.createDataFrame([("isle", "Bank of the Isles", False), ("none", "the unheardof", False)], "asset_id string, alias string, is_case_sensitive boolean")
    df = spark.createDataFrame([(i, "the bank of the storm", "") for i in range(300)] + [(300, "the bank of the isles", "")], "article_id int, title string, body string")
    got = detect.match_assets(detect.with_sentences(df), aliases, broadcast_aliases=0).collect()
    assert [(r.article_id, r.asset_id) for r in got] == [(300, "isle")]
    compiled = detect.compile_aliases(aliases)
    assert {tuple(r["keys"]) for r in compiled.collect()} == {("isles", "bank", "the", "of"), ("unheardof", "the")}


def test_sentences_are_built_once(spark, aliases, tmp_path):
    spark.createDataFrame([(1, "kelp", "and TIN.")], "article_id int, title string, body string").write.parquet(str(tmp_path / "a"))
    df = detect.mention_rows(spark.read.parquet(str(tmp_path / "a")), aliases)
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "BroadcastHashJoin" in final and "SortMergeJoin" not in final
