"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with token share p gets the weight p^a / sum(p^a). The exponent a in [0, 1] is bisected: a = 1 keeps the shares,
a = 0 weighs all sources alike. `target_entropy` (a fraction of the largest possible entropy) asks for the largest a
whose weights are at least that even; `max_repeats` asks for an a at which no source is read more often than
that. If both are given the repetition limit wins. If even a = 1 breaks the limit (a budget above `max_repeats` times
the corpus), a = 1 is used and every budget is cut to the limit.

Without `budget` the budget is the smallest one that reads every source at least once, so no document is lost.

A source's budget is spent in passes. Its documents are dealt into `blocks` blocks by a digest of their id; every pass
reads the blocks in an order of its own, as long as the budget covers them; in the block that it does not cover,
documents are taken in the order of another digest, as long as they fit. So a hot source is never sorted as a
whole: only its block totals and one block of documents are.

Edge cases: null source counts as the empty string, null text as empty. Sources without a token get weight 0 and budget 0, but
their documents are read once. Documents with equal or null ids fall into one block and are ordered together. Documents
of 0 tokens cost nothing. A document longer than what is left of the budget is not read in that pass. Empty input gives
empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood.llm.common import WORD_PATTERN, stage, whole_text

BLOCKS = 1024
#: The bisection runs several levels at once: each pass over the source table tries this many exponents.
GRID = 32
ROUNDS = 8


def _digest(*parts: Column) -> Column:
    """The first 60 bits of an MD5 over the parts: the same number in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """`doc_id`, `source`, `tokens` of every document; a token is a run of characters that are not ASCII white space."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.regexp_count(whole_text(F.col(text_col)), F.lit(WORD_PATTERN)).cast("long").alias("tokens"),
    )


def _measure(shares: DataFrame, low: float, high: float, budget: int | None) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest number of repeats) on a grid between `low` and `high`, highest exponent first."""
    grid = [high - (high - low) * i / GRID for i in range(GRID + 1)]
    tried = shares.where("tokens > 0").select("share", "tokens", "total", F.explode(F.array(*map(F.lit, grid))).alias("a"))
    power = F.pow("share", F.col("a"))
    sums = tried.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("share") * F.col("a")).alias("s"),
        F.max(power / F.col("share")).alias("most"), F.min(power / F.col("share")).alias("least"),
        F.max("total").alias("total"),
    )
    out = []
    for r in sums.orderBy(F.col("a").desc()).collect():
        entropy = 0.0 if r["z"] is None else float(math.log(r["z"]) - r["s"] / r["z"])
        repeats = r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget / r["total"]
        out.append((r["a"], entropy, repeats))
    return out


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> float:
    """The bisected exponent. `shares` has `share`, `tokens`, `total` per source; only grid sums reach the driver."""
    n = shares.where("tokens > 0").count()
    even = math.log(n) if n else 0.0

    def search(holds) -> float:
        """The end of [0, 1] nearest to 0 at which `holds` flips from the value that it has at 1."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            points = _measure(shares, low, high, budget)
            k = next((i for i, p in enumerate(points) if not holds(p)), None)
            if k is None:
                return low
            if k == 0:
                return high
            low, high = points[k][0], points[k - 1][0]
        return high

    if n == 0:
        return 1.0
    found = 1.0
    if target_entropy is not None:
        # The largest exponent that is even enough: from 1 downwards, the first at which the entropy reaches the target.
        flat = search(lambda p: p[1] < target_entropy * even - 1e-12)
        found = flat
    if max_repeats is not None:
        least = search(lambda p: p[2] <= max_repeats + 1e-12)
        found = max(found, least) if target_entropy is not None else least
    return found


def weights(
    tokens: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None
) -> DataFrame:
    """`source`, `tokens`, `share`, `exponent`, `weight`, `budget` (tokens), one row per source."""
    per_source = stage(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = per_source.agg(F.sum("tokens")).first()[0] or 0
    shares = per_source.select("source", "tokens", F.lit(total).alias("total"), (F.col("tokens") / F.lit(max(total, 1))).alias("share"))
    a = exponent(shares, target_entropy, max_repeats, budget)
    powered = shares.withColumn("power", F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    sums = powered.agg(F.sum("power").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("power"))).alias("cover")).first()
    z, cover = sums["z"] or 1.0, sums["cover"] or 0.0
    spend = F.col("power") * F.lit(cover) if budget is None else F.col("power") / F.lit(z) * F.lit(float(budget))
    if max_repeats is not None:
        spend = F.least(spend, F.col("tokens") * F.lit(float(max_repeats)))
    # A hair above whole numbers for rounding. The hair does not grow with a source, so where every source is read at least once that is said outright.
    spent = F.floor(F.coalesce(spend, F.lit(0.0)) + 1e-6).cast("long")
    if budget is None and (max_repeats is None or max_repeats >= 1):
        spent = F.greatest(spent, F.col("tokens"))
    return powered.select(
        "source", "tokens", "share", F.lit(a).alias("exponent"),
        F.when(F.col("tokens") > 0, F.col("power") / F.lit(z)).otherwise(0.0).alias("weight"),
        spent.alias("budget"),
    )


def draws(tokens: DataFrame, plan: DataFrame, blocks: int = BLOCKS, seed: int = 1) -> DataFrame:
    """One row per document and pass that reads it: `doc_id`, `source`, `tokens`, `pass`, `block`, `place`.

    `place` in [0, 1) is where the block starts in its source's budget: reading all sources in the order of
    (place, source, pass, block) keeps the weights at every point.
    """
    block = F.pmod(_digest(F.lit(seed), F.col("doc_id")), F.lit(blocks)).cast("int")
    dealt = stage(tokens.withColumn("block", block), "dealt")
    budgets = plan.select("source", "budget", F.col("tokens").alias("all"))
    sizes = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    passes = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.greatest("all", F.lit(1)))).cast("int")
    # At most `blocks` rows per source and pass: the windows below do not grow with the documents.
    turns = sizes.join(budgets, "source").select("*", F.explode(F.sequence(F.lit(1), passes)).alias("pass"))
    order = Window.partitionBy("source", "pass").orderBy(
        _digest(F.lit(seed), F.lit("block"), F.col("source"), F.col("pass"), F.col("block")), "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before + (F.col("pass") - 1) * F.col("all"))
    turns = turns.select(
        "source", "block", "pass", "size", (F.col("budget") - F.col("start")).alias("left"),
        (F.col("start") / F.greatest("budget", F.lit(1))).alias("place"))
    turns = stage(turns.where("left > 0 or size = 0 and left = 0"), "turns")
    whole = dealt.join(turns.where("size <= left").drop("size", "left"), ["source", "block"])
    cut = dealt.join(turns.where("size > left").drop("size"), ["source", "block"])
    within = Window.partitionBy("source", "block", "pass").orderBy(
        _digest(F.lit(seed), F.lit("doc"), F.col("pass"), F.col("doc_id")), "doc_id", "tokens")
    fits = cut.withColumn("upto", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))).where("upto <= left")
    names = ["doc_id", "source", "tokens", "pass", "block", "place"]
    return whole.select(*names).unionByName(fits.select(*names))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None,
    blocks: int = BLOCKS, seed: int = 1,
) -> DataFrame:
    """The draws of a mixture of `docs`; see the module."""
    tokens = stage(source_tokens(docs, id_col, text_col, source_col), "tokens")
    return draws(tokens, weights(tokens, target_entropy, max_repeats, budget), blocks, seed)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of `docs`, each as often as it is drawn, with the columns of `docs` only."""
    drawn = mix(docs, id_col, text_col, source_col, **how)
    times = drawn.groupBy("doc_id").agg(F.countDistinct("pass").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    joined = rows.join(times, rows["id"].eqNullSafe(times["doc_id"]))
    repeated = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select("row.*")
