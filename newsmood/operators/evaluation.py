"""Evaluation of a scorer against labelled examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers
from newsmood.session import checkpoint


def format_sentences(sentences: Column) -> Column:
    """`[S1] text` lines."""
    return F.array_join(
        F.transform(sentences, lambda s: F.concat(F.lit("["), s["id"], F.lit("] "), s["text"])), "\n"
    )


_LINE = r"^\[(S\d+)\]\s?(.*)$"


def _lines(cell: Column) -> Column:
    trimmed = F.transform(F.split(cell, r"\r?\n", -1), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x != "")


def parse_sentences(cell: Column) -> Column:
    """Sentences of a cell, NULL if a line is malformed."""
    lines = _lines(cell)
    parsed = F.transform(
        lines,
        lambda x: F.struct(F.regexp_extract(x, _LINE, 1).alias("id"), F.regexp_extract(x, _LINE, 2).alias("text")),
    )
    return F.when(F.forall(lines, lambda x: x.rlike(_LINE)), parsed)


def parse_ids(cell: Column) -> Column:
    """Ids separated by blanks, commas or semicolons, in upper case."""
    return F.filter(F.split(F.upper(cell), r"[\s,;]+", -1), lambda x: x != "")


def check_labels(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """Every label row with its kind (labelled, unlabelled, skipped, rejected) and its problems.

    `order` numbers the rows of the file; the first row of an example_id is not a duplicate. The
    first of each id is found by a partial minimum, so a repeated id does not gather in one task.
    """
    first = rows.groupBy("example_id").agg(F.min(order).alias("first_row"))
    gold = F.lower(F.trim("gold_stance"))
    cells = rows.join(first, "example_id").withColumns(
        {
            "gold": gold,
            "sentences": parse_sentences(F.col("numbered_sentences")),
            "gold_ids": parse_ids(F.col("gold_supporting_sentence_ids")),
            "labelled_by": F.coalesce(F.nullif(F.trim("labelled_by"), F.lit("")), F.lit("unknown")),
        }
    )
    known_type = F.col("asset_type").isin(config.ASSET_TYPES)
    allowed = F.array_contains(numbers.allowed_stances(F.col("asset_type")), F.col("gold"))
    kind = (
        F.when(F.col("gold") == "", "unlabelled")
        .when(F.col("gold") == config.SKIP_LABEL, "skipped")
        .when(~known_type | ~allowed | F.col("sentences").isNull(), "rejected")
        .otherwise("labelled")
    )
    known_ids = F.transform("sentences", lambda s: s["id"])
    unknown = F.filter("gold_ids", lambda i: ~F.array_contains(known_ids, i))
    bad_line = F.get(F.filter(_lines(F.col("numbered_sentences")), lambda x: ~x.rlike(_LINE)), F.lit(0))
    stances = F.concat_ws("/", numbers.allowed_stances(F.col("asset_type")))
    rejected, labelled = F.col("kind") == "rejected", F.col("kind") == "labelled"
    says = lambda problem, *values: F.format_string(config.LABEL_PROBLEMS[problem], "example_id", *values)
    problems = F.array_compact(
        F.array(
            F.when(F.col(order) != F.col("first_row"), says("duplicate")),
            F.when(rejected & ~known_type, says("asset_type", "asset_type")),
            F.when(rejected & known_type & ~allowed, says("stance", "gold", "asset_type", stances)),
            F.when(rejected & known_type & allowed, says("line", bad_line)),
            F.when(labelled & (F.size(unknown) > 0), says("ids", F.array_join(unknown, ", "))),
            F.when(labelled & (F.col("gold") != "unclear") & (F.size("gold_ids") == 0), says("support", "gold")),
        )
    )
    return cells.withColumn("kind", kind).withColumn("problems", problems).drop("first_row")


def labelled_examples(checked: DataFrame) -> DataFrame:
    return checked.where("kind = 'labelled'").select(
        "example_id", "asset", "asset_type", "article_id", "source", "bucket", "sentences",
        F.col("gold").alias("gold_stance"), "gold_ids", "labelled_by",
    )


def label_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count_if(F.col("kind") == "labelled").alias("labelled"),
        F.count_if(F.col("kind") == "unlabelled").alias("unlabelled"),
        F.count_if(F.col("kind") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.size("problems")), F.lit(0)).alias("problems"),
    )


def label_problems(checked: DataFrame) -> DataFrame:
    return checked.select("example_id", F.explode("problems").alias("problem"))


def prediction_label(status: Column, stance: Column) -> Column:
    """skipped without an answer, validation_failed, or the stance."""
    return F.when(status.isNull(), "skipped").when(status == "failed", "validation_failed").otherwise(stance)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Counts per (gold, pred): at most labels x labels rows, whatever the number of examples."""
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Long confusion matrix, filled with zeros: gold, pred, n.

    Columns are the classes that occur and every other predicted label. The set of predicted
    labels is gathered over the aggregated counts (a few dozen rows), not over the examples.
    """
    counts = pair_counts(pairs)
    everything = Window.partitionBy(F.lit(0))
    seen_gold = F.collect_set("gold").over(everything)
    seen_pred = F.collect_set("pred").over(everything)
    order = F.array(*[F.lit(c) for c in classes])
    labels = F.array_union(F.array_intersect(order, F.array_union(seen_gold, seen_pred)), F.array_except(seen_pred, order))
    per_gold = counts.withColumn("labels", labels).groupBy("gold").agg(
        F.any_value("labels").alias("labels"),
        F.map_from_entries(F.collect_list(F.struct("pred", "n"))).alias("cells"),
    )
    return per_gold.select("gold", "cells", F.explode("labels").alias("pred")).select(
        "gold", "pred", F.coalesce(F.try_element_at("cells", F.col("pred")), F.lit(0).cast("long")).alias("n")
    )


def confusion_wide(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The matrix for display, one column per predicted label of the given list."""
    return pairs.groupBy("gold").pivot("pred", list(labels)).count().na.fill(0)


def per_class(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Support, predicted, true positives, precision, recall, F1 of the classes that occur."""
    counts = pair_counts(pairs)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("s"),
        F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
    ).select("s.*", F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0).alias("hit"))
    totals = sides.where(F.col("label").isin(list(classes))).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("tp")
    )
    precision = numbers.ratio(F.col("tp"), F.col("predicted"))
    recall = numbers.ratio(F.col("tp"), F.col("support"))
    f1 = (
        F.when(F.col("support") == 0, F.lit(None).cast("double"))
        .when((F.col("predicted") == 0) | (F.col("tp") == 0), 0.0)
        .otherwise(2 * precision * recall / (precision + recall))
    )
    return totals.select(
        "label", "support", "predicted", "tp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def overall(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row: n, correct, accuracy and macro F1 over the classes that have gold examples."""
    counts = pair_counts(pairs)
    hits = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("correct"),
    ).select("n", "correct", F.lit(None).cast("double").alias("f1"))
    scores = per_class(pairs, classes).where("support > 0").select(
        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("correct"), F.coalesce("f1", F.lit(0.0)).alias("f1")
    )
    total = hits.unionByName(scores).agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.avg("f1").alias("macro_f1")
    )
    return total.withColumn("accuracy", numbers.ratio(F.col("correct"), F.col("n")))


def citation_overlap(items: DataFrame) -> DataFrame:
    """Precision and recall of cited ids over all examples (arrays `predicted` and `gold`)."""
    shared = F.size(F.array_intersect("predicted", "gold"))
    return items.agg(
        F.count("*").alias("n"),
        F.sum(shared).alias("shared"),
        F.sum(F.size(F.array_distinct("predicted"))).alias("cited"),
        F.sum(F.size(F.array_distinct("gold"))).alias("wanted"),
    ).select(
        "n",
        numbers.ratio(F.col("shared"), F.col("cited")).alias("precision"),
        numbers.ratio(F.col("shared"), F.col("wanted")).alias("recall"),
    )


def slice_accuracy(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Accuracy per value of each dimension, all dimensions in one pass."""
    return _per_dimension(rows, dimensions).agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gold")).alias("correct")
    ).withColumn("accuracy", numbers.ratio(F.col("correct"), F.col("n")))


def _per_dimension(rows: DataFrame, dimensions: Sequence[str]):
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return rows.withColumn("d", F.explode(pairs)).groupBy("d.dimension", "d.value")


def tallies(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Row counts per value of each dimension, largest first."""
    return _per_dimension(rows, dimensions).agg(F.count("*").alias("n")).orderBy("dimension", F.desc("n"), "value")


def citation_valid(status: Column, evidence_ids: Column, known_ids: Column) -> Column:
    """Whether all cited ids exist and there is one; NULL without a usable answer."""
    complete = (F.size(evidence_ids) > 0) & F.forall(evidence_ids, lambda i: F.array_contains(known_ids, i))
    return F.when(status.isNotNull() & (status != "failed"), complete)


def validity_rates(rows: DataFrame) -> DataFrame:
    """Share of valid citations and of first answers that passed, NULLs left out."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return rows.agg(
        F.count("citation_valid").alias("answers"),
        rate("citation_valid").alias("citation_validity"),
        F.count("first_attempt_ok").alias("attempted"),
        rate("first_attempt_ok").alias("first_attempt_pass"),
    )


def gold_overlap(rows: DataFrame) -> DataFrame:
    """Citation overlap over examples with a gold direction, gold ids and a valid citation."""
    return citation_overlap(
        rows.where((F.col("gold") != "unclear") & (F.size("gold_ids") > 0) & F.col("citation_valid")).select(
            F.col("evidence_ids").alias("predicted"), F.col("gold_ids").alias("gold")
        )
    )


def support_rates(verdicts: DataFrame) -> DataFrame:
    """Citation support from one row per judged sentence (example_id, gold, pred, verdict)."""
    supports = F.col("verdict") == "supports"
    per_example = verdicts.groupBy("example_id").agg(
        F.count("*").alias("sentences"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in config.VERDICTS],
        F.bool_and(supports).alias("fully"),
        F.count_if(F.col("gold") == F.col("pred")).alias("right"),
        F.count_if(supports & (F.col("gold") == F.col("pred"))).alias("right_supports"),
    )
    total = per_example.agg(
        F.count("*").alias("examples"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sentences", *config.VERDICTS, "right", "right_supports")],
        F.count_if("fully").alias("fully"),
    )
    return total.select(
        "examples", "sentences", *config.VERDICTS,
        numbers.ratio(F.col("supports"), F.col("sentences")).alias("sentence_support_rate"),
        numbers.ratio(F.col("fully"), F.col("examples")).alias("fully_supported_rate"),
        numbers.ratio(F.col("right_supports"), F.col("right")).alias("support_rate_when_correct"),
    )


def verdicts_complete(cited: Column, verdict_ids: Column) -> Column:
    """Whether there is exactly one verdict for each cited id."""
    same = F.array_sort(F.array_distinct(verdict_ids)) == F.array_sort(cited)
    return same & (F.size(verdict_ids) == F.size(cited))


def misses(rows: DataFrame, limit: int | None, order: str = "example_id") -> DataFrame:
    """The first wrong predictions in example order."""
    missed = rows.where(F.col("gold") != F.col("pred"))
    return missed if limit is None else missed.orderBy(order).limit(limit)


def label_provenance(examples: DataFrame) -> DataFrame:
    return examples.groupBy("labelled_by").agg(F.count("*").alias("examples"))


#: A prime, and the base of each lane of the fingerprint's polynomial.
FINGERPRINT_PRIME = 2**31 - 1
FINGERPRINT_BASES = (1_000_003, 1_000_033, 1_000_037, 1_000_039)


def numbered(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Adds `position`, 0 to n - 1 in the given order, without sorting all rows in one task.

    Rows are sorted in ranges; a range starts after the sizes of those before it, which are one row per range.
    """
    ranged = checkpoint(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(starts, "_range").withColumn("position", F.col("_start") + F.col("_inside") - 1).drop("_range", "_inside", "_start")


def _power(base: int, exponent: Column) -> Column:
    """base^exponent modulo the prime, by the bits of the exponent."""
    squares = F.array(*[F.lit(pow(base, 1 << k, FINGERPRINT_PRIME)).cast("long") for k in range(40)])
    bit = lambda k: F.call_function("shiftright", exponent, k).bitwiseAND(F.lit(1)) == 1
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(39)), F.lit(1).cast("long"),
        lambda acc, k: F.when(bit(k), acc * F.get(squares, k) % FINGERPRINT_PRIME).otherwise(acc))


def dataset_fingerprint(examples: DataFrame, order: Sequence[Column | str] = ("example_id",)) -> DataFrame:
    """One row with a fingerprint over id, gold label, gold ids and sentences of all examples, in the order of the file.

    `order` gives that order (ties: by the row itself). Every row is hashed on its own and counts as the coefficient of its place in a polynomial, which is
    evaluated modulo a prime for several bases. The terms are added up, so the partitioning of the rows does not matter and no list of rows is
    built, but two rows that change places change the result.
    """
    row = F.sha2(F.to_json(F.struct("example_id", "gold_stance", "gold_ids", "sentences")), 256)
    placed = numbered(examples.withColumn("_row", row), [*order, "_row"])
    count = placed.count()
    exponent = F.lit(count - 1) - F.col("position")
    # Terms are below 2^31, so 2^32 of them fit a long.
    lanes = [
        (F.coalesce(F.sum(F.conv(F.substring("_row", 1 + 7 * k, 7), 16, 10).cast("long") * _power(base, exponent) % FINGERPRINT_PRIME), F.lit(0)) % FINGERPRINT_PRIME).cast("string")
        for k, base in enumerate(FINGERPRINT_BASES)
    ]
    return placed.agg(
        F.count("*").alias("examples"),
        F.sha2(F.concat_ws(",", F.count("*").cast("string"), *lanes), 256).alias("fingerprint"),
    )


def smoke_summary(rows: DataFrame) -> DataFrame:
    """Accuracy per expected stance in long form: stance, cases, correct, accuracy."""
    right = F.col("correct")
    seen = rows.groupBy(F.col("expected").alias("stance")).agg(
        F.count("*").alias("cases"), F.count_if(right).alias("correct")
    )
    return seen.withColumn("accuracy", numbers.ratio(F.col("correct"), F.col("cases")))


def smoke_totals(rows: DataFrame) -> DataFrame:
    """One row: accuracy, unclear recall and precision, evidence validity, failures, latency.

    `rows`: expected, predicted, status, evidence_valid, latency_ms.
    """
    correct = (F.col("status") != "failed") & (F.col("predicted") == F.col("expected"))
    gold_unclear = F.col("expected") == "unclear"
    said_unclear = F.col("predicted") == "unclear"
    both = F.count_if(gold_unclear & said_unclear)
    return rows.agg(
        F.count("*").alias("cases"),
        numbers.ratio(F.count_if(correct), F.count("*")).alias("accuracy"),
        numbers.ratio(both, F.count_if(gold_unclear)).alias("unclear_recall"),
        numbers.ratio(both, F.count_if(said_unclear)).alias("unclear_precision"),
        F.avg(F.col("evidence_valid").cast("double")).alias("evidence_validity"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.floor(F.avg("latency_ms") + 0.5).alias("avg_latency_ms"),
    )
