"""Queries on evaluation, labels and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.operators import evaluation, sampling
from newsmood.plans.registry import query
from newsmood.plans.views import CLASSES, Views
from newsmood.session import scratch_path
from newsmood.sources import sinks

_LABELS = "'bullish','bearish','hawkish','dovish','neutral','unclear'"


def r(c, digits: int = 9):
    return F.round(c, digits)


# ---- codecs and labels ---------------------------------------------------------------------


@query("L1", """SELECT article_id, asset_id, array_to_string(list_transform(range(1, len(sids) + 1), lambda i: '[' || sids[i] || '] ' || texts[i]), chr(10)) AS cell,
  CAST(len(sids) AS BIGINT) AS parsed FROM mentions""", "mentions")
def sentence_cells(v):
    cell = evaluation.format_sentences(F.col("sentences"))
    return v.mentions.select("article_id", "asset_id", cell.alias("cell")).withColumn(
        "parsed", F.size(evaluation.parse_sentences(F.col("cell"))).cast("long")
    )


@query("L2", """SELECT example_id, array_to_string(list_filter(regexp_split_to_array(upper(lower(evidence_ids[1]) || ', ' || evidence_ids[2] || ';;' || labelled_by), '[\\s,;]+'),
  lambda x: x <> ''), '|') AS ids FROM pairs""", "pairs")
def id_lists(v):
    cell = F.concat(F.lower(F.get("evidence_ids", F.lit(0))), F.lit(", "), F.get("evidence_ids", F.lit(1)), F.lit(";;"), F.col("labelled_by"))
    return v.pairs.select("example_id", F.array_join(evaluation.parse_ids(cell), "|").alias("ids"))


def label_rows(v: Views) -> DataFrame:
    """Label rows from events, with every kind of problem."""
    k, value = F.col("k"), F.floor("value").cast("long")
    gold = (
        F.when(F.col("event_type") == "click", " Bullish ").when(F.col("event_type") == "view", "")
        .when(F.col("event_type") == "error", "SKIP").when(F.col("event_type") == "signup", "hawkish").otherwise("unclear")
    )
    kind = F.when(k % 10 == 0, "bond").when(F.col("user_id") % 5 == 0, "central_bank").otherwise("stock")
    cell = F.when(value % 9 == 0, "no brackets").otherwise("[S1] One.\n\n[S2] Two.")
    ids = F.when(value % 4 == 0, "s1, S2").when(value % 4 == 1, "").when(value % 4 == 2, "S7;S1").otherwise("S2")
    return v.events.select(
        F.col("event_id").alias("row_no"), F.concat(F.lit("ex"), (F.col("event_id") - F.col("event_id") % 3 % 2).cast("string")).alias("example_id"),
        F.lit("Asset").alias("asset"), F.col("event_id").cast("string").alias("article_id"), cell.alias("numbered_sentences"),
        gold.alias("gold_stance"), ids.alias("gold_supporting_sentence_ids"), kind.alias("asset_type"),
        F.lit("src").alias("source"), F.lit("standard").alias("bucket"), F.when(k % 2 == 0, "author").otherwise(" ").alias("labelled_by"),
    )


_LABEL_SQL = """label_rows AS (SELECT event_id AS row_no, 'ex' || (event_id - event_id % 3 % 2) AS example_id, v,
    CASE event_type WHEN 'click' THEN 'bullish' WHEN 'view' THEN '' WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'hawkish' ELSE 'unclear' END AS gold,
    CASE WHEN k % 10 = 0 THEN 'bond' WHEN user_id % 5 = 0 THEN 'central_bank' ELSE 'stock' END AS asset_type, v % 9 = 0 AS bad_cell, k FROM ev),
  kinds AS (SELECT *, CASE WHEN gold = '' THEN 'unlabelled' WHEN gold = 'skip' THEN 'skipped' WHEN asset_type = 'bond' OR bad_cell
      OR (gold = 'hawkish' AND asset_type = 'stock') OR (gold = 'bullish' AND asset_type = 'central_bank') THEN 'rejected' ELSE 'labelled' END AS kind,
      row_no > min(row_no) OVER (PARTITION BY example_id) AS dup FROM label_rows)"""


@query("L3", """SELECT row_no, example_id, kind, CAST(CASE WHEN dup THEN 1 ELSE 0 END + CASE WHEN kind = 'rejected' THEN 1 ELSE 0 END
  + CASE WHEN kind = 'labelled' AND v % 4 = 2 THEN 1 ELSE 0 END + CASE WHEN kind = 'labelled' AND gold <> 'unclear' AND v % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS problems
  FROM kinds""", "ev", recursive=_LABEL_SQL)
def check_labels(v):
    return evaluation.check_labels(label_rows(v)).select("row_no", "example_id", "kind", F.size("problems").cast("long").alias("problems"))


@query("L3", """SELECT split_part(p, ':', 2) AS problem, count(*) AS n FROM (
  SELECT example_id || ': duplicate example_id' AS p FROM kinds WHERE dup
  UNION ALL SELECT ': ' || CASE WHEN asset_type = 'bond' THEN 'unknown asset_type "bond"' WHEN gold = 'hawkish' AND asset_type = 'stock'
      THEN 'gold_stance "hawkish" is not allowed for stock (use bullish/bearish/neutral/unclear or skip)'
      WHEN gold = 'bullish' AND asset_type = 'central_bank' THEN 'gold_stance "bullish" is not allowed for central_bank (use hawkish/dovish/neutral/unclear or skip)'
      ELSE 'bad sentence line' END FROM kinds WHERE kind = 'rejected'
  UNION ALL SELECT ': gold_supporting_sentence_ids S7 not in the sentences' FROM kinds WHERE kind = 'labelled' AND v % 4 = 2
  UNION ALL SELECT ': a ' || gold || ' label needs at least one gold_supporting_sentence_id' FROM kinds WHERE kind = 'labelled' AND gold <> 'unclear' AND v % 4 = 1)
  GROUP BY 1""", "ev", recursive=_LABEL_SQL)
def label_problems(v):
    problems = evaluation.label_problems(evaluation.check_labels(label_rows(v)))
    return problems.groupBy(F.split_part("problem", F.lit(":"), F.lit(2)).alias("problem")).agg(F.count("*").alias("n"))


# ---- metrics -------------------------------------------------------------------------------


@query("L4", f"""SELECT g.gold, p.pred, CAST(count_if(x.gold = g.gold AND x.pred = p.pred) AS BIGINT) AS n FROM (SELECT DISTINCT gold FROM pairs) g,
  (SELECT DISTINCT pred FROM pairs UNION SELECT gold FROM pairs WHERE gold IN ({_LABELS})) p, pairs x GROUP BY 1, 2""", "pairs")
def confusion_matrix(v):
    return evaluation.confusion_matrix(v.pairs, CLASSES)


@query("L4", """SELECT gold, """ + ", ".join(f"CAST(count_if(pred = '{c}') AS BIGINT) AS {c}" for c in [*CLASSES, "skipped", "validation_failed"])
       + " FROM pairs GROUP BY gold", "pairs")
def confusion_wide(v):
    return evaluation.confusion_wide(v.pairs, [*CLASSES, "skipped", "validation_failed"])


_PER_CLASS = f"""per_class AS (SELECT label, support, predicted, tp, tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall,
    CASE WHEN support = 0 THEN NULL WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f1
    FROM (SELECT label, CAST(count_if(gold = label) AS BIGINT) AS support, CAST(count_if(pred = label) AS BIGINT) AS predicted,
          CAST(count_if(gold = label AND pred = label) AS BIGINT) AS tp FROM pairs, (SELECT unnest([{_LABELS}]) AS label) GROUP BY label)
    WHERE support + predicted > 0)"""


@query("L5", "SELECT label, support, predicted, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM per_class",
       "pairs", recursive=_PER_CLASS)
def per_class(v):
    scores = evaluation.per_class(v.pairs, CLASSES)
    return scores.withColumns({c: r(c) for c in ("precision", "recall", "f1")})


@query("L6", """SELECT (SELECT count(*) FROM pairs) AS n, (SELECT CAST(count_if(gold = pred) AS BIGINT) FROM pairs) AS correct,
  (SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 9) FROM pairs) AS accuracy,
  round(avg(coalesce(f1, 0)), 9) AS macro_f1 FROM per_class WHERE support > 0""", "pairs", recursive=_PER_CLASS)
def overall_scores(v):
    return evaluation.overall(v.pairs, CLASSES).select("n", "correct", r("accuracy").alias("accuracy"), r("macro_f1").alias("macro_f1"))


@query("L7", """SELECT count(*) AS n, round(sum(len(list_intersect(evidence_ids, gold_ids))) / sum(len(list_distinct(evidence_ids))), 9) AS precision,
  round(sum(len(list_intersect(evidence_ids, gold_ids))) / sum(len(list_distinct(gold_ids))), 9) AS recall FROM pairs""", "pairs")
def citation_overlap(v):
    items = v.pairs.select(F.col("evidence_ids").alias("predicted"), F.col("gold_ids").alias("gold"))
    return evaluation.citation_overlap(items).withColumns({c: r(c) for c in ("precision", "recall")})


@query("L8", """SELECT CASE WHEN asset_type IS NOT NULL THEN 'asset_type' WHEN bucket IS NOT NULL THEN 'bucket' ELSE 'source' END AS dimension,
  coalesce(asset_type, bucket, source) AS value, count(*) AS n, CAST(count_if(gold = pred) AS BIGINT) AS correct, round(count_if(gold = pred) / count(*), 9) AS accuracy
  FROM pairs GROUP BY GROUPING SETS ((asset_type), (bucket), (source))""", "pairs")
def slice_accuracy(v):
    return evaluation.slice_accuracy(v.pairs, ["asset_type", "bucket", "source"]).withColumn("accuracy", r("accuracy"))


@query("L9", """SELECT example_id, CASE WHEN status IS NULL THEN 'skipped' WHEN status = 'failed' THEN 'validation_failed' ELSE pred END AS label FROM pairs""", "pairs")
def prediction_labels(v):
    return v.pairs.select("example_id", evaluation.prediction_label(F.col("status"), F.col("pred")).alias("label"))


_VALID = """judged AS (SELECT *, CASE WHEN status IS NOT NULL AND status <> 'failed' THEN len(list_filter(evidence_ids, lambda i: i NOT IN ('S1','S2','S3','S4','S5'))) = 0 END AS citation_valid
    FROM pairs)"""


def judged(v: Views) -> DataFrame:
    known = F.array(*[F.lit(f"S{i}") for i in range(1, 6)])
    return v.pairs.withColumn("citation_valid", evaluation.citation_valid(F.col("status"), F.col("evidence_ids"), known))


@query("L10", """SELECT count(citation_valid) AS answers, round(avg(CAST(citation_valid AS INTEGER)), 9) AS citation_validity, count(first_attempt_ok) AS attempted,
  round(avg(CAST(first_attempt_ok AS INTEGER)), 9) AS first_attempt_pass FROM judged""", "pairs", recursive=_VALID)
def validity_rates(v):
    return evaluation.validity_rates(judged(v)).withColumns({c: r(c) for c in ("citation_validity", "first_attempt_pass")})


@query("L11", """SELECT count(*) AS n, round(sum(len(list_intersect(evidence_ids, gold_ids))) / sum(len(list_distinct(evidence_ids))), 9) AS precision,
  round(sum(len(list_intersect(evidence_ids, gold_ids))) / sum(len(list_distinct(gold_ids))), 9) AS recall FROM judged
  WHERE gold <> 'unclear' AND len(gold_ids) > 0 AND citation_valid""", "pairs", recursive=_VALID)
def gold_overlap(v):
    return evaluation.gold_overlap(judged(v)).withColumns({c: r(c) for c in ("precision", "recall")})


@query("L12", """SELECT count(DISTINCT ex) AS examples, count(*) AS sentences, CAST(count_if(verdict = 'supports') AS BIGINT) AS supports,
  CAST(count_if(verdict = 'partial') AS BIGINT) AS partial, CAST(count_if(verdict = 'does_not_support') AS BIGINT) AS does_not_support,
  round(count_if(verdict = 'supports') / count(*), 9) AS sentence_support_rate,
  round((SELECT avg(CAST(f AS INTEGER)) FROM (SELECT bool_and(verdict = 'supports') AS f FROM pairs GROUP BY example_id // 2)), 9) AS fully_supported_rate,
  round(count_if(verdict = 'supports' AND gold = pred) / count_if(gold = pred), 9) AS support_rate_when_correct
  FROM (SELECT *, example_id // 2 AS ex FROM pairs)""", "pairs")
def support_rates(v):
    """Two neighbouring events are the two cited sentences of one example."""
    verdicts = v.pairs.withColumn("example_id", F.floor(F.col("example_id") / 2))
    rates = ("sentence_support_rate", "fully_supported_rate", "support_rate_when_correct")
    return evaluation.support_rates(verdicts).withColumns({c: r(c) for c in rates})


@query("L13", """SELECT example_id, list_sort(list_distinct(gold_ids || [evidence_ids[1]])) = list_sort(evidence_ids) AND len(gold_ids) + 1 = len(evidence_ids) AS complete FROM pairs""", "pairs")
def verdict_sets(v):
    verdict_ids = F.concat("gold_ids", F.array(F.get("evidence_ids", F.lit(0))))
    return v.pairs.select("example_id", evaluation.verdicts_complete(F.col("evidence_ids"), verdict_ids).alias("complete"))


@query("L14", "SELECT example_id, gold, pred FROM pairs WHERE gold <> pred", "pairs")
def all_misses(v):
    return evaluation.misses(v.pairs, None).select("example_id", "gold", "pred")


@query("L14", "SELECT example_id, gold, pred FROM pairs WHERE gold <> pred ORDER BY example_id LIMIT 60", "pairs")
def miss_list(v):
    return evaluation.misses(v.pairs, config.MISS_LIMIT).select("example_id", "gold", "pred")


@query("L15", "SELECT example_id, verdict FROM pairs ORDER BY md5(example_id || ':7'), example_id LIMIT 30", "pairs")
def spot_check(v):
    """Thirty verdicts in seeded order."""
    return sampling.spot_check(v.pairs.select("example_id", "verdict"), ["example_id"], 30, seed=7)


_BUCKETS = """buckets AS (SELECT m.article_id, m.asset_id, CASE WHEN h.article_id IS NULL THEN 'not_in_title' WHEN n >= 3 THEN 'multi_asset' ELSE 'standard' END AS bucket
    FROM mentions m JOIN (SELECT article_id, count(*) AS n FROM mentions GROUP BY 1) c ON c.article_id = m.article_id
    LEFT JOIN (SELECT article_id, asset_id FROM hits WHERE pos = 1) h ON h.article_id = m.article_id AND h.asset_id = m.asset_id)"""


@query("L16", "SELECT article_id, asset_id, bucket FROM buckets", "mentions hits", recursive=_BUCKETS)
def hard_cases(v):
    return sampling.hard_cases(v.mentions, v.aliases).select("article_id", "asset_id", "bucket")


@query("L17", "SELECT asset_id || '-' || sha1(article_id || ':' || asset_id) AS example_id FROM signals", "signals")
def example_ids(v):
    return v.signals.select(sampling.example_id(F.col("article_id"), F.col("asset_id")).alias("example_id"))


def candidates(v: Views) -> DataFrame:
    rows = sampling.hard_cases(v.mentions, v.aliases).join(v.articles.select("article_id", "source_id"), "article_id")
    return rows.select(
        sampling.example_id(F.col("article_id"), F.col("asset_id")).alias("key"), F.col("asset_id").alias("asset"),
        F.col("source_id").alias("source"), (F.col("bucket") != "standard").alias("hard"),
    )


def _levels_sql(name: str, pool: str, before: str, limit: str) -> str:
    """The first `limit` picks of a pool when every pick goes to the asset with the fewest rows so far in `before`."""
    return f"""ranked_{name} AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY source_turn, md5(asset || ':' || source || ':42'), source) AS asset_turn
    FROM (SELECT *, row_number() OVER (PARTITION BY asset, source ORDER BY md5(key || ':42'), key) AS source_turn FROM {pool})),
  {name} AS (SELECT key, asset, source, hard FROM ranked_{name} LEFT JOIN (SELECT asset, count(*) AS have FROM {before} GROUP BY asset) USING (asset)
    ORDER BY coalesce(have, 0) + asset_turn, md5(asset || ':42'), asset LIMIT {limit})"""


_SAMPLE = _BUCKETS + """,
  cands AS (SELECT asset_id || '-' || sha1(article_id || ':' || asset_id) AS key, asset_id AS asset, source_id AS source, bucket <> 'standard' AS hard
    FROM buckets JOIN (SELECT article_id, source_id FROM articles) USING (article_id)),
  hard_ones AS (SELECT * FROM cands WHERE hard), easy_ones AS (SELECT * FROM cands WHERE NOT hard), nothing AS (SELECT * FROM cands WHERE false),
""" + ",\n".join((
    _levels_sql("first_picks", "hard_ones", "nothing", "60"),
    _levels_sql("second_picks", "easy_ones", "first_picks", "(SELECT 200 - count(*) FROM first_picks)"),
    "both_picks AS (SELECT * FROM first_picks UNION ALL SELECT * FROM second_picks)",
    "hard_rest AS (SELECT * FROM hard_ones WHERE key NOT IN (SELECT key FROM first_picks))",
    _levels_sql("third_picks", "hard_rest", "both_picks", "(SELECT 200 - count(*) FROM both_picks)"),
))


@query("L18", "SELECT * FROM both_picks UNION ALL SELECT * FROM third_picks", "mentions hits articles", recursive=_SAMPLE)
def stratified_sample(v):
    """Two hundred examples to label, balanced over assets and sources, 30 % hard ones."""
    return sampling.stratified_sample(candidates(v), 200, seed=42, hard_share=0.3)


@query("L19", """SELECT CASE WHEN asset_id IS NOT NULL THEN 'asset_id' WHEN source_id IS NOT NULL THEN 'source_id' ELSE 'bucket' END AS dimension,
  coalesce(asset_id, source_id, bucket) AS value, count(*) AS n FROM buckets JOIN (SELECT article_id, source_id FROM articles) USING (article_id)
  GROUP BY GROUPING SETS ((asset_id), (source_id), (bucket))""", "mentions hits articles", recursive=_BUCKETS)
def sample_tallies(v):
    rows = sampling.hard_cases(v.mentions, v.aliases).join(v.articles.select("article_id", "source_id"), "article_id")
    return evaluation.tallies(rows, ["asset_id", "source_id", "bucket"])


_LANES = " || ',' || ".join(
    f"list_reduce(list(CAST('0x' || substr(h, {1 + 7 * k}, 7) AS BIGINT) ORDER BY CAST(example_id AS VARCHAR), h), lambda a, b: (a * {base} + b) % {evaluation.FINGERPRINT_PRIME})"
    for k, base in enumerate(evaluation.FINGERPRINT_BASES))


@query("L20", rf"""SELECT count(*) AS examples, sha256(count(*) || ',' || {_LANES}) AS fingerprint
  FROM (SELECT example_id, sha256('{{"example_id":"' || example_id || '","gold_stance":"' || gold || '","gold_ids":'
      || CASE v % 4 WHEN 0 THEN '["S1","S2"]' WHEN 1 THEN '[]' WHEN 2 THEN '["S7","S1"]' ELSE '["S2"]' END
      || ',"sentences":[{{"id":"S1","text":"One."}},{{"id":"S2","text":"Two."}}]}}') AS h FROM kinds WHERE kind = 'labelled')""", "ev", recursive=_LABEL_SQL)
def dataset_fingerprint(v):
    """The labelled examples in the order of their ids."""
    return evaluation.dataset_fingerprint(evaluation.labelled_examples(evaluation.check_labels(label_rows(v))))


@query("L21", "SELECT labelled_by, count(*) AS examples FROM pairs GROUP BY 1", "pairs")
def label_provenance(v):
    return evaluation.label_provenance(v.pairs)


def smoke_rows(v: Views) -> DataFrame:
    return judged(v).select(
        F.col("gold").alias("expected"), F.col("pred").alias("predicted"), F.coalesce("status", F.lit("skipped")).alias("status"),
        F.col("citation_valid").alias("evidence_valid"), "latency_ms", (F.col("gold") == F.col("pred")).alias("correct"),
    )


@query("L22", """SELECT gold AS stance, count(*) AS cases, CAST(count_if(gold = pred) AS BIGINT) AS correct, round(count_if(gold = pred) / count(*), 9) AS accuracy FROM pairs GROUP BY 1""", "pairs")
def smoke_per_stance(v):
    return evaluation.smoke_summary(smoke_rows(v)).withColumn("accuracy", r("accuracy"))


@query("L22", """SELECT count(*) AS cases, round(count_if(gold = pred AND coalesce(status, 'skipped') <> 'failed') / count(*), 9) AS accuracy,
  round(count_if(gold = 'unclear' AND pred = 'unclear') / count_if(gold = 'unclear'), 9) AS unclear_recall,
  round(count_if(gold = 'unclear' AND pred = 'unclear') / count_if(pred = 'unclear'), 9) AS unclear_precision,
  round(avg(CAST(citation_valid AS INTEGER)), 9) AS evidence_validity, CAST(count_if(status = 'failed') AS BIGINT) AS failed,
  CAST(count_if(status IS NULL) AS BIGINT) AS skipped, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms FROM judged""", "pairs", recursive=_VALID)
def smoke_totals(v):
    totals = evaluation.smoke_totals(smoke_rows(v))
    return totals.withColumns({c: r(c) for c in ("accuracy", "unclear_recall", "unclear_precision", "evidence_validity")})


@query("A10", """SELECT count(*) AS n, CAST(count_if(gold = pred) AS BIGINT) AS correct FROM pairs
  UNION ALL SELECT count(*), CAST(count_if(gold = pred) AS BIGINT) FROM pairs""", "pairs")
def evaluation_results(v):
    """Summary and per-example rows written as JSON and counted back."""
    path = scratch_path(v.spark, "eval")
    sinks.write_results(evaluation.overall(v.pairs, CLASSES), v.pairs, path)
    summary = v.spark.read.schema("n long, correct long").json(f"{path}/summary")
    rows = v.spark.read.schema("example_id long, gold string, pred string").json(f"{path}/rows")
    return summary.select("n", "correct").unionByName(
        rows.agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("correct"))
    )
