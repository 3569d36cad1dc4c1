"""The operators of this subpackage over the test tables, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsmood.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import exact_dedup

    return exact_dedup.report(table(spark, folder, "documents"))


@query()
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import token_counts

    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


#: Parameters of the mixture: weights at least this even, no source read more often than this.
MIX = {"target_entropy": 0.95, "max_repeats": 4.0}


@query(r"""
    WITH RECURSIVE tok AS (
      SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
    shares AS (SELECT source, tokens, tokens / sum(tokens) OVER () AS share FROM (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM tok GROUP BY source)),
    used AS (SELECT * FROM shares WHERE tokens > 0),
    flat(i, lo, hi) AS (
      SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
      UNION ALL SELECT i + 1, CASE WHEN even THEN (lo + hi) / 2 ELSE lo END, CASE WHEN even THEN hi ELSE (lo + hi) / 2 END FROM (
        SELECT i, lo, hi, ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * ln(share) * (lo + hi) / 2) / sum(pow(share, (lo + hi) / 2))
          >= 0.95 * ln(count(*)) AS even FROM flat, used WHERE i < 52 GROUP BY i, lo, hi)),
    kept(i, lo, hi) AS (
      SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
      UNION ALL SELECT i + 1, CASE WHEN fits THEN lo ELSE (lo + hi) / 2 END, CASE WHEN fits THEN (lo + hi) / 2 ELSE hi END FROM (
        SELECT i, lo, hi, max(pow(share, (lo + hi) / 2 - 1)) / min(pow(share, (lo + hi) / 2 - 1)) <= 4 AS fits FROM kept, used WHERE i < 52 GROUP BY i, lo, hi)),
    power AS (SELECT source, tokens, pow(share, (SELECT greatest((SELECT max(lo) FROM flat), (SELECT min(hi) FROM kept)))) AS power FROM used),
    plan AS (
      SELECT source, tokens AS every, CAST(floor(least(power * (SELECT max(tokens / power) FROM power), tokens * 4.0) + 1e-6) AS BIGINT) AS budget FROM power
      UNION ALL SELECT source, 0, 0 FROM shares WHERE tokens = 0),
    dealt AS (SELECT *, CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 1024 AS block FROM tok),
    sizes AS (SELECT source, block, CAST(sum(tokens) AS BIGINT) AS size FROM dealt GROUP BY source, block),
    turns AS (
      SELECT source, block, pass, size, budget - start AS left_over, start / greatest(budget, 1) AS place FROM (
        SELECT *, (pass - 1) * every + coalesce(sum(size) OVER (PARTITION BY source, pass
            ORDER BY CAST('0x' || substr(md5('1:block:' || source || ':' || pass || ':' || block), 1, 15) AS BIGINT), block
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT *, unnest(range(1, 1 + greatest(1, CAST(ceil(budget / greatest(every, 1)) AS BIGINT)))) AS pass FROM sizes JOIN plan USING (source)))),
    drawn AS (
      SELECT doc_id, source, tokens, pass, block, place, size, left_over, sum(tokens) OVER (PARTITION BY source, block, pass
          ORDER BY CAST('0x' || substr(md5('1:doc:' || pass || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT), doc_id, tokens
          ROWS UNBOUNDED PRECEDING) AS upto
      FROM dealt JOIN turns USING (source, block) WHERE left_over > 0 OR (size = 0 AND left_over = 0))
    SELECT doc_id, source, tokens, pass, block, round(place, 9) AS place FROM drawn WHERE size <= left_over OR upto <= left_over
""")
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from newsmood.llm import mixing

    drawn = mixing.mix(table(spark, folder, "documents"), **MIX)
    return drawn.withColumns({"pass": F.col("pass").cast("long"), "block": F.col("block").cast("long"), "place": F.round("place", 9)})


@query()
def op3_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import simhash_pivots

    return simhash_pivots.near_duplicates(table(spark, folder, "documents"), shingle=3)


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import packing

    packed = packing.pack(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import toxicity

    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import language_id

    return language_id.languages(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query()
def op5_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from newsmood.llm import multi_index

    return multi_index.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import lm_scoring

    return lm_scoring.scores(table(spark, folder, "documents"))


@query()
def op6_suffix_levels(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import suffix_levels

    found = suffix_levels.repeated(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Fixed rules of the URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query(r"""
    WITH parts AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    ruled AS (
      SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""")
def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import url_filter

    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return url_filter.verdicts(table(spark, folder, "pages"), rules)


@query()
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from newsmood.llm import conversation_repair as conversations

    reports, lines = conversations.repair(conversations.damaged(table(spark, folder, "conversations")))
    hashed = conversations.digests(lines).withColumnRenamed("conv_id", "of")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    both = reports.join(hashed, reports["conv_id"].eqNullSafe(hashed["of"]), "left")
    return both.select(*reports.columns, F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


@query()
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from newsmood.llm import token_alignment

    return token_alignment.alignments(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
