"""Queries on stance scoring: pending pairs, prompts, answers, validation, usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers
from newsmood.operators import stance
from newsmood.plans.registry import query
from newsmood.plans.views import AS_OF, Views, stamp

MODEL, VERSION = "scorer-1", "v1"
PENDING_SQL = """pending AS (SELECT m.article_id, m.asset_id, a.name AS asset_name, a.asset_type, sids, texts,
    coalesce(published_at, fetched_at) AS event_at FROM mentions m JOIN assets a USING (asset_id) JOIN articles r USING (article_id)
    WHERE coalesce(published_at, fetched_at) > TIMESTAMP '2024-01-24'
      AND NOT EXISTS (SELECT 1 FROM mention_signals s WHERE s.article_id = m.article_id AND s.asset_id = m.asset_id))"""
PROMPT_SQL = PENDING_SQL + """, rendered AS (SELECT *, 'judge ' || asset_type AS system_text, 'Asset: ' || asset_name || ' (' || asset_type || ')' || chr(10)
    || '<sentences>' || chr(10) || array_to_string(list_transform(range(1, len(sids) + 1),
       lambda i: '[' || sids[i] || '] ' || regexp_replace(texts[i], '[<>]', ' ', 'g')), chr(10)) || chr(10) || '</sentences>' AS user_text FROM pending),
  hashed AS (SELECT *, sha256(system_text || chr(10) || user_text || chr(10) || 'scorer-1' || chr(10) || 'v1') AS prompt_hash FROM rendered)"""


def prompt_table(v: Views) -> DataFrame:
    return v.assets.select("asset_type").distinct().select(
        F.lit(VERSION).alias("version"), "asset_type", F.concat(F.lit("judge "), "asset_type").alias("system_text")
    )


def all_pending(v: Views) -> DataFrame:
    """Every pending pair, without the limit of one run."""
    keys = ["article_id", "asset_id"]
    since = numbers.days_before(numbers.instant(AS_OF), config.MAX_AGE_DAYS)
    recent = v.articles.select("article_id", numbers.event_time().alias("event_at")).where(F.col("event_at") > since)
    return (
        v.mentions.join(v.mention_signals.select(*keys), keys, "left_anti").join(recent, "article_id")
        .join(v.assets.select("asset_id", F.col("name").alias("asset_name"), "asset_type"), "asset_id")
    )


def hashed_pending(v: Views) -> DataFrame:
    return stance.with_prompt_hash(stance.render_prompts(all_pending(v), prompt_table(v), VERSION), MODEL)


def stub_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A deterministic scorer: the answer depends only on the prompt hash.

    About one answer in seven is no JSON, and about one in seven cites an unknown sentence; those
    questions get a second attempt.
    """
    rows = []
    for prompt_hash in batch["prompt_hash"]:
        kind = int(prompt_hash[:6], 16) % 7
        good = '{"stance": "neutral", "strength": %d, "evidence_ids": ["S1"], "why": "stub"}' % (kind % 4)
        first = "not json" if kind == 0 else good.replace("S1", "S99") if kind == 1 else good
        rows.append((prompt_hash, 1, first))
        if kind < 2:
            rows.append((prompt_hash, 2, good if int(prompt_hash[6:8], 16) % 2 else first))
    return pd.DataFrame(rows, columns=["prompt_hash", "attempt", "answer"])


@query("F1", "SELECT article_id, asset_id, asset_name, asset_type, strftime(event_at, '%Y-%m-%d %H:%M:%S') AS event_at, array_to_string(sids, ',') AS sids "
       "FROM pending", "mentions assets articles mention_signals", recursive=PENDING_SQL)
def pending_pairs(v):
    rows = stance.pending_pairs(v.mentions, v.assets, v.articles, v.mention_signals, AS_OF, None)
    return rows.select(
        "article_id", "asset_id", "asset_name", "asset_type", stamp("event_at").alias("event_at"),
        F.array_join(F.transform("sentences", lambda s: s["id"]), ",").alias("sids"),
    )


@query("F2", """SELECT article_id, asset_id FROM pending ORDER BY event_at DESC, article_id, asset_id
  LIMIT (SELECT greatest(0, 300 - count(*)) FROM calls WHERE created_at >= TIMESTAMP '2001-11-04')""",
       "mentions assets articles mention_signals calls", recursive=PENDING_SQL)
def within_call_budget(v):
    """Pairs that the calls left on 2001-11-04 allow (the cap is the feature)."""
    return stance.within_budget(all_pending(v), v.calls, "2001-11-04 12:00:00", 300).select("article_id", "asset_id")


@query("F3", """SELECT asset_id, CASE WHEN asset_type = 'central_bank' THEN 'hawkish,dovish,neutral,unclear'
  ELSE 'bullish,bearish,neutral,unclear' END AS stances FROM part_assets""", "part_assets")
def allowed_stances(v):
    return v.part_records.select("asset_id", F.array_join(numbers.allowed_stances(F.col("asset_type")), ",").alias("stances"))


@query("F4", "SELECT article_id, asset_id, system_text, user_text, 'v1' AS prompt_version FROM rendered",
       "mentions assets articles mention_signals", recursive=PROMPT_SQL)
def rendered_prompts(v):
    return stance.render_prompts(all_pending(v), prompt_table(v), VERSION).select(
        "article_id", "asset_id", "system_text", "user_text", "prompt_version"
    )


@query("F5", """SELECT prompt_hash, count(*) AS pairs FROM hashed WHERE prompt_hash NOT IN
  (SELECT prompt_hash FROM hashed WHERE event_at < TIMESTAMP '2024-01-29') GROUP BY 1""",
       "mentions assets articles mention_signals", recursive=PROMPT_SQL)
def questions_to_ask(v):
    """Questions whose answer is not stored yet (those of older pairs are), with their pairs."""
    hashed = hashed_pending(v)
    stored = hashed.where(F.col("event_at") < F.lit("2024-01-29").cast("timestamp")).select("prompt_hash")
    asked = stance.questions_to_ask(hashed, stored)
    return asked.select("prompt_hash").join(hashed, "prompt_hash").groupBy("prompt_hash").agg(F.count("*").alias("pairs"))


_SCORED_SQL = PROMPT_SQL + """,
  tries AS (SELECT *, CASE WHEN kind = 0 THEN 'invalid_json' WHEN kind = 1 OR NOT known THEN 'bad_citation' END AS failed_first FROM (
    SELECT article_id, asset_id, CAST('0x' || substr(prompt_hash, 1, 6) AS BIGINT) % 7 AS kind,
           CAST('0x' || substr(prompt_hash, 7, 2) AS BIGINT) % 2 AS coin, list_contains(sids, 'S1') AS known FROM hashed)),
  ends AS (SELECT *, CASE WHEN failed_first IS NULL THEN NULL WHEN coin = 0 THEN failed_first WHEN NOT known THEN 'bad_citation' END AS failed_last
    FROM tries WHERE failed_first IS NULL OR kind < 2)"""


@query("F6 F7 F8 F9", """SELECT article_id, asset_id, CASE WHEN failed_last IS NULL THEN 'neutral' ELSE 'unclear' END AS stance,
    CAST(CASE WHEN failed_last IS NULL THEN kind % 4 ELSE 0 END AS INTEGER) AS strength, CASE WHEN failed_last IS NULL THEN 'S1' ELSE '' END AS evidence_ids,
    CASE WHEN failed_last IS NULL THEN 'stub' ELSE '' END AS why, CASE WHEN failed_last IS NULL THEN 'ok' ELSE 'failed' END AS status,
    failed_last AS failure_reason, failed_first AS first_failure, CASE WHEN failed_first IS NULL THEN 1 ELSE 2 END AS calls FROM ends""",
       "mentions assets articles mention_signals", recursive=_SCORED_SQL)
def scored_signals(v):
    """Pending pairs through the stub scorer, validation and the two-attempt rule."""
    hashed = hashed_pending(v)
    questions = stance.questions_to_ask(hashed, hashed.select("prompt_hash").limit(0))
    answers = stance.score_batches(questions, stub_scorer)
    resolved = stance.resolve_attempts(stance.validate_answers(stance.attach_answers(hashed, answers)))
    return resolved.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


RAW_ANSWERS_SQL = """answers AS (SELECT event_id AS article_id, user_id, v, k,
    CASE WHEN event_type = 'error' THEN 'Sorry, no idea' ELSE '{"stance": "' || CASE event_type WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'unclear'
      WHEN 'signup' THEN 'bullish' ELSE 'hawkish' END || '", "strength": ' || (v % 5) || ', "evidence_ids": ["S' || (k % 4 + 1) || '"], "why": "w' || k || '"}' END AS answer,
    event_type, user_id % 5 = 0 AS bank FROM ev)"""


def event_answers(v: Views) -> DataFrame:
    """Raw answers made from events: not JSON, strength 4, unknown ids, stance not allowed."""
    named = F.when(F.col("event_type") == "view", "neutral").when(F.col("event_type") == "click", "unclear").when(
        F.col("event_type") == "signup", "bullish"
    ).otherwise("hawkish")
    answer = F.when(F.col("event_type") == "error", "Sorry, no idea").otherwise(
        F.concat(
            F.lit('{"stance": "'), named, F.lit('", "strength": '), (F.floor("value") % 5).cast("string"), F.lit(', "evidence_ids": ["S'),
            (F.col("k") % 4 + 1).cast("string"), F.lit('"], "why": "w'), F.col("k").cast("string"), F.lit('"}'),
        )
    )
    sentence = lambda i: F.struct(F.lit(f"S{i}").alias("id"), F.lit("text").alias("text"))
    return v.events.select(
        F.col("event_id").alias("article_id"), F.lit("a01").alias("asset_id"), F.lit(1).alias("attempt"), answer.alias("answer"),
        F.when(F.col("user_id") % 5 == 0, "central_bank").otherwise("commodity").alias("asset_type"),
        F.array(sentence(1), sentence(2), sentence(3)).alias("sentences"),
    )


@query("F7 F8", """SELECT article_id, CASE WHEN event_type = 'error' THEN 'invalid_json' WHEN k % 4 = 3 THEN 'bad_citation'
  WHEN v % 5 = 4 OR (event_type = 'signup' AND bank) OR (event_type = 'purchase' AND NOT bank) THEN 'schema' END AS failure FROM answers""",
       "ev", recursive=RAW_ANSWERS_SQL)
def answer_failures(v):
    return stance.validate_answers(event_answers(v)).select("article_id", "failure")


@query("F9", """SELECT user_id, hawkish, CAST(count_if(status = 'ok') AS BIGINT) AS ok, CAST(count_if(status = 'failed') AS BIGINT) AS failed,
  CAST(count_if(status = 'unclear') AS BIGINT) AS unclear FROM (SELECT k AS user_id, event_type = 'purchase' AS hawkish,
   CASE WHEN event_type = 'error' OR k % 4 = 3 OR v % 5 = 4 OR (event_type = 'signup' AND bank) OR (event_type = 'purchase' AND NOT bank) THEN 'failed'
        WHEN event_type = 'click' THEN 'unclear' ELSE 'ok' END AS status FROM answers) GROUP BY ALL""", "ev", recursive=RAW_ANSWERS_SQL)
def resolved_attempts(v):
    """Every answer given twice: a wrong one stays wrong and is stored as failed."""
    first = event_answers(v)
    both = first.unionByName(first.withColumn("attempt", F.lit(2)))
    resolved = stance.resolve_attempts(stance.validate_answers(both))
    facts = v.events.select(F.col("event_id").alias("article_id"), F.col("k").alias("user_id"), (F.col("event_type") == "purchase").alias("hawkish"))
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return resolved.join(facts, "article_id").groupBy("user_id", "hawkish").agg(status("ok"), status("failed"), status("unclear"))


@query("F10", """SELECT CAST(count(*) AS BIGINT) AS answered, CAST(count_if(NOT failed AND NOT retried) AS BIGINT) AS first_attempt_ok,
  CAST(count_if(NOT failed AND retried) AS BIGINT) AS retried_then_ok, CAST(count_if(failed) AS BIGINT) AS failed_after_retry,
  round(count_if(NOT failed AND NOT retried) / count(*), 3) AS first_attempt_pass_rate, round(count_if(retried) / count(*), 3) AS retry_rate,
  round(count_if(failed) / count(*), 3) AS failure_rate FROM (SELECT status = 'failed' AS failed, status = 'failed' OR v % 3 = 0 AS retried
  FROM signals JOIN ev ON event_id = article_id)""", "signals ev")
def validation_health(v):
    third = F.floor(F.col("value")) % 3 == 0
    facts = v.signals.join(v.events.select(F.col("event_id").alias("article_id"), "value"), "article_id").select(
        "status", F.when(F.col("status") == "failed", "schema").alias("failure_reason"),
        F.when((F.col("status") == "failed") | third, "invalid_json").alias("first_failure"),
    )
    return stance.validation_health(facts).select(
        "answered", "first_attempt_ok", "retried_then_ok", "failed_after_retry", "first_attempt_pass_rate", "retry_rate", "failure_rate"
    )


@query("F11", """SELECT stage, model, status, count(*) AS calls, CAST(count(input_tokens) AS BIGINT) AS priced,
  CAST(sum(CAST((input_tokens * 0.15 + output_tokens * 0.6) / 1000000 AS DECIMAL(20,10))) AS DOUBLE) AS cost FROM calls GROUP BY ALL""", "calls")
def call_costs(v):
    cost = stance.call_cost(F.col("input_tokens"), F.col("output_tokens"), 0.15, 0.6)
    return v.calls.withColumn("cost", cost).groupBy("stage", "model", "status").agg(
        F.count("*").alias("calls"), F.count("cost").alias("priced"), F.sum(F.col("cost").cast("decimal(20,10)")).cast("double").alias("cost")
    )


@query("F12", """SELECT stage, model, count(*) AS calls, CAST(count_if(status = 'schema_retry') AS BIGINT) AS schema_retries,
  CAST(count_if(status = 'rate_limited') AS BIGINT) AS rate_limited,
  CAST(sum(CASE WHEN status IN ('ok', 'schema_retry') THEN input_tokens END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN status IN ('ok', 'schema_retry') THEN output_tokens END) AS BIGINT) AS output_tokens,
  CAST(round(sum(CAST((input_tokens * 0.15 + output_tokens * 0.6) / 1000000 AS DECIMAL(20,10))), 6) AS DOUBLE) AS cost_usd FROM calls GROUP BY ALL""", "calls")
def usage_rollup(v):
    return stance.usage_rollup(
        v.calls.withColumn("est_cost_usd", stance.call_cost(F.col("input_tokens"), F.col("output_tokens"), 0.15, 0.6))
    )
