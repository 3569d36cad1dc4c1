"""Stance scoring as a batch job: pending pairs, prompts, answers, validation, cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions import numbers, text
from newsmood.operators.dedupe import first_per_key

FAILURES = ["invalid_json", "bad_citation", "schema"]


def pending_pairs(mentions: DataFrame, assets: DataFrame, articles: DataFrame, signals: DataFrame, as_of,
                  limit: int | None) -> DataFrame:
    """Mentions without a signal, event time in the last 7 days; the newest `limit`, or all of them with None.

    Sentences are joined back after the limit, so the sort moves only keys.
    """
    since = numbers.days_before(numbers.instant(as_of), config.MAX_AGE_DAYS)
    keys = ["article_id", "asset_id"]
    recent = articles.select("article_id", numbers.event_time().alias("event_at")).where(F.col("event_at") > since)
    named = assets.select("asset_id", F.col("name").alias("asset_name"), "asset_type")
    top = (
        mentions.select(*keys)
        .join(signals.select(*keys), keys, "left_anti")
        .join(recent, "article_id")
        .join(named, "asset_id")
    )
    if limit is not None:
        top = top.orderBy(F.desc("event_at"), "article_id", "asset_id").limit(max(0, limit))
    return top.join(mentions.select(*keys, "sentences"), keys)


def calls_today(calls: DataFrame, as_of) -> DataFrame:
    """One row: calls logged since UTC midnight."""
    midnight = F.to_date(numbers.instant(as_of)).cast("timestamp")
    return calls.where(F.col("created_at") >= midnight).agg(F.count("*").alias("used"))


def within_budget(pending: DataFrame, calls: DataFrame, as_of, max_calls_per_day: int) -> DataFrame:
    """The newest pending pairs that today's remaining calls still allow."""
    used = calls_today(calls, as_of).first().used
    newest = pending.orderBy(F.desc("event_at"), "article_id", "asset_id")
    return newest.limit(max(0, max_calls_per_day - used))


def prompt_user_text(asset_name: Column, asset_type: Column, sentences: Column) -> Column:
    """The question for one pair; angle brackets in quoted text are neutralised."""
    numbered = F.transform(
        sentences, lambda s: F.concat(F.lit("["), s["id"], F.lit("] "), text.neutralise_tags(s["text"]))
    )
    lines = F.concat(
        F.array(
            F.concat(F.lit("Asset: "), text.neutralise_tags(asset_name), F.lit(" ("), asset_type, F.lit(")")),
            F.lit("<sentences>"),
        ),
        numbered,
        F.array(F.lit("</sentences>")),
    )
    return F.array_join(lines, "\n")


def render_prompts(pairs: DataFrame, prompts: DataFrame, version: str) -> DataFrame:
    """Adds system_text (from the `prompts` table by version and asset type), user_text, version."""
    chosen = prompts.where(F.col("version") == version).select("asset_type", "system_text")
    return pairs.join(chosen, "asset_type").withColumns(
        {
            "user_text": prompt_user_text(F.col("asset_name"), F.col("asset_type"), F.col("sentences")),
            "prompt_version": F.lit(version),
        }
    )


def prompt_hash(system: Column, user: Column, model: Column, version: Column) -> Column:
    """sha256 over everything that determines an answer."""
    return F.sha2(F.concat_ws("\n", system, user, model, version), 256)


def with_prompt_hash(rendered: DataFrame, model: str) -> DataFrame:
    return rendered.withColumn("model", F.lit(model)).withColumn(
        "prompt_hash", prompt_hash(F.col("system_text"), F.col("user_text"), F.col("model"), F.col("prompt_version"))
    )


def questions_to_ask(hashed: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per prompt hash that has no stored answer yet."""
    asked = ["prompt_hash", "system_text", "user_text", "model", "prompt_version"]
    order = ["article_id", "asset_id"]
    once = first_per_key(hashed.select(*asked, *order), ["prompt_hash"], order).select(*asked)
    return once.join(answers.select("prompt_hash"), "prompt_hash", "left_anti")


def attach_answers(hashed: DataFrame, answers: DataFrame) -> DataFrame:
    """Every pair with the answers to its question, stored or new."""
    return hashed.join(answers.select("prompt_hash", "attempt", "answer"), "prompt_hash")


ANSWER_SCHEMA = "prompt_hash string, attempt int, answer string"
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_batches(questions: DataFrame, scorer: Scorer) -> DataFrame:
    """Calls the user's scorer on Arrow batches of questions, in parallel on the executors.

    The scorer gets system_text, user_text, model, prompt_version and prompt_hash, and returns
    prompt_hash, attempt (1 or 2) and the raw answer. It makes at most two attempts per question;
    a question it cannot reach gets no row and stays pending.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)[["prompt_hash", "attempt", "answer"]]

    return questions.mapInPandas(run, ANSWER_SCHEMA)


def validate_answers(attempts: DataFrame) -> DataFrame:
    """Checks every raw answer: adds stance, strength, evidence_ids, why, valid and failure.

    `attempts`: answer, asset_type, sentences. Types are tested on the parsed variant, because
    reading JSON with a schema would turn a wrong type into NULL. Failures: not JSON ->
    invalid_json; anything wrong with the cited ids (also their number) -> bad_citation;
    everything else -> schema.
    """
    parsed = F.try_parse_json("answer")
    # A valid JSON string starts with a bracket here only if the answer is an object.
    is_json = parsed.isNotNull()
    field = lambda path, kind: F.try_variant_get("v", path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))

    ids = field("$.evidence_ids", "array<variant>")
    id_texts = field("$.evidence_ids", "array<string>")
    all_strings = F.forall(ids, lambda i: F.coalesce(F.schema_of_variant(i) == "STRING", F.lit(False)))
    known = F.transform("sentences", lambda s: s["id"])
    ids_ok = F.coalesce(
        F.size(ids).between(1, config.MAX_EVIDENCE_IDS) & all_strings & F.forall(id_texts, lambda i: F.array_contains(known, i)),
        F.lit(False),
    )
    number = field("$.strength", "double")
    numeric = kind("$.strength").rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    strength_ok = numeric & (number == F.floor(number)) & number.between(0, config.MAX_STRENGTH)
    why = field("$.why", "string")
    word_count = F.size(F.filter(F.split(text.collapse(why), " "), lambda w: w != ""))
    why_ok = (
        (kind("$.why") == "STRING") & (F.length(why) <= config.WHY_MAX_CHARS) & (word_count <= config.WHY_MAX_WORDS)
    )
    stance = field("$.stance", "string")
    stance_ok = (kind("$.stance") == "STRING") & F.array_contains(numbers.allowed_stances(F.col("asset_type")), stance)
    sure = lambda c: F.coalesce(c, F.lit(False))
    object_like = F.schema_of_variant("v").startswith("OBJECT")

    flagged = attempts.withColumn("v", parsed).withColumns(
        {
            "_json": is_json,
            "_object": sure(object_like),
            "_ids": ids_ok,
            "_rest": sure(strength_ok) & sure(why_ok) & sure(stance_ok),
            "stance": stance,
            "strength": F.when(sure(strength_ok), number).cast("int"),
            "evidence_ids": id_texts,
            "why": F.trim(why),
        }
    )
    failure = (
        F.when(~F.col("_json"), "invalid_json")
        .when(~F.col("_object"), "schema")
        .when(~F.col("_ids"), "bad_citation")
        .when(~F.col("_rest"), "schema")
    )
    return (
        flagged.withColumn("failure", failure)
        .withColumn("valid", F.col("failure").isNull())
        .drop("v", "_json", "_object", "_ids", "_rest")
    )


def resolve_attempts(validated: DataFrame) -> DataFrame:
    """One signal row per pair from its one or two validated attempts.

    The first valid answer wins. Two invalid answers are kept as unclear, strength 0, status
    failed, with the reason of the second. A pair with a single invalid attempt is still open and
    has no row.
    """
    good = F.col("valid") & (F.col("attempt") <= 2)
    answer = F.struct("stance", "strength", "evidence_ids", "why")
    resolved = validated.groupBy("article_id", "asset_id").agg(
        F.min_by(F.when(good, answer), F.when(good, F.col("attempt"))).alias("won"),
        F.max(F.when(F.col("attempt") == 1, F.col("failure"))).alias("first_failure"),
        F.max(F.when(F.col("attempt") == 2, F.col("failure"))).alias("second_failure"),
        F.max("attempt").alias("calls"),
    )
    won = F.col("won").isNotNull()
    return resolved.where(won | F.col("second_failure").isNotNull()).select(
        "article_id",
        "asset_id",
        F.when(won, F.col("won.stance")).otherwise("unclear").alias("stance"),
        F.when(won, F.col("won.strength")).otherwise(0).alias("strength"),
        F.when(won, F.array_distinct("won.evidence_ids")).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
        F.when(won, F.col("won.why")).otherwise("").alias("why"),
        F.when(~won, "failed").when(F.col("won.stance") == "unclear", "unclear").otherwise("ok").alias("status"),
        F.when(~won, F.col("second_failure")).alias("failure_reason"),
        "first_failure",
        F.col("calls").cast("int").alias("calls"),
    )


def validation_health(resolved: DataFrame) -> DataFrame:
    """One row per run: how many answers passed at once, after a retry, or never.

    `resolved`: status, failure_reason, first_failure. Rates are rounded to three decimals and
    NULL when nothing was answered.
    """
    failed = F.col("status") == "failed"
    retried = ~failed & F.col("first_failure").isNotNull()
    reasons = {
        f"{name}_{reason}": F.count_if(F.col(column) == reason)
        for name, column in (("first", "first_failure"), ("final", "failure_reason"))
        for reason in FAILURES
    }
    counted = resolved.agg(
        F.count("*").alias("answered"),
        F.count_if(~failed & F.col("first_failure").isNull()).alias("first_attempt_ok"),
        F.count_if(retried).alias("retried_then_ok"),
        F.count_if(failed).alias("failed_after_retry"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(n) for n, c in reasons.items()],
    )
    rate = lambda c: F.round(numbers.ratio(c, F.col("answered")), 3)
    return counted.withColumns(
        {
            "first_attempt_pass_rate": rate(F.col("first_attempt_ok")),
            "retry_rate": rate(F.col("retried_then_ok") + F.col("failed_after_retry")),
            "failure_rate": rate(F.col("failed_after_retry")),
        }
    )


def call_cost(input_tokens: Column, output_tokens: Column, price_in: float, price_out: float) -> Column:
    """Estimated cost in dollars; prices are per million tokens; NULL if a count is missing."""
    return (input_tokens * price_in + output_tokens * price_out) / 1_000_000


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls, retries, tokens and cost per stage and model; tokens only of answered calls."""
    answered = F.col("status").isin("ok", "schema_retry")
    tokens = lambda c: F.coalesce(F.sum(F.when(answered, F.col(c))), F.lit(0))
    return calls.groupBy("stage", "model").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "schema_retry").alias("schema_retries"),
        F.count_if(F.col("status") == "rate_limited").alias("rate_limited"),
        tokens("input_tokens").alias("input_tokens"),
        tokens("output_tokens").alias("output_tokens"),
        # Added up as decimals, so the sum does not depend on the order of the calls.
        F.coalesce(F.round(F.sum(F.col("est_cost_usd").cast("decimal(20,10)")), 6), F.lit(0)).cast("double").alias("cost_usd"),
    )
