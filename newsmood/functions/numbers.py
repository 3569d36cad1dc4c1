"""Numbers, times and labels as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions.text import let


def round3(x: Column) -> Column:
    """Three decimals, half up towards plus infinity (so -0.0005 becomes 0)."""
    return F.floor(x * 1000 + 0.5) / 1000


def sign(x: Column) -> Column:
    tolerance = config.SIGN_TOLERANCE
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL when the whole is 0."""
    return F.when(whole != 0, part / whole)


def instant(as_of: datetime | str) -> Column:
    """A UTC point in time as a literal; operators never read the clock themselves."""
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp")


def hours_before(moment: Column, hours: int) -> Column:
    return moment - F.expr(f"INTERVAL {int(hours)} HOURS")


def hours_after(moment: Column, hours: int) -> Column:
    return moment + F.expr(f"INTERVAL {int(hours)} HOURS")


def days_before(moment: Column, days: int) -> Column:
    return hours_before(moment, 24 * days)


def event_time() -> Column:
    """Publication time, or arrival time where the feed gave none."""
    return F.coalesce(F.col("published_at"), F.col("fetched_at"))


def parse_date(text: Column) -> Column:
    """ISO or RFC 822 dates as a timestamp; NULL if neither fits.

    The weekday is cut off first because it cannot be parsed, and zone names become offsets.
    """
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},?\s+(?=\d)", ""))
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}"), bare.try_cast("timestamp"))
    zoned = bare
    # fixed values: zone names of RFC 822 and their offsets
    for names, offset in (
        ("GMT|UTC|UT|Z", "+0000"), ("EDT", "-0400"), ("EST|CDT", "-0500"),
        ("CST|MDT", "-0600"), ("MST|PDT", "-0700"), ("PST", "-0800"),
    ):
        zoned = F.regexp_replace(zoned, rf"\s({names})$", f" {offset}")
    rfc = [
        F.try_to_timestamp(zoned, F.lit(pattern))
        for pattern in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "d MMM yy HH:mm:ss xx", "d MMM yyyy HH:mm:ss")
    ]
    return F.coalesce(iso, *[F.when(zoned.rlike(r"^\d{1,2} [A-Za-z]{3} \d{2,4} "), r) for r in rfc])


def published_at(text: Column, now: Column) -> Column:
    """The date of an item, not later than now; NULL if there is none."""
    return let(parse_date(text), lambda at: F.when(at > now, now).otherwise(at))


def allowed_stances(asset_type: Column) -> Column:
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.when(asset_type == "central_bank", lits(config.CENTRAL_BANK_STANCES)).otherwise(
        lits(config.MARKET_STANCES)
    )


def stance_value(stance: Column) -> Column:
    """+1, -1 or 0; NULL for a stance without direction."""
    up = [s for s, v in config.STANCE_VALUE.items() if v > 0]
    down = [s for s, v in config.STANCE_VALUE.items() if v < 0]
    return F.when(stance.isin(up), 1).when(stance.isin(down), -1).when(stance == "neutral", 0)


def mood_word(score: Column, asset_type: Column) -> Column:
    """Five bands in the vocabulary of the asset type."""
    bank = asset_type == "central_bank"
    up = F.when(bank, "hawkish").otherwise("bullish")
    down = F.when(bank, "dovish").otherwise("bearish")
    return (
        F.when(score >= 0.5, F.concat(F.lit("mostly "), up))
        .when(score >= 0.15, F.concat(F.lit("leaning "), up))
        .when(score > -0.15, F.lit("mixed"))
        .when(score > -0.5, F.concat(F.lit("leaning "), down))
        .when(score.isNotNull(), F.concat(F.lit("mostly "), down))
    )


def confidence(sources: Column, agreement: Column) -> Column:
    high = (sources >= config.HIGH_MIN_SOURCES) & (agreement >= config.HIGH_MIN_AGREEMENT)
    return F.when(high, "high").when(sources >= config.MEDIUM_MIN_SOURCES, "medium").otherwise("low")


def asset_type_label(asset_type: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in config.ASSET_TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, asset_type), F.lit(""))
