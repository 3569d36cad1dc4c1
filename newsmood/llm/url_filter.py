"""Host and path rules for URLs, looked up in cascades of Bloom filters instead of by joins.

A rule is a host and the beginning of a path, written as one key (`example.net/en/`). It fits its host and all subdomains, if the path of the
URL starts with the rule's. So the keys that can fit a URL are ends of its host with beginnings of its path, and only those whose shape
(number of labels, length of path) some rule has. One cascade holds the keys of the blocking rules, one those of the allowing rules.

Level 1 of a cascade encodes the listed keys. Level 2 encodes the keys of the corpus that pass level 1 but are not listed, level 3 the listed
keys that pass level 2, and so on, until no key passes wrongly. The first level that a key fails tells on which side it is: exact for every
key of the corpus (its key universe) and every listed key. Level 1 passes about 0.7 unlisted keys per listed one, whatever the size of the universe, so
a cascade takes about 1.44 (log2(universe / listed) + 3) bits per listed key, and only the passing keys are ever made distinct and shuffled.

A filter is one row, an array of 64-bit words, which reaches the tasks as a scalar subquery. It has at most MAX_WORDS words (8 MB). Longer lists are
split into parts by a hash of the key, each with cascades of its own, and rows pass through one part after the other. Keys are tested in
code generated by Spark; what is shuffled is one row without page content per URL.

Of the rules that fit, the longest key wins, then the one with more host labels; a key on both lists blocks. The verdict is that of the rule. Without a
rule it is the cascades' own: the key is on no list, so the URL is allowed.

Edge cases: a null URL, or one without `://`, has an empty host and path, and fits no rule. Host labels are what lies between dots, empty ones too. Only
A-Z are lower-cased, in hosts only, also in those of rules. Rules are made distinct; rules without a host or null fit nothing. Without rules everything is allowed. Null or repeated ids:
one row per input row. No pages: no rows. Only the id and the URL are read; other columns may have any name.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.llm.common import stage

MAX_WORDS = 1 << 20
#: Share of unlisted keys that pass a level after the first.
HALF = 0.5
#: A match as one number: length of the key, labels of its host, blocking or not.
_LENGTH, _LABELS = 1 << 24, 2


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://` with A-Z lower-cased, and the path up to `?` or `#`; both empty if there is no `://`."""
    parts = r"://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(known, parts, 1)), F.regexp_extract(known, parts, 2)


def _labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def _end_of(host: Column, labels: Column) -> Column:
    """The last `labels` labels of a host."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `words` is a table of one row with the array `words`."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def slots(self, key: Column) -> list[Column]:
        return _slots(key, self.bits, self.hashes, self.seed)

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        found = F.lit(True)
        for slot in self.slots(key):
            word = F.get(words, F.shiftright(slot, 6).cast("int"))
            found = found & (F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


def _slots(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first, second = (F.pmod(F.xxhash64(key, F.lit(2 * seed + i)), F.lit(bits)) for i in (0, 1))
    return [F.pmod(first + F.lit(i) * second + F.lit(i * i), F.lit(bits)) for i in range(hashes)]


def size_of(keys: int, share: float) -> tuple[int, int]:
    """(bits, hashes) of a filter of `keys` keys that the given share of other keys passes."""
    hashes = max(1, round(math.log2(1 / share)))
    return 64 * max(1, math.ceil(keys * hashes / math.log(2) / 64)), hashes


def _level(keys: DataFrame, count: int, share: float, seed: int) -> Level:
    """The filter of the column `key` of `keys`."""
    bits, hashes = size_of(count, share)
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), bits, hashes, seed))).alias("slot"))
    masks = slots.select(
        F.shiftright("slot", 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int")).alias("mask"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    dense = masks.union(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    row = dense.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("all")).select(F.col("all.mask").alias("words"))
    return Level(stage(row, "url-level"), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that it fails decides, odd levels (from 1) against it."""
        if not self.levels:
            return F.lit(False)
        found = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            found = F.when(self.levels[number - 1].passes(key), found).otherwise(F.lit(number % 2 == 0))
        return found


def cascade(listed: DataFrame, universe: DataFrame, universe_size: int) -> Cascade:
    """The cascade of the column `key` of `listed`, exact for all keys of `universe` (which may repeat and hold listed ones)."""
    inside = stage(listed.select("key").distinct(), "url-listed")
    count = inside.count()
    if not count:
        return Cascade(())
    share = min(HALF, count * math.sqrt(0.5) / max(universe_size, 1))
    levels = [_level(inside, count, share, 1)]
    passing = universe.where(levels[0].passes(F.col("key"))).select("key", F.lit(0).alias("own"))
    both = passing.union(inside.select("key", F.lit(1)))
    wrong = stage(both.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key"), "url-wrong")
    while count := wrong.count():
        # The keys encoded last that pass the new level are wrong in turn.
        levels.append(_level(wrong, count, HALF, len(levels) + 1))
        inside, wrong = wrong, stage(inside.where(levels[-1].passes(F.col("key"))), "url-wrong")
    return Cascade(tuple(levels))


def rule_keys(rules: DataFrame, rule_col: str = "rule", action_col: str = "action") -> DataFrame:
    """`key`, `labels`, `path_length`, `action` of every rule with a host."""
    host = lower_ascii(F.regexp_extract(rule_col, "^[^/]*", 0))
    path = F.regexp_extract(rule_col, r"(?s)^[^/]*(.*)$", 1)
    known = rules.where(F.col(rule_col).isNotNull() & (host != ""))
    return known.select(
        F.concat(host, path).alias("key"), _labels(host).alias("labels"), F.length(path).alias("path_length"), F.col(action_col).alias("action")).distinct()


def _candidates(urls: DataFrame, shapes: list[tuple[int, int]], *keep: Column) -> DataFrame:
    """One row per URL and key that could fit it (one with a null key for URLs without): `keep`, `key`, `labels`."""
    listed = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(size).alias("path_length")) for n, size in shapes])
    fitting = F.filter(listed, lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["path_length"] <= F.length("path")))
    each = urls.select(*keep, "host", "path", F.explode_outer(fitting).alias("shape"))
    key = F.concat(_end_of(F.col("host"), F.col("shape.labels")), F.substring(F.col("path"), F.lit(1), F.col("shape.path_length")))
    return each.select(*[c for c in each.columns if c != "shape"], key.alias("key"), F.col("shape.labels").alias("labels"))


def verdicts(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *, max_words: int = MAX_WORDS,
) -> DataFrame:
    """`page_id`, `host`, `path`, `rule` (the longest that fits, else null), `verdict` (`allow` or `block`) of every row of `pages`.

    `rules` has the columns `rule` and `action` (`allow` or `block`).
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("best", F.lit(0).cast("long"))
    keys = stage(rule_keys(rules), "url-rules")
    # A shape is a number of labels and a length: no more of them than hosts have labels times lengths of paths.
    shapes = sorted((r["labels"], r["path_length"]) for r in keys.select("labels", "path_length").distinct().collect())
    if shapes:
        universe = _candidates(urls, shapes).where("key IS NOT NULL")
        size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
        count = keys.count()
        bits, _ = size_of(count, min(HALF, count * math.sqrt(0.5) / max(size, 1)))
        parts = -(-bits // (64 * max_words))
        urls = stage(urls, "url-rows") if parts > 1 else urls
        for part in range(parts):
            mine = lambda df: df.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)) == part)  # noqa: B023, E731
            block, allow = (cascade(mine(keys.where(F.col("action") == a)), mine(universe), max(1, size // parts)) for a in ("block", "allow"))
            urls = _matched(urls, shapes, block, allow, parts, part)
            urls = stage(urls, "url-rows") if part + 1 < parts else urls
    labels = F.shiftright(F.pmod("best", F.lit(_LENGTH)), 1).cast("int")
    length = F.floor(F.col("best") / _LENGTH).cast("int")
    end = _end_of(F.col("host"), labels)
    rule = F.when(F.col("best") > 0, F.concat(end, F.substring(F.col("path"), F.lit(1), length - F.length(end))))
    verdict = F.when(F.col("best") % 2 == 1, "block").otherwise("allow")
    return urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _matched(urls: DataFrame, shapes: list[tuple[int, int]], block: Cascade, allow: Cascade, parts: int, part: int) -> DataFrame:
    """`urls` with the best match so far as one number, after the keys of one part."""
    tried = _candidates(urls, shapes, F.col("row"), F.col("page_id"), F.col("best"))
    here = F.col("key").isNotNull()
    if parts > 1:
        here = here & (F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)) == part)
    number = F.length("key").cast("long") * _LENGTH + F.col("labels") * _LABELS
    found = F.when(here & block.lists(F.col("key")), number + 1).when(here & allow.lists(F.col("key")), number).otherwise(F.lit(0).cast("long"))
    return tried.groupBy("row", "page_id", "host", "path").agg(F.max(F.greatest("best", found)).alias("best"))
