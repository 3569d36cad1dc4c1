"""The same mapped tables as plain SQL, written on their own for the SQL checks."""

from __future__ import annotations

_WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def asset(expr: str) -> str:
    return f"'a' || lpad(CAST(({expr}) % 10 + 1 AS VARCHAR), 2, '0')"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{_WS}', ' ', 'g'))"


def truncate(expr: str, n: int = 500) -> str:
    """Cut at the last blank if it lies beyond 60 % of the limit."""
    cut = f"substr({expr}, 1, {n})"
    back = f"instr(reverse({cut}), ' ')"
    return (
        f"CASE WHEN length({expr}) <= {n} THEN {expr} "
        f"WHEN {back} > 0 AND length({cut}) - {back} > {n * 0.6} THEN trim(substr({cut}, 1, length({cut}) - {back})) "
        f"ELSE trim({cut}) END"
    )


def strip_html(expr: str) -> str:
    blocks = f"regexp_replace(regexp_replace({expr}, '<script[^>]*>[\\s\\S]*?</script>', ' ', 'gi'), '<style[^>]*>[\\s\\S]*?</style>', ' ', 'gi')"
    out = f"regexp_replace({blocks}, '<[^>]*>', ' ', 'g')"
    for name, char in (
        ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("hellip", "…"), ("mdash", "—"),
        ("ndash", "–"), ("rsquo", "’"), ("lsquo", "‘"), ("rdquo", "”"), ("ldquo", "“"), ("amp", "&"),
    ):
        out = f"regexp_replace({out}, '&{name};', '{char}', 'gi')"
    return collapse(f"regexp_replace({out}, '<[^>]*>', ' ', 'g')")


ALIASES = [
    ("a01", "thanedble", "i"), ("a01", "attion to", "i"), ("a02", "thtion", "i"), ("a03", "Eriner", "c"), ("a04", "thing", "i"),
    ("a05", "thble", "i"), ("a06", "erre", "i"), ("a07", "ernd", "i"), ("a07", "ered", "i"), ("a08", "the anea", "i"),
    ("a09", "Thnt", "c"), ("a10", "zzunknown", "i"),
]
_EDGE = r"[^\p{L}\p{N}]"
_ALIAS_TESTS = ", ".join(
    f"CASE WHEN regexp_matches(txt, '(^|{_EDGE}){alias.replace(' ', chr(92) + 's+')}($|{_EDGE})', '{flag}') THEN '{asset_id}' END"
    for asset_id, alias, flag in ALIASES
)
EVENT_TIME = "coalesce(published_at, fetched_at)"


def r3(expr: str) -> str:
    return f"floor(({expr}) * 1000 + 0.5) / 1000"


def sentence_breaks(text: str) -> str:
    """Sentence boundaries of Unicode without look-around: terminators after which a sentence goes on are set aside first, then the others get a mark."""
    tail = r"""["''()\[\]{}“”‘’«»]* *"""
    terminators = "[.!?,:\\-' || chr(2) || chr(3) || chr(4) || '"
    held = {".": "chr(2)", "!": "chr(3)", "?": "chr(4)"}
    steps = [(r"\.([0-9])", "chr(2) || '\\1'")] + 2 * [(r"(\p{L})\.(\p{Lu})", "'\\1' || chr(2) || '\\2'")]
    steps += [(rf"\.({tail}[^\p{{L}}.!?' || chr(2) || chr(3) || chr(4) || ']*\p{{Ll}})", "chr(2) || '\\1'")]
    steps += 2 * [(rf"[{c}]({tail}{terminators}])", f"{mark} || '\\1'") for c, mark in held.items()]
    steps += [(rf"([.!?]{tail})", "'\\1' || chr(1)")]
    for pattern, into in steps:
        text = f"regexp_replace({text}, '{pattern}', {into}, 'g')"
    return f"translate({text}, chr(2) || chr(3) || chr(4), '.!?')"


# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "sources": ([], """
        SELECT source AS source_id, 'Source ' || n AS name,
               CASE WHEN n % 10 = 3 THEN 'http' ELSE 'https' END || '://feeds.example/' || source AS feed_url,
               source || '.example' AS site_domain,
               CASE n % 4 WHEN 0 THEN 'central_bank' WHEN 1 THEN 'news' WHEN 2 THEN 'markets' ELSE 'blog' END AS kind,
               n % 7 <> 0 AS is_active, 'e' || n AS etag, 'm' || n AS last_modified,
               TIMESTAMP '2024-01-30 10:00:00' + INTERVAL (n) MINUTE AS last_fetched_at, '200' AS last_status,
               n % 6 AS consecutive_failures
        FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS n FROM documents)"""),
    "articles": ([], f"""
        SELECT doc_id AS article_id, CASE WHEN lang = 'de' THEN 'x-' || source ELSE source END AS source_id,
               'https://news.example/' || doc_id AS url, sha256('https://news.example/' || doc_id) AS url_hash,
               head AS title, body AS excerpt,
               CASE WHEN doc_id % 10 <> 0 THEN t0 END AS published_at, t0 + INTERVAL 30 MINUTE AS fetched_at,
               CASE WHEN n_chars % 7 <> 0 THEN 'st' || (n_chars % 97) END AS story_id, lang AS language
        FROM (SELECT *, {collapse("regexp_extract(text, '^[^\\n.]*')")} AS head, {collapse('text')} AS body,
                     TIMESTAMP '2024-01-30 12:00:00' - INTERVAL (5 * (doc_id % 2016)) MINUTE AS t0
              FROM documents)"""),
    "assets": ([], """
        SELECT 'a' || lpad(CAST(n AS VARCHAR), 2, '0') AS asset_id, 'a' || lpad(CAST(n AS VARCHAR), 2, '0') AS slug,
               'Asset ' || lpad(CAST(n AS VARCHAR), 2, '0') AS name,
               CASE n % 5 WHEN 0 THEN 'central_bank' WHEN 1 THEN 'currency_pair' WHEN 2 THEN 'commodity'
                          WHEN 3 THEN 'index' ELSE 'stock' END AS asset_type
        FROM range(1, 11) t(n)"""),
    "aliases": ([], "SELECT * FROM (VALUES "
                + ", ".join(f"('{a}', '{x}', {'true' if f == 'c' else 'false'})" for a, x, f in ALIASES)
                + ") v(asset_id, alias, is_case_sensitive)"),
    "stories": (["articles"], f"""
        SELECT story_id, arg_min(title, struct_pack(t := {EVENT_TIME}, a := article_id)) AS headline,
               count(*) AS article_count, count(DISTINCT source_id) AS source_count,
               min({EVENT_TIME}) AS first_seen_at, max({EVENT_TIME}) AS last_seen_at
        FROM articles WHERE story_id IS NOT NULL GROUP BY story_id"""),
    "sentences": (["articles"], r"""
        SELECT article_id, pos, 'S' || pos AS sid, txt FROM (
          SELECT article_id, txt, row_number() OVER (PARTITION BY article_id ORDER BY raw_pos) AS pos FROM (
            SELECT article_id, 0 AS raw_pos, title AS txt, title AS head FROM articles
            UNION ALL
            SELECT article_id, raw_pos, s, head FROM (
              SELECT article_id, title AS head, trim(unnest(parts)) AS s, unnest(range(1, len(parts) + 1)) AS raw_pos
              FROM (SELECT article_id, title, string_split("""+sentence_breaks("excerpt")+r""", chr(1)) AS parts FROM articles))
          ) WHERE txt <> '' AND (raw_pos = 0 OR lower(txt) <> lower(head)))"""),
    # One scan with a constant pattern per alias: patterns from a column are compiled for every row.
    "hits": (["sentences"], f"""
        SELECT DISTINCT article_id, pos, unnest(found) AS asset_id FROM (
          SELECT article_id, pos, list_filter([{_ALIAS_TESTS}], lambda x: x IS NOT NULL) AS found FROM sentences)"""),
    "mention_sentences": (["ranked_hits", "sentences"], """
        SELECT article_id, asset_id, pos, sid, txt FROM (
          SELECT *, row_number() OVER (PARTITION BY article_id, asset_id ORDER BY prio) AS place FROM (
            SELECT article_id, asset_id, pos, min(prio) AS prio FROM (
              SELECT article_id, asset_id, pos, turn AS prio FROM ranked_hits
              UNION ALL SELECT article_id, asset_id, pos - 1, 1000000 + 2 * turn FROM ranked_hits
              UNION ALL SELECT article_id, asset_id, pos + 1, 1000001 + 2 * turn FROM ranked_hits)
            GROUP BY ALL)
          JOIN sentences USING (article_id, pos)) WHERE place <= 6"""),
    "ranked_hits": (["hits"], """
        SELECT *, row_number() OVER (PARTITION BY article_id, asset_id ORDER BY pos) AS turn FROM hits"""),
    "mentions": (["mention_sentences"], """
        SELECT article_id, asset_id, list(sid ORDER BY pos) AS sids, list(txt ORDER BY pos) AS texts
        FROM mention_sentences GROUP BY article_id, asset_id"""),
    "mention_signals": (["mentions", "articles"], """
        SELECT article_id, asset_id,
               CASE WHEN kind = 0 THEN 'neutral' WHEN kind IN (1, 5) THEN 'unclear'
                    WHEN kind IN (2, 3) THEN CASE WHEN n % 5 = 0 THEN 'hawkish' ELSE 'bullish' END
                    ELSE CASE WHEN n % 5 = 0 THEN 'dovish' ELSE 'bearish' END END AS stance,
               CASE WHEN kind = 5 THEN 0 ELSE (article_id + n * 7) % 4 END AS strength,
               CASE WHEN kind <> 5 THEN sids[1] END AS evidence_id, 'w' || kind AS why,
               CASE WHEN kind = 5 THEN 'failed' WHEN kind = 1 THEN 'unclear' ELSE 'ok' END AS status,
               fetched_at + INTERVAL (n) MINUTE AS created_at, fetched_at, event_at
        FROM (SELECT m.*, a.fetched_at, coalesce(a.published_at, a.fetched_at) AS event_at,
                     CAST(substr(asset_id, 2, 2) AS INTEGER) AS n,
                     CASE WHEN toxic = 1 THEN 5 ELSE (article_id + CAST(substr(asset_id, 2, 2) AS INTEGER)) % 6 END AS kind
              FROM mentions m JOIN labels l ON l.doc_id = m.article_id JOIN articles a USING (article_id))"""),
    "ev": ([], """
        SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events"""),
    "signals": (["ev"], f"""
        SELECT event_id AS article_id, {asset('user_id')} AS asset_id, 'src' || (k % 6) AS source_id,
               CASE WHEN k % 5 <> 0 THEN 'st' || (k % 8) END AS story_id,
               CASE WHEN event_type = 'click' OR (event_type = 'signup' AND value < 20) THEN 'unclear'
                    WHEN event_type = 'view' THEN 'neutral'
                    WHEN event_type = 'error' THEN CASE WHEN user_id % 5 = 4 THEN 'dovish' ELSE 'bearish' END
                    WHEN user_id % 5 = 4 THEN 'hawkish' ELSE 'bullish' END AS stance,
               v % 4 AS strength,
               CASE WHEN event_type = 'signup' AND value < 20 THEN 'failed' WHEN event_type = 'click' THEN 'unclear'
                    ELSE 'ok' END AS status,
               ts AS event_at, ts AS created_at, ts + INTERVAL 30 MINUTE AS fetched_at
        FROM ev"""),
    "votes": (["signals"], """
        SELECT *, CASE WHEN stance IN ('bullish', 'hawkish') THEN 1 WHEN stance = 'neutral' THEN 0 ELSE -1 END AS direction
        FROM (SELECT *, CAST(event_at AS DATE) AS day, coalesce(story_id, 'article:' || article_id) AS story_key
              FROM signals WHERE status = 'ok')
        QUALIFY row_number() OVER (PARTITION BY asset_id, day, source_id, story_key
                                   ORDER BY strength DESC, event_at DESC, created_at, article_id) = 1"""),
    "mood": (["votes"], f"""
        SELECT asset_id, day, {r3('s')} AS score, sources AS source_count, n AS article_count, {r3('agree')} AS agreement,
               CASE WHEN sources >= 3 AND agree >= 0.7 THEN 'high' WHEN sources >= 2 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT asset_id, day, any_value(s) AS s, count(DISTINCT source_id) AS sources, count(*) AS n,
                     avg(CASE WHEN sign(direction) = CASE WHEN s > 1e-9 THEN 1 WHEN s < -1e-9 THEN -1 ELSE 0 END
                              THEN 1.0 ELSE 0.0 END) AS agree
              FROM (SELECT *, CASE WHEN sum(w) OVER d > 0 THEN greatest(-1, least(1, sum(w * direction) OVER d / sum(w) OVER d))
                                   ELSE 0 END AS s
                    FROM (SELECT *, strength / 3.0
                             * pow(0.5, greatest(0, epoch_us(least(TIMESTAMP '2024-01-31', CAST(day + 1 AS TIMESTAMP))) - epoch_us(event_at)) / 86400e6)
                             / count(*) OVER (PARTITION BY asset_id, day, source_id) AS w FROM votes)
                    WINDOW d AS (PARTITION BY asset_id, day))
              GROUP BY asset_id, day)"""),
    "pairs": (["ev"], """
        SELECT event_id AS example_id,
               CASE event_type WHEN 'click' THEN 'unclear' WHEN 'view' THEN 'neutral' WHEN 'error' THEN 'bearish'
                    WHEN 'signup' THEN 'bullish' ELSE 'hawkish' END AS gold,
               ['bullish','bearish','hawkish','dovish','neutral','unclear','skipped','validation_failed'][v % 8 + 1] AS pred,
               ['standard','multi_asset','not_in_title'][k % 3 + 1] AS bucket,
               ['central_bank','currency_pair','commodity','index','stock'][user_id % 5 + 1] AS asset_type,
               'src' || (k % 6) AS source,
               CASE v % 8 WHEN 6 THEN NULL WHEN 7 THEN 'failed' WHEN 5 THEN 'unclear' ELSE 'ok' END AS status,
               ['S' || (k % 6 + 1), 'S' || (v % 6 + 1)] AS evidence_ids,
               CASE WHEN k % 4 = 0 THEN [] ELSE ['S' || ((k + 1) % 6 + 1)] END AS gold_ids,
               CASE WHEN v % 8 <> 6 THEN k % 9 <> 0 END AS first_attempt_ok,
               ['supports','partial','does_not_support'][v % 3 + 1] AS verdict, v * 10 AS latency_ms,
               CASE WHEN k % 3 = 0 THEN 'author' ELSE 'rater' || (k % 3) END AS labelled_by
        FROM ev"""),
    "prices": ([], f"""
        SELECT {asset('o_custkey')} AS asset_id,
               CAST(o_orderdate AS DATE) + CAST(date_diff('day', DATE '2001-08-01', DATE '2024-01-30') AS INTEGER) AS day,
               arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
               arg_max(o_totalprice, o_orderkey) AS close
        FROM orders GROUP BY 1, 2"""),
    "raw_candles": ([], """
        SELECT 'SYM' || (l_suppkey % 12) AS symbol,
               CAST(CAST(epoch(l_shipdate) AS BIGINT) + (l_orderkey * 10 + l_linenumber) % 86400 AS VARCHAR) AS epoch,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS open,
               CAST(l_extendedprice * 2 * (1 + l_tax) AS VARCHAR) AS high,
               CAST(l_extendedprice * 2 * (1 + l_discount / 2) AS VARCHAR) AS low,
               CASE WHEN l_quantity = 1 THEN '0' ELSE CAST(l_extendedprice AS VARCHAR) END AS close
        FROM lineitem"""),
    "candles": (["raw_candles"], """
        SELECT symbol, o.epoch, o.open, o.high, o.low, o.close FROM (
          SELECT symbol, struct_pack(epoch := TRY_CAST(epoch AS DOUBLE), open := TRY_CAST(open AS DOUBLE), high := TRY_CAST(high AS DOUBLE),
                 low := TRY_CAST(low AS DOUBLE), close := TRY_CAST(close AS DOUBLE)) AS o FROM raw_candles)
        WHERE o.epoch IS NOT NULL AND o.open IS NOT NULL AND o.close > 0 AND o.high >= o.low"""),
    "calls": ([], """
        SELECT CASE WHEN l_linestatus = 'F' THEN 'stance' ELSE 'brief' END AS stage, l_returnflag AS model,
               ['ok','schema_retry','failed','timeout','rate_limited'][l_linenumber % 5 + 1] AS status,
               CASE WHEN l_discount > 0 THEN CAST(l_quantity AS INTEGER) END AS input_tokens, l_partkey % 97 AS output_tokens,
               l_shipdate AS created_at FROM lineitem"""),
    "fetches": (["ev"], """
        SELECT 'src' || (k % 20) AS source_id, event_id AS fetch_id, ts AS fetched_at,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'not_modified' ELSE 'ok' END AS outcome FROM ev"""),
    "outcomes": (["fetches"], """
        SELECT source_id, outcome, CASE outcome WHEN 'error' THEN 'http_500' WHEN 'ok' THEN '200' ELSE '304' END AS status,
               CASE WHEN fetch_id % 2 = 0 THEN 'new-' || fetch_id END AS etag
        FROM fetches QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, fetch_id DESC) = 1"""),
    "feed_items": ([], """
        SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS feed,
               regexp_extract(html, '(?i)<title>([\\s\\S]*?)</title>', 1) AS title, url AS link, html AS summary,
               TIMESTAMP '2024-01-30 12:00:00' - INTERVAL (page_id % 10) DAY AS item_at FROM pages"""),
    "clean_items": (["feed_items"], f"""
        SELECT page_id, feed, title, url, sha256(url) AS url_hash, excerpt, published_at,
               CASE WHEN title = '' THEN 'no_title' WHEN url IS NULL THEN 'bad_url'
                    WHEN published_at < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY THEN 'too_old' END AS reject_reason
        FROM (SELECT page_id, feed, t AS title, {truncate('s')} AS excerpt, least(item_at, TIMESTAMP '2024-01-31') AS published_at,
                     scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
                       || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url
              FROM (SELECT *, {strip_html('title')} AS t, {strip_html('summary')} AS s,
                           lower(regexp_extract(link, '^(https?)://', 1, 'i')) AS scheme,
                           lower(regexp_extract(link, '^https?://([^/?#]*)', 1, 'i')) AS host,
                           regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1, 'i') AS path,
                           list_filter(string_split(regexp_extract(link, '^[^?#]*\\?([^#]*)', 1), '&'),
                             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)', 'i')) AS kept
                    FROM feed_items))"""),
    "watchlists": ([], f"""
        SELECT o_custkey AS user_id, {asset('o_orderkey')} AS asset_id, min(o_orderdate) AS added_at FROM orders GROUP BY 1, 2"""),
    "requested": ([], f"""
        SELECT o_custkey AS user_id, {asset('o_orderkey * 3')} AS slug FROM orders
        UNION SELECT o_custkey, 'zz-unknown' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 490000
        UNION SELECT o_custkey, 'NOT A SLUG' FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 490000"""),
    "users": ([], """
        SELECT c_custkey AS user_id, c_acctbal > 5000 AS beginner_mode,
               CASE WHEN c_acctbal > 5000 THEN 'beginner' ELSE 'standard' END AS level FROM customer"""),
    "hashes": (["watchlists"], """
        SELECT user_id, sha256(string_agg(asset_id, ',' ORDER BY asset_id)) AS watchlist_hash FROM watchlists GROUP BY user_id"""),
    "briefs_log": ([], """
        SELECT o_custkey AS user_id, TIMESTAMP '2024-01-31' + INTERVAL (CASE WHEN o_orderstatus <> 'P'
               THEN o_orderkey % 86400 ELSE -1 - o_orderkey % 86400 END) SECOND AS created_at FROM orders"""),
    "bullets": (["ev"], f"""
        SELECT user_id, event_id AS bullet_no,
               CASE event_type WHEN 'click' THEN ' Stocks fell in a sell-off. ' WHEN 'view' THEN 'You should wait, then BUY.'
                    WHEN 'error' THEN 'Investors SELL gold.' WHEN 'signup' THEN 'Analysts raised the price  target.'
                    ELSE 'Selling slowed; buybacks rose.' END AS txt,
               [{asset('k')}, {asset('k + user_id')}] AS asset_slugs, ['art' || (k % 7), 'art' || (v % 9)] AS article_ids FROM ev"""),
    "part_assets": ([], """
        SELECT 'p' || p_partkey AS asset_id, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) || '-' || p_partkey AS slug,
               p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'commodity' WHEN 'LARGE' THEN 'stock' WHEN 'MEDIUM' THEN 'index'
                 WHEN 'PROMO' THEN 'crypto' WHEN 'SMALL' THEN 'currency_pair' WHEN 'STANDARD' THEN 'central_bank' END AS asset_type,
               p_brand AS description_simple FROM part"""),
    "part_aliases": ([], """
        SELECT DISTINCT 'p' || p_partkey AS asset_id, unnest(string_split(p_name, ' ')) AS alias, false AS is_case_sensitive FROM part
        UNION SELECT 'p' || p_partkey, p_brand, true FROM part WHERE p_size > 25"""),
    "shingle_sets": (["articles"], r"""
        SELECT article_id, title, source_id, story_id, fetched_at, event_at,
               list_distinct(CASE WHEN len(w) < 3 THEN w ELSE
                 list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh
        FROM (SELECT *, coalesce(published_at, fetched_at) AS event_at,
                list_filter(regexp_split_to_array(regexp_replace(lower(title), '[’'']', '', 'g'), '[^\p{L}\p{N}]+'),
                  lambda x: x <> '' AND NOT list_contains(string_split('a an and are as at be by for from has have in into is it its of on or over says said than that the their this to up was were will with after amid as but', ' '), x)) AS w
              FROM articles)"""),
    "postings": (["shingle_sets"], """
        SELECT article_id, event_at, len(sh) AS n, unnest(sh) AS shingle FROM shingle_sets"""),
    "near_pairs": (["postings"], """
        SELECT a.article_id AS a, b.article_id AS b, any_value(a.event_at) AS ta, any_value(b.event_at) AS tb,
               count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim
        FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.article_id <> b.article_id
         AND b.event_at BETWEEN a.event_at - INTERVAL 48 HOUR AND a.event_at + INTERVAL 48 HOUR
        GROUP BY a.article_id, b.article_id
        HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5"""),
}


def compose(select: str, needs: list[str] | None = None, recursive: str = "") -> str:
    """A query with the views it needs as CTEs; `recursive` holds further, possibly recursive, CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dependency in VIEWS[name][0]:
            add(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in needs or []:
        add(name)
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name][1].strip()})" for name in ordered]
    if recursive:
        parts.append(recursive.strip())
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    return head + select.strip()
