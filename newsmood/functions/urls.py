"""Canonical article URLs and their hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood import config
from newsmood.functions.text import WS, let

_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"


def canonical_url(raw: Column) -> Column:
    """http/https only, no credentials, lower-case host, no fragment, no tracking parameters.

    Dot segments are resolved, and characters that a URL cannot hold are percent-encoded, as URL parsers do. Anything else is NULL.
    International host names are written in their ASCII form (see `ascii_host`).
    """
    return let(F.regexp_replace(raw, f"^{WS}+|{WS}+$", ""), lambda url: F.when(url.rlike(_PARTS), _rebuild(url)))


# Characters that are percent-encoded in a path and in a query.
_PATH_UNSAFE, _QUERY_UNSAFE = r"""[^\x21-\x7e]|["<>`{}^]""", r"""[^\x21-\x7e]|["<>']"""
_DOTS = ["..", ".%2e", "%2e.", "%2e%2e"]


def _encoded(part: Column, unsafe: str) -> Column:
    """The part with every unsafe character as the percent-encoded bytes of its UTF-8 form."""
    as_bytes = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    each = F.transform(F.split(part, ""), lambda c: F.when(c.rlike(unsafe), as_bytes(c)).otherwise(c))
    return F.when(part.rlike(unsafe), F.array_join(each, "")).otherwise(part)


def _resolved(path: Column) -> Column:
    """The path without `.` and `..` segments; backslashes are slashes."""

    def walked(segments: Column) -> Column:
        last = F.lower(F.element_at(segments, -1))
        climb = lambda done: F.slice(done, F.lit(1), F.greatest(F.lit(1), F.size(done) - 1))
        done = F.aggregate(
            F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")),
            lambda done, s: F.when(F.lower(s).isin(".", "%2e"), done).when(F.lower(s).isin(_DOTS), climb(done)).otherwise(F.concat(done, F.array(s))),
        )
        return F.array_join(F.when(last.isin(".", "%2e", *_DOTS), F.concat(done, F.array(F.lit("")))).otherwise(done), "/")

    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), walked(F.split(slashed, "/", -1))).otherwise(slashed)


# ---- international host names -------------------------------------------------------------------------------------------------------
#
# Punycode (RFC 3492) as an expression. The RFC walks a label once per code point that is not ASCII; here every such character is taken in the order of
# (code point, position), and its delta follows from how many of the characters placed before it stand left of it.

# Fixed values of RFC 3492.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def _digit(value: Column) -> Column:
    return F.substring(F.lit(_DIGITS), (value + 1).cast("int"), F.lit(1))


def _variable_length(delta: Column, bias: Column) -> Column:
    """A delta in digits of growing thresholds; eight are enough for any."""

    def step(v: Column, k: Column) -> Column:
        t = F.least(F.greatest(k * _BASE - bias, F.lit(_T_MIN)), F.lit(_T_MAX)).cast("long")
        left = v["q"] - t
        state = lambda q, out, done: F.struct(q.alias("q"), out.alias("out"), F.lit(done).alias("done"))
        return (
            F.when(v["done"], v)
            .when(v["q"] < t, state(v["q"], F.concat(v["out"], _digit(v["q"])), True))
            .otherwise(state(_whole(left / (_BASE - t)), F.concat(v["out"], _digit(t + left % (_BASE - t))), False))
        )

    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda v: v["out"])


def _next_bias(delta: Column, placed: Column, is_first: Column) -> Column:
    limit = (_BASE - _T_MIN) * _T_MAX // 2
    damped = _whole(delta / F.when(is_first, _DAMP).otherwise(2))
    start = F.struct((damped + _whole(damped / placed)).alias("d"), F.lit(0).cast("long").alias("k"))
    smaller = lambda v, _: F.when(v["d"] <= limit, v).otherwise(F.struct(_whole(v["d"] / (_BASE - _T_MIN)).alias("d"), (v["k"] + _BASE).alias("k")))
    end = lambda v: v["k"] + _whole((_BASE - _T_MIN + 1) * v["d"] / (v["d"] + _SKEW))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, smaller, end)


def punycode_label(label: Column) -> Column:
    """A lower-case host label as `xn--...` if it has characters beyond ASCII."""

    def encoded(p: Column) -> Column:
        codes, basic = p["codes"], p["basic"]
        others = F.array_sort(F.filter(F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.alias("at"))), lambda x: x["code"] >= _FIRST))
        placed_left = lambda o: F.size(F.filter(F.slice(codes, F.lit(1), o["at"]), lambda c: c <= o["code"]))
        places = F.transform(others, lambda o: F.struct(o["code"].cast("long").alias("code"), placed_left(o).cast("long").alias("place")))
        n_basic = F.length(basic).cast("long")

        def step(s: Column, o: Column) -> Column:
            delta = (o["code"] - s["code"]) * (s["size"] + 1) + o["place"] - s["place"]
            return let(delta, lambda d: F.struct(
                o["code"].alias("code"), (o["place"] + 1).alias("place"), (s["size"] + 1).alias("size"),
                _next_bias(d, s["size"] + 1, s["size"] == n_basic).alias("bias"), F.concat(s["out"], _variable_length(d, s["bias"])).alias("out")))

        number = lambda x, name: x.cast("long").alias(name)
        start = F.struct(number(F.lit(_FIRST), "code"), number(F.lit(0), "place"), number(n_basic, "size"), number(F.lit(_BIAS), "bias"), F.lit("").alias("out"))
        out = F.aggregate(places, start, step, lambda s: s["out"])
        return F.concat(F.lit("xn--"), F.when(basic == "", "").otherwise(F.concat(basic, F.lit("-"))), out)

    parts = F.struct(F.transform(F.split(label, ""), F.ascii).alias("codes"), F.regexp_replace(label, r"[^\x00-\x7f]", "").alias("basic"))
    return F.when(label.rlike(r"[^\x00-\x7f]"), let(parts, encoded)).otherwise(label)


def ascii_host(host: Column) -> Column:
    """A lower-case host with international labels in punycode; full stops of other scripts part labels like a dot.

    Letters are not mapped or composed otherwise: a host has to be written in composed, lower-case letters to meet its punycode.
    """
    dotted = F.translate(host, "\u3002\uff0e\uff61", "...")
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(dotted, r"\.", -1), punycode_label), ".")).otherwise(host)


def _rebuild(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    pieces = F.struct(
        F.lower(part(1)).alias("scheme"), ascii_host(F.lower(part(2))).alias("authority"), part(3).alias("path"),
        part(4).alias("query"), F.split(F.substring(part(4), 2, 2**30), "&", -1).alias("params"),
    )

    def joined(p: Column) -> Column:
        default_port = F.when(p["scheme"] == "https", ":443").otherwise(":80")
        host = F.when(
            p["authority"].endswith(":") | F.endswith(p["authority"], default_port),
            F.regexp_replace(p["authority"], ":[0-9]*$", ""),
        ).otherwise(p["authority"])
        path = F.when(p["path"] == "", "/").otherwise(_encoded(_resolved(p["path"]), _PATH_UNSAFE))
        key = lambda x: F.lower(F.substring_index(x, "=", 1))
        kept = F.filter(
            p["params"], lambda x: ~(key(x).startswith(config.TRACKING_PREFIX) | key(x).isin(config.TRACKING_PARAMS))
        )
        query = let(
            kept,
            lambda k: F.when(F.size(k) == F.size(p["params"]), p["query"])
            .when(F.size(k) == 0, "")
            .otherwise(F.concat(F.lit("?"), F.array_join(k, "&"))),
        )
        bad_host = (host == "") | host.contains("@") | host.rlike(r"[\s<>\\^|%]")
        return F.when(~bad_host, F.concat(p["scheme"], F.lit("://"), host, path, _encoded(query, _QUERY_UNSAFE)))

    return let(pieces, joined)


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)
