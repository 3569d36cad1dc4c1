"""Column expressions for text: HTML stripping, entities, sentences, title words, shingles.

Everything here is a built-in expression, so no row leaves the JVM. Expressions over arrays run outside whole-stage code
generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood import config

# Every character the feeds' producers treat as white space, not only the ASCII ones. The range
# before && keeps the many letters that are no white space down to two cheap tests each.
WS = (
    r"[\x09\x0a\x0b\x0c\x0d\x20\xa0"
    r"[\x{1680}-\x{feff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]]"
)
_ENTITY = r"(?i)&(#x[0-9a-f]+|#\d+|[a-z]+);"
_BREAK = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row.

    Written out, an expression that uses its input several times would run the regular
    expressions below it once per use, and inside a lambda once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def _code_point(digits: Column, base: int) -> Column:
    """The character of a numeric entity; out-of-range codes become a blank."""
    bare = F.regexp_replace(digits, "^0+", "")
    code = F.conv(bare, base, 10).cast("long")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when((bare == "") | (F.length(bare) > 8), F.lit(" "))
        .when(code < 0x110000, char)
        .otherwise(F.lit(" "))
    )


def decode_entities(text: Column) -> Column:
    """Named and numeric HTML entities, decoded in one pass; unknown names are kept.

    The text between the entities and the entities themselves are cut apart and zipped back, so
    text that only looks like an entity after decoding stays as it is.
    """
    names = F.create_map(*[F.lit(x) for pair in config.ENTITIES.items() for x in pair])

    def decoded(entity: Column) -> Column:
        body = F.lower(F.substring(entity, 2, 2**30))
        name = F.substring_index(body, ";", 1)
        return (
            F.when(name.startswith("#x"), _code_point(F.substring(name, 3, 2**30), 16))
            .when(name.startswith("#"), _code_point(F.substring(name, 2, 2**30), 10))
            .otherwise(F.coalesce(F.try_element_at(names, name), entity))
        )

    def whole(t: Column) -> Column:
        entities = F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0))
        parts = F.split(t, _ENTITY, -1)
        zipped = F.zip_with(parts, entities, lambda part, e: F.concat(part, F.coalesce(decoded(e), F.lit(""))))
        return F.when(F.instr(t, "&") > 0, F.array_join(zipped, "")).otherwise(t)

    return let(text, whole)


def strip_html(text: Column) -> Column:
    """Script and style blocks, then tags, then entities, then tags those produced."""
    blocks = F.regexp_replace(text, r"(?i)<(script|style)[^>]*>[\s\S]*?</\1>", " ")
    tags = F.regexp_replace(blocks, "<[^>]*>", " ")
    decoded = F.regexp_replace(decode_entities(tags), "<[^>]*>", " ")
    return F.coalesce(collapse(decoded), F.lit(""))


def truncate(text: Column, limit: int) -> Column:
    """Cut at the last blank if it lies beyond 60 % of the limit, else at the limit."""

    def shortened(cut: Column) -> Column:
        from_end = F.instr(F.reverse(cut), " ")
        last_blank = F.when(from_end > 0, F.length(cut) - from_end).otherwise(-1)
        return F.trim(F.when(last_blank > limit * 0.6, F.substring(cut, F.lit(1), last_blank)).otherwise(cut))

    return let(
        text,
        lambda t: F.when(F.length(t) <= limit, t).otherwise(let(F.substring(t, 1, limit), shortened)),
    )


# ---- sentences -------------------------------------------------------------------------------------------------------------------------
#
# Sentence boundaries of Unicode Standard Annex 29. Its rules look at characters by class; the classes are character sets here, and the rules around one
# terminator (SB6 to SB11) are one pattern that takes the terminator and what belongs to it, so every character is read once.

# The property Sentence_Break of the Unicode Character Database.
_ATERM = r".\x{2024}\x{fe52}\x{ff0e}"
_STERM = (
    r"!?\x{589}\x{61d}-\x{61f}\x{6d4}\x{700}-\x{702}\x{7f9}\x{837}\x{839}\x{83d}\x{83e}\x{964}\x{965}\x{104a}\x{104b}\x{1362}\x{1367}\x{1368}\x{166e}"
    r"\x{1735}\x{1736}\x{1803}\x{1809}\x{1944}\x{1945}\x{1aa8}-\x{1aab}\x{1b5a}\x{1b5b}\x{1b5e}\x{1b5f}\x{1b7d}\x{1b7e}\x{1c3b}\x{1c3c}\x{1c7e}\x{1c7f}"
    r"\x{203c}\x{203d}\x{2047}-\x{2049}\x{2e2e}\x{2e3c}\x{2e53}\x{2e54}\x{3002}\x{a4ff}\x{a60e}\x{a60f}\x{a6f3}\x{a6f7}\x{a876}\x{a877}\x{a8ce}\x{a8cf}\x{a92f}"
    r"\x{a9c8}\x{a9c9}\x{aa5d}-\x{aa5f}\x{aaf0}\x{aaf1}\x{abeb}\x{fe56}\x{fe57}\x{ff01}\x{ff1f}\x{ff61}\x{10a56}\x{10a57}\x{11047}\x{11048}\x{110be}-\x{110c1}"
)
_CONTINUE = (
    r",\-:\x{55d}\x{60c}\x{60d}\x{7f8}\x{1802}\x{1808}\x{2013}\x{2014}\x{3001}\x{fe10}\x{fe11}\x{fe13}\x{fe31}\x{fe32}\x{fe50}\x{fe51}\x{fe55}\x{fe58}\x{fe63}"
    r"\x{ff0c}\x{ff0d}\x{ff1a}\x{ff64}"
)
_CLOSE = r"\p{Ps}\p{Pe}\p{Pi}\p{Pf}\"'\x{275b}-\x{275e}"
_BLANK = r"\x09\x0b\x0c\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_PARAGRAPH = r"\r\n\x{85}\x{2028}\x{2029}"
_UPPER, _LOWER = r"\p{IsUppercase}\p{Lt}", r"\p{IsLowercase}"


def _sentence_end() -> str:
    """What ends a sentence, up to where the next one begins."""
    paragraph = rf"(?:\r\n|[{_PARAGRAPH}])"
    marks = r"[\p{M}\p{Cf}]"  # SB5: marks and format characters count with what they follow
    tail = rf"(?:[{_CLOSE}]{marks}*+)*+(?:[{_BLANK}]{marks}*+)*+"
    goes_on = rf"[{_CONTINUE}{_ATERM}{_STERM}]"  # SB8a
    strong = rf"[{_STERM}]{marks}*+{tail}(?:{paragraph}|(?!{goes_on}))"
    number = r"\p{Nd}"  # SB6
    initial = rf"(?<=[{_UPPER}{_LOWER}]{marks}{{0,9}}[{_ATERM}]{marks}{{0,9}})[{_UPPER}]"  # SB7
    lower = rf"[^\p{{IsAlphabetic}}{_PARAGRAPH}{_ATERM}{_STERM}]*+[{_LOWER}]"  # SB8
    weak = rf"[{_ATERM}]{marks}*+(?!{number}|{initial}){tail}(?:{paragraph}|(?!{goes_on}|{lower}))"
    return f"{paragraph}|{strong}|{weak}"  # SB4; SB9 to SB11 are the tail


def split_sentences(text: Column) -> Column:
    """Sentences of a text, whole, by the sentence boundaries of Unicode; white space is collapsed.

    A sentence ends after `!`, `?` and their like in other scripts, after a full stop unless a lower-case letter, a digit, or an initial follows, and at the end of
    a paragraph; closing quotes and brackets stay with the sentence. A comma, dash or colon goes on with it.
    """
    marked = F.regexp_replace(text, f"(?:{_sentence_end()})", "$0" + _BREAK)
    return F.filter(F.transform(F.split(marked, _BREAK, -1), collapse), lambda s: s != "")


def build_sentences(title: Column, excerpt: Column) -> Column:
    """Numbered sentences `{id, text}`: the title is S1, the excerpt follows.

    A sentence of the excerpt that repeats the title, ignoring case, is left out.
    """
    head = collapse(F.coalesce(title, F.lit("")))
    pieces = split_sentences(F.coalesce(excerpt, F.lit("")))

    def numbered(h: Column) -> Column:
        texts = F.concat(F.array(h["head"]), F.filter(pieces, lambda s: F.lower(s) != h["lower"]))
        return F.transform(
            F.filter(texts, lambda s: s != ""),
            lambda s, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("id"), s.alias("text")),
        )

    return let(let(head, lambda h: F.struct(h.alias("head"), F.lower(h).alias("lower"))), numbered)


def title_words(title: Column) -> Column:
    """Content words of a title in order: lower case, no apostrophes, no stop words."""
    bare = F.regexp_replace(F.lower(title), "[’']", "")
    stop = F.array(*[F.lit(w) for w in config.STOPWORDS])
    return F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def shingles(words: Column, size: int = config.SHINGLE_WORDS) -> Column:
    """The set of word n-grams; a shorter title is the set of its words."""

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (size - 1))
        return F.when(F.size(w) < size, w).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")))

    return F.array_distinct(let(words, grams))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets held as arrays without duplicates; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 0.0).otherwise(common / union)


def neutralise_tags(text: Column) -> Column:
    """Angle brackets become blanks, so quoted text cannot close a tagged block."""
    return F.regexp_replace(text, "[<>]", " ")


def banned_phrase(text: Column) -> Column:
    """The first advice phrase found as whole words, or NULL.

    The nouns "sell-off" and "buy-back" are reporting, so they are taken out first.
    """
    cleaned = F.regexp_replace(text, r"(?i)\b(sell-?offs?|buy-?backs?)\b", " ")

    def first_found(t: Column) -> Column:
        whole = lambda phrase: r"(?iu)(?<![\p{L}\p{N}])" + phrase.replace(" ", r"\s+") + r"(?![\p{L}\p{N}])"
        return F.coalesce(*[F.when(t.rlike(whole(p)), F.lit(p)) for p in config.BANNED_PHRASES])

    return let(cleaned, first_found)
