"""Item cleaning on inputs of our own: markup, entities, links, dates, reasons; feed and label files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsmood.functions import numbers, text, urls
from newsmood.operators import clean
from newsmood.sources import feeds, labels_csv
from tests.conftest import rows

AS_OF = "2031-03-10 06:00:00"


def each(spark, fn, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("html", "plain"),
    [
        ("<h1>Tide</h1><p>table</p>", "Tide table"),
        ("left<script type='x'>if (a < b) {}</script>right", "left right"),
        ("<style media=print>h1 > p {}</style> ferry <img src=q>", "ferry"),
        ("3 &lt; 4 &gt; 2", "3 2"),  # what decoding turns into a tag goes as well
        ("\t two wide blanks ", "two wide blanks"),
        (None, ""),
    ],
)
def test_markup(spark, html, plain):
    assert each(spark, text.strip_html, html) == [plain]


def test_entities(spark):
    cases = {
        "salt &amp; pepper": "salt & pepper", "&#65;&#x42;&#X43;": "ABC", "&amp;#65;": "&#65;", "&unheard;": "&unheard;",
        "&#128674;": "🚢", "&#x1F30A; wave": "🌊 wave", "&#000;": " ", "&#1114112;": " ", "&QUOT;": '"', "& alone;": "& alone;",
    }
    assert each(spark, text.decode_entities, *cases) == list(cases.values())


def test_links(spark):
    cases = {
        "https://Harbour.Test/Quay?b=2&utm_campaign=z&a=1#pier": "https://harbour.test/Quay?b=2&a=1",
        "http://harbour.test:80": "http://harbour.test/", "https://harbour.test:8443/q": "https://harbour.test:8443/q",
        "https://harbour.test/?gclid=7&mc_eid=8": "https://harbour.test/",
        "https://harbour.test/a/./b/../c": "https://harbour.test/a/c", "https://harbour.test/../x/%2E%2e/": "https://harbour.test/",
        "https://harbour.test/d\\e/.": "https://harbour.test/d/e/", "https://harbour.test/kü ste?q=é 1": "https://harbour.test/k%C3%BC%20ste?q=%C3%A9%201",
        "https://harbour.test/%e2%82%ac": "https://harbour.test/%e2%82%ac", "https://harbour.test/a..b/.c": "https://harbour.test/a..b/.c",
        "mailto:quay@harbour.test": None, "//harbour.test/q": None, "quay": None, " ": None,
    }
    assert each(spark, urls.canonical_url, *cases) == list(cases.values())


def test_display_cut(spark):
    cut = lambda c: text.truncate(c, 20)
    assert each(spark, cut, "twenty characters ok", "a longer line of several words", "x" * 25, "ab " + "y" * 25) == [
        "twenty characters ok", "a longer line of", "x" * 20, "ab " + "y" * 17]


def test_dates(spark):
    cases = {
        "Fri, 07 Mar 2031 05:06:07 GMT": datetime(2031, 3, 7, 5, 6, 7), "7 Mar 2031 05:06 -0330": datetime(2031, 3, 7, 8, 36),
        "2031-03-07T05:06:07+02:00": datetime(2031, 3, 7, 3, 6, 7), "2031-03-07": datetime(2031, 3, 7), "at low tide": None,
    }
    assert each(spark, numbers.parse_date, *cases) == list(cases.values())


def test_first_failing_rule_decides(spark):
    data = [
        ("blank", " <i></i> ", "nolink", None, "2001-01-01"), ("link", "Buoy", "tel:1", None, "2001-01-01"),
        ("old", "Buoy", "https://b.test/1", None, "2031-03-03T05:59:59Z"), ("border", "Buoy", "https://b.test/2", None, "2031-03-03T06:00:00Z"),
        ("ahead", "Buoy", "https://b.test/3", None, "2099-01-01"), ("undated", "Buoy", "https://b.test/4", "", "low tide"),
    ]
    items = spark.createDataFrame(data, "name string, title string, link string, summary string, date string")
    got = {r["name"]: (r["reject_reason"], r["published_at"]) for r in rows(clean.normalise_items(items, AS_OF))}
    assert {k: v[0] for k, v in got.items()} == {
        "blank": "no_title", "link": "bad_url", "old": "too_old", "border": None, "ahead": None, "undated": None}
    assert got["ahead"][1] == datetime(2031, 3, 10, 6) and got["undated"][1] is None


def test_title_and_body_stay_whole(spark):
    long_title, long_body = "mast " * 200, "sail " * 400 + "rudder"
    items = spark.createDataFrame([(long_title, "https://b.test/", long_body, None)], "title string, link string, summary string, date string")
    got = rows(clean.normalise_items(items, AS_OF))[0]
    assert got["title"] == long_title.strip() and got["body"] == long_body
    assert len(got["excerpt"]) <= 500 and long_body.startswith(got["excerpt"])


def test_sentences(spark):
    body = "Waves reached 3.5 metres! “Stay inside.” Did the ferry leave? the FERRY is late. 船は出た。次は明日。"
    df = spark.createDataFrame([("The ferry is late.", body)], "t string, e string")
    got = df.select(text.build_sentences(F.col("t"), F.col("e")).alias("s")).first().s
    assert [(s.id, s.text) for s in got] == [
        ("S1", "The ferry is late."), ("S2", "Waves reached 3.5 metres!"), ("S3", "“Stay inside.”"),
        ("S4", "Did the ferry leave? the FERRY is late.".split("? ")[0] + "?"), ("S5", "船は出た。"), ("S6", "次は明日。"),
    ]


#: One character per class of the sentence rules.
CLASSES = {"a": "Lower", "A": "Upper", "漢": "OLetter", "1": "Numeric", ".": "ATerm", "!": "STerm", ",": "SContinue", ")": "Close", " ": "Sp", "\n": "ParaSep", "\u0301": "Extend", "%": "Other"}


def plain_sentences(text):
    """The rules SB4 to SB998 of the annex, asked at every place between two characters."""
    units = []
    for c in text:
        if CLASSES[c] == "Extend" and units and units[-1][1] != "ParaSep":
            units[-1] = (units[-1][0] + c, units[-1][1])
        else:
            units.append((c, CLASSES[c]))
    kinds = [k for _, k in units]

    def ends(i, classes, paragraph=False):
        """Whether what is before `i` is SATerm Close* Sp*, with a terminator of `classes`."""
        j = i - 1
        if paragraph and j >= 0 and kinds[j] == "ParaSep":
            j -= 1
        while j >= 0 and kinds[j] == "Sp":
            j -= 1
        while j >= 0 and kinds[j] == "Close":
            j -= 1
        return j >= 0 and kinds[j] in classes

    def breaks(i):
        cur, before = kinds[i], kinds[i - 1]
        if before == "ParaSep":
            return True
        if before == "ATerm" and (cur == "Numeric" or (cur == "Upper" and i > 1 and kinds[i - 2] in ("Upper", "Lower"))):
            return False
        rest = next((k for k in kinds[i:] if k in ("OLetter", "Upper", "Lower", "ParaSep", "ATerm", "STerm")), None)
        if ends(i, ["ATerm"]) and rest == "Lower":
            return False
        if ends(i, ["ATerm", "STerm"]) and (cur in ("SContinue", "ATerm", "STerm", "Sp", "ParaSep") or (cur == "Close" and before != "Sp")):
            return False
        return ends(i, ["ATerm", "STerm"], paragraph=True)

    out, start = [], 0
    for i in range(1, len(units) + 1):
        if i == len(units) or breaks(i):
            out.append(" ".join("".join(u for u, _ in units[start:i]).split()))
            start = i
    return [x for x in out if x]


def test_sentence_boundaries_follow_the_rules(spark):
    rng = __import__("random").Random(29)
    texts = ["".join(rng.choice(list(CLASSES)) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice("aA.! ),") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    got = each(spark, text.split_sentences, *texts)
    assert [(t, g) for t, g in zip(texts, got) if g != plain_sentences(t)][:3] == []


def test_long_sentences_stay_whole(spark):
    sentence = "knot " * 300 + "end."
    assert each(spark, text.split_sentences, sentence + " Next one.") == [[sentence, "Next one."]]


def feed(kind, entries):
    if kind == "rss":
        body = "".join(f"<item><title>{t}</title><link>{u}</link><description>{s}</description><pubDate>{d}</pubDate></item>" for t, u, s, d in entries)
        return f'<rss version="2.0"><channel><title>Pier</title>{body}</channel></rss>'
    body = "".join(f'<entry><title>{t}</title><link rel="edit" href="https://e.test/"/><link href="{u}"/><summary>{s}</summary><updated>{d}</updated></entry>' for t, u, s, d in entries)
    return f'<feed xmlns="http://www.w3.org/2005/Atom"><title>Buoys</title>{body}</feed>'


def test_feed_files(spark, tmp_path):
    (tmp_path / "pier.xml").write_text(feed("rss", [
        ("<![CDATA[Crane <em>moved</em>]]>", "https://pier.test/crane?utm_id=1&amp;n=2#x", "<![CDATA[<p>By night.</p>]]>", "Sat, 08 Mar 2031 01:00:00 GMT"),
        ("Dredging &#8211; again", "https://pier.test/dredge", "", "Sat, 01 Feb 2031 01:00:00 GMT"),
        ("Bad", "ftp://pier.test/", "", "Sat, 08 Mar 2031 01:00:00 GMT")]))
    (tmp_path / "buoys.xml").write_text(feed("atom", [("Buoy 7 adrift", "https://buoys.test/7", "Seen at dawn.", "2031-03-09T04:00:00Z")]))
    got = {r["title"]: r for r in rows(clean.normalise_items(feeds.read_feeds(spark, str(tmp_path)), AS_OF))}
    assert {t: r["reject_reason"] for t, r in got.items()} == {
        "Crane moved": None, "Dredging – again": "too_old", "Bad": "bad_url", "Buoy 7 adrift": None}
    assert got["Crane moved"]["url"] == "https://pier.test/crane?n=2" and got["Crane moved"]["body"] == "By night."
    assert got["Buoy 7 adrift"]["url"] == "https://buoys.test/7"


def test_international_hosts(spark):
    labels = ["bücher", "例え", "münchen-ost", "ñandú", "παράδειγμα", "пример", "😀", "a😀b", "é" * 40, "abc", "", "他们为什么不说中文", "üöäüöä", "z" * 30 + "é"]
    want = ["xn--" + x.encode("punycode").decode() if not x.isascii() else x for x in labels]
    assert each(spark, urls.punycode_label, *labels) == want
    rng = __import__("random").Random(4)
    more = ["".join(rng.choice([chr(rng.randint(97, 122)), chr(rng.randint(0xE0, 0x17F)), chr(rng.randint(0x4E00, 0x9FFF)), chr(rng.randint(0x1F300, 0x1F5FF))])
                    for _ in range(rng.randint(1, 20))) for _ in range(300)]
    assert each(spark, urls.punycode_label, *more) == ["xn--" + x.encode("punycode").decode() if not x.isascii() else x for x in more]
    hosts = {"http://BÜCHER.example/a": "http://xn--bcher-kva.example/a", "https://www.bücher。example:443/": "https://www.xn--bcher-kva.example/",
             "http://xn--bcher-kva.example/a": "http://xn--bcher-kva.example/a"}
    assert each(spark, urls.canonical_url, *hosts) == list(hosts.values())


def test_odd_feeds(spark, tmp_path):
    """CDATA that holds tags of items, encoded contents, several links, one broken item among good ones, folders as columns."""
    (tmp_path / "source_id=a").mkdir()
    (tmp_path / "source_id=a" / "1.xml").write_text(
        "<rss><channel><title>Feed</title><item><title><![CDATA[One </item> inside]]></title><link>https://pier.test/1</link>"
        "<content:encoded><![CDATA[<p>Whole</p>]]></content:encoded><dc:date>2031-03-09T04:00:00Z</dc:date><pubDate>x</pubDate></item>"
        "<item><title>Broken</link></item><item rdf:about='x'><title>Two</title><link>https://pier.test/2</link><description>&lt;b&gt; &lt;/b&gt;</description>"
        "<summary>Said.</summary></item></channel></rss>")
    (tmp_path / "source_id=a" / "2.xml").write_text(
        "<feed><entry><title type='html'>Three</title><link rel='self' href='https://pier.test/self'/><link href='https://pier.test/3'/><summary>short</summary>"
        "<content type='html'>Long text</content><updated>2031-03-09T05:00:00Z</updated></entry><entry><title>Four</title><link rel='edit' href='https://pier.test/4'/>"
        "<summary>only</summary></entry></feed>")
    (tmp_path / "source_id=a" / "3.xml").write_text("no feed at all")
    got = {r["title"]: (r["source_id"], r["link"], r["summary"], r["date"]) for r in rows(feeds.read_feeds(spark, str(tmp_path), "source_id string"))}
    assert got == {
        "One </item> inside": ("a", "https://pier.test/1", "<p>Whole</p>", "2031-03-09T04:00:00Z"), "Two": ("a", "https://pier.test/2", "Said.", None),
        "Three": ("a", "https://pier.test/3", "Long text", "2031-03-09T05:00:00Z"), "Four": ("a", "https://pier.test/4", "only", None)}


def test_label_csv(spark, tmp_path):
    file = tmp_path / "labels.csv"
    file.write_bytes('﻿example_id,asset,numbered_sentences\r\nq-7,Kelp,"[S1] ""No,"" said\n[S2] he"\r\n\r\nq-8, ,\r\n'.encode())
    got = rows(labels_csv.read_labels(spark, str(file)), "example_id")
    assert [(r["example_id"], r["asset"], r["numbered_sentences"]) for r in got] == [("q-7", "Kelp", '[S1] "No," said\n[S2] he'), ("q-8", "", "")]
    labels_csv.write_labels(labels_csv.read_labels(spark, str(file)), str(tmp_path / "again"))
    assert rows(labels_csv.read_labels(spark, str(tmp_path / "again")), "example_id") == got
