"""URL rules, main text and archives against plain versions."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import html_text, url_rules, warc
from inkwell.llm.catalog import URL_RULES
from inkwell.llm.words import runs


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_rules_equal_plain_rules(spark):
    rng = random.Random(1)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "b.net", "net", "com", "a.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/x?q=/fr/", "/es/é#f", "/fr/x.com/", "?a=b://c", "#/en/", "/EN/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://", "a.org/x.com/", "http://" + "a" * 5000 + ".com/en/", "http://a.org/x.com/"]
    rng.shuffle(urls)
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(df, URL_RULES).collect()}
    for i, url in enumerate(urls):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_rule(url), url


def test_url_rules_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_rules.judge_urls(df.limit(0), URL_RULES).count() == 0
    row = url_rules.judge_urls(df, []).first()
    assert (row["rule"], row["verdict"]) == (None, "allow")


@pytest.mark.parametrize("count", [1, 40])
def test_globs_equal_regular_expressions(count):
    rng = random.Random(count)
    globs = ["".join(rng.choice(["a", "b", "/", "é", "*", "**", "?"]) for _ in range(rng.randint(0, 7))) for _ in range(count)]
    texts = ["".join(rng.choice("ab/é.") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    automaton = url_rules.GlobAutomaton(globs)
    fits = np.concatenate([automaton.fits(d, o) for _, _, d, o in runs(pa.array(texts))])
    for p, glob in enumerate(globs):
        parts = re.findall(r"\*\*|\*|\?|[^*?]", glob)
        pattern = "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(x, re.escape(x)) for x in parts)
        for t, text in enumerate(texts):
            assert fits[t, p] == bool(re.fullmatch(pattern, text, re.S)), (glob, text)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a>
</nav><div class="sidebar"><p>Side, with many, many, commas, indeed, so many of them here.</p></div><div id=story><h2>Head</h2>
<p>One &amp; two,\n  three&nbsp;four.<p>Short.<div class="ad">Buy, buy, buy</div><form><p>Mail</p></form><script>"</p>"</script></div>
<section id="comments"><p>Nice, nice, very nice article, thanks a lot, really.</p></section><footer>End</footer></body>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head\n\nOne & two, three four.\n\nShort."
    assert html_text.main_text("<body><nav>x</nav><article><h1>A</h1><p>b<br>c</p></article></body>") == "A\n\nb c"
    assert html_text.main_text("plain &lt; text") == "plain < text"
    assert html_text.main_text("<p>only") == "only"
    assert html_text.main_text("<!-- x -->") == html_text.main_text("") == html_text.main_text(None) == ""
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"
    assert html_text.main_text('<p title="a>b">x</p><p title="open>y</p>')


def test_extract_text_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y")], "page_id long, html string, text string")
    rows = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert rows[1]["n_chars"] == len(rows[1]["text"]) and (rows[2]["text"], rows[2]["n_chars"]) == ("", 0)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (5, None, "x"), (3, "u\r\nv", "é\r\n\r\n" * 9), (4, "d", None), (None, "n", "x"), (6, "e", "")]
    rows += [(7, "same", "twice"), (7, "same", "twice"), (8, "big", "b" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    plain = sorted((r[0], len((r[2] or "").encode()), base64.b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode())
                   for r in rows if r[0])
    assert plain == sorted((r["record_id"], r["payload_bytes"], r["payload_digest"]) for r in got if r["record_id"])
    kinds = {(r["record_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(1, "revisit", 5), (5, "response", None), (None, "revisit", 5), (4, "revisit", 6), (6, "response", None)} <= kinds
    assert {(7, "response", None), (7, "revisit", 7), (3, "response", None)} <= kinds


def test_warc_selection_and_bound(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * (i % 3)) for i in range(30)], "page_id long, url string, html string")
    index = warc.write_archives(df, warc.as_uri(str(tmp_path / "w")), min_bytes=2, max_file_bytes=400)
    some = warc.read_records(index.where("record_id % 7 = 0"), warc.as_uri(str(tmp_path / "w"))).collect()
    assert {r["record_id"] for r in some} == {0, 7, 14, 21, 28}
    assert {r["record_type"] for r in some if r["payload_bytes"] < 2} == {"response"}
    assert warc.write_archives(df.limit(0), warc.as_uri(str(tmp_path / "e"))).count() == 0


LONG = "This paragraph has enough words, and commas, to be read as the text of an article, as it goes on for a while. " * 3


def test_link_lists_class_parts_and_formulas_of_an_article_stay():
    page = f"""<body><nav><a href=x>Home</a></nav><article><p>{LONG}</p>
      <ul><li><a href=1>First source</a><li><a href=2>Second source</a><li><a href=3>Third source</a></ul>
      <div class="share-price"><p>{LONG.upper()}</p></div><p>Let <math><mi>x</mi></math> be one.</p>
      <div class="share-buttons"><a href=4>Post</a></div><div class="share"><p>{LONG.lower()}</p></div>
      <div class="user-comments"><p>{LONG.title()}</p></div></article></body>"""
    text = html_text.main_text(page)
    for kept in ("First source", "Third source", LONG.strip(), LONG.upper().strip(), "Let x be one."):
        assert kept in text
    for gone in ("Home", "Post", LONG.lower().strip(), LONG.title().strip()):
        assert gone not in text


MALFORMED = [
    "<a x", '<a "x>', '<a "', "<a 'x\">", "<!x", "<b>", "<span><p>", "<div></span>", "</p>", "<li>", "<p><div>" + "<b>" * 20, "<table><tr><td>",
    "<script", "<![CDATA[", "<!--", "<td><p><li><dd>", "<p>" + "</b>" * 9, "&amp", "<", "<a href='", "<p title=\"'>",
]


@pytest.mark.parametrize("pattern", MALFORMED)
def test_a_megabyte_of_malformed_markup_takes_time_that_follows_its_length(pattern):
    def seconds(size):
        page = pattern * (size // len(pattern))
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    assert seconds(1_000_000) < max(4.0, 8 * seconds(250_000))


def test_tags_end_at_the_first_bracket_outside_quotes():
    def listed(html):
        return [(name, rest) for _, _, _, name, rest in html_text.tokens(html)]

    assert listed("""<a t="1>2" u='">'>x<b>""") == [("a", """ t="1>2" u='">'"""), ("b", "")]
    assert listed("""<a t="1>2<b>""") == [("a", ' t="1'), ("b", "")]
    assert listed("<!-- <a> --><?x?><!DOCTYPE html><p>1 < 2</p><br/>") == [(None, "")] * 3 + [("p", ""), ("p", ""), ("br", "/")]
    assert listed("<p") == [] and listed("a > b <") == [] and listed("<!--") == [(None, "")]


def test_repeated_pages_nulls_and_clashing_columns(spark):
    rows = [(1, f"<article><p>{LONG}</p></article>", "old", 5), (1, f"<article><p>{LONG}</p></article>", "old", 5), (2, None, "x", 1)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, LONG.strip(), len(LONG.strip()))] * 2 + [(2, "", 0)]
