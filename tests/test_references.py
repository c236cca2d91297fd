"""HTML to text decodes every character reference, checked against Python's own table."""

import html
from html.entities import html5

import pyarrow.parquet as pq

import __spark_entry__ as entry
from conftest import SMALL
from mailsignal.functions import text as T


def decoded(spark, texts, f=T.html_to_text):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r.x for r in df.select("id", f("t").alias("x")).orderBy("id").collect()]


def test_every_name(spark):
    names = sorted({n.rstrip(";") for n in html5})
    assert decoded(spark, ["|".join(f"&{n};" for n in names)]) == ["|".join(html5[n + ";"] for n in names)]


def test_numeric_and_edges(spark):
    cases = {"&#169;&#xA9;&#XA9;&#0169; &#x1F600;": "©©©© 😀", "&#150;&#x80;&#x81;": "–€\x81", "&#xD7FF;&#xE000;": "\ud7ff\ue000",
             "&#0;|&#xD800;|&#x110000;|&#99999999999999999999;|&#xffffffffffffffffffff;": "\ufffd|\ufffd|\ufffd|\ufffd|\ufffd",
             "&amp;copy; &amp;amp;lt; &amp;#65;": "&copy; &amp;lt; &#65;", "&copy 2020 &middot": "© 2020 ·",
             "&nosuch; &section=2 & &; &# &#x; AT&T": "&nosuch; &section=2 & &; &# &#x; AT&T", "&lt;b&gt;": "<b>", "": "", None: None}
    assert decoded(spark, cases) == list(cases.values())


def test_sql_reads_references_alike(spark):
    """The oracle's SQL on the same cases, and on names and numbers that end without a semicolon."""
    import duckdb

    from mailsignal.plans.oracle_views import html_text
    cases = ["|".join(f"&{n}" for n in html5), "&#169;&#xA9;&#XA9;&#0169; &#x1F600;&#150;&#x80;&#x81;&#xD7FF;&#xE000;",
             "&#0;|&#xD800;|&#x110000;|&#99999999999999999999;|&#xffffffffffffffffffff;", "&amp;copy; &amp;amp;lt; &amp;#65;", "?a=1&lang=en&copy=2&sect=3&section=4",
             "&nosuch; & &; &# &#x; AT&T &#65a &#65abz; &#12g &notit; &ampamp", "a&lt;b&gt;c<p>d&amp", "&&amp;&", "", None]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {html_text('$1::VARCHAR')}", [t]).fetchone()[0] for t in cases]
    assert decoded(spark, cases) == want


def test_names_without_semicolon(spark):
    """As the reference's parser reads them: any known name counts, and only a whole one (html.unescape knows fewer without
    a semicolon, and cuts longer words)."""
    cases = {"?q=1&lang=en": "?q=1\u27e8=en", "&copy=2 &notit; &ampx": "©=2 &notit; &ampx", "&#65a &#65 a": "&#65a A a"}
    assert decoded(spark, cases) == list(cases.values())
    assert html.unescape("?q=1&lang=en") == "?q=1&lang=en"


def test_no_stray_words_in_clean_text(spark):
    assert decoded(spark, ["A&copy;B &middot; C&Eacute;D &#8211; &hellip;"], T.clean_text) == ["a b c d"]


def test_pages_are_fully_decoded(spark):
    """All pages of the small set; their markup has no nested comments or scripts, so tags are cut by the same patterns."""
    import re
    want = {}
    for r in pq.read_table(f"{SMALL}/pages.parquet", columns=["page_id", "html"]).to_pylist():
        t = re.sub(T.HTML_SCRIPT_STYLE, "", re.sub(T.HTML_COMMENT, "", r["html"]))
        want[r["page_id"]] = html.unescape(re.sub(T.HTML_TAG, "", t))
    assert {r.page_id: r.text for r in entry.queries()["html_to_text"](spark, SMALL).collect()} == want
