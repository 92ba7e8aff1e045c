"""HTML, quality, URL filter, toxicity and the registered queries with SQL."""

from __future__ import annotations

import datetime
import math
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenmill.llm import html_text, quality, toxicity, url_filter
from screenmill.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div>Hi &amp; <i>you</i><p>a<p>b<aside>x</aside><form>q</form></div><div class='cookie-banner'>c</div> tail", "Hi & you\na\nb\ntail"),
        ("<body><nav>n</nav><article><header><h1>T</h1></header><p><b>one<br><p>two &lt;3<script>var x='</p>'</script></article><footer>f</footer>", "T\none\ntwo <3"),
        ("<main><p>a\n  b</p><div class='comments'><p>no</p></div><ul><li>x<li>y</ul></main>", "a b\nx\ny"),
        ("<p>cut <b>off", "cut off"),
        ("no markup", "no markup"),
        ("<!-- c --><style>p{}", ""),
        ("", ""),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_style_tree_finds_boilerplate(spark):
    rows = [(k, f"https://h.example/{k}", f"<body><div><p>Shared slogan of the site</p></div><section><p>Own text number {k} {'x' * k}</p></section></body>") for k in range(8)]
    rows += [(9, "https://other.example/", "<div><p>Shared slogan of the site</p></div>"), (10, None, None)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text number 3 xxx"
    assert (got[9], got[10]) == ("Shared slogan of the site", "")


def test_quality_edges_and_order(spark):
    texts = [None, "", "one two", "a b c d e f a b c d e g h i j k l m n o p q r s t", "x " * 100, "###### " * 20 + "fine words here", "l\nl\nl\n\n \nm", "w" * 100_000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert (got[0].n_words, got[1].kept, got[2].n_words) == (0, False, 1)
    assert got[3].n_repeat_words == 10 and got[4].n_repeat_words == 100 and got[6].n_dup_lines == 2
    orders = [list(quality.BASE + quality.RULES), list(reversed(quality.BASE + quality.RULES))]
    kept = [sorted(r.doc_id for r in quality.filter_quality(docs, o).collect()) for o in orders]
    assert kept[0] == kept[1] == sorted(k for k, r in got.items() if r.kept)
    assert quality.quality(docs.limit(0)).count() == 0
    named = docs.withColumnsRenamed({"words": "__words"}).select("*", F.lit(1).alias("a.b"), F.lit(2).alias("row"), F.lit(3).alias("t`k"))
    left = quality.filter_quality(named, orders[0])
    assert left.columns == named.columns and {(r["__words"], r["a.b"], r["row"], r["t`k"]) for r in left.collect()} <= {("clash", 1, 2, 3)}
    assert sorted(r.doc_id for r in left.collect()) == kept[0]


def test_cascade_spares_what_a_rejected_document_does_not_need(spark, monkeypatch):
    """A measure that fails when it is computed: rows that an earlier rule rejects never get there, in the query's own cascade too."""
    monkeypatch.setitem(quality.MEASURES, "costly", lambda text, words: F.raise_error(F.lit("computed")).cast("long"))
    costly = quality.Rule("costly", ("costly",), lambda m: m["costly"] > 0)
    docs = spark.createDataFrame([(1, " ".join(f"##w{c}" for c in "abcdefghijklmnopq"))], "doc_id long, text string")
    assert quality.quality(docs, [quality.RULES[0], costly]).first().kept is False
    assert quality.filter_quality(docs, [quality.RULES[0], costly]).count() == 0
    with pytest.raises(Exception, match="computed"):
        quality.quality(docs, [costly, quality.RULES[0]]).collect()


def test_rules_are_ranked_by_what_is_left(spark):
    """Of two rules that reject the same rows the second has nothing left to reject."""
    twin = quality.Rule("twin", ("n_words", "n_symbols"), quality.RULES[0].rejects)
    rows = spark.createDataFrame([(k, ("## " if k % 2 else "") + "some plain words that go on " * 3) for k in range(200)], "doc_id long, text string")
    ranked = quality.ranked_rules(rows, (quality.RULES[0], twin, quality.RULES[4]), 1000)
    gains = {r.name: share for r, share, _ in ranked}
    assert sorted((gains["symbols"], gains["twin"])) == [0.0, 0.5] and ranked[0][1] == 0.5


def test_quality_of_lines_and_digits(spark):
    texts = ["1234567890 " * 12, "- an item of a list here\n" * 1 + "".join(f"* item {c} of it\n" for c in "abcdefghij"), "".join(f"line {c} that is cut off...\n" for c in "abcdef"), "".join(f"line {c} that is whole\n" for c in "abcdef")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in quality.filter_quality(docs).collect()) == [3]


def test_url_intervals(spark):
    day = datetime.date
    log = [("bad.example", "spam", day(2020, 1, 1), "add"), ("bad.example", "spam", day(2020, 1, 1), "add"), ("bad.example", "spam", day(2020, 2, 1), "remove"), ("bad.example", "spam", day(2020, 3, 1), "add"), ("ok.example/ads", "ads", day(2020, 1, 1), "add"), (None, "x", day(2020, 1, 1), "add")]
    changes = spark.createDataFrame(log, "entry string, category string, day date, action string")
    asked = [("http://www.BAD.example/x", day(2020, 1, 15), "spam"), ("http://www.bad.example/x", day(2020, 2, 1), None), ("http://bad.example", day(2020, 5, 1), "spam"), ("http://ok.example/ads/1?q", day(2020, 5, 1), "ads"), ("http://ok.example/adsx", day(2020, 5, 1), None), ("http://notbad.example/", day(2020, 5, 1), None), (None, day(2020, 5, 1), None), ("junk", day(2020, 5, 1), None), ("http://bad.example", None, None)]
    captures = spark.createDataFrame([(k, u, d) for k, (u, d, _) in enumerate(asked)], "page_id long, url string, fetched_on date")
    got = {r.page_id: r.category for r in url_filter.filter_urls(captures, changes).collect()}
    assert got == {k: c for k, (_, _, c) in enumerate(asked)}
    assert url_filter.filter_urls(captures, changes.limit(0)).filter("blocked").count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    # in this table about half of the toxic documents hold no expression that others share
    assert (rows[rows.toxic == 1].predicted == 1).mean() > 0.5
    assert (rows[rows.toxic == 0].predicted == 1).mean() < 0.02
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "you idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0] * 4
    some = spark.createDataFrame([(4, 1), (2, 0), (1, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, some).filter(F.col("score").between(0, 1)).count() == 4


def test_results_as_tables(spark):
    assert isinstance(QUERIES["op1_token_counts"](spark, SF).limit(1).toPandas(), pd.DataFrame)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body class='single has-sidebar'><p>a</p></body>", "a"),
        ("<div class='no-comments'><p>a</p></div>", "a"),
        ("<article class='tag-cookies'><p>a</p></article>", "a"),
        ("<article><header class='entry-header'><h1>T</h1></header><div class='post-header'><p>s</p></div><p>a</p></article>", "T\ns\na"),
        ("<div class='page-header'>h</div><div class='widget-1'>w</div><p>a</p>", "a"),
        ("<p>a <svg width='1' /> b</p><p>c</p>", "a b\nc"),
        ("<p>a <math/> b</p><p>c <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>", "a b\nc x=1"),
    ],
)
def test_main_text_keeps_what_is_no_chrome(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one <iframe src='x'/> two</p><p>three</p>", "one two\nthree"),
        ("<p>one <script src='x'/> two</p><script>no()</script><p>three</p>", "one two\nthree"),
        ("<p>one</p><iframe>inner <p>no</p></iframe><p>two</p>", "one\ntwo"),
        ("<form id='aspnetForm'><div class='nav'>n</div><div id='main'><p>a</p></div></form><p>tail</p>", "a\ntail"),
        ("<form id='aspnetForm'><div><p>a</p><form>q</form></div></form>", "a\nq"),
        ("<article><p>a</p><form><div class='content'>q</div></form></article>", "a"),
        ("<html class='no-cookies'><body class='post no-sidebar'><article><p>a</p></article></body></html>", "a"),
        ("<div class='post'><div class='post-header'><h1>T</h1></div><p>a</p><div class='post-footer'>f</div></div>", "T\na"),
        ("<p>" + "long " * 50000 + "</p>", ("long " * 50000).strip()),
    ],
)
def test_main_text_of_odd_markup(page, want):
    assert html_text.main_text(page) == want


def test_style_tree_equals_one_over_lists(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(90_000 + k, f"https://h.example/{k % 11}", f"<div class='top'>Same slogan</div><section><p>Words {k % 11}</p><p>Terms apply</p></section>") for k in range(20)], "page_id long, url string, html string"))
    rows = pages.select("page_id", "html", html_text.host_of(F.coalesce("url", F.lit(""))).alias("host")).collect()
    # by host and node: the set of (feature, page) pairs
    nodes: dict = {}
    linked: dict = {}
    for r in rows:
        found = list(html_text.blocks(r.html or ""))
        page = "\n".join(b.text for b in found if b.under < html_text.CHROME_ABOVE)
        below: dict = {}
        for path, _, _, link, text in found:
            nodes.setdefault((r.host, path, True), set()).add((text, page))
            linked.setdefault((r.host, path, text), set()).add((page, link))
            while path:
                below.setdefault(path.rpartition(">")[0], []).append(path)
                path = path.rpartition(">")[0]
        for path, children in below.items():
            if path:
                nodes.setdefault((r.host, path, False), set()).add(("|".join(children), page))
    table = []
    for (host, path, content), pairs in nodes.items():
        times = Counter(f for f, _ in pairs)
        table.append((host, path, content, len({p for _, p in pairs}), sum(math.log(c) for c in times.values()) / len(times), sum(c * math.log(c) for c in times.values()), 0.0 if not content else sum(sum(x for _, x in linked[host, path, f]) / len(linked[host, path, f]) for f in times) / len(times)))
    want = {}
    for host in {t[0] for t in table}:
        own = pd.DataFrame([t[1:] for t in table if t[0] == host], columns=["path", "content", "m", "mean_log", "sum_log", "links"])
        low = {p for p, x in html_text.importance(own).items() if x < 0.2}
        links = {p for p, x in html_text.importance(own, True).items() if x < 0.2} - low
        if low or links:
            want[host] = (sorted(low), sorted(links))
    got = {r.host: (list(r.low), list(r.links)) for r in html_text.low_importance(spark.createDataFrame(rows).select("host", F.coalesce("html", F.lit("")).alias("html"))).collect()}
    assert got == want and "h.example" in got


SITE = """<html><body><div class=a1><ul>{menu}</ul></div><div class=b2><p>Welcome to our site</p></div>
<div class=c3><h2>Introduction</h2><p>{text}</p><p>More about {text}</p></div>
<div class=d4><p><a href=/n>{next}</a></p></div><div class="comment-list"><p>Reader says {text}</p></div></body></html>"""


@pytest.mark.parametrize("n", [2, 3, 20])
def test_style_tree_without_article(spark, n):
    """Menus and teasers that vary, a slogan, a heading that all pages share, comments; alike on hosts of any size."""
    page = lambda k: SITE.format(menu="".join(f"<li><a href=/{k}/{j}>Link {k} {j}</a></li>" for j in range(3)), text=f"words of page {k} alone " * 3, next=f"Teaser {k}")
    pages = spark.createDataFrame([(k, f"https://site.example/{k}", page(k)) for k in range(n)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == {k: f"Introduction\n{text}\nMore about {text}" for k in range(n) for text in [("words of page %d alone " % k * 3).strip()]}
    removed = sum(len(list(html_text.blocks(page(k)))) - 1 - len(got[k].split("\n")) for k in range(n))  # but for the comment
    assert removed == 5 * n  # three links, slogan, teaser: by the tree alone


def test_style_tree_keeps_near_copies_and_indexes(spark):
    rows = [(k, f"https://two.example/{k}", f"<article><p>One long text that both pages have in common</p><p>By {k}</p></article>") for k in range(2)]
    rows.append((2, "https://index.example/", "<ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>"))
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "One long text that both pages have in common\nBy 0", 1: "One long text that both pages have in common\nBy 1", 2: "One\nTwo"}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<a href=/x title=it's>one</a><p>two</p><p>three it's</p><p>four</p>", "one\ntwo\nthree it's\nfour"),
        ("<p title = 'a>b' class=x>one</p><p data-x='class=\"ad\"'>two</p><div title='class=ad'>three</div><p id=\"open>four</p>", "one\ntwo\nthree\nfour"),
        ("<p class='anti-social'>keep</p><div class='anti-social'>this</div><h2 class='menu'>too</h2>", "keep\nthis\ntoo"),
        ("<article class='teaser'><p>short</p></article><div class='content'><p>The real text of it</p></div>", "The real text of it"),
        ("<article><p>short</p></article><div class='content'><p>The real text of it</p></div>", "The real text of it"),
        ("<article class='teaser'><p>only</p></article>", "only"),
        ("<main><article><p>text</p></article><article class='teaser'><p>other</p></article></main>", "text"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
        ("<div class='comment-list'>c</div><div class='comments-area'>c</div><div class='widget-area'>c</div><ul class='related-posts'><li>c</ul><div class='cookie-bar'>c</div><div class='share-buttons'>c</div><div class='ad-slot'>c</div><p>text</p>", "text"),
    ],
)
def test_main_text_of_attributes_and_regions(page, want):
    assert html_text.main_text(page) == want


def test_html_extra_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "http://h.example", "<p>a</p>", "clash", 5)], "page_id long, url string, html string, text string, host int")
    assert [tuple(r) for r in html_text.extract_text(rows).collect()] == [(1, "http://h.example", "a", 1)]
    assert html_text.extract_text(rows.limit(0)).count() == 0


def test_url_entries_of_any_depth_and_case(spark):
    day = datetime.date(2020, 1, 1)
    changes = spark.createDataFrame([(e, e, day, "add") for e in ("Wiki.example/Wiki/Page", "deep.example/1/2/3/4/5/6")], "entry string, category string, day date, action string")
    asked = [("http://WIKI.example/Wiki/Page/x", True), ("http://wiki.example/wiki/page", False), ("http://deep.example/1/2/3/4/5/6/7/8", True), ("http://deep.example/1/2/3/4/5", False), ("http://deep.example", False)]
    captures = spark.createDataFrame([(k, u, day) for k, (u, _) in enumerate(asked)], "page_id long, url string, fetched_on date")
    got = {r.page_id: r.blocked for r in url_filter.filter_urls(captures, changes).collect()}
    assert got == {k: b for k, (_, b) in enumerate(asked)}


def test_url_entries_are_normalised_or_rejected(spark):
    day = datetime.date(2020, 1, 1)
    entries = ["slash.example/a/", "https://scheme.example/", "port.example:8080/b", "*.wild.example", " blank.example ", ".dot.example", "all.example/*", "q.example/a?b", "https://", "", None]
    changes = spark.createDataFrame([(e, "c", day, "add") for e in entries] + [("late.example", "c", None, "add")], "entry string, category string, day date, action string")
    asked = [("http://slash.example/a", True), ("http://slash.example/a/b", True), ("http://slash.example/", False), ("http://scheme.example/x", True), ("http://port.example/b", True), ("http://x.wild.example", True), (" http://blank.example/", True), ("http://dot.example/", True), ("http://q.example/a?b", False), ("http://late.example", False)]
    captures = spark.createDataFrame([(k, u, day) for k, (u, _) in enumerate(asked)] + [(90, "http://dot.example/", day)] * 2, "page_id long, url string, fetched_on date")
    got = [(r.page_id, r.blocked) for r in url_filter.filter_urls(captures, changes).collect()]
    assert sorted(got) == [(k, b) for k, (_, b) in enumerate(asked)] + [(90, True)] * 2
    reasons = {r.entry: r.reject_reason for r in url_filter.rejected_entries(changes).collect()}
    assert {k: v[:5] for k, v in reasons.items()} == {"q.example/a?b": "a que", "https://": "no ho", "": "no en", None: "no en", "late.example": "no da"}
    assert url_filter.filter_urls(captures.limit(0), changes).count() == 0


def test_url_hosts_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST_SPLIT", 3)
    monkeypatch.setattr(url_filter, "HOT_KEYS", 4)
    day = datetime.date(2020, 1, 1)
    changes = spark.createDataFrame([(e, "c", day, "add") for e in ("hot.example.", "[2001:DB8::1]", "3.4", "1.2.3.4")], "entry string, category string, day date, action string")
    asked = [(f"http://www.hot.example/{k}", True) for k in range(40)] + [("http://hot.example./x", True), ("http://[2001:db8::1]:80/x", True), ("http://[2001:db8::2]/", False), ("http://9.9.3.4/", False), ("http://1.2.3.4/", True)]
    captures = spark.createDataFrame([(k, u, day, "clash", k) for k, (u, _) in enumerate(asked)], "page_id long, url string, fetched_on date, category string, n int")
    got = {r.page_id: (r.blocked, r.n_entries) for r in url_filter.filter_urls(captures, changes).collect()}
    assert got == {k: (b, int(b)) for k, (_, b) in enumerate(asked)}


def test_toxicity_counts_all_labelled_rows(spark):
    # forty insults of ten rows each: a sample of a few rows sees few of them
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{'the report says that people met ' * 3} {letters[k // 10 % 26] * 3}{letters[k // 260] * 5} today" if k < 400 else "the report says that people met " * 3 + "today" for k in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 400)) for k in range(800)], "doc_id long, toxic int")
    sample = toxicity.known_labels(labels)
    counts = toxicity.word_counts(docs.join(sample, "doc_id").select("text", "toxic", "fold"))
    assert counts.count() == 7 + 40
    rows = toxicity.toxicity(docs, labels, sample_toxic=20, sample_ordinary=20).filter("held_out").toPandas()
    assert (rows[rows.doc_id < 400].predicted == 1).mean() > 0.9
    assert (rows[rows.doc_id >= 400].predicted == 1).mean() < 0.1
