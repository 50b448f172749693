"""The deduced template chooses the main text; brute force over occurrence vectors; article text
whose class names look like boilerplate stays."""

import collections
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("livepricing.llm")
from livepricing.llm import html_text  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("inner, want", [
    ("<div class='follow-up'>a</div><p>b", "a b"), ("<section class='legal-analysis'>a</section>b", "a b"),
    ("<div class='search-algorithms'>a</div>", "a"), ("<section id='notice-of-motion'>a</section>", "a"), ("<h2 id='promotion'>a</h2>b", "a b"),
    ("<section id=discussion-of-results>a</section>", "a"), ("<p id=footer>a<p>b", "a b"),
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"), ("<noscript><p>a</p></noscript>b", "a b"), ("<object>a</object> b", "a b"),
    ("<div class='comment-list'>no</div>a", "a"), ("<div class='ad-slot-3'>no</div>a", "a"), ("<div id=comments>no</div>a", "a"),
    ("<section id=comments>no</section>a", "a"), ("<div class='share-buttons'>no</div>a", "a")])
def test_names_inside_an_article(inner, want):
    assert html_text.main_text(f"<noscript>no</noscript><article>{inner}</article>", set()) == want


def neutral(page):
    """The page with div for every element that says what it holds, and names that say nothing."""
    for n, old in enumerate(('<div class="ad"', "<nav", "<article", "<footer", "<aside")):
        page = F.replace(page, F.lit(old), F.lit(f'<div class="c{n}"'))
    return F.regexp_replace(page, r"</(nav|article|footer|aside)>", "</div>")


def test_template_decides_on_given_pages(spark):
    """Without element names and classes the host's template still finds the articles."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    named = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    alone = {r.page_id: html_text.main_text(r.html, set()) for r in pages.collect()}
    assert named == alone
    bare = pages.withColumn("html", neutral("html"))
    per_host = collections.Counter(r.h for r in pages.select(html_text.host(F.col("url")).alias("h")).collect())
    got, of = 0, 0
    without = {r.page_id: html_text.main_text(r.html, set()) for r in bare.collect()}
    for r in html_text.extract(bare).withColumn("h", html_text.host(F.col("url"))).collect():
        if per_host[r.h] >= 10:
            of += 1
            got += r.text == named[r.page_id]
            assert without[r.page_id] != named[r.page_id]
    assert of >= 10 and got >= 0.95 * of


def page(i, body="long words of the story, more than anything else here", ad="buy"):
    return (f"<body><div><a href=x>home {i}</a><a href=y>about {i}</a></div><div>{ad} {i}</div><div><div><h1>Title {i}</h1></div>"
            f"<div><p>{body} {i}</p><p>{i} and on</p></div></div><div>foot {i}</div></body>")


@pytest.fixture(scope="module")
def hosts():
    """Hosts of two page kinds, of two pages only, of copies; nulls."""
    rows = [(i, f"http://a.example/{i}", re.sub("<div>", lambda m, n=iter("tnabcde"): f"<div id={next(n)}>", page(i))) for i in range(6)]
    rows += [(20 + i, f"http://a.example/k{i}", f"<body><div id=q><ul><li>x {i}</ul></div><div id=r><p>{'other kind ' * 9}{i}</p></div></body>") for i in range(4)]
    rows += [(40 + i, f"http://b.example/{i}", page(i)) for i in range(2)]
    rows += [(50 + i, "http://c.example/", page(1)) for i in range(5)]
    return rows + [(60, None, None), (61, "nonsense", ""), (None, "http://a.example/z", rows[0][2])]


def test_classes_by_brute_force(spark, hosts):
    d = spark.createDataFrame(hosts, "page_id long, url string, html string")
    got = {(r.host, r.pages, r["size"], frozenset(t.role for t in r.tokens)) for r in html_text.classes(d, 0.1, 3, 3).collect()}
    by_host = collections.defaultdict(set)
    for _, url, html in hosts:
        by_host[(re.findall("//([^/]*)", url or "") or [""])[0]].add(html)
    want = set()
    for h, texts in by_host.items():
        vectors, keep = collections.defaultdict(dict), set()
        for n, t in enumerate(sorted(texts, key=str)):
            blocks, boxes, tags = html_text.parse(t)
            for role, (count, run) in html_text.roles(blocks, tags).items():
                vectors[role][n] = count
                keep |= {role} if run else set()
            for role, x in html_text.slots(blocks, boxes).items():
                vectors[role][n] = x[0]
                keep.add(role)
        groups = collections.defaultdict(set)
        for role, v in vectors.items():
            if len(v) >= max(3, 0.1 * len(texts)):
                groups[tuple(sorted(v.items()))].add(role)
        want |= {(h, len(v), len(g), frozenset(g & keep)) for v, g in groups.items()}
    assert got == want and any(h == "a.example" for h, *_ in got)


def test_slots_of_a_host(spark, hosts):
    d = spark.createDataFrame(hosts, "page_id long, url string, html string").withColumn("main", F.lit(1))
    got = {(r.page_id, r.url): r.text for r in html_text.extract(d).collect()}
    # the heading stays with the text: the descent ends at the container that holds both
    story = "Title {0} long words of the story, more than anything else here {0} {0} and on"
    assert [got[i, f"http://a.example/{i}"] for i in range(6)] == [story.format(i) for i in range(6)]
    assert got[None, "http://a.example/z"] == story.format(0) and got[60, None] == got[61, "nonsense"] == ""
    # two pages teach no template
    assert got[40, "http://b.example/0"].startswith("home 0")
    assert html_text.extract(d.limit(0)).count() == 0
