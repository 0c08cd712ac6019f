"""Page differencing against a plain version, and on pages without telling containers, copies, broken markup, nulls, repeated rows, long pages, empty tables, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, pages

from . import brute

SCHEMA = "page_id long, url string, html string"


def rows(df):
    return sorted(((r["page_id"], r["text"], r["n_lines"], r["n_shared"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def site(spark):
    """Pages of hosts with their own boilerplate and no telling container, beside pages with articles; one host has most of them."""
    rng = random.Random(3)
    out = []
    for i in range(260):
        host = rng.choice(["one.example", "one.example", "One.Example", "two.example", "three.example"])
        body = [f"Paragraph {i} {k} with its own words" for k in range(rng.randrange(1, 6))]
        if host == "two.example":
            html = f"<html><head><title>t</title></head><body><div>Welcome to two</div><div>Home News About</div><article><h1>Title {i}</h1>" + "".join(f"<p>{x}<br>and more</p>" for x in body) + "</article><div class='comments'><p>nice</p></div><div>All rights reserved</div></body></html>"
        else:
            html = f"<body><div>Welcome to {host.lower()}</div><ul><li>Home<li>News</ul>" + "".join(f"<p>{x}" for x in body) + "<div class=cookie-notice>We use cookies</div><div>All rights reserved</div><script>if (a < b) { document.write('<p>no</p>') }</script>"
        out.append((i, f"https://{host}/{rng.choice(['a', 'b'])}/{rng.randrange(40)}/x{rng.randrange(9)}?q={i}", html))
    out += [(900, None, "<p>no url</p>"), (901, "no scheme", "<p>one</p><p>two</p>"), (902, "http://four.example/", None), (903, "http://four.example/a", ""), (904, "http://five.example/x", "<p>a  b\n c</p>plain &amp; simple &lt;tag&gt; &#8364;"), (None, "http://five.example/y", "<p>null id</p>")]
    out += [out[5], out[5]]
    return out


@pytest.mark.parametrize("ranges", [None, 1, 37])
def test_pages_equal_a_plain_version(spark, site, ranges):
    df = spark.createDataFrame(site, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in ("host", "path", "place", "part", "context", "text", "lines")]).repartition(5)
    got = rows(pages.extract_text(df, ranges=ranges))
    assert got == sorted(brute.main_texts(site), key=repr)
    assert sum(n for *_, n in got) > 500  # the differencing has found the hosts' own lines
    texts = {i: t for i, t, *_ in got}
    # but for page 5, which stands between copies of itself
    assert all("All rights" not in t and "Home" not in t for i, t in texts.items() if i is not None and i < 260 and i != 5 and t.count("\n") > 3)


def test_given_pages_equal_a_plain_version(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/pages.parquet")
    assert rows(pages.extract_text(df)) == sorted(brute.main_texts([tuple(r) for r in df.select("page_id", "url", "html").collect()]), key=repr)


@pytest.mark.parametrize("html, text", [
    ("<article><p>a<b>b</b>c</p>d</article>e", "abc\nd"),
    ("<main>x<aside>no</aside>y<nav>no</nav></main>", "x\ny"),
    ("<div class='content with-sidebar'><p>yes</p></div><div id=sidebar><p>no</p></div>", "yes"),
    ("<body class='has-sidebar'><header>no</header><article><header><h1>T</h1></header><p>a&nbsp;b&amp;amp;</p><div class='share-bar'>no</div><footer>no</footer></article>", "T\na b&amp;"),
    ("<p>a<!-- <p>no</p> -->b<p>c<script>\"<p>\" + '<a href=\"'</script>d<p", "ab\nc d"),
    ("<article>a<div class=comment-list><article>no</article></div></article>", "a"),
    ("<table><tr><td>1<td>2<tr><td>3</table><pre>x\n  y</pre>", "1\n2\n3\nx y"),
    ("<p hidden>no</p><div hidden>no</div><div role=navigation>no</div><dialog>no</dialog><form>no</form>yes<select><option>no</select><button>no</button>", "yes"),
    ("<section><p>1</p></div></section></p>2 < 3 &lt; 4<![CDATA[no]]><?no?>", "1\n2 < 3 < 4"),
    ("<script>never closed <p>no</p>", ""), ("<noscript>open <p>yes", "open\nyes"), ("<<<>>>", "<<<>>>"), ("<p class=\"x>y", "y"), (" \n ", ""),
])
def test_blocks_and_containers(html, text):
    lines, zones = pages.page_lines(html)
    page = pages._Page((), "", "", False, lines, zones)
    assert "\n".join(lines[i] for i in pages.main_lines(page, set())) == text


def test_long_and_adversarial_pages():
    for html in ("<div>" * 50_000 + "x" + "</div>" * 50_000, "</p>" * 100_000, "<a \"" * 50_000, "<p>" * 100_000 + "end", "<button>" * 30_000, "<p>line</p>" * 50_000, "x" * 2_000_000):
        pages.page_lines(html)


def test_alignment_is_longest(monkeypatch):
    rng = random.Random(1)
    for most in (1 << 27, 8):
        monkeypatch.setattr(alignment, "_MOST_BITS", most)
        for _ in range(400):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
            got = alignment.common_lines(a, b)
            rest = iter(b)
            assert got == sorted(set(got)) and all(a[i] in rest for i in got) and len(got) == len(brute._common(a, b))


def test_empty_table(spark):
    assert pages.extract_text(spark.createDataFrame([], SCHEMA)).collect() == []
