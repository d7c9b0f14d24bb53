"""Main-text extraction."""

import math
import random
from collections import defaultdict

import pytest

from tidelog.llm import html_text, queries


def main(page):
    return "\n".join(html_text.choose(html_text.blocks(page)))


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<nav>menu</nav><article><h1>T &amp; &#233;</h1><p>a <b>b</b>c<br>d<p>e</article><footer>f</footer>", "T & é\na bc d\ne"),
        ("<body><div class='cookie-banner'>yes</div><article><p>x<div class=ad>buy</div><aside>more</aside><form>q</form></article></body>", "x"),
        ("<article>one<section id='comments'><p>me too</section></article><article class='comment'>hi</article>", "one"),
        ("<script>var t='</p><p>no</p>'</script><style>p{}</style><!-- <p>no --><p>yes", "yes"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("<header><h1>Site</h1></header><article><header><h1>Own</h1></header><p>x</article>", "Own\nx"),
        ("<ul><li>a<li>b</ul><p hidden>no</p><p style='display: none'>no</p>", "a\nb"),
        ("<p><a href=x>all of it is a link</a></p><p>text with <a href=x>one</a> in it</p>", "text with one in it"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_pages(page, text):
    assert main(page) == text


def site(spark, pages):
    rows = [(i, f"https://h.example/{i}" if i % 7 else "http://H.EXAMPLE:80/x?y", p, "a", "b") for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, row string")


def test_templates_go_where_pages_share_them(spark):
    pages = [f"<div><p>Subscribe to our letter today</p></div><div><p>Story number {i} has a body of its own.</p><p>It goes on {i * 7}.</p></div>" for i in range(20)]
    pages += [pages[3]] * 15  # copies of one page don't make its text a template
    got = {r["page_id"]: r["text"] for r in html_text.extract(site(spark, pages), ["page_id", "url"]).collect()}
    assert all(got[i] == f"Story number {i} has a body of its own.\nIt goes on {i * 7}." for i in range(20))
    assert got[25] == got[3]


def test_article_text_stays_unless_nearly_all_pages_share_it(spark):
    pages = [f"<article><h1>Head {i}</h1><p>" + ("A passage that many repeat." if i % 2 else f"own {i}") + "</p><p>Read more on our site</p></article>" for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(site(spark, pages), ["page_id", "url"]).collect()}
    assert got[1] == "Head 1\nA passage that many repeat." and got[2] == "Head 2\nown 2"


def test_odd_rows(spark, sf_dir):
    rows = spark.createDataFrame([(1, None, None), (2, "http://a.b/c", None), (2, "http://a.b/c", ""), (None, "", "<p>x"), (4, "no url", "<p>y")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(rows, ["page_id", "url"]).collect())
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0), (4, "y", 1)]
    assert html_text.extract(rows.limit(0), ["page_id", "url"]).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = queries.op7_html_text(spark, sf_dir).collect()
    assert len(out) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in out)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><h1>Title</h1><p>Lead</p><article><p>" + "long body " * 20 + "</p></article></main>", "Title\nLead\n" + ("long body " * 20).strip()),
        ("<article>" + "first " * 20 + "</article><article>short</article>", ("first " * 20).strip() + "\nshort"),
        ("<article>" + "first " * 20 + "</article><article><a href=x>linked teaser</a></article>", ("first " * 20).strip()),
    ],
)
def test_smaller_parts_of_unlinked_text_stay(page, text):
    assert main(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article class='post social-science'><p>x</article>", "x"),
        ("<article class='post has-sidebar comments-open'><p>x</article>", "x"),
        ("<article>a<section class='related-work'>b</section><section id='side-effects'>c</section></article>", "a\nb\nc"),
        ("<p>x <span class='ad'>Buy</span> y</p><p>a <span hidden>no</span> b <button>Go</button> c</p>", "x y\na b c"),
        ("<article><div class='post-sidebar'>no</div><div class='cookie-notice'>no</div><p title='the hidden side'>yes</article>", "yes"),
        ("<b><i>x</b> y</i><div><i>z</div> w</i>", "x y\nz\nw"),
        ("<p>" + "<b>" * 5000 + "x" + "</i>" * 5000, "x"),
    ],
)
def test_names_and_inline_elements(page, text):
    assert main(page) == text


def test_time_is_linear_in_depth():
    import time

    began = time.perf_counter()
    assert main("<article>" + "<div>" * 40_000 + "deep" + "</div>" * 40_000 + "<i>" * 40_000 + "x" + "</i>" * 40_000) == "deep\nx"
    assert time.perf_counter() - began < 20


def plain_tree(pages, least=0.3, sure=0.05):
    """The texts of pages of one host by a style tree in plain Python."""
    found = [html_text.blocks(p) for p in pages]
    heads = [next((b.text for b in f if b.tag == "h1" and not b.off), "\n".join(b.text for b in f)) for f in found]
    m = len(set(heads))
    contents, shapes = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for head, f in zip(heads, found):
        for b in f:
            contents[b.node, b.text].add(head)
        for parent in {b.parent for b in f}:
            shapes[parent][" ".join(b.tag for b in f if b.parent == parent)].add(head)
    own = lambda k: 1 - math.log(k) / math.log(m + html_text.UNSEEN)
    out = []
    for f in found:
        worth = {}
        for i, b in enumerate(f):
            o = own(len(contents[b.node, b.text]))
            kinds = [len(x) for x in shapes[b.parent].values()]
            g = 0.9 ** min(3, len(kinds))
            worth[i] = ((1 - g) * sum(k * own(k) for k in kinds) / sum(kinds) + g * o if len(contents[b.node, b.text]) > 1 else 1.0, o)
        out.append("\n".join(html_text.choose(f, worth, least, sure)))
    return out


def test_extraction_equals_a_plain_style_tree(spark):
    r = random.Random(5)
    pages = []
    for i in range(30):
        body = [f"<p>own {i} {j} {r.random()}</p>" if r.random() < 0.6 else f"<div><p>{r.choice(['again', 'and again', 'rights reserved'])}</p></div>" for j in range(r.randrange(6))]
        body.insert(0, r.choice(["", "<h2>Section</h2>", "<div class='notice'>new rules</div>"]))
        body.append("<div><p>Subscribe now</p></div>" if i % 3 else "")
        pages.append(("<article>%s</article>" if i % 4 == 0 else "<h1>Page " + str(i // 2) + "</h1>%s") % "".join(body))
    for some in (pages, pages[:2], pages[:5]):
        rows = spark.createDataFrame([(i, "https://one.example/x", p) for i, p in enumerate(some)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in html_text.extract(rows, ["page_id"]).collect()}
        assert [got[i] for i in range(len(some))] == plain_tree(some)


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c", "http://h.x/", "<p>x")], "page_id long, host string, blocks string, `row` string, url string, html string")
    (r,) = html_text.extract(rows, ["page_id", "host", "blocks", "row"]).collect()
    assert tuple(r) == (1, "a", "b", "c", "x", 1)


def test_settled_texts_take_little_disk(spark):
    """Blocks and texts are on disk together: four fifths of a plain Parquet table's bytes at most."""
    import os

    from tidelog.llm import shared

    r = random.Random(1)
    pages = spark.createDataFrame([(" ".join(f"w{r.randrange(3000)}" for _ in range(2000)),) for _ in range(50)], "text string").coalesce(1)
    size = lambda path: sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    with shared.scratch(spark):
        settled = size(shared.settle(pages).settled_at.removeprefix("file:"))
    plain = shared.folder(spark).removeprefix("file:")
    pages.write.parquet(plain)
    assert settled < 0.8 * size(plain)
