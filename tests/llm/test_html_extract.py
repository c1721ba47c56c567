"""HTML extraction: blocks, alignment and differencing."""

from __future__ import annotations

import random

from tidemark.llm import html_extract, page_blocks, queries
from tidemark.llm.html_extract import extract_text
from tidemark.llm.page_blocks import blocks_of, common

PAGES = "page_id long, url string, html string, text string"


def texts(spark, pages):
    rows = [(k, url, page, "old") for k, (url, page) in enumerate(pages)]
    found = extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    assert all(r.n_chars == len(r.text) for r in found)
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_article_is_kept_and_the_rest_is_not():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header>H</header><nav><ul><li>menu</li></ul></nav><div class="ad top">buy</div>
    <article class="post"><header><h1>One &amp;&#32;two</h1></header>
    <p>a<b>b</b>\n c<br>d &lt;e&gt; &nbsp; f<p>g<script>if (a<b) "</p>"</script>
    <div id="comments"><p>reader</p></div><div class="share">s</div><form>q<input></form></article>
    <aside>side</aside><p>outside</p><div class="cookie-notice">c</div><footer>&copy;</footer>"""
    found = blocks_of(page)
    assert found.main == ["One & two", "ab c", "d <e> f", "g"]
    assert found.outside == ["outside"]


def test_broken_markup():
    assert blocks_of("").main == blocks_of("").outside == []
    assert blocks_of("a < b <3").outside == ["a < b <3"]
    assert blocks_of("<p>x<!-- never closed <p>y").outside == ["x"]
    assert blocks_of('<p title="a>b">x</p>').outside == ["x"]
    assert blocks_of('<p title="never closed>x</p>').outside == ["x"]
    assert blocks_of("<script>never closed").outside == []
    assert blocks_of("<nav>open<article><p>x</p></article>y").main == ["x"]
    assert blocks_of("</div></p>x &am &bogus;").outside == ["x &am &bogus;"]
    assert blocks_of("<p>" * 50_000 + "x" + '<a "' * 20_000).outside[0].startswith("x")


def test_only_exact_attributes_rule_out():
    for kept in (
        'style="overflow:hidden"', 'aria-hidden="false"', 'data-id="ad"', 'title="x hidden"',
        'id="related-work"', 'class="search-trees social-history"', "data-x='class=\"ad\"'",
    ):
        assert blocks_of(f"<article><div {kept}>x</div></article>").main == ["x"], kept
        assert blocks_of(f"<article {kept}>x</article>").main == ["x"], kept
    for dropped in ("hidden", "HIDDEN/", 'class="a comments"', "id=share", "ROLE = 'ad'"):
        found = blocks_of(f"<article>x<div {dropped}>y</div></article>")
        assert found.main == ["x"], dropped
    assert blocks_of('<body style="overflow-x:hidden" class="no-sidebar">x</body>').outside == ["x"]
    assert blocks_of('<body><div class="post-footer">y</div>x</body>').outside == ["x"]


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    chance = random.Random(1)
    for cells in (page_blocks.CELLS, 6):
        monkeypatch.setattr(page_blocks, "CELLS", cells)
        for _ in range(300):
            a, b = (chance.choices("abcd", k=chance.randint(0, 14)) for _ in "ab")
            marks = sorted(common(a, b))
            assert len(marks) == longest(a, b)
            rest = iter(b)
            assert all(a[k] in rest for k in marks)
    assert len(common(["x"] * 30_000, ["x"] * 20_000 + ["y"])) == 20_000


def test_nearest_url_decides_what_is_shared(spark):
    def page(*lines):
        return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"

    pages = [
        ("http://a.com/x/1", page("top", "one", "end")),
        ("http://a.com/x/2", page("top", "two", "end")),
        ("http://a.com/y/1", page("start", "three", "end")),
        ("http://a.com/y/2", page("start", "four", "end")),
        ("http://b.com/x/1", page("top", "alone", "end")),
        ("http://c.com/1", page("same", "text")),
        ("http://c.com/2", page("same", "text")),
    ]
    expected = ["one", "two", "three", "four", "top alone end", "same text", "same text"]
    assert texts(spark, pages) == expected


def paragraphs(*lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_pages_with_an_article_are_aligned_too(spark):
    def page(k):
        own = paragraphs(f"own {k}", "licence")
        return f"<p>top</p><article>{own}</article><p>licence</p><p>note {k}</p>"

    found = texts(spark, [(f"http://a.com/{k}", page(k)) for k in (1, 2)])
    assert found == ["own 1 licence note 1", "own 2 licence note 2"]


def test_copies_and_near_copies_are_no_pairs(spark, monkeypatch):
    same = [f"paragraph {k} of a text that many pages repeat" for k in range(20)]
    menu = ["home", "news"]
    pages = [(f"http://a.com/n{k}", paragraphs(*menu, *same, f"day {k}", "end")) for k in range(9)]
    pages += [("http://a.com/n4x", paragraphs(*menu, "exact", "end"))] * 3
    pages += [("http://a.com/z", paragraphs(*menu, "other text", "end"))]
    # All lines of this one stand in the page beside it, not in the next.
    pages += [("http://b.com/p/aa", paragraphs("top", "short", "end"))]
    pages += [("http://b.com/p/ab", paragraphs("top", "short", "end", "much more text than that", "and more"))]
    pages += [("http://b.com/q", paragraphs("top", "else", "end"))]
    wanted = [" ".join([*same, f"day {k}"]) for k in range(9)]
    wanted += ["exact"] * 3 + ["other text", "short", "much more text than that and more", "else"]
    for waiting in (html_extract.WAITING, 1):
        monkeypatch.setattr(html_extract, "WAITING", waiting)
        assert texts(spark, pages) == wanted


def test_odd_pages_and_empty_table(spark):
    long = "<article><p>" + "word &amp; " * 100_000 + "</p></article>"
    pages = [
        (None, None),
        (None, "<p>x</p>"),
        ("", ""),
        ("http://a.com/1", "<article><p>kept</p></article>"),
        ("http://a.com/1", "<article><p>kept</p></article>"),
        ("http://a.com/2", long),
        ("http://a.com/3", "<nav>only menu</nav>"),
    ]
    found = texts(spark, pages)
    assert found[:5] == ["", "x", "", "kept", "kept"]
    assert found[5] == " ".join(["word &"] * 100_000)
    assert found[6] == ""
    assert texts(spark, []) == []


def test_query_reads_every_article(spark, data_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()}
    rows = queries.op3_extract(spark, data_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        assert r.url == pages[r.page_id].url
        assert r.text == " ".join(blocks_of(inner).outside)
        assert r.text


def test_valid_pages_keep_their_text():
    """What the standard lets a page leave out, and what its attributes may hold."""
    assert blocks_of("<html><head><title>t</title><body><article><p>x</article>").main == ["x"]
    assert blocks_of("<head><meta charset=a><style>s</style><p>x<p>y").outside == ["x", "y"]
    assert blocks_of('<article><p title="a<b">T</p><p title=\'<p>"\'>U</p></article>').main == ["T", "U"]
    assert blocks_of("<ul><li hidden>a<li>b</ul><p>c").outside == ["b", "c"]


def test_comments_teasers_and_hidden_elements_go():
    for page in (
        '<article><p>x</p></article><section id="comments"><article class="comment-body">c</article></section>',
        '<aside><article class="teaser">c</article></aside><article><p>x</p></article>',
        '<nav><main>c</main></nav><footer><article>c</article></footer><article>x</article>',
        '<div class="related"><article>c</article></div><article>x</article>',
        '<article>x<div class="comment-list"><p>c</p></div><div id="comments-section">c</div></article>',
        '<article>x<p class="advert">c</p></article>',
        "<article>x<p hidden>c<b>c</b></p></article>",
        "<article>x<span hidden>c <i>c</i></span></article>",
    ):
        assert blocks_of(page).main == ["x"], page
    assert blocks_of("<article>a <span hidden>b</span> c<p hidden>d<p>e</article>").main == ["a c", "e"]
    # Left open, or no whole word: nothing surrounds the article.
    assert blocks_of("<aside>open<article><p>x</p></article>").main == ["x"]
    assert blocks_of('<div class="has-sidebar"><article><p>x</p></article></div>').main == ["x"]
    assert blocks_of("<p hidden>a<div>x</div>").outside == ["x"]
    assert blocks_of("<aside>" * 3000 + "<article>c</article></aside>" + "<p>y").outside == []
