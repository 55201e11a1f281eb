"""Pages written by hand with the text that a reader would take from them; none comes from the labelled table."""

import pytest

from tremor.llm import extraction

LONG = "This is a long paragraph of the main text, with enough words in it that a reader would take it for what the page is about."
MORE = "A second paragraph follows the first one and says somewhat more about the same matter, in the same even tone as before."
LAST = "At the end the writer sums up what was said in the paragraphs above and names what is left open for another day."

PAGES = {
    "container called more": (f"<div class='article-more'><p>{LONG}</p></div>", [LONG]),
    "one plain paragraph": ("<p>Just a plain fragment of text with many words in a row and no end</p>", ["Just a plain fragment of text with many words in a row and no end"]),
    "no tags": ("plain text without any tags at all, on one line\nand another", ["plain text without any tags at all, on one line and another"]),
    "inline element": (
        f"<nav><a href=x>Home</a></nav><article><h1>A title</h1><p>See <span class='search'>inline thing</span> in the main text of this page.</p><p>{LONG}</p></article><footer>us</footer>",
        ["A title", "See inline thing in the main text of this page.", LONG],
    ),
    "bait after a bare article": (f"<h1>Some title</h1><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p><div class='blurb'><p>Click here to win a prize now and today</p></div>", ["Some title", LONG, MORE, LAST]),
    "names of a style sheet": (
        f"<div class='x1a9'><ul><li><a href=1>Start</a></li><li><a href=2>News of today</a></li><li><a href=3>Sports</a></li></ul></div><div class='q7'><h2>How it went on</h2><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></div>"
        "<div class='z3'><a href=4>Another story</a><a href=5>One more story</a></div>",
        ["How it went on", LONG, MORE, LAST],
    ),
    "comments below": (
        f"<header><a href=/>Site</a></header><main><h1>On rivers</h1><p>{LONG}</p><p>{MORE}</p><section id='comments'><h3>3 comments</h3><div class='comment'><p>{LAST}</p></div>"
        f"<div class='comment'><p>Nice, thanks a lot for this!</p></div></section></main><footer>All rights reserved by the site</footer>",
        ["On rivers", LONG, MORE],
    ),
    "aside and form within": (
        f"<article><h1>On hills</h1><p>{LONG}</p><aside><p>Read also what we wrote about valleys last week.</p></aside><p>{MORE}</p><form><label>Your mail</label><button>Send</button></form><p>Short end.</p></article>",
        ["On hills", LONG, MORE, "Short end."],
    ),
    "entities, scripts, comments, open tags": (
        f"<script>if (a < b) document.write('<p>no</p>')</script><style>p{{}}</style><!-- <p>no</p> --><article><p>Fish &amp; chips &#8212; 1 &lt; 2<p>{LONG}<br>next   line\n here</article><template><p>{MORE}</p></template>",
        ["Fish & chips — 1 < 2", f"{LONG} next line here"],
    ),
    "only menus": ("<nav><ul><li><a href=1>Start</a></li><li><a href=2>News</a></li></ul></nav><footer>Imprint</footer>", []),
    "cut off": ("<article><p>The text was cut <off", ["The text was cut"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert extraction.main_text(page, *extraction.model()) == "\n".join(want)


def test_tree_looks_mostly_at_words_and_links():
    used = []

    def walk(node):
        if isinstance(node, tuple):
            used.append(extraction.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(extraction.model()[0])
    core = [f for f in used if f.startswith(("words", "link_density"))]
    assert len(core) > 0.6 * len(used) and {"words", "link_density", "words_before", "words_after", "link_density_before", "link_density_after"} <= set(used)


def test_held_out_lengths():
    """The table's pages with other lengths, elements and names left out than those the tree has seen."""
    node, worth = extraction.model()
    right = [(extraction.likelihood(row, node) >= 0.5) == y for rows in extraction.labelled(6, 99) for row, (_, y) in zip(extraction.table_of([b for b, _ in rows], worth), rows, strict=True)]
    assert sum(right) > 0.95 * len(right)


def test_odd_tables(spark):
    long = f"<article>{'<p>Some words of a very long page.' * 60_000}</article>"
    rows = [(1, "u", "<p>One page of words.</p>", "x", 1), (1, "u", "<p>One page of words.</p>", "x", 1), (None, None, None, None, None), (2, "u", "", "y", 2), (3, None, "  \n", "y", 2), (4, "u", long, "z", 3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.main_texts(table).collect()}
    assert extraction.main_texts(table).count() == 6 and got[1] == ("One page of words.", 18) and got[None] == got[2] == got[3] == ("", 0)
    assert got[4][0].count("\n") == 59_999 and got[4][1] == len(got[4][0])
    assert extraction.main_texts(table.limit(0)).count() == 0


def test_whole_pages(spark):
    """The table's pages have one layout, whose article element holds all of the text and nothing else."""
    for r in extraction.main_texts(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert r["text"] == "\n".join(b.text for b in extraction.blocks_of(inside))
