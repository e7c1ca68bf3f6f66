"""Main text of pages: the test tables' against a plain cut, and layouts by hand."""

import html
import re

import pytest

from tidemark.llm import html_text, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tree():
    return html_text.train()


def cut(page):
    """The article of a test page: its paragraphs, by splitting."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_articles_of_the_test_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = queries.op13_html_text(spark, SF).collect()
    assert found[0].__fields__ == ["page_id", "url", "text", "n_chars"] and len(found) == len(pages)
    for r in found:
        assert r["text"] == cut(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_the_tree_knows_its_table_and_layouts_it_has_not_seen(tree):
    held = html_text.train(html_text.LABELLED[::2])
    right = total = 0
    for k, page in enumerate(html_text.LABELLED):
        found = html_text.blocks(html_text.filled(page))
        truth = [t.startswith("+") for t in found.texts]
        assert list(tree.predict(html_text.features(found))) == truth
        if k % 2:
            right += sum(a == b for a, b in zip(held.predict(html_text.features(found)), truth, strict=True))
            total += len(truth)
    assert right / total > 0.9


WORDS = "one two three four five six seven eight nine ten " * 3
CASES = {
    # what stands inside an article and is not of it
    "<article><h1>T</h1><p>a</p><div class='ad-box'>buy</div><aside>x</aside><p>b</p><form>f <input></form><section id=comments><p>c</p></section></article>": "T\na\nb",
    "<article><p>a</p><script>var s='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> --><p>b</p></article>": "a\nb",
    "<main><header><nav>n</nav></header><h2>H</h2>text <b>bold</b>er<br>line</main><div class='cookie-notice'>ok</div>": "H\ntext bolder line",
    "<body class='has-sidebar'><article class='post no-sidebar'><p>a</p></article><div class=sidebar>b</div>": "a",
    "<article><p>x <button>Share</button> y <span class=ad>buy</span>z</p></article>": "x y z",
    "<article>A<div hidden>b</div><div style='display: none'>c</div>D</article><footer>e</footer>": "A\nD",
    "<article><p>a</p><article class=comment><p>c</p></article></article><article class=related-item>r</article>": "a",
    # references and white space
    "<article><p>&amp;amp; &lt;p&gt; &eacute;&#233;&#xe9; &nbsp; a\n\t b &copy</p></article>": "&amp; <p> ééé a b ©",
    "<article><p> \n </p><p>1 < 2 &am</p></article>": "1 < 2 &am",
    # broken markup
    "<article><p><b>a<br><p>b<p>c</article>d": "a\nb\nc",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>f</article>": "a\nb\nc\nd\ne\nf",
    "<article><p>a</p></div></span><p>b": "a\nb",
    "<article><p title='x>y'>a</p><p title=\"never closed>b</p><p>c</p></article>": "a\nb\nc",
    "<article><p>a</p><!-- no end <p>b</p></article>": "a",
    "<article><p>a</p><script>no end <p>b</p></article>": "a",
    "<ARTICLE><P>a</P><SCRIPT>x</Script><p>İb</p></ARTICLE>": "a\nİb",
    "<article><p>a</p></article><": "a",
    "<article></article><p>b": "",
    "": "", "   ": "", "<": "", "<p": "", "<article>1 < 2 <": "1 < 2 <",
    # no article: by words and links
    f"<div><a href=/>home</a> <a href=/>news</a></div><h1>one two three four</h1><p>{WORDS}</p><p>yes</p><p>{WORDS}</p><div class=footer>{WORDS}</div>": f"one two three four\n{WORDS.strip()}\nyes\n{WORDS.strip()}",
}


@pytest.mark.parametrize("page", CASES)
def test_layouts(tree, page):
    assert html_text.main_texts([page], tree) == [CASES[page]]


def test_rows_of_every_kind(spark, tree):
    page = "<article><p>a b</p></article>"
    long = "<article>" + "<p>word &amp; word</p>" * 100_000 + "</article>"
    rows = [(1, page), (1, page), (None, page), (2, None), (3, ""), (4, long), (5, "<div>" * 20000 + "<article>x</article>"), (6, "<a x='" * 20000 + "><article>y</article>")]
    df = spark.createDataFrame([(i, h, "t", 7, "z", "y") for i, h in rows], "page_id long, html string, text string, n_chars int, `a.b` string, `my col` string")
    found = html_text.extract(df, tree, keep=("page_id", "a.b", "my col")).collect()
    assert [(r["page_id"], r["n_chars"]) for r in found[:5]] == [(1, 3), (1, 3), (None, 3), (2, 0), (3, 0)]
    assert found[5]["text"] == "\n".join(["word & word"] * 100_000) and found[0]["a.b"] == "z" and found[0]["my col"] == "y"
    assert html_text.extract(df.limit(0), tree).collect() == []
    with pytest.raises(ValueError, match="added"):
        html_text.extract(df, tree, keep=("text",))
