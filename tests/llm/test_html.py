import html as H
import re
import time
import tracemalloc

import pytest

from calibra.llm.html_extract import extract, main_text

LONG = "A sentence, with commas, that is long enough to count as a paragraph of text. "


@pytest.mark.parametrize("page, text", [
    ("<article><h1>T</h1><p>a &lt;b&gt; &amp;  c\n d<p>e</article><footer>f</footer>", "T\na <b> & c d\ne"),
    ("<body><nav><ul><li><a href=x>Home</a></ul></nav><div id=main><h2>Head</h2><p>" + LONG + "</p><p>" + LONG + "</p>"
     "<form>mail <input></form><div class='share-box'>Share</div></div><div class=sidebar><p>" + LONG * 3 + "</p></div></body>",
     "Head\n" + LONG.strip() + "\n" + LONG.strip()),
    ("<div class='post'><p>" + LONG + "</p></div><div id='comments'><p>" + (LONG + ", , , ,") * 9 + "</p></div>", LONG.strip()),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>x</article>", "Title\nx"),
    ("<p>one<script>var a='</p>'</script> two<style>p{}</style><!-- <p>no -->", "one two"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>1<li>2</ul><b>bold<p>after</article>", "a\nb\nc\n1\n2\nbold\nafter"),
    ("<article>x<br>y &copy; &#233; &nope; &am</article>", "x y © é &nope; &am"),
    ("<article hidden>no</article><nav>no</nav>", ""),
    ("plain words only", "plain words only"),
    ("", ""), (None, ""), ("  ", ""), ("<", "<"), ("<p", ""), ("</p></div>", ""),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract(pages).collect():
        inside = re.split(r"</article>", r.html.partition("<article>")[2])[0]
        parts = re.split(r"</?(?:h1|p)>", inside)
        want = [" ".join(H.unescape(re.sub(r"<[^>]*>?", " ", p)).split()) for p in parts]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_rows_and_columns(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", "<p>" + "long text, " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "text").selectExpr("*", "1 AS source")
    out = extract(df)
    assert out.columns == ["page_id", "html", "source", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == [0, 1, 1, 549_999]
    assert extract(df.limit(0)).count() == 0


STORY = ["The first paragraph of the story, with some commas, and enough words to count.", "The second one goes on, a little longer than before, to its end."]


def _story(n=2):
    return "".join(f"<p>{p}</p>" for p in STORY[:n])


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "overflow-hidden", "page with-sidebar no-header", "entry", "Layout--withFooter", "hidden-print"])
def test_names_that_say_something_else_do_not_cut(name):
    assert main_text(f'<body><div class="{name}">{_story()}</div><div class="site-footer">Some footer text, with a comma.</div></body>') == "\n".join(STORY)


@pytest.mark.parametrize("name", ["sidebar", "comment-list", "ad-box", "cookie-notice", "site-footer", "related-posts", "share-links", "post-comments", "newsletter signup"])
def test_furniture_inside_an_article_is_cut(name):
    assert main_text(f'<article>{_story(1)}<div class="{name}"><p>Something else, not of the story, that is long enough.</p></div><p>{STORY[1]}</p></article>') == "\n".join(STORY)


def test_pages_with_several_articles():
    a, b = (f"<article><p>{p}</p><p>{p}</p></article>" for p in STORY)
    assert main_text(f"<main>{a}{b}</main>") == "\n".join([STORY[0]] * 2 + [STORY[1]] * 2)
    assert main_text(f"<main>{a}<article><a href='x'>More, of this, here, for you, and you</a></article></main>") == "\n".join([STORY[0]] * 2)


def test_nothing_left_without_names():
    assert main_text(f'<div class="comments">{_story()}</div>') == "\n".join(STORY)


@pytest.mark.parametrize("unit", ["<font color=red>word, ", "<b><i>word ", "<div>word ", "<p><span>word ", "</b></i>word ", "<ul><li>word "])
def test_long_pages_of_open_elements_take_linear_time(unit):
    html = "<body><article>" + unit * (300_000 // len(unit))
    tracemalloc.start()
    begin = time.process_time()
    text = main_text(html)
    took, (_, peak) = time.process_time() - begin, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert text.count("word") == html.count("word")
    assert took < 10 and peak < 100 << 20  # tracing makes it many times slower
