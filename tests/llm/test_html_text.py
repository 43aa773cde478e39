"""Main texts of pages that are built around known articles, and of odd ones."""

import random

import pytest

from termlake.llm.html_text import extract_pages, main_text

SENTENCE = "The river, which is old, runs slowly through the plain and turns twice before the sea."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(6)) + "</ul>"
COMMENT = '<div class="c"><p>I have read this, all of it, twice, and I think, as many do, that the river, old or not, is a river, and no more than that, I say.</p></div>'
ARTICLE = ["A title of the page", SENTENCE, "Short.", f"{SENTENCE} {SENTENCE}", "Café & more <than> that …", "First item", "Second item", "A word said, and quoted."]
INNER = (
    "<h1>A title\n of the&nbsp;page</h1><p>The <b>river</b>, which is old, <a href='/x'>runs</a> slowly through the plain and turns twice before the sea.<p>Short."
    f"<p>{SENTENCE}\n\t {SENTENCE}</p><p>Caf&eacute; &amp; more &lt;than&gt; that &#8230;</p><ul><li>First item<li>Second <i>item</i></ul><blockquote>A word said, and quoted.</blockquote>"
)
LAYOUTS = [
    "<article>{0}</article>",
    "<main>{0}</main>",
    "<div class='content'>{0}</div>",
    "<div>{0}</div>",
    "<div id='page' class='has-sidebar'><section>{0}</section></div>",
    "<table><tr><td>" + MENU + "</td><td>{0}</td></tr></table>",
    "<div class='wrapper'><div class='entry'>{0}<div class='share-buttons'><a>Share</a></div></div><div class='sidebar'><p>" + SENTENCE + "</p></div></div>",
    "<div class='site-header-fixed'><article class='post'>{0}</article></div>",
]
AROUND = [
    ("<nav>" + MENU + "</nav>", "<footer><p>&copy; us, all of us, for ever, and a day more.</p></footer>"),
    ("<div id='top-menu'>" + MENU + "</div><div class='cookie-notice'><p>We use cookies, many, of all kinds, as everybody does today.</p></div>", "<section id='comments'><h2>Comments</h2>" + COMMENT * 9 + "</section>"),
    ("<header><h1>Our site</h1><p>News, views, and more.</p></header><script>var x = '<p>no, no, no</p>';</script>", "<aside><p>" + SENTENCE + "</p></aside><form><p>Write to us, please, at once.</p></form><style>p { x: y }</style>"),
    ("<div class='ad'>Buy, buy, buy now, and buy more, for less, today, only here and only now.</div>", "<div role='contentinfo'><p>Legal words, many.</p></div><div hidden><p>" + SENTENCE + "</p></div></body></html>"),
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("around", AROUND)
def test_known_articles(layout, around):
    page = "<!DOCTYPE html><html><head><title>Not this</title></head><body>" + around[0] + layout.format(INNER) + around[1]
    assert main_text(page).split("\n") == ARTICLE


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<p>hi", "hi"), ("no markup at all", "no markup at all"), ("<!-- never closed <p>x", ""), ("<script>never closed <p>x", ""), ("a < b, c > d", "a < b, c > d"),
        ("<article>one<br>two<br><br>three</article>", "one two\nthree"), ("<article><p>&am &amp &notit; &#x41;&#0;</p></article>", "&am & ¬it; A�"),
        ("<article><header><h1>Title</h1><p>By me</p></header><p>Text.</p></article>", "Title\nText."), ('<a href="x>unclosed <p>text', "unclosed\ntext"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article><p title=\"a > b\">one</p><P>two</P ></ARTICLE>", "one\ntwo"), ("<nav>only a menu</nav>", ""),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_pages_as_rows(spark):
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    rows = [(1, "u", long, "t", 5), (2, None, None, None, None), (None, "v", "<p>x", "t", 1), (1, "u", long, "t", 5)]
    got = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")).collect()
    whole = "\n".join(["word"] * 50_000)
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", whole, len(whole)), (2, None, "", 0), (None, "v", "x", 1), (1, "u", whole, len(whole))], key=str)
    assert extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_any_text_is_a_page():
    rnd = random.Random(4)
    bits = ["<p>", "</p>", "<div", " class='ad'", ">", "<", "</", "<a href=x>", "</a>", "<table>", "<td>", "<li>", "&amp", "&#", "text, more", "\"", "'", "=", "<!--", "-->", "<script>", "</script>", "\x00", "<br/>", "</table>", "é"]
    for _ in range(400):
        text = main_text("".join(rnd.choices(bits, k=rnd.randrange(40))))
        assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and "\n\n" not in text
