from payerlens.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-banner">We use cookies <button>OK</button></div><!-- gone > --><div class="ad">Buy this now.</div>
<article><h1>Head&nbsp;line &amp; more</h1><p>First <b>paragraph
 of</b> text.<p>Short.<div class="advert">Advert inside</div><ul><li>Point one</li><li>Point <a href="x">two</a></li></ul>
<form><label>Name</label><input><select><option>x</option></select></form><p>Last &lt;one&gt;</article>
<aside>See also <a href="/c">that</a></aside><section id="comments"><p>Great post!</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head line & more First paragraph of text. Short. Point one Point two Last <one>"


def test_pages_without_a_named_part():
    page = "<ul><li><a href=a>Home</a><li><a href=b>About</a></ul><p>Some words of text here.</p><p>End</p><a href=c>Next</a>"
    assert html.main_text(page) == "Some words of text here. End"


def test_names_that_are_no_places():
    text = "Some words of the article are here."
    for start, end in (
        ("<article class='post category-reviews'>", "</article>"), ("<div class='content has-sidebar'>", "</div>"),
        ("<main id='comments-main' class='search'>", "</main>"), ("<div class='no-ads with-menu tag-social'><article>", "</article></div>"),
        ("<div class='social-studies'>", "</div>"), ("<div class='layout-sidebar-left post-content'>", "</div>"),
        ("<div data-id='sidebar' data-role='menu'>", "</div>"), ("<article><div class='entry-header'>", "</div></article>"),
    ):
        assert html.main_text(f"<body>{start}<p>{text}</p>{end}</body>") == text, start


def test_names_of_places():
    for name in (
        "sidebar", "site-header", "mainNav", "main-menu", "page_footer", "comments-area", "comment-list", "post-comments", "related-posts",
        "ad-slot", "ad-300x250", "cookie-banner", "newsletter-signup", "share-buttons", "widget-area", "search-form", "comment-17", "x ad y",
    ):
        for page in (f"<article><p>Kept words.</p><div class='{name}'>Not these.</div></article>", f"<main><p>Kept words.</p><div id='{name}'>Not these.</div></main>"):
            assert html.main_text(page) == "Kept words.", name


STORY = "The river rose in the night and by the morning the lower street of the old town stood under a foot of brown water."
SECOND = "People carried what they could up the stairs, and the baker gave his bread away before the flood could take it."

#: Pages that no row of the labelled table was made from, with their main text.
HELD_OUT = (
    (f"<h1 class='post-title'>Title</h1><div class='text'><p>{STORY}</p><p>{SECOND}</p></div>", f"Title {STORY} {SECOND}"),
    (f"<h1 class='entry-title'>Title</h1><div class='text'><p>{STORY}</p></div>", f"Title {STORY}"),
    (f"<div class='wrap'><h2>Flood</h2><p>{STORY}</p><p>{SECOND}</p></div><ul><li class='story'><a href=a>Other story</a></li></ul>", f"Flood {STORY} {SECOND}"),
    (f"<form id='aspnetForm'><main><h1>Flood</h1><p>{STORY}</p></main><input></form>", f"Flood {STORY}"),
    (f"<form><div><p>{STORY}</p><p>{SECOND}</p></div></form>", f"{STORY} {SECOND}"),
    (f"<header>Site</header><article><header><h1>Title</h1></header><p>{STORY}</p></article>", f"Title {STORY}"),
    (f"<ul><li><a href=a>Home</a><li><a href=b>World news</a></ul><h1>Flood</h1><p>{STORY}</p><p>Yes.</p><p>{SECOND}</p>"
     "<p>More</p><ul><li><a href=c>One</a><li><a href=d>Two</a></ul><p>Copyright us</p>", f"Flood {STORY} Yes. {SECOND} More"),
    (f"<div><a href=a>Start</a> <a href=b>Sport</a> <a href=c>Money</a></div><p>{STORY} <a href=d>Read the report</a> now.</p>"
     "<div><a href=e>Storm warning for the north</a></div><p>Strong winds are expected from Friday on, the office says today.</p>"
     "<div><a href=f>Bridge closed for repairs</a></div>", f"{STORY} Read the report now."),
    (f"<td class='x'>Menu</td><td><a href=a>A</a></td><td><a href=b>B</a></td><table><tr><td>{STORY}</td></tr></table>", STORY),
)


def test_held_out_pages():
    assert [html.main_text(page) for page, _ in HELD_OUT] == [text for _, text in HELD_OUT]


def test_tree_uses_words_and_neighbours():
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(html.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html.tree())
    assert {"words", "link", "link_before", "link_after"} <= used and used & {"words_before", "words_after"}
    rows, marks = html.labelled()
    assert (html.classify(rows) == marks).all()


def test_math():
    page = "<article><p>If <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> holds.</p></article>"
    assert html.main_text(page) == "If x=2 holds."


def test_broken_markup():
    assert html.main_text("") == html.main_text("<p>") == html.main_text("<script>x") == ""
    assert html.main_text("plain <b>text") == "plain text"
    assert html.main_text("<article><p>a</b></p></div><p>b <!-- open") == "a b"
    assert html.main_text("<p title='a>b'>x</p") == "x"
    deep = "<div>" * 5000 + "inside" + "</div>" * 4000
    assert html.main_text(deep) == "inside"


def test_rows(spark):
    rows = [(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "v", "", 9), (3, "w", "<p>" + "long words " * 60_000, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html.extract(pages).collect()
    assert len(got) == 5 and sorted(len(r.text) for r in got)[-1] == 660_000 - 1
    assert html.extract(pages.where("false")).count() == 0
