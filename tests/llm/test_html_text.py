import numpy as np

from strandsieve.llm import html_text

PAGE = """<html><head><title>x</title><script>var a="</p>";</script></head><body><header><a href=/>Home</a> Site name</header>
<div id="cookie-notice">We use cookies, accept all of them please</div><aside class=sidebar>Some side text</aside>
<div class="post"><h1>Title A&amp;B</h1><p>First <b>bo</b>ld para&nbsp;graph with many words &eacute;.</p><form>sign up now</form>
<p>Second 1 &lt; 2<br>line</p><div class="ad">buy this</div><p>third long paragraph of text</p></div>
<div class="comments"><p>I disagree very much indeed my friend</p></div><footer>copy</footer></body></html>"""


def test_best_region_is_the_maximum_sum():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = rng.integers(-5, 6, rng.integers(0, 12)).astype(float)
        a, b = html_text.best_region(x)
        best = max([0.0, *(x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        assert x[a:b].sum() == best


def test_content_without_boilerplate():
    want = "Title A&B First bold para graph with many words é. Second 1 < 2 line third long paragraph of text"
    assert html_text.main_text(PAGE, html_text.DEFAULT) == want


def test_odd_pages():
    for page in (None, "", "<p", "<!-- never ends", "<script>x", "<nav>menu</nav>"):
        assert html_text.main_text(page, html_text.DEFAULT) == ""
    assert html_text.main_text("plain &amp text <b>bold", html_text.DEFAULT) == "plain & text bold"
    assert html_text.main_text("<p>" + "w " * 100_000, html_text.DEFAULT).count("w") == 100_000


def test_extract(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "<main><p>a b c</p></main><div>menu</div>")]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert [g[0] for g in got] == ["1", "1", "2", "None"] and got[2][1] == "a b c" and got[3][1:] == ("", 0) and all(n == len(t) for _, t, n in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_driver_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        body = source[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", body)).split())


#: As learned from pages of one template: words far above zero, and many tags far below.
STEEP = {**html_text.DEFAULT, "word": 8.0, "word:link": -8.0, **{f"tag:{t}": -8.0 for t in ("div", "ul", "li", "a", "nav", "td", "tr")}}


def test_articles_keep_their_ends():
    page = "<body><nav><a href=/>home</a> <a href=/x>more of it</a></nav><article><p><a href=1>This long linked phrase</a> begins a text of some words.</p><p>A second one, see <a href=2>the last of all the links here</a></p><ul><li>one</li><li>two</li><li>three</li></ul></article><footer>(c)</footer></body>"
    want = "This long linked phrase begins a text of some words. A second one, see the last of all the links here one two three"
    for weights in (html_text.DEFAULT, STEEP):
        assert html_text.main_text(page, weights) == want
        # a division does as well, unless what follows is mostly links
        other = page.replace("<article>", '<div class="post-body">').replace("</article>", "<p><a href=3>other</a> <a href=4>pages</a></p></div>")
        assert html_text.main_text(other, weights) == want


def test_names_inside_the_content():
    page = "<main><p>Some words to begin with.</p><div class='related-work'><p>Work that came before it.</p></div><div class='related-posts'><p>Ten more things</p></div><section id=comments><p>first!</p></section><div class=adSlot>buy</div><p>Last words.</p></main>"
    assert html_text.main_text(page, html_text.DEFAULT) == "Some words to begin with. Work that came before it. Last words."


TEMPLATES = [
    "<html><body><div class='top-menu'><ul><li><a href=/>Start</a></li><li><a href=/b>News</a></li></ul></div><div id=sidebar><p>Most read this week</p></div><article><header><h1>{t}</h1></header>{p}</article><div id='comments'><p>I liked it a lot, thank you</p></div></body></html>",
    "<html><body><div role=banner><p>Our site, since 1999</p></div><div id=page><main><h2>{t}</h2>{p}<form><p>Your mail</p></form></main><aside><p>About the author and others</p></aside></div><footer><p>All rights</p></footer></body></html>",
    "<html><body><table><tr><td><a href=/>Home</a> <a href=/2>Two</a></td></tr></table><div class=cookie-consent><p>We use cookies here</p></div><div class='entry'><h1>{t}</h1>{p}</div><div class=newsletter-signup><p>Sign up for our letter</p></div></body></html>",
]


def test_three_templates_of_one_table(spark):
    rows, want = [], {}
    for i in range(60):
        body = [f"Paragraph {i} of {k} has &lt;some&gt; words, and <a href=/{k}>a link</a> to it." for k in range(3 + i % 3)]
        rows.append((i, "u", TEMPLATES[i % 3].format(t=f"Title {i}", p="".join(f"<p>{x}</p>" for x in body))))
        want[i] = " ".join([f"Title {i}", *(x.replace("&lt;", "<").replace("&gt;", ">").replace("</a>", "").replace(f"<a href=/{k}>", "") for k, x in enumerate(body))])
    rows += [(100, "u", "<p>no labelled element &amp; no names</p>"), (101, "u", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**want, 100: "no labelled element & no names", 101: ""}


def test_parts_of_names_are_learned(spark):
    page = "<body><div class='zork-box'><p>{0}</p></div><article><div class='blah'><p>{0}</p></div></article></body>".format("word " * 30)
    weights = html_text.learn_weights(spark.createDataFrame([(page.replace("word", f"w{i}"),) for i in range(20)], "html string"))
    assert weights["part:zork"] < -2 and weights["part:blah"] > 1
    assert html_text.main_text("<body><div class=zork>short one</div><div class=x><p>this is the text of it</p></div></body>", weights) == "this is the text of it"


def test_deep_and_broken_pages_take_time_by_their_size():
    text = "<p>the text of it is here</p>"
    for page in ("<div>" * 100_000 + text, "<div class='ab'>" * 100_000 + text + "</section>" * 100_000, "<svg><iframe>" * 100_000 + text, "<b>" * 100_000 + text):
        assert html_text.main_text(page, html_text.DEFAULT) == "the text of it is here"


def test_very_long_pages_are_read_whole():
    words = " ".join(f"w{i}" for i in range(300_000))
    assert html_text.main_text(f"<nav>menu</nav><article><h1>t</h1><p>{words}</p></article><footer>end</footer>", html_text.DEFAULT) == "t " + words


def test_icons_that_close_themselves_take_nothing_along():
    for icon in ('<svg class="i"/>', "<svg viewBox='0 0 9 9' />", '<svg><path d="M0"/></svg>', "<svg>", "<iframe src=x />"):
        page = f"<body><article><h1>{icon} Title</h1><p>first half of it</p>{icon}<p>second half {icon} of it</p></article></body>"
        assert html_text.main_text(page, html_text.DEFAULT) == "Title first half of it second half of it"


PROSE = "The law was changed in that year, and all who had paid for it before were asked to file their claims again within two months."


def test_names_alone_do_not_decide():
    for name in ("social-security", "related-work", "cookie-recipe", "search-engines", "share-prices", "discussion"):
        page = f"<article><h1>Title</h1><p>{PROSE}</p><section id='{name}'><h2>On it</h2><p>{PROSE}</p><p>{PROSE}</p></section><p>Last words of it.</p></article>"
        assert html_text.main_text(page, html_text.DEFAULT) == f"Title {PROSE} On it {PROSE} {PROSE} Last words of it."
    for name in ("social", "share-buttons", "related", "cookie-notice", "advert", "newsletter-signup", "sidebar-widget"):
        page = f"<article><h1>Title</h1><p>{PROSE}</p><div class='{name}'><p>Some few words</p></div><p>Last words of it.</p></article>"
        assert html_text.main_text(page, html_text.DEFAULT) == f"Title {PROSE} Last words of it."


def test_comments_of_readers():
    thread = "".join(f"<div class=post><span>reader{i}</span><p>{PROSE}</p></div>" for i in range(3))
    for inner in (thread, "<p>I liked it.</p><p>Me too, very much</p>", f"<p>{PROSE}</p>"):
        for name in ("discussion", "comments", "user-comments", "replies"):
            for page in (f"<article><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><div class='{name}'>{inner}</div></article>", f"<div class=story><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class='{name}'>{inner}</div>"):
                assert html_text.main_text(page, html_text.DEFAULT) == f"T {PROSE} {PROSE}", (name, inner)


def test_a_linked_last_paragraph_stays_and_a_list_of_links_goes():
    page = f"<body><div class=story><h1>T</h1><p>{PROSE}</p><p><a href=/r>Read the whole report here.</a></p>{{}}</div></body>"
    want = f"T {PROSE} Read the whole report here."
    assert html_text.main_text(page.format(""), html_text.DEFAULT) == want
    assert html_text.main_text(page.format("").replace("story", "box"), STEEP) == want
    for links in ("<p><a href=1>One</a> <a href=2>Two</a></p>", "<ul><li><a href=1>One more of them here</a></li><li><a href=2>Two more of them here</a></li></ul>", "<p><a href=1>Next</a></p>"):
        got = html_text.main_text(page.replace("<p><a href=/r>Read the whole report here.</a></p>", "").format(links), html_text.DEFAULT)
        assert got == f"T {PROSE}", links


def test_a_form_around_the_page_is_no_form():
    page = f"<form id=aspnet><div><a href=/>Home</a></div><div class=main><h1>T</h1><p>{PROSE}</p><form><input><p>Your mail</p></form><p>{PROSE}</p></div></form>"
    assert html_text.main_text(page, html_text.DEFAULT) == f"T {PROSE} {PROSE}"


def made_pages(n, seed):
    """(page, text): pages of five templates around articles that are made first, so that their text is known."""
    import html
    import random

    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "cor", "den", "fi", "gul", "ha", "jo", "kel", "mi", "or") for b in ("", "n", "ta", "sil", "re", "mond")] + ["<b", "R&D", "é", "5", "日本"]
    line = lambda a, b: " ".join(rng.choices(vocabulary, k=rng.randint(a, b)))

    def inline(text):
        out = []
        for w in text.split():
            w = html.escape(w)
            out.append(rng.choice([w] * 12 + [f"<b>{w}</b>", f"<a href='/x?{w}'>{w}</a>", f"<span class=x>{w}</span>"]))
        return rng.choice([" ", "\n  ", "&nbsp;"]).join(out)

    def junk():
        return rng.choice(["", "", "<div class='ad-slot'><p>Buy it now</p></div>", "<aside><p>By the way, as said before</p></aside>", "<form><p>Your mail</p><button>Send</button></form>", "<!-- <p>old</p> -->", "<script>if (a<b) x('</p>')</script>", "<svg class=i />", "<div class='share'><a href=1>A</a> <a href=2>B</a></div>"])

    menu = lambda: "<ul>" + "".join(f"<li><a href=/{k}>{html.escape(line(1, 2))}</a></li>" for k in range(rng.randint(3, 9))) + "</ul>"
    comments = lambda: "".join(f"<div class=c><b>{line(1, 1)}</b><p>{html.escape(line(3, 40))}</p></div>" for _ in range(rng.randint(1, 5)))
    outer = [
        "<html><head><title>{t}</title></head><body><nav>{menu}</nav><article>{x}</article><div id=comments>{comments}</div><footer>(c) all rights</footer></body></html>",
        "<html><body><header><a href=/>Site</a> since 1999</header><main>{x}</main><aside>{menu}</aside><section class='reader-comments'>{comments}</section></body></html>",
        "<html><body><div id=top-nav>{menu}</div><div class='cookie-consent'><p>We use cookies here</p></div><div class=story>{x}</div><div class='related-links'>{menu}</div><div class=discussion>{comments}</div></body></html>",
        "<html><body><table><tr><td><div class=sidebar>{menu}</div></td><td><div id=c1>{x}</div></td></tr></table><div class=newsletter><p>Sign up</p></div><div class=footer>{menu}</div></body></html>",
        "<html><body><form id=page><div class=masthead><p>Daily paper</p></div><div><div><div class='entry-body'>{x}</div></div></div><div class='popular-widget'>{menu}</div></form></body></html>",
    ]
    for k in range(n):
        title, parts = line(2, 8), [line(25, 80) for _ in range(rng.randint(3, 7))]
        body = f"<h1>{inline(title)}</h1>" + "".join((junk() if j else "") + f"<p>{inline(p)}</p>" for j, p in enumerate(parts))
        yield outer[k % 5].format(t=html.escape(title), x=body, menu=menu(), comments=comments()), " ".join([title, *parts])


def test_equals_articles_of_five_templates(spark):
    made = list(made_pages(250, 6))
    rows = [(i, "u", page) for i, (page, _) in enumerate(made)] + [(i, "u", made[i][0]) for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 270
    for r in got:
        assert r.text == made[r.page_id][1], (r.page_id % 5, made[r.page_id][0])
