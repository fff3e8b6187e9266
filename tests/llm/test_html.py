from pyspark.sql import Row

from lineagram.llm import html as h

PROSE = "It was a long day, and nobody knew where the road would end; still they went on, slowly. "


def test_page_with_everything():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>
    <header><a href=/>Site</a></header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies, you know.</div>
    <article><h1>A  title</h1><p>{PROSE * 4}<p>Short.</p><div class="ad">Buy, buy, buy!</div><ul><li>one &amp; two</li><li>three&nbsp;&lt;four&gt;</li></ul>
    <form>Name: <input name=a></form><aside>See also, perhaps.</aside><p><b>{PROSE * 3}<br>after</p><script>var x = "</p>"; if (a < b) {{}}</script></article>
    <section id="comments"><p>{PROSE}</p></section><footer>&copy; us</footer>"""
    lines = h.main_text(page).split("\n")
    assert lines == ["A title", (PROSE * 4).strip(), "Short.", "one & two", "three <four>", (PROSE * 3).strip() + " after"]


def test_page_without_article():
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div><h2>Head</h2><p>{PROSE * 5}</p><p>Small one.</p><p>{PROSE * 2}</p></div><div>All rights reserved</div></body>"
    assert h.main_text(page).split("\n") == ["Head", (PROSE * 5).strip(), "Small one.", (PROSE * 2).strip()]


def test_odd_pages(spark):
    pages = [None, "", "   ", "plain words, only.", "<", "<p", "<!-- open", "<a b='", "<script>x", "<nav><a>x</a></nav>", "<p>" * 3000 + "deep, deep.", "<div>" * 3000 + "deep, deep.", '<p title="a>b">in &#x41;&bogus; out.</p>', "<b" * 5000]
    got = h.extract(spark.createDataFrame([Row(page_id=i, html=x, text=1.5) for i, x in enumerate(pages)])).orderBy("page_id").collect()
    text = [r.text for r in got]
    assert text[:3] == ["", "", ""] and text[3] == "plain words, only." and text[9] == ""
    assert text[10] == text[11] == "deep, deep."
    assert text[12] == "in A&bogus; out."
    assert h.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_names_that_say_more_than_furniture():
    for name in ("legal-analysis", "social-history", "art-form", "searching", "widget-wrap main"):
        page = f"<body><nav><a href=1>Home</a></nav><article><p>{PROSE * 3}</p><div class='{name}'><p>{PROSE * 2}</p></div></article><footer>(c)</footer>"
        assert h.main_text(page).split("\n") == [(PROSE * 3).strip(), (PROSE * 2).strip()], name
    for name in ("share-buttons", "related-posts", "comments", "cookie-notice", "ad", "newsletter-signup", "sidebar right", "comment-list"):
        page = f"<body><article><p>{PROSE * 3}</p><div class='{name}'><p>{PROSE * 2}</p></div></article>"
        assert h.main_text(page) == (PROSE * 3).strip(), name


def test_deep_pages_are_read_in_linear_time():
    import time

    began = time.time()
    text = h.main_text("<b>" * 20000 + f"<p>{PROSE}</i></p>" * 3000)
    assert text.count("\n") == 2999 and time.time() - began < 5


def test_ratios_equal_a_plain_sum():
    """The ratio of a path, from its definition, picks the same blocks."""
    import math
    import random

    rng = random.Random(4)
    for _ in range(20):
        parts = [(rng.choice(["p", "li", "td"]), " ".join(["word"] * rng.randint(1, 60)) + rng.choice([".", "", ", and; so."])) for _ in range(rng.randint(2, 30))]
        page = h._read("<body><div>" + "".join(f"<{t}>{x}</{t}>" for t, x in parts) + "</div>")
        assert [b[0] for b in page.blocks] == [x for _, x in parts]
        want = {}
        for t, _ in parts:
            mine = [x for u, x in parts if u == t]
            want[t] = sum(map(len, mine)) / len(mine) * math.sqrt(1 + sum(len(h.MARKS.findall(x)) for x in mine) / len(mine))
        ratio = h.ratios(page)
        assert all(math.isclose(ratio[page.paths[at]], want[page.tags[at]]) for _, at, _ in page.blocks)
        assert h.ratios(page).keys() == {page.paths[at] for _, at, _ in page.blocks}


def test_repeated_rows(spark):
    rows = [(1, f"<p>{PROSE}</p>")] * 3 + [(None, f"<p>{PROSE}</p>")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert [r.text for r in got] == [PROSE.strip()] * 4
