import pytest

from provenant.llm import html

ARTICLE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style>
<script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>1</p> -->
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>Bold  text<br><p>Second
 &eacute;&nbsp;para.</p>Loose <i>in</i>line<div>Own block</div></article><footer>&copy; x</footer></body></html>"""


def test_article():
    assert html.main_text(ARTICLE) == "Head & line\nBold text\nSecond é para.\nLoose inline\nOwn block"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain < text & more", "plain < text & more"),
        ("<p>a<p>b", "a\nb"),
        ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
        ("<div id='cookie-notice'>x</div><p>y</p>", "y"),
        ("<div><p>y</p><section class='reader-comments'><p>z</p></section></div>", "y"),
        ("<main><h1>t</h1><aside>s</aside><p>y</p></main><p>out</p>", "t\ny"),
        ("<header><h1>Site</h1></header><p>y</p>", "y"),
        ("<article><header><h1>Title</h1></header><p>y</p></article>", "Title\ny"),
        ("<p>a</p></div></b><p>c", "a\nc"),
        ("<p>a<!-- open", "a"),
        ("<p>a</p><script>if (1<2) '</p>'", "a"),
        ("<p title='1 > 2'>a</p>", "a"),
        ("<form><p>f</p></form><p hidden>h</p><p>a &lt;b&gt; &#65;</p>", "a <b> A"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_long_and_hostile_pages_end():
    assert html.main_text("<p>" * 20_000 + "x") == "x"
    assert html.main_text("<div>" * 5_000 + "x") == "x"
    assert html.main_text("<a href=\"" * 2_000) != ""
    assert len(html.main_text("word " * 200_000)) == 999_999


def test_style_tree_removes_what_repeats(spark):
    """Unmarked boilerplate goes by entropy alone; a host of few pages keeps it."""
    page = "<body><div class='top'><p>Welcome to our site</p></div><div class='text'><p>Story {0} begins</p><p>and ends {0}</p></div><div class='end'><span>Call us</span></div></body>"
    rows = [(i, f"http://www.a.com/{i}", page.format(i), 1) for i in range(30)]
    rows += [(100, "https://A.com:80/x", page.format(100), 1), (200, "http://b.com/", page.format(200), 1), (None, None, None, 1)]
    got = {r.page_id: r for r in html.op8_html(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert len(got) == len(rows)
    for i in [*range(30), 100]:
        assert got[i].text == f"Story {i} begins\nand ends {i}"
    assert got[200].text == "Welcome to our site\nStory 200 begins\nand ends 200\nCall us"
    assert got[None].text == "" and got[None].n_chars == 0


def test_copies_of_one_article_stay(spark):
    page = "<body><article><p>Same story</p></article></body>"
    rows = [(i, "http://a.com/", page) for i in range(10)]
    assert all(r.text == "Same story" for r in html.op8_html(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert html.op8_html(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_table_matches_its_template(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = {r.page_id: r.text for r in html.op8_html(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert text[r.page_id].split("\n") == [x for x in want if x]


def test_neutral_mark_up_and_a_plain_tree(spark):
    """With tags and classes that say nothing, what repeats goes by the tree, which equals a plain computation; without the tree it stays."""
    import math
    import random

    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    fixed = [prose(6) for _ in range(4)]
    pages, articles = [], []
    for i in range(40):
        article = [prose(30), prose(25)]
        articles.append("\n".join(article))
        pages.append(f"<body><div class=a><span>{fixed[0]}</span><a href='/x'>{fixed[1]}</a></div><div class=b><p>{article[0]}</p><p>{article[1]}</p></div><div class=c>{rng.choice(fixed[2:])}<img src=/logo.png></div></body>")
    df = spark.createDataFrame([(i, f"http://h.com/{i}", p, "h.com") for i, p in enumerate(pages)], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html.op8_html(df).collect()}
    assert [got[i] for i in range(40)] == articles
    assert all(html.main_text(p) != a for p, a in zip(pages, articles))

    features, looks, paths = {}, {}, {}
    for p in pages:
        page = html.parse(p)
        for node, kind, feature in html.page_features(page):
            table = features if kind == html.TEXT else looks
            table.setdefault(node, {}).setdefault(feature, 0)
            table[node][feature] += 1
            paths[node] = page.path(node)
    low = set()
    for node in {k for path in paths.values() for k in path}:
        below = [n for leaf, counts in features.items() if node in paths[leaf] for n in counts.values()]
        if not below:
            continue
        content = 1 - sum(math.log(n) / math.log(40) for n in below) / len(below)
        own = list(looks.get(node, {}).values())
        spread = -sum(n / sum(own) * math.log(n / sum(own), 40) for n in own) if own else 0
        weight = html.GAMMA ** len(own)
        if (1 - weight) * spread + weight * content < 0.3:
            low.add(node)
    assert low and set(html.low_importance(df).collect()[0].low) == low


def test_counts_of_many_pages_are_split(spark):
    df = spark.createDataFrame([(f"<p>same</p><p>x{i % 5}</p>", "h") for i in range(70_000)], "html string, host string")
    row = html.feature_sums(html.style_rows(df)).where(f"kind = {html.TEXT}").collect()
    assert len(row) == 1 and row[0].total == 140_000 and row[0].features == 6


def test_unclosed_raw_tags_formulas_and_class_names():
    assert html.main_text("<main><p>a</p><video>fallback<p>rest</p></main>") == "a\nfallback\nrest"
    assert html.main_text("<p>let <math><mi>x</mi></math> be</p>") == "let x be"
    assert html.main_text("<div class='related-work'><p>a</p></div><div class='related-posts'><p>b</p></div>") == "a"
    deep = "<div>x" * 20_000
    assert html.main_text(deep).count("x") == 20_000
