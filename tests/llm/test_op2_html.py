import html as markup
import itertools
import math
import random
import time

import numpy as np
import pytest

from quarry.llm import op2_html as op

SENTENCES = [f"The {a} of the {b} went over the {c} river." for a in ("old", "new", "lost") for b in ("stones", "hills")
             for c in ("cold", "wide", "dry", "long")]


def extractor():
    return op.train(SENTENCES, pages=150)


EX = extractor()


def test_article_without_its_surroundings():
    body = "".join(f"<p>{s} {s} {s}</p>" for s in SENTENCES[:6])
    page = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x='</p>';</script></head><body>"
            "<header class='site-header'><h2>Site</h2></header><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
            "<div class='cookie-notice'>We use cookies of all sorts.</div>"
            f"<article><h1>A headline of words</h1>{body}<div class='ad'>Buy now.</div></article>"
            "<section id='comments'><h3>Comments</h3><div class='comment'><p>Nice text.</p></div></section>"
            "<aside class='sidebar'><ul><li><a href='/x'>Related</a></li></ul></aside>"
            "<form><label>Mail</label><input><button>Send</button></form><footer>&copy; someone</footer></body></html>")
    want = ["A headline of words"] + [f"{s} {s} {s}" for s in SENTENCES[:6]]
    assert EX.texts([page]) == ["\n".join(want)]


def test_white_space_references_and_open_markup():
    page = ("<body><article><h1>Head&amp;line &lt;one&gt;</h1><p><b>First\n  part &eacute;t&#233;, " + SENTENCES[0] + "<br>and more"
            "<p>Second <i>in</i>line " + SENTENCES[1] + "</article><footer>end</footer>")
    text = EX.texts([page])[0]
    assert text.split("\n") == ["Head&line <one>", "First part été, " + SENTENCES[0] + " and more", "Second inline " + SENTENCES[1]]


def test_odd_pages():
    pages = [None, "", "   ", "<", "<p", "<!-- never closed", "</div></p>", "<script>", "<a href=\"x>" * 50, "&", "no markup at all"]
    out = EX.texts(pages)
    assert len(out) == len(pages) and out[0] == out[1] == out[2] == ""


def test_very_long_page():
    page = "<body><article>" + "".join(f"<p>{s}</p>" for s in SENTENCES * 500) + "</article>"
    assert EX.texts([page])[0].count("\n") == 500 * len(SENTENCES) - 1


def seconds(make, n):
    page = make(n)
    start = time.perf_counter()
    EX.texts([page])
    return time.perf_counter() - start


@pytest.mark.parametrize("make", [
    lambda n: "<body>" + "<div>" * n + SENTENCES[0] + "</div>" * n,
    lambda n: "<body>" + "".join(f"<x{i}>w" for i in range(n)),
    lambda n: "<body><p>" + "<x>" * n + "</p>" * n,
    lambda n: "<ul><li>" + "<x>" * n + "<li>" * n,
    lambda n: "<body>" + "<div>" * n + "</section></li></td>" * n,
    lambda n: "<body>" + "<div>" * n + "<svg></y></div>" * n,
    lambda n: "<body>" + "<x>" * n + "<button></y>" * n])
def test_time_is_linear_in_odd_markup(make):
    """Four times the markup takes at most eight times as long (sixteen, if quadratic)."""
    small = min(seconds(make, 3000) for _ in range(3))
    assert seconds(make, 12_000) < 8 * small + 0.5


def test_decoding_is_the_best_of_all_choices():
    """All choices of small trees in which no kept block stands in a dropped one."""
    r = random.Random(6)
    for _ in range(150):
        blocks = [op.Block(None, "", (), 0, 0)]
        for i in range(r.randrange(1, 9)):
            parent = r.choice(blocks)
            b = op.Block(parent, r.choice(["div", "p", "section"]), (), parent.depth + 1, i)
            b.chars = r.randrange(1, 50)
            parent.children.append(b)
            blocks.append(b)
        for b in blocks:
            b.all_chars = b.chars
        for b in reversed(blocks):
            if b.parent:
                b.parent.all_chars += b.all_chars
        odds = np.array([r.uniform(-3, 3) for _ in blocks])

        def worth(kept):
            return sum(odds[i] * (b.chars + op.CONTAINER_WEIGHT * (b.all_chars - b.chars)) for i, b in enumerate(blocks) if i and kept[i])

        place = {id(b): i for i, b in enumerate(blocks)}
        allowed = [(True, *c) for c in itertools.product([False, True], repeat=len(blocks) - 1)]
        allowed = [c for c in allowed if all(c[place[id(b.parent)]] for b, k in zip(blocks[1:], c[1:]) if k)]
        got = tuple(op.decode(blocks, odds))
        assert got in allowed and math.isclose(worth(got), max(map(worth, allowed)), abs_tol=1e-9)


def test_no_kept_block_stands_in_a_dropped_one():
    maker = op.Maker(SENTENCES, 5)
    for _ in range(40):
        blocks, _ = op.made_page(maker)
        kept = op.decode(blocks, np.random.default_rng(1).normal(size=len(blocks)))
        at = {id(b): k for b, k in zip(blocks, kept)}
        assert all(at[id(b.parent)] for b, k in zip(blocks, kept) if k and b.parent is not None)


def test_made_pages_that_were_not_trained_on():
    maker, right, found, there = op.Maker(SENTENCES, 77), 0, 0, 0
    for _ in range(100):
        blocks, labels = op.made_page(maker)
        for b, y, k in zip(blocks, labels, op.decode(blocks, EX.trees.log_odds(op.features(blocks, EX.evidence)))):
            if b.tag not in ("", "html", "body"):
                right, found, there = right + b.chars * (y and k), found + b.chars * k, there + b.chars * y
    assert right / found > 0.95 and right / there > 0.95


def test_query_against_the_marked_article(spark, none):
    """Every page of the small table: the text of its article element, cut at its blocks."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r for r in op.op2_main_text(spark, "/root/testdata/sf0.001").collect()}
    same = 0
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(markup.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        same += got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url
    assert same >= 0.98 * len(pages)
    assert op.op2_main_text(spark, none).count() == 0


def test_null_columns_and_repeated_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x"), (2, "u", "")]
    out = op.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), EX).collect()
    assert len(out) == 4 and all(r.text is not None and r.n_chars == len(r.text) for r in out)


def read(page):
    """All text that the parser takes from a page, in page order."""
    return " ".join(t for _, t in sorted(run for b in op.parse(page) for run in b.parts))


def test_self_closed_and_open_svg_and_object_lose_no_text():
    article = "<article><h1>Head</h1><p>First.</p><p>Second.</p></article>"
    want = "Head First. Second."
    heads = ["<svg class='icon'/>", "<svg/>", "<svg class=icon />", "<svg hidden/>", "<svg data-x='a=b'/>",
             "<svg class='icon'><path d='M0'/><title>t</title></svg>", "<svg><svg><g></svg>lost</svg>", "<svg><svg/>lost</svg>",
             "<svg class='icon'><path d='M0'>", "<svg class=icon/>", "<svg><style>a > b {}</style>", "<svg><foreignObject><p>in</p><br></foreignObject></svg>",
             "<object data='x'>", "<object data='x'/>", "<object data='x'><param name='a'>", "<object data='x'></object>"]
    for head in heads:
        for later in ("", "<footer><svg><path></svg></footer>", "<footer><object></object></footer>"):
            page = f"<body><header>{head}</header>{article}{later}</body>"
            assert read(page) == want, page
    assert read(f"<body><a href='/'><svg class='icon'></a>{article}") == want
    assert read("<p>a <svg class='icon'/> b <svg/> c</p>") == "a b c"
    assert read("<div>a<object data='x'>b</object>c</div>") == "a b c"
    assert read("<div><svg class='icon'><g><p>a</p></div>b") == "a b"


def test_open_buttons_and_selects_lose_no_text():
    article = "<article><h1>Head</h1><p>First.</p></article>"
    for name in ("button", "select"):
        for later in ("", f"<footer><{name}>x</{name}></footer>"):
            assert read(f"<body><header><{name}></header>{article}{later}</body>") == "Head First."
            assert read(f"<body><{name}>{article}{later}</body>") == "Head First."
        assert read(f"<div><{name}><div>x</div><br></{name}>a</div>") == "a"
    assert read("<button><select>" * 20_000 + "a") == "a"


def test_raw_text_without_an_end_runs_to_the_end_of_the_page():
    for name in ("script", "style", "textarea", "title", "iframe", "noscript"):
        assert read(f"<p>a</p><{name}><p>b</p>") == "a"
        assert read(f"<p>a</p><{name}/><p>b</p></{name}>c") == "a c"


def test_articles_behind_self_closed_and_open_elements():
    body = "".join(f"<p>{s} {s} {s}</p>" for s in SENTENCES[:6])
    want = "\n".join(["A headline of words"] + [f"{s} {s} {s}" for s in SENTENCES[:6]])
    for head in ("<svg class='icon'/>", "<svg class='icon'><path d='M0'>", "<object data='x'>"):
        page = (f"<html><body><header class='site-header'>{head}<h2>Site</h2></header><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
                f"<article><h1>A headline of words</h1>{body}</article><footer>&copy; someone</footer></body></html>")
        assert EX.texts([page]) == [want], head


def test_many_open_svgs_stay_linear():
    assert read("<svg><g>" * 20_000 + "<p>a") == "a"
    assert read("<div><svg></div>" * 20_000 + "a") == "a"
