import itertools
import random
import time

import numpy as np

from tests.llm.hand_pages import PAGES
from tideline.llm import html_text
from tideline.llm.html_text import MARK, Field, leaf_blocks

FIELD = html_text.default_field()


def text(body):
    return html_text.main_text(f"<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body>{body}</body></html>", FIELD)


def test_article_without_the_rest():
    got = text(
        '<header><div>Site name</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></ul></nav><!-- ad -->'
        '<div class="cookie-notice"><p>We use cookies to improve this page.</p></div><div class="ad">Buy the thing now.</div>'
        "<article><h1>A headline &amp; more</h1><p><b>First\n  words</b> and<br>more.<p>Second, with a <a href=x>link</a>.</p>"
        '<aside class="related"><a href=y>Another story</a></aside><p>Third &lt;one&gt;.</p>'
        '<section class="comments"><h2>Comments</h2><p>I liked this article very much, thank you.</p></section></article>'
        '<form class="newsletter"><label>Email</label><input><button>Go</button></form><footer>&copy; example &middot; All rights.</footer>'
    )
    assert got == "A headline & more\nFirst words and more.\nSecond, with a link.\nThird <one>."


def test_formulas_buttons_and_linked_lists_of_an_article_stay():
    got = text(
        "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></ul></nav><article><h1>Reading list of the year</h1><p>The value <math><mi>x</mi><annotation>x</annotation></math> is positive, as said before.</p>"
        "<p>Press the <button>OK</button> key to go on, then wait.</p><ul><li><a href=1>The first book on the shelf</a></li><li><a href=2>The second one, on rivers</a></li></ul></article><footer>&copy; 2020 All rights reserved.</footer>"
    )
    assert got == "Reading list of the year\nThe value x is positive, as said before.\nPress the OK key to go on, then wait.\nThe first book on the shelf\nThe second one, on rivers"


def test_telling_words_count_by_their_share():
    few, many = html_text.text_features("word " * 200 + "cookies", 0), html_text.text_features("accept our cookies " * 200, 0)
    assert "k=cookies" not in few and "k=cookies" in many and "k=cookies" in html_text.text_features("our cookies", 0)


def test_gradient_of_the_likelihood_by_differences():
    likelihood = html_text.Likelihood(html_text.made_pages(12, seed=3), 2e-3, 2)
    theta = np.random.default_rng(2).normal(size=len(likelihood.names) + 5) * 0.3
    _, grad = likelihood(theta)
    for i in [*range(0, len(theta), 17), *range(len(theta) - 5, len(theta))]:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        slope = (likelihood(theta + step)[0] - likelihood(theta - step)[0]) / 2e-5
        assert abs(slope - grad[i]) < 1e-6 * max(1, abs(slope))


def test_leaf_blocks_of_broken_markup():
    assert [t for _, t, _ in leaf_blocks("a<p>b<p>c</div>d<li>e<li>f<table><tr><td>g<td>h")] == list("abcdefgh")
    assert leaf_blocks("") == [] and [t for _, t, _ in leaf_blocks("<")] == ["<"]
    assert [t for _, t, _ in leaf_blocks("x<script>if (a<b) {'<p>'}</script>y<style>p{}</style><p title='a>b'>z &amp; &eacute;&#33;")] == ["xy", "z & é!"]
    assert leaf_blocks("<p>open <!-- never closed <p>hidden") == [(["a=p", "in=False", "s=", "t=p"], "open", 0)]
    assert set(leaf_blocks("<div class='Ad-slot_1' hidden><p>t")[0][0]) >= {"c=ad", "c=hidden!", "c=slot", "d=ad", "a=div", "t=p"}
    rng = random.Random(1)
    for _ in range(2000):
        leaf_blocks("".join(rng.choice("<>/!-pdiv \"'=ab&;") for _ in range(rng.randint(0, 40))))


def test_text_of_odd_tags_stays():
    texts = lambda page: [t for _, t, _ in leaf_blocks(page)]
    assert texts("<h1>Title here</h1><p data-x=it's>Hello world, this is text.<p>It's the second one.") == ["Title here", "Hello world, this is text.", "It's the second one."]
    assert texts("<p>a <b and c.</p><p>d") == ["a <b and c.", "d"] and texts("a <b and c.") == ["a <b and c."]
    assert texts("1 < 2 <3 x<y<p>z<div") == ["1 < 2 <3 x<y", "z"] and texts("<div <p>q</p>") == ["q"]
    assert texts('<a href="open>text</a> more') == ["text more"] and texts("<a href=a>b</a/ x='>'>c</>d</ 1>e") == ["bcde"]
    assert texts("<!-->a<!--->b<!-- c --!>d<?x?>e<!y>f") == ["abdef"]
    assert texts("&#0000000065;&#" + "9" * 9999 + ";&#xD800;") == ["A��"]
    assert texts("İ<SCRIPT>x</Script >y<textarea>t</textarea><svg>z</p>") == ["İy", "z"]


def test_places_are_scored_by_their_features():
    rng = random.Random(6)
    weights = {f"{k}={v}": rng.random() for k in "acdts" for v in ("p", "div", "li", "section", "ad", "article", "")} | {"in=True": 0.3, "in=False": 0.1}
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "<div class=ad>", "<li>", "</div>", "</li>", "<section>", "</section>", "<article id=ad>", "</article>", "x", "<ul>", "<b>y</b>"]) for _ in range(rng.randint(0, 40)))
        for (features, text, linked), (score, *same) in zip(leaf_blocks(page), leaf_blocks(page, weights), strict=True):
            assert [text, linked] == same and abs(score - sum(weights.get(f, 0) for f in features)) < 1e-9


def test_odd_pages_take_linear_time():
    for part in ["<a ", "<a b ", '<a x="', "<div>x", "<svg>", "<head></head>", "&#99", "</", "<td>x", "<b and c ", "<ul><li>y", "<title>", "a=\"'<"]:
        began = time.process_time()
        html_text.main_text(part * 50_000, FIELD)
        assert time.process_time() - began < 10, part


def test_pages_written_by_hand():
    wrong = n = 0
    for page in PAGES:
        want = [t.startswith("§") for _, t, _ in leaf_blocks(page)]
        texts = [t for _, t, _ in leaf_blocks(page.replace("§", ""))]
        got = FIELD.labels(leaf_blocks(page.replace("§", ""), FIELD.weights))
        assert sum(want) == page.count("§")
        wrong, n = wrong + sum(bool(a) != b for a, b in zip(got, want, strict=True)), n + len(want)
        print([(t, b) for a, b, t in zip(got, want, texts, strict=True) if bool(a) != b])
    print(wrong, n)
    assert wrong / n < 0.06


def test_recall_and_precision_of_text_written_by_hand():
    kept = right = whole = 0
    for page in PAGES:
        blocks = leaf_blocks(page)
        want = [len(t) - 1 if t.startswith("§") else 0 for _, t, _ in blocks]
        got = FIELD.labels(leaf_blocks(page.replace("§", ""), FIELD.weights))
        texts = [len(t.replace("§", "")) for _, t, _ in blocks]
        whole += sum(want)
        right += sum(w for w, g in zip(want, got, strict=True) if g)
        kept += sum(n for n, g in zip(texts, got, strict=True) if g)
    print(f"recall {right / whole:.4f} precision {right / kept:.4f}")
    assert right / whole > 0.99 and right / kept > 0.95


def test_viterbi_matches_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(200):
        blocks = [(0.0, "x" * int(rng.integers(1, 40)), 0) for _ in range(rng.integers(1, 7))]
        field = Field({}, float(rng.normal()), rng.normal(size=(2, 2)).tolist())
        emissions = rng.normal(size=len(blocks)).tolist()
        at = iter(emissions)
        field.emission = lambda *b, at=at: next(at)

        def total(ys):
            s = sum(e for e, y in zip(emissions, ys, strict=True) if y) + (field.start if ys[0] else 0)
            return s + sum(field.moves[a][b] for a, b in itertools.pairwise(ys))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
        assert tuple(field.labels(blocks)) == best


def test_accuracy_on_held_out_pages():
    wrong = n = 0
    for page in html_text.made_pages(300, seed=77):
        blocks = leaf_blocks(page, FIELD.weights)
        want = [MARK in t for _, t, _ in blocks]
        got = FIELD.labels([(p, t.replace(MARK, "").strip() or "x", k) for p, t, k in blocks])
        wrong, n = wrong + sum(bool(a) != b for a, b in zip(got, want, strict=True)), n + len(want)
    assert wrong / n < 0.015


def test_query_columns(spark):
    page = "<body><nav><a href=x>m</a></nav><article><p>Hello there, this is it.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (4, "x", "<article>" + "<p>Many words here.</p>" * 20_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    t = "Hello there, this is it."
    long_text = "\n".join(["Many words here."] * 20_000)
    assert got == sorted([(1, "u", t, len(t)), (1, "u", t, len(t)), (2, None, "", 0), (3, "v", "", 0), (None, "w", t, len(t)), (4, "x", long_text, len(long_text))], key=str)
    assert html_text.extract(pages.where("false")).count() == 0
