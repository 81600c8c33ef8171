import random

import pytest

from nestq.llm import html_extract as he

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">More</a></li></ul></nav>
<div class="ad">Buy this now. Cheap.</div><!-- ad -->
<article><h1>A title &amp; more</h1><p><b>First   line of the
text, which goes on for a while.<br><p>Second one&nbsp;is here, with some words. And it ends.</p><p>Fish &lt; chips, caf&eacute; and so on, until the end of it.</p></article>
<div class="comments"><div class="comment"><p>Bob</p><p>Nice one, I liked it.</p></div></div>
<footer>&copy; site</footer></body></html>"""


@pytest.fixture(scope="module")
def trees():
    return he.fit([])


def text_of(trees, source):
    page = he.Page(source)
    return page.decode(trees.predict(page.features(trees.odds)))


def test_main_text(trees):
    assert text_of(trees, PAGE) == "A title & more First line of the text, which goes on for a while. Second one is here, with some words. And it ends. Fish < chips, café and so on, until the end of it."


@pytest.mark.parametrize("source", ["", "<", "<p", "text only", "<div><p>a", "</p></div>", "<script>x", "<a href='x>y</a>", "<!-- no end", "<" * 3000, "<div>" * 3000 + "x"])
def test_broken_markup_does_not_fail(trees, source):
    assert isinstance(text_of(trees, source), str)


def test_held_out_layouts_without_semantics(trees):
    """Word-level F1 on generated pages whose classes and telling tags are taken away."""
    rnd, right, got, there = random.Random(99), 0, 0, 0
    for _ in range(100):
        source = he.generated_page(rnd)
        page = he.Page(source)
        labels = page.weak_labels()
        want = {w for node, text, _ in page.blocks if labels[node] == 1 for w in text.split()}
        features = page.features()
        features[:, he.SEMANTIC] = 0
        found = set(page.decode(trees.predict(features)).split())
        right, got, there = right + len(want & found), got + len(found), there + len(want)
    f1 = 2 * right / (got + there)
    assert f1 > 0.85, f1


def test_no_descendant_contradicts(trees):
    import numpy as np

    page = he.Page("<div><div><p>kept?</p></div><p>other</p></div>")
    keep = np.array([0.9, 0.01, 0.01, 0.9, 0.01])
    assert page.decode(keep) == ""


def best_by_force(page, keep):
    """The consistent choice with the largest sum, of all choices; ties go to keeping."""
    import itertools

    import numpy as np

    n = len(page.tag)
    direct = [sum(len(t) for node, t, _ in page.blocks if node == k) for k in range(n)]
    p, best = np.clip(keep, 1e-6, 1 - 1e-6), None
    for stay in itertools.product((True, False), repeat=n - 1):
        stay = (True, *stay)
        if any(stay[k] and not stay[page.parent[k]] for k in range(1, n)):
            continue
        total = sum((1 + np.log1p(direct[k])) * np.log(p[k] if stay[k] else 1 - p[k]) for k in range(1, n))
        if best is None or total > best[0] + 1e-9:
            best = (total, stay)
    return " ".join(t for node, t, _ in page.blocks if best[1][node])


def test_decoder_equals_brute_force():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(60):
        source, depth = "", 0
        for i in range(rnd.randrange(1, 9)):
            if depth and rnd.random() < 0.4:
                source, depth = source + "</div>", depth - 1
            source, depth = source + f"<div>t{i} {'w' * rnd.randrange(0, 30)}", depth + 1
        page = he.Page(source)
        keep = np.array([rnd.random() for _ in page.tag])
        assert page.decode(keep) == best_by_force(page, keep)


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>", '<a x="', "<!-- ", "<p <p ", "</", "< ", '<a b="c>" d'])
def test_reading_takes_linear_time(piece):
    import time

    took = []
    for n in (50_000, 400_000):
        began = time.perf_counter()
        he.Page(piece * (n // len(piece)))
        he.Page(piece * (n // len(piece)) + ">")
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1


def test_deep_nesting_and_long_text(trees):
    deep = "<div>" * 2000 + "inner words" + "</div>" * 2000 + "<p>after</p>"
    page = he.Page(deep)
    assert max(page.depth) <= he.MOST_DEPTH and [t for _, t, _ in page.blocks] == ["inner words", "after"]
    long = "<article>" + "".join(f"<p>Sentence number {i}, which is long enough to count as text.</p>" for i in range(30_000)) + "</article>"
    assert text_of(trees, long).count("Sentence number") == 30_000


def test_attribute_tokens_are_learnt():
    """A class name that no list holds decides once labelled pages have shown what it is."""
    rnd = random.Random(5)

    def page(odd):
        return f'<body><div class="content"><p>{"Some words here, and more. " * 9}</p></div><div class="comment"><div class="{odd}"><p>{"Other words there, and more. " * rnd.randrange(4, 9)}</p></div></div></body>'

    trees = he.fit([page("zqx17") for _ in range(40)], generated=20)
    node = he.Page('<div class="zqx"><p>x</p></div>')
    assert all(trees.odds[b] < -1 for b in node.buckets(1)[:1])
    assert node.features(trees.odds)[1, he.LEARNT] < -1


def test_table(spark, trees):
    rows = [(1, "u", PAGE, "x"), (2, "v", None, "y"), (3, "w", "", "z"), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = sorted((r.page_id, r.main_text) for r in he.extract(df, he.fit_table(df)).collect())
    assert got[0] == got[1] and got[0][1].startswith("A title") and got[2:] == [(2, ""), (3, "")]
    assert he.extract(df.limit(0), trees).count() == 0
