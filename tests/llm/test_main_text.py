"""Main text: the parser on markup by hand, features and decoding against brute force, known articles, other layouts."""

from __future__ import annotations

import html
import itertools
import random

import numpy as np
import pytest

from corpusloom.llm import maintext as M


def words(rnd, most=14):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(3, most))) + "."


def made(seed: int):
    """A page with a known article."""
    rnd = random.Random(seed)
    blocks = [words(rnd, 40) for _ in range(rnd.randint(1, 9))]
    title = words(rnd, 6) + " & <x>"
    links = "".join(f'<li><a href="/{k}">{words(rnd, 3)}</a></li>' for k in range(5))
    inner = "".join(f"<p><b>{b}<br>" if k % 3 == 0 else f"<p>{b}</p>" for k, b in enumerate(blocks))
    page = f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav><!-- ad --><div class="ad">{words(rnd)}</div><article><h1>{html.escape(title)}</h1>{inner}</article><footer>&copy; {words(rnd)}</footer></body></html>'
    return page, "\n\n".join([title, *blocks])


@pytest.fixture(scope="module")
def forest(spark):
    return M.train(spark.createDataFrame([(k, made(k)[0]) for k in range(80)], "page_id long, html string"))


@pytest.mark.parametrize(
    "markup,want",
    [
        ("a<p>b<p>c", ["a", "b", "c"]),
        ("<p>a<b>b<br>c</b> \n d</p>e", ["ab c d", "e"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div title='a > b' data-x=\"<p>\">x</div>", ["x"]),
        ("x<script>if (a<b) '</p>'</SCRIPT >y<style>p</style>z", ["xyz"]),
        ("a<!-- <p>x --> b<!---->c<!DOCTYPE x><?php y ?>d", ["a bcd"]),
        ("a<!-- open <p>b", ["a"]),
        ("a<script>b", ["a"]),
        ("a &amp; b &lt;c&gt; &#233;&eacute; &am &nbsp; d", ["a & b <c> éé &am d"]),
        ("1 < 2 and <3 </ p>x", ["1 < 2 and <3 x"]),
        ("a<p class='x", ["a"]),
        ("</p></div>a</b>b", ["ab"]),
        ("<head><title>t</title></head><body>a<button>b</button><select><option>c</select>d</body>", ["ad"]),
        ("<p>a</p><hr>b<img alt='x'>c", ["a", "bc"]),
        ("", []),
    ],
)
def test_parser(markup, want):
    assert [text for _, text, _ in M.parse(markup).blocks] == want


def test_parser_is_linear_and_not_recursive():
    for markup in ("<div>" * 50_000 + "x" + "</div>" * 50_000, "<b>" * 100_000 + "x", "<p <p " * 50_000, "<!--" * 100_000, "</x>" * 100_000, '<a href="' * 50_001, "<script>" * 50_000, "&" * 200_000):
        M.parse(markup)
    forest_input = M.describe([M.parse("<div>" * 3000 + "x")])
    assert M.decode(forest_input, np.full(len(forest_input.page), 0.9))[-1]


def test_features_of_siblings_and_ancestors():
    page = M.parse("<body><nav><p>one two</p></nav><div class='mainContent'><p>three, four.</p><p>a <a href='#'>link</a></p></div></body>")
    x = dict(zip(M.FEATURES, M.describe([page]).x.T, strict=True))
    assert page.tags == ["#page", "body", "nav", "p", "div", "p", "p"]
    assert list(x["nearest"]) == [0, 0, -1, -1, 1, 1, 1] and list(x["nearest_gap"][3:]) == [1, 0, 1, 1] and list(x["depth"]) == [0, 1, 2, 3, 2, 3, 3]
    assert x["link_share"][6] == pytest.approx(4 / 6) and x["link_share"][4] == pytest.approx(4 / 18) and x["share_of_page"][4] == pytest.approx(18 / 25)
    assert list(x["place"][5:]) == [0, 0.5] and list(x["siblings"][5:]) == [2, 2] and x["before_chars"][6] == pytest.approx(np.log1p(12)) and x["after_chars"][6] == 0


def test_decoding_is_the_best_consistent_choice():
    """Against listing every way to keep, drop or split: nothing in a kept or dropped subtree differs from it."""
    rnd = random.Random(3)
    for _ in range(60):
        page = M.Page()
        for k in range(rnd.randint(1, 7)):
            page.parent.append(rnd.randrange(k) if k else -1)
            page.depth.append(page.depth[page.parent[k]] + 1 if k else 0)
            page.tags.append("div"), page.side.append(0), page.main.append(0), page.label.append(-1), page.controls.append(0)
            if rnd.random() < 0.7:
                page.blocks.append((k, "x" * rnd.randint(1, 9), 0))
        nodes = M.describe([page])
        p = np.array([rnd.uniform(0.02, 0.98) for _ in page.tags])
        odds = np.where(nodes.has, np.log(p / (1 - p)).clip(-M.MOST_ODDS, M.MOST_ODDS), 0)

        def value(states, page=page, nodes=nodes, odds=odds):
            total = 0.0
            for k, s in enumerate(states):
                up = states[page.parent[k]] if k else "split"
                if up != "split" and s != up:
                    return None
                total += odds[k] if s == "keep" else 0 if s == "drop" else (max(odds[k], 0) if nodes.own[k] else 0) - M.SPLIT_COST
            return total

        best = max(v for s in itertools.product(("keep", "drop", "split"), repeat=len(p)) if (v := value(s)) is not None)
        kept = M.decode(nodes, p)
        matching = [s for s in itertools.product(("keep", "drop", "split"), repeat=len(p)) if (v := value(s)) is not None and v > best - 1e-9 and all(kept[k] == (t == "keep" or t == "split" and odds[k] > 0) for k, t in enumerate(s))]
        assert matching


def test_known_articles(spark, forest):
    pages = [(k, f"u{k}", *made(k)) for k in range(1000, 1200)]
    got = M.extract(spark.createDataFrame(pages, "page_id long, url string, html string, want string").repartition(3), forest, keep=["url", "want"]).collect()
    assert len(got) == 200 and all(r.text == r.want and r.n_chars == len(r.want) for r in got)


def test_other_layouts(forest):
    """Pages of layouts from the same generator, other sentences: by characters nearly all of the main text, and little else."""
    right = extra = lost = 0
    for seed in range(150):
        rnd = random.Random(seed)
        page = M.parse(M.relaid([words(rnd, 25) for _ in range(30)], 10_000 + seed))
        nodes = M.describe([page])
        kept = M.decode(nodes, forest.score(nodes.x))
        for node, text, _ in page.blocks:
            right += len(text) * bool(kept[node] and page.label[node] == 1)
            extra += len(text) * bool(kept[node] and page.label[node] != 1)
            lost += len(text) * bool(not kept[node] and page.label[node] == 1)
    assert right / (right + extra) > 0.95 and right / (right + lost) > 0.97


def test_pages_by_hand(forest):
    prose = "A sentence of some length, with marks and more words that go on. " * 4
    side = {
        "<div class='cookie-banner'><p>We use cookies to make this better for you.</p></div>": "",
        "<aside><h3>Related</h3><p>Another story that is not this one.</p></aside>": "",
        f"<section id='comments'><h2>Comments</h2><div class='comment'><p>{prose}</p></div></section>": "",
        "<form action='/s'><label>Search</label><input name=q></form>": "",
    }
    for extra in side:
        page = f"<html><body><header><a href='/'>Site</a></header><nav><a href='/a'>A</a> <a href='/b'>B</a></nav><main><h1>Title here</h1><p>{prose}</p><p>{prose}</p></main>{extra}<footer><p>Imprint</p></footer></body></html>"
        assert M.texts([M.parse(page)], forest) == ["\n\n".join(["Title here", prose.strip(), prose.strip()])], extra


def test_edge_cases(spark, forest):
    long = "<article>" + "<p>many words here, and more of them.</p>" * 30_000 + "</article>"
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (3, "<nav>x</nav>", 3, "c"), (4, long, 4, "d"), (4, long, 4, "d"), (None, "plain text only", 5, "e")]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars long, `text` string")
    got = M.extract(df, forest).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == 6 and by_id[1] == by_id[2] == by_id[3] == "" and by_id[4].count("\n\n") == 29_999
    empty = spark.createDataFrame([], "page_id long, html string")
    nothing = M.train(empty)
    assert M.extract(empty, nothing).collect() == [] and len(M.extract(df, nothing).collect()) == 6
    named = spark.createDataFrame([("x.y", made(1)[0])], "`my.id` string, `my.html` string")
    assert M.extract(named, forest, "my.id", "my.html").collect()[0].text == made(1)[1]


def test_training_is_the_same_on_every_run(spark, forest):
    again = M.train(spark.createDataFrame([(k, made(k)[0]) for k in reversed(range(80))], "page_id long, html string").repartition(3))
    assert all(np.array_equal(getattr(forest, f), getattr(again, f)) for f in ("feature", "threshold", "left", "value"))
