import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_topk, html_text, prefix_forest, shared

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in draw.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(120)]  # one common vector
    rows += [(2000, None), (2020, []), (2040, [NAN] * 8), (2060, [INF] + [0.0] * 7), (2080, [None] + [1.0] * 7), (2100, [0.0] * 8), (2120, [1.0, 2.0]), (2140, [1.0, 2.0]), (None, [1.0] * 8), (20, rows[20][1])]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, ids string, n int")


def usable(vectors, zero):
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    rows = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, v) for i, v in rows if zero or v.any()]


def slow(rows, step, k, score):
    out = []
    for q, v in sorted({i: v for i, v in rows if i % step == 0}.items()):
        hits = sorted((-score(v, w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(hits)]
    return out


def result(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("tile,group,block", [(1 << 24, 1 << 28, 8192), (200, 7000, 7)])
def test_exact_topk(vectors, tile, group, block):
    whole = lambda v: np.array([int(x) for x in np.floor(v * 64)], dtype=object)
    want = slow(usable(vectors, True), 20, 20, lambda a, b: int(whole(a).dot(whole(b))))
    assert result(exact_topk.exact_topk(vectors, F.col("id") % 20 == 0, 20, tile_bytes=tile, group_bytes=group, block_rows=block)) == want
    assert exact_topk.exact_topk(vectors.where("vec_id < 0"), F.col("id") % 20 == 0, 20).count() == 0


def test_scores_beyond_double():
    q = np.array([[2.0**40, 3.0]])
    assert exact_topk.scores_of(q, np.array([[2.0**22, 5.0]]))[0, 0] == 2**62 + 15


@pytest.mark.parametrize("target,group,block", [(1.0, 1 << 28, 8192), (1.1, 3000, 50)])
def test_forest_is_exact_when_asked(vectors, target, group, block):
    """With a target that the sample must reach whole, or cannot reach, the sample being all queries here."""
    want = slow(usable(vectors, False), 50, 5, prefix_forest.exact_cosine)
    assert result(prefix_forest.forest_search(vectors, F.col("id") % 50 == 0, 5, target=target, group_bytes=group, block_rows=block)) == want
    assert prefix_forest.forest_search(vectors.where("vec_id < 0"), F.col("id") % 50 == 0, 5).count() == 0


def clustered(spark):
    draw = np.random.default_rng(6)
    middles = draw.standard_normal((60, 32))
    rows = [(i, (middles[i % 60] + 0.4 * draw.standard_normal(32)).tolist()) for i in range(6000)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def directions(spark):
    draw = np.random.default_rng(7)
    return spark.createDataFrame([(i, draw.standard_normal(64).tolist()) for i in range(8000)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("which,most", [("sf0.01", 0.3), ("sf0.1", 0.1), ("directions", 0.1), ("clustered", 0.1)])
def test_forest_recall_and_candidates(spark, which, most):
    """Recall at 5 against brute force, and the share of rows that a query ranks."""
    made = {"clustered": clustered, "directions": directions}
    table = made[which](spark) if which in made else spark.read.parquet(f"/root/testdata/{which}/embeddings.parquet")
    got = result(prefix_forest.forest_search(table, F.col("id") % 50 == 0, 5))
    rows = table.toPandas()
    mat = np.stack(rows["embedding"]).astype(float)
    v, ids, hits, total = prefix_forest.unit(mat), rows["vec_id"].to_numpy(), 0, 0
    asked = np.flatnonzero(ids % 50 == 0)
    for at in asked:
        s = v @ v[at]
        s[at] = -9
        best = set(ids[np.argsort(-s)[:5]])
        hits, total = hits + len(best & {i for a, _, i, _ in got if a == ids[at]}), total + len(best)
    assert hits / total >= 0.9
    frame = table.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    ranked, best = [0], shared.Best(len(asked), 5, np.float64)
    state = {"asked": v[asked], "strings": prefix_forest.hash_strings(v[asked], prefix_forest.TREES)}
    prefix_forest._search(5, prefix_forest.TREES, prefix_forest.TARGET, prefix_forest.sample_of(frame), ranked)(state, ids[asked], mat[asked], ids, mat, best)
    print(which, "recall", hits / total, "share ranked", ranked[0] / len(asked) / len(ids), "ends", sorted(set(state["end"].tolist())))
    assert ranked[0] / len(asked) / len(ids) <= most


def test_forest_does_not_depend_on_blocks(spark):
    """A row is a candidate of a query or not, whatever rows share its block, group or tile."""
    table = directions(spark).where("vec_id < 3000")
    whole = result(prefix_forest.forest_search(table, F.col("id") % 50 == 0, 5))
    assert whole == result(prefix_forest.forest_search(table.repartition(7), F.col("id") % 50 == 0, 5, tile_bytes=8000, group_bytes=200000, block_rows=100))


def test_all_symbols_count():
    """Longest matches: with the symbols after the first ones dealt to other rows neighbours are met no longer."""
    draw = np.random.default_rng(8)
    rows = prefix_forest.unit(draw.standard_normal((4000, 64)))
    asked = prefix_forest.unit(rows[:60] + 0.09 * draw.standard_normal((60, 64)))
    strings, mine = prefix_forest.hash_strings(rows, 96), prefix_forest.hash_strings(asked, 96)
    end, enough = prefix_forest.ascent((asked * rows[:60]).sum(axis=1) - 0.02, 96, 0.95)
    assert end.min() >= 4

    def met(codes):
        order = np.argsort(codes, axis=1, kind="stable")
        return prefix_forest.meetings(np.take_along_axis(codes, order, 1), order, mine, end)

    slow = np.zeros((60, 4000))
    for t in range(96):
        for q in range(60):
            match = np.array([prefix_forest.SYMBOLS - int(x).bit_length() for x in strings[t] ^ mine[t, q]])
            slow[q] += np.maximum(0, match - end[q] + 1)
        if t == 1:
            break
    assert (prefix_forest.meetings(*(lambda c, o: (np.take_along_axis(c, o, 1), o))(strings[:2], np.argsort(strings[:2], axis=1, kind="stable")), mine[:2], end) == slow).all()
    own = np.arange(60)
    assert (met(strings)[own, own] >= enough).mean() > 0.9
    first = np.uint64(0xF) << np.uint64(prefix_forest.SYMBOLS - 4)
    others = strings[:, draw.permutation(4000)]
    assert (met(strings & first | others & ~first)[own, own] >= enough).mean() < 0.1


def test_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_html(table).collect()}
    for r in table.collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?h1>|</?p>", inside.replace("<br>", " "))]
        want = "\n".join(p for p in parts if p)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (3, "u", "plain"), (None, "u", "<p>a<p>b"), (5, "u", "<div>" * 20000 + "deep"), (6, "u", "<p>" + "long " * 50000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in html_text.extract_html(table).collect())
    assert got == [(0, "a\nb", 3), (1, "", 0), (2, "", 0), (3, "plain", 5), (3, "plain", 5), (5, "deep", 4), (6, "long long", 249999)]
    assert html_text.extract_html(table.where("page_id = 99")).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        ("<nav><ul><li>Home</ul></nav><article><h1>T&amp;t</h1><p>One <i>t</i>wo.<p>Three</article><footer>f</footer>", "T&t\nOne two.\nThree"),
        ("<main><header>h</header><p>Body text here</p><aside>s</aside><form>q<input></form><div class='comments'><p>me too</p></div></main>", "Body text here"),
        ("<div id=menu><a>x</a></div><div class=post><p>Hello, this is the long text of it.</p><p>More</p></div><div class='cookie-notice'>ok</div>", "Hello, this is the long text of it.\nMore"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><p>a<!-- no --> b</p>", "a b"),
        ("<table><tr><td>one<td>two</table>", "one\ntwo"),
        ("<div hidden>secret words here</div><p>Shown words are here.</p>", "Shown words are here."),
        ("<p>a<br>b</p>", "a b"),
        ("<div class=social-sciences><p>A study of towns and people.</p></div><div class=ad-hoc><p>An ad hoc remark on it.</p></div><div class=ad-box>buy</div>", "A study of towns and people.\nAn ad hoc remark on it."),
        ("<div class=title><h1>T</h1></div><div class=content><p>The first paragraph of the text.</p><p>The second one of it, longer.</p></div>", "T\nThe first paragraph of the text.\nThe second one of it, longer."),
        ("<article><p>One story told in full.</p></article><article><p>Another story told in full.</p></article>", "One story told in full.\nAnother story told in full."),
        # unmarked menus and small print: only their ratios tell them from the text
        ("<div><a href=1>Home</a> <a href=2>News</a> <a href=3>Shop</a></div><div><p>A long paragraph that says what the page is about, at some length.</p><p>Another long paragraph that goes on about it, at some length.</p><p>So.</p></div><div><a href=4>x</a> <a href=5>y</a></div>", "A long paragraph that says what the page is about, at some length.\nAnother long paragraph that goes on about it, at some length.\nSo."),
    ],
)
def test_layouts(page, want):
    assert html_text.main_text(page) == want


def test_clusters_decide(spark, monkeypatch):
    """Without the content cluster, or with one dealt at random, pages lose their text or gain what is none."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    want, found, draw = [html_text.main_text(x) for x in pages], html_text.content_cluster, np.random.default_rng(1)
    for broken in (lambda x: np.zeros(len(x), bool), lambda x: draw.random(len(x)) < 0.5, lambda x: draw.permutation(found(x)), lambda x: ~found(x)):
        monkeypatch.setattr(html_text, "content_cluster", broken)
        assert sum(html_text.main_text(x) != w for x, w in zip(pages, want)) > 0.9 * len(pages)
