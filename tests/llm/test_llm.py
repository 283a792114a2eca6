"""The operators of the llm subpackage against brute force, with nulls, empty and long texts, ties and repeats."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_topk as T2, html_content as H4, jaccard_join as J8, language_id as L3, learned_ann as A1, mixing as X10, records as R6, sentencepiece_codec as S5, suffix_dedup as D7, url_filter as U9
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.packed import multikey_order
from ledgerloom.llm.queries import URL_RULES, vocabulary

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "r", "st", "x", "é")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def sets_of(rows, k=4):
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UP))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] * bool(w))
    return out


def brute_components(sets, t):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("edits", [4, 8])
def test_jaccard_against_brute_force(spark, edits):
    rng = random.Random(edits)
    passage = text(rng, 40)
    rows, base = [], text(rng, 90).split()
    for i in range(60):  # near copies of one text, some close, some not
        w = base[:]
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(9))
        rows.append((i, " ".join(w)))
    rows += [(100 + i, text(rng, rng.randrange(3, 60)) + " " + passage) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \t "), (203, "Two words"), (204, "two WORDS"), (205, "two words"), (300, passage), (301, passage + " x"), (302, "a"), (303, text(rng, 30000)), (304, None)]
    rows.append((305, rows[-2][1]))
    got = {r.doc_id: r for r in J8.similar_components(frame(spark, rows), words=4, percent=85).collect()}
    sets = sets_of(rows)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets, 85)


def test_jaccard_bounds_of_the_last_round(spark):
    def pairs(both, beside, own, pivots=(9, 9)):
        columns = ([7, 7], [1, 2], [100, 100], [1, 1], [0, 0], [1, 2], pivots, both, beside, own)
        rows = [np.array(x, kind) for x, kind in zip(columns, J8.ROW, strict=True)]
        return [tuple(map(int, x)) for x in zip(*J8.list_pairs(rows, 85, True)[0][:2], strict=True)]

    # Sets of 100 link if they have 92 in common.
    assert pairs((92, 92), (0, 0), (8, 8)) == [(1, 2)] and pairs((92, 100), (0, 0), (8, 0)) == [(1, 2)]
    assert pairs((91, 100), (0, 0), (9, 0)) == []
    # By the pivot that both were compared with: 90 of it in either, and no more than 2 beside it.
    assert pairs((90, 98), (10, 2), (0, 0)) == [(1, 2)] and pairs((90, 98), (10, 1), (0, 1)) == []
    assert pairs((90, 98), (10, 1), (0, 1), pivots=(8, 9)) == [(1, 2)]
    # Only stuck nodes are pivots, so that no token that a node has alone is its pivot's.
    seen = spark.createDataFrame([(0, 1, 108, 100, 96, False), (0, 2, 108, 100, 88, False), (3, 4, 50, 50, 40, False)], "a long, b long, na long, nb long, both long, linked boolean")
    got = {r.node: (r.pivot, r.both) for r in J8.pivots(seen, spark.createDataFrame([(1,), (2,), (3,)], "node long")).collect()}
    assert got == {0: (2, 88), 4: (3, 40)}


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D E"), (2, "q r s t u v")]
    got = J8.similar_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1)]
    assert J8.similar_components(frame(spark, [])).collect() == []


def test_components(spark):
    links = [(i + 1, i) for i in range(30)] + [(100, 40), (41, 100), (41, 42)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40, 42: 40, 100: 40}


def brute_repeats(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            if s in seen:
                cut[p : p + n] = b"\1" * n
            seen.add(s)
        out[i] = (len(b), sum(cut), sum(1 for j in range(len(b)) if cut[j] and (j == 0 or not cut[j - 1])), bytes(c for c, f in zip(b, cut, strict=True) if not f))
    return out


@pytest.mark.parametrize("length", [100, 20])
def test_suffix_dedup_against_brute_force(spark, length):
    rng = random.Random(length)
    passages = [text(rng, rng.randrange(5, 40)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [text(rng, rng.randrange(0, 30)) for _ in range(3)] + rng.sample(passages, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(90, None), (91, ""), (92, "z" * 700), (93, "éé" * 200), (94, rows[3][1]), (95, "ab" * 99 + rows[4][1]), (96, text(rng, 20000)), (97, "short")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in D7.remove_repeats(frame(spark, rows), length).collect()}
    assert got == brute_repeats(rows, length)


def test_suffix_dedup_odd_rows(spark):
    t = text(random.Random(1), 60)
    got = D7.remove_repeats(frame(spark, [(1, t), (1, t), (None, t), (2, t)]).withColumn("kept", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, len(t.encode())), (1, len(t.encode())), (2, len(t.encode()))]
    assert D7.remove_repeats(frame(spark, [])).collect() == []
    cut = D7.remove_repeats(frame(spark, [(1, "ä" * 60), (2, "x" + "ä" * 60 + "y")])).orderBy("doc_id").collect()
    assert "�" not in cut[1].whole and cut[1].whole.startswith("x") and cut[1].whole.endswith("y")


def test_multikey_order():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 5, 500) for _ in range(3)]
    assert (np.stack(keys, 1)[multikey_order(keys)] == np.stack(keys, 1)[np.lexsort(keys[::-1])]).all()


def test_exact_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (400, 8))
    v[50:60] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1, 2]), (3, v[3].tolist())]
    docs = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T2.exact_topk(docs, docs.filter("vec_id % 50 = 0"), 5).collect())
    want = []
    for q in range(0, 400, 50):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert got == want
    assert T2.exact_topk(docs.limit(0), docs, 5).collect() == []


def test_block_bounds_skip_blocks():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (20, 16))
    mat = np.repeat(centres, 64, axis=0) + rng.integers(-3, 3, (1280, 16))
    *_, scored = T2.search_chunk(centres, np.arange(1280), mat, 5)
    assert scored < 20 * 20 / 2


def test_search_of_topk_ends_before_its_answers_are_joined(spark):
    """No join waits for the search, and a batch that a worker gets holds a few chunks at most; blocks that are scored
    together give what a plain product gives, ties included."""
    docs = spark.range(300).selectExpr("id as vec_id", "array(id % 7, id % 11, 1L) as vector")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    try:
        out = T2.exact_topk(docs, docs.filter("vec_id % 50 = 0"), 5)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert out.count() == 30
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    v = np.random.default_rng(5).integers(-100, 100, (1000, 4))
    for large in (1, 10**5, 10**10):
        q, i, s, _ = T2.search_chunk(v[:40] * large, np.arange(1000), v, 6)
        want = v[:40] * large @ v.T
        a, b = np.nonzero(want >= np.sort(want, axis=1)[:, -6:-5])
        assert sorted(zip(q.tolist(), i.tolist(), s.tolist())) == list(zip(a.tolist(), b.tolist(), want[a, b].tolist()))


def test_ann_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    v = np.repeat(centres, 150, axis=0) + 0.3 * rng.standard_normal((4500, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, []), (9004, [1.0, 2.0]), (9020, [3.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {}
    for r in A1.ann_search(docs, docs.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for q in range(0, 4500, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({i for i, _ in got[q].values()} & set(np.argsort(-s)[:20].tolist()))
        assert len(got[q]) == 20 and all(score == pytest.approx(v[i] @ v[q], rel=1e-12) for i, score in got[q].values())
    assert hit / (225 * 20) >= 0.9 and got[9020] == {1: (9004, 5.0)}
    assert A1.ann_search(docs.limit(0), docs, 20).collect() == []


def test_learned_ann_rows_do_not_grow_with_the_parts(spark, monkeypatch):
    """Each query's best are kept while a task searches: no rows for each query and part."""
    monkeypatch.setattr(A1, "PART_ROWS", 16)
    v = np.random.default_rng(2).standard_normal((1200, 12))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vector array<double>")
    made, answers = [], A1.answers
    monkeypatch.setattr(A1, "answers", lambda hits, *a: (made.append(hits.count()), answers(hits, *a))[1])
    monkeypatch.setattr(A1, "TARGET", 1.0)
    got = {(r.query_id, r.rank): r.vec_id for r in A1.ann_search(docs, docs.filter("vec_id % 20 = 0"), 5).collect()}
    right = sum(got[q, r + 1] == i for q in range(0, 1200, 20) for r, i in enumerate([i for i in np.argsort(-(v @ v[q]), kind="stable") if i != q][:5]))
    assert len(got) == 60 * 5 and right >= 0.9 * len(got)
    assert made[0] <= 60 * 16 * 6


def test_nearest_settles_as_it_goes():
    """Ties go to the smaller id, whatever comes together; parts that a query doesn't want are passed by."""
    rng = np.random.default_rng(4)
    q, v = rng.integers(-3, 4, (7, 5)).astype(float), rng.integers(-3, 4, (900, 5)).astype(float)
    near = A1.Nearest(np.arange(7), q, np.array([[False, True, i != 3] for i in range(7)]), 4)
    near.most = 40
    part = np.arange(900) // 450
    for at in range(0, 900, 30):
        near.meet(int(part[at]), np.arange(900)[at : at + 30], v[at : at + 30])
    got = [(r["rep"], r["vec_id"], r["score"]) for b in near.best() for r in b.to_pylist()]
    want = [(i, j, float(q[i] @ v[j])) for i in range(7) for j in sorted((j for j in range(900) if i != 3 or part[j] == 0), key=lambda j: (-(q[i] @ v[j]), j))[:4]]
    assert got == want


def test_balanced_parts_are_balanced():
    x = np.random.default_rng(5).standard_normal((512, 8))
    part = A1.balanced_parts(A1.neighbour_graph(x, 8), 8, np.random.default_rng(0))
    assert np.bincount(part).tolist() == [64] * 8


def test_language_id(spark):
    rng = random.Random(6)
    alphabets = {"aa": ["ba", "bo", "bu", "lim"], "bb": ["kri", "skt", "vor", "zem"], "cc": ["öl", "üm", "äh", "eß"]}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(3)) for _ in range(rng.randrange(1, 40))), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 150)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = L3.fit(docs.filter(~L3.held_out(F.col("doc_id"))))
    odd = frame(spark, [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", None), (1003, "BABABO " * 50000, "bb"), (1004, "xqzw jjxq wwzz qjqj " * 5, None)], docs.schema)
    got = {r.doc_id: r for r in L3.identify(docs.unionByName(odd).withColumn("score", F.lit("clash")), model).collect()}
    held = [got[i] for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values()) and got[1004].rejected
    unlearned = frame(spark, [(1, "Это русский текст о погоде и политике " * 3, None)], docs.schema)
    assert L3.identify(unlearned, model).first().rejected
    assert np.mean([got[i].rejected for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]) < 0.02
    few = L3.fit(docs.limit(12))
    assert few.threshold == 1 / (len(few.langs) + 1)
    assert L3.identify(docs, L3.fit(docs.limit(0))).first().lang_pred == "und"


PAGE = """<html><head><title>T &amp; U</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav>
<div class="cookie-notice"><p>We use cookies, many of them.</p></div><article><header><h1>The  title</h1></header><p>First <b>bold</b> para&shy;graph with enough words to count &lt;here&gt;.<p>Second one,
over two lines.<aside><p>Read also: something else.</p></aside><ul><li>An item of the list</li></ul></article><div id="comments"><p>anna: great article, thanks for it</p></div><footer>&copy; all</footer>"""


def test_html_content(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>unclosed <b>text &amp"), (5, "<nav><a>x</a></nav>"), (6, "<article><p>" + "long word " * 50000 + "</p></article>"), (1, PAGE)]
    got = H4.extract_content(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and by[2] == by[3] == by[5] == "" and by[4] == "unclosed text &"
    lines = by[1].split("\n")
    assert lines[-3:] == ["First bold para­graph with enough words to count <here>.", "Second one, over two lines.", "An item of the list"]
    assert not any(w in by[1] for w in ("cookies", "Home", "anna", "Read also", "©", "var"))
    assert all(r.n_chars == len(r.text) for r in got) and len(by[6]) == 499999


def test_html_layout_and_articles_beside():
    story = "<h1>A long story</h1><p>It has words enough to be the text of this page, and then some more.</p>"
    want = "A long story\nIt has words enough to be the text of this page, and then some more."
    remarks = '<div id="comments"><article class="comment-body"><p>anna: great, and a good many words more than one would have thought, said at length in every way</p></article></div>'
    teasers = "<aside><article><h3>Teaser</h3><p>Other things that one may want to read as well, all told.</p></article></aside>"
    for page in (
        f'<body><div class="layout has-sidebar"><div class="story">{story}</div></div></body>',
        f'<body><div class="sidebar-right-layout header-fixed sidebar"><div>{story}</div></div><div>Copyright</div></body>',
        f'<body><form id="aspnetForm"><div>{story}</div></form></body>',
        f"<body><article>{story}</article>{remarks}{teasers}</body>",
        f"<body>{teasers}<div>{story}</div>{remarks}</body>",
        f'<body><div class="with-comments"><div>{story}</div>{remarks}</div></body>',
        f'<body><div class="article-with-tags">{story}</div></body>',
        f'<body><article class="post category-social">{story}</article><article class="related"><p>Also of note</p></article></body>',
        f"<body><nav><ul><li>Never closed<article>{story}</article></body>",
    ):
        assert H4.main_text(page) == want, page


BODY = "".join(f"<p>Sentence {i} of the real article goes on for some words here.</p>" for i in range(6))
LINKS = "<div>" + "".join(f'<a href="/{i}">Some other page number {i}</a> ' for i in range(12)) + "</div>"


@pytest.mark.parametrize("page", [
    f'<body><ul><li class="menu-item">x</ul>{BODY}',
    f'<body><div class="ad">Buy now<div class="story">{BODY}</div></body>',
    f'<body><nav><a href=/>Home</a></nav><div class="related-story-page"><main>{BODY}</main></div><footer>c</footer></body>',
    f"<body>{LINKS}<div>{BODY}</div>{LINKS}</body>",
    f'<body><p class="notice">Old browser{BODY}',
    f'<body><article>{BODY}</article><div id="comments"><article class="comment-body"><p>{"long words " * 300}</p></article></div>',
])
def test_html_malformed_markup_and_unmarked_links(page):
    assert H4.main_text(page) == "\n".join(f"Sentence {i} of the real article goes on for some words here." for i in range(6))


def test_html_the_scan_decides(monkeypatch):
    page = f"<body>{LINKS}<div>{BODY}</div>{LINKS}</body>"
    assert "number" not in H4.main_text(page)
    monkeypatch.setattr(H4, "best_region", lambda found: (0, len(found)))
    assert "number" in H4.main_text(page)


def test_html_time_grows_with_the_page(monkeypatch):
    import time

    for piece in ("<a ", "<", '<script "', "<b>", "<p class=notice>", "<div>", "<!--"):
        t = time.process_time()
        H4.main_text(piece * 50_000)
        assert time.process_time() - t < 5


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, f"<p>{'a b c ' * 9}</p>", 5, "old"), (2, None, 6, "x")], "page_id long, html string, n_chars int, text string")
    got = sorted(H4.extract_content(df).collect())
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, ("a b c " * 9).strip(), 53), (2, "", 0)]


def test_language_id_counts_across_cuts(monkeypatch):
    rng = random.Random(2)
    texts = [text(rng, 400) for _ in range(6)]
    model = L3.train(texts, ["a", "b"] * 3, epochs=1)
    whole, _ = model.logits(texts)
    monkeypatch.setattr(L3, "PIECE", 64)
    cut, _ = model.logits(texts)
    assert np.allclose(whole, cut)


def test_ann_uses_parts_and_answers_in_full(spark):
    """Parts on a small table, answers for all queries, ties by id, repeated rows once, clashing columns left."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 12)) * 3
    x = [(int(i), [float(v) for v in centres[i % 8] + rng.standard_normal(12)]) for i in range(600)]
    x += [(600, x[0][1]), (601, x[0][1]), x[5]]
    df = spark.createDataFrame(x, "vec_id long, vector array<double>").withColumn("part", F.lit(1)).withColumn("salt", F.lit(2))
    index = A1.fit_index(df.select("vec_id", "vector"), 600, 20)
    assert index.parts >= 4
    got = A1.ann_search(df, df.filter("vec_id % 20 = 0"), 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    mats = {i: np.array(v) for i, v in x}
    assert set(found) == {i for i in mats if i % 20 == 0} and all(len(v) == 20 for v in found.values())
    right = 0
    for q, rows in found.items():
        want = sorted(((-float(np.einsum("i,i->", mats[q], v)), i) for i, v in mats.items() if i != q))[:20]
        right += len({i for _, i in want} & {i for _, i, _ in rows})
        assert all(abs(s - float(mats[q] @ mats[i])) < 1e-9 for _, i, s in rows) and [r for r, _, _ in sorted(rows)] == list(range(1, 21))
    assert right >= 0.9 * 20 * len(found)


def test_exact_topk_of_large_components(spark):
    rows = [(i, [10**10 + i, -i, 3]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("n", F.lit(1)).withColumn("slot", F.lit(1))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in T2.exact_topk(df.select("vec_id", F.transform("vector", lambda x: F.when(x > 10**9, x - 9 * 10**9).otherwise(x)).alias("vector"), "n", "slot"), df.limit(0).select("vec_id", "vector").unionByName(spark.createDataFrame([(1, [3 * 10**9, 0, 0])], "vec_id long, vector array<long>")), 3).collect()}
    assert [got[1, r] for r in (1, 2, 3)] == [(i, 3 * 10**9 * (10**9 + i)) for i in (39, 38, 37)]


def test_url_filter(spark):
    urls = {
        1: "https://Example.ORG/es/a?x", 2: "http://m.example.org/en/123#t", 3: "http://example.org/fr/", 4: "http://a.b.com/de/1", 5: "http://x.com/fr/", 6: "http://x.net/fr/", 7: None, 8: "no scheme", 9: "http://org",
        10: "ftp://notexample.org/es/", 11: "http://example.org?q=/es/", 12: "http://a.com/" + "p" * 100000, 13: "http://org/",
    }
    got = {r.page_id: r for r in U9.filter_urls(spark.createDataFrame(list(urls.items()), "page_id int, url string"), URL_RULES).collect()}
    want = {1: "example.org/es/", 2: "example.org/en/1", 3: "org/", 4: "com/de/", 5: "com/fr/", 10: "org/", 13: "org/"}
    assert {i: r.rule for i, r in got.items() if r.rule} == want
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 4}
    assert (got[7].host, got[7].path, got[8].host, got[2].host, got[2].path) == ("", "", "", "m.example.org", "/en/123")
    twice = spark.createDataFrame([(1, urls[1]), (1, urls[1])], "page_id int, url string")
    assert U9.filter_urls(twice, URL_RULES).count() == 2 and U9.filter_urls(twice.limit(0), URL_RULES).count() == 0


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randrange(1, 50)), s) for i, s in enumerate([None, "a", "b", "b", "B", "é"] * 40)] + [(900, None, "a"), (901, "", "zzz"), (902, text(rng, 5000), "b"), (902, "one two", "b")]
    got = X10.mix_sources(frame(spark, rows, "doc_id long, text string, source string"), [3, 1, 2], 1.5, 2.0).collect()
    again = X10.mix_sources(frame(spark, rows[::-1], "doc_id long, text string, source string"), [3, 1, 2], 1.5, 2.0).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), [s for s in order if size[s]]
    left = 1.5 * sum(size.values())
    while open_:  # clamp and share again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    assert X10.mix_sources(frame(spark, [], "doc_id long, text string, source string"), [1], 1.5, 2).collect() == []


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    rows = [(5, "Hello World! It's 2024 — naïve café"), (2, None), (9, ""), (7, "İstanbul Σίσυφος ΣΑΣ 日本語 é"), (None, "no id"), (3, "<|endoftext|> x\ty z"), (3, "a"), (11, text(random.Random(9), 5000))]
    got = R6.token_records(frame(spark, rows), path, 2).collect()
    tok, start = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    folder, written = R6.write_records(frame(spark, rows), lambda: R6.word_encoder(path, 2), 2, f"file://{tmp_path}/out")
    fs, where = R6.filesystem(folder)
    name = max(written, key=lambda r: r.records).file
    index = np.frombuffer(fs.open_input_file(f"{where}/{name}.idx").read(), "<u8").reshape(-1, 2)
    with fs.open_input_file(f"{where}/{name}.rec") as f:
        record = R6.read_record(f, int(index[-1][0]))
    assert (len(record) - 9) // 2 == index[-1][1]
    data = bytearray((tmp_path / "out" / f"{name}.rec").read_bytes())
    data[20] ^= 1
    import io

    with pytest.raises(ValueError):
        R6.read_record(io.BytesIO(bytes(data)))
    assert R6.token_records(frame(spark, []), path, 2).collect() == []


def test_records_encode_as_the_library_does():
    """Every character below U+0530 in several contexts; word_encoder splits texts itself where it may."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    encode, width = R6.word_encoder(path, 2)
    texts = [f.format(chr(c)) for c in range(0x530) for f in ("{0}", "{0}bc", "a{0} 1{0}2", "It{0}s {0}{0} end")]
    got = encode(texts)
    assert [np.frombuffer(x, f"<u{width}").tolist() for x in got] == [e.ids + [2] for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_records_with_a_full_cache_look_a_word_up_once(monkeypatch):
    """Ids don't depend on what is kept; words that were kept are looked up by the dict alone, also when it is full."""
    path = vocabulary("word_bpe_49k.json")
    texts = ["one two three, two!", "four two éa'll five 6\x1c", None, "six one ‰", "naïve " * 3]
    monkeypatch.setattr(R6, "_kept", {})
    want = R6.word_encoder(path, 2)[0](texts)
    looked = []

    class Kept(dict):
        def get(self, word):
            looked.append(word)
            return super().get(word)

        __getitem__ = None

    kept = Kept()
    monkeypatch.setattr(R6, "WORDS_KEPT", 3)
    monkeypatch.setattr(R6, "_kept", {(path, "<u2"): kept})
    encode, _ = R6.word_encoder(path, 2)
    assert encode(texts[:1]) + encode(texts[1:]) == want and len(kept) == 3
    assert encode(texts) == want and len(kept) == 3
    assert len(looked) == 2 * (6 + 7 + 3)


def test_byte_letters_are_the_library_s():
    from tokenizers import pre_tokenizers

    level, letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), R6.byte_letters()
    chars = [chr(c) for c in range(R6.PLAIN_END) if c != 32]
    assert [c.translate(letters) for c in chars] == [level.pre_tokenize_str(c)[0][0] for c in chars]


def test_sentencepiece_ids_are_the_rebuilt_tokenizers(monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    texts = ["Hello world, again and again.\nA new line", "naïve café 日本語"]
    right, parity = S5.Codec(path).encode(texts)
    assert all(parity)
    merges = S5.merges
    monkeypatch.setattr(S5, "merges", lambda m: merges(m)[:500])
    wrong, parity = S5.Codec(path).encode(texts)
    assert wrong != right and not any(parity)


def test_sentencepiece_parity_and_decoding(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    texts = ["Hello  World", "", None, "\n\n a\nb ", " lead", "日本語 😀 ok", "tab\tx\r\n", "ünïcödé " * 3000]
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    df = frame(spark, list(enumerate(texts))).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in S5.piece_encode(df, path, round_trip=True).collect()}
    assert all(got[i].ids == own.encode(t or "") and got[i].parity and got[i].round_trip for i, t in enumerate(texts))
    back = S5.piece_decode(S5.piece_encode(frame(spark, list(enumerate(texts))), path), path).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert S5.piece_encode(frame(spark, []), path).collect() == []


def test_sentencepiece_round_trip_of_the_marker(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    texts = ["a plain text", "a▁b", "▁", "x\n▁▁y z"]
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in S5.piece_encode(frame(spark, list(enumerate(texts))), path, round_trip=True).collect()}
    back = {r.doc_id: r.text for r in S5.piece_decode(S5.piece_encode(frame(spark, list(enumerate(texts))), path), path).collect()}
    assert [got[i].ids for i in range(4)] == [own.encode(t) for t in texts]
    assert [got[i].round_trip for i in range(4)] == [back[i] == t for i, t in enumerate(texts)] == [True, False, False, False]


def test_decoding_of_markers_spelt_in_bytes():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt = [own.piece_to_id(f"<0x{b:02X}>") for b in "▁".encode()]
    ids = [own.encode("one two"), own.encode("a") + spelt + own.encode("b"), spelt, [], own.encode("x\n  é ☃")]
    assert S5.codec(path).decode(ids) == [own.decode(x) for x in ids]


def test_unigram_rebuild_without_chunks():
    m = S5.PieceModel([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -1.5, 1), ("▁", -2.0, 1), ("a", -2.5, 1), ("▁ab", -1.2, 1)], kind=S5.UNIGRAM, trim=True)
    t = S5.rebuild(m)
    t.normalizer, t.decoder = S5.normaliser(m), S5.decoder(m)
    e = t.encode("  ab  a ", add_special_tokens=False)
    assert e.tokens == ["▁ab", "▁a"] and t.decode(e.ids) == "ab a"


def test_pipeline(spark):
    import corpus_pipeline as C

    rng = random.Random(10)
    langs = {"aa": ["ba", "bo", "bu", "lim"], "bb": ["kri", "skt", "vor", "zem"]}
    word = lambda a: "".join(rng.choice(a) for _ in range(3))
    rows = [(i, " ".join(word(a) for _ in range(40)), lang, f"s{i % 3}", 0) for i, (lang, a) in enumerate(list(langs.items()) * 60)]
    passage = " ".join(word(langs["aa"]) for _ in range(60))
    rows += [(500, rows[0][1], "aa", "s0", 0), (501, rows[0][1] + " babobu", "aa", "s1", 0), (502, None, "aa", "s1", 0), (503, "12 34", "aa", "s1", 0), (504, passage, "aa", "s2", 0), (505, passage + " " + " ".join(word(langs["aa"]) for _ in range(60)), "aa", "s2", 0)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in C.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["language_id"]) == {r[0] for r in rows} - {502, 503}
    assert set(kept["near_duplicates"]) == set(kept["language_id"]) - {500, 501}
    assert passage in kept["repeated_passages"][504].text and passage[:100] not in kept["repeated_passages"][505].text
    assert set(kept["repeated_passages"]) == set(kept["near_duplicates"])
    assert all(r.parity and len(r.ids) == r.n_tokens for r in kept["token_ids"].values())


