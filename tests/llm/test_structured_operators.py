"""Pages, URLs, vectors, passages and the pipeline against brute force."""

import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.llm import components, crowds, kernels, membership, nndescent, registry, sitetree, urls, windows

SF = "/root/testdata/sf0.001"


def test_urls_match_the_oracle(spark, tmp_path):
    odd = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.ORG/es/x?q", "x://example.org/en/12", "x://sub.example.org/en/2", "x://a.com/fr/", "x://a.com/de/1", "x://com/de/", "x://notorg/", "x://a.net/xxx/1", "x://a.net/free-bets", "x://a.net/freebets", "x://b/://c", "x://a.net?u=http://casino.com", "ftp://h#f/org/"]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(odd)], "page_id long, url string, rule string")
    rows = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert (rows[4].host, rows[4].path, rows[4].rule, rows[4].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (rows[5].rule, rows[5].verdict) == ("example.org/en/1", "block") and rows[6].rule == "org/"
    assert [rows[i].verdict for i in (7, 8, 9, 10, 11, 12, 13)] == ["allow", "block", "block", "allow", "block", "block", "allow"]
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == ("", "", None, "allow")
    db = duckdb.connect()
    both = pages.select("page_id", "url").union(spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id") + 1000, "url"))
    frame = both.toPandas()
    db.register("pages", frame)
    names = ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "points"]
    truth = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({urls.oracle()})").fetchall(), key=lambda r: r[0])
    assert sorted((tuple(r[n] for n in names) for r in urls.judge_urls(both).collect()), key=lambda r: r[0]) == truth


def test_url_rules_ties_and_a_vocabulary(spark):
    rules = [("b.org", "/x", "block"), ("org", "/xyz", "allow"), ("org", "/xyz", "block")]
    pages = spark.createDataFrame([(1, "x://a.b.org/xyz"), (2, "x://c.org/xyz"), (3, "x://k.net/wood-oak"), (4, "x://k.net/oak"), (5, "x://k.net/elm/oak_pine")], "page_id long, url string")
    rows = {r.page_id: r for r in urls.judge_urls(pages, rules=rules, vocabulary={"wood": 100, "oak": 40, "elm": 40, "pine": 20}).collect()}
    assert (rows[1].rule, rows[1].verdict) == ("b.org/x", "block")  # as long as the other, of the longer host
    assert (rows[2].rule, rows[2].verdict) == ("org/xyz", "allow")  # the first of the same
    assert [(rows[i].verdict, rows[i].n_strict, rows[i].n_soft, rows[i].points) for i in (3, 4, 5)] == [("block", 1, 1, 140), ("allow", 0, 1, 40), ("block", 0, 3, 100)]



#: pages of everyday words, and pages that the filter is for
ORDINARY = [
    "university.edu/farm/diet", "sports.net/track/win", "health.net/sex-education", "docs.net/spam-filter", "museum.net/nude-in-art", "adult-learning.edu", "shop.net/sale/discount-coupon", "film.net/casino-royale",
    "bank.net/credit/loans", "news.net/crypto/bitcoin", "school.net/sex_ed/same-sex?q=young+adult", "lib.net/toll-free/tax-free-loan", "essex.net/sussex", "a.net/pharmacy/deal", "punk.net/Hardcore%20Punk",
]
UNWANTED = [
    "freeporn.net", "onlinecasino.net", "casin0.net", "a.net/online/casino", "a.net/online-casino-royale/poker-slots", "payday-loans.net", "a.net/PaydayLoan", "p0rn.net", "a.net/sex?x=adult", "a.net/sex-education/free-sex",
    "hot.singles.net", "pornhd.net", "a.net/free/poker", "a.net/win/cheap/pills/prize",
]


def test_url_vocabulary_means_what_it_says(spark):
    urls_of = [f"https://{u}" for u in ORDINARY + UNWANTED]
    pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string")
    rows = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert [urls_of[i] for i in range(len(ORDINARY)) if rows[i].verdict != "allow"] == []
    assert [urls_of[i] for i in range(len(ORDINARY), len(urls_of)) if rows[i].verdict != "block"] == []
    db = duckdb.connect()
    db.register("pages", pages.toPandas())
    names = ["page_id", "verdict", "n_strict", "n_soft", "points"]
    assert sorted(tuple(r[n] for n in names) for r in rows.values()) == sorted(db.execute(f"SELECT {', '.join(names)} FROM ({urls.oracle()})").fetchall())


def test_url_exceptions_cover_whole_terms():
    words = urls.Vocabulary({"a b": 40, "b": 30, "c": 100}, 100, ["x a b", "b", "c d"])
    assert words.count("A-b") == (0, 1, 40)  # the phrase "b" covers only itself
    assert words.count("x/a_b") == words.count("b") == words.count("c+d") == words.count("") == (0, 0, 0)
    assert words.count("c d c c ac") == (2, 0, 100)
    assert urls.Vocabulary({}, 100).count("porn") == (0, 0, 0)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><a href=x>Logo</a></header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><aside>side</aside>
<article><header><h1>Ti&amp;tle {n}</h1></header><p>Fir<b>st</b> para&nbsp;{n}.<br>Line<p>Se&#99;ond &lt;x&gt;
  text<script>var a="</p>";</script> end<div class="share-buttons">Share</div><form><input value=1>Send</form>
<div id="comments"><article>me too</article></div><p>Last</article><div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    text = sitetree.main_text(PAGE.format(n=3), {})
    assert text == "Ti&tle 3 First para 3. Line Second <x> text end Last"
    assert sitetree.main_text(None, {}) == sitetree.main_text("", {}) == ""
    assert sitetree.main_text("<p>a<!-- <p>x --><b>b</b>c <i>d", {}) == "abc d"
    assert sitetree.main_text("plain < 5 & more", {}) == "plain < 5 & more"
    assert sitetree.main_text("<body><p>x</body><", {}) == "x <"
    assert sitetree.main_text("<b><div>" * 20000 + "deep" + "</div>" * 20000 + "<nav>no</nav><p>end", {}) == "deep end"
    assert sitetree.main_text("<article>" + '<a "' * 20000 + "<p>ok</p></article>", {}) == "ok"
    story = "The body of a story that says more than all else on the page."
    for page in (
        f'<div class="layout has-sidebar"><div><p>{story}</div></div>',
        f'<article class="post social-science notice-board"><p>{story}</article>',
        f'<div id="main-search-results-page"><p>{story}</div>',
        f'<article class=card>other story</article><div><p>{story}</div>',
        f'<form><div class=sidebar>side</div><main>{story}</main></form>',
        f'<div class=sidebar><article>{story}</article><nav>menu</nav></div>',
        f'<p data-x="{"y>" * 5000}leaked">{story}',
        "<div>" * 3000 + f"<nav>menu</nav>{story}" + "</div>" * 3000,
    ):
        assert sitetree.main_text(page, {}) == story
    assert sitetree.main_text("<nav>Menu</nav><footer>Imprint</footer><p>x", {}) == "x"


def test_furniture_larger_than_the_story():
    many = "".join(f"<p>Reader {i} says that this is a long comment about the story.</p>" for i in range(30))
    articles = "".join(f'<article class="comment-body"><p>Reader {i} says much.</p></article>' for i in range(30))
    story = "A short story in one line."
    for furniture in (
        f'<div id="comments">{many}</div>', f'<section class="comments-area">{articles}</section>', f'<div class="cookie-consent">{many}</div>', f"<aside>{many}</aside>",
        f"<aside><article>{many}</article></aside>", f'<div class="sidebar">{many}</div>', f'<div role="complementary">{many}</div>', f'<div class="ad-container">{many}</div>',
        f'<div class="newsletter-box"><form>{many}</form></div>', f'<div class="related-posts-list related">{articles}</div>', '<div class="site-head">Logo</div>', f"<dialog open>{many}</dialog>",
    ):
        for page in (f'<div class="story"><p>{story}</div>{furniture}', f"<body>{furniture}<div><p>{story}</p></div></body>", f'<form id="aspnet"><div class="story"><p>{story}</div>{furniture}</form>'):
            assert sitetree.main_text(page, {}) == story, page[:90]
    # wrappers of whole pages, and menus' names around the only article
    assert sitetree.main_text(f'<form><div class="card"><p>{story}</div></form>', {}) == story
    assert sitetree.main_text(f'<div class="navigation"><main>{story}</main></div>', {}) == story


def test_hostile_pages_take_linear_time():
    began = time.process_time()
    for piece in ('<a "', "<b><div>", '<a x="', '<a ">" ', "<a x='\"", "<!--", "<li>", "<p>", "</div>", "<a b=", "<", "&"):
        sitetree.main_text(piece * 30000, {})
    assert time.process_time() - began < 30


def _site(rng, host, n):
    """Pages whose class names say nothing and differ by host: a menu, a line that all share, the story, related stories of few texts."""
    name = [f"c{x}" for x in rng.integers(0, 10**6, 4)]
    few = [" ".join(f"r{x}" for x in rng.integers(0, 99, 8)) for _ in range(3)]
    for i in range(n):
        story = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 30))
        yield f"http://{host}/{i}", story, (
            f"<html><body><div class={name[0]}><ul><li>Home<li>About us</ul></div><div class='{name[1]}'>All rights reserved</div>"
            f"<div class={name[2]}><p>{story}</p></div><div class={name[3]}><p>{few[i % 3]}</p></div></body></html>"
        )


@pytest.mark.parametrize("nodes", [sitetree.BROADCAST_NODES, 0])
def test_the_tree_removes_what_pages_of_a_host_share(spark, nodes):
    rng = np.random.default_rng(41)
    made = [x for h in range(4) for x in _site(rng, f"h{h}.example", 40)]
    rows = [(i, url, html) for i, (url, _, html) in enumerate(made)]
    lone = next(_site(rng, "lone.example", 1))
    rows += [(1000, lone[0], lone[2]), (1001, None, None), (1002, "http://h0.example/z", "")]
    # copies of one page are one page, so the host has too few to judge by
    rows += [(2000 + i, f"http://copies.example/{i}", f"<div class=q><div class=body><p>{made[0][1]}</p></div></div>") for i in range(30)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in sitetree.extract_pages(pages, broadcast_nodes=nodes).collect()}
    assert {i: found[i].text for i in range(len(made))} == {i: story for i, (_, story, _) in enumerate(made)}
    assert all(found[i].n_removed == 4 for i in range(len(made)))  # the parts of the menu, the line, and the related stories
    assert "Home About us All rights reserved " + lone[1] in found[1000].text
    assert all(found[2000 + i].text == made[0][1] for i in range(30))
    assert (found[1001].text, found[1001].n_chars, found[1002].text) == ("", 0, "")
    assert sitetree.extract_pages(pages.where("false")).count() == 0


def test_pages_of_the_test_data(spark):
    def plain(html):
        body = re.search(r"<article>(.*)</article>", html, re.S)[1]
        import html as entities

        return " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: plain(r.html) for r in pages.collect()}
    rows = registry.op1_site_style_tree(spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in rows} == truth
    assert all(r.n_chars == len(r.text) for r in rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 3), (7, 7), (200, 201), (201, 200), (50, 60), (60, 55)]
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert found == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200, 50: 50, 55: 50, 60: 50}
    assert components.connected_components(frame.where("false")).count() == 0


def brute_vectors(rows, threshold=0.95):
    ids = [i for i, _ in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    width = max(len(v) for (_, v), g in zip(rows, good) if g)
    unit = np.zeros((len(rows), width))
    for n, ((_, v), g) in enumerate(zip(rows, good)):
        if g:
            unit[n, : len(v)] = np.array(v, np.float64) / np.linalg.norm(v)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(linked, comp[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == comp).all():
            return dict(zip(ids, zip(linked.sum(axis=1).tolist(), comp.tolist())))
        comp = new


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(150):
        center = rng.standard_normal(16)
        center /= np.linalg.norm(center)
        for _ in range(rng.choice([1, 1, 2, 3, 8, 40])):
            rows.append((len(rows), [float(np.float32(x)) for x in center + 0.05 * rng.standard_normal(16)]))
    rows += [(len(rows) + i, list(rows[5][1])) for i in range(5)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, []), (n + 5, [float("inf")] * 16), (n + 6, [x * 1000 for x in rows[9][1]])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, component_id int")
    truth = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicate_vectors(frame).collect()}
    assert got == truth
    assert nndescent.near_duplicate_vectors(frame.where("false")).count() == 0
    assert {tuple(r) for r in nndescent.near_duplicate_vectors(frame.where("vec_id in (0)")).collect()} == {(0, 0, 0, True)}


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        values = rng.integers(0, rng.choice([4, 1000]), rng.integers(1, 40)).astype(np.uint64)
        width = int(rng.integers(1, 9))
        truth = set()
        for a in range(len(values)):
            for b in range(a + width - 1, len(values)):
                c = a + int(np.argmin(values[a : b + 1]))
                left = a - 1
                first, last = a, b
                while first > 0 and values[first - 1] > values[c]:
                    first -= 1
                while last + 1 < len(values) and values[last + 1] >= values[c]:
                    last += 1
                truth.add((c, first, last))
        center, first, last = windows.compact_windows(values, width)
        assert set(zip(center.tolist(), first.tolist(), last.tolist())) == truth


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_passages_have_a_length_that_places_can_hold(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for words in (4, windows.SHINGLE + windows.REACH + 1):
        with pytest.raises(ValueError, match="passage_words"):
            windows.repeated_passages(docs, passage_words=words)


def test_repeated_passages(spark):
    rng = np.random.default_rng(6)
    passage, edited = words(rng, 51), None
    long = words(rng, 120)
    edited = [*long]
    for i in range(10, 120, 40):
        edited[i] = "changed"
    half = words(rng, 60)
    docs = {
        0: words(rng, 30) + passage + words(rng, 80),
        1: words(rng, 300),
        2: words(rng, 10) + passage,
        3: long + words(rng, 10),
        4: words(rng, 70) + edited,
        5: half[:30] + words(rng, 40),
        6: half[:30] + words(rng, 90),  # 30 words in common are too few
        7: words(rng, 20) + passage + words(rng, 20),
        8: [],
        9: passage[:20],
    }
    texts = [(i, " ".join(w).upper() if i == 7 else " ".join(w), 1, "x") for i, w in docs.items()] + [(10, None, 1, "x"), (11, "same " * 400, 1, "x"), (12, "same " * 400, 1, "x")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, span int, link string")
    rows = windows.repeated_passages(frame).collect()
    found = {r.doc_id: (r.start_word, r.end_word, r.source_id) for r in rows}
    assert len(rows) == len(found) and set(found) == {2, 4, 7, 12}
    assert found[2] == (10, 61, 0) and found[7] == (20, 71, 0)
    assert found[4][2] == 3 and found[4][0] <= 85 and found[4][1] >= 185
    cut = {r.doc_id: r for r in windows.cut_passages(frame.withColumn("n_chars", F.length("text").cast("long")), windows.repeated_passages(frame)).collect()}
    assert len(cut[2].text.split()) == 10 and cut[2].n_chars == len(cut[2].text)
    assert 12 not in cut and cut[11].text == texts[11][1] and cut[10].text is None and cut[8].text == ""
    assert len(cut[7].text.split()) == 40
    assert windows.repeated_passages(frame.where("false")).count() == 0


def test_membership(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "x")
    rows = spark.range(6000).selectExpr("if(id = 5999, null, id) as doc_id", "id as x", "'t' as text")
    frame, may = membership.mark(rows, "doc_id", ids)
    marked = {r.x: r[may] for r in frame.collect()}
    assert all(marked[i] for i in range(0, 5000, 7)) and sum(marked.values()) < 720 and not marked[5999]
    kept = {r.x for r in membership.without(rows, "doc_id", ids).collect()}
    assert kept == set(range(6000)) - set(range(0, 5000, 7))
    assert membership.without(rows, "doc_id", ids.where("false")).count() == 6000


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, SF))
        assert kept.columns == columns and 0 < kept.count() <= docs.count()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()
    assert {r.doc_id for r in packed} == ids
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_act_on_planted_cases(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    source = docs.where("doc_id = 1").first()
    clean = " ".join(words(rng, 90))
    planted = [
        (9000, source.text, "en", "p", len(source.text)),
        (9001, clean + " " + bench, "en", "p", 1),
        (9002, clean[::-1], "en", "p", 1),
        (9003, "### 123 !!!", None, "p", 11),
        (9004, None, None, None, None),
    ]
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not {9003, 9004} & ids(stages["language_id"](spark, both, SF))
    near = ids(stages["near_duplicates"](spark, both, SF))
    assert 9000 not in near and {9001, 9002} <= near
    assert 9001 not in ids(stages["decontamination"](spark, both, SF))
    assert 9002 in ids(stages["decontamination"](spark, both, SF))


def test_stages_keep_columns_that_clash_with_their_own(spark):
    import corpus_pipeline

    names = ("score", "rejected", "lang_pred", "_may", "_bits", "_id", "cut_id", "cut_spans", "fp", "row")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in kept.collect() for n in names)


def test_word_hash_is_the_same_in_any_place():
    a = kernels.word_hashes(b"tail of words")
    b = kernels.word_hashes(b"x" * 70000 + b" tail of words")
    assert (a == b[1:]).all()


@pytest.mark.parametrize("k", [1, 5])
def test_shingles_of_short_texts(k):
    assert len(kernels.shingle_hashes(kernels.word_hashes(b"a b c"), k)) == (3 if k == 1 else 1)
    assert len(kernels.shingle_hashes(kernels.word_hashes(b""), k)) == 0


def test_repeated_rows_long_inputs_and_empty_tables(spark):
    long_html = "<article>" + "<p>word &amp; more</p>" * 40000 + "</article>"
    pages = spark.createDataFrame([(1, "http://h/", long_html, "x"), (2, "http://h/", "<p>a</p>", "x"), (2, "http://h/", "<p>a</p>", "x")], "page_id long, url string, html string, host string")
    rows = sitetree.extract_pages(pages).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, 40000 * 12 - 1), (2, 1), (2, 1)]
    same = spark.createDataFrame([(1, "http://a.org/" + "x" * 200000, "v")] * 2, "page_id long, url string, verdict string")
    assert [(r.page_id, r.verdict) for r in urls.judge_urls(same).collect()] == [(1, "allow")] * 2
    assert urls.judge_urls(same.where("false")).count() == 0
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicate_vectors(vectors).collect()) == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True)]
    text = " ".join(f"w{i}" for i in range(20000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [(r.doc_id, r.start_word, r.end_word, r.source_id) for r in windows.repeated_passages(docs).collect()] == [(2, 0, 20000, 1)]


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, truth = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLES[name]).df()
    plain = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(truth.columns) and plain(got) == plain(truth)


def test_passages_around_a_frequent_line(spark):
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    line, texts, truth = fresh(40), [], set()
    own = [fresh(11) for _ in range(20)]
    for i in range(400):  # the documents of a pair are 200 apart, and the line is in all
        before, after = fresh(60), fresh(60)
        tail = own[i % 200 // 10] if i % 10 == 3 else fresh(11)
        texts.append(" ".join([*before, *line, *tail, *after]))
        if i >= 200 and i % 10 == 3:
            truth.add((i, 60, 111, i - 200))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in windows.repeated_passages(docs).collect()}
    assert found == truth


def test_a_passage_twice_in_one_document(spark):
    rng = np.random.default_rng(22)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, truth = [], set()
    for i in range(20):
        passage = fresh(51)
        rows.append((i, " ".join([*fresh(20), *passage, *fresh(20)])))
        rows.append((100 + i, " ".join([*fresh(30), *passage, *fresh(900), *passage, *fresh(9)])))
        truth |= {(100 + i, 30, 81, i), (100 + i, 981, 1032, i)}
    docs = spark.createDataFrame([*rows[::2], *rows[1::2]], "doc_id long, text string").repartitionByRange(2, "doc_id")  # sources in one task, copies in the other
    found = {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in windows.repeated_passages(docs).collect()}
    assert found == truth


def test_links_between_two_tight_groups_of_vectors(spark):
    rng = np.random.default_rng(31)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    vectors = [*unit(rng.standard_normal((2000, 64)))]
    for _ in range(12):  # pairs of groups of 20 at 0.965, members closer to their own group than to the other
        a, b = unit(rng.standard_normal((2, 64)))
        b = unit(b - (a @ b) * a)
        for middle in (a, 0.965 * a + np.sqrt(1 - 0.965**2) * b):
            vectors += [*unit(middle + 0.0003 * rng.standard_normal((20, 64)))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in nndescent.near_duplicate_vectors(table).collect()}
    cosines = np.array(vectors) @ np.array(vectors).T
    assert {i: r.n_links for i, r in rows.items()} == dict(enumerate(((cosines >= 0.95).sum(axis=1) - 1).tolist()))
    assert len({rows[i].component_id for i in range(2000, len(vectors))}) == 12


def test_rare_pairs_of_vectors(spark, caplog):
    rng = np.random.default_rng(33)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    vectors = unit(rng.standard_normal((20000, 48)))
    off = rng.standard_normal((200, 48))
    off = unit(off - (off * vectors[:200]).sum(axis=1, keepdims=True) * vectors[:200])
    cosine = rng.uniform(0.9501, 0.97, (200, 1))
    vectors[10000:10200] = cosine * vectors[:200] + np.sqrt(1 - cosine**2) * off
    vectors[:2000] *= 3
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    with caplog.at_level("INFO", nndescent.__name__):
        linked = {r.vec_id: r.component_id for r in nndescent.near_duplicate_vectors(table).where("n_links > 0").collect()}
    assert all(linked[i] == i % 10000 for i in linked) and len(linked) >= 2 * 196
    said = [r.args for r in caplog.records if r.name == nndescent.__name__][-1]
    assert said[4] >= 0.99 and said[5] >= 0.99 and said[6] >= 150  # planted pairs, audited points and their number


def test_threshold_ties_and_a_failing_audit(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (1, [0.95, (1 - 0.95**2) ** 0.5]), (2, [0.9499, (1 - 0.9499**2) ** 0.5]), (3, [0.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = np.array([r[1] for r in rows])
    near = (exact @ exact.T) / np.outer(*[np.linalg.norm(exact, axis=1)] * 2) >= 0.95
    assert {r.vec_id: r.n_links for r in nndescent.near_duplicate_vectors(table).collect()} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
    monkeypatch.setattr(nndescent, "_audit", lambda *a: (0.5, 9))
    monkeypatch.setattr(nndescent, "WAVES", 2)
    with pytest.raises(RuntimeError, match="0.5000"):
        nndescent.near_duplicate_vectors(table)


def _passages_by_brute_force(docs, width=47, need=42):
    """Spans by definition: runs of a document of which enough shingles are in an equally wide run of a smaller document, and the other way round."""
    grams = {i: [tuple(w[j : j + 5]) for j in range(len(w) - 4)] for i, w in docs.items()}
    found = {i: set() for i in docs}
    for i, a in grams.items():
        for j, b in grams.items():
            if j >= i or not set(a) & set(b):
                continue
            for s in range(len(a) - width + 1):
                run = a[s : s + width]
                for t in range(len(b) - width + 1):
                    other = b[t : t + width]
                    if run[0] in other and run[-1] in other and sum(x in other for x in run) >= need and sum(x in run for x in other) >= need:
                        found[i] |= set(range(s, s + width + 4))
                        break
    return found


@pytest.mark.parametrize("limits", [{}, {"GROUP_PAIRS": 64, "STARS": 3, "DEALT": 8, "LEVELS": 2, "LOCAL_CROWD": 2}])
def test_passages_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(windows if hasattr(windows, name) else crowds, name, value)
    rng = np.random.default_rng(23)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    phrase, long, docs = fresh(44), fresh(70), {}
    for i in range(30):
        docs[i] = [*fresh(int(rng.integers(0, 20))), *phrase, *fresh(12)]
    for i in range(30, 45):  # the words behind the phrase too, exactly or with one edit
        tail = docs[i - 30][-12:]
        near = [*phrase, *tail]
        if i % 3 == 1:
            near[int(rng.integers(0, len(near)))] = "changed"
        elif i % 3 == 2:
            near.insert(int(rng.integers(0, len(near))), "more")
        docs[i] = [*fresh(5), *near, *fresh(5)]
    for i in range(45, 60):  # copies of a longer passage, each with an edit of its own
        near = [*long]
        near[int(rng.integers(0, len(near)))] = f"own{i}"
        docs[i] = [*fresh(8), *near, *fresh(8)]
    line = fresh(20)
    docs[60], docs[61] = [*line * 8, *fresh(5)], [*fresh(9), *line * 5, *fresh(60), *line * 4]  # lines that repeat inside documents
    docs[62] = [*fresh(3), *line[:19], "other", *line * 3, *fresh(3)]
    truth = _passages_by_brute_force(docs)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3, "doc_id")
    got = {i: set() for i in docs}
    for r in windows.repeated_passages(table).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    wanted = sum(map(len, truth.values()))
    assert wanted > 1000 and sum(len(got[i] - truth[i]) for i in docs) <= 0.002 * wanted
    assert sum(len(got[i] & truth[i]) for i in docs) >= 0.98 * wanted
    for i in range(30, 45, 3):  # exact copies are always found
        assert truth[i] <= got[i]


def test_exact_pairs_in_a_crowd(spark):
    rng = np.random.default_rng(24)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    phrase, rows, truth = fresh(44), [], set()
    for i in range(2000):
        rows.append((i, " ".join([*fresh(9), *phrase, *fresh(9)])))
    for i in range(100):
        rows[1900 + i] = (1900 + i, rows[i * 19][1])
        truth.add((1900 + i, 0, 62, i * 19))
    boiler = fresh(40)
    for i in range(3000, 4200):
        at = 60 + i % 7
        rows.append((i, " ".join([*fresh(at), *boiler, *fresh(60)])))
        if i >= 4100:
            own = rows[2000 + (i - 4100) * 11]
            passage = own[1].split()[60 + own[0] % 7 - 8 : 60 + own[0] % 7 + 48]
            rows[-1] = (i, " ".join([*fresh(30), *passage, *fresh(30)]))
            truth.add((i, 30, 86, own[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in windows.repeated_passages(docs).collect()} == truth
