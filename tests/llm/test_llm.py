"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plan_text import plan_of

from parcela.llm import bitsliced, crf, decontaminate, lshforest, mixing, quality, sharding, spans, warc, wrapper

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i} and" for i in range(20_000))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id and text, empty, blank, long, repeated rows, an own copy column."""
    near = [f"common words number {i} of a passage" for i in range(40)]
    base = " ".join(near)
    rows = [(1, base), (2, base + " tail"), (3, base), (4, None), (5, ""), (6, " \n "), (7, LONG), (7, LONG), (None, base), (8, "solo")]
    return docs_of(spark, rows).withColumn("copy", F.lit(9)).withColumn("page", F.lit("p"))


def test_archive_round_trip_and_order(spark):
    big = "<p>" + "é" * 800
    rows = [(i, f"http://www.h{i % 3}.example.com:80/a?{i}#x", big) for i in range(20)]
    rows += [(100, None, None), (101, "http://b.example/\r\nx", "WARC/1.0\r\n\r\n\r\n\r\nWARC/1.0\r\n"), (102, "http://b.example/", "small"), (103, "http://b.example/", "small")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("captured", F.lit("clash"))
    stamp = F.lit("2020-01-01T00:00:00Z")
    got = warc.archive_pages(pages, stamp, archive_bytes=4000, rows_per_task=7).collect()
    assert len(got) == 24 and len({r.archive for r in got}) > 1
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
        revisit = r.page_id < 19
        assert (r.record_type, r.refers_to) == (("revisit", 19) if revisit else ("response", None))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_pages(pages.limit(0), stamp).count() == 0


def test_loser_tree_merges():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted((int(x),) for x in rng.integers(0, 50, rng.integers(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(iter(r) for r in runs)) == sorted(x for r in runs for x in r)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.3, (300, 8)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (304, vectors[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = bitsliced.topk(df, df.filter("vec_id % 20 = 0"), 5, block_rows=70, query_block=4).collect()
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    assert bitsliced.topk(df.limit(0), df.limit(0), 5).count() == 0


def test_topk_broadcasts_nothing_and_holds_some_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-50, 50, (400, 8)) / 64
    df = spark.createDataFrame([(i + (1 << 60), v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    sums = np.rint(vectors @ vectors.T * 64 * 64).astype(int)
    want = [(q + (1 << 60), n + 1, i + (1 << 60), int(sums[q, i])) for q in range(400)
            for n, i in enumerate([i for i in np.lexsort((np.arange(400), -sums[q])) if i != q][:5])]
    # Spans of one block, of several, and of all.
    for most in (1, 300, 1 << 20):
        monkeypatch.setattr(bitsliced, "SPAN_BYTES", most, raising=False)
        found = bitsliced.topk(df, df, 5, block_rows=70, query_block=16)
        assert "Broadcast" not in plan_of(found)
        assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == want


def test_decontamination(spark):
    items = spark.createDataFrame([("b", ITEM), ("a", ITEM), ("c", "short one"), ("d", None), (None, "nil item"), ("e", "")], "item_id string, text string")
    rows = [(1, "x " + ITEM.upper() + ", y"), (2, "alpha beta gamma"), (3, None), (4, ""), (5, "a short one here, short one"), (6, LONG + " " + ITEM), (1, "other"), (7, "nil item")]
    docs = docs_of(spark, rows).withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1, 14].n_hit, got[1, 14].n_items, got[1, 14].items_sha256) == (12, 2, hashlib.sha256(b"a,b").hexdigest())
    assert not got[1, 1].contaminated and not got[2, 3].contaminated
    assert (got[3, 0].n_hit, got[4, 0].n_hit, got[5, 6].n_hit, got[6, 40012].n_hit) == (0, 0, 4, 12)
    assert (got[7, 2].n_hit, got[7, 2].n_items) == (2, 0)
    assert got[3, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, items).collect()) == [1, 2, 3, 4]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_proximity_match(spark):
    items = spark.createDataFrame([("a", ITEM)], "item_id string, text string")
    docs = docs_of(spark, [(1, ITEM.replace("epsilon", "epsilon inserted")), (2, "nothing of it")])
    cut = decontaminate.windows(items)
    assert decontaminate.find_windows(docs, cut).count() == 0
    near = decontaminate.find_windows(docs, cut, slop=2).collect()
    assert {r["_id"] for r in near} == {1} and {r["match"] for r in near} == {"near"}


def test_wrapper_drops_what_pages_share(spark):
    page = "<html><body><div class=top>Site name</div><div class=sidebar>a</div><div><p>{}<p>{} &amp; more</div><p>All rights</body>"
    rows = [(i, "http://h.example/x", page.format(f"one {i}", f"two  {i}")) for i in range(6)]
    rows += [(10, "http://other.example/", "<article>Only<br>page</article><aside>x"), (11, None, None), (12, "u", "<p>&lt;a&gt;<script>if (a < b) x"), (13, "http://z/", "<div>" * 3000 + "deep")]
    rows += rows[-1:]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = wrapper.extract_pages(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 11 and text[3] == "one 3 two 3 & more"
    assert (text[10], text[11], text[12], text[13]) == ("Only page", "", "<a>", "deep")
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrapper.extract_pages(pages.limit(0)).count() == 0


def test_wrapper_keeps_article_text():
    def text(page):
        return wrapper.main_text(wrapper.parse(page), set())

    assert text("<p>a<svg width='1'/>b</p><math/><p>c") == "ab c"
    assert text("<p>a<svg hidden/>b<svg><path/></svg>c") == "abc"
    deep = "<div id=page><article>one " + "<div>" * 70 + "two" + "</div>" * 70 + " three</article></div>four"
    assert text(deep) == "one two three"
    assert text("<div>" * 70 + "<nav>menu</nav><article>one</article>") == "one"
    assert text("<div class='content has-sidebar'><p>one</div><div class=sidebar>two") == "one"
    assert text("<div class='layout sidebar-right'><article>one</article><div class=sidebar>two</div></div>") == "one"
    assert text("<main><div class='page header-top'><article>one</article></div></main>") == "one"
    assert text("<article>one</article><div class=related><article>two</article></div>") == "one"


def wrapped(pages, marked=True):
    trees = [wrapper.parse(p, marked) for p in pages]
    template, beside = wrapper.template_nodes(trees, pages)
    return [wrapper.main_text(t, template, beside, marked) for t in trees]


def test_wrapper_keeps_articles_and_reads_odd_quotes():
    shared = [f"<body><nav>x</nav><article><p>Same article</p></article><footer>f{i}</footer></body>" for i in range(6)]
    assert wrapped(shared) == ["Same article"] * 6
    assert wrapped(["<p title=Bob's>one</p><p>two</p>"]) == ["one two"] and wrapped(['<p ">one</p>']) == ["one"]
    assert wrapped(["<p data-class='menu' title='a class=menu'>one</p>"]) == ["one"]
    for mark in ('class="post-tags-wrapper"', 'class="col-side main-col"', 'id="share-post"'):
        assert wrapped([f"<body><div {mark}><p>The body</p></div></body>"]) == ["The body"]
    long = "The body goes on. " * 20
    assert wrapped([f"<div class=notice><p>{long}</div>", "<div class=notice>We use cookies</div>"]) == [long.strip(), ""]
    assert wrapped(["<article><header><h1>Title</h1><p>by x</p></header><p>text</article>"]) == ["Title text"]
    teasers = f"<div><p>{long}</p></div><article>teaser one</article><article>teaser two</article>"
    assert wrapped([teasers]) == [long.strip()]
    odd = ["<body><p>odd</p></body>"] + [f"<body><div>Site menu</div><div><p>text {i} of it</p></div></body>" for i in range(6)]
    assert wrapped(odd) == ["odd"] + [f"text {i} of it" for i in range(6)]


def test_wrapper_finds_the_template_without_marks():
    page = ("<body><div><ul><li><a>m{0}<li><a>n{0}<li><a>o{0}</ul></div><div>advert {0}</div><div><h1>T{0}</h1>"
            "<p>{1}</p><p>{1}</p></div><div>made by {0}</div></body>")
    body = [f"Running text of number {i}, which goes on for quite a while. " * 3 for i in range(5)]
    pages = [page.format(i, b) for i, b in enumerate(body)]
    assert wrapped(pages, False) == [f"T{i} {b.strip()} {b.strip()}" for i, b in enumerate(body)]
    # Too few pages tell nothing.
    assert wrapped(pages[:3], False)[0].startswith("m0 n0 o0 advert 0")


def test_wrapper_alone_agrees_with_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = wrapper._host(F.col("url"))
    many = pages.groupBy(host.alias("h")).agg(F.countDistinct("html").alias("n")).filter("n BETWEEN 4 AND 32")
    pages = pages.join(many, host == F.col("h"), "left_semi")
    with_marks = {r.page_id: r.text for r in wrapper.extract_pages(pages).collect()}
    without = {r.page_id: r.text for r in wrapper.extract_pages(pages, marked=False).collect()}
    assert len(without) > 50 and sum(without[i] == t for i, t in with_marks.items()) >= 0.98 * len(without)


def brute_match(a, b):
    """Largest match of two trees, by every pair of orders of children."""
    if a.label != b.label:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute_match(xs[0], ys[0]) + best(xs[1:], ys[1:]) if xs[0].label == ys[0].label else 0)

    return 1 + best(a.kids, b.kids)


def test_matching_equals_brute_force():
    rng = np.random.default_rng(3)

    def tree(depth):
        node = wrapper.Node(str(rng.choice(["div", "p", "ul"])), "div")
        node.kids = [tree(depth - 1) for _ in range(int(rng.integers(0, 4)))] if depth else []
        return node

    for _ in range(60):
        a, b = wrapper.Node("body", "body"), wrapper.Node("body", "body")
        a.kids, b.kids = [tree(2) for _ in range(3)], [tree(2) for _ in range(3)]
        matcher = wrapper.Matcher()
        matcher.name_shapes(a)
        matcher.name_shapes(b)
        assert matcher.size(a, b) == brute_match(a, b) == len(matcher.pairs(a, b))


def test_spans(spark):
    passage = "The first sentence is here. The second one follows it now. A third ends it."
    rows = [(1, "Start of one. " + passage), (2, "Other begin.\n" + passage + "\nOther end."), (3, passage), (4, None), (5, ""), (6, "Ab. Cd."), (7, "Ab. Cd.")]
    got = {r.doc_id: r for r in spans.remove_repeats(docs_of(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "Other begin.\nOther end." and got[3].text == ""
    assert (got[2].n_sentences, got[2].n_removed) == (5, 3)
    assert got[4].text is None and got[5].text == "" and got[7].text == "Ab. Cd."
    assert spans.remove_repeats(docs_of(spark, rows).limit(0)).count() == 0


def brute_spans(rows):
    """Whole texts after removal, by a table of all runs in order of documents."""
    cut = {}
    for i, text in rows:
        parts = re.split("[\n\r\x01]+", re.sub(r"([.!?])[ \t]+", "\\1\x01", text or ""))
        cut[i] = [p.strip(" \t") for p in parts if p.strip(" \t")]
    seen, gone = {}, {i: set() for i in cut}
    for i in sorted(cut):
        low = [re.sub("[ \t]+", " ", s.lower()) for s in cut[i]]
        words = [len(s.split(" ")) for s in low]
        for at in range(len(low)):
            fits = [n for n in range(min(2, len(low)), len(low) - at + 1) if sum(words[at:at + n]) >= (8 if n <= 2 else 20)][:1]
            for n in {*fits, *([1] if words[at] >= 20 else [])}:
                if seen.setdefault(tuple(low[at:at + n]), (i, at)) != (i, at):
                    gone[i] |= set(range(at, at + n))
    return {i: "\n".join(s for k, s in enumerate(cut[i]) if k not in gone[i]) if gone[i] else text for i, text in rows}


def test_spans_of_short_and_long_sentences(spark):
    verse = "".join(f"word{j}!! " for j in range(60))
    middle = " ".join(f"m{j}" for j in range(30)) + "."
    head, tail = (" ".join(f"{c}{j}" for j in range(15)) for c in "ht")
    rows = [(1, "Own start. " + verse + "own end."), (2, "Begin. " + verse + "\nOther end of it."),
            (3, f"Some other words {head}. {middle} {tail} and so on."), (4, f"{head}. {middle} {tail} or not at all."),
            (5, "One. Two. Three."), (6, "One. Two. Three.")]
    got = {r.doc_id: r for r in spans.remove_repeats(docs_of(spark, rows)).collect()}
    # Fewer words than a run needs may stay at the end of a passage.
    assert got[2].n_removed >= 60 - 19 and got[2].text.startswith("Begin.\n") and got[2].text.endswith("Other end of it.")
    assert got[4].text == f"{head}.\n{tail} or not at all." and got[6].n_removed == 0
    assert {i: got[i].text for i in got} == brute_spans(rows)


def test_spans_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(rng.choice(["a", "Bc", "def", "g"], int(rng.integers(1, 26)))) + rng.choice([".", "!", "?"]) for _ in range(40)]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(pool, int(rng.integers(0, 30))))) for i in range(80)]
    # Many equal one-word sentences, a repeated row and one without id.
    rows += [(80, "Go. " * 3000), (81, rows[3][1]), (82, None)]
    twice = docs_of(spark, rows + [rows[5]]).withColumn("_runs", F.lit(1)).withColumn("n", F.lit("own"))
    got = spans.remove_repeats(twice)
    assert got.columns == twice.columns + ["n_sentences", "n_removed"]
    found = got.collect()
    assert len(found) == len(rows) + 1 and {r.doc_id: r.text for r in found} == brute_spans(rows)


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(7, LONG), (8, None), (9, ""), (10, "solo")]
    for g in range(12):
        base = rng.choice(words, 60).tolist()
        for c in range(int(rng.integers(1, 9))):
            t = list(base)
            for p in rng.integers(0, 60, int(rng.integers(0, 6))):
                t[p] = str(rng.choice(words))
            rows.append((100 + 20 * g + c, " ".join(t)))
    for n in (2, 5):
        got = {r.doc_id: r.component_id for r in lshforest.near_duplicates(docs_of(spark, rows), words=n).collect()}
        assert got == lshforest.brute_force(rows, n)
    found = {(r.doc_id, r.component_id, r.kept) for r in lshforest.near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (4, 4, True), (7, 7, True)} <= found
    assert lshforest.keep_one(odd).count() == 8
    assert lshforest.near_duplicates(odd.limit(0)).count() == 0


def test_deep_regions_keep_the_group(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(80)) + f" end{i}") for i in range(60)]
    profiles = docs_of(spark, rows).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).mapInPandas(
        lambda parts: lshforest._profile(5, parts), "_id bigint, n_shingles int, _set string, _sig array<int>, _chars bigint")
    members = lshforest.regions(profiles.select("_id", "_sig", "_chars"), most=3000)
    assert members.select("_id").distinct().count() == 60


def test_cut_regions_lose_no_link(spark):
    # A chain: neighbours are alike, the ends are not, and every region is cut.
    words = [f"w{i * 7919 % 10_007}" for i in range(1400)]
    texts = [(i, " ".join(words[i * 20:i * 20 + 1000])) for i in range(20)]
    got = lshforest.near_duplicates(docs_of(spark, texts), words=5, percent=93, region_chars=1000)
    assert {r.doc_id: r.component_id for r in got.collect()} == lshforest.brute_force(texts, 5, 93) == dict.fromkeys(range(20), 0)


def test_crowded_regions_find_pairs_at_80_percent(spark):
    # Pairs at 0.811, each above the region size.
    rows = []
    for g in range(60):
        words = [f"g{g}w{j}" for j in range(100)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:-10] + [f"g{g}x{j}" for j in range(10)]))]
    exact = lshforest.brute_force(rows, 5, 80)
    assert all(exact[i] == i - i % 2 for i, _ in rows)
    got = lshforest.near_duplicates(docs_of(spark, rows), words=5, percent=80, region_chars=300)
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert sum(found[i] != exact[i] for i in exact) <= 1


def test_crowded_regions_of_unlike_texts_go_deeper(spark, monkeypatch):
    # All share two thirds of their shingles; pairs are at 0.81 and triples chain.
    rng = np.random.default_rng(11)
    common = [f"c{j}" for j in range(200)]
    rows = []
    for g in range(90):
        own = [f"g{g}w{j}" for j in range(100)]
        rows.append((3 * g, " ".join(common + own)))
        for c in (1, 2):
            at = int(rng.integers(0, 60))
            rows.append((3 * g + c, " ".join(common + own[:at] + [f"g{g}c{c}x{j}" for j in range(26)] + own[at + 26:])))
    deeper = []
    real = lshforest._deeper
    monkeypatch.setattr(lshforest, "_deeper", lambda *a: deeper.append(1) or real(*a))
    exact = lshforest.brute_force(rows, 2, 80)
    got = lshforest.near_duplicates(docs_of(spark, rows), words=2, percent=80, region_chars=20_000)
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert deeper and sum(exact[i] != i for i in exact) > 50
    # The bound of 0.23 % leaves about one of these links out.
    assert sum(found[i] != exact[i] for i in exact) <= 1


def test_neighbours_keep_runs_across_batches():
    import pandas as pd

    def part(*keys):
        return pd.DataFrame({"_id": range(len(keys)), "_tree": 0, "_k1": keys, "_k2": 0})

    kept = pd.concat(lshforest._neighbours(iter([part(1, 2, 3, 3), part(4), part(), part(4, 5, 6, 6), part(7)])))
    # The outer rows stay, single ones inside go.
    assert kept["_k1"].tolist() == [1, 3, 3, 4, 4, 6, 6, 7]


def test_region_of_many_classes(spark):
    sig = F.array(*[F.lit(i) for i in range(lshforest.SIGNATURE)])
    profiles = spark.range(40_000).select(F.col("id").alias("_id"), sig.alias("_sig"), F.lit(10).cast("bigint").alias("_chars"))
    members = lshforest.regions(profiles)
    assert members.count() == members.select("_id").distinct().count() == 40_000


def test_shards_fit(spark, odd):
    many = docs_of(spark, [(i % 40, "x" * (i % 50)) for i in range(400)])
    for limit in (200, 1000):
        rows = sharding.shard_rows(many, limit=limit).collect()
        size = {}
        for r in rows:
            size.setdefault((r.shard, r.page), []).append(r.n_bytes)
        assert len(rows) == 400 and all(sum(v) <= limit or len(v) == 1 for v in size.values())
    got = sharding.shard_rows(odd)
    assert got.columns == [c for c in odd.columns if c != "page"] + ["n_bytes", "shard", "depth", "page"] and got.count() == 10
    assert sharding.shard_rows(odd.limit(0)).count() == 0


def test_shards_split_as_far_as_needed(spark):
    rows = [(i, "é" * (i % 70)) for i in range(600)] + [(600, "x" * 900), (601, None)]
    limit = 500
    cut = sharding.shard_rows(docs_of(spark, rows), limit=limit).collect()
    held = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    size = {i: len((t or "").encode()) for i, t in rows}
    want = {}
    for i in held:
        fits = (d for d in range(60) if sum(size[j] for j in held if held[j][:d] == held[i][:d]) <= limit)
        want[i] = held[i][:next(fits, 60)]
    assert {r.doc_id: r.shard for r in cut} == want and len({r.depth for r in cut}) > 3
    assert [r.doc_id for r in cut if r.page] == [600]


def test_language_sample_is_the_least_hashes(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"text number {i}") for i in range(600)] + [(3, "text number 3"), (None, "no id")])
    seen = []
    monkeypatch.setattr(crf, "train", lambda rows: seen.extend(rows))
    crf.fit(docs, per_language=20)
    labelled = docs.filter(~crf.held_out(F.col("doc_id"))).select(F.xxhash64("doc_id", "text").alias("h"), "text").distinct()
    assert [t for t, _ in seen] == [r.text for r in labelled.orderBy("h").limit(20).collect()]


def test_toxic_lexicon_has_no_limit(spark):
    bad = [(i, " ".join(f"vile{j}x" for j in range(700))) for i in range(5)]
    rows = docs_of(spark, bad + [(i, f"kind words {i}") for i in range(5, 40)]).withColumn("toxic", (F.col("doc_id") < 5).cast("int"))
    words, stems = quality.toxic_lexicon(rows)
    assert words == {f"vile{j}x".encode() for j in range(700)} and stems == {w[:5] for w in words if len(w) > 5}


@pytest.mark.parametrize("text", [None, "", " \n", "... !"])
def test_labelled_documents_without_words(spark, text):
    rows = [(i, f"fine words of text {i}") for i in range(6)] + [(6 + i, "vile words") for i in range(4)] + [(10, text), (11, text)]
    labels = spark.createDataFrame([(i, 1, int(6 <= i < 11)) for i in range(12)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, rows)
    assert quality.toxic_lexicon(docs.join(labels, "doc_id"))[0] == {b"vile"}
    assert quality.classify(docs, labels).count() == 12


def test_mixing(spark, odd):
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a', 'b') AS source")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("none", 5.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.poisson_mix(docs, weights).groupBy("source").count().collect()}
    assert abs(got["a"] - 3000) < 200 and abs(got["b"] - 1000) < 150
    large = mixing.poisson_mix(docs.filter("source = 'a'").limit(20), weights, rows=20 * 900).count()
    assert abs(large - 18_000) < 800
    assert mixing.poisson_mix(odd, mixing.tempered_weights(odd)).columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    assert mixing.poisson_mix(odd.limit(0), weights).count() == 0


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.unionByName(docs_of(spark, [(-1, None), (-2, ""), (-3, "12 !?"), (-4, LONG)]))
    got = crf.identify(more.withColumn("score", F.lit("clash"))).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    odd = {r.doc_id: r.lang_pred for r in got if r.doc_id < 0}
    assert (odd[-1], odd[-2], odd[-3]) == ("und", "und", "und")
    tested = [r for r in got if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    nothing = crf.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert crf.identify(docs.limit(0)).count() == 0


def test_code_switching():
    en, de = "the quick house and with that there which".split(), "schnell über straße nicht und wird schön haus".split()
    rng = np.random.default_rng(0)
    rows = [(" ".join(rng.choice(w, 120)), lang) for w, lang in ((en, "en"), (de, "de")) for _ in range(10)]
    model = crf.train(rows)
    chance = crf.label_words(model, [en + de])[0]
    assert [model.languages[i] for i in chance.argmax(1)] == ["en"] * 8 + ["de"] * 8


def test_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.unionByName(docs_of(spark, [(-1, None), (-2, ""), (-3, "Spam Spam " * 50)])).withColumn("kept", F.lit("clash"))
    judged = {r.doc_id: r for r in quality.classify(more, labels).collect()}
    assert len(judged) == more.count() and not judged[-1].kept and not judged[-2].kept and not judged[-3].kept
    clean = [judged[r.doc_id].kept for r in labels.filter("quality = 1 AND toxic = 0").collect()]
    assert np.mean(clean) > 0.98
    assert quality.keep_good(more, labels).columns == more.columns
    assert quality.classify(docs.limit(0)).count() == 0


def test_label_model_finds_the_noisy_labeller():
    rng = np.random.default_rng(2)
    patterns = {}
    for _ in range(5000):
        bad = rng.random() < 0.2
        p = "".join("b" if bad == (rng.random() < a) else "g" for a in (0.95, 0.9, 0.7))
        patterns[p] = patterns.get(p, 0) + 1
    post, rate = quality.label_model(patterns)
    assert post["bbb"] > 0.9 and post["ggg"] < 0.1 and rate[0, 0] - rate[0, 1] > rate[2, 0] - rate[2, 1]
