"""Near duplicates, neighbours, pages, preferences and the pipeline against brute force."""

import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import combination_join, permutation_index, preference, queries, site_templates
from ragloom.llm.common import table
from ragloom.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_components(rows, words=3, percent=90):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        own = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(key, own)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders, common = defaultdict(list), Counter()
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for some in holders.values():
        for i, a in enumerate(some):
            for b in some[i + 1:]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def noisy_rows():
    rng = random.Random(1)
    vocabulary, rows = [f"w{i}" for i in range(60)], []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 30, 60, 120, 200]))]
        for _ in range(rng.choice([1, 2, 8, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < .3:
                text = text[:max(1, int(len(text) * rng.uniform(.9, 1)))]
            rows.append((len(rows), " ".join(text)))
    return rows + [(1000, ""), (1001, None), (1002, "A b"), (1003, "a B"), (1004, "  ")]


@pytest.mark.parametrize("settings", [
    combination_join.Settings(),
    combination_join.Settings(rare=2, block=5),
    combination_join.Settings(rare=1, extension=0.3, block=7, block_tokens=100),
    combination_join.Settings(words=5, percent=80, extension=0.05, rare=1)])
def test_join_equals_all_pairs(spark, settings):
    rows = noisy_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in combination_join.jaccard_components(docs, settings=settings).collect()}
    assert got == brute_components(rows, settings.words, settings.percent)


def test_join_on_the_table_and_edges(spark, edge_docs, no_docs):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in combination_join.jaccard_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    rows = combination_join.jaccard_components(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_shingles == 0 and by_id[0].component_id == 0 and by_id[1].component_id == 1
    assert by_id[12].component_id == 11 and by_id[None].component_id is None
    assert combination_join.jaccard_components(no_docs).count() == 0
    kept = combination_join.keep_one_per_component(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted(
        (k is None, k) for k in {r.component_id for r in rows})


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(
        spark.range(500, 520).select(F.col("id").alias("a"), F.lit(519).cast("long").alias("b")))
    found = {r.node: r.component for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[i] == 500 for i in range(500, 520))


def test_search_recall_order_and_edges(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in vectors.collect()}
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    got = defaultdict(list)
    for r in permutation_index.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = matrix @ rows[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits += len({ids[i] for i in order} & {r.vec_id for r in found})
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - rows[r.vec_id] @ rows[q]) < 1e-12 for r in found)
    assert hits >= 0.9 * 20 * len(got)


def recall_of(spark, rows, settings=None, k=20, every=20):
    """Share of the true neighbours found; every query has to have min(k, candidates) rows in order."""
    vectors = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(rows)],
                                    "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    found = permutation_index.nearest(vectors, F.col("vec_id") % every == 0, k=k,
                                      settings=settings or permutation_index.Settings())
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hits = 0
    for q in range(0, len(rows), every):
        scores = (rows * rows[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(rows)), -scores)) if i != q][:k]
        assert [r["rank"] for r in got[q]] == list(range(1, min(k, len(rows) - 1) + 1))
        assert [(-r.score, r.vec_id) for r in got[q]] == sorted((-scores[r.vec_id], r.vec_id) for r in got[q])
        hits += len(set(order) & {r.vec_id for r in got[q]})
    return hits / (min(k, len(rows) - 1) * len(range(0, len(rows), every)))


def test_recall_on_clusters_norms_and_outliers(spark):
    rng = np.random.default_rng(11)
    plain = rng.normal(size=(3000, 32))
    unit = plain / np.linalg.norm(plain, axis=1)[:, None]
    clusters = np.concatenate([rng.normal(size=32) * 5 + rng.normal(size=(1000, 32)) for _ in range(2)])
    assert recall_of(spark, clusters) >= 0.9
    assert recall_of(spark, unit * rng.lognormal(0, 1, size=(3000, 1))) >= 0.9
    opposite = unit[:1000].copy()
    opposite[:, 0] = np.abs(opposite[:, 0]) + 2
    opposite[::160, 0] *= -1      # queries that point away from all others
    few = permutation_index.Settings(file=64, posted=2, probed=0.3, least=1)
    assert recall_of(spark, opposite, few) > 0
    assert recall_of(spark, unit[:15]) == 1


def test_share_of_postings_falls():
    s = permutation_index.Settings()
    share = []
    for n in (10_000, 50_000, 400_000, 520_000):
        files = s.files(n, s.pivots)
        share.append(s.opened(files, 0) * s.posted / files)
    assert share == sorted(share, reverse=True) and share[1] < 0.9 and share[-1] < 0.3


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [1.0, float(i)]) for i in range(30)] + [(100, [1.0]), (120, [1.0, 2.0, 3.0]), (140, []), (160, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = permutation_index.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in found} == {0, 20} and all(r.vec_id < 30 for r in found) and len(found) == 40
    huge = [(i, [1e200 * (i + 1), -1e-200]) for i in range(4)]
    found = permutation_index.nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>"),
                                      F.col("vec_id") == 0, k=2).collect()
    assert len(found) == 2


def test_search_edges(spark):
    one = [0.6, 0.8]
    rows = [(0, one), (1, one), (2, one), (20, one), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, one), (8, [-0.6, 0.8]), (40, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = permutation_index.nearest(vectors, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    small = permutation_index.Settings(block=2, query_block=1)
    again = permutation_index.nearest(vectors, F.col("vec_id") % 20 == 0, k=3, settings=small)
    assert again.orderBy("query_id", "rank").collect() == found
    assert permutation_index.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_different_texts_under_one_id_stay(spark):
    rows = [(1, "one text of its own"), (1, "quite another text here"), (1, "one text of its own"), (2, "one text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, combination_join.keep_one_per_component(docs).collect()))
    assert kept == [(1, "one text of its own"), (1, "quite another text here")]


def page(body, article="<h1>Title</h1><p>One &amp; two<br>three <b>bo</b>ld</p>"):
    return f"<html><head><title>t</title></head><body>{body}<article>{article}</article><footer>f</footer></body></html>"


def test_pages(spark):
    box = "<div><div class='x1'>Welcome <i>to</i> the site</div></div>"
    inside = "<p>Own text {0} here</p><div class='z'>Read our paper</div><p>Everyone quotes this</p>"
    rows = [(i, f"http://u@A.example.org:80/{i}?q", page(box, inside.format(i))) for i in range(6)]
    rows += [(10, "https://b.org/", page("<nav>n</nav><script>if (a<b) '</p>'</script>")),
             (11, "https://b.org/", "<body><header>h</header><p>bare page<p>second<!-- c --></body>"),
             (12, None, page(box)), (13, "no host", ""), (14, "http://c.org", None),
             (15, "http://c.org", "plain &lt;text&gt;"),
             (16, "http://c.org", "<article>x <form>f</form><div class='post-comments'><article>c</article></div>y"),
             (17, "http://c.org", "<main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>"),
             (10, "https://b.org/", page("<nav>n</nav><script>if (a<b) '</p>'</script>"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = Counter(tuple(r) for r in site_templates.extract_pages(pages).collect())
    text = {r[0]: r[2] for r in got}
    for i in range(6):  # the box recurs on the host; so does the quoted paragraph, which stays
        assert text[i] == f"Own text {i} here Everyone quotes this"
    assert text[10] == "Title One & two three bold" and text[11] == "bare page second"
    assert text[12] == "Title One & two three bold" and text[13] == "" and text[14] == ""
    assert text[15] == "plain <text>" and text[16] == "x y" and text[17] == "a b c d"
    assert sum(got.values()) == len(rows) and all(r[3] == len(r[2]) for r in got)
    assert site_templates.extract_pages(pages.limit(0)).count() == 0


def test_templates_by_host_are_counted_whole(spark):
    html = [page(f"<div class='x{i}'>note {i % 2}</div>") for i in range(40)]
    pages = spark.createDataFrame([("h", p) for p in html], "host string, html string").repartition(7)
    counts = Counter(k for p in html for k in site_templates.subtree_keys(p))
    expected = {k for k, n in counts.items() if n >= 4}
    (row,) = site_templates.site_templates(pages).collect()
    assert row.pages == 40 and set(row.templates) == expected


def test_copies_of_a_page_are_no_templates(spark):
    own = "<p>" + " ".join(f"word{i}" for i in range(60)) + "</p>"
    boxed = own + "<div>first box of it</div><ul><li>a<li>b</ul>"
    bare = "<body><div><p>only this here</p><p>and that there too</p></div><p>end</p></body>"
    rows = [(i, "http://a.org/", f"<body><div>{page('', boxed)}</div></body>") for i in range(6)]  # wrapped article
    rows += [(10 + i, "http://b.org/", page("", boxed)) for i in range(6)]
    rows += [(20 + i, "http://c.org/", bare) for i in range(6)]
    rows += [(30 + i, "http://d.org/", page("", boxed + f"<p>seen {i} times</p>")) for i in range(6)]  # near copies
    rows += [(40 + i, "http://e.org/", f"<body><div>Notice</div><p>Some text of {i} alone</p></body>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in site_templates.extract_pages(pages).collect()}
    body = own[3:-4] + " first box of it a b"
    for i in range(6):
        assert text[i] == body and text[10 + i] == body
        assert text[20 + i] == "only this here and that there too end"
        assert text[30 + i] == f"{body} seen {i} times"
        assert text[40 + i] == f"Some text of {i} alone"  # what recurs on different pages still goes


def test_templates_need_not_recur_on_a_share_of_the_host(spark):
    rows = [(i, f"http://a.org/{i}", page("", f"<p>This is the own text of page {i}</p><div>notice {i % 20}</div>"))
            for i in range(100)]  # each notice on 5 of 100 pages
    rows += [(100, "http://a.org/", rows[0][2]), (101, "http://b.org/", rows[0][2]), (102, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {}
    for settings in (site_templates.Settings(), site_templates.Settings(listed=3)):
        found[settings.listed] = Counter(map(tuple, site_templates.extract_pages(pages, settings=settings).collect()))
    assert found[1000] == found[3]
    text = {r[0]: r[2] for r in found[3]}
    for i in range(100):
        assert text[i] == f"This is the own text of page {i}"
    assert text[100] == text[0] and text[101] == text[0] + " notice 0" and text[102] == ""


def test_words_in_a_class_do_not_refuse_the_article():
    article = "<p>The whole story of it</p>"
    for body in (f"<div class='content with-sidebar'><article>{article}</article></div>",
                 f"<div class='sidebar'><article>{article}</article></div>",
                 f"<article class='share-enabled'>{article}</article>", f"<article class='post comments'>{article}</article>",
                 f"<div id='social-history'>{article}</div>", f"<div class='menu'>{article}</div>",
                 f"<article>{article}</article><div id='comments'><article>c</article>{article * 3}</div>"):
        text, _ = site_templates.main_text(f"<body><nav>n</nav>{body}</body>", ())
        assert text == "The whole story of it", body
    inside = ("<h1>Paper</h1><p>What was found, at some length</p><section id='related-work'><p>Others</p></section>"
              "<section class='related-posts'>More</section><div class='ad-slot'>Buy</div>")
    assert site_templates.main_text(page("", inside), ())[0] == "Paper What was found, at some length Others"


def test_site_rules_alone_find_the_article(spark):
    """The pages of the table carry one article each; what surrounds it must not come along."""
    pages = table(spark, SF, "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in site_templates.extract_pages(pages).collect():
        inner = html[r.page_id].split("<article>")[1].split("</article>")[0]
        for tag in ("<b>", "</b>"):
            inner = inner.replace(tag, "")
        import html as lib
        import re
        assert r.text == " ".join(lib.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def brute_pairs(chosen, rejected):
    def render(turns):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    def spans(turns):
        out, at = [], 0
        for r, t in turns:
            size = len(render([(r, t)]))
            if r == "assistant":
                out.append(f"{at + size - len(t) - len('<|im_end|>') - 1}-{at + size}")
            at += size
        return ",".join(out)
    same = 0
    while same < min(len(chosen), len(rejected)) and chosen[same] == rejected[same]:
        same += 1
    c, r = chosen[same:], rejected[same:]
    return (render(chosen[:same]), render(c), render(r), spans(c), spans(r), same, len(c), len(r))


def test_preference_pairs(spark):
    rng = random.Random(2)
    sides = {"c": {}, "r": {}}
    for pair in range(40):
        base = [(rng.choice(["system", "user", "assistant"]), rng.choice(["", "x", "é\n", "long " * 9]))
                for _ in range(rng.randint(0, 5))]
        for side in sides:
            sides[side][pair] = base[:rng.randint(0, 5)] + [("assistant", rng.choice("ab"))] * rng.randint(0, 2)
    def frame(side):
        rows = [(p, i, r, t if t else None) for p, turns in sides[side].items() for i, (r, t) in enumerate(turns)]
        return spark.createDataFrame(rows + [(None, 0, "user", "lost")],
                                     "pair_id long, turn long, role string, text string").withColumn("side", F.lit(1))
    got = {r.pair_id: tuple(r)[1:] for r in preference.preference_pairs(frame("c"), frame("r")).collect()}
    assert got == {p: brute_pairs(sides["c"][p], sides["r"][p]) for p in range(40) if sides["c"][p] or sides["r"][p]}
    empty = frame("c").limit(0)
    assert preference.preference_pairs(empty, empty).count() == 0


def test_preference_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    expected = con.sql(queries.ORACLES["op3_preference_pairs"])
    got = queries.op3_preference_pairs(spark, SF).select(*expected.columns)
    assert Counter(map(tuple, got.collect())) == Counter(expected.fetchall())


def test_turns_without_a_number_stay(spark):
    rows = [(1, None, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"),
            (2, None, "assistant", "a"), (2, None, "assistant", "b"), (2, 1, "user", "later"), (3, 1, "user", "alone"),
            (None, 1, "assistant", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    chosen, rejected = ([(r.pair_id, r.role, r.text) for r in side.orderBy("pair_id", "turn").collect()]
                        for side in preference.echo_negatives(turns))
    assert chosen == [(1, "system", "be kind"), (1, "user", "hi"), (1, "assistant", "hello"),
                      (2, "assistant", "a"), (2, "assistant", "b")]
    assert rejected == chosen[:2] + [(1, "assistant", "hi"), (2, "assistant", "a"), (2, "assistant", "a")]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    from ragloom.llm import compression, language, packing
    docs = table(spark, SF, "documents")
    rows = [r for r in docs.collect()]
    kept = {r.doc_id for r in compression.compression_quality(docs).filter("kept").collect()}
    rows = [r for r in rows if r.doc_id in kept]
    named = language.identify_language(docs.filter(F.col("doc_id").isin(list(kept))))
    known = {r.doc_id for r in named.filter("lang_pred <> 'und' and score >= 0.3").collect()}
    rows = [r for r in rows if r.doc_id in known]
    found = brute_components([(r.doc_id, r.text) for r in rows], 5, 80)
    firsts = {k for k, (_, c) in found.items() if k == c}
    expected = packing.pack(docs.filter(F.col("doc_id").isin(list(firsts))))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, expected.select(columns).collect()))
    assert len(corpus_pipeline.STAGES) == 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_templates_remove_most_of_what_is_not_text(spark):
    """Pages of plain boxes: neither tag, role nor class tells the site's parts from the text."""
    menu = "<div><div>Home</div><div>About the makers</div><div>All that we ever wrote</div></div>"
    foot = "<div><p>Words of the owners of this place, the same below each page</p></div>"
    rows = [(i, f"http://site.org/{i}", f"<body>{menu}<div><p>Report number {i} tells of {i * 7} things that happened</p>"
                                        f"<p>and of nothing else that day {i}</p></div>{foot}</body>") for i in range(9)]
    rows += [(20, "http://small.org/1", f"<body>{menu}<div><p>A page of its own here</p></div></body>")]
    found = {r.page_id: r for r in site_templates.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    boilerplate = len("HomeAbout the makersAll that we ever wrote") + len(
        "Words of the owners of this place, the same below each page")
    for i in range(9):
        assert found[i].text == f"Report number {i} tells of {i * 7} things that happened and of nothing else that day {i}"
        assert found[i].template_chars == boilerplate
    # A host of one page has no templates: what is not told by tag, role or class stays.
    assert found[20].template_chars == 0 and found[20].text.startswith("Home About")


def test_raw_elements_end_at_their_end_tag():
    text = site_templates.main_text
    assert text('<article>a <script src="x"/>code</script> b</article>', ())[0] == "a b"
    assert text('<article>a <svg/> b <video src="x"/> c</article>', ())[0] == "a b c"
    assert text("<article>one<!-- gone", ())[0] == "one" and text("<p>x<![CDATA[y z", ())[0] == "xy z"
    assert text("a < b <c", ())[0] == "a < b <c"


def test_parsing_takes_time_in_proportion():
    made = [lambda n: "<div>" * n + "text", lambda n: "<a x=\"1\" y='2' " * n, lambda n: "<p>" + "<table><td>" * n + "<div>x" * n,
            lambda n: "<div>" * n + "<li>x</li>" * n, lambda n: "<!" * n, lambda n: "<article>" * n + "x", lambda n: "<b '" * n + ">"]
    for make in made:
        times = []
        for n in (4000, 16000):
            began = time.process_time()
            site_templates.main_text(make(n), ())
            times.append(time.process_time() - began)
        assert times[1] < 6 * times[0] + 0.2, make(2)


def test_columns_of_any_name_in_the_stages(spark):
    import corpus_pipeline
    words = "these are words of one longer document that tells of many things in turn and of none of them twice over".split()
    rows = [(i, " ".join(words[i % 7:] + [f"word{i}{j}" for j in range(12)]), "en", "x", 1, b"d", "f", "b", 2.0, "t", 5)
            for i in range(12)] + [(3, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _digest binary, "
                                       "_first string, First string, digest double, id string, n int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").collect() == []
        docs = stage(spark, docs, "")
    assert docs.count() == 12


def test_preferences_against_sql_with_turns_without_number(spark):
    import duckdb
    rows = [(1, None, "user", "a"), (1, None, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"),
            (1, 4, "user", "e"), (2, None, "assistant", "x"), (2, None, "user", "y"), (2, 5, "user", "z"),
            (3, 1, "user", "q"), (4, 1, None, None), (4, 2, "assistant", None), (4, 2, "assistant", "two"),
            (None, 1, "assistant", "n"), (5, None, "user", None), (5, 1, "assistant", "r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = preference.preference_pairs(*preference.echo_negatives(turns))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(queries.ORACLES["op3_preference_pairs"])
    assert sorted(map(tuple, got.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)
