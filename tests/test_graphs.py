import math
import re

import pytest
from pyspark.sql import functions as F

from corpusrank.operators import checks, diffusion, fusion, linkgraph, vectors
from corpusrank.operators.graphs import connected_components
from corpusrank.operators.skew import group_positions, join_statistics, numbered_copies


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_links_resolve_by_every_alias(docs):
    d = docs(
        ("wiki/a.md", "First Page", "x", "wiki", ["b-two", "C Title", "nothing", "a"], ["s.pdf"], "note"),
        ("wiki/b-two.md", "B", "x", "wiki", ["wiki/a.md"], ["S.pdf"], "note"),
        ("wiki/sub/c.md", "C Title", "x", "wiki", [], [], ""),
        ("raw/sources/s.md", "s", "x", "source", ["a"], [], ""),
    )
    edges = linkgraph.link_edges(d)
    assert rows(edges, "src", "dst") == [("wiki/a.md", "wiki/b-two.md"), ("wiki/a.md", "wiki/sub/c.md"), ("wiki/b-two.md", "wiki/a.md"), ("wiki/sub/c.md", "wiki/a.md")]
    weight = {(r["src"], r["dst"]): r["weight"] for r in linkgraph.relevance(d, edges, edges).collect()}
    assert weight["wiki/a.md", "wiki/b-two.md"] == 3 + 4 + 1 and weight["wiki/a.md", "wiki/sub/c.md"] == 3
    related = linkgraph.related_pages(d, d.where("path = 'wiki/b-two.md'").selectExpr("path src"))
    assert [(r["dst"], round(r["weight"], 6)) for r in related.orderBy("rank").collect()] == [("wiki/a.md", 8.0), ("wiki/sub/c.md", round(1.5 / math.log(2), 6))]


def test_mentions_equal_a_regular_expression(docs):
    texts = ["Ada Lovelace met ada lovelace, not Adalovelace. Ada alone.", "ada-lovelace and Ada\nLovelace; Lovelace's", "", "Analytical Engine Analytical Engine Two", None]
    pages = [("wiki/ada-lovelace.md", "Ada Lovelace", texts[0]), ("wiki/ada.md", "Ada", texts[1]), ("wiki/engine.md", "Analytical Engine", texts[3]), ("wiki/e2.md", "Analytical Engine Two", texts[4])]
    d = docs(*pages)
    forms = {}
    for path, title, _ in sorted(pages):
        stem = path.split("/")[-1][:-3]
        for f in (title, stem, stem.replace("-", " ")):
            if len(f) >= 3:
                forms.setdefault(f.lower(), path)
    pattern = re.compile("|".join(rf"\b{re.escape(f)}\b" for f in sorted(forms, key=len, reverse=True)), re.I)
    want = {}
    for path, _, text in pages:
        for m in pattern.finditer(text or ""):
            key = (forms[m[0].lower()], path)
            want[key] = want.get(key, 0) + 1
    for path, _, _ in pages:
        want.setdefault((path, path), 1)
    assert {(r["entity"], r["key"]): r["tf"] for r in linkgraph.scanned_mentions(d).collect()} == want


def test_hubs_are_pruned_and_edges_sparse(spark):
    m = spark.createDataFrame([("hub", f"d{i}", 1) for i in range(8)] + [("rare", "d0", 2), ("rare", "d1", 1)] + [(f"e{i}", "d0", i + 1) for i in range(6)], "entity string, key string, tf long")
    assert rows(linkgraph.hubs(m, 8), "entity") == [("hub",)]
    kept = linkgraph.without_hubs(m, 8)
    edges = linkgraph.mention_edges(kept, 8)
    assert edges.where("src = 'd0'").count() == 4
    w = {(r["entity"], r["key"]): r["weight"] for r in linkgraph.mention_weights(kept, 8).collect()}
    assert w["rare", "d0"] == pytest.approx(2 * math.log(9 / 3) + 1)


def walk(spark, edges, seeds, **more):
    e = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src string, dst string, weight double")
    s = spark.createDataFrame(seeds, "query_id int, node string, mass double")
    return diffusion.pagerank(s, linkgraph.transitions(e), **more)


def test_mass_is_kept_and_spreads(spark):
    out = walk(spark, [("a", "b", 1.0), ("b", "c", 2.0)], [(1, "a", 1.0), (1, "alone", 1.0), (2, "c", 5.0)]).collect()
    for q in (1, 2):
        assert sum(r["mass"] for r in out if r["query_id"] == q) == pytest.approx(1, abs=1e-9)
    assert {r["node"] for r in out if r["query_id"] == 2} == {"a", "b", "c"}


def test_both_ways_of_walking_agree(spark):
    edges = [(f"n{i}", f"n{(i * 7 + 3) % 23}", 1.0 + i % 3) for i in range(23)]
    seeds = [(q, f"n{(q * 5 + j) % 30}", 1.0 / (j + 1)) for q in range(4) for j in range(3)]
    a = {(r["query_id"], r["node"]): r["mass"] for r in walk(spark, edges, seeds, rounds=5, tolerance=0).collect()}
    b = {(r["query_id"], r["node"]): r["mass"] for r in walk(spark, edges, seeds, rounds=5, tolerance=0, kernel_rows=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_ranking_by_mass_drops_nothing(spark):
    fused = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "query_id int, key string, rank int")
    keep = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "key string")
    mass = walk(spark, [("x", "w", 1.0), ("w", "@entity/e", 1.0)], [(1, "x", 1.0)])
    got = [(r["key"], r["score"] > 0) for r in diffusion.ranked_by_mass(mass, fused, keep, None).orderBy("rank").collect()]
    assert set(got[:2]) == {("x", True), ("w", True)} and got[2:] == [("y", False), ("z", False)]


def test_fusion_constant_matters(spark):
    a = spark.createDataFrame([(1, "certain", 1), (1, "lukewarm", 10)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "lukewarm", 10), (1, "unknown", 1)], "query_id int, key string, rank int")
    known = spark.createDataFrame([("certain",), ("lukewarm",)], "key string")
    first = lambda k: fusion.fuse([(a, 1.0), (b, 1.0)], known, k).where("rank = 1").first()["key"]
    assert first(3) == "certain" and first(60) == "lukewarm"


def test_vector_lane(spark):
    c = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("p", 1, [0.0, 1.0]), ("q", 0, [3.0, 4.0]), ("r", 0, [1.0]), ("s", 0, None), ("t", 0, [0.0, 0.0])], "page_id string, chunk_index int, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id int, vector array<float>")
    hits = vectors.nearest_chunks(c, q, 10)
    assert [(r["page_id"], round(r["score"], 6)) for r in hits.orderBy("rank").collect()] == [("p", 1.0), ("q", 0.6), ("p", 0.0), ("t", 0.0)]
    assert [(r["page_id"], r["chunks"]) for r in vectors.pages_of(hits).orderBy("rank").collect()] == [("p", [0, 1]), ("q", [0]), ("t", [0])]


def test_store_tables(spark):
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "page_id string, x int")
    new = spark.createDataFrame([("a", 9)], "page_id string, x int")
    assert rows(vectors.upserted(stored, new), "page_id", "x") == [("a", 9), ("b", 3)]
    assert rows(vectors.pruned(stored, new), "x") == [(1,), (2,)] and rows(vectors.dropped(stored, new), "x") == [(3,)]


def test_checks_see_what_is_wrong(spark, docs):
    d = docs(("wiki/a.md", "A", ""), ("wiki/a.md", "A", ""), ("", "", ""))
    bad = spark.createDataFrame([("a", "b", 1.0), ("a", "a", -1.0), ("b", "c", float("nan"))], "src string, dst string, weight double")
    found = {r["check"]: r["violations"] for r in checks.conformance(d, bad).collect()}
    assert found["keys are unique"] == 1 and found["keys are not empty"] == 1 and found["weights are finite"] == 1
    assert found["edges lead elsewhere"] == 1 and found["weights are positive"] == 1 and found["edges go both ways"] == 2
    good = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    assert not any(r["violations"] for r in checks.conformance(docs(("wiki/a.md", "A", "")), good).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_positions_and_statistics_of_hot_groups(spark):
    data = [("hot", i % 500, i) for i in range(3000)] + [("cold", 1, 9000)] + [(None, 1, 9001)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    got = {(r["g"], r["id"]): r["place"] for r in group_positions(df, "g", ["v", "id"], "place").where("g is not null").collect()}
    want = {("hot", i): n for n, (_, i) in enumerate(sorted((v, i) for g, v, i in data if g == "hot"), 1)}
    assert got == {**want, ("cold", 9000): 1}
    stats = spark.createDataFrame([("hot", 3000, "h"), ("cold", 1, "c")], "g string, n long, s string")
    joined = join_statistics(df, stats, "g", "n", df["id"], share=10, salts=8)
    assert rows(joined.groupBy("g").count(), "g", "count") == [("cold", 1), ("hot", 3000)]


def test_counts_and_copies_of_hot_groups(spark):
    rows = spark.range(5000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id % 50 as string) end g", "id % 7 v")
    placed = group_positions(rows, "g", ["v"], "at", "n")
    want = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    assert all(r["n"] == want[r["g"]] and 1 <= r["at"] <= r["n"] for r in placed.collect())
    assert placed.select("g", "at").distinct().count() == 5000 and set(placed.columns) == {"g", "v", "at", "n"}
    copies = numbered_copies(rows.unionAll(spark.createDataFrame([(None, None)] * 3, "g string, v long")), "copy", at_once=100)
    assert copies.count() == 5003 and copies.distinct().count() == 5003
    got = copies.groupBy("g", "v").agg(F.max("copy").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["m"] + 1 == r["n"] for r in got)


@pytest.mark.parametrize("tolerance", [0, 1e-3])
def test_both_ways_of_walking_stop_each_query_alike(spark, tolerance):
    edges = [(f"n{i}", f"n{(i * 7 + k) % 40}", 1.0 + k) for i in range(40) for k in range(3)] + [("a", "b", 1.0), ("b", "a", 1.0)]
    moves = linkgraph.transitions(spark.createDataFrame(edges, "src string, dst string, weight double"))
    seeds = spark.createDataFrame([(1, "n1", 1.0), (1, "n9", 0.5), (2, "a", 1.0), (3, "nowhere", 1.0), (4, "n3", 1.0)], "query_id int, node string, mass double")
    walked = [{(r["query_id"], r["node"]): r["mass"] for r in diffusion.pagerank(seeds, moves, rounds=12, tolerance=tolerance, kernel_rows=n).collect()} for n in (10**6, 0)]
    assert walked[0].keys() == walked[1].keys() and all(walked[1][k] == pytest.approx(m, abs=1e-12) for k, m in walked[0].items())


def test_nearest_chunks_are_those_of_brute_force(spark, monkeypatch):
    import numpy as np

    from corpusrank.operators import blocks

    rng = np.random.default_rng(5)
    v, q = np.round(rng.normal(size=(900, 6)), 1), np.round(rng.normal(size=(7, 6)), 1)
    v[300:600] = v[:300]  # ties
    c = spark.createDataFrame([(f"p{i % 40:02d}", i, [float(x) for x in r]) for i, r in enumerate(v)], "page_id string, chunk_index int, vector array<float>")
    asked = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id int, vector array<float>")
    sent, best = [], blocks.best
    monkeypatch.setattr(blocks, "best", lambda queries, score, k, width, digits=None: best(queries, lambda table, pack: sent.append(score(table, pack)) or sent[-1], k, width, digits))
    got = {(r["query_id"], r["rank"]): (r["page_id"], r["chunk_index"]) for r in vectors.nearest_chunks(c, asked, 12).collect()}
    v32, q32 = v.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    cos = (q32 / np.linalg.norm(q32, axis=1)[:, None]) @ (v32 / np.linalg.norm(v32, axis=1)[:, None]).T
    for i in range(7):
        first = sorted(range(900), key=lambda j: (-round(cos[i, j], 12), f"p{j % 40:02d}", j))[:12]
        assert [got[i, n + 1] for n in range(12)] == [(f"p{j % 40:02d}", j) for j in first]
    assert sent[0].agg(F.sum(F.length("items") / 8)).first()[0] <= 7 * 12 * sent[0].rdd.getNumPartitions()


def test_ranking_takes_only_the_best_masses_from_the_walk(spark):
    edges = [(f"n{i:02d}", f"n{(i * 7 + 3) % 60:02d}", 1.0 + i % 3) for i in range(60)] + [(f"n{i:02d}", f"n{i + 1:02d}", 0.7) for i in range(59)]
    mass = walk(spark, edges, [(1, "n01", 1.0), (1, "out", 0.5), (2, "n40", 1.0)])
    keep = spark.createDataFrame([(f"n{i:02d}",) for i in range(0, 60, 2)] + [("out",)], "key string")
    fused = spark.createDataFrame([(1, "n01", 1), (1, "out", 2), (2, "n40", 1), (3, "n02", 1)], "query_id int, key string, rank int")
    cut = mass.best(keep, 4)
    assert cut.where("query_id = 2").count() < 15 < mass.where("query_id = 2").count()
    whole = spark.createDataFrame(mass.collect(), mass.schema)
    assert rows(diffusion.ranked_by_mass(mass, fused, keep, 4), "query_id", "key", "rank") == rows(diffusion.ranked_by_mass(whole, fused, keep, 4), "query_id", "key", "rank")


def test_related_pages_are_cut_where_they_are_made(spark, docs):
    pages = [(f"wiki/p{i:02d}.md", f"T{i}", "x", "wiki", [f"p{j:02d}" for j in {(i * 3) % 40, (i * 7 + 1) % 40, 0}], [f"s{i % 9}.pdf", f"s{i % 4}.pdf"][: i % 3], ["", "note", "idea", None][i % 4]) for i in range(40)]
    d = docs(*pages)
    of = d.selectExpr("path src")
    got = linkgraph.related_pages(d, of, 5)
    joined = linkgraph.related_pages(d, of, 5, kernel_rows=0)
    places = lambda f: {(r["src"], r["rank"]): (r["dst"], pytest.approx(r["weight"], abs=1e-9)) for r in f.collect()}
    assert places(got) == places(joined) and got.count() == 200
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
