import random
import math
from collections import Counter

import numpy as np
import pytest

from corpusrank.llm import terms

ROWS = [("a", "Graph graph", "the graph of the co\u00adffee"), ("b", None, "the e\u0301cole 42nd x2y"), ("c", "", None), ("d", "\u00c9cole", "the the caf\u200b\u00e9"), ("d", "\u00c9cole", "the the caf\u200b\u00e9")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(k, t, c, "z") for k, t, c in ROWS], "path string, title string, content string, term string")


def test_frequencies(table):
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.term_frequencies(table, ["title", "content"]).collect()}
    each = [Counter(terms.terms_of(t) + terms.terms_of(c)) for _, t, c in ROWS]
    want = {w: (sum(e[w] for e in each), sum(w in e for e in each)) for e in each for w in e}
    assert {w: v[:2] for w, v in got.items()} == want
    assert got["the"] == (7, 4, "common") and got["\u00e9cole"] == (3, 3, "common") and got["coffee"][2] == "rare" and got["nd"][2] == "rare" and got["caf\u00e9"][1] == 2
    assert terms.term_frequencies(table.where("false"), ["title"]).count() == 0


def test_bitmaps():
    sparse, dense = np.arange(0, 60_000, 100), np.arange(0, 60_000, 3)
    for a, b in ((sparse, dense), (sparse, sparse + 1), (dense, dense)):
        joined = terms.union(terms._container(a), terms._container(b))
        assert terms.cardinality(joined) == len(np.union1d(a, b)) and (terms._records(joined) == np.union1d(a, b)).all()


def test_bitmaps_of_several_flushes(spark, monkeypatch):
    monkeypatch.setattr(terms, "FLUSH_POSTINGS", 7)
    df = spark.createDataFrame([(f"every w{chr(97 + i % 20)}",) for i in range(300)], "content string")
    got = {r["term"]: r["records"] for r in terms.term_frequencies(df, ["content"]).collect()}
    assert got["every"] == 300 and got["wa"] == 15


def test_scores(table):
    got = {(r["doc"], r["term"]): r for r in terms.characteristic_terms(table, "path", ["title", "content"]).collect()}
    r = got["a", "graph"]
    lengths = [len(terms.terms_of(t) + terms.terms_of(c)) for _, t, c in ROWS]
    tfn, rate = 3 * math.log2(1 + np.mean(lengths) / lengths[0]), 3 / 5
    assert r["df"] == 1 and r["score"] == pytest.approx((math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1))
    assert r["score"] > got["a", "the"]["score"]
    few = terms.characteristic_terms(table, "path", ["title", "content"], least_tf=2).collect()
    assert {(x["doc"], x["term"]): x["score"] for x in few}.items() <= {k: x["score"] for k, x in got.items()}.items()


def test_values_are_summed_and_hubs_fade(spark):
    rows = [("d0", "hub", 1), ("d0", "rare", 2), ("d0", "rare", 3), ("d1", "rare", 1), ("d0", "x", 0), ("d0", "x", None), (None, "x", 3), ("d1", None, 3), ("d2", "x", -1)] + [(f"e{i}", "hub", 5) for i in range(50)]
    df = spark.createDataFrame(rows, "doc string, term string, tf int")
    got = {(r["doc"], r["term"]): r for r in terms.characteristic_values(df, "doc", "term", "tf").collect()}
    assert len(got) == 53 and got["d0", "rare"]["tf"] == 5 and got["d0", "rare"]["df"] == 2 and got["d0", "hub"]["df"] == 51
    assert got["d0", "rare"]["score"] > got["e1", "hub"]["score"]


@pytest.mark.parametrize("path", ["Wiki\\A\\B.MD", " wiki/a/b ", "wiki/a/b.md", "WIKI/a/b"])
def test_spellings_of_a_path(spark, path):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(terms.same_path(df["p"])).first()[0] == "wiki/a/b.md"


def test_rare_terms_are_never_below_the_bound(spark):
    rng = random.Random(6)
    rows = [(f"d{d}", f"t{min(int(rng.expovariate(0.05)), 400)}", rng.choice([1, 1, 2, 5, 40, 3000])) for d in range(60) for _ in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "d string, t string, n int")
    every = {(r["doc"], r["term"]): r["df"] for r in terms.characteristic_values(df, "d", "t", "n").collect()}
    kept = {(r["doc"], r["term"]) for r in terms.characteristic_values(df, "d", "t", "n", most_df=5).collect()}
    rare = {k for k, n in every.items() if n <= 5}
    assert rare <= kept and len(kept) < len(every)
    assert terms.characteristic_values(df, "d", "t", "n", most_df=0).count() == 0
