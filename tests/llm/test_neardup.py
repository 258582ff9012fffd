import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from corpusrank.llm import neardup
from corpusrank.llm.arrays import WORD


def sets_of(rows, k, least):
    out = {}
    for key, text in rows:
        w = WORD.findall((text or "").lower())
        if len(w) >= max(least, k):
            out[key] = set(zip(*(w[i:] for i in range(k)), strict=False))
    return out


def brute(rows, k, t, least=0):
    s = sets_of(rows, k, least)
    return {tuple(sorted((a, b))) for a, b in combinations(s, 2) if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


def texts(seed, n, vocabulary=40, copies=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < copies:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(0, 3)] = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 3))]
            w = w or ["x"]
        else:
            w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(5, 60))]
        rows.append((f"k{i:04d}", " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "t"), [(1, 3, 0.5), (2, 5, 0.8), (3, 1, 0.6), (4, 2, 1.0)])
def test_pairs_equal_brute_force(spark, seed, k, t):
    rows = texts(seed, 250)
    got = {(r["key_a"], r["key_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "key string, text string"), "key", "text", k, t).collect()}
    assert got == brute(rows, k, t)


def test_hot_tokens_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_ROWS", 8)
    rows = texts(5, 200, vocabulary=4, copies=0.2)  # every sequence is common
    df = spark.createDataFrame(rows, "key string, text string")
    got = {(r["key_a"], r["key_b"]) for r in neardup.similar_pairs(df, "key", "text", 2, 0.7).collect()}
    assert got == brute(rows, 2, 0.7)


def test_copies_are_one_class(spark):
    rows = [(f"c{i}", "one two three four five six seven") for i in range(300)] + [("d", "one two three four five six seven eight"), ("e", "other words that nobody else uses here")]
    df = spark.createDataFrame(rows, "key string, text string")
    members, links = neardup.near_duplicates(df, "key", "text", 2, 0.8)
    assert members.count() == 302 and members.select("rid").distinct().count() == 3
    assert [(r["overlap"], r["n_union"]) for r in links.collect()] == [(6, 7)]
    groups = {r["key"]: (r["group_id"], r["n_links"]) for r in neardup.duplicate_groups(df, "key", "text", 2, 0.8).collect()}
    assert groups["c0"] == groups["c299"] and groups["d"][0] == groups["c0"][0] and groups["e"][1] == 0 and groups["c5"][1] == 1


def test_nulls_short_texts_and_clashing_columns(spark):
    rows = [("a", None, "x"), ("b", "", "x"), ("c", "too short", "x"), (None, "w1 w2 w3 w4 w5 w6", "x"), ("e", "w1 w2 w3 w4 w5 w6", "x")]
    df = spark.createDataFrame(rows, "key string, text string, rid string").withColumnRenamed("rid", "tokens")
    members, links = neardup.near_duplicates(df, "key", "text")
    assert {r["key"] for r in members.collect()} == {None, "e"} and links.count() == 0
    assert neardup.similar_pairs(df, "key", "text").count() == 0  # a null key is no partner
    assert neardup.similar_pairs(df.where("false"), "key", "text").count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i % 9000}" for i in range(120_000))
    df = spark.createDataFrame([("a", long), ("b", long + " end"), ("c", "w1 w2")], "key string, text string")
    assert [(r["key_a"], r["key_b"]) for r in neardup.similar_pairs(df, "key", "text", 3, 0.5).collect()] == [("a", "b")]


@pytest.mark.parametrize("seed", range(8))
def test_the_trie_finds_what_counting_finds(seed):
    rng = random.Random(seed)
    t = Fraction(rng.choice([1, 2, 3, 4]), 5)
    record = np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), dtype=np.uint64)
    base = [sorted(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(10)]
    partners = [(i, np.array(sorted(set(rng.choice(base)[: rng.randrange(1, 40)]) | set(rng.sample(range(60), rng.randrange(0, 6))) or {1}), dtype=np.uint64)) for i in range(120)]
    partners += [(1000 + i, np.array(sorted((set(record.tolist()) | {i}) - {i + 1}), dtype=np.uint64)) for i in range(5)]
    want = {(i, o, u) for i, p in partners if (o := len(set(p.tolist()) & set(record.tolist()))) >= t * (u := len(set(p.tolist()) | set(record.tolist())))}
    assert set(neardup._traversed(record, partners, t)) == want and want


def test_records_of_many_partners_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PARTNERS", 16)
    words = [f"w{i}" for i in range(40)]
    rows = [("hub", " ".join(words))] + [(f"k{i:03d}", " ".join(words + [f"x{i}"])) for i in range(120)] + [(f"c{i:03d}", " ".join(words)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, text string")
    got = sorted((r["key_a"], r["key_b"]) for r in neardup.similar_pairs(df, "key", "text", 3, 0.9).collect())
    assert got == sorted(brute(rows, 3, 0.9)) and len(got) == 161 * 160 // 2


def test_a_crowded_sketch_does_not_split_everything(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_MOST_BITS", 16)
    rng = random.Random(3)
    rows = [(f"k{i}", "everyone says this " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(600))) for i in range(800)]
    sets = neardup.token_sets(spark.createDataFrame(rows, "key string, text string"), 3, 3)
    tokens = sum(r["n"] for r in sets.collect())
    ranks = neardup.token_order(sets, tokens)
    assert len(ranks) == 1 << 16 and tokens >> 16 >= 7  # every counter holds seven tokens
    counts = neardup._least_count(ranks)
    assert np.median(counts) < 7 and (counts > 400).sum() == 1  # the one common sequence stands out
