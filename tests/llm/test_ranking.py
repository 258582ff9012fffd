import math
import random

from corpusrank.llm import ranking

NAN, INF = float("nan"), float("inf")


def places(values):
    good = {k: v for k, v in values.items() if v is not None and math.isfinite(v)}
    return {k: 1 + sum(w > v for w in good.values()) for k, v in good.items()}


def test_agreement_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for g in range(60):
        for i in range(rng.randrange(1, 12)):
            pick = lambda: rng.choice([None, NAN, INF, -INF, *(rng.randrange(6) / 2 for _ in range(12))])
            rows.append((g, f"i{i}", pick(), pick()))
    rows += [(None, "x", 1.0, 1.0), (1, None, 9.0, 9.0)] + rows[:20]
    best = {}
    for g, i, a, b in rows:
        if g is None or i is None:
            continue
        at = best.setdefault(g, {}).setdefault(i, [None, None])
        for n, v in enumerate((a, b)):
            if v is not None and math.isfinite(v) and (at[n] is None or v > at[n]):
                at[n] = v
    want = set()
    for g, items in best.items():
        p = [places({k: v[n] for k, v in items.items()}) for n in (0, 1)]
        hits = [k for k in items if p[0].get(k, 9) <= 2 and p[1].get(k, 9) <= 2]
        if len(hits) == 1:
            want.add((g, hits[0]))
    df = spark.createDataFrame(rows, "g int, item string, a double, b double").selectExpr("*", "1 as closeness")
    scored = ranking.ideal_point(df, "g", "item", ["a", "b"])
    assert {(r["group"], r["item"]) for r in ranking.agreed(scored, ["a", "b"]).collect()} == want
    assert scored.count() == sum(map(len, best.values()))


def test_scale_does_not_matter(spark):
    rows = [("x", 1.0, 9.0), ("y", 2.0, 8.0), ("z", 3.0, 1.0)]
    order = lambda f: [r["item"] for r in ranking.ranked(ranking.ideal_point(spark.createDataFrame([(1, i, a * f, b) for i, a, b in rows], "g int, item string, a double, b double"), "g", "item", ["a", "b"])).orderBy("rank").collect()]
    assert order(1.0) == order(1e200) == order(1e-200) and order(1.0)[0] == "y"


def test_a_hot_group_is_ranked_whole(spark):
    rows = [(1, f"i{i:05d}", float(i % 97), float(i % 89)) for i in range(5000)] + [(2, "only", 1.0, None), (3, "flat", 0.0, 0.0), (3, "flat2", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, item string, a double, b double")
    out = ranking.ranked(ranking.ideal_point(df, "g", "item", ["a", "b"])).collect()
    hot = sorted((r for r in out if r["group"] == 1), key=lambda r: (-r["closeness"], r["item"]))
    assert [r["rank"] for r in hot] == list(range(1, 5001))
    assert {r["item"]: (r["closeness"], r["rank"]) for r in out if r["group"] != 1} == {"only": (0.0, 1), "flat": (0.0, 1), "flat2": (0.0, 2)}
    assert ranking.ideal_point(df.where("false"), "g", "item", ["a", "b"]).count() == 0


def test_items_at_the_top_of_all_scores_are_among_the_closest(spark):
    rng = random.Random(4)
    rows = [(g, f"i{i}", rng.choice([None, float("nan"), *map(float, range(6))]), rng.gauss(0, 1) * 10 ** rng.randrange(4)) for g in range(150) for i in range(rng.randrange(1, 14))]
    scored = ranking.ideal_point(spark.createDataFrame(rows, "g int, i string, a double, b double"), "g", "i", ["a", "b"])
    by = {}
    for r in scored.collect():
        by.setdefault(r["group"], []).append(r)
    for items in by.values():
        for r in items:
            if r["top_a"] and r["top_b"]:
                assert sum(o["closeness"] > r["closeness"] + 1e-9 for o in items) <= 2
    broken = scored.withColumn("closeness", -scored["closeness"])
    assert ranking.agreed(broken, ["a", "b"]).count() < ranking.agreed(scored, ["a", "b"]).count()


def test_winsor_cuts_are_exact_ranks(spark):
    values = [float(x) for x in range(1, 41)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(1, f"i{v}", v) for v in values], "g int, i string, a double")
    cuts = ranking._cuts(df.toDF("group", "item", "a"), ["a"], 0.05, 2).first()
    assert (cuts["low_cut_a"], cuts["high_cut_a"], cuts["least_a"]) == (2.0, 38.0, 39.0)
