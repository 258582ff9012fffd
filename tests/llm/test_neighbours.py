import numpy as np

from corpusrank.llm import neighbours


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([c + 0.25 * rng.standard_normal((10, 32)) for c in centres] + [rng.standard_normal((200, 32))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    got = {(r["probe_id"], r["neighbour_id"]) for r in neighbours.similar_vectors(df).collect()}
    true = {(r["probe_id"], r["neighbour_id"]) for r in neighbours.exact_neighbours(df, df, block=100).collect()}
    f = x.astype(np.float32).astype(np.float64)
    u = f / np.linalg.norm(f, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    brute = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85}
    assert true == brute and len(got & true) >= 0.98 * len(true) and len(true) > 1000


def test_copies_ties_nulls_and_dims(spark):
    copies = [(i, [1.0, 0.0, 0.0]) for i in range(100, 0, -1)]
    odd = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [float("nan"), 1.0, 0.0]), (203, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0]), (204, [1.0, 0.0]), (205, []), (1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(copies + odd, "id long, vector array<float>").selectExpr("*", "id as kind", "1 as cls")
    probe = spark.createDataFrame([("query", 1, [5.0, 0.1, 0.0]), ("query", 2, None)], "kind string, id long, vector array<float>")
    out = neighbours.similar_vectors(df, probe).collect()
    near = lambda k, i: sorted(r["neighbour_id"] for r in out if r["probe_kind"] == k and r["probe_id"] == i)
    assert near("item", 50) == [1, 2, 3, 4, 5] and near("item", 2) == [1, 3, 4, 5, 6] and near("query", 1) == [1, 2, 3, 4, 5]
    assert near("item", 204) == [] and near("query", 2) == [] and not [r for r in out if r["probe_id"] in (None, 200, 201, 202, 203, 205)]
    assert neighbours.similar_vectors(df.where("false")).count() == 0


def test_logged_probes_meet_items_in_many_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    near = [("query", i, [float(v) for v in x[i] + 0.3 * rng.standard_normal(64)]) for i in range(0, 1500, 5)]
    probes = spark.createDataFrame(near, "kind string, id long, vector array<float>")
    out = neighbours.similar_vectors(items, probes, leaf_rows=256).where("probe_kind = 'query'")
    assert out.where("probe_id = neighbour_id").count() >= 0.98 * len(near)


def test_near_copies_that_are_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(64) + 0.2 * rng.standard_normal((2500, 64))
    x = np.concatenate([hot, rng.standard_normal((5000, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    asked = spark.createDataFrame([("query", i, [float(v) for v in hot[i] + 0.01]) for i in range(50)], "kind string, id long, vector array<float>")
    got = {(r["probe_kind"], r["probe_id"], r["neighbour_id"]) for r in neighbours.similar_vectors(df, asked).collect()}
    f = x.astype(np.float32).astype(np.float64)
    u = f / np.linalg.norm(f, axis=1)[:, None]
    s = u[:2500] @ u.T
    s[np.arange(2500), np.arange(2500)] = -2
    best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :5]
    true = {("item", i, int(j)) for i in range(2500) for j in best[i] if s[i, j] >= 0.85}
    assert len(true) == 12500 and len(got & true) >= 0.999 * len(true)
    a = np.stack([np.array(r["vector"]) for r in asked.orderBy("id").collect()])
    near = np.argsort(-(a / np.linalg.norm(a, axis=1)[:, None] @ u.T), axis=1, kind="stable")[:, :5]
    assert {("query", i, int(j)) for i in range(50) for j in near[i]} <= got


def test_exact_comparison_gathers_nothing_in_the_driver(spark):
    rng = np.random.default_rng(5)
    x, y = ([*rng.standard_normal((n, 8)), *rng.standard_normal((n // 2, 5))] for n in (60, 3000))
    x += [rng.standard_normal(3)]  # no item has that length
    probes = spark.createDataFrame([(-i, [float(v) for v in r]) for i, r in enumerate(x, 1)], "cls long, vector array<float>")
    items = spark.createDataFrame([(i, -i, [float(v) for v in r]) for i, r in enumerate(y)], "cls long, low long, vector array<float>")
    out = neighbours._in_blocks(probes, items, len(x), len(y), 5, 0.5, probe_block=16, item_block=64)
    got: dict[int, list[tuple[float, int]]] = {}
    for r in out.collect():
        got.setdefault(-r["p"] - 1, []).append((-round(r["cosine"], 9), -r["q"]))
    unit = lambda v: (f := v.astype(np.float32).astype(np.float64)) / np.linalg.norm(f)
    for i, v in enumerate(x):
        true = sorted((-round(c, 9), -j) for j, w in enumerate(y) if len(w) == len(v) and (c := float(unit(v) @ unit(w))) >= 0.5)[:5]
        assert [q for _, q in sorted(got.get(i, []))[:5]] == [q for _, q in true]
    # the probes are few, but not their copies for every block of items
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    turns = neighbours._in_blocks(probes, items, len(x), len(y), 5, 0.5, probe_block=16, item_block=64, in_turn=2)
    key = lambda rows: sorted((r["p"], r["q"], round(r["cosine"], 9)) for r in rows)
    assert key(turns.collect()) == key(out.collect())
