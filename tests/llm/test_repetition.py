import math
import random

import pytest

from corpusrank.llm import queries, repetition
from pyspark.sql import functions as F

SCHEMA = "id long, text string, lang string"


def documents(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))]
        if i % 4 == 0:
            words += words[: len(words) // 2] * rng.randrange(1, 4)
        rows.append((i, ". ".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9)), ["en", "de", "xx", None][i % 4]))
    return rows


def test_measures(spark):
    rows = [(1, "a b c d e f " * 10, "en"), (2, None, "en"), (3, "", None), (4, "one two", "EN "), (5, "Same line.\n\nSame line.\n\nOther one.", "de"), (1, "a b c d e f " * 10, "en"), (None, "x " * 100_000, "fr")]
    got = sorted((tuple(r) for r in repetition.measured(spark.createDataFrame(rows, SCHEMA), "id", "text", "lang").collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == 7 and by[1][2:5] == (60, 56, 6) and by[1][5] == pytest.approx(50 / 56)
    assert by[2][2:] == (0, 0, 0, 0.0, 0.0, 0.0, 0.0) and by[4][1] == "en" and by[3][1] == "other" and by[None][4] == 1
    assert by[5][7] == by[5][8] == pytest.approx(10 / 30)
    assert repetition.measured(spark.createDataFrame([], SCHEMA), "id", "text", "lang").count() == 0


def test_exact_bound():
    assert repetition.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    for x, n in ((0, 40), (3, 50), (17, 90), (60, 100)):
        p = repetition.upper_bound(x, n, 0.01)
        assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)) == pytest.approx(0.01, rel=1e-6)
    assert repetition.upper_bound(1_000_000, 50_000_000, 0.05) == pytest.approx(0.02003, abs=1e-5)
    assert repetition.upper_bound(5, 5, 0.05) == 1.0 and repetition.upper_bound(3, 50, 0.05) == pytest.approx(0.1478, abs=1e-4)


def test_cutoffs_hold_on_held_out_documents(spark):
    m = repetition.measured(spark.createDataFrame(documents(1, 4000), SCHEMA), "id", "text", "lang").withColumn("label", F.expr("10 * (n_sequences - n_distinct) >= 3 * n_sequences"))
    cuts = repetition.certified_cutoffs(m.where("key % 2 = 0"), most=0.05)
    sure = {(s, x): c for s, x, c, *_ in cuts}
    assert sure["other", "short_share"] is not None and sure["other", "short_share"] <= 0.3 and sure["es", "short_share"] is None
    out = repetition.flagged(m.where("key % 2 = 1"), [c for c in cuts if c[1] == "short_share"], ["short_share"])
    good = out.where("not label and stratum = 'other'")
    assert good.where("flag").count() <= 0.05 * good.count() and out.where("label and not flag").count() == 0
    assert out.where("stratum in ('fr', 'es') and flag is not null").count() == 0


def test_small_strata_share_a_cutoff_or_abstain(spark):
    rows = [(f"d{i}", s, 0.0, False) for i, s in enumerate(["de"] * 80 + ["fr"] * 80 + ["es"] * 70 + ["en"] * 400)]
    df = spark.createDataFrame(rows, "key string, stratum string, short_share double, label boolean")
    cuts = {s: (c, n) for s, _, c, _, n, _ in repetition.certified_cutoffs(df, ["short_share"])}
    assert repetition.needed(0.02, 0.05 / 6) == 237 and cuts["en"] == (0.01, 400) and all(cuts[s] == (None, 230) for s in ("de", "fr", "es", "pooled"))
    more = df.unionByName(df.where("stratum = 'de'"))
    cuts = {s: (c, n) for s, _, c, _, n, _ in repetition.certified_cutoffs(more, ["short_share"])}
    assert cuts["de"] == cuts["es"] == cuts["pooled"] == (0.01, 310)


def test_found_documents_pass_the_cutoffs(spark, tmp_path, monkeypatch):
    spark.createDataFrame(documents(2, 1200), SCHEMA).toDF("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    flag = repetition.flagged
    monkeypatch.setattr(repetition, "flagged", lambda *a: seen.append(a[1]) or flag(*a))
    assert queries.p10_found(spark, str(tmp_path)).count() > 100 and any(c[2] is not None for c in seen[0])
    monkeypatch.setattr(repetition, "flagged", lambda df, *_: df.withColumn("flag", F.lit(False)))
    assert queries.p10_found(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shorter_sequences_repeat_at_least_as_much(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcd") for _ in range(rng.randrange(20, 60))]
    share = lambda k: 1 - len(set(zip(*(words[i:] for i in range(k))))) / (len(words) - k + 1)  # noqa: B905, E731
    assert share(3) >= repetition.least_short_share(share(5), len(words)) - 1e-12 >= repetition.least_short_share(share(5), 20) - 1e-12


def test_nothing_is_certified_of_nothing(spark):
    m = repetition.measured(spark.createDataFrame([], SCHEMA), "id", "text", "lang").withColumn("label", F.lit(True))
    assert all(c[2] is None for c in repetition.certified_cutoffs(m))


def test_cases_below_a_high_cutoff_are_found(spark, tmp_path):
    rng = random.Random(5)
    good = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)), "de") for i in range(1000)]
    short = [(2000 + i, "note " * 19, "de") for i in range(24)]
    real = [(3000 + i, " ".join(f"w{i}x{j}" for j in range(12)) + " " + " ".join(f"w{i}x{j}" for j in range(12)), "de") for i in range(6)]
    spark.createDataFrame(good + short + real, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in queries.p10_found(spark, str(tmp_path)).collect()) == [r[0] for r in real]
