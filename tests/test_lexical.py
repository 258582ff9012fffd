import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusrank.functions import text as t
from corpusrank.operators import lexical

WORDS = ["alpha", "beta", "gamma", "delta", "été", "naïve", "straße", "x2", "omega", "art", "cartesian"]


def corpus(docs):
    rows = []
    for i in range(30):
        body = " ".join(WORDS[(i * 7 + j * j) % len(WORDS)] for j in range(5 + i % 9))
        rows.append((f"wiki/p{i:02d}.md", f"Page {WORDS[i % len(WORDS)]}", f"# {WORDS[(i + 3) % len(WORDS)]}\n\n{body}"))
    return docs(*rows)


def asked(spark, *queries):
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id int, query string")


@pytest.mark.parametrize("weights", [lexical.WEIGHTS, lexical.DOCUMENTED_WEIGHTS])
def test_bm25_equals_fts5(spark, docs, weights):
    d = corpus(docs)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, headings, body, tokenize='unicode61 remove_diacritics 2')")
    keys = []
    for r in d.select("path", t.search_title(F.col("title"), F.col("path")), t.heading_lines(F.col("content")), "content").collect():
        keys.append(r[0])
        db.execute("insert into f values (?, ?, ?)", tuple(r)[1:])
    got = {r["key"]: r["score"] for r in lexical.bm25(lexical.index_documents(d), asked(spark, "alpha ETE naive"), None, weights).collect()}
    want = {keys[i - 1]: -s for i, s in db.execute(f"select rowid, bm25(f, {weights[0]}, {weights[1]}, {weights[2]}) from f where f match '\"alpha\" OR \"ete\" OR \"naive\"'")}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rare_terms_rank_first_and_parts_of_words_do_not_match(spark, docs):
    d = docs(("wiki/a.md", "A", "common words here"), ("wiki/b.md", "B", "common words and zebra"), ("wiki/c.md", "C", "common cartesian words"))
    index = lexical.index_documents(d)
    found = lexical.bm25(index, asked(spark, "common zebra", "art")).collect()
    assert [r["key"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 0][0] == "wiki/b.md"
    assert not [r for r in found if r["query_id"] == 1]


def test_a_token_that_the_index_splits_is_a_phrase(spark, docs):
    d = docs(("wiki/a.md", "", "state—of the art"), ("wiki/b.md", "", "of all states, a state"), ("wiki/c.md", "", "a state of mind"))
    keys = {r["key"] for r in lexical.bm25(lexical.index_documents(d), asked(spark, "state—of")).collect()}
    assert keys == {"wiki/a.md", "wiki/c.md"}


@pytest.mark.parametrize(
    ("query", "tokens"),
    [
        ("What is RAG?", ["rag"]),
        ("version 2 of x", ["2", "version"]),
        ("", []),
        (None, []),
        ("?!,.", []),
        ("检索系统", sorted(["检", "检索", "检索系统", "索", "索系", "系", "系统", "统"])),
        ("b a-b b", []),
        ("zeta alpha zeta", ["alpha", "zeta"]),
    ],
)
def test_query_tokens(spark, query, tokens):
    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(t.query_tokens(F.col("q"))).first()[0] == tokens


def test_long_queries_keep_the_first_tokens(spark):
    df = spark.createDataFrame([(" ".join(f"w{i:05d}" for i in range(20_000, 0, -1)),)], "q string")
    got = df.select(t.query_tokens(F.col("q"))).first()[0]
    assert len(got) == 64 and got[-1] == "w20000"


def test_substring_scores_prefer_pages_to_sources(spark, docs):
    d = docs(("wiki/图谱.md", "图谱", "知识图谱 和 检索"), ("raw/sources/图.txt", "图", "知识图谱 和 检索", "source"))
    got = lexical.lexical_lane(lexical.index_documents(d), d, asked(spark, "知识图谱")).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["wiki/图谱.md", "raw/sources/图.txt"]


def test_gate(spark, docs):
    d = corpus(docs)
    index = lexical.index_documents(d)
    cal = lexical.calibrate(index, d)
    assert cal.count() == 30
    fence = lexical.fence(cal, 0.5)
    assert fence > 0 and lexical.fence(cal.where("false")) == 0
    rows = spark.createDataFrame([(fence - 0.1,), (fence,), (None,)], "s double")
    assert [r[0] for r in rows.select(lexical.abstains(F.col("s"), fence)).collect()] == [True, False, True]
    assert not rows.select(lexical.abstains(F.col("s"), 0.0)).first()[0]


def test_empty_corpus_and_null_texts(spark, docs):
    empty = lexical.index_documents(docs(("wiki/a.md", "A", "x")).where("false"))
    assert lexical.bm25(empty, asked(spark, "anything")).count() == 0
    nulls = docs(("wiki/a.md", None, None), ("wiki/b.md", "B", "found"))
    assert [r["key"] for r in lexical.bm25(lexical.index_documents(nulls), asked(spark, "found")).collect()] == ["wiki/b.md"]


HOSTILE = ['"', "' OR 1=1", "NEAR(a b)", "a AND NOT b", "col:val", "*", "^x", "(((", "\0", "-", "， 。", "知识 OR", "{}[]", "%_", "\\"]


def test_hostile_queries_do_not_fail(spark, docs):
    d = corpus(docs)
    assert lexical.lexical_lane(lexical.index_documents(d), d, asked(spark, *HOSTILE)).count() >= 0


def test_only_the_best_of_each_block_are_shuffled(spark, docs, monkeypatch):
    from corpusrank.operators import blocks

    d = docs(*((f"wiki/p{i:03d}.md", f"P{i}", "alpha beta " * (i % 7 + 1)) for i in range(200)))
    sent, best = [], blocks.best

    def counted(queries, score, k, width, digits=None):
        return best(queries, lambda table, pack: sent.append(score(table, pack)) or sent[-1], k, width, digits)

    monkeypatch.setattr(blocks, "best", counted)
    index = lexical.index_documents(d)
    found = lexical.bm25(index, asked(spark, *["alpha beta"] * 5), 3).collect()
    tasks = sent[0].rdd.getNumPartitions()
    assert len(found) == 15 and sent[0].agg(F.sum(F.length("items") / 8)).first()[0] <= 5 * 3 * tasks < 5 * 200
    phrase = lexical.bm25(index, asked(spark, "alpha—beta", "beta—alpha alpha"), None).collect()
    assert {r["query_id"] for r in phrase} == {0, 1} and len([r for r in phrase if r["query_id"] == 0]) == 200


ODD = ["alpha", "alpha beta", "al", "beta alpha", "é", "'", "  ", "知识图谱", "p1", "alpha. beta", "x2 art", "gamma-delta", "P00", "naïve straße"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_substring_scores_equal_brute_force_without_a_cross_join(spark, docs, monkeypatch):
    from corpusrank.operators import blocks

    d = corpus(docs).unionByName(docs(("raw/sources/Alpha Beta.txt", "alpha beta", "Alpha beta alpha beta.\nalpha. Beta", "source"), ("wiki/图谱.md", None, "知识图谱 和 检索"), ("wiki/e.md", "E", None)))
    sent, best = [], blocks.best
    monkeypatch.setattr(blocks, "best", lambda queries, score, k, width, digits=None: best(queries, lambda table, pack: sent.append(score(table, pack)) or sent[-1], k, width, digits))
    got = {(r["query_id"], r["key"]): (r["score"], r["rank"], r["title_match"]) for r in lexical.substring_scores(d, asked(spark, *ODD), 5).collect()}
    read = spark.createDataFrame([(i, q) for i, q in enumerate(ODD)], "i int, q string").select("i", t.query_phrase(F.col("q")), t.query_tokens(F.col("q"))).collect()
    want = {}
    for i, phrase, words in read:
        scored = []
        for path, title, content, kind, *_ in d.collect():
            name, body = path.split("/")[-1].lower(), (content or "").lower()
            head, stem = f"{title or ''} {name}".lower(), name.rsplit(".", 1)[0]
            some = words or [ODD[i].strip().lower()]
            titled, in_title = bool(phrase) and phrase in head, sum(w in head for w in some)
            points = (200 if phrase and stem == phrase else 0) + 50 * titled + 20 * min(10, body.count(phrase) if phrase else 0) + 5 * in_title + sum(w in body for w in some)
            if points:
                scored.append((-round(points * (0.6 if kind == "source" else 1.0), 6), path, titled or in_title > 0))
        want |= {(i, path): (pytest.approx(-s), n, m) for n, (s, path, m) in enumerate(sorted(scored)[:5], 1)}
    assert got == want
    assert "Join" not in plan_of(sent[0]) and sent[0].agg(F.sum(F.length("items") / 8)).first()[0] <= len(ODD) * 5 * sent[0].rdd.getNumPartitions()
