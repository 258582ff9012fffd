import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusrank.operators import context, metrics, oplog
from corpusrank.operators.incremental import IncrementalState, Interrupted
from corpusrank.plans import ingest, ladder, profiles
from corpusrank.sources import corpus, embedding
from corpusrank.streaming.index import PageStore
from tests.conftest import SMALL


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows_of(spark, *rows, start=0):
    return spark.createDataFrame([(k, v, i, "extra", "x") for i, (k, v) in enumerate(rows, start)], "k string, v string, i int, bucket string, base string")


def changed(state, run=None):
    return sorted((r["run"], r["k"], r["v"] or "") for r in state.changes().collect() if run in (None, r["run"]))


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("die", ["changes", "state"])
def test_changes_survive_every_failure(spark, tmp_path, die, whole):
    first, second, third = [("a", "1"), ("b", "1"), (None, "x"), ("a", "1")], [("a", "2")], [("c", None), ("b", "1")]
    s = IncrementalState(spark, str(tmp_path), "k", ["v"], ["i"], bucket_rows=1)
    s.run(1, rows_of(spark, *first), whole)
    seen = rows_of(spark, *first, *second) if whole else rows_of(spark, *second, start=4)
    with pytest.raises(Interrupted):
        s.run(2, seen, whole, die_after=die)
    with pytest.raises(Interrupted):  # a failure that undoes nothing of the one before
        s.run(2, seen, whole, die_after="state")
    everything = rows_of(spark, *first, *second, *third)
    s.run(3, everything if whole else rows_of(spark, *second, *third, start=4), whole)
    assert changed(s) == [(1, "a", "1"), (1, "b", "1"), (3, "a", "2"), (3, "c", "")]
    assert s.run(3, rows_of(spark, *first), whole) == [] and s.committed() == [1, 3]
    if whole:
        assert s.run(4, everything, whole) == []  # equal fingerprints: nothing is read again
        s.run(5, rows_of(spark, *first), whole)  # a value that goes back is a change
        assert changed(s, 5) == [(5, "a", "1")]
    else:
        s.run(4, rows_of(spark, *first))  # older rows delivered again
        assert changed(s, 4) == []


@pytest.mark.parametrize("die", ["changes", "state"])
def test_a_retry_with_other_rows_keeps_nothing_of_the_dead_attempt(spark, tmp_path, die):
    s = IncrementalState(spark, str(tmp_path), "k", ["v"], ["i"], bucket_rows=1, most_buckets=4)
    s.run(0, rows_of(spark, *((x, "1") for x in "abcdefgh")))
    with pytest.raises(Interrupted):
        s.run(1, rows_of(spark, ("a", "2"), start=10), die_after=die)
    s.run(1, rows_of(spark, ("b", "2"), start=10))
    assert changed(s, 1) == [(1, "b", "2")]
    s.run(2, rows_of(spark, ("a", "2"), ("b", "2"), start=20))  # the state did not take over the dead a
    assert changed(s, 2) == [(2, "a", "2")]


def test_a_crash_while_buckets_are_replaced_is_made_good(spark, tmp_path):
    s = IncrementalState(spark, str(tmp_path), "k", ["v"], ["i"], bucket_rows=1)
    s.run(0, rows_of(spark, *((x, "1") for x in "abcdefgh")))
    s._forget = lambda attempt: None  # died before the end of the replacing was noted
    with pytest.raises(Interrupted):
        s.run(1, rows_of(spark, ("a", "2"), ("c", "2"), start=10), die_after="state")
    del s._forget
    for folder in Path(tmp_path).glob("state/of=*/bucket=*"):  # deleted, not yet replaced
        if any(r["attempt"] in str(list(Path(tmp_path).glob("pending/*"))) for r in spark.read.parquet(str(folder)).select("attempt").collect()):
            shutil.rmtree(folder)
    s.run(2, rows_of(spark, *((x, "1") for x in "abcdefgh"), start=5))
    assert changed(s, 2) == [] and not list(Path(tmp_path).glob("staged/*")) and not list(Path(tmp_path).glob("pending/*.json"))
    s.run(3, rows_of(spark, ("a", "2"), start=20))
    assert changed(s, 3) == [(3, "a", "2")]


def test_only_changed_buckets_are_read_and_written(spark, tmp_path):
    s = IncrementalState(spark, str(tmp_path), "k", ["v"], ["i"], bucket_rows=16)
    many = spark.range(200).selectExpr("cast(id as string) k", "'1' v", "0 i")
    assert len(s.run(1, many)) == 16
    wrote = {f: f.stat().st_mtime_ns for f in Path(tmp_path).glob("state/of=16/*/*.parquet")}
    read = []
    stage = s._stage
    s._stage = lambda *a: read.append(stage(*a).count()) or s.spark.read.parquet(f"{tmp_path}/staged/{a[0]}")
    one = spark.createDataFrame([("7", "2", 1)], "k string, v string, i int")
    assert len(s.run(2, one)) == 1 and read[0] < 40 and changed(s, 2) == [(2, "7", "2")]
    assert sum(f.exists() and f.stat().st_mtime_ns == t for f, t in wrote.items()) == len(wrote) - 1
    assert s.run(3, many.unionByName(one), whole=True) == [] and len(read) == 1  # what came in parts has the fingerprint of the whole


def test_buckets_grow_with_the_rows(spark, tmp_path):
    s = IncrementalState(spark, str(tmp_path), "k", ["v"], ["i"], bucket_rows=10)
    part = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) k", "'1' v", "0 i")
    assert len(s.run(1, part(0, 10))) == 1
    with pytest.raises(Interrupted):
        s.run(2, part(10, 200), die_after="state")
    assert len(s.run(2, part(5, 200))) > 16 and len(changed(s, 2)) == 190 and len(list(Path(tmp_path).glob("state/*"))) == 1
    s.run(3, part(0, 200).withColumn("v", F.when(F.col("k") == "9", "2").otherwise(F.col("v"))).withColumn("i", F.lit(1)))
    assert changed(s, 3) == [(3, "9", "2")]


def test_empty_state(spark, tmp_path):
    s = IncrementalState(spark, str(tmp_path), "k", ["v"], ["i"])
    with pytest.raises(ValueError):
        s.changes()
    assert s.run(1, spark.createDataFrame([], "k string, v string, i int")) == [] and s.committed() == [1]
    assert s.changes().columns == ["run", "k", "v"] and s.changes().count() == 0
    s.run(2, rows_of(spark, ("a", None)))
    assert changed(s) == [(2, "a", "")]


def test_packing_passes_over_what_does_not_fit(spark):
    rows = [(1, r, f"p{r}", "T", "wiki", "x" * n, []) for r, n in ((1, 100), (2, 5000), (3, 50))] + [(2, 1, "long", "T", "source", "y" * 9000, ["A", "B"])]
    df = spark.createDataFrame(rows, "query_id int, rank int, path string, title string, kind string, content string, related array<string>")
    got = context.packed_context(df, 400, 300).orderBy("query_id", "number").collect()
    assert [(r["query_id"], r["number"], r["path"]) for r in got] == [(1, 1, "p1"), (1, 2, "p3"), (2, 1, "long")]
    assert len(got[2]["block"]) <= 400 and "Related via: A, B" in got[2]["block"]
    said = spark.createDataFrame([(1, "so [2] and [7, 9]")], "query_id int, answer string")
    assert {(r["path"], r["cited"]) for r in context.marked_citations(context.packed_context(df, 400, 300), said).collect()} == {("p1", False), ("p3", True), ("long", False)}


def test_budgets():
    assert context.context_budget(0).size == 204_800 and context.context_budget(8000).page == 4000
    assert context.generation_tokens(128_000) == 16_000 and context.source_budget(204_800, 0) == 122_880
    clock = iter([0.0, 0.1, 0.5, 0.5]).__next__
    d = profiles.Deadline(0.4, clock)
    assert d.for_stage(1.0) == pytest.approx(0.3) and d.over and not d.affords(0.1)
    assert profiles.profile(" Voice ").budget.fast and profiles.StageBudgets.of_turn(400).embedding == 60
    with pytest.raises(KeyError):
        profiles.profile("loud")
    with pytest.raises(ValueError):
        profiles.Budget(0)


def test_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert oplog.append(spark, path, [{"query": "a", "raw_query": "a", "cited": None, "query_vector": [0.5]}, {"query": "b", "raw_query": "B", "cited": [], "lanes": {"lexical": "ok"}}]) is None
    rows = {r["query"]: r for r in spark.read.parquet(path).collect()}
    assert rows["a"]["cited"] is None and rows["b"]["cited"] == [] and rows["a"]["raw_query"] is None and rows["b"]["raw_query"] == "B"
    assert oplog.stats(spark.read.parquet(path)).first()["turns"] == 2
    assert "not logged" in oplog.append(spark, path, [{"lexical_top": "high"}])
    times = spark.createDataFrame([("s", float(i)) for i in [1, 2, 3, 4, 4, 9]] + [("s", None)], "stage string, ms double")
    r = oplog.percentiles(times).first()
    assert (r["n"], r["p50"], r["p95"], r["p99"]) == (6, 3.0, 9.0, 9.0)


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id int, key string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y")], "query_id int, key string")
    got = metrics.summary(ranking, gold, 5).first()
    assert (got["queries"], got["recall_any"], got["hit"], got["mrr"]) == (2, 0.25, 0.5, 0.25)
    same = spark.createDataFrame([(i, 0.5, 0.5) for i in range(30)], "query_id int, a double, b double")
    assert tuple(metrics.paired_bootstrap(same, 50).first()) == (0.0, 0.0, 0.0)


def model(phase, prompt, most):
    return {
        "analysis": "It is about bridges.",
        "pages": "---FILE: wiki/concepts/bridge.md---\n---\ntype: concept\ntitle: Bridge\ncreated: YYYY-MM-DD\nsources: [notes.txt]\n---\n# Bridge\n\nA bridge spans a river.\n---END FILE---\n---FILE: wiki/index.md---\nno\n---END FILE---\n---REVIEW: suggestion | More?---\nAsk.\n---END REVIEW---\n---FILE: wiki/concepts/river.md---\ncut",
        "repair": "---FILE: wiki/concepts/river.md---\n---\ntitle: River\n---\nRivers flow under [[bridge]].\n---END FILE---\n---FILE: wiki/other.md---\nx\n---END FILE---",
        "answer": "A bridge spans it [1].",
        "part": "notes",
        "merge": "all notes",
    }[phase]


def test_a_corpus_from_source_to_answer(spark, tmp_path):
    root = corpus.create(str(tmp_path / "w"))
    note = tmp_path / "notes.txt"
    note.write_text("Bridges and rivers.")
    out = ingest.ingest(str(root), str(note), model, today="2031-03-15")
    assert out.written == ["wiki/concepts/bridge.md", "wiki/concepts/river.md", "wiki/sources/notes.md"] and out.skipped == ["wiki/index.md"] and out.reviews == 1
    page = (root / "wiki/concepts/bridge.md").read_text()
    assert "created: 2031-03-15" in page and "sources: [notes.txt]" in page
    index = (root / "wiki/index.md").read_text()
    assert "- [[concepts/bridge]] — Bridge" in index and "ingest | notes.txt" in (root / "wiki/log.md").read_text()
    assert ingest.ingest(str(root), str(note), model).from_cache
    (root / "wiki/concepts/river.md").unlink()
    assert not ingest.ingest(str(root), str(note), model).from_cache
    note.write_text("Other text.")
    assert ingest.ingest(str(root), str(note), model).identity == "notes-2.txt"
    note.write_text("\n\n".join("A long paragraph about bridges. " * 40 for _ in range(40)))
    assert ingest.ingest(str(root), str(note), model, size=8000).identity == "notes-3.txt"

    docs = corpus.load_documents(spark, str(root)).cache()
    kinds = {r["path"]: r["kind"] for r in docs.collect()}
    assert kinds["wiki/concepts/bridge.md"] == "wiki" and kinds["raw/sources/notes.txt"] == "source" and "wiki/index.md" not in kinds and "wiki/reviews.md" not in kinds
    searched = ladder.build(docs)
    searched.check()
    answer, cited, note_ = ingest.ask(spark, searched, "what spans a river", model, log=f"{tmp_path}/log")
    assert answer == "A bridge spans it [1]." and note_ is None and cited.where("cited").count() == 1
    assert spark.read.parquet(f"{tmp_path}/log").first()["cited"]
    silent = lambda *_: pytest.fail("the model must not be asked")
    assert ingest.ask(spark, searched, "zzz qqq", silent)[0] == ingest.NOTHING_FOUND

    empty_chunks = spark.createDataFrame([], "page_id string, chunk_index int, heading_path string, text string, vector array<float>, dims int")
    empty_pages = spark.createDataFrame([], "page_id string, title string, hash string, model string")
    chunks, pages, counts = embedding.embed_changes(docs, empty_chunks, empty_pages, "m", embedding.hashing_embedder())
    assert counts["embedded"] == docs.count() and pages.count() == docs.count() and chunks.count() >= docs.count()
    _, _, again = embedding.embed_changes(docs.where("path <> 'wiki/concepts/bridge.md'"), chunks, pages, "m", embedding.hashing_embedder())
    assert again["embedded"] == 0 and again["removed"] == 1
    hybrid = ladder.search(ladder.Corpus(docs, searched.index, chunks, searched.edges, searched.transitions, searched.calibration), spark.createDataFrame([(1, "bridge river", embedding.hashing_embedder()(["bridge river"])[0]), (2, " ", None)], "query_id int, query string, vector array<float>"), 5)
    assert {r["mode"] for r in hybrid.lanes.collect()} <= {"hybrid", "vector"} and {r["query_id"] for r in hybrid.results.collect()} == {1}


def test_search_refuses_repeated_keys(spark, docs):
    d = docs(("wiki/a.md", "A", "x"), ("wiki/a.md", "B", "y"))
    with pytest.raises(ValueError):
        ladder.build(d).check()


def test_embedding_retries_and_halves():
    calls, waits = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise embedding.Unreachable
        if "bad" in texts:
            raise embedding.Rejected
        return [[1.0]] * len(texts)

    assert embedding.embed_all(["a", "bad", "c"], flaky, sleep=waits.append) == [[1.0], None, [1.0]] and waits == [2.0]
    with pytest.raises(embedding.Unreachable):
        embedding.embed_all(["a"], lambda t: (_ for _ in ()).throw(embedding.Unreachable()), sleep=waits.append)


def test_page_store_merges_in_any_order(spark, tmp_path):
    feed = spark.read.parquet(f"{SMALL}/page_feed.parquet").select("page_id", "title", "hash", "model", "seen_at", "feed_id")
    store = PageStore(spark, str(tmp_path))
    for part in feed.randomSplit([0.5, 0.5], 3):
        store.merge(part)
    store.merge(feed.limit(20))  # delivered again
    want = {r["page_id"]: r["x"]["h"] for r in feed.where("hash is not null").groupBy("page_id").agg(F.max(F.struct("seen_at", "feed_id", F.lower(F.trim("hash")).alias("h"))).alias("x")).collect()}
    assert {r["page_id"]: r["hash"] for r in store.read().collect()} == want


def test_cli(tmp_path, capsys):
    from corpusrank import cli

    assert cli.main(["--root", str(tmp_path / "c"), "init"]) == 0 and Path(tmp_path, "c/wiki/index.md").exists()
    assert cli.main(["--root", "/", "status"]) == 1
    assert cli.main(["--root", str(tmp_path / "c"), "add", "x.txt", "--model", "no.such:model"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["nonsense"])
    assert e.value.code == 2
    assert json.dumps(capsys.readouterr().out)


@pytest.fixture
def small(spark, docs):
    pages = docs(("wiki/a.md", "Bridge", "a bridge spans the river [[b]]"), ("wiki/b.md", "River", "the river flows"), ("wiki/c.md", "Cloud", "clouds rain"))
    chunks = spark.createDataFrame([("wiki/c.md", 0, "", "clouds", [1.0, 0.0])], "page_id string, chunk_index int, heading_path string, text string, vector array<float>")
    return ladder.build(pages, chunks), spark.createDataFrame([(1, "bridge", [1.0, 0.1])], "query_id int, query string, vector array<float>")


@pytest.mark.parametrize(
    ("total_ms", "clock", "outcomes"),
    [
        (None, lambda: 0.0, {"words": "ran", "vectors": "ran", "graph": "ran"}),
        (5000, lambda: 0.0, {"words": "ran", "vectors": "ran", "graph": "ran"}),
        (1000, lambda: 0.0, {"words": "ran", "vectors": "skipped", "graph": "ran"}),  # embedding may take three seconds
        (400, None, {"words": "ran", "vectors": "expired", "graph": "expired"}),  # every look at the clock costs 300 ms
    ],
)
def test_lanes_are_left_out_when_their_time_is_not_left(small, total_ms, clock, outcomes):
    searched, asked = small
    tick = iter(x * 0.3 for x in range(1000))
    heard = []
    found = ladder.search(searched, asked, 5, budget=profiles.Budget(total_ms) if total_ms else None, sink=lambda n, ms: heard.append(n) or 1 / 0, clock=clock or (lambda: next(tick)))
    assert {n: found.stages.outcomes[n] for n in outcomes} == outcomes and set(heard) == set(found.stages.times) == {n for n, o in outcomes.items() if o == "ran"}
    keys = {r["path"] for r in found.results.collect()}
    assert "wiki/a.md" in keys and ("wiki/c.md" in keys) == (outcomes["vectors"] == "ran")
    assert found.lanes.first()["mode"] == ("hybrid" if outcomes["vectors"] == "ran" else "keyword")


def test_lanes_may_be_replaced(spark, small):
    searched, asked = small
    words = lambda queries, depth: queries.selectExpr("query_id", "'wiki/b.md' key", "2.0D score", "1 rank", "'x' extra")
    embed = lambda queries: queries.selectExpr("query_id", "array(1.0f, 0.0f) vector")
    options = profiles.Options(graph_ppr=False, lexical_gate=False)
    found = ladder.search(searched, asked.withColumn("vector", F.lit(None).cast("array<float>")), 5, options, searchers=ladder.Searchers(words=words, embed=embed))
    assert [r["path"] for r in found.results.orderBy("rank").collect()] == ["wiki/b.md", "wiki/c.md"] and found.stages.outcomes["graph"] == "off"
    near = lambda queries, k: queries.selectExpr("query_id", "'wiki/a.md' key", "0.9D score", "1 rank")
    found = ladder.search(searched, asked, 5, options, searchers=ladder.Searchers(near=near))
    assert {r["path"] for r in found.results.collect()} == {"wiki/a.md"}

    def broken(queries, depth):
        raise OSError

    with pytest.raises(OSError):
        ladder.search(searched, asked, 5, options, searchers=ladder.Searchers(words=broken))


def test_naming_decides_what_the_title_field_holds(spark, docs):
    from corpusrank.operators import lexical, linkgraph

    d = docs(("a1b2_note.md", "Bridge", "text"), ("c3_other.md", "Other", "text"))
    bare = linkgraph.Naming(title_field=lambda: F.col("title"))
    ask = spark.createDataFrame([(1, "a1b2")], "query_id int, query string")
    assert lexical.bm25(ladder.build(d).index, ask).count() == 1 and lexical.bm25(ladder.build(d, naming=bare).index, ask).count() == 0


def test_embedding_again_from_the_command_line(tmp_path, capsys):
    from corpusrank import cli

    root = corpus.create(str(tmp_path / "c"))
    corpus.write_page(str(root), "wiki/concepts/a.md", "---\ntitle: A\n---\nSome words.")
    for n in (1, 0):
        assert cli.main(["--root", str(root), "embed", str(tmp_path / "store")]) == 0
        assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["embedded"] == n
    corpus.write_page(str(root), "wiki/concepts/b.md", "Other words.")
    assert cli.main(["--root", str(root), "embed", str(tmp_path / "store")]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["embedded"] == 1
    assert cli.main(["--root", str(root), "ask", "words", "--json", "--model", "tests.test_plans:model"]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["answer"] == "A bridge spans it [1]."


@pytest.mark.parametrize("name", ["f4_pagerank", "f5_ranked_by_mass", "f9_results", "f11_search"])
def test_queries_run_production_rounds(spark, monkeypatch, name):
    from corpusrank.operators import diffusion
    from corpusrank.plans import retrieval

    asked = []

    class Stop(Exception):
        pass

    def record(seeds, transitions, alpha=diffusion.ALPHA, rounds=diffusion.ROUNDS, tolerance=diffusion.TOLERANCE):
        asked.append((alpha, rounds, tolerance))
        raise Stop

    monkeypatch.setattr(diffusion, "pagerank", record)
    with pytest.raises(Stop):
        retrieval.QUERIES[name](spark, SMALL)
    assert asked == [(0.15, 60, 1e-8)]


def test_results_answer_every_logged_query(spark, monkeypatch):
    from corpusrank.plans import retrieval

    asked = []

    class Stop(Exception):
        pass

    def record(corpus, queries, k):
        asked.append(queries.count())
        raise Stop

    monkeypatch.setattr(ladder, "build", lambda *a: None)
    monkeypatch.setattr(ladder, "search", record)
    for name in ("f9_results", "f11_search"):
        with pytest.raises(Stop):
            retrieval.QUERIES[name](spark, SMALL)
    log = retrieval.log_of(spark, SMALL)
    assert asked == [log.count(), log.where("id % 20 = 0").count()] and asked[0] > asked[1] > 0
