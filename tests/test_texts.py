import pytest
from pyspark.sql import functions as F

from corpusrank.functions import formats, generated, markdown
from corpusrank.functions import text as t


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(f(*(F.col(c) for c in df.columns))).first()[0]


SAFE = ["wiki/a.md", "wiki/concepts/b-c.md", "wiki\\x\\y.md"]
UNSAFE = ["", " ", "/wiki/a.md", "raw/a.md", "wiki/../a.md", "C:/wiki/a.md", "wiki/a\x01.md", "wiki/con.md", "wiki/LPT1", "wiki/a?.md", "wiki/a ", "wiki/a.", "wiki//a.md", "wiki/.git/x", "\\wiki\\a.md"]


@pytest.mark.parametrize(("path", "ok"), [(p, True) for p in SAFE] + [(p, False) for p in UNSAFE])
def test_safe_paths(spark, path, ok):
    assert one(spark, t.safe_page_path, path) is ok and generated.safe_path(path) is ok


def test_front_matter():
    page = markdown.read_page('---\ntitle: "A: b"\nsources: [a, "b, c", [d]]\ntags:\n  - x\n  - \'y\'\nempty:\nnot a key line\n---\nBody\n')
    assert page.data == {"title": "A: b", "sources": ["a", "b, c", "d"], "tags": ["x", "y"], "empty": ""} and page.body == "Body\n"
    assert page.first("tags") == "x" and page.items("title") == ["A: b"] and page.items("empty") == []
    again = markdown.read_page(markdown.write_page(page.data, page.body))
    assert again.data["title"] == "A: b" and again.body.strip() == "Body"
    assert markdown.with_field("no fences", "a", "b") == "no fences" and markdown.read_page("---\nopen").present is False


def test_titles_and_links(spark):
    f = lambda c, p: t.page_title(c, p)
    assert one(spark, f, "---\ntitle: 'T'\n---\n# H", "wiki/x.md") == "T"
    assert one(spark, f, "---\ntype: a\n---\ntext\n# H one\n", "wiki/x.md") == "H one"
    assert one(spark, f, "text", "wiki/some-page.md") == "some page"
    assert one(spark, t.wikilinks, "[[a|b]] [[c#d]] [[ ]] [[a]]") == ["a", "c", "a"]
    assert one(spark, t.alias, "Wiki\\Some Page.MD#part") == "wiki/some-page"


def test_snippets_slugs_sources(spark):
    body = "x" * 200 + " needle " + "y" * 200
    got = one(spark, lambda c: t.snippet(c, F.lit("NEEDLE")), body)
    assert got.startswith("...x") and got.endswith("y...") and "needle" in got and len(got) < 200
    assert one(spark, t.slug, " Hello, World/Again! ") == "hello-world-again" and one(spark, t.slug, "!!") == "untitled"
    values = ["./a.pdf", "/abs", "x/../y", "wiki/index.md", "A.PDF", "paper.pdf", "C:/x"]
    assert one(spark, lambda v: t.canonical_sources(v, F.lit("in/paper.pdf")), values) == ["a.pdf", "in/paper.pdf"]
    assert one(spark, t.source_identity, "/p/raw/sources/in/x.pdf") == "in/x.pdf"


@pytest.mark.parametrize(("text", "lang"), [("plain words", "English"), ("これは漢字です", "Japanese"), ("知识图谱和检索", "Chinese"), ("안녕하세요", "Korean"), ("", "English"), (None, "English"), ("a" * 100 + "知", "English")])
def test_languages(spark, text, lang):
    assert one(spark, t.language, text) == lang


def test_blocks_keep_fences_and_tables_whole():
    fence = "```\n" + "\n".join(f"line {i}\n" for i in range(200)) + "```"
    table = "\n".join(f"| {i} | x |" for i in range(202))
    blocks = markdown.text_blocks(f"# A\nintro\n\n## B\n{fence}\n{table}\nafter\n# C\nend")
    assert [b.heading_path for b in blocks] == ["# A", "# A > ## B", "# A > ## B", "# A > ## B", "# C"]
    assert [b.whole for b in blocks] == [False, True, True, False, False] and blocks[1].text == fence and blocks[2].text == table
    chunks = markdown.markdown_chunks(f"---\na: b\n---\n{fence}")
    assert len(chunks) == 1 and chunks[0].oversized and chunks[0].start == 13


def test_chunks_lose_no_words_and_overlap():
    words = [f"w{i}" for i in range(3000)]
    text = "".join(f"## Part {k}\n\n{' '.join(words[k * 600:(k + 1) * 600])}.\n\n" for k in range(5))
    chunks = markdown.markdown_chunks(text)
    said = " ".join(c.text for c in chunks)
    assert all(w in said for w in words) and max(len(c.text) for c in chunks) <= 1500 + 202
    pairs = [(a, b) for a, b in zip(chunks, chunks[1:], strict=False) if a.heading_path == b.heading_path]
    assert pairs and all(b.text[:50] in a.text for a, b in pairs)
    assert markdown.markdown_chunks("") == [] and markdown.markdown_chunks(None) == []
    assert markdown.cut_text("z" * 25, 10) == ["z" * 10, "z" * 10, "z" * 5]


def test_sections_are_numbered_and_overlap():
    text = "\n\n".join(f"Sentence {i} says something. Another one follows here." for i in range(100))
    parts = markdown.source_sections(text, 1000, 100)
    assert [p.index for p in parts] == list(range(1, len(parts) + 1)) and all(p.total == len(parts) for p in parts)
    assert parts[0].before == "" and all(p.before and p.before in q.main for q, p in zip(parts, parts[1:], strict=False))


def test_formats():
    assert formats.file_text("a.csv", b"h1,h2\nx|y,1,2\nz\n") == "| h1 | h2 |\n| --- | --- |\n| x\\|y | 1 |\n| z |  |"
    assert formats.file_text("a.json", b'{"a":1}') == '```json\n{\n  "a": 1\n}\n```' and formats.file_text("a.jsonl", b"{}\n{}") == "```json\n{}\n{}\n```"
    page = "<html><nav>no</nav><h2>T</h2><p>a <b>c</b> &amp; d<br>e</p><ul><li>x<ol><li>y</li></ol></li></ul><a href='u'>l</a><script>z</script></html>"
    got = formats.html_text(page)
    assert "## T" in got and "a **c** & d\ne" in got and "- x" in got and "1. y" in got and "[l](u)" in got and "no" not in got and "z" not in got
    assert formats.file_text("a.txt", "é".encode("latin-1")) == "é"
    for name, raw in (("a.bin", b"\xff\xfe\x00"), ("a.unknown", b"a\0b"), ("a.pdf", b"")):
        with pytest.raises(Exception):
            formats.file_text(name, raw)


def test_generated_blocks(spark):
    text = "x\r\n--- FILE: wiki/a.md ---\n```\n---END FILE---\n```\nend\n---end file---\n---FILE: ../b.md---\nno\n---END FILE---\n---REVIEW: Duplicate | Same?---\nWhy\nOPTIONS: Skip | Explode\nPAGES: a, b\n---END REVIEW---\n---REVIEW: odd---\n---END REVIEW---\n---FILE: wiki/c.md---\ncut"
    got = generated.read_generated(text)
    assert got.files == [("wiki/a.md", "```\n---END FILE---\n```\nend")] and got.truncated == ["wiki/c.md"] and len(got.warnings) == 3
    assert got.reviews == [{"type": "duplicate", "title": "Same?", "description": "Why", "options": ["Skip"], "pages": ["a", "b"], "search": []}]
    row = generated.generated_table(spark.createDataFrame([("1", text), ("2", None)], "id string, text string")).orderBy("id").collect()
    assert len(row[0]["files"]) == 1 and row[1]["files"] == []


ASKED = ["alpha", "alpha beta", "beta zeta", "al", "of", "title", "gamma. delta", "zeta\\nx"]
TEXTS = [("wiki/alpha-one.md", "One", "---\ntitle: alpha\n---\n\n" + "word " * 40 + "Alpha beta\nzeta " + "word " * 40), ("wiki/b.md", "Beta", "beta"), ("wiki/c.md", None, None), ("wiki/d.md", "D", "gamma. delta \u00a0 "), ("wiki/e.md", "title", "\u2003alpha x alpha")]


def test_snippets_and_title_matches_equal_those_of_each_pair_without_a_cross_join(spark, docs):
    from corpusrank.operators import fusion

    d = docs(*TEXTS)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "query_id int, query string")
    pairs = d.join(asked.select("query_id", "query", t.query_tokens(F.col("query")).alias("w"), t.query_phrase(F.col("query")).alias("p")).where("size(w) > 0"))
    one = fusion.result_snippet(F.col("content"), F.col("w"), F.col("p"), F.col("query"), F.array().cast("array<string>"))
    cut = fusion.all_snippets(d, asked)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, pairs.where(F.exists("w", lambda x: F.contains(F.lower("content"), x))).select("query_id", "path", one).collect()))
    match = fusion.all_title_matches(d, asked)
    assert sorted(map(tuple, match.collect())) == sorted(map(tuple, pairs.where(fusion.title_matches(F.col("title"), F.col("path"), F.col("w"), F.col("p"))).select("query_id", "path").collect()))
    assert all("Join" not in f._jdf.queryExecution().optimizedPlan().toString() for f in (cut, match))
