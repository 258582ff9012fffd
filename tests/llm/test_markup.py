import itertools
import random

import pytest

from corpusrank.llm import markup

PLAIN = ["Set {a, b} of it.", "Here x < y and y > z holds.", "R&D asked ~80 times.", "It costs 66$ per seat and 5$ more.", "D:\\notes\\frac\\old", "A block of 5 * 3 * 2 rows.", "see [page 7] is done", "Rate: 7% | cost: 7 | owner: x", "    x = a[0] * 2\n    if p < limit > 5", "Ticket #5 of C#", "snake_case and a_b_c", "- a\n- b\n1. c", "Is 2 == 2 for all?", "* a\n* b", ""]
HELD = [
    ("html", "<p>x</p>"), ("html", "a<br/>b"), ("html", "Fish &amp; tide"), ("html", "4&#8211;5"), ("html", "a <!-- c --> b"), ("html", "<pre>x ** y ** z</pre>"),
    ("markdown", "---\ntitle: x\n---\ntext"), ("markdown", "# Head"), ("markdown", "Head\n-----\n\ntext"), ("markdown", "```\n<p> $x$ [[y]] \\frac\n```"), ("markdown", "use `x`"),
    ("markdown", "a **b** c"), ("markdown", "a __b__ c"), ("markdown", "[a b](c/d.md)"), ("markdown", "![a](b.png)"), ("markdown", "| a | b |\n|---|---|\n| c | d |"),
    ("wiki", "== Head =="), ("wiki", "a '''b''' c"), ("wiki", "x {{stub}}"), ("wiki", "see [[A|b]]"), ("wiki", "{| class=\"x\"\n| a || b\n|}"),
    ("latex", "\\section{A}"), ("latex", "so \\emph{x}"), ("latex", "\\begin{quote}\nx\n\\end{quote}"), ("latex", "Set $k=3$ first"), ("latex", "$$x$$"), ("latex", "\\(x\\)"), ("latex", "\\[x\\]"), ("latex", "\\begin{verbatim}\n<p> **x**\n\\end{verbatim}"),
]


def marks_of(text):
    return set().union(*(b.markups for b in markup.parse(text)))


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert marks_of(text) == set()
    for other in PLAIN:
        assert marks_of(f"{text}\n\n{other}") == set()


@pytest.mark.parametrize(("kind", "text"), HELD)
def test_markup(kind, text):
    assert marks_of(text) == {kind}
    assert marks_of(text.replace("\n", "\r\n") + "\r\n") == {kind}


def test_math_elements_are_two_markups():
    assert marks_of("<math>\\frac{a}{b}</math>") == {"html", "latex"}
    assert marks_of("<math>a + b</math>") == {"html"}


def test_structure_survives():
    text = "<html><body><h1>Top</h1><nav><a href='x'>Home</a> <a href='y'>About</a></nav><p>Some &amp; text with <b>bold</b> words, long enough to be read.</p><ul><li>one<ul><li>inner</li></ul></li><li>two</li></ul><pre><code>if a &lt; b:\n    c()</code></pre><p>Then $x_1$ and <math>y^2</math>.</p><table><tr><td>a</td><td>b</td></tr></table><footer>Exported by the clipper</footer></body></html>"
    clean = markup.clean(text)[0]
    for s in ("# Top", "Some & text with bold words", "- one", "  - inner", "- two", "```\nif a < b:\n    c()\n```", "$x_1$", "$y^2$", "| a | b"):
        assert s in clean, (s, clean)
    assert "<" not in clean.replace("a < b", "") and "Exported" not in clean
    wiki = markup.clean("= T =\n\n'''It''' is [[A b|so]] and {{cite|x}} fine.\n\n== U ==\n\n{| class=\"l\"\n| a || b\n|-\n| c || d\n|}")[0]
    assert wiki == "# T\n\nIt is so and  fine.\n\n## U\n\n| a | b |\n| c | d |"
    latex = markup.clean("\\documentclass{article}\n\\begin{document}\n\\section{S}\nIt is \\emph{so}.~\\cite{x}\n\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\n\\[a \\leq b\\]\n\\end{document}")[0]
    assert latex == "# S\n\nIt is so.\n\n- one\n- two\n\n$$\na \\leq b\n$$"


def test_plain_text_stays():
    text = "First paragraph of words.\n\nSecond one, with a line\nthat goes on here."
    assert markup.clean(text) == (text, [], [], 2, 0)
    assert markup.clean(None) == ("", [], [], 0, 0) and markup.clean(" \n ")[0] == ""
    for prose in ("rock ''n'' roll and 5'' pipe", "a $5 note", "so {{ it goes"):
        assert markup.clean(prose)[:3] == (prose, [], [])


def test_nothing_is_capped():
    formula = "x_{1} + \\frac{a}{b} " * 300
    clean, marks, _, _, _ = markup.clean(f"It is ${formula.strip()}$ in all.")
    assert clean == f"It is ${formula.strip()}$ in all." and marks == ["latex"]
    nested = "so " + "{{a|" * 20 + "x" + "}}" * 20 + " it is"
    assert markup.clean(nested)[:2] == ("so  it is", ["wiki"])
    assert markup.clean("so " + "\\emph{a " * 20 + "x" + "}" * 20)[0] == "so " + "a " * 20 + "x"
    deep = "<div>" * 3000 + "<p>inner text of some words</p>" + "</div>" * 3000 + "<p>after it</p>"
    assert markup.clean(deep)[0] == "inner text of some words\n\nafter it"
    assert markup.clean("'''''both''''' and '''bold''' and ''thin'' and 5'' pipe")[0] == "both and bold and thin and 5'' pipe"
    assert markup.clean("<title>Only a title</title>")[:3] == ("Only a title", [], ["html"])


def test_markups_stand_in_labelled_blocks(spark):
    text = "---\na: b\n---\n<article><p>A paragraph of **strong** words that goes on for a while, as text does.</p></article><footer>{{stub}} <a href='x'>Home</a></footer><!-- end -->"
    clean, content, other, n, dropped = markup.clean(text)
    assert content == ["html", "markdown"] and set(other) == {"html", "markdown", "wiki"} and (n, dropped) == (2, 1) and "Home" not in clean
    row = markup.clean_markup(spark.createDataFrame([("a", text), ("a", text), (None, None)], "k string, t string"), "k", "t", markup.PRIOR_WEIGHTS).collect()
    assert len(row) == 3 and sorted(len(r["content_markups"]) for r in row) == [0, 2, 2]


def test_found_markups_need_labelled_blocks(spark, monkeypatch):
    monkeypatch.setattr(markup, "content_blocks", lambda blocks, weights: [False] * len(blocks))
    assert markup.clean("a **bold** word")[:3] == ("", [], ["markdown"])
    monkeypatch.setattr(markup, "parse", lambda text: [])
    assert markup.clean("a **bold** word")[:3] == ("", [], [])


def test_flow_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(2, 7)
        arcs = {(i, j): rng.randrange(1, 9) for i in range(n + 2) for j in range(n + 2) if i != j and rng.random() < 0.5 and j != n and i != n + 1}
        capacity = [{j: c for (i, j), c in arcs.items() if i == u} for u in range(n + 2)]
        side = markup.max_flow(capacity, n, n + 1)
        cost = lambda s: sum(c for (i, j), c in arcs.items() if s[i] and not s[j])  # noqa: E731, B023
        best = min(cost([*bits, True, False]) for bits in itertools.product([False, True], repeat=n))
        assert side[n] and not side[n + 1] and cost(side) == best


def test_smoothness_joins_neighbours():
    good = markup.Block("A long paragraph with many words that says something at length. It goes on, and on, until it ends here.", "text")
    short = markup.Block("Home", "text", links=4)
    weights = markup.PRIOR_WEIGHTS
    assert markup.content_blocks([good, short, short, short], weights, next_to=0, siblings=0) == [True, False, False, False]
    assert markup.content_blocks([good, short, good], weights, next_to=9) == [True, True, True]


def test_table(spark):
    rows = [("a", "<p>x</p>", 1), ("a", "<p>x</p>", 1), (None, "# h", 2), ("n", None, 3), ("e", "", 4)]
    df = spark.createDataFrame(rows, "path string, content string, markups int")
    got = [(r["key"], r["content_markups"]) for r in markup.clean_markup(df, "path", "content").collect()]
    assert sorted(got, key=str) == sorted([("a", ["html"]), ("a", ["html"]), (None, ["markdown"]), ("n", []), ("e", [])], key=str)
    assert markup.clean_markup(df.where("false"), "path", "content").count() == 0


def test_fitted_classifier_on_held_out_blocks(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/wiki_docs.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/wiki_docs.parquet"))
    weights = markup.fit(d.where("path < 'wiki'"), "content")
    right = total = 0
    for r in d.where("path >= 'wiki'").select("content").collect():
        blocks = [b for b in markup.parse(r["content"]) if b.kind != "residue"]
        for b, keep in zip(blocks, markup.content_blocks([markup.Block(b.text, b.kind, links=b.links) for b in blocks], weights), strict=True):
            y = markup.labels_of(b)
            if y == 1:
                total += 1
                right += keep
    assert total == 0 or right >= 0.95 * total
