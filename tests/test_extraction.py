from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions import extraction as X
from inkmill.functions import macros as MX
from inkmill.functions import markup as K
from inkmill.functions import sequences as Q

PAPER = r"""\documentclass{article}
\usepackage{tikz}
\makeatletter\newcommand{\hi}[1]{Hello #1}\makeatother
\begin{document}
\section{One}
See \ref{fig:a} here.

\begin{figure}
\begin{tikzpicture}\node{\hi{you}};\end{tikzpicture}
\caption{A {nested} caption}\label{fig:a}
\end{figure}

\begin{tikzcd} A \arrow[r] & B \end{tikzcd}

First one. Then \cref{fig:a,fig:b} is long. After it. And more. And last. %s
\end{document}"""


def test_figures():
    a, b = X.figures_in(PAPER, balanced=True)
    assert (a["env"], a["caption"], a["label"]) == ("tikzpicture", "A {nested} caption", "fig:a")
    assert (b["env"], b["caption"], b["label"]) == ("tikzcd", "", "")
    assert X.figures_in(PAPER)[0]["caption"] == "A {nested"
    assert X.figures_in(PAPER, longest=5) == []
    assert X.balanced_group(r"{a \} b", 0) is None


def test_pictures_and_mentions(spark):
    df = spark.createDataFrame([(1, PAPER.replace("%s", "x" * 1200)), (2, None), (3, "")], "id int, t string")
    rows = {r.id: r for r in df.select("id", F.size(X.pictures("t")).alias("n"), X.text_mentions("t", F.lit("fig:a")).alias("m")).collect()}
    assert rows[1].n == 2 and rows[3].n == 0
    assert rows[1].m == sorted(["\\section{One}\nSee \\ref{fig:a} here.", "First one. Then \\cref{fig:a,fig:b} is long. After it. And more. And last."])
    assert rows[3].m == []


def test_plan(spark):
    from inkmill.plans.extraction import extract_figures

    df = spark.createDataFrame([(1, PAPER), (2, None), (3, "no picture")], "id int, t string")
    rows = extract_figures(df, "id", "t", True).orderBy("file_id").collect()
    assert len(rows) == 2
    assert "\\newcommand{\\hi}[1]{Hello #1}" in rows[0].code and rows[0].caption == "A {nested} caption"


def test_macros():
    defs = r"\newcommand{\a}[2]{#2-\b{#1}} % x" + "\n" + r"\renewcommand\b[1]{<#1>} \newcommand{\unused}{u} \newenvironment{box}[1]{[#1}{]}"
    text, used = MX.expand(defs, r"\a{x}y \begin{box}{q}in\end{box}")
    assert text == "y-<x> [qin]"
    assert used.split("\n\n")[0] == r"\newcommand{\a}[2]{#2-\b{#1}}" and "unused" not in used
    loop = r"\newcommand{\l}{\l}"
    assert MX.expand(loop, r"\l") == (r"\l", "")
    assert MX.expand(r"\newcommand{\o}[1]{#2}", r"\o{x}") == (r"\o{x}", "")
    assert MX.expand(None, "t") == ("t", "") and MX.expand("", None) == (None, "")
    assert MX.joined([r"\foo", "b"]) == r"\foo b"
    assert MX.expand(r"\makeatletter\newcommand{\x@y}{1}\makeatother", r"\makeatletter\x@y\makeatother")[0] == r"\makeatletter1\makeatother"


def test_html(spark):
    page = '<title>T &ndash; x</title><h2>Head</h2><p align="center">Big <b>one</b></p><p>About it</p><pre><code>a &lt; b</code></pre><a class="k" href="/x">l</a>'
    assert K.page_blocks(page) == [{"code": "a < b", "description": "Big one About it", "heading": "Head", "title": "Big one"}]
    assert K.page_blocks(None) == []
    row = spark.createDataFrame([(page,)], "p string").select(X.html_code_blocks("p"), X.html_text("p"), X.page_links("p"), X.resolved(X.page_links("p")[0], F.lit("http://h/a/b"))).first()
    assert row[0] == ["a < b"] and "About it" in row[1] and "pre" not in row[1] and row[2] == ["/x"] and row[3] == "http://h/x"


def test_manual():
    text = "\\section{Lines} About lines.\n\\begin{codeexample}[pre={\\x},hidden]\n\\draw;\n\\end{codeexample}\n%\\begin{codeexample}[]\n%\\fill;\n%\\end{codeexample}"
    a, b = K.code_examples(text)
    assert (a["code"], a["hidden"], a["pre"], a["section"], a["description"]) == ("\\draw;", True, "\\x", "Lines", "About lines.")
    assert b["section"] == "" and "\\fill;" in b["code"]


def test_markdown_yaml_json(spark):
    md = "# Title here\n\ntext\n\n## Notes\n\nsome\nnote\n\nmore"
    row = spark.createDataFrame([(md,)], "m string").select(X.markdown_title("m"), X.markdown_notes("m")).first()
    assert tuple(row) == ("Title here", "some note")
    assert K.yaml_fields("title: a\ndescription: 3") == {"title": "a", "description": "3"} and K.yaml_fields(": :")["title"] is None
    qa = '{"p": {"qa": [{"reference": "a-Figure1.png", "rationale": "  why  so "}, {"reference_figures": "[\\"b.png\\", \\"Table2.png\\"]", "explanation": "e"}, {"reference": "c.png"}]}}'
    got = {tuple(r) for r in X.qa_rows(spark.createDataFrame([(qa,)], "j string"), "j").collect()}
    assert got == {("a-Figure1", "why so"), ("b", "e")}
    answers = spark.createDataFrame([("k", '```json\n{"q1": "x", "q2": "y"}\n```'), ("bad", "no json"), ("none", None)], "k string, r string")
    assert {tuple(r) for r in X.query_rows(answers, "k", "r", 1).collect()} == {("k", 0, "q1", "x")}
    templates = spark.createDataFrame([("k", '{"template_1": "A <s>", "terms_1": {"s": ["a"]}, "template_2": "no terms"}')], "k string, r string")
    assert [(r.j, r.template, r.terms) for r in X.template_rows(templates, "k", "r").collect()] == [(1, "A <s>", {"s": ["a"]})]


def test_sequences(spark):
    df = spark.createDataFrame([([5, 6, 7], [0, 1, 1, 0, 1], ["a", "b", "c"])], "ids array<int>, mask array<int>, t array<string>")
    row = df.select(Q.label_mask("ids", 2), Q.mask_values("ids", 6), Q.position_ids("mask"), F.size(Q.all_ngrams("t", 4)), Q.image_length(), Q.merge_image_tokens(F.array(F.lit(9), F.lit(1), F.lit(9)), "ids", 9)).first()
    assert row[0] == [-100, -100, 7] and row[1] == [5, -100, 7] and row[2] == [1, 0, 1, 1, 2] and row[3] == 6 and row[4] == 300 and row[5] == [0, None, 1]
    assert Q.template_request("easy", 3).startswith("Write 3 ")
    lexed = spark.createDataFrame([("\\draw (0,0) % note\n Hello There",), (None,)], "x string").select(Q.lexed("x"), Q.lexed("x", True)).collect()
    assert "\\draw" in lexed[0][0] and not any("note" in t for t in lexed[0][0]) and "hello" in lexed[0][1] and lexed[1][0] is None


def test_text_mentions_of_every_label(spark, tmp_path):
    from inkmill import queries

    text = "\\label{fig:a} \\label{ fig:b } \\label{fig:a}\n\nAs \\ref{fig:a} shows, all is well.\n\nAs \\ref{fig:b} shows, it is not."
    spark.createDataFrame([(1, text), (2, "no label"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.label): r.mentions for r in queries.QUERIES["text_mentions"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, "fig:a"), (1, "fig:b")} and ["fig:a" in m[0] for m in got.values()].count(True) == 1 and all(len(m) == 1 for m in got.values())
