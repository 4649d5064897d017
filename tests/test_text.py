from __future__ import annotations

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from inkmill.functions import latex as L
from inkmill.functions import text as T

NBSP = chr(0xA0)


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "x string").select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize("given, wanted", [("a % b", "a"), (r"50\% of % x", r"50\% of"), ("a \\\\% b", "a \\\\"), ("", ""), ("%", ""), (None, None)])
def test_strip_comment(spark, given, wanted):
    assert one(spark, given, T.strip_comment("x")) == wanted


def spec_comment(line):
    k = 0
    while k < len(line):
        if line[k] == "\\":
            k += 2
        elif line[k] == "%":
            return line[:k].rstrip()
        else:
            k += 1
    return line.rstrip()


def test_comments_at_random(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab \\%\n{}\t") for _ in range(r.randrange(60))) for _ in range(2000)] + ["x" * 200_000 + "% y", "\\" * 5001 + "%"]
    clean = lambda t: "\n".join(spec_comment(line) for line in t.split("\n") if not line.lstrip().startswith("%")).strip()
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.clean_code("x").alias("y")).collect()
    assert all(g.y == clean(g.x) for g in got)


def test_strip_is_python_strip(spark):
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    for s in spaces:
        assert s.strip() == ""
        assert one(spark, f"{s}a{s}b{s}", T.strip("x")) == f"a{s}b"


def test_dedent(spark):
    for text in ("  a\n    b\n\n  c", "a\n  b", "\t x\n\t  y", "  \n   ", "", " \ta\n  b"):
        assert one(spark, text, T.dedent("x")) == textwrap.dedent(text)


def test_clean_block(spark):
    assert one(spark, "%a\n % b", T.clean_block("x")) == "a\nb" or one(spark, "%a\n % b", T.clean_block("x")) == "a\n b"
    assert one(spark, "  pre x\n  y % z", T.clean_block("x", F.lit("pre"))) == "x\ny"
    assert one(spark, None, T.clean_block("x")) is None


@pytest.mark.parametrize("given, wanted", [("2101.00001", "2101.00001"), ("math0309136", "math/0309136"), ("a b", None), ("", None)])
def test_paper_id(spark, given, wanted):
    assert one(spark, given, T.paper_id("x")) == wanted


def test_version(spark):
    assert one(spark, "2101.00001v2", T.strip_version("x")) == "2101.00001"


def test_answers(spark):
    assert one(spark, r"Sure: \documentclass{a} \end{document} bye", T.extract_answer("x")) == r"\documentclass{a} \end{document}"
    assert one(spark, r"a \b c \d e", T.extract_answer("x")) == r"\b c " + "\\"
    assert one(spark, "none", T.extract_answer("x")) == ""
    assert one(spark, "so: \\a\n\\b {c}\nbye", T.extract_code("x")) == "\\a\n\\b {c}"
    assert one(spark, "so: \\a {b}", T.extract_code("x")) == "\\a {b}"  # no character is lost at the end
    assert one(spark, "<think>\\no</think>\n\\yes\n", T.extract_repair("x")) == "\\yes"
    assert one(spark, "<think>x</think> sorry", T.extract_repair("x")) == "sorry"
    assert one(spark, '```json\n{"a": 1}\n```', T.strip_fence("x")) == '{"a": 1}'


def test_log_excerpt(spark):
    log = [f"l{i}" for i in range(100)]
    log[10] = "! Error"
    assert one(spark, "\n".join(log), T.log_excerpt("x")) == "\n".join(log[7:40])
    log[10], log[1] = "l10", "! Early"
    assert one(spark, "\n".join(log), T.log_excerpt("x")) == "\n".join(log[0:31])
    log[1] = "l1"
    assert one(spark, "\n".join(log), T.log_excerpt("x")) == "\n".join(log[70:])
    assert one(spark, None, T.log_excerpt("x")) == ""


def test_page_description(spark):
    title = F.lit("A Title")
    assert one(spark, "", T.page_description("x", title)) == "No Description"
    assert one(spark, "Edit and compile if you like:", T.page_description("x", title)) == "No Description"
    assert one(spark, "Text  here", T.page_description("x", title)) == "A Title. Text here."
    assert one(spark, "This a title holds", T.page_description("x", title)) == "This a title holds"


def test_names(spark):
    assert one(spark, "/a/one_two+x_y+z.tex", T.title_from_name("x", "tags")) == "one two (x y, z)"
    assert one(spark, "/a/b-c-d.e.tex", T.title_from_name("x"), T.title_from_name("x", "last_dash"), T.title_from_name("x", "last_dot")) == ("b-c-d.e", "d.e", "e")
    with pytest.raises(ValueError):
        T.title_from_name("x", "?")


def test_fold(spark):
    assert one(spark, f"caf{chr(0xE9)} {chr(0x2013)} {chr(0x4E2D)}x{NBSP}", T.ascii_fold("x")) == "cafe - x "


@pytest.mark.parametrize("text", [r"a { b { c }", r"a } b", r"\{ { }", "", "}}{{", r"{\}"])
def test_balance(spark, text):
    got = one(spark, text, L.balance_braces("x"))
    n = lambda t, c: len(re.findall(r"(?<!\\)\%s" % c, t))
    assert n(got, "{") == n(got, "}") == min(n(text, "{"), n(text, "}"))


def test_math_and_captions(spark):
    assert one(spark, r"a $b$ c $d", L.balance_dollars("x")) == "a $b$ c d"
    assert one(spark, r"cost \$5", L.balance_dollars("x")) == r"cost \$5"
    assert one(spark, r"x \( y \) \( z", L.balance_delimiters("x")) == r"x \( y \)  z"
    assert one(spark, "A  b\n\\label{fig:x} $c", L.clean_caption("x")) == "A b c"


def test_documents(spark):
    assert one(spark, r"\documentclass{standalone}", L.inject_network_package("x")) == "\\documentclass{standalone}\n\\usepackage{tikz-network}"
    assert one(spark, r"\documentclass[a4]{standalone}", L.inject_network_package("x")) == r"\documentclass[a4]{standalone}"
    begun = one(spark, "\\documentclass{article}\n\\begin{tikzpicture}x\\end{tikzpicture}\n\\end{document}", L.as_document("x"))
    assert begun.index("\\documentclass") < begun.index("\\begin{document}") < begun.index("\\begin{tikzpicture}")
    assert one(spark, "x", L.as_document("x")).endswith("\\begin{document}\nx\n\\end{document}")
    code = "\\usepackage{q}\n\\newcommand{\\a}{b}\n% c\n\\documentclass{zzz}\n\\definecolor{me}{rgb}{1,0,0}\n\\begin{document}x"
    assert tuple(one(spark, code, L.preamble_parts("x", ["article"]))) == ("\\documentclass{article}", "\\usepackage{q}\n\\definecolor{me}{rgb}{1,0,0}")
    assert one(spark, "\\definecolor{red one}{rgb}{1}\n\\definecolor{me}{rgb}{1,0,0}\n\\definecolor{men}{rgb}{0,0,0}", L.colour_definitions("x", F.lit("fill=me, mend"))) == "\\definecolor{me}{rgb}{1,0,0}"
    built = one(spark, "a\n\\begin{tikzpicture}\n\n\\input{q}\\draw[me];\n\\end{tikzpicture} z", L.build_document(F.lit("tikzpicture"), "x", F.lit("\\usepackage{k}\n\\foo"), F.lit("\\definecolor{me}{rgb}{1,0,0}"), F.lit("\\newcommand{\\u}{}")))
    assert built == "\\documentclass[tikz]{standalone}\n\n\\definecolor{me}{rgb}{1,0,0}\n\n\\newcommand{\\u}{}\n\n\\usepackage{k}\n\n\\begin{document}\n\n\\begin{tikzpicture}\n\\draw[me];\n\\end{tikzpicture}\n\n\\end{document}"
    assert one(spark, r"\begin{document}\begin{tikzpicture}1\end{tikzpicture}x\begin{tikzpicture}2\end{tikzpicture}", F.size(L.page_documents("x"))) == 2
    assert one(spark, "% a\n\\input{x}\n\\draw { };\n\\maketitle\n", L.filter_lines("x")) == "\\draw {};"


def test_detection(spark):
    assert one(spark, r"\begin{axis} \node[right of=a] stealth", L.required_packages("x"), L.required_libraries("x")) == (["pgfplots"], ["arrows.meta", "positioning"])
    assert one(spark, r"\usetikzlibrary{fit,animations}", L.is_uncompilable("x")) is True
    assert one(spark, "nothing", L.required_packages("x")) == []
