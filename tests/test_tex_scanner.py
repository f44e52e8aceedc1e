"""The one-pass LaTeX scanner: equal to the ordered rules where those can be right, and right where they can't."""

from __future__ import annotations

import random
import re
import time

import pytest

from skimmer.functions import latex as L
from skimmer.functions.tex_scanner import LETTERS, MACROS, MARKS, braces, composed, scanned

FLAT = [
    "\\label{a}", "\\index{b c}", "\\footnote{note {x} y}", "\\section{A}", "\\section*{B b}", "\\subsection{C}", "\\subsubsection*{D}", "\\caption{An {e} f}", "\\textbf{g}", "\\textit{h}", "\\emph{i {j}}",
    "\\texttt{k}", "\\textsc{l}", "\\textsf{m}", "\\cite{n,o}", "\\cite*[p. 3]{q}", "\\ref{r}", "\\eqref{s}", "\\url{http://t.u/v}", "\\href{http://w}{x {y}}", "\\item one", "\\title{T}", "\\author{A}", "\\date{D}",
    "\\maketitle ", "\\centering ", "\\noindent ", "\\hspace{1em}", "\\vspace*{2cm}", "\\newpage ", "\\clearpage ", "\\\\ ", "\\par ", "\\qquad ", "\\quad ", "\\left(", "\\right)", "\\mathbb{R}", "\\mathfrak{g}",
    "\\operatorname*{max}", "\\overline{z}", "\\underline{u}", "\\sqrt{2}", "\\sqrt[3]{4}", "\\frac{5}{6}", "\\begin{center} ", "\\begin{tabular}[t] ", "\\end{center} ", "\\includegraphics[width=1]{f.png}", "\\input{g}",
    "\\include{h}", "\\usepackage[utf8]{i}", "\\newcommand{\\foo}[1][x]{bar {#1}}", "\\renewcommand\\foo{baz}", "\\DeclareMathOperator{\\op}{op}", "\\bibitem[k]{l}", "\\bibliographystyle{m}", "\\textnormal{n}", "\\unknown{o}", "{plain}",
    "word", " ", "\n", "more text. ",
]


@pytest.mark.parametrize("seed", range(4))
def test_scan_equals_the_ordered_rules(seed):
    r = random.Random(seed)
    for _ in range(300):
        text = "".join(r.choice(FLAT) for _ in range(r.randint(0, 30)))
        assert scanned(text) == L.older_macros(text), text


def test_every_macro_letter_accent_and_sign():
    assert len(MACROS) == 59 and len(L.SIGNS) == 104
    for name, sign in L.SIGN_OF.items():
        for before, after in (("a", " b"), ("", ""), ("{", "}"), ("\\textbf{", "}")):
            kept = before.replace("\\textbf{", "") + sign + (after if before != "\\textbf{" else "")
            assert scanned(before + name + after, L.SIGN_OF) == kept, name
    every = " | ".join(L.SIGN_OF)
    assert scanned(every * 50, L.SIGN_OF) == " | ".join(L.SIGN_OF.values()) * 50
    for name, letter in LETTERS.items():
        assert scanned(f"x\\{name}{{}}y \\{name} z", L.SIGN_OF) == f"x{letter}y {letter} z"
    for command in MARKS:
        for letter in "aezA":
            for use in (f"\\{command}{{{letter}}}", f"\\{command} {{ {letter} }}", f"\\{command} {letter}"):
                assert scanned(f"q{use} r", L.SIGN_OF) == f"q{composed(command, letter)} r"
    assert scanned("\\'e\\~n\\t{oo} \\lambdax \\in\\infty~a\\", L.SIGN_OF) == "éño\u0361o \\lambdax ∈∞ a\\"


@pytest.mark.parametrize("text, wanted", [
    ("\\frac{\\frac{a}{b}}{\\sqrt{c}}", "((a/b)/sqrt(c))"), ("\\textbf{a \\emph{b {c {d}}}}", "a b {c {d}}"), ("\\footnote{\\cite{x} and \\url{y}}", " ([ref] and y)"), ("\\section{On \\texttt{\\alpha} {\\bf x}}", "\n\n=== On α {\\bf x} ===\n"),
    ("\\frac{a}", "\\frac{a}"), ("\\textbf{a", "\\textbf{a"), ("a} \\textbf{b}}", "a} b}"), ("\\textbf{}\\emph{}", ""), ("\\textbf{\\}}", "}"), ("\\itemsep \\parbox", "\\itemsep \\parbox"), ("\\textbackslash{}n", "\\n"),
    ("\\caption{\\label{a}\\caption{b}}", "Caption: Caption: b"), ("\\href{a}{}", " (a)"), ("", ""), ("\\", "\\"), ("a\\quadb\\qquadc", "a b  c"), ("\\~", "\\ "), ("\\frac{}{}x", "(/)x"),
])
def test_nested_and_broken_uses(text, wanted):
    assert scanned(text, L.SIGN_OF) == wanted


@pytest.mark.parametrize("text", ["\\textbf{" * 50_000 + "x" + "}" * 50_000, "\\frac{" * 50_000, "{" * 200_000, "\\footnote{a}" * 60_000, "\\cite[" * 60_000, "\\alpha\\'e~" * 60_000, "\\begin{a}" * 60_000])
def test_time_is_in_proportion(text):
    begin = time.perf_counter()
    out = scanned(text, L.SIGN_OF)
    assert time.perf_counter() - begin < 10
    assert out == "x" or not out.startswith("x")


def test_braces():
    assert braces("{a{b}\\}}{") == {0: 7, 2: 4}


def test_older_accents_are_what_their_marks_compose():
    for command, letter, sign in L.OLDER_ACCENTS:
        assert composed(command, letter) == sign
    assert len(L.OLDER_ACCENTS) == len({(c, x) for c, x, _ in L.OLDER_ACCENTS})


def test_whole_documents(spark):
    tex = "\\documentclass{a}\n\\begin{document}\\newcommand{\\R}{\\mathbb{R}}\n\\section{Gr\\\"o\\ss e}\n% gone\nIn $\\R^n$, \\textbf{see \\cite{a}}~5\\% \\frac{\\alpha}{\\sqrt{2}}\n\\begin{thebibliography}{1}\\bibitem{a} A\\end{thebibliography}\\end{document} after"
    df = spark.createDataFrame([(tex,), (None,), ("",)], "t string")
    found = [r["x"] for r in df.select(L.latex_text(L.F.col("t"), no_references=True).alias("x")).collect()]
    assert found == ["=== Größ e ===\n\nIn $R^n$, see [ref] 5% (α/sqrt(2))", None, ""]
    older = [r["x"] for r in df.select(L.latex_text(L.F.col("t"), True, compat=True).alias("x")).collect()]
    assert older[1:] == [None, ""] and re.search(r"\(.*/sqrt", older[0])


def test_steps_of_a_document_equal_their_columns(spark):
    r = random.Random(9)
    signs = ["a", "b ", "%", "\\%", "\\\\%", "\n", "\n\n\n\n", " \t", "\u00a0", "\u2003", "\x0b", "\\iffalse ", "\\fi ", "\\begin{document}", "\\end{document}", "\\begin{thebibliography}", "\\end{thebibliography}", "\\bibliography{x}", "\x1c"]
    rows = [("".join(r.choice(signs) for _ in range(r.randint(0, 25))),) for _ in range(1500)]
    c = L.F.col("t")
    columns = [L.without_comments(c).alias("plain"), L.without_bibliography(L.body(L.without_comments(c))).alias("made"), L.body(L.without_comments(c)).alias("kept"), L.clean_space(c).alias("tidy")]
    for row in spark.createDataFrame(rows, "t string").select("t", *columns).collect():
        assert row["plain"] == L._uncommented(row["t"]) and row["made"] == L._prepared(row["t"], True) and row["kept"] == L._prepared(row["t"], False) and row["tidy"] == L._tidy(row["t"]), repr(row["t"])
