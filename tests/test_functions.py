"""Scalar functions, one case a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skimmer.functions import latex as L
from skimmer.functions import paper_html as H
from skimmer.functions import providers as P
from skimmer.functions import responses as G
from skimmer.functions import text as T
from skimmer.operators import papers, store
from skimmer.sources import feeds


def value(spark, column, **literals):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()] or [F.lit(1).alias("one")])
    return frame.select(column.alias("x")).first()["x"]


def on(spark, f, text, *more):
    return value(spark, f(F.col("t"), *more), t=text)


@pytest.mark.parametrize("raw, wanted", [
    ('[{"id": "a", "score": 0.5}]', [("a", 0.5)]), ('```json\n[{"id": "a", "score": 1.5}]\n```', [("a", 1.0)]), ('```\n[{"id": "a", "score": -0.3}]\n```', [("a", 0.0)]),
    ("no json", []), ("", []), ("[]", []), ('[{"score": 1}]', []), ('[{"id": "a"}]', []), ('[{"id": "a", "score": 1, "why": "x"}]', [("a", 1.0)]), ('[{"id": 7, "score": 1}]', []), ('[{"id": "a", "score": "1"}]', []),
    ('{"id": "a", "score": 1}', []), (' ```json\n[{"id": "a", "score": 0}]\n```\n', [("a", 0.0)]), (None, []),
])
def test_parsed_scores(spark, raw, wanted):
    got = spark.createDataFrame([(raw,)], "raw string").select(G.parsed_scores(F.col("raw")).alias("x")).first()["x"]
    assert [tuple(r) for r in got] == wanted


@pytest.mark.parametrize("text, n, wanted", [("abc", 5, "abc"), ("abcde", 5, "abcde"), ("abcdef", 5, "abcde..."), ("ééééé!", 5, "ééééé...")])
def test_truncated(spark, text, n, wanted):
    assert on(spark, T.truncated, text, n) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("2401.00001", "2401.00001"), ("2401.00001v2", "2401.00001v2"), ("hep-ph/9901001", "hep-ph/9901001"), ("https://arxiv.org/abs/2401.00001v2", "2401.00001v2"), ("https://arxiv.org/pdf/2401.00001.pdf", "2401.00001"),
    ("https://arxiv.org/html/2401.00001/", "2401.00001"), ("arxiv:2401.00001", "2401.00001"), ("ARXIV:2401.00001", "2401.00001"), (" odd ", "odd"),
])
def test_normal_id(spark, given, wanted):
    assert on(spark, T.normal_id, given) == wanted


def test_ids(spark):
    assert on(spark, T.id_from_link, "https://arxiv.org/abs/solv-int/9901001v3") == "solv-int/9901001"
    assert on(spark, T.id_from_link, "https://arxiv.org/abs/solv-int/9901001", True) == "sol"
    assert on(spark, T.ids_in, "x 2401.00001v1, cs/9901001; 2401.00001v1") == ["2401.00001v1", "cs/9901001"]
    assert on(spark, T.valid_ids, "2401.00001\n\n cs.AI/9901001v2") is True and on(spark, T.valid_ids, "2401.00001\nfoo") is False
    assert on(spark, T.number_entry, "4a5b6") == 45 and on(spark, T.number_entry, "x") == 0
    assert on(spark, T.upper_entries, "cs.ai, cs.AI ,,x") == ["CS.AI", "X"]


def test_math_tokens(spark):
    got = on(spark, T.math_tokens, "a $x$ b \\[y\\] \\(z\\) $$w$$ cost $5")
    assert [(t["math"], t["display"], t["content"]) for t in got] == [
        (False, False, "a "), (True, False, "x"), (False, False, " b "), (True, True, "y"), (False, False, " "), (True, False, "z"), (False, False, " "), (True, True, "w"), (False, False, " cost $5")
    ]


def test_authors(spark):
    assert on(spark, T.short_authors, "a, b, c, d, e") == "a, b, c, d, e"
    assert on(spark, T.short_authors, "a, b, c, d, e, f") == "a, b, c, et. al., e, f"


def test_feed_items(spark):
    rss = "<rss><item><title>A</title><link>https://arxiv.org/abs/1.1v1</link><description>x Abstract: y </description><category>c</category></item>"
    rss += "<item><title>B</title><link>https://arxiv.org/abs/1.2</link><arxiv:announce_type>replace</arxiv:announce_type></item><item><title></title><link>l</link></item><item><title>C</title><link>elsewhere</link><dc:creator>D</dc:creator></item>"
    got = feeds.parsed_items(spark.createDataFrame([(rss,)], "content string")).orderBy("item_no").collect()
    assert [(r["title"], r["abstract"], r["author"], r["category"]) for r in got] == [("A", "y", None, "c"), ("C", "", "D", None)]
    assert got[0]["id"] == "1.1" and len(got[1]["id"]) == 32
    assert feeds.parsed_items(spark.createDataFrame([], "content string")).count() == 0


def test_atom_entries(spark):
    one = '<feed><entry><link href="http://arxiv.org/abs/2401.1v2"/><title>A\nB</title><summary> s </summary><author><name> N </name></author><category term="cs.AI"/></entry>'
    got = feeds.parsed_entries(spark.createDataFrame([(one + '<entry><link href="http://arxiv.org/pdf/1"/></entry>',)], "content string")).collect()
    assert [(r["id"], r["title"], r["abstract"], r["author"], r["category"]) for r in got] == [("2401.1", "A B", "s", "N", "cs.AI")]


def test_archives(spark, tmp_path):
    import gzip
    import io
    import tarfile

    def tar(**files):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, text in files.items():
                info = tarfile.TarInfo(name.replace("__", "."))
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
        return out.getvalue()

    rows = [("p", tar(main__tex="A")), ("g", gzip.compress(tar(main__tex="B"))), ("s", gzip.compress(b"\\documentclass{x}")), ("t", b"plain"), ("bad", tar(**{"../x": "C"})), ("none", None)]
    got = {r["paper"]: (r["path"], r["content"], r["problem"]) for r in feeds.archive_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["p"][:2] == ("main.tex", "A") and got["g"][:2] == ("main.tex", "B") and got["s"][1] == "\\documentclass{x}" and got["t"][1] == "plain"
    assert got["bad"][0] is None and "unsafe" in got["bad"][2]


def test_paper_html(spark):
    page = '<h1 class="ltx_title_document">T <b>x</b></h1><div class="ltx_authors">A and B, c@d</div><section><p>one</p><section><p>two</p></section>lost</section>'
    assert on(spark, H.paper_text, page) == "T x\n\nAuthors: A, B\n\none\n\ntwo"
    assert on(spark, H.decoded, "&amp;lt; &nbsp;&#39;") == "<  '"
    assert on(spark, H.math_to_latex, '<math><annotation encoding="application/x-tex"> a\\b $ </annotation></math>') == "$a\\b $$"
    assert spark.createDataFrame([(None,)], "t string").select(H.paper_text(F.col("t")).alias("x")).first()["x"] is None
    assert on(spark, H.paper_text, "") == ""


@pytest.mark.parametrize("tex, wanted", [
    ("a % c\n% d\n5\\% e", "a\n5% e"), ("\\begin{document}x\\end{document}y", "x"), ("\\begin{itemize}\\item a \\item b\\end{itemize}", "- a \n- b"), ("\\begin{enumerate}\\item a\n\\item b\\end{enumerate}", "1. a\n\n2. b"),
    ("\\begin{equation}x\\end{equation}", "$ x $"), ("\\begin{figure}\\caption{A {b} c}\\end{figure}", "Caption: A {b} c"), ("\\newcommand{\\x}{y}\\x\\x1 \\x{}", "y\\x1 y{}"),
    ("\\newcommand{\\f}[2]{#2#1}\\f{a}{b}", "ba"), ("\\def\\x{1}\\newcommand{\\x}{2}\\x", "1"), ("\\DeclareMathOperator{\\argmax}{arg max}\\argmax", "arg max"), ("\\newcommand{\\a}{\\b}\\newcommand{\\b}{\\a}\\a", "\\a"),
    ("\\'e \\\"{u} \\c{c} \\v{s} \\ss{} \\o x", "é ü ç š ß ø x"), ("\\lambda \\omega \\in \\infty \\leq \\rightarrow \\Pi cap", "λ ω ∈ ∞ ≤ → Π cap"), ("\\frac{a}{b} \\sqrt[3]{c}", "(a/b) sqrt(c)"), ("", ""),
])
def test_latex(spark, tex, wanted):
    assert on(spark, L.latex_text, tex) == wanted


def test_environments_in_environments():
    nested = "\\begin{itemize}\\item a\\begin{enumerate}\\item x\\item y\\end{enumerate}\\item b\\end{itemize}"
    assert L.environments(nested) == "\n- a\n1. x\n2. y\n- b"
    assert L.environments("\\begin{itemize}\\item a\\begin{itemize}\\item b\\end{itemize}\\end{itemize}") == "\n- a\n- b"
    assert L.environments("a\\end{itemize}\\begin{align}x") == "a\\end{itemize}\\begin{align}x"
    assert L.environments("\\begin{figure}\\begin{equation}x\\end{figure}y") == "y"
    assert len(L.environments("\\begin{itemize}" * 20_000)) == 15 * 20_000


def test_accents_of_any_letter():
    assert L.accents("\\v{g} \\u{a} \\.z \\k{e} \\=o \\H o \\'{ n } \\d{s}") == "ǧ ă ż ę ō ő ń ṣ"
    assert L.accents("\\'q") == "q\u0301" and L.accents("\\vspace \\c{c}") == "\\vspace ç"


def test_vectors_as_bytes(spark):
    rows = spark.createDataFrame([(b"\x00\x00\x80?\x00\x00\x00\xc0",), (None,), (b"abc",), (b"",)], "b binary")
    got = rows.select(T.vector_of_bytes(F.col("b")).alias("v")).collect()
    assert [r["v"] for r in got] == [[1.0, -2.0], None, None, []]
    back = spark.createDataFrame([([1.0, -2.0],), (None,)], "v array<float>").select(T.bytes_of_vector(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in back] == [bytearray(b"\x00\x00\x80?\x00\x00\x00\xc0"), None]


def test_translation_is_tried_again(spark):
    calls = []

    def flaky(texts):
        calls.append(texts)
        if texts[0].startswith("bad") or len(calls) % 2:
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([("1", "hello"), ("2", "bad"), ("3", None), ("4", "x" * 7000)], "id string, text string").coalesce(1)
    got = {r["id"]: (r["translation"], r["signature"]) for r in P.translated(rows, flaky).collect()}
    assert got["1"][0] == "HELLO" and got["2"][0] is None and got["3"][0] == "" and got["4"][0] == "X" * 6000
    assert all(len(s) == 32 for _, s in got.values())


def test_translations_fall_back_to_the_originals(spark):
    rows = spark.createDataFrame([("1", "a", "b"), ("2", "c", "d")], "id string, title string, abstract string")
    said = spark.createDataFrame([('[{"id":"1","title":"A","abstract":"B"}]',), ("broken",), (None,)], "response string")
    got = {r["id"]: (r["translated_title"], r["translated_abstract"]) for r in G.with_translations(rows, said).collect()}
    assert got == {"1": ("A", "B"), "2": ("c", "d")}
    assert {r["translated_title"] for r in G.with_translations(rows, said.limit(0)).collect()} == {"a", "c"}


def test_writes(spark, tmp_path):
    stored = spark.createDataFrame([("1", 5, 5, 5, None), ("2", 6, 6, 6, None)], "id string, hf_upvotes int, ax_upvotes int, ax_downvotes int, votes_updated_at timestamp")
    failed = spark.createDataFrame([("2", None, None, None)], "id string, hf_upvotes int, ax_upvotes int, ax_downvotes int")
    got = {r["id"]: r for r in store.update_votes(stored, failed).collect()}
    assert got["1"]["hf_upvotes"] == 5 and got["1"]["votes_updated_at"] is None and got["2"]["hf_upvotes"] is None and got["2"]["votes_updated_at"] is not None
    assert store.stamped(stored.select("id")).where("timestamp IS NULL").count() == 0
    papers.write_texts(spark.createDataFrame([("a\nb",), (None,), ("c",)], "text string"), str(tmp_path / "texts"))
    assert sorted(r["value"] for r in spark.read.option("lineSep", "\f").text(str(tmp_path / "texts")).collect()) == ["a\nb", "c"]


def test_prompts_of_any_number_of_entries(spark):
    rows = spark.createDataFrame([(str(k), "T", "x", 2, "", k) for k in range(500)], "id string, title string, abstract string, status int, comment string, t int").withColumn("timestamp", F.timestamp_seconds("t"))
    got = [r["prompt"] for r in G.profile_prompts(rows, size=3).collect()]
    assert sum(p.count("[liked]") for p in got) == 500 and max(p.count("[liked]") for p in got) <= 3


def test_latex_older_order(spark):
    got = on(spark, lambda c: L.signs(c, True), "\\lambda \\chi cap \\Pi \\\"u \\'e")
    assert got == "łambda hi ∩ ¶i u é"


def test_long_arguments_do_not_overflow(spark):
    assert len(on(spark, L.simple_macros, "\\footnote{" + "x{y}" * 20_000 + "}")) == 80_003
    assert len(on(spark, L.latex_text, "\\newcommand{\\a}{\\a\\a}\\a" * 3)) < 2_000_000


def test_flattened():
    files = {"main.tex": "a \\input{b} \\input{b} \\include{c.tex} \\input{none}\n% \\input{c}\n\\\\% x \\input{b}", "b.tex": "B\\input{main}", "c.tex": "C"}
    assert papers.flattened(files, "main.tex") == "a B  C \\input{none}\n% \\input{c}\n\\\\% x \\input{b}"
    assert papers.commented("a % b") and not papers.commented("a \\% b") and papers.commented("a \\\\% b")


def test_main_file(spark):
    doc = "\\documentclass{a}\n"
    rows = [("1", "x/paper.tex", doc), ("1", "main.tex", "none"), ("1", "long.tex", doc * 9), ("2", "a.tex", doc), ("2", "b.tex", doc * 2), ("2", "c.tex", doc * 2), ("3", "a.txt", doc), ("4", None, None)]
    got = {r["paper"]: r["path"] for r in papers.main_files(spark.createDataFrame(rows, "paper string, path string, content string")).collect()}
    assert got == {"1": "x/paper.tex", "2": "b.tex"}


def test_page_or_source(spark):
    pages = spark.createDataFrame([("1", '<h1 class="ltx_title_document">Page</h1>')], "paper string, html string")
    tex = spark.createDataFrame([("1", "Source"), ("2", "Only")], "paper string, latex string")
    assert {r["paper"]: r["text"] for r in papers.paper_texts(pages, tex).collect()} == {"1": "Page", "2": "Only"}
    assert {r["paper"]: r["text"] for r in papers.paper_texts(pages, tex, force_tex=True).collect()} == {"1": "Source", "2": "Only"}


def test_prompts(spark):
    rows = spark.createDataFrame([("a", "T", "x" * 301, 2, "good", 5), ("b", "U", None, -1, "", 4)], "id string, title string, abstract string, status int, comment string, t int")
    prompt = G.profile_prompt(rows.withColumn("timestamp", F.timestamp_seconds("t"))).first()["prompt"]
    assert prompt == "[liked] T\n" + "x" * 300 + "...\nComment: good\n\n[disliked] U\n"
    assert G.first_profile_prompt(rows.where("false")).first()["prompt"] == ""


def test_translations(spark):
    assert on(spark, G.translated_pair, "T") == '{"title":"T","abstract":""}'
    assert spark.createDataFrame([("nonsense",)], "t string").select(G.translations(F.col("t")).alias("x")).first()["x"] is None
    assert [tuple(r) for r in on(spark, G.translations, '[{"id":"1","title":"a","abstract":"b"}]')] == [("1", "a", "b")]


def test_store_edges(spark):
    stored = spark.createDataFrame([("1", "a", "l", "s")], "id string, title string, link string, source string")
    new = spark.createDataFrame([("1", "x", "l", "s", 0), ("2", "b", "l", "s", 2), ("2", "c", "l", "s", 1), ("3", None, "l", "s", 3), (None, "d", "l", "s", 4)], "id string, title string, link string, source string, seq int")
    assert [(r["id"], r["title"]) for r in store.new_rows(new, stored, "seq").collect()] == [("2", "c")]
    assert store.new_rows(new.limit(0), stored, "seq").count() == 0
    with pytest.raises(ValueError):
        store.listing(stored, order="score; drop table")


def test_includes_in_a_long_chain_and_in_circles():
    files = {"main.tex": "0 \\input{f1} end", **{f"f{k}.tex": f"{k} \\input{{f{k + 1}}}." for k in range(1, 5000)}, "f5000.tex": "\\input{main}\\input{f1}last"}
    assert papers.flattened(files, "main.tex") == " ".join(map(str, range(5000))) + " last" + "." * 4999 + " end"


def test_chat_request(spark):
    ask = lambda model, host, system, user: on(spark, lambda c: G.chat_request(F.lit(model).cast("string"), F.lit(host).cast("string"), F.lit(system).cast("string"), c), user)
    plain = '{"model":"m","messages":[{"role":"system","content":"S"},{"role":"user","content":"U \\"q\\""}],"temperature":0.3,"max_tokens":4000}'
    assert ask("m", "https://h", "S", 'U "q"') == plain and ask("m", None, "S", 'U "q"') == plain
    assert ask("qwq-1", "https://x.modelscope.y", "S", "U").endswith('"enable_thinking":false}') and "S /no_think" in ask("a-qwen", "h", "S", "U")
    assert ask(None, "h", "S", "U") is None and ask("m", "h", None, "U") is None
    assert on(spark, G.chat_answer, '{"choices":[{"message":{"content":"a"}}]}') == "a" and on(spark, G.chat_answer, "no json") is None and on(spark, G.chat_answer, '{"choices":[]}') is None
