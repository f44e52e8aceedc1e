"""The filter audit against removing documents filter by filter."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

from skimmer.llm import audit as K

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = WORDS.findall(text)
        out.append(
            {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text]}
        )
    return out


def expected(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails, parts, out = failed(rows), defaultdict(list), {}
    for k, (_, _, source) in enumerate(rows):
        parts[source or ""].append(k)
    for part, own in parts.items():
        share = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [k for k in left if fails[k][x]]
                redundant = sum(fails[k][x] for k in own) - len(gone)
                left = [k for k in left if not fails[k][x]]
                share[x] += len(gone)
                only = sum(fails[k][x] and sum(fails[k].values()) == 1 for k in own)
                out[part, "".join(order), step] = [x, len(left), len(gone), redundant, only, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (p, _, _), told in out.items():
            if p == part:
                told.append(share[told[0]])
    return out


def got(df):
    assert df.columns == ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_odd_tables(spark):
    long = " ".join(f"word{k}" for k in range(250))
    rows = [(5, long, "a"), (3, long, None), (3, long, "b"), (9, long, "a"), (None, long, "a"), (None, long, "a"), (None, None, None), (1, None, "a"), (2, "", "a"), (2, "", "a"), (4, "x \x0b\x0c y", ""), (6, "Ab " * 300, "b")]
    rows += [(7, "ünï $ " * 400, "c"), (8, long.upper(), "c"), (10, "ABC# ", "b"), (11, long + " %", "c"), (12, long + " %", "c"), (13, " " + long, "a"), (14, "x" * 100_000, "a")]
    labels = [(5, 1, 0), (9, 1, 1), (9, 0, 1), (3, None, 1), (1, 1, None), (None, 1, 1), (6, 0, 0), (12, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, "m", 7, True) for x in rows], "doc_id long, text string, source string, mask int, part string, n long, good boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(K.filter_audit(docs.repartition(3), marks)) == expected(rows, labels)
    assert got(K.filter_audit(docs, marks.limit(0))) == expected(rows, [])
    assert K.filter_audit(docs.limit(0), marks).count() == 0


def test_query_over_all_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(K.op13_filter_audit(spark, sf_dir)) == expected(rows, labels)


def test_copies_of_one_text_are_few_rows_before_the_window(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same text' AS text", "'s' AS source")
    cells = K.failure_cells(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic").where("doc_id % 2 = 0"), K.text_filters(K.F.col("_text")), "E").collect()
    assert sorted((r["mask"], r["good"], r["n"]) for r in cells) == [(1, True, 1), (17, False, 1500), (17, True, 1499)]
