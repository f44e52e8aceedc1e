"""The pipeline's stages on their own inputs, and the whole."""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as P
from skimmer.llm.catalogue import queries

sys.path.insert(0, str(Path(__file__).parent))
from test_jaccard import brute  # noqa: E402
from test_mixing import plain_targets  # noqa: E402
from test_packing import check as check_packing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_duplicates", "mixing", "packing"]
    kept = P.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() <= docs.count()
    one = P.one_of_each_class(spark, docs, sf_dir)
    classes = {r["doc_id"]: r["class_id"] for r in queries()["op6_jaccard_forest"](spark, sf_dir).collect()}
    assert one.columns == docs.columns and Counter(r["doc_id"] for r in one.collect()) == Counter(set(classes.values()))
    mixed = P.mix_sources(spark, docs, sf_dir)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    wanted = {r["doc_id"]: r["taken"] // r["size"] for r in queries()["op8_budget_mixing"](spark, sf_dir).collect() if r["taken"]}
    assert mixed.columns == docs.columns and copies == wanted


def test_odd_rows(spark, sf_dir):
    rows = [(1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", None, None, None), (2, "a b c d e f", None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one = P.one_of_each_class(spark, docs, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in one) == ["1", "3", "4", "None"]
    assert P.mix_sources(spark, docs, sf_dir).columns == docs.columns
    assert P.pack_sequences(spark, docs, sf_dir).count() == 6
    # null ids: one row of each class
    near = " ".join(f"w{k}" for k in range(100))
    lost = spark.createDataFrame([(None, near, "en", "s", 1), (None, near + " end", "en", "s", 1), (None, "quite another text of more words", "en", "s", 1), (5, near, "en", "s", 1)], SCHEMA)
    texts = [r["text"] for r in P.one_of_each_class(spark, lost, sf_dir).collect()]
    assert len(texts) == 2 and "quite another text of more words" in texts
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


CLASHING = (
    "_doc", "_id", "_sha", "_place", "_settled", "_turn", "_source", "_size", "_copies", "_copy", "_total", "_rows", "_row", "_text", "_key", "key", "class_key", "class_row", "n_links", "held_out", "score", "predicted", "row", "x",
    "piece", "start", "length", "a.b",
)


def test_columns_of_any_name_stay_as_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("*", *[P.F.concat_ws(":", P.F.lit(c), "doc_id").alias(c) for c in CLASHING])
    for name, stage in P.STAGES[:-1]:
        plain, got = stage(spark, docs, sf_dir), stage(spark, more, sf_dir)
        assert got.columns == more.columns
        rows = got.collect()
        assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, plain.collect())), name
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHING), name
    assert P.pack_sequences(spark, more, sf_dir).count() == P.pack_sequences(spark, docs, sf_dir).count()


def test_run_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it keeps: all pairs, targets by a plain loop, pieces by the library."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = P.drop_toxic(spark, docs, sf_dir).collect()
    classes = brute([(r["doc_id"], r["text"]) for r in clean])
    alone = {r["doc_id"]: r for r in clean if classes[r["doc_id"]][0] == r["doc_id"]}
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for k, r in alone.items()}
    totals: dict = {}
    for k, r in alone.items():
        totals[r["source"]] = totals.get(r["source"], 0) + sizes[k]
    targets = plain_targets(totals)
    got = P.run(spark, sf_dir).collect()
    copies = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert set(copies) <= set(alone) and max(copies.values()) <= 2
    for source, target in targets.items():
        own = [k for k, r in alone.items() if r["source"] == source]
        assert abs(sum(sizes[k] * copies[k] for k in own) - target) <= max([1, *(sizes[k] for k in own)])
    check_packing([(k, alone[k]["text"]) for k, n in copies.items() for _ in range(n)], got)
    assert P.ORACLE_SQL is None and "pipeline" in P.queries()


def _workers() -> float:
    """Megabytes that this session's Python workers hold for themselves."""
    total = 0
    for own in Path("/proc").glob("[0-9]*"):
        try:
            if b"pyspark" in (own / "cmdline").read_bytes() and b"worker" in (own / "cmdline").read_bytes():
                total += sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", (own / "smaps_rollup").read_text()))
        except OSError:  # it has ended
            continue
    return total / 1024


def test_memory_of_workers_does_not_grow_from_run_to_run(spark, sf_dir):
    held = []
    for _ in range(3):
        P.run(spark, sf_dir).count()
        held.append(_workers())
    assert held[2] <= 1.1 * held[0] + 10, held
