"""Queries on tables of odd texts and of larger size, and what keeps them within bounds."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from skimmer.functions import latex as L
from skimmer.functions import providers as P
from skimmer.functions import steady
from skimmer.functions.latex import closing
from skimmer.functions.tex_scanner import scanned
from skimmer.operators import clusters as C
from skimmer.operators.bucketed import BucketedStore
from skimmer.plans import catalogue
from skimmer.sources import feeds
from skimmer.sources.tables import conform
from skimmer.streaming import stateful as K


def against_sql(spark, folder, name):
    """Rows of a query and of its SQL over the tables in ``folder``."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}/*.parquet')")
    found = catalogue.queries()[name](spark, str(folder))
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, wanted))


@pytest.fixture
def odd_texts(spark, tmp_path):
    texts = ["", "123 456", "   ", "日本語", "a b", "Some text: with signs", None, "Abc " * 3000]
    rows = [(k, t, "en", "web" if k % 3 else "s", len(t or "")) for k, t in enumerate(texts * 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


def test_texts_without_letters_keep_their_space(spark, odd_texts):
    found, wanted = against_sql(spark, odd_texts, "feed_xml")
    assert found == wanted and any("'d0 '" in x for x in found)


def test_comments_after_texts_without_letters(spark, odd_texts):
    found, wanted = against_sql(spark, odd_texts, "tex_comments")
    assert found == wanted and any("{First}\\n\\n50" in x for x in found)
    alone = spark.createDataFrame([("a\n % c\nb % d\n% e\n",)], "t string").select(L.without_comments(F.col("t")).alias("x")).first()["x"]
    assert alone == "a\nb\n"  # a line with nothing but a comment goes whole, as before


def test_items_of_texts_without_letters(spark, odd_texts):
    found, wanted = against_sql(spark, odd_texts, "tex_environments")
    assert found == wanted and any("\\n1.  \\n2." in x for x in found)
    assert L.environments("\\begin{enumerate}\\item  \\item\n b\\end{enumerate}") == "\n1. \n2. b"  # blanks before an item's content go, as before


def test_workers_see_a_megabyte_at_a_time():
    seen, texts = [], pa.array(["x" * 300_000, None, ""] * 40)
    for part in steady.slices(texts):
        seen.append(pa.compute.sum(pa.compute.binary_length(part)).as_py())
    assert sum(seen) == 12_000_000 and max(seen) <= steady.SLICE_BYTES + 300_000
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a", "b"])], ["id", "text"])
    assert [len(p) for p in steady.slices(batch, batch.column(1))] == [2] and list(steady.slices(texts[:0])) == []


def test_long_plain_text_is_passed_over():
    text = "\\textbf{W}" + "Some words. " * 1_000_000 + "{x~"
    begun = time.process_time()
    assert scanned(text) == "W" + "Some words. " * 1_000_000 + "{x~"
    assert closing("{" + "a" * 5_000_000 + "\\}{}}", 0) == 5_000_005
    assert time.process_time() - begun < 0.25


def test_only_what_is_asked_goes_to_workers(spark):
    rows = spark.createDataFrame([(k, "é" * 9000 if k % 2 else None) for k in range(50)], "id long, text string")
    plan = P.translated(rows, lambda t: [f"T:{x}" for x in t], "id")
    assert "substring" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["id"] % 2, r["translation"]) for r in plan.collect()} == {(1, "T:" + "é" * 6000), (0, "T:")}


def test_items_of_a_file_as_those_of_the_whole(spark, tmp_path):
    head = "<rss><channel><title>not this</title><link>https://x/abs/0</link>"
    own = lambda k: f"<item><title>t{k}</title><link>https://x/abs/{k}</link><description>{'日本 ' * (k % 50)}</description></item>\n"
    texts = [head + "".join(own(k) for k in range(900)) + "</channel></rss>", "".join(own(k) for k in range(5)) + "<item>", head, "", "<item><item>" + own(7) + "<item"]
    (tmp_path / "feeds").mkdir()
    for k, t in enumerate(texts):
        (tmp_path / f"feeds/f{k}.xml").write_text(t)
    wanted = sorted(r["item"] for r in feeds.read_files(spark, str(tmp_path / "feeds")).select(F.explode(feeds.items(F.col("content"))).alias("item")).collect() if r["item"])
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for size in (before, "3000b", "777b"):  # a file is read in blocks, and a task reads blocks of several files
        spark.conf.set(key, size)
        try:
            got = feeds.read_items(spark, str(tmp_path / "feeds")).collect()
        finally:
            spark.conf.set(key, before)
        assert sorted(r["item"] for r in got if r["item"]) == wanted
        assert len({(r["path"], r["block"], r["item_no"]) for r in got}) == len(got)
        assert size == before or len({r["block"] for r in got}) > 5
    first = sorted((r for r in got if r["path"].endswith("f0.xml")), key=lambda r: (r["block"], r["item_no"]))
    assert [r["item"][:10].split("<")[1] for r in first[:3]] == ["title>t0", "title>t1", "title>t2"]


def test_clusters_go_on_until_they_rest(spark, monkeypatch):
    v = np.random.default_rng(11).normal(size=(900, 3))
    rows = spark.createDataFrame([(x.tolist(), 2) for x in v], "vector array<double>, status int")
    monkeypatch.setattr(C, "PASSES", 2)  # all runs would end far from rest
    found = C.fit_centroids(rows, "positive", restarts=2)
    centers = np.array([r["centroid"] for r in found.orderBy("cluster_id").collect()])
    means, weight, _ = C.moved(C.weighted_vectors(rows, "positive"), {0: centers})[0]
    assert weight.sum() == 1800 and np.abs(means - centers).max() < 1e-4
    again = C.fit_centroids(rows.repartition(5), "positive", restarts=2)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))


def test_a_change_moves_the_store_once(spark, tmp_path):
    rows = conform(spark.range(2000).selectExpr("CAST(id AS STRING) AS id", "repeat(md5(CAST(id AS STRING)), 30) AS title", "'l' AS link", "'s' AS source", "CAST(id % 4 AS INT) AS status"))
    store = BucketedStore(spark, f"{tmp_path}/articles", 8)
    store.create(rows)
    changes = spark.range(0, 2000, 2).selectExpr("CAST(id AS STRING) AS id", "'c' AS comment")
    moved = []
    stages = spark._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def shuffled():
        it, total = stages.stageList(None, False, False, quantiles, None).iterator(), 0
        while it.hasNext():
            total += it.next().shuffleWriteBytes()
        return total

    for change in (lambda: store.rows().repartition(8, "id").write.format("noop").mode("overwrite").save(), lambda: store.update(changes, ["comment"]), store.mark_all_read):
        before = shuffled()
        change()
        time.sleep(1)  # what stages have moved is told a little later
        moved.append(shuffled() - before)
    assert moved[1] < 1.5 * moved[0] and moved[2] < 0.1 * moved[0]
    assert store.rows().where("comment = 'c'").count() == 1000 and store.rows().where("status = 3").count() == 1000


class _State:
    def __init__(self, calls, value=None):
        self.calls, self.value = calls, value

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None


class _Handle:
    def __init__(self, calls):
        self.calls, self.timers = calls, set()

    def listTimers(self):
        self.calls.append("listTimers")
        return iter(self.timers)

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.add(at)


def test_states_are_asked_no_more_than_needed():
    calls = []
    memory = K._Memory(5_000)
    memory.handle, memory.seen = _Handle(calls), _State(calls)
    assert list(memory.handleInputRows((1,), iter([{"us": 3_000}, {"us": 1_000}]), None)) == []
    assert calls == ["get", "registerTimer", "update"] and memory.handle.timers == {8}
    calls.clear()
    assert list(memory.handleInputRows((1,), iter([{"us": 2_000}]), None)) == [] and calls == ["get", "update"]
    calls.clear()
    told = list(memory.handleInputRows((1,), iter([{"us": 20_000}]), None))
    assert [(r["first"], r["last"], r["n"]) for r in told] == [(1_000, 3_000, 3)] and memory.handle.timers == {25}
    assert calls == ["get", "deleteTimer", "registerTimer", "update"]
    calls.clear()
    last = K._LastStatus()
    last.last = _State(calls)
    assert len(list(last.handleInputRows((1,), iter([{"us": 1, "event_id": 1, "status": 2}]), None))) == 1 and calls == ["get", "update"]
