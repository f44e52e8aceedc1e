"""The article store: inserts, merges, marks, retention, counts and reads, each a DataFrame in and a DataFrame out.

Tables are replaced as a whole or by partition when they are written; nothing here updates in place. Every
rule for repeated keys is explicit, and the id is the last sort key everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.sources.tables import CLICKED, DISLIKED, LIKED, SKIPPED, UNREAD


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows with equal keys the first in ``order``: an aggregate with a map-side step, not a sort."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others]).select(*rows.columns)


def last_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows with equal keys the last in ``order``."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others]).select(*rows.columns)


def new_rows(incoming: DataFrame, stored: DataFrame, order: str, key: str = "id", required: tuple[str, ...] = ("id", "title", "link", "source")) -> DataFrame:
    """What an insert that ignores known keys adds: rows without a required null, the first of each key, keys that are not stored."""
    fit = incoming.dropna(subset=[c for c in required if c in incoming.columns])
    return first_by(fit, [key], F.col(order)).join(stored.select(key), key, "left_anti")


def insert_ignore(incoming: DataFrame, stored: DataFrame, order: str, key: str = "id") -> DataFrame:
    """``stored`` with the new rows of ``incoming``; stored rows stay as they are."""
    return stored.unionByName(new_rows(incoming, stored, order, key), allowMissingColumns=True)


def existing(ids: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).distinct().join(stored.select(key), key, "left_semi")


def merge(stored: DataFrame, updates: DataFrame, columns: list[str], key: str = "id", dealt: str | None = None) -> DataFrame:
    """``stored`` with ``columns`` from ``updates`` (one row for each key) where it has the key, nulls included; unknown keys change nothing.

    ``dealt``: a column of both that the key decides, by which they may be dealt already.
    """
    new = updates.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns], *([F.col(dealt).alias("_dealt")] if dealt else []))
    same = F.col(key) == F.col("_key")
    both = stored.join(new, same & (F.col(dealt) == F.col("_dealt")) if dealt else same, "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def merge_scores(stored: DataFrame, scores: DataFrame, order: str) -> DataFrame:
    """Scores by id; of several for an id the last in ``order`` wins. The status is not looked at."""
    last = last_by(scores.select("id", "score", order), ["id"], F.col(order))
    return merge(stored, last, ["score"])


def update_translations(stored: DataFrame, translations: DataFrame) -> DataFrame:
    """Translated title and abstract by id, both at once."""
    return merge(stored, translations, ["translated_title", "translated_abstract"])


def update_votes(stored: DataFrame, scrapes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Three counters by id, and when they were asked for. A scrape that failed writes nulls, and the time all the same."""
    counters = ["hf_upvotes", "ax_upvotes", "ax_downvotes"]
    new = scrapes.select("id", *counters, (F.current_timestamp() if as_of is None else as_of).alias("votes_updated_at"))
    return merge(stored, new, [*counters, "votes_updated_at"])


def stamped(rows: DataFrame, as_of: Column | None = None, column: str = "timestamp") -> DataFrame:
    """``rows`` with the time of their writing where they bring none."""
    now = F.current_timestamp() if as_of is None else as_of
    return rows.withColumn(column, F.coalesce(F.col(column), now) if column in rows.columns else now)


def cleared(stored: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What clearing all leaves: the tables without rows."""
    return stored.where(F.lit(False)), settings.where(F.lit(False))


def set_comment(stored: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments by id; an empty one becomes null."""
    return merge(stored, comments.select("id", F.nullif(F.col("comment"), F.lit("")).alias("comment")), ["comment"])


def mark_all_read(stored: DataFrame) -> DataFrame:
    """Unread becomes skipped; nothing else changes. How many that are is ``count_where``'s matter."""
    return stored.withColumn("status", F.when(F.col("status") == UNREAD, SKIPPED).otherwise(F.col("status")))


def latest_status(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, status): the last status of each key in ``order``."""
    return last_by(changes.select(key, "status", *order), [key], *[F.col(c) for c in order]).select(key, "status")


def kept_since(stored: DataFrame, as_of: str, days: int = 30, column: str = "timestamp") -> DataFrame:
    """What retention keeps: rows not older than ``days`` days at ``as_of``. A null time is not older."""
    old = F.col(column) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return stored.where(~F.coalesce(old, F.lit(False)))


def dropped_before(stored: DataFrame, as_of: str, days: int = 30, column: str = "timestamp") -> DataFrame:
    return stored.where(F.col(column) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))


def recent_feedback(stored: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Liked, clicked and disliked rows of the last ``days`` days, newest first."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return stored.where(F.col("status").isin(CLICKED, LIKED, DISLIKED) & (F.col("timestamp") >= since)).orderBy(F.desc("timestamp"), "id")


def listing(stored: DataFrame, status: int | None = None, limit: int = 50, offset: int = 0, order: str = "score") -> DataFrame:
    """A page of the table by score or time, highest first; ``order`` is one of a fixed set of columns."""
    if order not in ("score", "timestamp", "id"):
        raise ValueError(f"cannot sort by {order!r}")
    rows = stored if status is None else stored.where(F.col("status") == status)
    return rows.orderBy(F.desc(order), "id").offset(offset).limit(limit)


#: What a client's copy of the table holds.
SHOWN = ("id", "title", "link", "abstract", "source", "category", "status", "score", "author", "comment", "translated_title", "translated_abstract")


def shown_rows(stored: DataFrame) -> DataFrame:
    """All rows with the columns that a client shows, highest score first; ``persist`` keeps them for a session."""
    return stored.select(*SHOWN).orderBy(F.desc("score"), "id")


def local_date(ts: Column, zone: str) -> Column:
    """The day that a time falls on in a zone, as YYYY-MM-DD."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def count_by_status(stored: DataFrame) -> DataFrame:
    return stored.groupBy("status").agg(F.count("*").alias("n"))


def stats(stored: DataFrame, least_liked: int = 5) -> DataFrame:
    """One row: a counter for each status, and whether enough is liked to learn from."""
    n = {name: F.count_if(F.col("status") == s).alias(name) for name, s in (("unread", UNREAD), ("clicked", CLICKED), ("liked", LIKED), ("skipped", SKIPPED), ("disliked", DISLIKED))}
    return stored.agg(*n.values()).withColumn("ready", F.col("liked") >= least_liked)


def count_where(stored: DataFrame, status: int) -> DataFrame:
    return stored.where(F.col("status") == status).agg(F.count("*").alias("n"))


def net_votes(up: str = "ax_upvotes", down: str = "ax_downvotes") -> Column:
    """Up minus down with a plus sign where not negative; null unless both are known."""
    n = F.col(up) - F.col(down)
    return F.when(F.col(up).isNotNull() & F.col(down).isNotNull(), F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string")))


def display(column: str, translated: str) -> Column:
    """The translation if it is not empty, else the original."""
    return F.coalesce(F.nullif(F.col(translated), F.lit("")), F.col(column))


def stays_visible(tab: Column, old: Column, new: Column) -> Column:
    """Whether a row stays in a tab of the list after its status changed."""
    return (
        F.when(old == new, True)
        .when(tab == "all", True)
        .when(tab == "unread", new.isin(UNREAD, CLICKED))
        .when(tab == "liked", new == LIKED)
        .otherwise(False)
    )


def upsert_settings(stored: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """(key, value): what is stored with the changes, of which the last in ``order`` wins."""
    both = stored.select("key", "value", F.lit(-1).cast("long").alias("_at")).union(changes.select("key", "value", F.col(order).cast("long")))
    return last_by(both, ["key"], F.col("_at")).drop("_at")


def settings_map(stored: DataFrame) -> DataFrame:
    """One row with all settings as a map."""
    return stored.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))


def parsed_settings(settings: Column) -> list[Column]:
    """Typed settings from a string map: what does not parse keeps its default, the ratio stays in [0, 1], true is exactly 'true'."""
    number = lambda key, kind, default: F.coalesce(F.expr(f"try_cast(settings['{key}'] AS {kind})"), F.lit(default).cast(kind)).alias(key)
    categories = F.filter(F.transform(F.split(F.coalesce(settings["categories"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return [
        F.array_join(categories, "|").alias("categories"), number("daily_papers", "int", 20),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(settings['diversity_ratio'] AS double)"), F.lit(0.3)))).alias("diversity_ratio"),
        F.coalesce(settings["auto_batch"] == "true", F.lit(False)).alias("auto_batch"), F.coalesce(settings["initialized"] == "true", F.lit(False)).alias("initialized"),
    ]


def recommendation_dates(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("recommend_date").isNotNull()).select("recommend_date").distinct().orderBy(F.desc("recommend_date"))


def batch_of(stored: DataFrame, date: str) -> DataFrame:
    return stored.where(F.col("recommend_date") == F.lit(date).cast("date")).orderBy("batch_order", "id")


def vote_update_counts(scrapes: DataFrame, compat: bool = False) -> DataFrame:
    """(updated, failed) of a vote scrape: ``compat`` counts a failed scrape as updated."""
    good = F.lit(True) if compat else F.col("hf_upvotes").isNotNull() | F.col("ax_upvotes").isNotNull()
    return scrapes.agg(F.count_if(good).alias("updated"), F.count_if(~good).alias("failed"))
