"""Requests to and responses of language models: prompts, fences, score lists, translations; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimmer.functions.text import trim_all, truncated
from skimmer.sources.tables import CLICKED, DISLIKED, LIKED

PAIRS = "array<struct<id:string,score:double>>"


def unfenced(raw: Column, compat: bool = False) -> Column:
    """A response without its code fence. ``compat`` trims last, so that a line end after the closing fence, or a space before the opening one, keeps it."""
    c = raw if compat else trim_all(raw)
    for pattern in (r"^(?:```json)+", r"^(?:```)+", r"(?:```)+$" if not compat else r"(?:```)+\z"):
        c = F.regexp_replace(c, pattern, "")
    return trim_all(c)


def parsed_scores(raw: Column, compat: bool = False) -> Column:
    """(id, score) of each item with a string id and a number as score, kept in [0, 1]; an empty array if it is no JSON array."""
    whole = F.try_parse_json(unfenced(raw, compat))
    items = F.try_variant_get(whole, "$", "array<variant>")
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    numeric = lambda x: kind(x, "$.score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    good = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.coalesce((kind(x, "$.id") == "STRING") & numeric(x), F.lit(False)))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get(x, "$.score", "double")))
    return F.transform(good, lambda x: F.struct(F.try_variant_get(x, "$.id", "string").alias("id"), clamp(x).alias("score"))).cast(PAIRS)


def article_block(id_: Column, title: Column, abstract: Column, length: int = 500) -> Column:
    return F.concat(F.lit("ID: "), id_, F.lit("\nTitle: "), title, F.lit("\nAbstract: "), truncated(F.coalesce(abstract, F.lit("")), length))


def score_prompts(batches: DataFrame, profile: str, order: str = "score") -> DataFrame:
    """(batch, prompt): the profile, then a block for each article of the batch, highest score first."""
    block = F.struct((-F.col(order)).alias("k"), F.col("id").alias("id"), article_block(F.col("id"), F.col("title"), F.col("abstract")).alias("b"))
    blocks = F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]), "\n\n")
    return batches.groupBy("batch").agg(F.concat(F.lit(f"Preferences:\n{profile}\n\nArticles:\n\n"), blocks).alias("prompt"))


def feedback_entry(status: Column, title: Column, abstract: Column, comment: Column, length: int = 300) -> Column:
    """What a reader did with an article, for the profile's update."""
    action = F.when(status == LIKED, "liked").when(status == CLICKED, "clicked").when(status == DISLIKED, "disliked").otherwise("read")
    note = F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit("\nComment: "), comment)).otherwise("")
    return F.concat(F.lit("["), action, F.lit("] "), title, F.lit("\n"), truncated(F.coalesce(abstract, F.lit("")), length), note)


def profile_prompt(feedback: DataFrame, profile: str = "") -> DataFrame:
    """One row (prompt): the profile so far, if any, and an entry for each feedback row, newest first. The feedback of a reader's month, not the corpus, is what goes in."""
    entry = F.struct((-F.unix_seconds("timestamp")).alias("k"), F.col("id").alias("id"), feedback_entry(F.col("status"), F.col("title"), F.col("abstract"), F.col("comment")).alias("e"))
    head = f"Current profile:\n{profile}\n\n" if profile else ""
    return feedback.agg(F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]), "\n\n")).alias("prompt"))


def profile_prompts(feedback: DataFrame, profile: str = "", size: int = 20) -> DataFrame:
    """(day, part, chunk, prompt): as ``profile_prompt``, over feedback of any size: a day's rows are dealt by a hash of their id, and a prompt has ``size`` entries at most, newest first."""
    rows = feedback.withColumns({"day": F.date_format("timestamp", "yyyy-MM-dd"), "part": F.substring(F.md5("id"), 1, 2)})
    turn = F.row_number().over(Window.partitionBy("day", "part").orderBy(F.desc("timestamp"), "id"))
    entry = F.struct((-F.unix_seconds("timestamp")).alias("k"), F.col("id").alias("id"), feedback_entry(F.col("status"), F.col("title"), F.col("abstract"), F.col("comment")).alias("e"))
    head = f"Current profile:\n{profile}\n\n" if profile else ""
    prompt = F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]), "\n\n"))
    return rows.withColumn("chunk", F.floor((turn - 1) / size).cast("int")).groupBy("day", "part", "chunk").agg(prompt.alias("prompt"))


def first_profile_prompt(liked: DataFrame, most: int = 100) -> DataFrame:
    """One row (prompt) of titles and short abstracts of liked papers; '' without any."""
    top = liked.orderBy("id").limit(most)
    block = F.struct("id", F.concat(F.lit("Title: "), F.col("title"), F.lit("\nAbstract: "), truncated(F.coalesce("abstract", F.lit("")), 300)).alias("b"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("prompt"))


def translations(raw: Column, compat: bool = False) -> Column:
    """(id, title, abstract) of a translation response; null if it does not parse. ``compat`` wants the key abstract_text."""
    kind = "array<struct<id:string,title:string,abstract_text:string>>" if compat else "array<struct<id:string,title:string,abstract:string>>"
    key = "abstract_text" if compat else "abstract"
    items = F.try_variant_get(F.try_parse_json(unfenced(raw, compat)), "$", kind)
    whole = F.forall(items, lambda x: x["id"].isNotNull() & x["title"].isNotNull() & x[key].isNotNull())
    return F.when(whole, F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x[key].alias("abstract"))))


def with_translations(rows: DataFrame, responses: DataFrame, compat: bool = False) -> DataFrame:
    """``rows`` (id, title, abstract and others) with translated_title and translated_abstract from ``responses`` (response); where no response
    that parses names the id, the originals stand there. Of several translations of an id the smallest counts."""
    key = "abstract_text" if compat else "abstract"
    each = responses.select(F.explode(translations(F.col("response"), compat)).alias("t")).groupBy(F.col("t.id").alias("_id")).agg(F.min(F.struct("t.title", F.col("t.abstract").alias(key))).alias("_t"))
    both = rows.join(each, F.col("id") == F.col("_id"), "left")
    return both.withColumns({"translated_title": F.coalesce("_t.title", "title"), "translated_abstract": F.coalesce(f"_t.{key}", "abstract")}).drop("_id", "_t")


def translated_pair(raw: Column) -> Column:
    """First line as title, the rest as abstract: a JSON object as a string."""
    parts = F.split(trim_all(raw), "\n", 2)
    return F.to_json(F.struct(trim_all(parts[0]).alias("title"), trim_all(F.coalesce(F.get(parts, 1), F.lit(""))).alias("abstract")))


# A host that asks for a flag, and models whose system prompt asks them not to think aloud.
FLAGGED_HOST, THINKING_MODELS, NO_THINKING = "modelscope", ("qwen", "qwq"), " /no_think"


def chat_request(model: Column, base_url: Column, system: Column, user: Column, temperature: float = 0.3, max_tokens: int = 4000) -> Column:
    """The body of a chat request as JSON: two messages, and what the host and the model ask for besides. Null if the model or a message is."""
    thinks = F.coalesce(*[F.when(F.contains(model, F.lit(name)), True) for name in THINKING_MODELS], F.lit(False))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(
        model.alias("model"), F.array(message("system", F.when(thinks, F.concat(system, F.lit(NO_THINKING))).otherwise(system)), message("user", user)).alias("messages"),
        F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.when(F.contains(base_url, F.lit(FLAGGED_HOST)), False).alias("enable_thinking"),
    )
    return F.when(model.isNotNull() & system.isNotNull() & user.isNotNull(), F.to_json(body))


def chat_answer(response: Column) -> Column:
    """The assistant's text in the JSON of a chat response; null if there is none."""
    return F.get_json_object(response, "$.choices[0].message.content")
