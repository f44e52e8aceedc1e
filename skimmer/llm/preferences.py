"""Chat formatting (operator 4): preference pairs with a shared prompt and masked completions, in column expressions only.

The turns that a chosen and a rejected conversation have in common at their beginning are rendered once, as the
prompt; what follows in each is its completion. Only what the assistant says in a completion is to be learned: spans say where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.llm.merkle import with_next
from skimmer.llm.shared import written

#: What stands before a turn's role, between role and text, and after the text.
OPEN, MIDDLE, CLOSE = "<|start|>", "\n", "<|end|>\n"
ASSISTANT = "assistant"

TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(``id_column``, turns): the turns of each conversation in order; ties of the number go by role, then text.

    Null roles and texts count as empty, null numbers come first, and turns with a null id are one conversation.
    Repeated rows are turns of their own. A row holds one conversation, which is one training example. An empty table gives an empty result.
    """
    turn = F.struct(F.col(turn_column).alias("k"), F.coalesce(role_column, F.lit("")).alias("role"), F.coalesce(text_column, F.lit("")).alias("text"))
    own = turns.select(F.col(id_column), turn.alias("_turn")).groupBy(id_column).agg(F.sort_array(F.collect_list("_turn")).alias("turns"))
    return own.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns that both begin with; an empty array has none."""
    n = F.least(F.size(a), F.size(b))
    other = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y), True)
    return F.when(other > 0, other - 1).otherwise(n).cast("int")


def rendered(turns: Column) -> Column:
    """The turns as one string; an empty array gives ''."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def learned_spans(turns: Column) -> Column:
    """Where ``rendered`` holds what the assistant says: 'begin:end' in code points, by commas. A turn's closing sign is learned with it."""
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.char_length(t["role"]) + head
        end = begin + F.char_length(t["text"]) + tail
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == ASSISTANT, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with n_common, prompt, and for either side its completion and learned spans, in place of the two columns of turns.

    ``chosen`` and ``rejected`` hold arrays of (role, text). A null array counts as empty. Equal conversations have empty
    completions; if one is the beginning of the other, only its completion is empty. Columns of the given names are replaced.
    """
    a, b = (F.coalesce(F.col(c), F.array().cast(TURNS)) for c in (chosen, rejected))
    n = F.col("n_common")
    rest = lambda turns: F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))
    out = pairs.withColumn("n_common", common_turns(a, b)).withColumn("prompt", rendered(F.slice(a, F.lit(1), n)))
    for side, turns in ((chosen, a), (rejected, b)):
        out = out.withColumn(f"_{side}", rest(turns)).withColumn(f"{side}_completion", rendered(F.col(f"_{side}"))).withColumn(f"{side}_spans", learned_spans(F.col(f"_{side}")))
    return out.drop(chosen, rejected, *[f"_{s}" for s in (chosen, rejected)])


def with_other_reply(convs: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(``id_column``, chosen, rejected): each conversation, and itself with the last reply of the next conversation that has one.

    Next is meant by ascending id; after the last comes the first. What followed the reply goes from the rejected one.
    Conversations without an assistant's turn have no reply and make no pair.
    """
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == ASSISTANT)), True).cast("int") + 1
    replied = convs.where(F.exists("turns", lambda t: t["role"] == ASSISTANT)).withColumn("_last", last)
    replied = written(replied.withColumn("_reply", F.element_at("turns", F.col("_last"))["text"]), "replied")  # read three times
    both = with_next(replied, id_column, ["turns", "_last", "_reply"])
    reply = F.struct(F.lit(ASSISTANT).alias("role"), F.col("next__reply").alias("text"))
    return both.select(id_column, F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("_last") - 1), F.array(reply)).alias("rejected"))


def op4_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_pairs(with_other_reply(conversations(turns))).select(
        "conv_id", "n_common", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans"
    )


OP4_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations),
last AS (SELECT conv_id, max(k) AS k FROM turns WHERE role = 'assistant' GROUP BY conv_id),
replies AS (SELECT t.conv_id, t.k, t.text FROM turns t JOIN last l ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.k = l.k),
pairs AS (
  SELECT conv_id, k,
         coalesce(lead(text) OVER (ORDER BY conv_id NULLS FIRST), first_value(text) OVER (ORDER BY conv_id NULLS FIRST)) AS other
  FROM replies),
sides AS (
  SELECT p.conv_id, t.k, 'chosen' AS side, t.role, t.text FROM pairs p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id
  UNION ALL
  SELECT p.conv_id, t.k, 'rejected', t.role, CASE WHEN t.k = p.k THEN p.other ELSE t.text END
  FROM pairs p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.k <= p.k),
lengths AS (SELECT conv_id, side, max(k) AS n FROM sides GROUP BY conv_id, side),
differing AS (
  SELECT a.conv_id, min(a.k) AS k
  FROM sides a JOIN sides b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.k = b.k AND a.side = 'chosen' AND b.side = 'rejected'
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.conv_id),
common AS (
  SELECT l.conv_id, CAST(coalesce(max(d.k) - 1, min(l.n)) AS INTEGER) AS n_common
  FROM lengths l LEFT JOIN differing d ON l.conv_id IS NOT DISTINCT FROM d.conv_id GROUP BY l.conv_id),
drawn AS (
  SELECT s.conv_id, s.side, s.k, s.role, c.n_common, '<|start|>' || s.role || chr(10) || s.text || '<|end|>' || chr(10) AS piece,
         length(s.role) + 10 AS head
  FROM sides s JOIN common c ON s.conv_id IS NOT DISTINCT FROM c.conv_id),
placed AS (
  SELECT *, CASE WHEN k > n_common THEN
           sum(CASE WHEN k > n_common THEN length(piece) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY k) - length(piece) END AS pos
  FROM drawn)
SELECT conv_id, n_common,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'chosen' AND k <= n_common), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'chosen' AND k > n_common), '') AS chosen_completion,
       coalesce(string_agg(CAST(pos + head AS VARCHAR) || ':' || CAST(pos + length(piece) AS VARCHAR), ',' ORDER BY k)
                FILTER (side = 'chosen' AND k > n_common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (side = 'rejected' AND k > n_common), '') AS rejected_completion,
       coalesce(string_agg(CAST(pos + head AS VARCHAR) || ':' || CAST(pos + length(piece) AS VARCHAR), ',' ORDER BY k)
                FILTER (side = 'rejected' AND k > n_common AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id, n_common
"""
