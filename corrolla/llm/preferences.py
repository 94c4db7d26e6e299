"""Chat formatting: preference pairs as one prompt, the turns both conversations begin with, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values. How a turn is written; the learned part of an assistant's turn is its text and the closing mark.
OPEN, CLOSE, CLOSE_LINE = ("<|{}|>\n", "<|end|>", "\n")
LEARNED_ROLE = "assistant"


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, role, text) in order, for each conversation.

    Rows alike count once, before anything is gathered. Turns with the same number are ordered by role and text; a null
    number comes first, a null role is "unknown", a null text empty. Rows without a conversation are left out.
    """
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return clean.distinct().groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def _written(turns: Column) -> Column:
    opened, closed = OPEN.split("{}")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(opened), t["role"], F.lit(closed), t["text"], F.lit(CLOSE + CLOSE_LINE))), "")


def _learned(turns: Column) -> Column:
    """start:end of what is learned in the written turns, in code points, comma-joined."""
    frame = len(OPEN.format(""))

    def step(acc, t):
        start = acc["at"] + F.char_length(t["role"]) + frame
        end = start + F.char_length(t["text"]) + len(CLOSE)
        mine = F.when(t["role"] == LEARNED_ROLE, F.array(F.concat_ws(":", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + len(CLOSE_LINE)).cast("int").alias("at"), F.concat(acc["spans"], mine).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc["spans"], ","))


def format_pairs(rows: DataFrame, chosen: str, rejected: str, *keys: str) -> DataFrame:
    """keys, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask and usable for rows with two arrays of turns.

    The prompt is the longest run of first turns that both have, by role and text; each completion is what follows in
    its own. A mask lists the stretches of a completion that are learned: an assistant's text with its closing mark.
    A pair is usable if both masks list something and the completions differ; the others stay, marked.
    """
    rows = rows.select(*keys, F.col(chosen).alias("_chosen"), F.col(rejected).alias("_rejected"))
    shorter = "least(size(_chosen), size(_rejected))"
    same = "get(_chosen, i).role = get(_rejected, i).role AND get(_chosen, i).text = get(_rejected, i).text"
    rows = rows.withColumn("_n", F.expr(f"array_min(filter(sequence(0, {shorter}), i -> i >= {shorter} OR NOT ({same})))"))
    rest = lambda x: F.slice(F.col(x), F.col("_n") + 1, F.greatest(F.size(x) - F.col("_n"), F.lit(0)))
    out = rows.select(
        *keys,
        F.col("_n").cast("long").alias("n_prompt_turns"),
        _written(F.slice("_chosen", F.lit(1), F.col("_n"))).alias("prompt"),
        _written(rest("_chosen")).alias("chosen"),
        _written(rest("_rejected")).alias("rejected"),
        _learned(rest("_chosen")).alias("chosen_mask"),
        _learned(rest("_rejected")).alias("rejected_mask"),
    )
    return out.withColumn("usable", F.expr("chosen_mask <> '' AND rejected_mask <> '' AND chosen <> rejected"))


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """format_pairs for each row of pairs (pair_id, chosen_id, rejected_id), which names two conversations.

    A conversation that is null or missing has no turns. Conversations are rows of the result, so their length is bounded
    by a row's. Further columns play no part; empty tables give an empty result.
    """
    own = conversations_as_rows(turns)
    side = lambda x: own.select(F.col("conv_id").alias(f"{x}_id"), F.col("turns").alias(f"_{x}"))
    rows = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    rows = rows.withColumns({f"_{x}": F.coalesce(f"_{x}", none) for x in ("chosen", "rejected")})
    return format_pairs(rows, "_chosen", "_rejected", "pair_id")


def swapped_replies(turns: DataFrame) -> DataFrame:
    """format_pairs for each conversation (pair_id is its id): up to its last reply as chosen, and the same with that
    reply taken from its neighbour, the conversation whose id differs in the last bit, as rejected.

    So all turns before the reply are shared. Without a neighbour that replies, the rejected one ends before the reply;
    a conversation without any reply is both; neither is usable, nor are equal replies. Null ids are left out; null
    roles, texts and turn numbers are taken as by conversations_as_rows; empty tables give an empty result.
    """
    own = conversations_as_rows(turns)
    own = own.withColumn("_at", F.expr(f"array_max(filter(sequence(0, size(turns) - 1), i -> turns[i].role = '{LEARNED_ROLE}'))"))
    other = own.where("_at IS NOT NULL").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.expr("turns[_at].text").alias("_other"))
    rows = own.join(other, "conv_id", "left")
    rows = rows.withColumn("_chosen", F.expr("CASE WHEN _at IS NULL THEN turns ELSE slice(turns, 1, _at + 1) END"))
    put = "array(named_struct('turn', turns[_at].turn, 'role', turns[_at].role, 'text', _other))"
    rejected = f"CASE WHEN _at IS NULL THEN turns WHEN _other IS NULL THEN slice(turns, 1, _at) ELSE concat(slice(turns, 1, _at), {put}) END"
    return format_pairs(rows.withColumn("_rejected", F.expr(rejected)).withColumnRenamed("conv_id", "pair_id"), "_chosen", "_rejected", "pair_id")


def op7_preference_pairs(spark, sf_dir: str) -> DataFrame:
    """The table names no preferences: a conversation's own reply is chosen over its neighbour's."""
    return swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said
  FROM t
), k AS (SELECT conv_id, count(*) AS turns, max(i) FILTER (role = 'assistant') AS last FROM n GROUP BY conv_id),
reply AS (SELECT n.conv_id, n.text FROM n JOIN k ON n.conv_id = k.conv_id AND n.i = k.last),
p AS (
  SELECT k.conv_id, k.last, own.text AS own, other.text AS other,
    CASE WHEN k.last IS NULL THEN k.turns WHEN own.text = other.text THEN k.last + 1 ELSE k.last END AS common
  FROM k LEFT JOIN reply own ON own.conv_id = k.conv_id LEFT JOIN reply other ON other.conv_id = xor(k.conv_id, 1)
), d AS (SELECT *, last IS NOT NULL AND own IS DISTINCT FROM other AS differ FROM p)
SELECT d.conv_id AS pair_id, any_value(common) AS n_prompt_turns,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (i < common), '') AS prompt,
  any_value(CASE WHEN differ THEN '<|assistant|>' || chr(10) || own || '<|end|>' || chr(10) ELSE '' END) AS chosen,
  any_value(CASE WHEN differ AND other IS NOT NULL THEN '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) ELSE '' END) AS rejected,
  any_value(CASE WHEN differ THEN '14:' || (14 + length(own) + 7) ELSE '' END) AS chosen_mask,
  any_value(CASE WHEN differ AND other IS NOT NULL THEN '14:' || (14 + length(other) + 7) ELSE '' END) AS rejected_mask,
  any_value(differ AND other IS NOT NULL) AS usable
FROM d JOIN n USING (conv_id) GROUP BY d.conv_id
"""
