"""Preference formatting of conversation pairs, in DataFrame functions only.

A pair has two arrays of turns (role, text). Their longest common prefix of turns is rendered once, as the prompt; what follows it in
either is rendered as that side's completion. Each completion comes with character spans of which only those inside assistant turns
(their text and end mark) are marked for the loss; all else, and the whole prompt, is masked.

A null array or turn list counts as empty, a null role as `user`, a null text as empty. Equal sides have empty completions. Rows are
kept as they are, repeated ones too; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|start|>", "\n", "<|end|>\n"
_NO_TURNS = "array<struct<role:string,text:string>>"


def render_turn(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _clean(turns: Column) -> Column:
    return F.transform(
        F.coalesce(turns, F.array().cast(_NO_TURNS)),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def _tail(turns: Column, shared: Column) -> Column:
    return F.filter(turns, lambda _, i: i >= shared)


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def _spans(turns: Column) -> Column:
    """Start and end, in characters of the completion, of what assistants say."""
    head = F.lit(len(START) + len(MIDDLE))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + head + F.length(turn["role"])
        stop = begin + F.length(turn["text"]) + F.lit(len(END))
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(
            stop.alias("at"),
            F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, add, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, id_column: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """id, n_shared, prompt, chosen and rejected completions with their unmasked spans."""
    rows = pairs.select(F.col(id_column), _clean(F.col(chosen)).alias("c"), _clean(F.col(rejected)).alias("r"))
    # first place where the two differ, else the shorter one's length
    same = F.transform(F.arrays_zip("c", "r"), lambda z: z["c"].eqNullSafe(z["r"]))
    rows = rows.withColumn("n", F.array_position(same, False).cast("int"))
    rows = rows.withColumn("n_shared", F.when(F.col("n") > 0, F.col("n") - 1).otherwise(F.size("c")))
    rows = rows.select(
        id_column, "n_shared", F.slice("c", F.lit(1), F.col("n_shared")).alias("p"),
        _tail(F.col("c"), F.col("n_shared")).alias("c"), _tail(F.col("r"), F.col("n_shared")).alias("r"))
    return rows.select(
        id_column, "n_shared", _text(F.col("p")).alias("prompt"), _text(F.col("c")).alias("chosen"),
        _spans(F.col("c")).alias("chosen_spans"), _text(F.col("r")).alias("rejected"), _spans(F.col("r")).alias("rejected_spans"))


def pairs_of_conversations(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation with an assistant turn: chosen, the conversation itself; rejected, the same one cut off within a reply.

    The reply is that of number conv_id modulo the number of assistant turns; its text is cut to the first half of its characters. Turns are ordered
    by (turn, role, text); a null conv_id is left out.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"),
                                             F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    replies = F.filter(F.transform("t", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    turns = turns.withColumn("replies", replies).where(F.size("replies") > 0)
    turns = turns.withColumn("cut", F.element_at("replies", (F.pmod("conv_id", F.size("replies")) + 1).cast("int")))
    pick = F.struct(F.lit("assistant").alias("role"), F.expr("substring(t[cut].text, 1, length(t[cut].text) div 2)").alias("text"))
    plain = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.select(
        "conv_id", plain.alias("chosen"),
        F.concat(F.slice(plain, F.lit(1), F.col("cut")), F.array(pick)).alias("rejected"))


#: DuckDB: the same rows. Spans are given as text start-stop, comma-joined.
SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, list(i ORDER BY i) AS replies FROM t WHERE role = 'assistant' GROUP BY conv_id),
c AS (SELECT conv_id, replies[(conv_id % len(replies) + len(replies)) % len(replies) + 1] AS cut FROM k),
d AS (SELECT t.*, cut, cut + (text = substring(text, 1, length(text) // 2) AND i = cut)::INT AS keep FROM t JOIN c USING (conv_id)),
s AS (SELECT conv_id, max(keep) FILTER (i = cut) AS n_shared, max(cut) AS cut FROM d GROUP BY conv_id),
e AS (
  SELECT d.conv_id, i, s.cut, n_shared, role, text, '<|start|>' || role || chr(10) || text || '<|end|>' || chr(10) AS full_turn,
         '<|start|>assistant' || chr(10) || substring(text, 1, length(text) // 2) || '<|end|>' || chr(10) AS cut_turn
  FROM d JOIN s USING (conv_id)),
f AS (
  SELECT *, coalesce(sum(length(full_turn)) FILTER (i >= n_shared) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM e)
SELECT conv_id, CAST(max(n_shared) AS INT) AS n_shared,
  coalesce(string_agg(full_turn, '' ORDER BY i) FILTER (i < n_shared), '') AS prompt,
  coalesce(string_agg(full_turn, '' ORDER BY i) FILTER (i >= n_shared), '') AS chosen,
  coalesce(string_agg((base + 10 + length(role)) || '-' || (base + length(full_turn)), ',' ORDER BY i)
           FILTER (i >= n_shared AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(cut_turn, '') FILTER (i = cut AND i >= n_shared), '') AS rejected,
  coalesce(string_agg('19-' || length(cut_turn), ',') FILTER (i = cut AND i >= n_shared), '') AS rejected_spans
FROM f GROUP BY conv_id
"""
