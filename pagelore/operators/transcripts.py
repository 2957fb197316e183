"""Agent transcripts and traces: pruning, billing, totals, last entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions.text import estimated_tokens

SUPERSEDED = "[superseded page state; see the deltas that follow]"
STATE_HEAD = "<page_state>\nPAGE:"
OVERHEAD = 4


def holds_state(role: Column, content: Column) -> Column:
    return (role == "tool") & F.coalesce(F.startswith(content, F.lit(STATE_HEAD)), F.lit(False))


def prune_superseded(messages: DataFrame, state: Column | None = None) -> DataFrame:
    """Messages (session_id, seq, role, content); of a session's page states only the newest stays verbatim."""
    state = holds_state(F.col("role"), F.col("content")) if state is None else state
    newest = F.max(F.when(state, F.col("seq"))).over(Window.partitionBy("session_id"))
    old = state & (F.col("seq") < newest)
    return messages.withColumn("superseded", F.coalesce(old, F.lit(False))).withColumn("content", F.when(F.col("superseded"), F.lit(SUPERSEDED)).otherwise(F.col("content")))


def bill(messages: DataFrame, pruned: bool, state: Column | None = None) -> DataFrame:
    """Per session turns, cumulative and peak prompt tokens, and prunes applied, in one pass over the messages.

    Every message costs its content, its tool_calls (text, if there is such a column) and an overhead. A turn ends with
    each message that isn't the assistant's; its prompt is all messages so far, sent again. When pruned, a page state
    costs its full length only while it is the newest one.
    """
    state = holds_state(F.col("role"), F.col("content")) if state is None else state
    upto = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    calls = estimated_tokens(F.col("tool_calls")) if "tool_calls" in messages.columns else F.lit(0)
    full = OVERHEAD + estimated_tokens(F.col("content")) + calls
    least = OVERHEAD + F.lit(len(SUPERSEDED) // 4)
    rows = messages.withColumns({"_state": state, "_full": full.cast("long")})
    rows = rows.withColumns({"_low": F.when(F.col("_state"), least).otherwise(F.col("_full")).cast("long"), "_turn": F.col("role") != "assistant"})
    if pruned:
        newest = F.last(F.when(F.col("_state"), F.col("_full") - least), ignorenulls=True).over(upto)
        prompt = F.sum("_low").over(upto) + F.coalesce(newest, F.lit(0))
    else:
        prompt = F.sum("_full").over(upto)
    rows = rows.withColumn("_prompt", prompt)
    turns = F.col("_turn")
    prunes = F.greatest(F.count_if(F.col("_state")) - 1, F.lit(0)) if pruned else F.lit(0)
    return rows.groupBy("session_id").agg(
        F.count_if(turns).alias("turns"),
        F.coalesce(F.sum(F.when(turns, F.col("_prompt"))), F.lit(0)).cast("long").alias("cumulative"),
        F.coalesce(F.max(F.when(turns, F.col("_prompt"))), F.lit(0)).cast("long").alias("peak"),
        prunes.cast("long").alias("prunes"),
    )


def trace_totals(trace: DataFrame) -> DataFrame:
    """Per session n_entries, tokens, duration_ms, n_errors, and maps of counts by action and by error type."""
    counted = lambda c, name: trace.where(F.col(c).isNotNull()).groupBy("session_id", F.col(c).alias("k")).agg(F.count("*").alias("n")).groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)
    )
    sums = trace.groupBy("session_id").agg(F.count("*").alias("n_entries"), F.sum("tokens_consumed").alias("tokens"), F.sum("duration_ms").alias("duration_ms"), F.count("error_type").alias("n_errors"))
    return sums.join(counted("action", "actions"), "session_id", "left").join(counted("error_type", "errors"), "session_id", "left")


def last_entries(trace: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n entries of each session; totals come from the whole trace, see trace_totals."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("entry_id"))
    return trace.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n).drop("_place")
