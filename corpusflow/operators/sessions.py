"""Conversations as tables: exchanges, their context, statistics and lists of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusflow.functions.text import clip

CONTEXT_EXCHANGES = 3
ANSWER_CHARS = 200
RECENT_HOURS = 24


def exchanges(turns: DataFrame) -> DataFrame:
    """session_id, seq from 1, question, answer: each user turn with the assistant's turn that follows it, if any."""
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"_role": F.lead("role").over(order), "_text": F.lead("text").over(order)}).where("role = 'user'")
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return rows.select(F.col("conv_id").alias("session_id"), number.alias("seq"), F.col("text").alias("question"), F.when(F.col("_role") == "assistant", F.col("_text")).alias("answer"))


def last_exchanges(history: DataFrame, n: int) -> DataFrame:
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))
    return history.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def chat_context(history: DataFrame, n: int = CONTEXT_EXCHANGES) -> DataFrame:
    """session_id, context: the last ``n`` exchanges in order, long answers cut."""
    part = F.concat(F.lit("Previous Q: "), F.coalesce("question", F.lit("")), F.lit("\nPrevious A: "), clip(F.coalesce(F.col("answer"), F.lit("")), ANSWER_CHARS))
    rows = last_exchanges(history, n).select("session_id", "seq", part.alias("part"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "\n").alias("context"))


def session_stats(history: DataFrame) -> DataFrame:
    """session_id, exchanges, total characters, mean lengths of questions and answers."""
    q, a = F.length(F.coalesce("question", F.lit(""))), F.length(F.coalesce("answer", F.lit("")))
    return history.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("exchanges"), F.sum(q + a).alias("total_chars"), F.round(F.avg(q), 6).alias("mean_question"), F.round(F.avg(a), 6).alias("mean_answer")
    )


def session_list(events: DataFrame, n: int) -> DataFrame:
    """session_id, exchanges, last_updated of the ``n`` sessions that changed last: events(session_id, ts)."""
    sums = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("exchanges"), F.max("ts").alias("last_updated"))
    return sums.orderBy(F.desc("last_updated"), "session_id").limit(n)


def resumable(events: DataFrame, now: str, hours: int = RECENT_HOURS) -> DataFrame:
    """The session that changed last, if that is less than ``hours`` before ``now``."""
    recent = events.where((F.col("ts") <= F.lit(now).cast("timestamp")) & (F.col("ts") > F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")))
    return session_list(recent, 1).select("session_id", "last_updated")
