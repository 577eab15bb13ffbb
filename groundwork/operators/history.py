"""Conversation histories: recent turns, titles, indexes, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _last(turns: DataFrame, key: str, order: str, n: int) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)


def recent_history(turns: DataFrame, key: str, order: str, n: int = 10, role_chars: int = 20, text_chars: int = 2000) -> DataFrame:
    """(key, history): the last n turns that have role and text, oldest first, cut to size. Each key collects n short rows at most."""
    rows = _last(turns.where(F.coalesce("role", F.lit("")) != "").where(F.coalesce("text", F.lit("")) != ""), key, order, n)
    cut = F.struct(F.col(order).alias("turn"), F.substring("role", 1, role_chars).alias("role"), F.substring("text", 1, text_chars).alias("text"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(cut)).alias("history"))


def history_text(turns: DataFrame, key: str, order: str, n: int = 3, chars: int = 4000) -> DataFrame:
    """(key, text): the last n question-and-answer turns as lines, the last ``chars`` characters of them."""
    reply = F.when(F.lead("role").over(Window.partitionBy(key).orderBy(order)) == "assistant", F.lead("text").over(Window.partitionBy(key).orderBy(order)))
    asked = turns.where(F.col("role").isin("user", "assistant")).withColumn("reply", reply).where("role = 'user'")
    line = F.concat(F.lit("User: "), F.coalesce("text", F.lit("")), F.lit("\nAssistant: "), F.coalesce("reply", F.lit("")))
    rows = _last(asked, key, order, n).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), line.alias("line")))).alias("a"))
    return rows.select(key, F.right(F.array_join(F.transform("a", lambda x: x["line"]), "\n"), F.lit(chars)).alias("text"))


def titles(turns: DataFrame, key: str, order: str, chars: int = 72, default: str = "New conversation") -> DataFrame:
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(order)))
    return turns.groupBy(key).agg(F.substring(F.coalesce(first, F.lit(default)), 1, chars).alias("title"))


def index(turns: DataFrame, key: str, order: str, deleted: DataFrame, n: int = 30) -> DataFrame:
    """The n keys with the latest turns that aren't deleted: message_count and latest text."""
    rows = turns.join(deleted.select(key).distinct(), key, "left_anti").groupBy(key)
    rows = rows.agg(F.count("*").alias("message_count"), F.max(order).alias("last_turn"), F.max_by("text", order).alias("last_text"))
    return rows.orderBy(F.desc("last_turn"), F.desc(key)).limit(n)


def question_turns(turns: DataFrame, key: str, role: str = "system", marks: str = "[?؟]") -> DataFrame:
    return turns.groupBy(key).agg(F.count_if((F.col("role") == role) & F.col("text").rlike(marks)).alias("n_questions"))
