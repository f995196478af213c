"""Expressions over probability maps stored as JSON text (JSN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probability_map(column) -> Column:
    return F.from_json(column, "map<string,double>")


def top_options(probs: Column, n: int = 2, skip: str = "none") -> Column:
    """Keys of the n largest probabilities without ``skip``, ties by key (JSN-1)."""
    pairs = F.transform(
        F.filter(F.map_entries(probs), lambda e: e["key"] != skip),
        lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("key")),
    )
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda e: e["key"])


def expected_score(probs: Column) -> Column:
    """Sum of level times probability over keys that are levels (JSN-2)."""
    return F.aggregate(
        F.map_entries(probs), F.lit(0.0),
        lambda acc, e: acc + F.coalesce(e["key"].try_cast("double"), F.lit(0.0)) * F.coalesce(e["value"], F.lit(0.0)),
    )


def key_lengths(rows: DataFrame, column: str) -> DataFrame:
    """Every JSON key with its count and longest value (JSN-3)."""
    parsed = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
    return parsed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("longest"))


def answer_problems(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """First shape problem per answer, null when valid (JSN-4).

    ``questions`` is (question_id, qtype, options); it is configuration-sized.
    """
    spec = questions.select("question_id", F.col("qtype").alias("__qtype"), F.col("options").alias("__options"))
    rows = answers.join(spec, "question_id", "left")
    keys = F.map_keys(probability_map("probabilities_json"))
    gaps = F.size(F.array_except("__options", F.coalesce(keys, F.array().cast("array<string>"))))
    problem = (
        F.when(F.col("__qtype").isNull(), "unknown_question")
        .when(F.col("qtype") != F.col("__qtype"), "type_mismatch")
        .when((F.col("qtype") == "choice") & ~F.coalesce(F.array_contains("__options", F.col("choice")), F.lit(False)), "choice_not_an_option")
        .when((F.col("qtype") == "choice") & (gaps > 0), "probabilities_incomplete")
    )
    return rows.withColumn("problem", problem).drop("__qtype", "__options")


def missing_questions(items: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(item, question) pairs without an answer (JSN-4), for every question of the table."""
    names = [F.lit(r[0]) for r in questions.select("question_id").distinct().collect()]  # a question set is configuration
    wanted = items.select("comment_id", F.explode(F.array(*names)).alias("question_id"))
    return wanted.join(answers.select("comment_id", "question_id"), ["comment_id", "question_id"], "left_anti")
