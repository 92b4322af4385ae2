"""Evaluation of answers against expected keywords and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(answers: DataFrame) -> DataFrame:
    """``(question_id, keyword_hit, file_hit, matched)`` of ``question_id, answer, expected_keywords,
    expected_files, paths``: a keyword in the answer, whatever its case, or an expected file in the path of a
    reference. Nulls hit nothing."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    keyword = F.exists(F.coalesce("expected_keywords", F.array().cast("array<string>")), lambda k: F.contains(low, F.lower(k)))
    files = F.coalesce("expected_files", F.array().cast("array<string>"))
    file = F.exists(F.coalesce("paths", F.array().cast("array<string>")), lambda p: F.exists(files, lambda f: F.contains(p, f)))
    out = answers.select("question_id", F.coalesce(keyword, F.lit(False)).alias("keyword_hit"), F.coalesce(file, F.lit(False)).alias("file_hit"))
    return out.withColumn("matched", F.col("keyword_hit") | F.col("file_hit"))


def summary(results: DataFrame) -> DataFrame:
    """One row: questions, matched ones and their share in percent, 2 decimals."""
    share = F.round(F.coalesce(F.avg(F.col("matched").cast("double")), F.lit(0.0)) * 100, 2)
    return results.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("matched").cast("long")), F.lit(0)).alias("matched"), share.alias("rate"))


def report(results: DataFrame, title: str = "Evaluation") -> str:
    """A Markdown report of a question set's results (a small, stated set)."""
    total = summary(results).first()
    lines = [f"# {title}", "", f"Matched {total['matched']} of {total['total']} ({total['rate']:.2f}%).", "", "| question | keyword | file | matched |", "|---|---|---|---|"]
    yes = lambda x: "yes" if x else "no"
    lines += [f"| {r['question_id']} | {yes(r['keyword_hit'])} | {yes(r['file_hit'])} | {yes(r['matched'])} |" for r in results.orderBy("question_id").toLocalIterator()]
    return "\n".join(lines) + "\n"
