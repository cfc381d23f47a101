"""Function bodies out of source files, and what their text says, judged without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_lines(source: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (from 1, both inclusive); beyond the text there is nothing."""
    lines = F.split(source, "\n")
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def bodies(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, body) of every Function with a place in a file. A node written twice counts as written
    last, a file scanned twice as scanned first. The functions of one file meet its text once."""
    n = nodes.filter("label = 'Function' and id is not null").groupBy("id").agg(F.max_by(F.struct("repo", "file", "start_line", "end_line"), F.struct("last_indexed", "end_line")).alias("n")).select("id", "n.*").dropna()
    per = n.groupBy("repo", "file").agg(F.collect_list(F.struct("id", "start_line", "end_line")).alias("fns"))
    f = files.filter("source is not null and repo is not null and relpath is not null").groupBy("repo", F.col("relpath").alias("file")).agg(F.min_by("source", "file_id").alias("source"))
    j = per.join(f, ["repo", "file"]).select("source", F.explode("fns").alias("f"))
    return j.select("f.id", slice_lines(F.col("source"), F.col("f.start_line"), F.col("f.end_line")).alias("body"))


#: What the judge looks for; the same text is used in SQL.
NULLS = r"\breturn\s+(?:null|None|undefined)\b"
SENTINEL = r"\breturn\s+(-1)\b"
CALLS = r"(\w+)\s*\("
GUARDED = r"\b(?:if|while)\b[^\n]*?(\w+)\s*\("
SWALLOWED = r"try\s*\{[^{}]*?(\w+)\s*\([^{}]*\}\s*catch\s*\([^)]*\)\s*\{[^{};]*\}"
ACQUIRES = r"\b(?:getConnection|openSession|prepareStatement|connect|acquire)\s*\("
FINALLY = r"\bfinally\b[\s\S]*\.(?:close|release)\s*\(|\btry\s*\(|\bwith\s+\w"
DYNAMIC = r"(?i)\b(?:select|insert|update|delete)\b[^\n;]*[\"'`]\s*\+|\$\{"
EXEC = r"\b(?:exec|spawn|system|eval)\s*\("


def judge(b: DataFrame) -> DataFrame:
    """A deterministic summary of every body (id, body), in the shape of ``derive_signals``."""
    body = F.col("body")
    calls = F.regexp_extract_all(body, F.lit(CALLS), 1)
    guarded = F.regexp_extract_all(body, F.lit(GUARDED), 1)
    sentinel = F.regexp_extract(body, SENTINEL, 1)
    false, zero = F.lit(False), F.lit(0)
    return b.select(
        "id", F.rlike(body, F.lit(DYNAMIC)).alias("sql_is_dynamic"), F.rlike(body, F.lit(ACQUIRES)).alias("acquires"), F.rlike(body, F.lit(FINALLY)).alias("released_in_finally"), F.rlike(body, F.lit(r"\bthrow\b")).alias("throws_between"), zero.alias("n_leaked"),
        F.rlike(body, F.lit(r"\b(?:getParameter|input|request)\b")).alias("reads_untrusted"), false.alias("is_entry_point"), false.alias("authenticates"), F.rlike(body, F.lit(r"(?i)\bauthori[sz]e\w*\s*\(")).alias("authorizes"), F.rlike(body, F.lit(r"(?i)\b(?:escape|sanitize)\w*\s*\(")).alias("is_sanitizer"),
        F.rlike(body, F.lit(NULLS)).alias("may_return_null"), sentinel.alias("returns_sentinel"), F.when(F.rlike(body, F.lit(EXEC)), F.array(F.lit("exec"))).otherwise(F.array().cast("array<string>")).alias("touches"),
        F.array_except(calls, guarded).alias("unguarded_calls"), F.array_distinct(F.regexp_extract_all(body, F.lit(SWALLOWED), 1)).alias("swallowed_calls"), zero.alias("strong"),
    )
