"""Queries of the operators on texts and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import docs, leaks, origin, packing, secrets, splitting, syntax
from graphloom.session import spread

HOUSE = "harborlight"


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return t.select(*columns) if columns else t


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(_table(spark, d, "file_info", *columns), spark)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "documents", "doc_id", "text"), spark)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.classify(_table(spark, d, "file_info", "file_id", "repo", "relpath", "lang", "source"), HOUSE).select("file_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not hand-written, with the reasons, and whether a family or the file itself gave them."""
    b = origin.classify(_table(spark, d, "file_info", "file_id", "repo", "relpath", "lang", "source"), HOUSE)
    b = b.select("file_id", F.col("bits").alias("own"), "family_bits", F.col("bits").bitwiseOR(F.col("family_bits")).alias("bits"))
    has = lambda bit: F.col("bits").bitwiseAND(bit) != 0
    return b.select(
        "file_id", has(origin.GENERATED).alias("generated"), has(origin.VENDORED).alias("vendored"), has(origin.DATA).alias("data"), has(origin.MINIFIED).alias("minified"),
        (F.col("family_bits") != 0).alias("by_family"), (F.col("own") != 0).alias("by_itself"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return docs.documented(_table(spark, d, "nodes"), _files(spark, d, "repo", "relpath", "lang", "source")).select("id")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description pairs taken from the source files themselves."""
    return docs.extract(_files(spark, d, "file_id", "lang", "source"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(_files(spark, d, "file_id", "lang", "source"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their secrets masked in place."""
    return secrets.redacted(_files(spark, d, "file_id", "lang", "source"))


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per language, files with secrets, and how many of them parsed before and parse after redaction."""
    f = _files(spark, d, "file_id", "lang", "source")
    r = secrets.redacted(f.filter("lang is not null"), keep=True).filter("n_secrets > 0")
    both = r.select(F.struct("file_id", F.lit("before").alias("at")).alias("file"), "lang", F.col("original").alias("source")).unionByName(r.select(F.struct("file_id", F.lit("after").alias("at")).alias("file"), "lang", "source"))
    v = syntax.flag(both, key="file")
    n = lambda at: F.count_if((F.col("file.at") == at) & F.col("ok"))
    return v.groupBy("lang").agg(F.count_if(F.col("file.at") == "after").alias("n_files"), n("before").alias("n_parsed_before"), n("after").alias("n_parsed_after"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.flag(_files(spark, d, "file_id", "lang", "source")).filter("not ok").select("file_id")


def p6_places(spark: SparkSession, d: str) -> DataFrame:
    """Of every invalid file the line and the text of the token at which it fails; of a text that
    ends too early its last line."""
    return syntax.flag(_files(spark, d, "file_id", "lang", "source")).filter("not ok").select("file_id", "lang", "kind", "line_no", "token")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files, broken files and truncated files per repository and language."""
    f = _files(spark, d, "file_id", "repo", "lang", "source")
    keyed = f.select(F.struct("file_id", "repo").alias("file"), "lang", "source")
    v = syntax.flag(keyed, key="file")
    return v.groupBy(F.col("file.repo").alias("repo"), "lang").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("ok")).alias("n_broken"), F.count_if(F.col("kind") == "end").alias("n_truncated"),
        F.round(F.count_if(~F.col("ok")) / F.count(F.lit(1)), 4).alias("rate"),
    )


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers."""
    return packing.pack(_documents(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find(_documents(spark, d), _table(spark, d, "eval_items", "item_id", "text"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out item, in how many documents it turns up."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every document in pieces under the limit."""
    return splitting.split(_documents(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_pairs, p4_found, p4_redacted, p4_kept, p6_found, p6_places, p6_rates, p8_packed, p9_found, p9_items, p10_pieces)}

SQL: dict[str, str] = {}
