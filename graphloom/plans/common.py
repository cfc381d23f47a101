"""What the query modules share: tables, registration next to the SQL, and small typed inline tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Queries of a module and the SQL that gives the same result."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def functions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").filter((F.col("label") == "Function") & F.col("id").isNotNull())
    return n.select("id", "name", "fqn", "repo", "file", "lang", "package", "param_count", "return_type", "start_line", "body_hash").distinct()


def edges(spark: SparkSession, d: str, *types: str) -> DataFrame:
    return table(spark, d, "edges").filter(F.col("type").isin(*types) & F.col("dst").isNotNull())


def _literal(v, kind: str) -> str:
    if v is None:
        return f"cast(null as {kind})"
    if isinstance(v, list):
        return "[" + ", ".join(_literal(x, kind.removesuffix("[]")) for x in v) + f"]::{kind}"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


_KINDS = {"string": "varchar", "int": "integer", "long": "bigint", "double": "double", "boolean": "boolean"}


class Inline:
    """A small typed table of cases, as a DataFrame and as a common table expression."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        cols = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
        kinds = [_KINDS[k[6:-1]] + "[]" if k.startswith("array<") else _KINDS[k] for _, k in cols]
        lines = ", ".join("(" + ", ".join(_literal(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
        self.cte = f"{name}({', '.join(c for c, _ in cols)}) as (values {lines})"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)
