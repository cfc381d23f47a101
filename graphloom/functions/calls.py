"""What a call out of the repository does: database work, reflection, or what a catalog of known
methods says, as column expressions over small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import make_id

#: Types whose methods are database work.
DB_TYPES = """java.sql.Connection java.sql.Statement java.sql.PreparedStatement java.sql.CallableStatement java.sql.ResultSet
java.sql.DataSource javax.sql.DataSource javax.sql.PooledConnection java.sql.DriverManager javax.persistence.EntityManager
jakarta.persistence.EntityManager javax.persistence.EntityManagerFactory jakarta.persistence.EntityManagerFactory
javax.persistence.Query jakarta.persistence.Query javax.persistence.TypedQuery jakarta.persistence.TypedQuery
org.hibernate.Session org.hibernate.SessionFactory org.hibernate.Transaction org.springframework.jdbc.core.JdbcTemplate
org.springframework.jdbc.core.namedparam.NamedParameterJdbcTemplate org.springframework.transaction.support.TransactionTemplate
org.apache.ibatis.session.SqlSession org.apache.ibatis.session.SqlSessionFactory""".split()
#: Types that are a connection.
CONNECTION_TYPES = """java.sql.Connection javax.sql.PooledConnection org.hibernate.Session javax.persistence.EntityManager
jakarta.persistence.EntityManager org.apache.ibatis.session.SqlSession""".split()
#: Methods of database types, in lower case.
ACQUIRES = "getconnection createstatement preparestatement preparecall getsession opensession createentitymanager opensqlsession getcurrentsession".split()
EXECUTES = """executequery executeupdate execute executebatch executelargeupdate query queryforobject queryforlist update createquery
createnativequery getresultlist getsingleresult selectone selectlist insert delete persist merge remove save find""".split()
RELEASES = "close commit rollback setautocommit releasesavepoint".split()
#: Reflection, by whole type or by methods of a type.
REFLECT_TYPES = ["java.lang.reflect.Method", "java.lang.reflect.Constructor", "java.lang.reflect.Field"]
REFLECT_METHODS = {
    "java.lang.Class": """forname newinstance getmethod getmethods getdeclaredmethod getdeclaredmethods getconstructor getconstructors
getdeclaredconstructor getdeclaredconstructors getfield getfields getdeclaredfield getdeclaredfields""".split(),
    "java.lang.ClassLoader": ["loadclass"],
}
#: Kinds of sinks by the weakness they stand for; others are a taint_sink.
CATEGORY_KINDS = {
    "CWE-78/command-injection": "exec", "CWE-94/code-injection": "exec", "CWE-22/path-traversal": "file_write", "CWE-502/unsafe-deserialization": "deserialize",
    "CWE-79/xss": "response", "CWE-113/response-splitting": "response", "CWE-89/sql-injection": "db_execute", "CWE-943/nosql-injection": "db_execute",
}
ROLE_KINDS = {"source": "taint_source", "sanitizer": "taint_sanitizer"}
#: Categories left out unless asked for.
NOT_RECOMMENDED = ["CWE-134/format-string", "CWE-117/log-injection"]
#: Kinds of external calls that are dangerous.
DANGEROUS = "db_execute db_other exec file_write deserialize response reflection".split()
#: Owners whose methods say little; each also stands for what starts with it.
NOISE = """java.lang.String java.lang.Integer java.lang.Long java.lang.Double java.lang.Float java.lang.Short java.lang.Byte java.lang.Boolean
java.lang.Character java.lang.Number java.lang.Math java.lang.Object java.lang.Enum java.lang.Comparable java.lang.Iterable
java.lang.CharSequence java.util.Vector java.util.Hashtable java.util.ArrayList java.util.HashMap java.util.LinkedList
java.util.LinkedHashMap java.util.HashSet java.util.TreeMap java.util.TreeSet java.util.Iterator java.util.Enumeration
java.util.Collection java.util.List java.util.Map java.util.Set java.util.Arrays java.util.Collections java.util.Objects
java.util.Optional java.util.StringTokenizer java.util.stream java.math.BigDecimal java.math.BigInteger""".split()


def tail(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _is_one_of(name: Column, types: list[str]) -> Column:
    """By full name or by simple name."""
    simple = sorted({t.rsplit(".", 1)[-1] for t in types})
    return F.coalesce(name.isin(types) | tail(name).isin(simple), F.lit(False))


def is_connection(return_type: Column) -> Column:
    return _is_one_of(return_type, CONNECTION_TYPES)


def category_kind(category: Column) -> Column:
    """The kind of a sink; categories are known with and without their number."""
    out = F.lit("taint_sink")
    for k, kind in CATEGORY_KINDS.items():
        out = F.when(category.isin(k, k.split("/", 1)[1]), kind).otherwise(out)
    return out


def role_kind(role: Column, category: Column) -> Column:
    """The kind of a catalogued call; null for roles that are none."""
    out = F.when(role == "sink", category_kind(category))
    for k, kind in ROLE_KINDS.items():
        out = out.when(role == k, kind)
    return out


def node_kind(role: Column, category: Column) -> Column:
    """The kind of an external node by its role, database roles included."""
    return F.when(role == "acquire", "db_acquire").when(role == "release", "db_release").when(role == "other", "other").otherwise(role_kind(role, category))


def classify(owner: Column, method: Column, return_type: Column, catalogued: Column) -> Column:
    """The kind of a call, first rule that holds: a connection comes back; reflection; a method of a
    database type; the catalog; none (null). ``catalogued`` is the catalog's kind or null. Owners and
    types may be full or simple names; reflection asks for the full name."""
    m = F.lower(F.coalesce(method, F.lit("")))
    reflects = owner.isin(REFLECT_TYPES)
    for t, ms in REFLECT_METHODS.items():
        reflects = reflects | ((owner == t) & m.isin(ms))
    db = _is_one_of(owner, DB_TYPES)
    return (
        F.when(is_connection(return_type), "db_acquire")
        .when(F.coalesce(reflects, F.lit(False)), "reflection")
        .when(db & m.isin(ACQUIRES), "db_acquire")
        .when(db & m.isin(RELEASES), "db_release")
        .when(db & m.isin(EXECUTES), "db_execute")
        .when(db, F.coalesce(catalogued, F.lit("db_other")))
        .otherwise(catalogued)
    )


def external_key(owner: Column, method: Column) -> Column:
    return F.concat(owner, F.lit("#"), method)


def external_id(owner: Column, method: Column) -> Column:
    """External targets are shared between repositories, and overloads are one."""
    return make_id(F.lit("external"), F.lit("external"), external_key(owner, method))


def external_display(owner: Column, method: Column) -> Column:
    return F.concat(tail(owner), F.lit("."), method)


def is_noise(owner: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in NOISE]), lambda p: F.startswith(owner, p))


def lookup(calls: DataFrame, entries: DataFrame, values: list[str]) -> DataFrame:
    """``calls`` (owner, method, ...) with ``values`` of the catalog's ``entries`` (entry, owner,
    method in lower case): by the exact owner, else by a simple name that only one entry has. An
    owner that is catalogued without the method has no simple-name hit.

    The catalog grows with known libraries, not with data; it is sent to all tasks only if Spark
    finds it small.
    """
    known = entries.select(F.col("owner").alias("__o")).distinct().withColumn("__known", F.lit(True))
    one = entries.groupBy(tail(F.col("owner")).alias("__simple")).agg(F.count_distinct("entry").alias("n"), F.min("owner").alias("__owner")).filter("n = 1").drop("n")
    c = calls.join(known, calls["owner"] == known["__o"], "left").drop("__o")
    c = c.withColumn("__simple", F.when(F.col("__known").isNull(), tail(F.col("owner")))).join(one, "__simple", "left")
    c = c.withColumn("__at", F.when(F.col("__known"), F.col("owner")).otherwise(F.col("__owner"))).withColumn("__m", F.lower("method"))
    e = entries.select(F.col("owner").alias("__at"), F.col("method").alias("__m"), *values)
    return c.join(e, ["__at", "__m"], "left").drop("__at", "__m", "__simple", "__known", "__owner")
