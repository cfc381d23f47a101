"""Summaries, signals, contract joins and the catalog, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import calls as C
from graphloom.operators import bodies as B
from graphloom.operators import catalog as K
from graphloom.operators import findings as V
from graphloom.operators import graph as G
from graphloom.plans.common import Inline, Registry, edges, functions, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

LIMIT = 5_000


def _rx(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_BODY = f"""n as (select id, max_by(struct_pack(repo := repo, file := file, a := start_line, b := end_line), struct_pack(t := last_indexed, e := end_line)) as n from nodes where label = 'Function' and id is not null group by id),
f as (select repo, relpath, min_by(source, file_id) as source from file_info where source is not null and repo is not null and relpath is not null group by repo, relpath),
body as (select id, array_to_string(list_slice(string_split(source, chr(10)), n.a, n.b), chr(10)) as body from n join f on f.repo = n.repo and f.relpath = n.file where n.a is not null and n.b is not null),
sig as (select id, regexp_matches(body, {_rx(B.NULLS)}) as may_null, regexp_extract(body, {_rx(B.SENTINEL)}, 1) as sentinel, regexp_matches(body, {_rx(B.ACQUIRES)}) as acquires, regexp_matches(body, {_rx(B.FINALLY)}) as releases,
 list_filter(list_distinct(regexp_extract_all(body, {_rx(B.CALLS)}, 1)), lambda x: not list_contains(regexp_extract_all(body, {_rx(B.GUARDED)}, 1), x)) as unguarded, list_distinct(regexp_extract_all(body, {_rx(B.SWALLOWED)}, 1)) as swallowed,
 regexp_matches(body, {_rx(B.DYNAMIC)}) as dynamic, regexp_matches(body, '\\bthrow\\b') as throws, regexp_matches(body, '\\b(?:getParameter|input|request)\\b') as untrusted, regexp_matches(body, '(?i)\\bauthori[sz]e\\w*\\s*\\(') as auth,
 regexp_matches(body, '(?i)\\b(?:escape|sanitize)\\w*\\s*\\(') as sanitizer, regexp_matches(body, {_rx(B.EXEC)}) as exec from body)"""


def _signals(spark, d) -> DataFrame:
    return V.derive_signals(B.judge(B.bodies(table(spark, d, "nodes"), table(spark, d, "file_info"))))


@query(f"with {_BODY} select id, sha1(body) as hash, length(body) as n_chars from body")
def function_bodies(spark, d):
    """The text of every function, by file and lines."""
    b = B.bodies(table(spark, d, "nodes"), table(spark, d, "file_info"))
    return b.select("id", F.sha1("body").alias("hash"), F.length("body").cast("long").alias("n_chars"))


_SCORE = """(case when dynamic then 5.0 else 0 end + case when acquires then 2.0 else 0 end + case when exec then 3.0 else 0 end + case when untrusted then 3.5 else 0 end + case when auth then 1.0 else 0 end
 + case when acquires and not releases then 2.0 else 0 end + case when acquires and not releases and throws then 1.0 else 0 end) * case when sanitizer then 0.5 else 1 end"""


@query(f"with {_BODY} select id, round({_SCORE}, 2)::double as score, {_SCORE} >= 3 as important, acquires and not releases as leak, may_null, len(unguarded) as n_unguarded from sig")
def signals(spark, d):
    """What the body of each function says, scored."""
    s = _signals(spark, d)
    return s.select("id", F.col("sig_risk_score").alias("score"), F.col("sig_important").alias("important"), F.col("sig_leak").alias("leak"), F.col("sig_may_return_null").alias("may_null"), F.size("sig_unguarded_calls").cast("long").alias("n_unguarded"))


_RATE = "round(avg({0}::int), 4)::double as {0}"


@query(f"with {_BODY}, r as (select {_SCORE} >= 3 as important, acquires and not releases as leak, untrusted, dynamic, sanitizer, auth, may_null from sig) select count(*) as n, {', '.join(_RATE.format(c) for c in ('important', 'leak', 'untrusted', 'dynamic', 'sanitizer', 'auth', 'may_null'))}, avg(important::int) > 0.3 as flags_too_much from r")
def signal_rates(spark, d):
    """How often each signal is set; one that is set nearly always or never selects nothing."""
    s = _signals(spark, d)
    names = {"important": "sig_important", "leak": "sig_leak", "untrusted": "sig_untrusted", "dynamic": "sig_sql_dynamic", "sanitizer": "sig_sanitizer", "auth": "sig_auth", "may_null": "sig_may_return_null"}
    return s.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(c).cast("int")), 4).alias(k) for k, c in names.items()], (F.avg(F.col("sig_important").cast("int")) > 0.3).alias("flags_too_much"))


_JOIN = f"""{_BODY}, fn as (select id, min(name) as name, min(file) as file, min(start_line) as start_line from nodes where label = 'Function' and id is not null group by id), s as (select * from fn join sig using (id)),
c as (select distinct src, dst, strategy, evidence_line as line from edges where type = 'CALLS' and dst is not null and (strategy = 'bytecode' or starts_with(strategy, 'receiver_type') or starts_with(strategy, 'same_'))),
j as (select c.*, a.file, coalesce(c.line, a.start_line) as ln, a.unguarded, a.swallowed, a.releases as ra, b.name, b.may_null, b.sentinel, b.acquires, b.releases as rb from c join s a on a.id = c.src join s b on b.id = c.dst),
m as (select 'null_dereference' as kind, * from j where may_null and list_contains(unguarded, name) union all select 'correctness', * from j where sentinel <> '' and list_contains(unguarded, name)
 union all select 'error_handling', * from j where list_contains(swallowed, name) union all select 'resource_leak', * from j where acquires and not ra and not rb)"""


def _mismatches(spark, d) -> DataFrame:
    fn = functions(spark, d).groupBy("id").agg(F.min("name").alias("name"), F.min("file").alias("file"), F.min("start_line").alias("start_line"))
    calls = edges(spark, d, "CALLS").select("src", "dst", "strategy", F.col("evidence_line").alias("line")).distinct()
    return V.mismatches(calls, fn.join(_signals(spark, d), "id"))


@query(f"with {_JOIN} select kind, src as caller_id, dst as callee_id, file, ln as line, strategy from m order by kind, file, line, caller_id, callee_id, strategy limit {LIMIT}")
def contract_mismatches(spark, d):
    """Calls whose two ends don't agree, by place; the first five thousand."""
    return _mismatches(spark, d).orderBy("kind", "file", "line", "caller_id", "callee_id", "strategy").limit(LIMIT)


@query(f"with {_JOIN} select kind, count(*) as n, count(distinct src) as n_callers from m group by kind")
def mismatch_counts(spark, d):
    return _mismatches(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("caller_id").alias("n_callers"))


@query(f"with {_BODY}, fn as (select distinct id from nodes where label = 'Function' and id is not null) select count(*) as total, count(sig.id) as with_contracts, round(count(sig.id)::double / count(*), 4) as fraction from fn left join sig on sig.id = fn.id")
def contract_coverage(spark, d):
    """Functions with contracts at all: no mismatches may only mean that nothing was looked at."""
    s = _signals(spark, d).select("id", F.lit(1).alias("has"))
    j = functions(spark, d).select("id").distinct().join(s, "id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("has").alias("with_contracts"), F.round(F.count("has") / F.count(F.lit(1)), 4).alias("fraction"))


@query("""with fn as (select distinct id, name from nodes where label = 'Function' and id is not null), k as (select id, min(name) as name from fn group by id),
out as (select e.src as id, string_agg(distinct k.name, ',' order by k.name) as callees from edges e join k on k.id = e.dst where e.type = 'CALLS' and (strategy = 'bytecode' or starts_with(strategy, 'receiver_type') or starts_with(strategy, 'same_')) group by e.src),
inn as (select dst as id, count(distinct src) as n_callers from edges where type = 'CALLS' and (strategy = 'bytecode' or starts_with(strategy, 'receiver_type') or starts_with(strategy, 'same_')) group by dst),
ext as (select src as id, string_agg(distinct method, ',' order by method) as external from edges e join catalog c on c.node_id = e.dst where e.type = 'CALLS_EXTERNAL' group by src),
fld as (select src as id, count(distinct dst) as n_fields from edges where type in ('READS', 'WRITES') group by src)
select k.id, coalesce(callees, '') as callees, coalesce(n_callers, 0) as n_callers, coalesce(external, '') as external, coalesce(n_fields, 0) as n_fields from k left join out on out.id = k.id left join inn on inn.id = k.id left join ext on ext.id = k.id left join fld on fld.id = k.id""")
def graph_facts(spark, d):
    """What the graph knows about each function: each kind of fact is gathered by itself before it
    meets the function, so that facts don't multiply."""
    fn = functions(spark, d).groupBy("id").agg(F.min("name").alias("name"))
    calls = edges(spark, d, "CALLS").filter(G.trusted(F.col("strategy"))).select("src", "dst").distinct()
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = calls.join(fn.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(listed("name").alias("callees"))
    inn = calls.groupBy(F.col("dst").alias("id")).agg(F.count("src").alias("n_callers"))
    x = table(spark, d, "catalog").select(F.col("node_id").alias("dst"), "method")
    ext = edges(spark, d, "CALLS_EXTERNAL").select("src", "dst").distinct().join(x, "dst").groupBy(F.col("src").alias("id")).agg(listed("method").alias("external"))
    fld = edges(spark, d, "READS", "WRITES").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n_fields"))
    j = fn.select("id").join(out, "id", "left").join(inn, "id", "left").join(ext, "id", "left").join(fld, "id", "left")
    return j.select("id", F.coalesce("callees", F.lit("")).alias("callees"), F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("external", F.lit("")).alias("external"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


# calls out of the repository

_CALLS = Inline("calls", "n int, owner string, method string, return_type string", [
    (1, "com.acme.DbManager", "open", "java.sql.Connection"), (2, "DbManager", "open", "Connection"), (3, "java.lang.Class", "forName", ""), (4, "java.lang.reflect.Method", "invoke", ""), (5, "Method", "invoke", ""), (6, "Statement", "executeQuery", ""),
    (7, "java.sql.Connection", "close", ""), (8, "java.sql.Connection", "prepareStatement", ""), (9, "java.sql.ResultSet", "getString", ""), (10, "java.sql.ResultSet", "getMetaData", ""), (11, "java.io.InputStream", "close", ""), (12, "java.lang.Runtime", "exec", ""),
    (13, "Runtime", "EXEC", ""), (14, "org.log.Log", "info", ""), (15, "jakarta.servlet.http.HttpServletRequest", "getParameter", ""), (16, None, "exec", None), (17, "java.lang.Runtime", None, ""), (18, "Shared", "go", ""), (19, "java.sql.PreparedStatement", "setString", ""),
])
_MINED = Inline("mined", "owner string, role string, category string, method string, positions array<int>", [
    ("java.lang.Runtime", "sink", "CWE-78/command-injection", "exec", [0]), ("javax.servlet.http.HttpServletRequest", "source", "CWE-20/untrusted-input", "getparameter", []), ("java.sql.ResultSet", "source", "CWE-20/untrusted-input", "getstring", []), ("org.log.Log", "sink", "CWE-117/log-injection", "info", [0]),
    ("a.Shared", "sink", "CWE-79/xss", "go", [0]), ("b.Shared", "sink", "CWE-78/command-injection", "go", [0]), ("java.sql.PreparedStatement", "sink", "CWE-89/sql-injection", "setstring", [1]), ("java.lang.Runtime", "source", "CWE-20/untrusted-input", "load", []),
])
_CURATED = Inline("curated", "owner string, role string, category string, method string, positions array<int>", [
    ("java.sql.PreparedStatement", "sanitizer", "CWE-89/sql-injection", "setString", [1]), ("java.lang.Runtime", "sanitizer", "CWE-78/command-injection", "exec", [0]), ("org.owasp.Encoder", "sanitizer", "CWE-79/xss", "forHtml", [0]),
])
_MERGED = f"""{_MINED.cte}, {_CURATED.cte}, u as (select *, case when role = 'sink' then 1 else 2 end as rank from mined union all select *, case when owner in ('java.sql.PreparedStatement') then 0 else 3 end from curated),
own as (select owner as entry, owner, role, category, lower(method) as method, positions from u where rank = (select min(rank) from u v where v.owner = u.owner)),
entries as (select * from own union all select entry, 'jakarta.' || substr(owner, 7), role, category, method, positions from own where starts_with(owner, 'javax.') and 'jakarta.' || substr(owner, 7) not in (select owner from own))"""
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_SIMPLE = lambda xs: sorted({x.rsplit('.', 1)[-1] for x in xs})
_TAIL = "list_extract(string_split({}, '.'), -1)"
_CATALOG_KIND = f"case when role = 'sink' then case {' '.join(f'when category = {k!r} then {v!r}' for k, v in C.CATEGORY_KINDS.items())} else 'taint_sink' end when role = 'source' then 'taint_source' when role = 'sanitizer' then 'taint_sanitizer' end"
_CLASSIFIED = f"""{_MERGED}, {_CALLS.cte}, one as (select {_TAIL.format('owner')} as simple, min(owner) as owner from entries group by 1 having count(distinct entry) = 1),
placed as (select c.*, case when c.owner in (select owner from entries) then c.owner else one.owner end as place from calls c left join one on one.simple = {_TAIL.format('c.owner')}),
hit as (select placed.n, placed.owner, placed.method, placed.return_type, case when e.category in ({_IN(C.NOT_RECOMMENDED)}) then null else {_CATALOG_KIND} end as known from placed left join entries e on e.owner = placed.place and e.method = lower(placed.method)),
kinds as (select n, owner, method, case when return_type in ({_IN(C.CONNECTION_TYPES)}) or {_TAIL.format('return_type')} in ({_IN(_SIMPLE(C.CONNECTION_TYPES))}) then 'db_acquire'
 when owner in ({_IN(C.REFLECT_TYPES)}) {' '.join(f"or (owner = '{t}' and lower(method) in ({_IN(m)}))" for t, m in C.REFLECT_METHODS.items())} then 'reflection'
 when owner in ({_IN(C.DB_TYPES)}) or {_TAIL.format('owner')} in ({_IN(_SIMPLE(C.DB_TYPES))}) then case when lower(method) in ({_IN(C.ACQUIRES)}) then 'db_acquire' when lower(method) in ({_IN(C.RELEASES)}) then 'db_release' when lower(method) in ({_IN(C.EXECUTES)}) then 'db_execute' else coalesce(known, 'db_other') end
 else known end as kind from hit)"""


def _entries(spark) -> DataFrame:
    return K.merge(_MINED.frame(spark), _CURATED.frame(spark))


@query(f"with {_CLASSIFIED} select n, kind from kinds")
def classify_cases(spark, d):
    """The rules' order on cases that more than one of them fits."""
    return K.classify_calls(_CALLS.frame(spark), _entries(spark)).select("n", "kind")


@query(f"with {_MERGED} select owner, role, method, array_to_string(positions, ',') as positions from entries")
def catalog_merge(spark, d):
    return _entries(spark).select("owner", "role", "method", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("""with x as (select distinct owner, method from catalog where label = 'External' and owner is not null and method is not null),
k as (select distinct e.src, e.dst from edges e where type = 'CALLS_EXTERNAL')
select x.owner, x.method, substr(sha1('external' || chr(0) || 'external' || chr(0) || x.owner || '#' || x.method), 1, 16) as id, list_extract(string_split(x.owner, '.'), -1) || '.' || x.method as name from x""")
def external_ids(spark, d):
    """Identity and name of every external method; the same in all repositories."""
    x = table(spark, d, "catalog").filter("label = 'External' and owner is not null and method is not null").select("owner", "method").distinct()
    o, m = F.col("owner"), F.col("method")
    return x.select("owner", "method", C.external_id(o, m).alias("id"), C.external_display(o, m).alias("name"))


@query(f"""with x as (select node_id, any_value(owner) as owner, any_value(method) as method from catalog where label = 'External' group by node_id), n as (select dst, count(*) as n from edges where type = 'CALLS_EXTERNAL' group by dst),
k as (select owner, method, sum(coalesce(n, 0)) as n_calls from x left join n on n.dst = x.node_id where owner is not null group by owner, method)
select owner, method, n_calls::bigint as n_calls, sum(n_calls) over (partition by owner)::bigint as owner_calls from k where not ({' or '.join(f"starts_with(owner, '{p}')" for p in C.NOISE)}) order by n_calls desc, owner, method limit 100""")
def external_top(spark, d):
    """The hundred most called external methods, without those that say little, with their owner's calls."""
    n = edges(spark, d, "CALLS_EXTERNAL").groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    x = table(spark, d, "catalog").filter("label = 'External' and owner is not null").select("node_id", "owner", "method").dropDuplicates(["node_id"])
    k = x.join(n, "node_id", "left").filter(~C.is_noise(F.col("owner"))).groupBy("owner", "method").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_calls"))
    own = k.groupBy("owner").agg(F.sum("n_calls").alias("owner_calls"))
    return k.join(own, "owner").orderBy(F.desc("n_calls"), "owner", "method").limit(100).select("owner", "method", "n_calls", "owner_calls")


@query(f"select distinct id as src, 'acq:' || fqn as id, name from nodes where label = 'Function' and id is not null and (return_type in ({_IN(C.CONNECTION_TYPES)}) or {_TAIL.format('return_type')} in ({_IN(_SIMPLE(C.CONNECTION_TYPES))}))")
def in_repo_acquires(spark, d):
    """Functions of the repository that hand out connections."""
    return K.in_repo_acquires(functions(spark, d)).select("src", "id", "name")
