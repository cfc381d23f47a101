"""Queries of the code-graph operators over the node, edge, file and log tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.operators import store as S
from graphloom.plans.common import Registry
from graphloom.plans.common import edges as _edges
from graphloom.plans.common import functions as _fn
from graphloom.plans.common import table as _t
from graphloom.streaming import incremental as I

query = Registry()
QUERIES, SQL = query.queries, query.sql

# Views used by many queries: functions once each, calls, links to external nodes.
_FN = "fn as (select distinct id, name, fqn, repo, file, package, param_count, return_type, start_line, body_hash from nodes where label = 'Function' and id is not null)"
_CALLS = "calls as (select src, dst, strategy from edges where type = 'CALLS' and dst is not null)"
_TRUST = "(coalesce(strategy, '') = 'bytecode' or starts_with(coalesce(strategy, ''), 'receiver_type') or starts_with(coalesce(strategy, ''), 'same_'))"


# identities and names


@query("select id, substr(sha1(repo || chr(0) || kind || chr(0) || fqn), 1, 16) as made from nodes where label = 'Function' and repo is not null and kind is not null and fqn is not null")
def ids_make_id(spark, d):
    n = _t(spark, d, "nodes").filter("label = 'Function'").dropna(subset=["repo", "kind", "fqn"])
    return n.select("id", X.make_id(F.col("repo"), F.col("kind"), F.col("fqn")).alias("made"))


@query("select file_id, substr(sha1(source), 1, 16) as hash, sha = substr(sha1(source), 1, 16) as agrees from file_info")
def ids_body_hash(spark, d):
    h = X.body_hash(F.col("source"))
    return _t(spark, d, "file_info").select("file_id", h.alias("hash"), (F.col("sha") == h).alias("agrees"))


@query("""with m as (select repo, relpath, max_by(sha, file_id) as sha from file_info where repo is not null group by repo, relpath)
select repo, sha1(string_agg(relpath || ':' || sha, chr(10) order by relpath)) as hash, count(*) as n_files from m group by repo""")
def codebase_hash(spark, d):
    """Hash of each repository's manifest: its lines, sorted by path. The lines of one repository's
    manifest (a path and a short hash a file) have to come together, as the hash runs over all."""
    m = _t(spark, d, "file_info").filter("repo is not null").groupBy("repo", "relpath").agg(F.max_by("sha", "file_id").alias("sha"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("relpath", "sha"))), lambda x: F.concat(x["relpath"], F.lit(":"), x["sha"]))
    return m.groupBy("repo").agg(F.sha1(F.array_join(lines, "\n")).alias("hash"), F.count(F.lit(1)).alias("n_files"))


@query(r"""with r as (select distinct regexp_replace(trim(relpath), '^[''"]+|[''"]+$', '', 'g') as p, relpath from file_info where relpath is not null),
a as (select relpath, p, regexp_replace(regexp_replace(regexp_replace(p, '\{[^/}]*\}', '*', 'g'), '<[^/>]*>', '*', 'g'), ':[^/]+', '*', 'g') as q from r),
b as (select relpath, p, case when starts_with(q, '/') then q else '/' || q end as q from a)
select relpath, case when p = '' then '' when length(q) > 1 then regexp_replace(q, '/+$', '') else q end as route, len(list_filter(string_split(q, '/'), lambda x: x <> '')) as n_segments from b""")
def route_normalize(spark, d):
    r = _t(spark, d, "file_info").select("relpath").dropna().distinct()
    return r.select("relpath", X.route(F.col("relpath")).alias("route"), F.size(X.segments(X.route(F.col("relpath")))).cast("long").alias("n_segments"))


@query(r"""select distinct name, trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(name), '([a-z0-9])([A-Z])', '\1.\2', 'g')), '[_\-/:]+|\s+', '.', 'g'), '\.{2,}', '.', 'g'), '.') as dotted
from nodes where label = 'Function' and name is not null""")
def event_name_normalize(spark, d):
    return _t(spark, d, "nodes").filter("label = 'Function' and name is not null").select("name", X.dotted(F.col("name")).alias("dotted")).distinct()


@query("""with t as (select distinct return_type as raw from nodes where return_type is not null union select distinct unnest(param_types) from nodes)
select raw, list_extract(string_split(trim(replace(split_part(raw, '<', 1), '[]', '')), '.'), -1) as simple from t where raw is not null""")
def type_simple_name(spark, d):
    n = _t(spark, d, "nodes")
    t = n.select(F.col("return_type").alias("raw")).union(n.select(F.explode("param_types"))).dropna().distinct()
    return t.select("raw", X.simple_type(F.col("raw")).alias("simple"))


def _duck_case(expr: str, table: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {expr} in ({', '.join(repr(k) for k in ks)}) then '{v}'" for v, ks in table.items()) + " else null end"


_NAME, _EXT = "lower(list_extract(string_split(relpath, '/'), -1))", "regexp_extract({}, '^.+\\.([^.]*)$', 1)"
_ART = f"coalesce({_duck_case(_NAME, X.ARTIFACT_NAMES)}, case when ends_with({_NAME}, '.d.ts') then 'stub' end, {_duck_case(_EXT.format(_NAME), X.ARTIFACT_EXTENSIONS)})"


@query(f"select distinct relpath, {_ART} as artifact, case when {_ART} is null then {_duck_case(_EXT.format('list_extract(string_split(relpath, chr(47)), -1)'), X.LANGUAGES)} end as lang from file_info where relpath is not null")
def path_kinds(spark, d):
    p = F.col("relpath")
    return _t(spark, d, "file_info").dropna(subset=["relpath"]).select("relpath", X.artifact_kind(p).alias("artifact"), X.source_lang(p).alias("lang")).distinct()


# store and validation


@query("""select id, max_by(name, last_indexed) filter (where name is not null) as name, max_by(signature, last_indexed) filter (where signature is not null) as signature,
max_by(body_hash, last_indexed) filter (where body_hash is not null) as body_hash, max(last_indexed) as last_indexed from nodes where id is not null group by id""")
def upsert_nodes(spark, d):
    n = _t(spark, d, "nodes")
    up = S.upsert(n, ["id"], F.col("last_indexed"), ["name", "signature", "body_hash", "last_indexed"])
    return up


@query("""with ids as (select id from nodes union select node_id from catalog union select repo_id from graph_meta)
select type, src, dst, max(evidence_line) as evidence_line, count(*) as n_written from edges where src in (select id from ids where id is not null) and dst in (select id from ids where id is not null) and type is not null group by type, src, dst""")
def upsert_edges(spark, d):
    """Edges with both ends, once per (type, src, dst); evidence is that of the largest line."""
    ids = _all_ids(spark, d)
    e = S.with_endpoints(_t(spark, d, "edges").filter("type is not null"), ids)
    return e.groupBy("type", "src", "dst").agg(F.max("evidence_line").alias("evidence_line"), F.count(F.lit(1)).alias("n_written"))


def _all_ids(spark, d) -> DataFrame:
    return _t(spark, d, "nodes").select("id").union(_t(spark, d, "catalog").select("node_id")).union(_t(spark, d, "graph_meta").select("repo_id")).dropna().distinct()


@query("""select repo, relpath, arg_min(sha, file_id) as sha, min(file_id) as file_id, count(*) as n_rows from file_info where repo is not null and relpath is not null group by repo, relpath""")
def dedupe_first_wins(spark, d):
    """Of rows of one key the one that arrived first, by the number given on arrival."""
    f = _t(spark, d, "file_info").select("repo", "relpath", "file_id", "sha").dropna(subset=["repo", "relpath"])
    n = f.groupBy("repo", "relpath").agg(F.count(F.lit(1)).alias("n_rows"))
    return S.first_wins(f, ["repo", "relpath"], ["file_id"]).select("repo", "relpath", "sha", "file_id").join(n, ["repo", "relpath"])


_GONE = "gone as (select distinct id from nodes where repo = 'harbor-core' and file in (select relpath from file_info where repo = 'harbor-core' and lang = 'sql'))"


@query(f"with {_GONE} select label, count(*) as n_nodes from nodes where id is null or id not in (select id from gone where id is not null) group by label")
def delete_files_nodes(spark, d):
    files = _t(spark, d, "file_info").filter("repo = 'harbor-core' and lang = 'sql'").select(F.col("relpath").alias("file"))
    n, _ = S.delete_files(_t(spark, d, "nodes"), _t(spark, d, "edges"), "harbor-core", files)
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"with {_GONE} select type, count(*) as n_edges from edges where coalesce(src, '') not in (select id from gone where id is not null) and coalesce(dst, '') not in (select id from gone where id is not null) group by type")
def delete_files_edges(spark, d):
    files = _t(spark, d, "file_info").filter("repo = 'harbor-core' and lang = 'sql'").select(F.col("relpath").alias("file"))
    _, e = S.delete_files(_t(spark, d, "nodes"), _t(spark, d, "edges"), "harbor-core", files)
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"))


@query("""with a as (select repo || '/' || relpath as relpath, min_by(sha, file_id) as sha from file_info where repo is not null and relpath is not null and file_id % 7 <> 0 group by 1),
b as (select repo || '/' || relpath as relpath, max_by(sha, file_id) as sha from file_info where repo is not null and relpath is not null and lang is not null group by 1)
select coalesce(a.relpath, b.relpath) as relpath, case when a.relpath is null then 'added' when b.relpath is null then 'deleted' else 'changed' end as change
from a full join b on a.relpath = b.relpath where a.relpath is null or b.relpath is null or a.sha is distinct from b.sha""")
def manifest_diff(spark, d):
    """Two manifests of the same tree: an older one that lacks some files, a newer one without settings."""
    f = _t(spark, d, "file_info").dropna(subset=["repo", "relpath"]).withColumn("relpath", F.concat_ws("/", "repo", "relpath"))
    a = f.filter("file_id % 7 <> 0").groupBy("relpath").agg(F.min_by("sha", "file_id").alias("sha"))
    b = f.filter("lang is not null").groupBy("relpath").agg(F.max_by("sha", "file_id").alias("sha"))
    return S.manifest_diff(a, b)


@query("select type, count(*) as n_edges, count(distinct src) as n_sources from edges group by type")
def edge_histogram(spark, d):
    return _t(spark, d, "edges").groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_sources"))


@query("select strategy, count(*) as n_edges from edges where strategy is not null group by strategy order by n_edges desc, strategy limit 15")
def edges_by_strategy(spark, d):
    e = _t(spark, d, "edges").filter("strategy is not null").groupBy("strategy").agg(F.count(F.lit(1)).alias("n_edges"))
    return e.orderBy(F.desc("n_edges"), "strategy").limit(15)


@query("""with ids as (select id from nodes where id is not null union select node_id from catalog where node_id is not null union select repo_id from graph_meta where repo_id is not null)
select type, count(*) as n_dangling, sum((dst is null)::int) as n_null from edges where dst is null or dst not in (select id from ids) group by type""")
def dangling_edges(spark, d):
    e = S.dangling(_t(spark, d, "edges"), _all_ids(spark, d))
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n_dangling"), F.count_if(F.col("dst").isNull()).alias("n_null"))


@query("select id, count(*) as n_rows from nodes where id is not null group by id having count(*) > 1")
def duplicate_ids(spark, d):
    return _t(spark, d, "nodes").filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


@query("""select repo, count(*) as n_nodes, count(*) filter (where label = 'Function') as n_functions, count(*) filter (where end_line < start_line or start_line < 1) as n_bad_ranges,
count(*) filter (where label = 'Function' and file is null) as n_no_file from nodes group by repo""")
def validate_nodes(spark, d):
    n = _t(spark, d, "nodes")
    fn = F.col("label") == "Function"
    return n.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(fn).alias("n_functions"),
        F.count_if((F.col("end_line") < F.col("start_line")) | (F.col("start_line") < 1)).alias("n_bad_ranges"), F.count_if(fn & F.col("file").isNull()).alias("n_no_file"),
    )


@query("""with n as (select distinct id, repo from nodes where id is not null)
select a.repo, count(*) as n_edges from edges e join n a on a.id = e.src join n b on b.id = e.dst and a.repo = b.repo group by a.repo""")
def namespace_counts(spark, d):
    n = _t(spark, d, "nodes").select("id", "repo").filter("id is not null").distinct()
    a, b = n.select(F.col("id").alias("src"), "repo"), n.select(F.col("id").alias("dst"), F.col("repo").alias("other"))
    return _t(spark, d, "edges").select("src", "dst").join(a, "src").join(b, "dst").filter("repo = other").groupBy("repo").agg(F.count(F.lit(1)).alias("n_edges"))


@query("""with x as (select md5(coalesce(type, '') || chr(31) || coalesce(src, '') || chr(31) || coalesce(dst, '') || chr(31) || coalesce(strategy, '')) as d from edges),
l as (select count(*) as n, sum(('0x' || substr(d, 1, 8))::hugeint) as a, sum(('0x' || substr(d, 9, 8))::hugeint) as b, sum(('0x' || substr(d, 17, 8))::hugeint) as c, sum(('0x' || substr(d, 25, 8))::hugeint) as e from x),
c3 as (select *, e // 4294967296 as k3 from l), c2 as (select *, (c + k3) // 4294967296 as k2 from c3), c1 as (select *, (b + k2) // 4294967296 as k1 from c2)
select n as n_rows, lpad(lower(to_hex(((a + k1) % 4294967296)::bigint)), 8, '0') || lpad(lower(to_hex(((b + k2) % 4294967296)::bigint)), 8, '0') || lpad(lower(to_hex(((c + k3) % 4294967296)::bigint)), 8, '0') || lpad(lower(to_hex((e % 4294967296)::bigint)), 8, '0') as hash from c1""")
def fingerprint_edges(spark, d):
    return S.set_hash(_t(spark, d, "edges"), ["type", "src", "dst", "strategy"])


# neighbourhoods and ancestors

@query(f"with {_CALLS}, e as (select distinct src, dst from calls where src is not null) select src as id, dst as other, 1 as depth from e union select a.src, b.dst, 2 from e a join e b on b.src = a.dst")
def neighbourhood(spark, d):
    return G.neighbourhood(_edges(spark, d, "CALLS").filter("src is not null"), 2)


_UPS = "links as (select distinct src as child, dst as parent from edges where type in ('EXTENDS', 'IMPLEMENTS') and src is not null and dst is not null)"


@query(f"with recursive {_UPS}, up as (select child as id, parent as ancestor, 1 as depth from links union select up.id, l.parent, depth + 1 from up join links l on l.child = up.ancestor where depth < 40) select id, ancestor, min(depth) as depth from up where id <> ancestor group by id, ancestor")
def ancestor_chain(spark, d):
    return G.ancestors(_edges(spark, d, "EXTENDS", "IMPLEMENTS").select(F.col("src").alias("child"), F.col("dst").alias("parent")))


# derived edges

_CLS = "cls as (select distinct id, name, fqn from nodes where label = 'Class'), own as (select distinct f.id, f.name, f.param_count, e.src as class_id from fn f join edges e on e.dst = f.id and e.type = 'CONTAINS' join cls on cls.id = e.src)"


def _methods(spark, d) -> DataFrame:
    c = _t(spark, d, "nodes").filter("label = 'Class'").select(F.col("id").alias("class_id")).distinct()
    own = _edges(spark, d, "CONTAINS").select(F.col("src").alias("class_id"), F.col("dst").alias("id")).distinct().join(c, "class_id", "left_semi")
    return _fn(spark, d).select("id", "name", "param_count").distinct().join(own, "id")


_OVER = f"""{_FN}, {_CLS}, {_UPS}, up as (select child as id, parent as ancestor, 1 as depth from links union select up.id, l.parent, depth + 1 from up join links l on l.child = up.ancestor where depth < 40),
over as (select distinct m.id as src, b.id as dst from own m join up on up.id = m.class_id and up.id <> up.ancestor join own b on b.class_id = up.ancestor and b.name = m.name and b.param_count is not distinct from m.param_count)"""


def _overrides(spark, d) -> DataFrame:
    m = _methods(spark, d)
    up = ancestor_chain(spark, d).select(F.col("id").alias("class_id"), F.col("ancestor").alias("up_class"))
    base = m.select(F.col("id").alias("dst"), "name", F.col("param_count").alias("n"), F.col("class_id").alias("up_class"))
    return m.join(up, "class_id").join(base, ["up_class", "name"]).filter(F.col("param_count").eqNullSafe(F.col("n"))).select(F.col("id").alias("src"), "dst").distinct()


@query(f"with recursive {_OVER} select src, dst from over")
def derive_overrides(spark, d):
    """Methods and the methods of ancestors that they override, by name and number of parameters."""
    return _overrides(spark, d)


@query(f"with recursive {_OVER}, {_CALLS} select distinct c.src, o.src as dst from calls c join over o on o.dst = c.dst where c.src is not null and not exists (select 1 from calls k where k.src = c.src and k.dst = o.src)")
def polymorphic_calls(spark, d):
    """Calls of a method also call what overrides it, unless that call is known already."""
    calls = _edges(spark, d, "CALLS").select("src", "dst").dropna().distinct()
    o = _overrides(spark, d).select(F.col("dst").alias("base"), F.col("src").alias("dst"))
    more = calls.withColumnRenamed("dst", "base").join(o, "base").select("src", "dst").distinct()
    return more.join(calls, ["src", "dst"], "left_anti")


@query("""with f as (select distinct repo, package from nodes where label = 'File' and package is not null and package <> '' and repo is not null),
p as (select distinct repo, array_to_string(string_split(package, '.')[1:k], '.') as child, array_to_string(string_split(package, '.')[1:k - 1], '.') as parent from f, (select unnest(range(1, 60)) as k) where k <= len(string_split(package, '.')))
select repo, parent, child from p""")
def package_tree(spark, d):
    """Parent and child packages out of the packages of files; top packages have an empty parent."""
    f = _t(spark, d, "nodes").filter("label = 'File' and package is not null and package <> '' and repo is not null").select("repo", "package").distinct()
    parts = F.split("package", r"\.")
    k = f.select("repo", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    prefix = lambda n: F.array_join(F.slice("p", 1, n), ".")
    return k.select("repo", F.when(F.col("k") == 1, "").otherwise(prefix(F.greatest(F.col("k") - 1, F.lit(1)))).alias("parent"), prefix(F.col("k")).alias("child")).distinct()


@query("""with t as (select distinct lower(name) as t from nodes where label = 'Table' and name is not null),
x as (select distinct file_id, lower(unnest(regexp_extract_all(source, '(?i)\\b(?:from|join|into|update)\\s+([a-z_][a-z0-9_]*)', 1))) as t from file_info where lang <> 'sql')
select file_id, t as table_name from x where t in (select t from t)""")
def sql_links(spark, d):
    """Tables named by SQL texts inside source files."""
    t = _t(spark, d, "nodes").filter("label = 'Table' and name is not null").select(F.lower("name").alias("table_name")).distinct()
    f = _t(spark, d, "file_info").filter("lang <> 'sql'")
    x = f.select("file_id", F.explode(F.regexp_extract_all("source", F.lit(r"(?i)\b(?:from|join|into|update)\s+([a-z_][a-z0-9_]*)"), 1)).alias("t"))
    return x.select("file_id", F.lower("t").alias("table_name")).distinct().join(t, "table_name", "left_semi").select("file_id", "table_name")


# classification and inventory


@query("""select c.owner, c.method, coalesce(c.role, 'none') as role, coalesce(c.category, '') as category, count(e.dst) as n_calls from catalog c left join edges e on e.dst = c.node_id and e.type = 'CALLS_EXTERNAL'
where c.label = 'External' group by 1, 2, 3, 4""")
def external_inventory(spark, d):
    """Calls per external method, combined per target before the join."""
    n = _edges(spark, d, "CALLS_EXTERNAL").groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    c = _t(spark, d, "catalog").filter("label = 'External'").join(n, "node_id", "left")
    return c.groupBy("owner", "method", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("category", F.lit("")).alias("category")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_calls"))


@query("""select e.src as id, string_agg(distinct c.category, ',' order by c.category) as categories, bool_or(c.role = 'source') as is_source, bool_or(c.role = 'sanitizer') as is_sanitizer
from (select distinct src, dst from edges where type = 'CALLS_EXTERNAL' and src is not null) e join catalog c on c.node_id = e.dst where c.category is not null group by e.src""")
def taint_marks(spark, d):
    e = _edges(spark, d, "CALLS_EXTERNAL").select("src", "dst").dropna().distinct()
    c = _t(spark, d, "catalog").filter("category is not null").select(F.col("node_id").alias("dst"), "category", "role")
    return e.join(c, "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"), F.bool_or(F.col("role") == "source").alias("is_source"), F.bool_or(F.col("role") == "sanitizer").alias("is_sanitizer"))


# incremental state, runs, vectors


@query("""with w as (select distinct write_seq, op, id, nullif(body_hash, '') as b, nullif(summary_hash, '') as s from function_log where id is not null),
gone as (select id, max(write_seq) as at from w where op = 'delete' group by id),
live as (select w.* from w left join gone on gone.id = w.id where op <> 'delete' and write_seq > coalesce(gone.at, -1)),
f as (select id, max_by(b, write_seq) filter (where b is not null) as b, max_by(s, write_seq) filter (where s is not null) as s from live group by id)
select count(*) as n_functions, count(*) filter (where s is not null) as n_summaries, count(*) filter (where s = b) as n_fresh, count(*) filter (where s is not null and s is distinct from b) as n_stale from f where b is not null""")
def summary_coverage(spark, d):
    """Of the functions that exist, how many have a summary, and of the body they have now; what was
    deleted is gone with its properties."""
    f = I.fold_log(_t(spark, d, "function_log")).select("id", *[F.when(F.col("deleted_at").isNull() | (F.col(f"{c}_at") > F.col("deleted_at")), F.col(c)).alias(c) for c in ("body", "summary")])
    b, u = F.col("body"), F.col("summary")
    return f.filter("body is not null").agg(F.count(F.lit(1)).alias("n_functions"), F.count("summary").alias("n_summaries"), F.count_if(b == u).alias("n_fresh"), F.count_if(u.isNotNull() & ~u.eqNullSafe(b)).alias("n_stale"))


@query("""select case when error is null then 'ok' else 'failed' end as outcome, count(*) as n_runs, max(overall_peak_mb) as peak_mb, round(sum(total_duration_s), 3) as total_s from run_index group by 1""")
def run_report(spark, d):
    r = _t(spark, d, "run_index").groupBy(F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("outcome"))
    return r.agg(F.count(F.lit(1)).alias("n_runs"), F.max("overall_peak_mb").alias("peak_mb"), F.round(F.sum("total_duration_s"), 3).alias("total_s"))
