"""Marks, universe, paths and findings over the call graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import calls as C
from graphloom.functions import text as X
from graphloom.operators import findings as V
from graphloom.operators import graph as G
from graphloom.operators import reach as R
from graphloom.operators import store as S
from graphloom.plans.common import Registry, functions, table
from graphloom.session import Scratch, files_of

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Hops of a path, calls that make a hub, and rows of a report.
DEPTH, HUB, PATHS, LEAKS = 8, 500, 20_000, 1_000


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TRUST = "(strategy = 'bytecode' or starts_with(strategy, 'receiver_type') or starts_with(strategy, 'same_'))"
_CATEGORY = "case " + " ".join(f"when {{0}} in ('{k}', '{k.split('/', 1)[1]}') then '{v}'" for k, v in C.CATEGORY_KINDS.items()) + " else 'taint_sink' end"
_KIND = f"case when role = 'acquire' then 'db_acquire' when role = 'release' then 'db_release' when role = 'other' then 'other' when role = 'source' then 'taint_source' when role = 'sanitizer' then 'taint_sanitizer' when role = 'sink' then {_CATEGORY.format('category')} end"
_BASE = f"""fn as (select distinct id, name, fqn, repo, file, lang, start_line, body_hash from nodes where label = 'Function' and id is not null),
fi as (select distinct id from fn),
t as (select src, dst, min(strategy) as strategy from edges where type = 'CALLS' and strategy is not null and {_TRUST} and src in (select id from fi) and dst in (select id from fi) group by src, dst),
x as (select node_id, method as name, {_KIND} as kind from catalog where label = 'External'),
direct as (select distinct e.src as id, x.kind from edges e join x on x.node_id = e.dst where e.type = 'CALLS_EXTERNAL' and x.kind in ({_list(C.DANGEROUS)}) and e.src in (select id from fi)),
cats as (select distinct id, {_CATEGORY.format('c')} as kind from (select id, unnest(taint_categories) as c from nodes where label = 'Function') where id not in (select id from direct)),
seeds as (select * from direct union all select * from cats),
ups as (select id from seeds union select t.src from ups join t on t.dst = ups.id),
entry as (select distinct e.src as id, 'annotation' as why from edges e join catalog c on c.node_id = e.dst where e.type = 'ANNOTATED_WITH' and c.label = 'Annotation' and ltrim(c.owner, '@') in ({_list(R.ENTRY_ANNOTATIONS)}) and e.src in (select id from fi)
 union select distinct src, 'endpoint' from edges where type = 'EXPOSES' and src in (select id from fi) union select distinct id, 'page' from fn where lang = 'jsp' and name = '_jspService'
 union select distinct id, 'source' from nodes where label = 'Function' and taint_source),
downs as (select id from entry union select t.dst from downs join t on t.src = downs.id)"""


_marks: dict[tuple, dict[str, DataFrame]] = {}


class _Graph:
    """The inputs of the analysis, and the marks that several queries derive from them: each is
    written once per session and state of the input files."""

    def __init__(self, spark, d):
        self.spark = spark
        state = tuple(files_of(spark, f"{d}/{t}.parquet") for t in ("nodes", "edges", "catalog"))
        self.kept = _marks.setdefault((spark.sparkContext.applicationId, d, state), {})
        self.nodes, self.edges = table(spark, d, "nodes"), table(spark, d, "edges")
        self.functions = functions(spark, d)
        c = table(spark, d, "catalog")
        self.external = c.filter("label = 'External'").select("node_id", C.node_kind(F.col("role"), F.col("category")).alias("kind"), F.col("method").alias("name"))
        self.annotations = c.filter("label = 'Annotation'").select("node_id", F.col("owner").alias("name"))
        self.calls = R.trusted_calls(self.edges, self.functions)

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.kept:
            self.kept[name], _ = Scratch(self.spark, "marks").write(build(), name)
        return self.kept[name]

    def sinks(self) -> DataFrame:
        return R.sink_seeds(self.functions, self.nodes, self.edges, self.external)

    def reach(self) -> DataFrame:
        return self._once("reach", lambda: R.reaches_sink(self.sinks(), self.calls))

    def entries(self) -> DataFrame:
        return R.entry_seeds(self.functions, self.nodes, self.edges, self.annotations)

    def from_entry(self) -> DataFrame:
        return self._once("from_entry", lambda: G.closure(self.entries().select("id").distinct(), self.calls))

    def hubs(self) -> DataFrame:
        return G.hubs(self.edges.filter("type = 'CALLS' and dst is not null"), HUB)

    def direct(self) -> DataFrame:
        return R.external_kinds(self.edges, self.external, C.DANGEROUS).join(self.functions.select("id").distinct(), "id", "left_semi")

    def paths(self) -> DataFrame:
        return self._once("paths", lambda: R.sink_paths(self.from_entry(), self.direct(), self.calls, self.reach(), self.hubs(), DEPTH))

    def named(self) -> DataFrame:
        return self.functions.groupBy("id").agg(F.min("fqn").alias("fqn"), F.min("repo").alias("repo"), F.min("file").alias("file"), F.min("start_line").alias("start_line"), F.min("body_hash").alias("body_hash"))


@query(f"with recursive {_BASE} select id, coalesce(string_agg(distinct kind, ',' order by kind), '') as kinds from seeds group by id")
def sink_seeds(spark, d):
    """Functions that are dangerous themselves, with the kinds."""
    return _Graph(spark, d).sinks().groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query(f"with recursive {_BASE} select id from ups")
def reach_sink(spark, d):
    """Functions from which a sink can be reached over trusted calls."""
    return _Graph(spark, d).reach()


@query(f"with recursive {_BASE}, up as (select id, kind from seeds union select t.src, up.kind from up join t on t.dst = up.id) select id, string_agg(kind, ',' order by kind) as kinds from up group by id")
def reach_sink_kinds(spark, d):
    """The kinds of sinks each function reaches."""
    g = _Graph(spark, d)
    return R.reaches_kinds(g.sinks(), g.calls).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query(f"with recursive {_BASE} select why, count(*) as n_functions from entry group by why")
def entry_counts(spark, d):
    """Entries per origin: their ratio tells which convention a repository follows."""
    return _Graph(spark, d).entries().groupBy("why").agg(F.count(F.lit(1)).alias("n_functions"))


@query(f"with recursive {_BASE} select id from downs")
def reach_entry(spark, d):
    """Functions reachable from where something comes in."""
    return _Graph(spark, d).from_entry()


@query(f"""with recursive {_BASE}, marks as (select distinct repo, id, id in (select id from ups) as s, id in (select id from downs) as e from fn)
select repo, count(*) as n_functions, count(*) filter (where s) as n_reach_sink, count(*) filter (where e) as n_from_entry, count(*) filter (where s and e) as n_universe,
round(count(*) filter (where s and e)::double / count(*), 4) as share from marks group by repo""")
def universe(spark, d):
    """Functions between an entry and a sink, per repository."""
    g = _Graph(spark, d)
    up, down = g.reach().withColumn("s", F.lit(True)), g.from_entry().withColumn("e", F.lit(True))
    m = g.functions.select("id", "repo").distinct().join(up, "id", "left").join(down, "id", "left")
    s, e = F.coalesce("s", F.lit(False)), F.coalesce("e", F.lit(False))
    return m.groupBy("repo").agg(F.count(F.lit(1)).alias("n_functions"), F.count_if(s).alias("n_reach_sink"), F.count_if(e).alias("n_from_entry"), F.count_if(s & e).alias("n_universe"), F.round(F.count_if(s & e) / F.count(F.lit(1)), 4).alias("share"))


@query(f"""select count(*) filter (where taint_source) as n_sources, count(*) filter (where taint_sanitizer) as n_sanitizers, count(*) filter (where len(taint_categories) > 0) as n_sinks, count(*) filter (where len(taint_sites) > 0) as n_with_sites
from (select distinct id, taint_source, taint_sanitizer, taint_categories, taint_sites from nodes where label = 'Function')""")
def mark_counts(spark, d):
    """Functions with marks of the catalog, by kind of mark."""
    n = table(spark, d, "nodes").filter("label = 'Function'").select("id", "taint_source", "taint_sanitizer", "taint_categories", "taint_sites").distinct()
    return n.agg(F.count_if("taint_source").alias("n_sources"), F.count_if("taint_sanitizer").alias("n_sanitizers"), F.count_if(F.size("taint_categories") > 0).alias("n_sinks"), F.count_if(F.size("taint_sites") > 0).alias("n_with_sites"))


@query("""select file, repo, string_agg(distinct c, ',' order by c) as categories from (select file, repo, unnest(taint_categories) as c from nodes where label = 'Function' and file is not null) group by file, repo""")
def marks_per_file(spark, d):
    """Categories found anywhere in a file."""
    n = table(spark, d, "nodes").filter("label = 'Function' and file is not null").select("file", "repo", F.explode("taint_categories").alias("c"))
    return n.groupBy("file", "repo").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("categories"))


@query(f"select dst as id, count(*) as callers from edges where type = 'CALLS' and dst is not null group by dst having count(*) >= {HUB // 10} order by callers desc, id")
def hubs(spark, d):
    """Functions with very many calls, most called first, at a tenth of the threshold that paths use."""
    return G.hubs(table(spark, d, "edges").filter("type = 'CALLS' and dst is not null"), HUB // 10).orderBy(F.desc("callers"), "id")


_WALKS = f"""{_BASE}, hub as (select dst as id from edges where type = 'CALLS' and dst is not null group by dst having count(*) >= {HUB}),
ok as (select id from ups where id not in (select id from hub)), te as (select * from t where src in (select id from ok) and dst in (select id from ok)),
walk as (select [id] as ids, []::varchar[] as strategies, id as top, 0 as hops from (select distinct id from downs) where id in (select id from ok)
 union all select list_append(ids, te.dst), list_append(strategies, te.strategy), te.dst, hops + 1 from walk join te on te.src = walk.top
 where hops < {DEPTH} and not list_contains(list_transform(range(1, len(ids)), lambda i: ids[i] || ids[i + 1]), te.src || te.dst)),
paths as (select ids, strategies, hops from walk where top in (select id from direct))"""
_NAMED = "named as (select id, min(fqn) as fqn, min(repo) as repo, min(file) as file, min(start_line) as start_line, min(body_hash) as body_hash from fn group by id)"


@query(f"with recursive {_WALKS}, {_NAMED} select array_to_string(ids, '>') as path, array_to_string(strategies, ',') as strategies, hops, a.fqn as entry from paths join named a on a.id = ids[1] order by hops, entry, path limit {PATHS}")
def sink_paths(spark, d):
    """Trails of trusted hops from where something comes in to a sink, shortest first; cut at the
    report's length, see ``sink_paths_report`` for what was left out."""
    g = _Graph(spark, d)
    p = g.paths().join(g.named().select(F.col("id").alias("first"), F.col("fqn").alias("entry")), F.element_at("ids", 1) == F.col("first"))
    p = p.select(F.array_join("ids", ">").alias("path"), F.array_join("strategies", ",").alias("strategies"), "hops", "entry")
    return p.orderBy("hops", "entry", "path").limit(PATHS)


@query(f"with recursive {_WALKS} select hops, count(*) as n_paths, count(distinct ids[-1]) as n_sinks, sum(count(*)) over () > {PATHS} as truncated from paths group by hops")
def sink_paths_report(spark, d):
    """Paths per length, and whether there are more than a report takes."""
    p = _Graph(spark, d).paths()
    n = p.groupBy("hops").agg(F.count(F.lit(1)).alias("n_paths"), F.count_distinct(F.element_at("ids", -1)).alias("n_sinks"))
    return n.withColumn("truncated", F.sum("n_paths").over(W.partitionBy(F.lit(1))) > PATHS)  # one row a length


_TRUST_CASE = "case when coalesce(s, '') = '' then 0.3 " + " ".join(f"when split_part(s, '+', 1) = '{k}' then {v}" for k, v in G.TRUST.items()) + " " + " ".join(f"when starts_with(split_part(s, '+', 1), '{k}') then {G.TRUST[k]}" for k in sorted(G.TRUST, key=len, reverse=True)) + " else 0.3 end"
_CLEAN = "clean as (select distinct id from nodes where taint_sanitizer)"
_SCORED = f"""{_WALKS}, {_NAMED}, {_CLEAN}, dirty as (select distinct ids from (select ids, unnest(ids) as id from paths) where id in (select id from clean)),
scored as (select p.ids, p.strategies, p.hops, d.ids is not null as has_sanitizer from paths p left join dirty d on d.ids = p.ids),
score as (select *, round(case when len(strategies) = 0 then 0.95 else list_min(list_transform(strategies, lambda s: {_TRUST_CASE})) * case when has_sanitizer then 0.5 else 1 end * case when hops > 6 then 0.9 else 1 end end, 3)::double as score from scored)"""


def _scored(g: _Graph) -> DataFrame:
    p = R.on_path(g.paths(), g.nodes.filter("taint_sanitizer").select("id"))
    return p.withColumn("score", G.path_score(F.col("strategies"), F.col("has_sanitizer"), F.col("hops")))


@query(f"with recursive {_SCORED} select array_to_string(ids, '>') as path, has_sanitizer, score from score")
def path_score(spark, d):
    """How far each path can be trusted: by its weakest hop, its sanitizers and its length."""
    return _scored(_Graph(spark, d)).select(F.array_join("ids", ">").alias("path"), "has_sanitizer", "score")


@query(f"with recursive {_WALKS} select ids[1] as first, ids[-1] as last, array_to_string(arg_min(ids, (lpad((99 - hops)::varchar, 3, '0')) || array_to_string(ids, '')), '>') as path, max(hops) as hops from paths group by 1, 2")
def path_dedupe(spark, d):
    """Of the paths with the same ends the longest."""
    return G.longest_per_ends(_Graph(spark, d).paths()).select("first", "last", F.array_join("ids", ">").alias("path"), "hops")


@query(f"""with recursive {_WALKS}, {_NAMED}, best as (select ids[1] as f, ids[-1] as l, arg_min(ids, (lpad((99 - hops)::varchar, 3, '0')) || array_to_string(ids, '')) as ids, max(hops) as hops from paths group by 1, 2),
r as (select n.fqn as sink, array_to_string(ids, '>') as path, row_number() over (partition by n.fqn order by hops, array_to_string(ids, '>')) - 1 as i from best join named n on n.id = best.l)
select sink, i // 3 as batch, string_agg(path, ';' order by i) as paths, count(*) as n_paths from r group by sink, i // 3""")
def path_batches(spark, d):
    """Paths that share a sink, three to a batch."""
    g = _Graph(spark, d)
    p = G.longest_per_ends(g.paths()).join(g.named().select(F.col("id").alias("last"), F.col("fqn").alias("sink")), "last").withColumn("path", F.array_join("ids", ">"))
    b = S.chunked(p, "sink", ["hops", "path"], 3)
    return b.groupBy("sink", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), ";").alias("paths"), F.count(F.lit(1)).alias("n_paths"))


@query(f"""with recursive {_BASE}, hub as (select dst as id from edges where type = 'CALLS' and dst is not null group by dst having count(*) >= {HUB}),
te as (select * from t where src not in (select id from hub) and dst not in (select id from hub)),
acq as (select distinct e.src as id from edges e join x on x.node_id = e.dst where e.type = 'CALLS_EXTERNAL' and x.kind = 'db_acquire' and e.src in (select id from fi) and e.src not in (select id from hub)),
walk as (select [id] as ids, id as top, 0 as hops from acq
 union all select list_append(ids, te.dst), te.dst, hops + 1 from walk join te on te.src = walk.top where hops < {DEPTH} and not list_contains(list_transform(range(1, len(ids)), lambda i: ids[i] || ids[i + 1]), te.src || te.dst)), {_NAMED}
select array_to_string(ids, '>') as path, n.fqn as acquire, hops from walk join named n on n.id = ids[1] order by acquire, hops, path limit {LEAKS}""")
def leak_paths(spark, d):
    """What is called below every function that acquires a connection; the first thousand."""
    g = _Graph(spark, d)
    acq = R.external_kinds(g.edges, g.external, ["db_acquire"]).select("id").distinct().join(g.functions.select("id").distinct(), "id", "left_semi")
    p = R.leak_paths(acq, g.calls, g.hubs(), DEPTH)
    p = p.join(g.named().select(F.col("id").alias("first"), F.col("fqn").alias("acquire")), F.element_at("ids", 1) == F.col("first"))
    return p.select(F.array_join("ids", ">").alias("path"), "acquire", "hops").orderBy("acquire", "hops", "path").limit(LEAKS)


@query(f"""with recursive {_BASE}, a as (select distinct e.src as id, x.kind from edges e join x on x.node_id = e.dst where e.type = 'CALLS_EXTERNAL' and x.kind in ('db_acquire', 'db_release'))
select id from a where kind = 'db_acquire' and id not in (select id from a where kind = 'db_release') and id in (select id from fi)""")
def unreleased(spark, d):
    """Functions that acquire a connection and release none."""
    g = _Graph(spark, d)
    k = R.external_kinds(g.edges, g.external, ["db_acquire", "db_release"]).select("id", "kind").distinct()
    a, r = k.filter("kind = 'db_acquire'").select("id"), k.filter("kind = 'db_release'").select("id")
    return a.join(r, "id", "left_anti").join(g.functions.select("id").distinct(), "id", "left_semi")


# findings: each scored path into a sink of one kind

_IMPACT = {"exposure": ["db_execute", "exec", "deserialize", "response"], "integrity": ["file_write", "db_other"], "correctness": ["reflection"]}
_CERT = "case when score >= 0.7 then 'demonstrated' when score >= 0.5 then 'probable' else 'speculative' end"
_IMP = "case " + " ".join(f"when kind in ({_list(v)}) then '{k}'" for k, v in _IMPACT.items()) + " end"
_SEV = "case " + " ".join(f"when certainty = '{c}' and impact = '{i}' then '{s}'" for c, by in V.SEVERITY.items() for i, s in by.items()) + " else 'none' end"
_FOUND = f"""{_SCORED}, raw as (select p.ids, p.hops, p.score, k.kind, p.has_sanitizer, e.fqn as entry, s.fqn as sink, s.repo, s.file, coalesce(s.start_line, 0) as line, {_CERT} as certainty, {_IMP} as impact,
 substr(sha1(k.kind || chr(0) || coalesce(s.fqn, s.file, '') || chr(0) || coalesce(s.body_hash, '')), 1, 16) as fingerprint
 from score p join direct k on k.id = p.ids[-1] join named e on e.id = p.ids[1] join named s on s.id = p.ids[-1]),
found as (select *, {_SEV} as severity from raw),
ranked as (select *, row_number() over (partition by fingerprint order by hops, array_to_string(ids, '>')) as n, count(*) over (partition by fingerprint) as paths from found),
entries as (select fingerprint, count(distinct entry) as reach from found group by fingerprint),
kept as (select r.*, e.reach from ranked r join entries e on e.fingerprint = r.fingerprint where n = 1)"""


def _certainty(score: Column) -> Column:
    return F.when(score >= 0.7, "demonstrated").when(score >= 0.5, "probable").otherwise("speculative")


def _findings(g: _Graph) -> DataFrame:
    impact = None
    for k, v in _IMPACT.items():
        impact = F.when(F.col("kind").isin(v), k) if impact is None else impact.when(F.col("kind").isin(v), k)
    p = _scored(g).withColumn("first", F.element_at("ids", 1)).withColumn("id", F.element_at("ids", -1)).join(g.direct().select("id", "kind").distinct(), "id")
    n = g.named()
    p = p.join(n.select(F.col("id").alias("first"), F.col("fqn").alias("entry")), "first").join(n.select("id", F.col("fqn").alias("sink"), "repo", "file", F.coalesce("start_line", F.lit(0)).alias("line"), "body_hash"), "id")
    p = p.withColumns({"certainty": _certainty(F.col("score")), "impact": impact})
    return p.withColumns({"severity": V.severity(F.col("certainty"), F.col("impact")), "fingerprint": X.finding_id(F.col("kind"), F.coalesce("sink", "file"), F.col("body_hash")), "path_ids": F.col("ids")})


@query(f"with recursive {_FOUND} select kind, certainty, impact, severity, count(*) as n from found group by 1, 2, 3, 4")
def severity_matrix(spark, d):
    return _findings(_Graph(spark, d)).groupBy("kind", "certainty", "impact", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {_FOUND} select fingerprint, array_to_string(ids, '>') as path, entry, reach as reachable_from_count, paths - 1 as duplicate_paths from kept")
def findings_dedupe(spark, d):
    """One row per defect, with its shortest path."""
    f = V.dedupe(_findings(_Graph(spark, d)))
    return f.select("fingerprint", F.array_join("path_ids", ">").alias("path"), "entry", F.col("reachable_from_count").cast("long").alias("reachable_from_count"), "duplicate_paths")


@query(f"""with recursive {_FOUND} select fingerprint, severity, reach, hops, file, line from kept where severity <> 'none'
order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, reach desc, hops, file, line, fingerprint limit 100""")
def findings_rank(spark, d):
    """The hundred defects to look at first: by severity, reach, length of the path, place."""
    f = V.dedupe(_findings(_Graph(spark, d))).filter("severity <> 'none'")
    f = f.select("fingerprint", "severity", F.col("reachable_from_count").cast("long").alias("reach"), F.col("hops"), "file", "line")
    return f.orderBy(V.severity_rank(F.col("severity")), F.desc("reach"), "hops", "file", "line", "fingerprint").limit(100)


@query(f"with recursive {_FOUND} select severity, kind, count(*) as n, sum(paths) as n_paths from kept group by severity, kind")
def findings_counts(spark, d):
    """Defects and their paths by severity and kind."""
    f = V.dedupe(_findings(_Graph(spark, d)))
    return f.groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("duplicate_paths") + 1).alias("n_paths"))


@query(f"""with recursive {_FOUND}, old as (select repo, fingerprint, body_hash from (select distinct repo, fingerprint, (select min(body_hash) from named n where n.fqn = kept.sink) as body_hash from kept) where fingerprint < '8')
select k.repo, count(*) as n_all, count(*) filter (where o.repo is null) as n_kept from kept k left join (select distinct repo, fingerprint from old) o on o.repo = k.repo and o.fingerprint = k.fingerprint where k.repo is not null group by k.repo""")
def dismissals_split(spark, d):
    """What an earlier review dismissed (here: the lower half of the fingerprints) isn't reported
    again; the fingerprint holds the body's hash, so a changed body comes back."""
    f = V.dedupe(_findings(_Graph(spark, d))).filter("repo is not null")
    kept, out = V.split_dismissed(f, f.filter("fingerprint < '8'").select("repo", "fingerprint"))
    a, b = kept.groupBy("repo").agg(F.count(F.lit(1)).alias("k")), out.groupBy("repo").agg(F.count(F.lit(1)).alias("o"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "repo", "full_outer").select("repo", (z("k") + z("o")).alias("n_all"), z("k").alias("n_kept"))


@query(f"""with recursive {_FOUND}, v as (select fingerprint as finding, unnest([case when has_sanitizer then true else false end, case when score < 0.5 then true else false end, case when hops > 6 then true when hops = 0 then null else false end]) as refuted from kept)
select finding, count(refuted) as votes, count(*) filter (where refuted) as refuted, case when count(refuted) = 0 then 'unverified' when 2 * count(*) filter (where refuted) >= count(refuted) then 'killed' else 'kept' end as outcome from v group by finding""")
def votes_tally(spark, d):
    """A panel of three views on each defect (sanitized, unlikely, too far) and its outcome: the
    majority refutes, ties kill, no vote leaves it unverified. A view without an opinion doesn't vote."""
    f = V.dedupe(_findings(_Graph(spark, d)))
    views = F.array(F.col("has_sanitizer"), F.col("score") < 0.5, F.when(F.col("hops") > 6, True).when(F.col("hops") == 0, F.lit(None).cast("boolean")).otherwise(False))
    return V.tally(f.select(F.col("fingerprint").alias("finding"), F.explode(views).alias("refuted")))


@query(f"""with recursive {_FOUND}, s as (select fingerprint, sink, score, hops, row_number() over (partition by sink order by score desc, hops, fingerprint) as n from kept)
select sink, fingerprint, score from s where n = 1""")
def best_per_sink(spark, d):
    """Per sink the defect with the best evidence."""
    f = V.dedupe(_findings(_Graph(spark, d)))
    best = F.min_by(F.struct("fingerprint", "score"), F.struct((-F.col("score")).alias("a"), "hops", "fingerprint")).alias("b")
    return f.groupBy("sink").agg(best).select("sink", "b.fingerprint", "b.score")


@query(f"""with recursive {_FOUND}, sinks as (select distinct id from direct), on_path as (select distinct ids[-1] as id from paths), kept_at as (select distinct ids[-1] as id from kept where severity <> 'none'),
stage as (select s.id, case when s.id not in (select id from ups) then 'unreached' when s.id not in (select id from downs) and s.id not in (select id from on_path) then 'no entry' when s.id not in (select id from on_path) then 'no path' when s.id not in (select id from kept_at) then 'no severity' else 'reported' end as stage from sinks s)
select stage, count(*) as n_sinks from stage group by stage""")
def stage_trace(spark, d):
    """Where the way of each dangerous function into the report ended."""
    g = _Graph(spark, d)
    mark = lambda df, c, name: df.select(c.alias("id")).distinct().withColumn(name, F.lit(True))
    f = V.dedupe(_findings(g))
    last = F.element_at("ids", -1)
    s = g.direct().select("id").distinct().join(mark(g.from_entry(), F.col("id"), "entered"), "id", "left").join(mark(g.paths(), last, "path"), "id", "left").join(mark(f.filter("severity <> 'none'"), last, "kept"), "id", "left")
    stage = F.when(F.col("entered").isNull() & F.col("path").isNull(), "no entry").when(F.col("path").isNull(), "no path").when(F.col("kept").isNull(), "no severity").otherwise("reported")
    return s.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n_sinks"))
