"""References that are only names resolved to nodes: tiers of candidates, the first that has any wins.

Every tier is an equi-join that gives (ref_id, cand, tier); their union is reduced to the smallest
tier of each reference, narrowed by arity and counted. Only the last tier, by name alone, could grow
with the number of equal names; it is joined for names within the cap, and counted for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.session import Scratch

CAP = 5
#: Edge types that are not kept, and annotations that say nothing.
DROPPED = "RETURNS HAS_TYPE HAS_GENERIC THROWS CATCHES REFERENCES BELONGS_TO RE_EXPORTS EMITS_EVENT CONSUMES_EVENT REQUIRES_AUTH ENFORCES_POLICY IMPORTS".split()
TYPE_REFS = "EXTENDS IMPLEMENTS INSTANTIATES AUTOWIRED".split()
#: Strategies of calls by tier.
CALL_TIERS = """same_scope same_file imports_qualified_exact imports_qualified imports receiver_type_hint receiver_type_hint_inherited
receiver_type receiver_type_inherited receiver_type receiver_type_inherited name""".split()
TYPE_TIERS = "unique same_file imports_qualified_exact imports_qualified same_package imports_wildcard imports name".split()
OWN = ("self", "cls")

REFS = """ref_id string, type string, src string, target_name string, kind_hint string, recv string, recv_type string, import_fqn string,
http_method string, ref_file string, ref_line int, ref_col int, call_arity int"""


def tail(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def class_package(fqn: Column, name: Column) -> Column:
    """What stands before ``.name``; nothing for a method written with ``#``."""
    return F.when(F.endswith(fqn, F.concat(F.lit("."), name)), F.substring(fqn, F.lit(1), F.length(fqn) - F.length(name) - 1)).otherwise(F.lit(""))


class Names:
    """The nodes by name, and what each file imports."""

    def __init__(self, nodes: DataFrame, contains: DataFrame, refs: DataFrame, links: DataFrame | None = None):
        n = nodes.select("id", "label", "name", "fqn", "file", "package", "param_count").dropna(subset=["id"]).dropDuplicates(["id"])
        self.nodes = n
        self.named = n.filter(F.col("label").isin("Class", "Function") & F.col("name").isNotNull()).withColumn("owner", class_package(F.col("fqn"), F.col("name")))
        self.classes = self.named.filter("label = 'Class'")
        self.parent = contains.select(F.col("src").alias("parent"), F.col("dst").alias("id")).dropna().dropDuplicates(["id"])
        kids = contains.select(F.col("src").alias("class_id"), F.col("dst").alias("id")).dropna().distinct()
        self.members = kids.join(n.select("id", "label", "name", "param_count"), "id").filter("label in ('Function', 'Field')").join(self.classes.select(F.col("id").alias("class_id")), "class_id", "left_semi")
        imports = refs.filter((F.col("type") == "IMPORTS") & F.col("ref_file").isNotNull())
        plain = imports.filter("coalesce(kind_hint, '') <> 'import_wildcard'")
        self.wildcards = imports.filter("kind_hint = 'import_wildcard' and import_fqn is not null").select(F.col("ref_file").alias("file"), F.col("import_fqn").alias("pkg")).distinct()
        self.imported = plain.filter("target_name is not null").select(F.col("ref_file").alias("file"), tail(F.col("target_name")).alias("name")).distinct()
        self.import_fqns = plain.filter("import_fqn is not null").select(F.col("ref_file").alias("file"), "import_fqn").distinct()
        self.packages = n.filter("label = 'File' and file is not null and coalesce(package, '') <> ''").select("file", "package").distinct()
        self.links = links
        self.scratch = Scratch(nodes.sparkSession, "resolve")
        self._ancestors: DataFrame | None = None
        # what nearly every tier joins is cut off here, so that the tiers' plans stay small
        self.nodes, self.named, self.members, self.parent = (self.scratch.write(t, k)[0] for t, k in ((self.nodes, "nodes"), (self.named, "named"), (self.members, "members"), (self.parent, "parent")))
        self.classes = self.named.filter("label = 'Class'")

    def _segments(self, pool: DataFrame) -> DataFrame:
        """(key, file, cand): candidates one of whose segments but the first is the tail of an import of the file."""
        seg = pool.select("key", "file", "cand", F.explode(F.slice(F.split("fqn", "[.]"), 2, 1000)).alias("seg"))
        tails = self.import_fqns.select("file", tail(F.col("import_fqn")).alias("seg")).filter("seg <> ''").distinct()
        return seg.join(tails, ["file", "seg"]).select("key", "file", "cand").distinct()

    def narrow_classes(self, wanted: DataFrame) -> DataFrame:
        """(name, file, cand, tier) of the classes visible from a file under a name. ``wanted``: name, file."""
        w = wanted.select("name", "file").distinct()
        c = self.classes.select("name", F.col("id").alias("cand"), "fqn", F.col("file").alias("c_file"), "owner")
        pool = w.join(c, "name").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("name", "file")))
        one, many = pool.filter("n = 1"), pool.filter("n > 1").withColumn("key", F.col("name"))
        at = lambda df, t: df.select("name", "file", "cand", F.lit(t).alias("tier"))
        tiers = [at(one, 0), at(many.filter("c_file = file"), 1)]
        tiers.append(at(many.join(self.import_fqns, "file").filter("fqn = import_fqn"), 2))
        tiers.append(at(self._segments(many).withColumnRenamed("key", "name"), 3))
        tiers.append(at(many.join(self.packages, "file").filter("owner = package"), 4))
        tiers.append(at(many.join(self.wildcards, "file").filter("owner = pkg"), 5))
        tiers.append(at(many.join(self.imported, ["file", "name"]), 6))
        tiers.append(at(many, 7))
        return _first(_union(tiers), ["name", "file"])

    def ancestors(self) -> DataFrame:
        """(class_id, ancestor, depth), nearest first, over the known hierarchy."""
        if self.links is None:
            return self.classes.select(F.col("id").alias("class_id"), F.col("id").alias("ancestor"), F.lit(0).alias("depth")).limit(0)
        if self._ancestors is None:
            up = G.ancestors(self.links.select(F.col("src").alias("child"), F.col("dst").alias("parent")))
            self._ancestors = up.select(F.col("id").alias("class_id"), "ancestor", "depth")
        return self._ancestors

    def member_tiers(self, at: DataFrame, own: int) -> list[DataFrame]:
        """Candidates of references at classes (ref_id, target_name, class_id): own members, then those
        of the nearest ancestor that has any."""
        m = self.members.filter("label = 'Function'").select("class_id", F.col("name").alias("target_name"), F.col("id").alias("cand"))
        direct = at.join(m, ["class_id", "target_name"]).select("ref_id", "cand", F.lit(own).alias("tier"))
        up = at.join(self.ancestors(), "class_id").select("ref_id", "target_name", F.col("ancestor").alias("class_id"), "depth").join(m, ["class_id", "target_name"])
        near = up.withColumn("best", F.min("depth").over(W.partitionBy("ref_id"))).filter("depth = best").select("ref_id", "cand", F.lit(own + 1).alias("tier"))
        return [direct, near]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _first(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Only the smallest tier of each key, its candidates once."""
    return cands.distinct().withColumn("best", F.min("tier").over(W.partitionBy(*keys))).filter("tier = best").drop("best")


def calls(refs: DataFrame, names: Names) -> DataFrame:
    """(ref_id, cand, strategy, n_pool) of CALLS; cand is null where there is none, or too many by name."""
    src = names.nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    known = names.classes.select(F.col("name").alias("recv_type")).distinct().withColumn("known", F.lit(True))
    r = refs.filter("type = 'CALLS'").join(src, "src", "left").join(known, "recv_type", "left")
    outside = (F.coalesce("recv_type", F.lit("")) != "") & F.col("known").isNull()
    external = r.filter(outside).select("ref_id", F.lit(None).cast("string").alias("cand"), F.lit("external_receiver").alias("strategy"), F.lit(0).cast("long").alias("n_pool"))
    r = r.filter(~outside).drop("known")
    has_fn = names.named.groupBy("name").agg(F.count_if(F.col("label") == "Function").alias("fns"), F.count(F.lit(1)).alias("all"))
    sizes = has_fn.select(F.col("name").alias("target_name"), F.when(F.col("fns") > 0, F.col("fns")).otherwise(F.col("all")).alias("n_pool"), (F.col("fns") > 0).alias("only_fn"))
    r = names.scratch.write(r.join(sizes, "target_name", "left"), "calls")[0]
    pool = names.named.select(F.col("name").alias("target_name"), F.col("id").alias("cand"), "label", "fqn", F.col("file").alias("c_file"), "owner")
    fits = ~F.col("only_fn") | (F.col("label") == "Function")
    parents = names.parent.select(F.col("id").alias("src"), F.col("parent").alias("scope"))
    sibling = names.parent.select(F.col("id").alias("cand"), F.col("parent").alias("scope"))
    hit = lambda df, t: df.select("ref_id", "cand", F.lit(t).alias("tier"))
    tiers = [hit(r.join(parents, "src").join(pool.join(sibling, "cand"), ["target_name", "scope"]).filter(fits), 0)]
    tiers.append(hit(r.join(pool, (r["target_name"] == pool["target_name"]) & (r["src_file"] == pool["c_file"])).drop(pool["target_name"]).filter(fits), 1))
    placed = r.filter("src_file is not null")
    # imports: from the file's side, so that a hot name meets only what the file imports
    by_import = placed.join(names.import_fqns.withColumnRenamed("file", "src_file"), "src_file").join(pool.withColumnRenamed("owner", "import_fqn"), ["target_name", "import_fqn"]).filter(fits)
    tiers.append(hit(by_import, 2))
    tails = names.import_fqns.select(F.col("file").alias("src_file"), tail(F.col("import_fqn")).alias("seg")).filter("seg <> ''").distinct()
    segs = pool.withColumn("seg", F.explode(F.array_distinct(F.slice(F.split("fqn", "[.]"), 2, 1000))))
    tiers.append(hit(placed.join(tails, "src_file").join(segs, ["target_name", "seg"]).filter(fits), 3))
    seen = names.imported.select(F.col("file").alias("src_file"), F.col("name").alias("seen"))
    by_name = placed.join(seen, "src_file").join(pool, "target_name").filter(fits & ((F.col("target_name") == F.col("seen")) | (tail(F.col("fqn")) == F.col("seen"))))
    tiers.append(hit(by_name, 4))
    for at, col in ((5, "recv_type"), (9, "recv")):
        typed = r.filter((F.coalesce(col, F.lit("")) != "") & ~F.col(col).isin(*OWN) & (F.col("n_pool").isNotNull()))
        narrowed = names.scratch.write(names.narrow_classes(typed.select(F.col(col).alias("name"), F.coalesce("src_file", F.lit("")).alias("file"))), "classes")[0]
        keyed = typed.withColumn("name", F.col(col)).withColumn("file", F.coalesce("src_file", F.lit("")))
        tiers += names.member_tiers(keyed.join(narrowed.select("name", "file", F.col("cand").alias("class_id")), ["name", "file"]).select("ref_id", "target_name", "class_id"), at)
    own = r.filter(F.col("recv").isin(*OWN)).join(enclosing(names).withColumnRenamed("id", "src"), "src").select("ref_id", "target_name", "class_id")
    tiers += names.member_tiers(own, 7)
    tiers.append(hit(r.filter(F.col("n_pool") <= CAP).join(pool, "target_name").filter(fits), 11))
    best = names.scratch.write(_arity(_first(_union(tiers), ["ref_id"]), r, names), "best")[0]
    strategy = F.element_at(F.array(*[F.lit(s) for s in CALL_TIERS]), F.col("tier") + 1)
    found = best.select("ref_id", "cand", F.concat(strategy, F.when(F.col("narrowed"), "+arity").otherwise("")).alias("strategy"))
    rest = r.join(found.select("ref_id").distinct(), "ref_id", "left_anti").select("ref_id", F.lit(None).cast("string").alias("cand"), F.when(F.col("n_pool").isNull(), "none").otherwise("name").alias("strategy"), F.coalesce("n_pool", F.lit(0)).alias("n_pool"))
    return found.join(r.select("ref_id", "n_pool"), "ref_id").unionByName(rest).unionByName(external)


def enclosing(names: Names) -> DataFrame:
    """(id, class_id): the nearest class around each node, itself included; a climb over CONTAINS."""
    p = names.parent
    is_class = names.classes.select(F.col("id").alias("at"), F.lit(True).alias("is_class"))
    level = p.select("id", F.col("parent").alias("at")).unionByName(names.classes.select("id", F.col("id").alias("at")))
    out = None
    for _ in range(8):  # classes, functions and lambdas are nested no deeper in any language here
        j = level.join(is_class, "at", "left")
        done = j.filter("is_class").select("id", F.col("at").alias("class_id"))
        out = done if out is None else out.unionByName(done)
        level = j.filter("is_class is null").select("id", "at").join(p.select(F.col("id").alias("at"), "parent"), "at").select("id", F.col("parent").alias("at"))
    return out.dropDuplicates(["id"])


def _arity(best: DataFrame, refs: DataFrame, names: Names) -> DataFrame:
    """Where a candidate has the call's number of arguments, only such candidates."""
    j = best.join(refs.select("ref_id", F.coalesce("call_arity", F.lit(-1)).alias("arity")), "ref_id").join(names.nodes.select(F.col("id").alias("cand"), "param_count"), "cand", "left")
    j = j.withColumn("same", F.coalesce((F.col("arity") >= 0) & (F.col("param_count") == F.col("arity")), F.lit(False)))
    j = j.withColumn("narrowed", F.max("same").over(W.partitionBy("ref_id")))
    return j.filter("same or not narrowed").select("ref_id", "cand", "tier", "narrowed")


def types(refs: DataFrame, names: Names) -> DataFrame:
    """(ref_id, cand, strategy, n_pool) of references to types."""
    src = names.nodes.select(F.col("id").alias("src"), F.coalesce("file", F.lit("")).alias("file"))
    r = refs.filter(F.col("type").isin(TYPE_REFS)).join(src, "src", "left").withColumn("file", F.coalesce("file", F.lit(""))).withColumn("name", tail(F.col("target_name")))
    sizes = names.classes.groupBy("name").agg(F.count(F.lit(1)).alias("n_pool"))
    c = names.narrow_classes(r.select("name", "file"))
    strategy = F.element_at(F.array(*[F.lit(s) for s in TYPE_TIERS]), F.col("tier") + 1)
    j = r.select("ref_id", "name", "file").join(c, ["name", "file"], "left").join(sizes, "name", "left")
    return j.select("ref_id", "cand", F.coalesce(strategy, F.lit("none")).alias("strategy"), F.coalesce("n_pool", F.lit(0)).alias("n_pool"))


def accesses(refs: DataFrame, names: Names) -> DataFrame:
    """(ref_id, cand, strategy, n_pool) of READS and WRITES: a field of the class around, else a global of the file."""
    r = refs.filter("type in ('READS', 'WRITES')")
    f = names.members.filter("label = 'Field'").select("class_id", F.col("name").alias("target_name"), F.col("id").alias("cand"))
    own = r.join(enclosing(names).withColumnRenamed("id", "src"), "src").join(f, ["class_id", "target_name"]).select("ref_id", "cand", F.lit(0).alias("tier"))
    src = names.nodes.select(F.col("id").alias("src"), "file")
    g = names.nodes.filter("label = 'Field'").select(F.col("id").alias("cand"), F.col("name").alias("target_name"), "file").join(names.members.select(F.col("id").alias("cand")), "cand", "left_anti")
    glob = r.join(src, "src").join(g, ["file", "target_name"]).select("ref_id", "cand", F.lit(1).alias("tier"))
    best = _first(own.unionByName(glob), ["ref_id"])
    j = r.select("ref_id").join(best, "ref_id", "left")
    return j.select("ref_id", "cand", F.when(F.col("tier") == 0, "same_scope").otherwise("same_file_global").alias("strategy"), F.when(F.col("cand").isNull(), 0).otherwise(1).cast("long").alias("n_pool"))


def others(refs: DataFrame, names: Names) -> DataFrame:
    """Anything else by name and hinted kind; if nothing of the kind has the name, by name alone."""
    handled = ["CALLS", *TYPE_REFS, "READS", "WRITES", "ANNOTATED_WITH", "CALLS_API", "RENDERS", "HANDLED_BY", *DROPPED]
    r = refs.filter(~F.col("type").isin(handled))
    label = F.when(F.col("kind_hint").isin("type", "import"), "Class").when(F.col("kind_hint") == "call", "Function")
    sizes = names.named.groupBy(F.col("name").alias("target_name")).agg(F.count(F.lit(1)).alias("n_pool"))
    c = r.withColumn("want", label).join(names.named.select(F.col("name").alias("target_name"), F.col("id").alias("cand"), "label"), "target_name")
    c = c.select("ref_id", "cand", F.when(F.col("want").isNull() | (F.col("want") == F.col("label")), 0).otherwise(1).alias("tier"))
    j = r.select("ref_id", "target_name").join(_first(c, ["ref_id"]), "ref_id", "left").join(sizes, "target_name", "left")
    return j.select("ref_id", "cand", F.lit("kind_hint").alias("strategy"), F.coalesce("n_pool", F.lit(0)).alias("n_pool"))


def resolve(refs: DataFrame, nodes: DataFrame, contains: DataFrame, links: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """One row per reference and target: (ref_id, src, type, dst, strategy, confidence, outcome).

    ``refs`` as in ``REFS``, ref_id unique; ``nodes``: id, label, name, fqn, file, package, param_count;
    ``contains`` and ``links`` (EXTENDS and IMPLEMENTS): src, dst. Outcome is resolved, ambiguous,
    unresolved (the name exists, but nothing pins it, or it is too common) or external (no such name);
    dst is null for the last two. A call found by name only on a receiver of unknown type becomes
    REFERENCES; so does a dotted name found by its tail. Dropped types give no row. Null names match
    nothing. An empty input gives an empty result.
    """
    names = Names(nodes, contains, refs, links)
    r = refs.filter(~F.col("type").isin(DROPPED) & (F.col("type") != "ANNOTATED_WITH"))
    found = names.scratch.write(_union([calls(r, names), types(r, names), accesses(r, names), others(r, names)]), "found")[0]
    base = r.select("ref_id", "src", "type", "recv", "target_name")
    # a dotted name that nothing has, by its tail
    lost = found.filter("cand is null and n_pool = 0 and strategy = 'none'").select("ref_id").join(base.filter("type = 'CALLS' and target_name like '%.%'"), "ref_id")
    byname = names.named.select(F.col("name").alias("t"), F.col("id").alias("cand"), F.when(F.col("label") == "Function", 0).otherwise(1).alias("tier"))
    back = _first(lost.join(byname, tail(F.col("target_name")) == F.col("t")).select("ref_id", "cand", "tier"), ["ref_id"]).select("ref_id", "cand", F.lit("none+fallback_tail").alias("strategy"), F.lit(1).cast("long").alias("n_pool"), F.lit(True).alias("again"))
    found = found.withColumn("again", F.lit(False)).unionByName(back)
    n = found.withColumn("n", F.count("cand").over(W.partitionBy("ref_id", "again"))).join(base, "ref_id")
    by_name = F.startswith("strategy", F.lit("name"))
    demoted = (F.col("type") == "CALLS") & by_name & (F.coalesce("recv", F.lit("")) != "") & ~F.col("recv").isin(*OWN) & (F.col("n_pool") > 0)
    many = by_name & (F.greatest("n", F.when(F.col("cand").isNull(), F.col("n_pool")).otherwise(0)) > cap) if cap else F.lit(False)
    outcome = F.when(F.col("strategy") == "external_receiver", "external").when(many, "unresolved").when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("n_pool") > 0, "unresolved").otherwise("external")
    sure = F.when((F.col("type").isin(TYPE_REFS) & ~F.col("strategy").isin("name", "none")) | F.col("type").isin("READS", "WRITES"), "EXTRACTED").otherwise("INFERRED")
    out = n.select(
        "ref_id", "src", F.when(demoted | F.col("again"), "REFERENCES").otherwise(F.col("type")).alias("type"), F.when(many, F.lit(None)).otherwise(F.col("cand")).alias("dst"),
        F.when(demoted, F.concat("strategy", F.lit("+unknown_recv"))).otherwise(F.col("strategy")).alias("strategy"), F.when(outcome == "ambiguous", "AMBIGUOUS").when(outcome == "resolved", sure).alias("confidence"), outcome.alias("outcome"),
    )
    return out.distinct()


def coverage(resolved: DataFrame) -> DataFrame:
    """References per final type and outcome."""
    return resolved.select("ref_id", "type", "outcome").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("resolved", "ambiguous", "unresolved", "external")])


def match_endpoints(calls_: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(ref_id, endpoint, tier) of outbound calls: the same verb and route; else any verb on either
    side; else a template of the same verb with as many segments, ``*`` standing for one.
    ``calls_``: ref_id, method, route; ``endpoints``: id, method, route; verbs in upper case."""
    e = endpoints.select(F.col("id").alias("endpoint"), F.col("method").alias("e_method"), F.col("route").alias("e_route")).distinct()
    c = calls_.select("ref_id", "method", "route")
    same = c.join(e, c["route"] == e["e_route"])
    exact = same.filter("method = e_method").select("ref_id", "endpoint", F.lit(0).alias("tier"))
    any_ = same.filter("method = 'ANY' or e_method = 'ANY'").select("ref_id", "endpoint", F.lit(1).alias("tier"))
    parts = lambda x: F.filter(F.split(x, "/"), lambda s: s != "")
    t = e.filter(F.contains("e_route", F.lit("*"))).select("endpoint", F.col("e_method").alias("method"), parts(F.col("e_route")).alias("template"), F.size(parts(F.col("e_route"))).alias("n"))
    d = c.withColumn("segments", parts(F.col("route"))).withColumn("n", F.size("segments"))
    fits = d.join(t, ["method", "n"]).filter(F.forall(F.zip_with("template", "segments", lambda a, b: (a == "*") | (a == b)), lambda x: x))
    return _first(_union([exact, any_, fits.select("ref_id", "endpoint", F.lit(2).alias("tier"))]), ["ref_id"])


def match_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, file_id, same_dir): files with the referred basename, those of the referring file's
    folder only if there are several. ``refs``: ref_id, basename, ref_file; ``files``: id, file."""
    folder = lambda p: F.regexp_replace(p, "[^/]*$", "")
    f = files.select(F.col("id").alias("file_id"), F.substring_index("file", "/", -1).alias("basename"), folder(F.col("file")).alias("dir"))
    j = refs.select("ref_id", "basename", folder(F.col("ref_file")).alias("from")).join(f, "basename").withColumn("same_dir", F.col("dir") == F.col("from"))
    w = W.partitionBy("ref_id")
    j = j.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("near", F.max("same_dir").over(w))
    return j.filter("n = 1 or same_dir or not near").select("ref_id", "file_id", "same_dir")
