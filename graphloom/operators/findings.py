"""Severity, signals, contract joins, findings and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import trusted

#: Severity by certainty and impact, and the order of severities.
SEVERITY = {
    "demonstrated": {"exposure": "critical", "integrity": "high", "correctness": "high", "quality": "low"},
    "probable": {"exposure": "high", "integrity": "medium", "correctness": "medium", "quality": "low"},
    "speculative": {"exposure": "medium", "integrity": "low", "correctness": "low", "quality": "low"},
}
SEVERITIES = ("critical", "high", "medium", "low", "none")
#: Weights of what a function does.
WEIGHTS = {"sql_dynamic": 3.0, "acquires": 2.0, "exec": 3.0, "deserialize": 3.0, "reflection": 2.0, "file": 1.5, "untrusted": 2.0, "auth": 1.0}
IMPORTANT = 3.0
#: Kinds of findings in a single body that can be high; others are medium at most.
HIGH_KINDS = ("resource_leak", "concurrency", "correctness")


def severity(certainty: Column, impact: Column) -> Column:
    """Unknown or missing values give 'none'."""
    out = F.lit("none")
    for c, by in SEVERITY.items():
        for i, s in by.items():
            out = F.when((F.lower(certainty) == c) & (F.lower(impact) == i), F.lit(s)).otherwise(out)
    return out


def severity_rank(s: Column) -> Column:
    out = F.lit(len(SEVERITIES) - 1)
    for i, name in enumerate(SEVERITIES[:-1]):
        out = F.when(F.lower(s) == name, F.lit(i)).otherwise(out)
    return out


def leak(acquires: Column, in_finally: Column, n_leaked: Column) -> Column:
    no = F.lit(False)
    return F.coalesce(acquires, no) & (~F.coalesce(in_finally, no) | (F.coalesce(n_leaked, F.lit(0)) > 0))


def bare_names(names: Column) -> Column:
    """Method names without receiver and parentheses, sorted, each once; null is empty."""
    t = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda v: F.trim(F.substring_index(F.substring_index(v, "(", 1), ".", -1)))
    return F.array_sort(F.array_distinct(F.filter(t, lambda x: x.isNotNull() & (x != ""))))


#: What a function touches that is a risk, and the risk's name.
TOUCH_RISKS = {"exec": "spawns_process", "deserialize": "deserialization", "reflection": "reflection", "file": "writes_filesystem"}


def derive_signals(s: DataFrame) -> DataFrame:
    """Flat signals of function summaries.

    ``s``: id, sql_is_dynamic, acquires, released_in_finally, throws_between, n_leaked,
    reads_untrusted, is_entry_point, authenticates, authorizes, is_sanitizer, may_return_null,
    returns_sentinel, touches, unguarded_calls, swallowed_calls, strong (findings of at least medium
    severity). Nulls count as false, zero or empty. The score is a sum of weights of what the
    function does plus what makes it worse, halved for sanitizers.
    """
    no = F.lit(False)
    b = lambda c: F.coalesce(F.col(c), no)
    touch = lambda t: F.coalesce(F.array_contains("touches", t), no)
    has = [(b("sql_is_dynamic"), "builds_sql_dynamically", "sql_dynamic"), (b("acquires"), "manual_resource_handling", "acquires")]
    has += [(touch(t), r, t) for t, r in TOUCH_RISKS.items()]
    has += [(b("reads_untrusted"), "parses_untrusted_input", "untrusted"), (b("authenticates") | b("authorizes"), "auth_check", "auth")]
    yes = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    leaks = leak(F.col("acquires"), F.col("released_in_finally"), F.col("n_leaked"))
    sure = b("acquires") & ~b("released_in_finally") & b("throws_between")
    score = F.lit(0.0)
    for c, _, w in has:
        score = score + yes(c, WEIGHTS[w])
    score = score + yes(b("sql_is_dynamic"), 2.0) + yes(leaks, 2.0) + yes(sure, 1.0) + yes(b("reads_untrusted"), 1.5) + yes(b("is_entry_point"), 1.0)
    score = score + F.least(F.coalesce("strong", F.lit(0)), F.lit(3)) * 2.0
    score = F.when(b("is_sanitizer"), score * 0.5).otherwise(score)
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r, _ in has])))
    return s.select(
        "id", F.round(score, 2).alias("sig_risk_score"), (score >= IMPORTANT).alias("sig_important"), reasons.alias("sig_reasons"), b("is_entry_point").alias("sig_entry"), b("reads_untrusted").alias("sig_untrusted"),
        b("is_sanitizer").alias("sig_sanitizer"), (b("authenticates") | b("authorizes")).alias("sig_auth"), b("sql_is_dynamic").alias("sig_sql_dynamic"), b("acquires").alias("sig_acquires"),
        leaks.alias("sig_leak"), sure.alias("sig_confirmed_leak"), F.coalesce("strong", F.lit(0)).alias("sig_findings"), b("may_return_null").alias("sig_may_return_null"),
        F.coalesce("returns_sentinel", F.lit("")).alias("sig_returns_sentinel"), bare_names(F.col("unguarded_calls")).alias("sig_unguarded_calls"), bare_names(F.col("swallowed_calls")).alias("sig_swallowed_calls"),
        b("released_in_finally").alias("sig_released_in_finally"),
    )


def mismatches(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Contracts that caller and callee don't agree on: (kind, caller_id, callee_id, file, line,
    strategy), over trusted calls only.

    ``functions``: id, name, file, start_line and the signals. Four kinds at once, by one join of
    callees and callers: a null that may come back to a caller that doesn't check that name, a
    sentinel likewise, a failure swallowed by the caller, and a resource that neither end surely
    releases. Nulls count as false or empty. ``calls``: src, dst, strategy, line.
    """
    no, none = F.lit(False), F.array().cast("array<string>")
    a = functions.select(F.col("id").alias("src"), "file", "start_line", F.coalesce("sig_unguarded_calls", none).alias("unguarded"), F.coalesce("sig_swallowed_calls", none).alias("swallowed"), F.coalesce("sig_released_in_finally", no).alias("caller_releases"))
    b = functions.select(F.col("id").alias("dst"), F.col("name").alias("callee"), F.coalesce("sig_may_return_null", no).alias("null"), F.coalesce("sig_returns_sentinel", F.lit("")).alias("sentinel"), F.coalesce("sig_acquires", no).alias("acquires"), F.coalesce("sig_released_in_finally", no).alias("callee_releases"))
    j = calls.filter(trusted(F.col("strategy"))).join(b, "dst").join(a, "src")
    unchecked, swallowed = F.array_contains("unguarded", F.col("callee")), F.array_contains("swallowed", F.col("callee"))
    kinds = F.array_compact(F.array(
        F.when(F.col("null") & unchecked, "null_dereference"), F.when((F.col("sentinel") != "") & unchecked, "correctness"), F.when(swallowed, "error_handling"),
        F.when(F.col("acquires") & ~F.col("callee_releases") & ~F.col("caller_releases"), "resource_leak"),
    ))
    return j.select(F.explode(kinds).alias("kind"), F.col("src").alias("caller_id"), F.col("dst").alias("callee_id"), "file", F.coalesce("line", "start_line").alias("line"), "strategy")


def unknown_callees(claimed: DataFrame, called: DataFrame) -> DataFrame:
    """(id, n_claimed, n_unknown): names a summary says its function calls, and those among them the
    function calls nothing of. ``claimed``: id, names; ``called``: id, name."""
    c = claimed.select("id", F.explode(bare_names(F.col("names"))).alias("name"))
    k = called.select("id", "name", F.lit(True).alias("known")).distinct()
    j = c.join(k, ["id", "name"], "left")
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("n_claimed"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


def kind_severity(kind: Column, confidence: Column) -> Column:
    """The lower of what the kind allows at most and what the confidence gives."""
    levels = F.array(F.lit("high"), F.lit("medium"), F.lit("low"))
    top = F.lit(1)
    for k in HIGH_KINDS:
        top = F.when(kind == k, 0).otherwise(top)
    sure = F.when(F.lower(confidence) == "high", 0).when(F.lower(confidence) == "medium", 1).otherwise(2)
    return F.element_at(levels, F.greatest(top, sure) + 1)


def dedupe(findings: DataFrame) -> DataFrame:
    """One row per fingerprint, that of the shortest path (ties: smallest ids, entry, file, line);
    all other entries are counted, and the first 20 of them listed."""
    rest = [c for c in findings.columns if c != "fingerprint"]
    best = F.min_by(F.struct(*rest), F.struct(F.size("path_ids"), F.col("path_ids"), F.col("entry"), F.col("file"), F.col("line")))
    g = findings.groupBy("fingerprint").agg(best.alias("p"), F.count(F.lit(1)).alias("n"))
    e = findings.select("fingerprint", "entry").filter("entry <> ''").distinct()
    n = e.groupBy("fingerprint").agg(F.count(F.lit(1)).cast("int").alias("reachable_from_count"))
    first = e.withColumn("at", F.row_number().over(W.partitionBy("fingerprint").orderBy("entry"))).filter("at <= 21")
    first = first.groupBy("fingerprint").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    g = g.join(n, "fingerprint", "left").join(first, "fingerprint", "left")
    others = F.filter(F.coalesce("entries", F.array().cast("array<string>")), lambda x: ~x.eqNullSafe(F.col("p.entry")))
    return g.select("fingerprint", "p.*", F.coalesce("reachable_from_count", F.lit(0)).alias("reachable_from_count"), F.slice(others, 1, 20).alias("also_reachable_from"), (F.col("n") - 1).alias("duplicate_paths"))


def split_dismissed(findings: DataFrame, dismissals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) by (repo, fingerprint)."""
    d = dismissals.select("repo", "fingerprint").distinct()
    return findings.join(d, ["repo", "fingerprint"], "left_anti"), findings.join(d, ["repo", "fingerprint"], "left_semi")


def tally(votes: DataFrame) -> DataFrame:
    """(finding, votes, refuted, outcome): a majority of refutations or a tie kills; no votes at
    all (a null vote) leave it unverified."""
    g = votes.groupBy("finding").agg(F.count("refuted").alias("votes"), F.count_if(F.col("refuted")).alias("refuted"))
    return g.withColumn("outcome", F.when(F.col("votes") == 0, "unverified").when(F.col("refuted") * 2 >= F.col("votes"), "killed").otherwise("kept"))


def confusion(rows: DataFrame, truth: str, found: str, by: str) -> DataFrame:
    """True and false positives and negatives per group and in total (group null), with precision,
    recall and F1; null where undefined."""
    t, f = F.col(truth), F.col(found)
    g = rows.rollup(by).agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & ~f).alias("tn"))
    div = lambda a, b: F.round(F.try_divide(a, b), 4)
    return g.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn")), "f1": div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
