import pytest
from pyspark.sql import functions as F

from graphloom.operators import balance, graph, hierarchy, store
from graphloom.session import Scratch
from graphloom.streaming.incremental import ChangeFeed, Run, take_up
from graphloom.streaming.versioned import CommitConflict, VersionedTable

EDGE = "type string, src string, dst string"


def links(spark, rows):
    return hierarchy.parent_links(spark.createDataFrame(rows, "t string, c string, p string"), "t", "c", "p")


def test_chain_cycle_and_star(spark):
    rows = [("a", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x"), ("a", "w", "x"), ("a", "s", "s")]
    rows += [("b", f"leaf{i}", "hub") for i in range(50)] + [("b", "leaf0", "hub"), ("b", None, "hub"), ("b", "q", None)]
    h = hierarchy.contract(links(spark, rows), with_paths=True).nodes
    got = {(r["tree"], r["id"]): r for r in h.collect()}
    assert got["a", "n000"]["root_id"] == "n060" and got["a", "n000"]["depth"] == 60
    assert got["a", "n000"]["path"] == [f"n{i:03d}" for i in range(60, -1, -1)]
    assert {(got["a", k]["root_id"], got["a", k]["depth"]) for k in "xyzw"} == {("x", -1)}
    assert (got["a", "s"]["root_id"], got["a", "s"]["depth"]) == ("s", -1)
    assert all(got["b", f"leaf{i}"]["depth"] == 1 for i in range(50)) and ("b", "q") not in got
    d = hierarchy.descendants(h)
    assert d.filter("ancestor_id = 'n060'").count() == 60 and d.filter("ancestor_id = 'hub'").count() == 50


def test_hierarchy_of_nothing_and_conflicts(spark):
    assert hierarchy.contract(links(spark, [])).nodes.count() == 0
    df = spark.createDataFrame([("a", "c", "p2"), ("a", "c", "p1")], "t string, c string, p string")
    assert hierarchy.parent_links(df, "t", "c", "p").first()["par"] == "p1"
    assert hierarchy.conflicts(df, "t", "c", "p").first()["n_parents"] == 2


def test_hot_key_is_split_and_whole(spark):
    rows = [("T", f"s{i % 40}", "hot") for i in range(900)] + [("T", f"s{i}", f"d{i % 90}") for i in range(600)] + [("T", "s1", None)] * 7
    df = spark.createDataFrame(rows, EDGE)
    p, bucket_rows, hot_rows = balance.place(df, ["type", "dst"], tasks=4)
    loads = p.loads(bucket_rows, hot_rows)
    assert sum(loads) >= 1507 and max(loads) <= 1.4 * 1507 / 4
    got = {(r["type"], r["dst"]): (r["n_rows"], r["n_distinct"]) for r in balance.summarize(df, ["type", "dst"], "src", tasks=4).collect()}
    assert got["T", "hot"] == (900, 40) and got["T", None] == (7, 1) and sum(n for n, _ in got.values()) == 1507
    right = spark.createDataFrame([("hot", "h", "k"), ("d1", "one", "k"), (None, "null", "k")], "dst string, label string, src string")
    j = balance.balanced_join(df, right, ["dst"], tasks=4)
    assert j.count() == 900 + df.filter("dst = 'd1'").count() and "src_right" in j.columns
    assert balance.balanced_join(df, right, ["dst"], "left", tasks=4).count() == 1507
    assert balance.balanced_join(df, right, ["dst"], "left_anti", tasks=4).count() == 1507 - j.count()
    assert balance.summarize(df.limit(0), ["type", "dst"], "src", tasks=4).count() == 0
    assert {r["dst"] for r in balance.heavy_keys(df, ["type", "dst"], "dst", 0.3).collect()} == {"hot"}


LOG = "write_seq long, op string, id string, body_hash string, summary_hash string, sig_schema_version int"


def test_runs_take_up_changes_and_survive_failures(spark):
    rows = [
        (1, "scan", "f", "b1", None, None), (1, "scan", "f", "b1", None, None), (2, "scan", "g", "b2", "", None), (3, "summary", "g", None, "b2", 4),
        (11, "summary", "f", None, "b1", 4), (12, "scan", "g", "", None, None), (21, "scan", "f", "b9", None, None), (22, "delete", "g", None, None, None),
        (31, "scan", "g", "b2", None, None), (32, "summary", "f", None, "b9", 5), (33, "scan", None, "b", None, None),
    ]
    log = spark.createDataFrame(rows, LOG)
    runs = [Run(1, 10, 4, False), Run(2, 20, 4, False), Run(3, 25, 4, True), Run(4, 30, 4, False), Run(5, 40, 5, False)]
    out = take_up(log, runs, Scratch(spark, "t").root)
    got = {}
    for r in out.collect():
        got.setdefault(r["run_no"], set()).add(r["id"])
    assert got == {1: {"f"}, 3: {"f"}, 4: {"f"}, 5: {"g"}}
    assert take_up(log, [], Scratch(spark, "t").root).count() == 0


def test_a_run_killed_before_its_commit_is_made_up_for_by_another_session(spark, monkeypatch):
    root = Scratch(spark, "t").root
    first = spark.createDataFrame([(1, "scan", "f", "b1", None, None), (2, "scan", "g", "b2", None, None)], LOG)
    feed = ChangeFeed(spark, root)
    feed.append(first)
    assert {r["id"] for r in feed.process(Run(1, 10, 1, False)).collect()} == {"f", "g"}
    feed.append(spark.createDataFrame([(3, "summary", "f", None, "b1", 1), (4, "scan", "h", "b3", None, None)], LOG))

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit_files", killed)
        with pytest.raises(KeyboardInterrupt):
            feed.process(Run(2, 20, 1, False))
    again = ChangeFeed(spark.newSession(), root)  # knows nothing but the folder
    assert again.picks.properties()["run_no"] == 1
    assert {r["id"] for r in again.process(Run(3, 20, 1, False)).collect()} == {"g", "h"}
    # nothing new: the same picks, and no state is lost
    assert {r["id"] for r in again.process(Run(4, 20, 1, False)).collect()} == {"g", "h"}
    # late rows are in an added file, however old their number
    again.append(spark.createDataFrame([(2, "summary", "h", None, "b3", 1)], LOG))
    assert {r["id"] for r in again.process(Run(5, 20, 1, False)).collect()} == {"g"}


def test_rows_taken_out_of_the_log_are_undone(spark):
    feed = ChangeFeed(spark, Scratch(spark, "t").root)
    feed.append(spark.createDataFrame([(1, "scan", "f", "b1", None, None), (2, "scan", "g", "b2", None, None), (3, "summary", "g", None, "b2", 1)], LOG))
    assert {r["id"] for r in feed.process(Run(1, 10, 1, False)).collect()} == {"f"}
    at = feed.log.latest()
    feed.log.commit(at, hide=[feed.log.stage_vector(feed.log.read(at, positions=True).filter("write_seq = 3 or id = 'f'"))])
    assert {r["id"] for r in feed.process(Run(2, 10, 1, False)).collect()} == {"g"}
    assert [(r["id"], r["body"], r["summary"]) for r in feed.state._live(feed.picks.properties()["state"]).orderBy("id").collect()] == [("f", None, None), ("g", "b2", None)]


def test_versions_and_deltas(spark):
    t = VersionedTable(spark, Scratch(spark, "v").root, spark.createDataFrame([], "id string, v int").schema)
    assert t.latest() == 0 and t.read().count() == 0
    f = t.stage(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"))
    assert t.commit(0, add=[f], properties={"seq": 5}) == 1
    dv = t.stage_vector(t.read(1, positions=True).filter("id = 'a'"))
    g = t.stage(spark.createDataFrame([("a", 9)], "id string, v int"))
    assert t.commit(1, add=[g], hide=[dv]) == 2
    assert sorted(map(tuple, t.read().collect())) == [("a", 9), ("b", 2)] and t.read(1).count() == 2
    assert sorted(map(tuple, t.changes(1, 2).collect())) == [("a", 1, "delete"), ("a", 9, "insert")]
    assert t.properties() == {"seq": 5}
    try:
        t.commit(1, add=[g])
        raise AssertionError("a second writer must fail")
    except CommitConflict:
        pass


def test_trails_use_no_edge_twice(spark):
    e = spark.createDataFrame([("a", "b", "same_file"), ("b", "a", "same_file"), ("b", "c", None)], "src string, dst string, strategy string")
    p = {tuple(r["ids"]) for r in graph.trails(spark.createDataFrame([("a",)], "id string"), e, 5).collect()}
    assert p == {("a",), ("a", "b"), ("a", "b", "a"), ("a", "b", "c")}
    assert {r["id"] for r in graph.closure(spark.createDataFrame([("a",)], "id string"), e).collect()} == {"a", "b", "c"}


def test_merge_keeps_what_is_not_written(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "id string, n int, s string")
    assert sorted(map(tuple, store.merge(old, new, ["id"]).collect())) == [("a", 1, "z"), ("b", 2, "y"), ("c", 3, None)]
    h = store.set_hash(old, ["id", "n"]).first()["hash"]
    assert h == store.set_hash(old.orderBy(F.desc("id")), ["id", "n"]).first()["hash"] and len(h) == 32
