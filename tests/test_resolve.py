from graphloom.operators import resolve as R

NODES = "id string, label string, name string, fqn string, file string, package string, param_count int"


def nodes(spark):
    rows = [
        ("fA", "File", "A.java", "a/A.java", "a/A.java", "a", None), ("fB", "File", "B.java", "b/B.java", "b/B.java", "b", None), ("fC", "File", "C.java", "c/C.java", "c/C.java", "c", None),
        ("A", "Class", "A", "a.A", "a/A.java", "a", None), ("B", "Class", "B", "b.B", "b/B.java", "b", None), ("Base", "Class", "Base", "b.Base", "b/B.java", "b", None), ("Top", "Class", "Top", "c.Top", "c/C.java", "c", None),
        ("U1", "Class", "Util", "b.Util", "b/B.java", "b", None), ("U2", "Class", "Util", "c.Util", "c/C.java", "c", None),
        ("a1", "Function", "run", "a.A#run", "a/A.java", "a", 0), ("a2", "Function", "help", "a.A#help", "a/A.java", "a", 1), ("b1", "Function", "help", "b.B#help", "b/B.java", "b", 2),
        ("s1", "Function", "save", "b.Base#save", "b/B.java", "b", 1), ("s2", "Function", "save", "c.Top#save", "c/C.java", "c", 1), ("t1", "Function", "top", "c.Top#top", "c/C.java", "c", 0),
        ("u1", "Function", "go", "b.Util#go", "b/B.java", "b", 1), ("u2", "Function", "go", "c.Util#go", "c/C.java", "c", 1), ("x", "Function", "only", "c.Top#only", "c/C.java", "c", 3),
        ("fld", "Field", "count", "a.A#count", "a/A.java", "a", None), ("glob", "Field", "LIMIT", "a.LIMIT", "a/A.java", "a", None),
    ] + [(f"h{i}", "Function", "hot", f"h{i}.H#hot", f"h/{i}.java", "h", i) for i in range(7)]
    return spark.createDataFrame(rows, NODES)


CONTAINS = [("A", "a1"), ("A", "a2"), ("B", "b1"), ("Base", "s1"), ("Top", "s2"), ("Top", "t1"), ("U1", "u1"), ("U2", "u2"), ("Top", "x"), ("A", "fld"), ("fA", "A"), ("fA", "glob")]
LINKS = [("B", "Base"), ("Base", "Top"), ("A", "B")]


def ref(i, type_, target, recv="", recv_type="", arity=-1, kind="call", src="a1", file="a/A.java", fqn=None):
    return (i, type_, src, target, kind, recv, recv_type, fqn, None, file, 1, 1, arity)


def resolved(spark, rows, cap=5):
    e = lambda r: spark.createDataFrame(r, "src string, dst string")
    out = R.resolve(spark.createDataFrame(rows, R.REFS), nodes(spark), e(CONTAINS), e(LINKS), cap)
    got = {}
    for r in out.collect():
        got.setdefault(r["ref_id"], set()).add((r["type"], r["dst"], r["strategy"], r["confidence"], r["outcome"]))
    return got


def test_tiers_of_calls(spark):
    got = resolved(spark, [
        ref("scope", "CALLS", "help", arity=1), ref("recv", "CALLS", "save", "b", "B", 1), ref("deep", "CALLS", "top", "b", "B"), ref("self", "CALLS", "save", "self"), ref("class", "CALLS", "go", "Util"),
        ref("ext", "CALLS", "save", "c", "Connection"), ref("only", "CALLS", "only"), ref("unknown", "CALLS", "only", "thing"), ref("hot", "CALLS", "hot"), ref("hotter", "CALLS", "hot", "thing"), ref("no", "CALLS", "nothing"), ref("tail", "CALLS", "pkg.only"),
    ])
    assert got["scope"] == {("CALLS", "a2", "same_scope+arity", "INFERRED", "resolved")}
    assert got["recv"] == {("CALLS", "s1", "receiver_type_hint_inherited+arity", "INFERRED", "resolved")}  # the nearest ancestor's
    assert got["deep"] == {("CALLS", "t1", "receiver_type_hint_inherited", "INFERRED", "resolved")}
    assert got["self"] == {("CALLS", "s1", "receiver_type_inherited", "INFERRED", "resolved")}
    assert got["class"] == {("CALLS", "u1", "receiver_type", "AMBIGUOUS", "ambiguous"), ("CALLS", "u2", "receiver_type", "AMBIGUOUS", "ambiguous")}
    assert got["ext"] == {("CALLS", None, "external_receiver", None, "external")}  # a known foreign type ends the search
    assert got["only"] == {("CALLS", "x", "name", "INFERRED", "resolved")}
    assert got["unknown"] == {("REFERENCES", "x", "name+unknown_recv", "INFERRED", "resolved")}
    assert got["hot"] == {("CALLS", None, "name", None, "unresolved")} and got["hotter"] == {("REFERENCES", None, "name+unknown_recv", None, "unresolved")}
    assert got["no"] == {("CALLS", None, "none", None, "external")}
    assert ("REFERENCES", "x", "none+fallback_tail", "INFERRED", "resolved") in got["tail"]


def test_imports_come_before_the_receiver(spark):
    imports = [ref("i", "IMPORTS", "c.Util", kind="import", fqn="c.Util")]
    got = resolved(spark, [*imports, ref("go", "CALLS", "go", "u", "Util"), ref("t", "INSTANTIATES", "Util", kind="type")])
    assert "i" not in got
    assert got["go"] == {("CALLS", "u2", "receiver_type_hint", "INFERRED", "resolved")}
    assert got["t"] == {("INSTANTIATES", "U2", "imports_qualified_exact", "EXTRACTED", "resolved")}
    wild = [ref("w", "IMPORTS", None, kind="import_wildcard", fqn="b")]
    assert resolved(spark, [*wild, ref("t", "EXTENDS", "Util", kind="type")])["t"] == {("EXTENDS", "U1", "imports_wildcard", "EXTRACTED", "resolved")}
    assert resolved(spark, [ref("t", "EXTENDS", "Util", kind="type", src="u1", file="b/B.java")])["t"] == {("EXTENDS", "U1", "same_file", "EXTRACTED", "resolved")}


def test_fields_and_nothing(spark):
    got = resolved(spark, [ref("r", "READS", "count"), ref("w", "WRITES", "LIMIT"), ref("n", "READS", "local"), ref("o", "OF_TYPE", "Base", kind="type"), ref("e", "EXTENDS", "Missing", kind="type"), ref("d", "THROWS", "X", kind="type")])
    assert got["r"] == {("READS", "fld", "same_scope", "EXTRACTED", "resolved")} and got["w"] == {("WRITES", "glob", "same_file_global", "EXTRACTED", "resolved")}
    assert {x[4] for x in got["n"]} == {"external"} and got["o"] == {("OF_TYPE", "Base", "kind_hint", "INFERRED", "resolved")} and {x[4] for x in got["e"]} == {"external"} and "d" not in got
    assert resolved(spark, [ref("x", "CALLS", None)])["x"] == {("CALLS", None, "none", None, "external")}


def test_endpoints_and_files(spark):
    e = spark.createDataFrame([("e1", "GET", "/a/*"), ("e2", "ANY", "/b"), ("e3", "POST", "/a/c"), ("e4", "GET", "/a/c")], "id string, method string, route string")
    c = spark.createDataFrame([("1", "GET", "/a/c"), ("2", "GET", "/a/d"), ("3", "PUT", "/b"), ("4", "ANY", "/a/c"), ("5", "PUT", "/a/d"), ("6", "GET", "/a/d/e")], "ref_id string, method string, route string")
    got = {}
    for r in R.match_endpoints(c, e).collect():
        got.setdefault(r["ref_id"], set()).add(r["endpoint"])
    assert got == {"1": {"e4"}, "2": {"e1"}, "3": {"e2"}, "4": {"e3", "e4"}}
    f = spark.createDataFrame([("p1", "web/a/x.jsp"), ("p2", "web/b/x.jsp"), ("p3", "y.jsp")], "id string, file string")
    r = spark.createDataFrame([("1", "x.jsp", "web/a/m.jsp"), ("2", "x.jsp", "src/m.java"), ("3", "y.jsp", "z/z.java")], "ref_id string, basename string, ref_file string")
    assert sorted((x["ref_id"], x["file_id"]) for x in R.match_files(r, f).collect()) == [("1", "p1"), ("2", "p1"), ("2", "p2"), ("3", "p3")]
