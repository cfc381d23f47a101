import io
import zipfile

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.sources import archives, classfile, files
from graphloom.streaming.ingest import ingest_files


def test_source_tree(spark, tmp_path):
    for p, text in (("a/B.java", "class B {}"), ("node_modules/x.js", "1"), ("t.d.ts", "x"), ("._B.java", "z"), ("q.SQL", "select 1"), ("b.sql", "select 1")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    got = {(r["relpath"], r["lang"], r["source"]) for r in files.source_tree(spark, str(tmp_path), "r").collect()}
    assert got == {("a/B.java", "java", "class B {}"), ("b.sql", "sql", "select 1")}


def test_graph_json_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}],\n "edges": [{"src": "a", "dst": "b"}]}')
    n, e = files.graph_json(spark, str(tmp_path / "g.json"))
    assert n.count() == 2 and e.first()["dst"] == "b"
    files.write_graph_json(n, e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 2


def test_stream_merges_by_path(spark, tmp_path):
    schema = "file_id long, repo string, relpath string, source string"
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "r", "a", "x"), (2, "r", "b", "y")], schema).coalesce(1).write.parquet(src)
    args = (spark, src, schema, str(tmp_path / "t"), str(tmp_path / "cp"))
    ingest_files(*args).awaitTermination()
    spark.createDataFrame([(3, "r", "a", "z"), (4, "r", "b", None)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest_files(*args).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()) == [(3, "r", "a", "z"), (4, "r", "b", "y")]


def test_classes_out_of_an_archive(spark):
    import glob
    import os

    import pyspark

    jar = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "jackson-annotations*.jar")))[0]
    c = classfile.classes(spark.read.format("binaryFile").load(jar)).cache()
    assert c.filter("error is not null").count() == 0
    n = {r["name"]: r for r in c.filter("name like '%.JsonInclude$Value'").collect()}
    v = n["com.fasterxml.jackson.annotation.JsonInclude$Value"]
    assert v["super"] == "java.lang.Object" and v["source"] == "JsonInclude.java" and {"equals", "hashCode", "construct"} <= {m["name"] for m in v["methods"]}
    k = classfile.calls(c)
    assert k.filter("caller like '%JsonInclude$Value' and caller_method = 'equals' and method = 'getClass' and owner = 'java.lang.Object'").count() >= 1
    assert k.filter("line = 0").count() < k.count() / 10
    bad = spark.createDataFrame([("x.class", b"\xca\xfe\xba\xbe\x00\x00"), ("y.jar", b"PK\x03\x04zz"), ("z.class", b"hello")], "path string, content binary")
    assert classfile.classes(bad).filter("error is not null").count() == 3


def test_descriptors(spark):
    df = spark.createDataFrame([("(I[[Ljava/lang/String;J)V",), ("()Z",), ("(Q)V",), ("I",)], "d string")
    assert [r[0] for r in df.select(X.descriptor_params(F.col("d"))).collect()] == [["int", "java.lang.String[][]", "long"], [], None, None]
    u = spark.createDataFrame([("HTTPS://u@Api.Test:80/a/b?x=1",), ("/a?x",), ("//h",)], "u string")
    assert [tuple(r) for r in u.select(*X.split_url(F.col("u"))).collect()] == [("api.test:80", "/a/b"), ("", "/a"), ("h", "/")]
    t = spark.createDataFrame([("java.util.Map<String, a.B>",), ("a.Outer$Inner[]",), ("int...",)], "t string")
    assert [r[0] for r in t.select(X.erased(F.col("t"))).collect()] == ["Map", "Inner[]", "int[]"]


def test_uploads(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for p in ("a/B.java", "../evil.py", "C:/x.py", "node_modules/x.js", "lib/x.d.ts", "src/./y.py"):
            z.writestr(p, "x = 1")
    up = spark.createDataFrame([("u.zip", b.getvalue()), ("bad.zip", b"nothing")], "path string, content binary")
    e = archives.entries(up)
    assert {r["path"] for r in e.filter("error is null").collect()} == {"a/B.java", "node_modules/x.js", "lib/x.d.ts", "src/y.py"} and e.filter("error is not null").count() == 1
    assert {r["relpath"] for r in archives.sources(e.filter("error is null"), "r").collect()} == {"a/B.java", "src/y.py"}


def test_readers(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("@FILE\tA.java\na.A\tf\t1\tb.B\tg\t0\tA.java\t7\nshort\trow\n")
    rows, files_ = files.call_oracle(spark, str(tmp_path / "o.tsv"))
    assert [tuple(r) for r in rows.select("caller_class", "caller", "caller_arity", "callee", "line").collect()] == [("a.A", "f", 1, "g", 7)] and files_.first()["file"] == "A.java"
    (tmp_path / "e.csv").write_text("# test name, category, real, cwe\nT1, sqli, true, 89\nT2, xss, false, 79\nshort\n")
    assert [(r["test"], r["real"]) for r in files.labelled(spark, str(tmp_path / "e.csv")).collect()] == [("T1", True), ("T2", False)]
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "a.jar").write_text("x")
    assert ("build/a.jar", "archive") in {(r["relpath"], r["kind"]) for r in files.artifacts(spark, str(tmp_path)).collect()}
