from graphloom.operators import extract as E

FILES = "repo string, relpath string, lang string, source string"
JAVA = """package a.b;
import c.Base;
import d.*;
@RestController
public class A extends Base implements I, J {
  private Store store;
  @GetMapping("/x/{id}")
  public int f(final int x, Map<String, Integer> m) throws IOException {
    // not( a call
    Other o = new Other(x);
    if (x > 0 && store.load("(", x)) { return this.g(o.h()); }
    return 1;
  }
  int g(int y) { store = null; return y; }
}
"""
PY = '''from a.b import c as d
import x.y
LIMIT = 3


class K(Base):
    """Doc."""
    size = 1

    @app.get("/r")
    async def f(self, a: Store, b=1):
        "Tells."
        s = Store()
        self.n = LIMIT
        return s.load(a) + self.g() + a.go(1, 2)
'''


def rows(spark, table):
    n, r, e = E.tables(E.extract(spark.createDataFrame(table, FILES)))
    return n.collect(), r.collect(), e.collect()


def test_java(spark):
    n, r, e = rows(spark, [("r", "p/A.java", "java", JAVA)])
    by = {(x["label"], x["name"]): x for x in n}
    f = by["Function", "f"]
    assert f["fqn"] == "a.b.A#f(final int x, Map<String, Integer> m)" and (f["start_line"], f["end_line"], f["param_count"], f["return_type"], f["visibility"]) == (8, 13, 2, "int", "public") and f["cyclomatic"] == 3
    assert by["Endpoint", "GET /x/{id}"]["route"] == "/x/{id}" and by["Field", "store"]["return_type"] == "Store" and by["Class", "A"]["fqn"] == "a.b.A"
    refs = {(x["type"], x["target_name"], x["recv"], x["recv_type"], x["call_arity"]) for x in r}
    assert {("CALLS", "load", "store", "Store", 2), ("CALLS", "g", "self", "", 1), ("CALLS", "h", "o", "Other", 0), ("INSTANTIATES", "Other", "", "", 1), ("EXTENDS", "Base", "", "", -1), ("IMPLEMENTS", "J", "", "", -1), ("THROWS", "IOException", "", "", -1)} <= refs
    assert ("CALLS", "not", "", "", 1) not in refs and ("WRITES", "store", "", "", -1) in refs and ("IMPORTS", None, "", "", -1) in refs
    assert sum(x["type"] == "EXPOSES" for x in e) == 1 and sum(x["type"] == "CONTAINS" for x in e) == 4


def test_python_and_sql(spark):
    n, r, _ = rows(spark, [("r", "p/m.py", "python", PY), ("r", "bad.py", "python", "def f(:"), ("r", "s.sql", "sql", "CREATE TABLE IF NOT EXISTS s.t (id INT PRIMARY KEY, o DECIMAL(1, 2), PRIMARY KEY (id), FOREIGN KEY (o) REFERENCES u(id)); -- x"), ("r", "n.java", "java", None)])
    by = {(x["label"], x["name"]): x for x in n}
    f = by["Function", "f"]
    assert f["fqn"] == "p.m.K.f" and f["is_async"] and f["docstring"] == "Tells." and f["param_names"] == ["a", "b"] and by["Endpoint", "GET /r"]["method"] == "GET"
    assert ("File", "bad.py") in by and ("File", "n.java") in by and by["Table", "t"]["docstring"] == '[{"name": "id", "type": "INT PRIMARY KEY"}, {"name": "o", "type": "DECIMAL(1, 2)"}]'
    refs = {(x["type"], x["target_name"], x["recv"], x["recv_type"], x["call_arity"]) for x in r}
    assert {("CALLS", "load", "s", "Store", 1), ("CALLS", "g", "self", "", 0), ("CALLS", "go", "a", "Store", 2), ("INSTANTIATES", "Store", "", "", 0), ("READS", "LIMIT", "", "", -1), ("WRITES", "n", "", "", -1), ("REFERENCES", "u", "", "", -1), ("EXTENDS", "Base", "", "", -1)} <= refs
    x = E.extract(spark.createDataFrame([("r", "bad.py", "python", "def f(:"), ("r", None, "java", "x")], FILES)).collect()
    assert len(x) == 1 and x[0]["error"].startswith("SyntaxError")


def test_pages():
    u, _ = E.unit("w/list.jsp", "jsp", '<%@ page import="a.B, a.C" %>\n<%-- no --%>\n<%! int n() { return 1; } %>\n<script src="js/x.js?v=1"></script>\n<jsp:include page="/inc/h.jsp"/>\n<% B b = new B();\n b.go(1); %>\n${user.name}\n')
    got = {(x["type"], x["target_name"], x["ref_line"]) for x in u.refs}
    assert {("INCLUDES_PAGE", "h.jsp", 5), ("INCLUDES_SCRIPT", "x.js", 4), ("CALLS", "go", 7), ("INSTANTIATES", "B", 6), ("CALLS", "getName", 8), ("IMPORTS", "C", 1)} <= got
    assert "_jspService" in {x["name"] for x in u.nodes}
