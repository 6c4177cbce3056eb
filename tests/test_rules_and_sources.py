import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import scalar
from stratagraph.operators import clinic, constraint, impact, retrieval, temporal
from stratagraph.session import Session, Tables
from stratagraph.sources import files, scanners, store


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_scalars(spark):
    f = F.lit
    assert one(spark, scalar.package_of(f("pkg.T.m"))) == "pkg.T" and one(spark, scalar.package_of(f("x"))) == ""
    assert one(spark, scalar.split_camel(f("parseHTTPServer_v2"))) == ["parse", "HTTP", "Server", "v2"]
    assert one(spark, scalar.short_path(f("m/a/b"), "m")) == "a/b" and one(spark, scalar.short_path(f("m"), "m")) == "(root)"
    assert one(spark, scalar.matches_pattern(f("a/b"), "a/*")) and not one(spark, scalar.matches_pattern(f("a/b/c"), "a/*")) and one(spark, scalar.matches_pattern(f("xyz"), "y"))
    assert one(spark, scalar.normalise_repo_url(f("git@host.org:a/b.git"))) == "https://host.org/a/b" and one(spark, scalar.normalise_repo_url(f("a/b"))) == "https://github.com/a/b"
    assert one(spark, scalar.percent(f(2), f(3))) == 66 and one(spark, scalar.percent(f(2), f(0))) == 0
    assert one(spark, scanners.fold_path(f("a/b/../c/./d"))) == "a/c/d"


def test_budgets_and_gaps(spark):
    c = spark.createDataFrame([("core", 50, 500), ("util", 5, 100)], "name string, churn int, loc int")
    e = spark.createDataFrame([("api", "core"), ("util", "core"), ("api", "util")], "src string, dst string")
    lim = spark.createDataFrame([("core", 1, 60, 0), ("util", 1, 4, 0), ("nobody", 1, 1, 1)], "component string, max_fan_in int, max_churn int, max_nesting int")
    assert rows(constraint.budgets(c, e, lim)) == [("core", "fan_in", 2, 1), ("util", "churn", 5, 4)]
    fs = spark.createDataFrame([("a", "a/x.go"), ("a", "a/x_test.go"), ("b", "b/README.md"), ("b", "b/y.go")], "component string, file string")
    assert rows(constraint.gaps(fs), "component", "gap") == [("a", "no docs"), ("b", "no tests")]


def test_rules_and_directions(spark):
    e = spark.createDataFrame([("cmd/app", "internal/protocol"), ("internal/protocol", "internal/store"), ("x", "y")], "src string, dst string")
    d = spark.createDataFrame([("cmd/app", 0), ("internal/protocol", 2), ("internal/store", 3), ("x", 5), ("y", 2)], "node string, depth int")
    assert rows(constraint.import_direction(e, d)) == [("internal/protocol", "internal/store", 2, 3)]
    assert rows(constraint.boundary_rules(e, [("cmd/*", "internal/*", False), ("x", "*", True)]), "src", "dst") == [("cmd/app", "internal/protocol")]
    assert constraint.boundary_rules(e, []).isEmpty()


def test_roles_and_solid(spark):
    c = spark.createDataFrame([("cmd/server", True, 0, 1, 1, False, 10), ("internal/notify", False, 0, 2, 3, True, 900), ("internal/domain", False, 0, 2, 9, False, 1200)], "name string, has_main boolean, n_interfaces int, n_types int, n_symbols int, external boolean, loc int")
    e = spark.createDataFrame([("internal/domain", "internal/notify")] + [("internal/domain", f"x{i}/y") for i in range(9)], "src string, dst string")
    r = clinic.hexa_roles(c, e)
    assert dict(rows(r)) == {"cmd/server": "entrypoint", "internal/notify": "adapter", "internal/domain": "entrypoint"}
    r2 = clinic.resolve_roles(r, spark.createDataFrame([("internal/domain", "domain"), ("extra", "port")], "component string, role string"))
    assert rows(clinic.hexa_violations(e, r2)) == [("internal/domain", "internal/notify", "domain", "adapter", "error")]
    v = clinic.srp(c, e, r2)
    assert rows(v, "component", "reason") == [("internal/domain", "size")]
    accepted = spark.createDataFrame([("internal/domain", "SRP")], "component string, principle string")
    assert clinic.srp(c, e, r2, accepted).isEmpty()
    src = spark.createDataFrame([("p", "func f() {\n\tswitch v := x.(type) {\n" + "".join(f"\tcase T{i}:\n\t\tg()\n" for i in range(7)) + "\t}\n}\n")], "component string, source string")
    assert rows(clinic.ocp(src), "component", "severity", "reason") == [("p", "warning", "7 cases")]
    cyc = spark.createDataFrame([("pkg/a->pkg/b", 2)], "cycle string, len int")
    pe = spark.createDataFrame([("pkg/a", "pkg/b"), ("pkg/b", "pkg/a")], "src string, dst string")
    assert rows(clinic.pattern_scan(pe, cyc)) == [("circular_dependency", "pkg/a", 1.0), ("circular_dependency", "pkg/b", 1.0), ("inappropriate_intimacy", "pkg/a", 0.9)]


def test_risk(spark):
    c = spark.createDataFrame([("core", 50, 500, 3), ("util", 5, 100, 1), ("api", 30, 200, 2)], "name string, churn int, loc int, n_symbols int")
    e = spark.createDataFrame([("api", "core"), ("util", "core"), ("api", "util")], "src string, dst string")
    cov = spark.createDataFrame([("core", 80.0), ("api", 20.0)], "component string, coverage_pct double")
    r = {x["component"]: x for x in impact.risk_scores(e, c, cov).collect()}
    assert abs(r["core"]["score"] - 84) < 1e-9 and r["core"]["level"] == "critical"


def test_history(spark, tmp_path):
    c = spark.createDataFrame([("a1b2c3d4e5", "ann", dt.datetime(2025, 1, 30), "fix\nbody", "pkg/x.go"), ("a1b2c3d4e5", "ann", dt.datetime(2025, 1, 30), "fix\nbody", "pkg/x_test.go"), ("ff", "bob", dt.datetime(2024, 1, 1), "old", "pkg/x.go"), ("ff", "bob", dt.datetime(2024, 1, 1), "old", "root.go")], "hash string, author string, date timestamp_ntz, message string, file string")
    at = F.lit("2025-01-31").cast("timestamp_ntz")
    assert rows(temporal.churn(c, at)) == [("pkg", 1)]
    assert rows(temporal.recent_commits(c), "hash8", "subject") == [("a1b2c3d4", "fix"), ("ff", "old")]
    assert rows(temporal.author_ownership(c, 1)) == [("pkg", "ann", 2)]
    lines = spark.createDataFrame([("mode: set",), ("m/pkg/a.go:1.2,3.4 2 1",), ("m/pkg/a.go:5.2,6.4 2 0",)], "value string")
    assert rows(temporal.coverage(lines, "m")) == [("pkg", 50.0)]
    h = store.History(spark, str(tmp_path / "h"))
    for i in range(3):
        h.append(spark.createDataFrame([(f"2025-01-0{i + 1}", f"s{i}")], "timestamp string, sha string"))
    schema = "timestamp string, sha string"
    assert rows(h.last(schema, 2), "sha") == [("s1",), ("s2",)] and rows(h.at(schema, -1), "sha") == [("s2",)] and rows(h.at(schema, 0), "sha") == [("s0",)]
    s = store.ParquetStore(spark, str(tmp_path / "st"))
    s.put("c", "repo", "abc", c, "health")
    assert s.get("c", "repo", "abc", "health").count() == 4 and s.get("c", "repo", "abc") is None
    s.invalidate("c", "repo")
    assert s.get("c", "repo", "abc", "health") is None
    n = store.Notes(spark, str(tmp_path / "n"))
    n.put("repo", "a note", "text", "s1")
    assert rows(n.get("repo", "a_note", "s2")) == [("text", "s1", True)]


def test_scanners(spark):
    f = spark.createDataFrame(
        [
            ("a/x.go", 'package a\n\nimport (\n\t"m/b"\n)\n\ntype S struct {\n\tX int `json:"x"`\n}\n\nfunc (s *S) Do() { helper(1) }\n\nfunc helper(n int) {\n\tif n > 0 {\n\t\tfor {\n\t\t}\n\t}\n}\n\nfunc main() { helper(2) }\n\nconst (\n\tIdle State = iota\n\tBusy\n\tDone\n)\n'),
            ("p/y.py", "import os\nfrom a.b import c\nfrom . import z\n\nclass K(Base):\n    async def f(self):\n        g()\n\ndef _h():\n    pass\n"),
            ("w/z.ts", "import { a } from '../v/q';\nimport type { T } from './t';\nexport class C extends D implements E, F {\n}\nexport const k = 1;\n"),
            ("v/q.ts", "export function q() {}\n"),
            ("r/l.rs", "use crate::x::Y;\npub struct R;\nimpl Tr for R {}\npub fn go() {}\nfn hidden() {}\n"),
            ("c/m.c", '#include <stdio.h>\n#include "b/h.h"\n'),
        ],
        "path string, text string",
    )
    d = rows(scanners.declarations(f), "path", "name", "kind", "exported")
    assert ("a/x.go", "Do", "method", True) in d and ("a/x.go", "helper", "function", False) in d and ("p/y.py", "_h", "function", False) in d and ("r/l.rs", "go", "function", True) in d and not any(x[1] == "hidden" for x in d)
    imp = rows(scanners.imports(f), "path", "target")
    assert ("p/y.py", "a.b") in imp and ("w/z.ts", "../v/q") in imp and ("c/m.c", "b/h.h") in imp and not any("./t" in x[1] for x in imp if x[0] == "w/z.ts")
    pk = spark.createDataFrame([("v",), ("b",), ("a",)], "package string")
    e = {(r["src"], r["dst"]): r["external"] for r in scanners.import_edges(scanners.imports(f), pk).collect()}
    assert e["w", "v"] is False and e["a", "b"] is False and e["p", "os"] is True
    assert rows(scanners.implementations(f)) == [("C", "D", "extends"), ("C", "E", "implements"), ("C", "F", "implements"), ("K", "Base", "extends"), ("R", "Tr", "implements")]
    assert dict(rows(scanners.nesting_depth(f)))["a/x.go"] == 3
    calls = rows(scanners.regex_calls(f), "caller", "callee")
    assert ("Do", "helper") in calls and ("main", "helper") in calls
    assert ("a/x.go", "main", "main") in rows(scanners.anchors(f)) and ("a/x.go", "config", "S") in rows(scanners.anchors(f))
    m = scanners.state_machines(f).collect()
    assert [(r["name"], r["states"], r["initial"]) for r in m] == [("State", ["Idle", "Busy", "Done"], "Idle")]
    p, r = scanners.go_signature(F.lit("(a map[string]int, b func(x int) error) (*T, error)"))
    assert one(spark, p) == ["map[string]int", "func(x int) error"] and one(spark, r) == ["*T", "error"]
    roots = spark.createDataFrame([("r1", "go.mod"), ("r1", "package.json"), ("r2", "x/go.mod"), ("r3", "setup.py")], "root string, path string")
    assert rows(scanners.detect_language(roots)) == [("r1", "go"), ("r2", "unknown"), ("r3", "python")]
    conv = {(r["category"], r["pattern"]): r["count"] for r in scanners.conventions(spark.createDataFrame([(f"cmd/a{i}_test.go",) for i in range(8)] + [("vendor/x_test.go",)], "path string")).collect()}
    assert conv["structure", "cmd/"] == 8 and conv["test", "_test.go"] == 5
    edges = spark.createDataFrame([("s", "t", "v/q.ts", 1)], "source string, target string, file string, line int")
    assert rows(scanners.source_snippet(f, edges, 1), "n", "text") == [(1, "export function q() {}"), (2, "")]


def test_small_files(spark):
    mod = spark.createDataFrame([("go.mod", "module a/b\n\ngo 1.22\n\nrequire (\n\tx/y v1.2.3\n\tz/w v0.1.0 // indirect\n)\nreplace x/y => ../y\n")], "path string, text string")
    got = rows(files.go_mod(mod), "kind", "module", "version", "indirect")
    assert ("require", "x/y", "v1.2.3", False) in got and ("require", "z/w", "v0.1.0", True) in got and ("module", "a/b", "", False) in got and ("replace", "x/y", "../y", False) in got
    rule = spark.createDataFrame([("r.mdc", "---\ndescription: d\nglobs: [*.go, *.py]\nalwaysApply: true\n---\nbody\n")], "path string, text string")
    assert [(r["description"], r["globs"], r["always"], r["body"]) for r in files.front_matter(rule).collect()] == [("d", ["*.go", "*.py"], True, "body")]
    c, e = files.desired_state(spark, 'graph TD\n  a["core/x"]\n  a --> b\n')
    assert rows(c) == [("b",), ("core/x",)] and rows(e) == [("core/x", "b")]
    n, k = files.knowledge_graph(spark, "nodes:\n  - id: hub\n    kind: smell\n    keywords: [hub, fan-in]\n    about: \"x\"\n  - id: fan-in\n    kind: metric\n    keywords: [fan-in]\nedges:\n  - {from: hub, to: fan-in, kind: measured_by}\n")
    q = retrieval.book_query(n, k, "what about Hub?")
    assert [r["id"] for r in q["roots"].collect()] == ["hub"] and rows(q["nodes"], "id") == [("fan-in",), ("hub",)]
    log = spark.createDataFrame([("h|a|2025-01-01T00:00:00|m|p/f.go",), ("broken",)], "value string")
    assert rows(files.git_log(log), "hash", "file") == [("h", "p/f.go")]


def test_triage(spark):
    t = spark.createDataFrame([("cycles", ["graph"], ["cycle", "circular"], 1), ("deps", ["graph"], ["dependency", "import"], 2), ("churn", ["time"], ["churn", "history"], 1)], "name string, categories array<string>, keywords array<string>, priority int")
    assert [r["tool"] for r in retrieval.triage(t, "find circular imports").collect()] == ["cycles", "deps"]
    assert [r["tool"] for r in retrieval.triage(t, "zzz").collect()] == ["scan_project"]
    assert one(spark, retrieval.route(F.lit("Where are the CYCLES?"))) == "cycles" and one(spark, retrieval.route(F.lit("hm"))) == "none"


@pytest.fixture(scope="module")
def session(spark):
    c = spark.createDataFrame([("A", "p", 100, 9, 2), ("B", "p", 200, 1, 1), ("C", "q", 150, 3, 3)], "name string, package string, loc long, churn long, n_symbols long")
    e = spark.createDataFrame([("A", "B", 1, 3, 1), ("B", "C", 1, 5, 1), ("C", "A", 2, 1, 1)], "src string, dst string, weight long, call_sites long, loc_surface long")
    s = spark.createDataFrame([("p.Run", "p", "Run", "function", True, "f.go", 1, "()"), ("p.DataMgr", "p", "DataMgr", "struct", True, "f.go", 9, None)], "fqn string, package string, name string, kind string, exported boolean, file string, line int, signature string")
    k = spark.createDataFrame([("p.Run", "p.DataMgr", "call", "f.go", 2), ("q.X", "p.Run", "call", "g.go", 1)], "source string, target string, kind string, file string, line int")
    return Session(spark, Tables(c, e, s, k, layers=["A", "B", "C"], rules=[("A", "B", False)]))


def test_session(session):
    assert rows(session.run("cycles"), "cycle") == [("A->B->C",)]
    assert rows(session.run("violations")) == [("A", "B"), ("B", "C")]
    got = session.batch([("callers", {"symbol": "Run"}), ("what_if", {}), ("nothing", {}), ("budgets", {})])
    assert rows(got[0]["result"]) == [("q.X", "g.go")] and all("error" in g for g in got[1:])
    assert rows(session.run("symbol_quality"), "fqn", "issue") == [("p.DataMgr", "abbreviation")]
    assert session.answer("show me the riskiest") == "coupling view=hot_spots"
    for name in Session.PRESETS:
        assert session.preset(name).count() == len(Session.PRESETS[name]), name
    for kind in ("dependency", "c4", "tree", "layers", "zones", "dsm", "coupling", "churn", "hexa"):
        assert session.diagram(kind).count() >= 1, kind
    assert "sequenceDiagram" in session.diagram("sequence", start="q.X").first()["text"]
    with pytest.raises(ValueError):
        session.diagram("nothing")
    assert session.probe("Run").first()["fan_in"] == 1 and session.islands().count() == 2


def test_streaming(spark, tmp_path):
    from stratagraph.streaming.churn import windowed_churn

    src = str(tmp_path / "in")
    spark.createDataFrame([(dt.datetime(2025, 1, 1, 3), "a/x.go"), (dt.datetime(2025, 1, 1, 4), "a/y.go"), (dt.datetime(2025, 1, 9), "b/z.go"), (dt.datetime(2025, 1, 9), "b/z_test.go")], "date timestamp, file string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("date timestamp, file string").parquet(src)
    q = windowed_churn(stream).writeStream.outputMode("append").format("memory").queryName("churn_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["package"], r["changes"]) for r in spark.table("churn_out").collect()] == [("a", 2)]


def test_model(spark):
    from stratagraph.operators import model

    ns = spark.createDataFrame([("m",), ("m/a/b",), ("m/a/c",), ("m/testkit/x",)], "path string")
    e = spark.createDataFrame([("m/a/b", "m/a/c", False, 2), ("m/a/b", "fmt", True, 1), ("m/a/b", "m/gone", False, 1), ("m/testkit/x", "m/a/b", False, 1)], "src string, dst string, external boolean, weight int")
    s = spark.createDataFrame([("m/a/b", True), ("m/a/b", False), ("m", True)], "package string, exported boolean")
    r = model.package_model(ns, e, s, "m", external=True, no_tests=True)
    assert rows(r["components"]) == [("(root)", 1), ("a/b", 1), ("a/c", 0)]
    assert rows(r["edges"]) == [("a/b", "a/c", "import", 2), ("a/b", "fmt", "external", 1)]
    g = model.group_model(r["components"].select("name", F.lit(3).alias("churn")), r["edges"], model.default_groups(r["components"], 1))
    assert rows(g["components"]) == [("(root)", 3), ("a", 6)] and rows(g["edges"]) == [("a", "fmt", "external", 1)]
    names = spark.createDataFrame([("a/x/1",), ("a/x/2",), ("a/y/1",), ("b/z",)], "name string")
    assert model.suggested_depth(names) == 1 and model.suggested_depth(names.limit(2)) == 0
    assert model.project_path({"Cargo.toml": '[package]\nname = "c"\n'}, "/x/y") == "c" and model.project_path({}, "/x/y/") == "y"
    f = spark.createDataFrame([("a", 10), ("a", 5), ("b", None)], "component string, lines int")
    assert rows(model.size_rollup(f, spark.createDataFrame([("a", 2), ("a", 4)], "component string, depth int"))) == [("a", 15, 4, 3.0), ("b", None, 0, 0.0)]


def test_graph_cache(spark):
    from stratagraph.sources.store import GraphCache

    built, cache = [], GraphCache(most=2)
    make = lambda i: lambda: built.append(i) or spark.range(i)
    a = cache.get("r", "1", make(3))
    assert cache.get("r", "1", make(4)) is a and a.count() == 3 and a.storageLevel.useMemory and built == [3]
    cache.get("r", "2", make(5))
    cache.get("q", "1", make(6))
    assert cache.get("r", "1", make(7)).count() == 7 and built == [3, 5, 6, 7]
    cache.invalidate("r")
    assert list(cache.held) == [("q", "1")] and not a.storageLevel.useMemory


def test_signatures_of_five_languages(spark):
    cases = [
        ("func Run(x int, ys []string) (*Result, error)", ["int", "[]string"], ["*Result", "error"]),
        ("def load_config(self, path: str, opts: dict[str, int] = None, *rest) -> dict", ["str", "dict[str, int] = None"], ["dict"]),
        ("def go(x) -> None", [], []),
        ("function loadConfig(path: string, cb: (a: number, b: string) => void): Promise<Map<string, X>>", ["string", "(a: number, b: string) => void"], ["Promise<Map<string, X>>"]),
        ("function go(x: T): void", ["T"], []),
        ("pub fn load_config(&mut self, path: &str, m: HashMap<K, V>) -> Result<Config, E>", ["&str", "HashMap<K, V>"], ["Result<Config, E>"]),
        ("fn go() -> ()", [], []),
        ("static Config loadConfig(const std::string &path, int n)", ["const std::string", "int"], ["static Config"]),
        ("void go(void)", [], []),
        ("int x", None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(99, None)], "i int, s string")
    p, r = scanners.signature_types(F.col("s"))
    got = {x["i"]: (x["p"], x["r"]) for x in df.select("i", p.alias("p"), r.alias("r")).collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(cases)} | {99: (None, None)}
