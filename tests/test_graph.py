import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import cycles, graph, impact, kernels, mesh, primitives

NODES = ["pkg1.A", "pkg1.B", "pkg2.C", "pkg2.D", "pkg3.E", "pkg3.F", "pkg4.G", "pkg5.H"]
EDGES = [("pkg1.A", "pkg1.B"), ("pkg1.B", "pkg2.C"), ("pkg2.C", "pkg2.D"), ("pkg1.A", "pkg3.E"), ("pkg3.E", "pkg3.F"), ("pkg4.G", "pkg1.B"), ("pkg2.D", "pkg3.E")]


@pytest.fixture(scope="module")
def known(spark):
    n = spark.createDataFrame([(x, x.split(".")[0], x.split(".")[1], "function", True, "", 1) for x in NODES], "fqn string, package string, name string, kind string, exported boolean, file string, line int")
    e = spark.createDataFrame([(a, b, "call", 1.0) for a, b in EDGES], "source string, target string, kind string, weight double")
    return n.cache(), e.cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_known_topology(known, spark):
    n, e = known
    fi = dict(rows(graph.fan_in(e, "source", "target"), "node", "fan_in"))
    assert fi == {"pkg1.B": 2, "pkg3.E": 2, "pkg2.C": 1, "pkg2.D": 1, "pkg3.F": 1}
    assert [r[0] for r in rows(primitives.entry_points(n, e))] == ["pkg1.A", "pkg4.G"]
    assert [r[0] for r in rows(primitives.islands(n, e))] == ["pkg5.H"]
    down = dict(rows(primitives.scenario(n, e, "A", 3)["downstream"], "fqn", "depth"))
    assert down == {"pkg1.B": 1, "pkg3.E": 1, "pkg2.C": 2, "pkg3.F": 2, "pkg2.D": 3}
    conv = primitives.convergence(n, e, ["pkg1.A", "pkg4.G"])["nodes"]
    assert [r[0] for r in rows(conv, "fqn")] == ["pkg1.B", "pkg2.C", "pkg2.D", "pkg3.E", "pkg3.F"]
    assert rows(primitives.isolate(n, e, "pkg1.B")) == [(2, 3)]
    v = {r["fqn"]: r for r in primitives.probe_all(n, e).collect()}
    assert v["pkg1.A"]["fan_out"] == 2 and v["pkg1.A"]["instability"] == 1.0 and v["pkg5.H"]["instability"] == 0.0
    assert primitives.scenario(n, e, "nobody", 3) is None and primitives.scenario(n, e, "A", 0) is None


def brute(edges):
    nodes = {x for e in edges for x in e}
    adj = {x: {b for a, b in edges if a == x} for x in nodes}
    out = {}
    for s in nodes:
        depth, level = {s: 0}, [s]
        while level:
            after = []
            for u in level:
                for w in adj[u]:
                    if w not in depth:
                        depth[w] = depth[u] + 1
                        after.append(w)
            level = after
        out[s] = depth
    return nodes, adj, out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(16)})
    nodes, adj, reach = brute(edges)
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = graph.nodes_of(df)
    want = sorted((s, n, d) for s, r in reach.items() for n, d in r.items())
    assert rows(graph.closure(df, seeds), "seed", "node", "depth") == want
    assert rows(graph.closure(df, seeds, small=0), "seed", "node", "depth") == want, "the way for large graphs"
    on = sorted(n for n in nodes if n in adj[n] or any(n in reach[m] for m in adj[n]))
    assert [r[0] for r in rows(cycles.on_cycle_nodes(df))] == on
    found = set()
    for k in range(1, 5):
        for p in itertools.permutations(sorted(nodes), k):
            if p[0] == min(p) and all(b in adj[a] for a, b in zip(p, p[1:] + p[:1])):
                found.add("->".join(p))
    assert {r[0] for r in rows(cycles.elementary_cycles(df, 4), "cycle")} == found
    assert {r[0] for r in rows(cycles.elementary_cycles(df, 4, small=0), "cycle")} == found, "the way for large graphs"
    for k in range(5, len(nodes) + 1):
        for p in itertools.permutations(sorted(nodes), k):
            if p[0] == min(p) and all(b in adj[a] for a, b in zip(p, p[1:] + p[:1])):
                found.add("->".join(p))
    assert sorted(r[0] for r in rows(cycles.elementary_cycles(df), "cycle")) == sorted(found)
    scc = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    several = sorted((n, r) for n, r in scc.items() if list(scc.values()).count(r) > 1)
    assert rows(cycles.components(df)) == several and rows(cycles.components(df, small=0)) == several
    und = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    _, _, ur = brute(sorted(und))
    want = sorted((n, min(ur[n])) for n in nodes)
    assert rows(graph.weak_components(df)) == want and rows(graph.weak_components(df, small=0)) == want
    starts = df.select(F.col("src").alias("node")).distinct().orderBy("node").limit(2)
    first = [r[0] for r in rows(starts)]
    want = sorted((n,) for n in {m for f in first for m in reach[f]})
    assert rows(primitives.reach_from(df, starts, "src", "dst")) == want and rows(primitives.reach_from(df, starts, "src", "dst", small=0)) == want


def test_depth_and_order(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "c"), ("c", "d")], "src string, dst string")
    # c is held up by the cycle: it keeps the depth from b and isn't followed, so d stays at 0.
    want = {"a": 0, "b": 1, "c": 2, "d": 0, "x": -1, "y": -1}
    assert dict(rows(cycles.import_depth(df))) == want and dict(rows(cycles.import_depth(df, small=0))) == want
    with pytest.raises(cycles.CycleError):
        cycles.topological_levels(df)
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("z", "z")], "src string, dst string")
    assert dict(rows(cycles.topological_levels(dag))) == {"a": 0, "b": 1, "c": 2, "z": 0}
    assert graph.shortest_path(dag, "a", "c") == ["a", "b", "c"] and graph.shortest_path(dag, "c", "a") is None and graph.shortest_path(dag, "q", "q") == ["q"]


def test_kernels(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    b = dict(rows(kernels.betweenness(df)))
    assert b["a"] == 0 and abs(b["b"] - 4 / 6) < 1e-9
    assert [r["node"] for r in kernels.rcm_order(df).orderBy("pos").collect()] == ["d", "c", "b", "a"]
    e = spark.createDataFrame(
        [("main", "Parse", ["string"], ["*AST"], "f", 1), ("Parse", "Transform", ["*AST"], ["*IR", "error"], "f", 2), ("Transform", "Render", ["*IR"], ["string"], "f", 3)],
        "source string, target string, param_types array<string>, return_types array<string>, file string, line int",
    )
    got = kernels.typed_pipelines(e, 2).collect()
    assert [(r["steps"], r["type_chain"]) for r in got] == [(["Parse", "Transform", "Render"], ["*AST", "*IR"])]


def test_kernels_of_large_graphs(spark):
    rnd = random.Random(5)
    names = [f"n{i:02d}" for i in range(14)]
    edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(22)})
    df = spark.createDataFrame(edges, "src string, dst string")
    small, large = dict(rows(kernels.betweenness(df))), dict(rows(kernels.betweenness(df, small=0)))
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-9 for k in small) and max(small.values()) > 0
    adj = {n: sorted({b for a, b in edges if a == n and b != n} | {a for a, b in edges if b == n and a != n}) for e in edges for n in e}
    key = lambda n: (len(adj[n]), n)
    order = [min(adj, key=key)]
    for v in order:
        order += [w for w in sorted(adj[v], key=key) if w not in order]
    order += sorted(set(adj) - set(order))
    assert [r["node"] for r in kernels.rcm_order(df).orderBy("pos").collect()] == order[::-1]
    assert kernels.rcm_order(df.limit(0)).isEmpty() and kernels.betweenness(df.limit(0)).isEmpty()


def test_pipelines_are_walked_in_the_order_of_names(spark):
    rnd = random.Random(11)
    for _ in range(4):
        names = [f"f{i:02d}" for i in range(30)]
        after = {n: rnd.choice(names) for n in names if rnd.random() < 0.8}
        want, seen = [], set()
        for s in sorted(after):
            if s in seen:
                continue
            chain = [s]
            seen.add(s)
            while chain[-1] in after and after[chain[-1]] not in seen:
                chain.append(after[chain[-1]])
                seen.add(chain[-1])
            if len(chain) >= 2:
                want.append((s, chain))
        e = spark.createDataFrame([(a, b, ["T"], ["T"], "f", i) for i, (a, b) in enumerate(after.items())] + [(None, n, ["T"], ["T"], "f", 99) for n in names][:0], "source string, target string, param_types array<string>, return_types array<string>, file string, line int")
        sig = spark.createDataFrame([("~" + n, n, ["T"], ["T"], "e", 0) for n in names], e.schema)
        got = kernels.typed_pipelines(e.unionByName(sig), 2).where(~F.col("start").startswith("~")).collect()
        assert sorted((r["start"], r["steps"]) for r in got) == want and all(r["type_chain"] == ["T"] * (r["length"] - 1) for r in got)


def test_new_cycles(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y")], "src string, dst string")
    b = spark.createDataFrame([("y", "x"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert rows(impact.new_cycles(a, b)) == [(2,)] and rows(impact.new_cycles(a, a)) == [(0,)]


def test_mesh(spark):
    e = spark.createDataFrame([("pkg.Alpha", "pkg.Beta", 1.0), ("pkg.Beta", "pkg.Alpha", 1.0), ("pkg.Beta", "pkg.Gamma", 1.0)], "source string, target string, weight double")
    assert rows(mesh.circuits(e, 0.3)) == [(1, "pkg.Alpha", "pkg.Beta")]
    cases = [("analyzer.X", "engine.Y", 1.0), ("engine.X", "engine.Y", 0.5), ("engine.X", "fmt.Println", 0.01), ("engine.X", "net/http.Get", 0.3), ("engine.X", "/usr/go/src/sort.Slice", 0.01), ("engine.X", "/usr/go/src/net/http.Get", 0.3)]
    df = spark.createDataFrame(cases, "s string, t string, w double")
    assert all(r["w"] == r["g"] for r in df.select("w", mesh.edge_weight(F.col("s"), F.col("t"), ["analyzer", "engine"]).alias("g")).collect())
    n = spark.createDataFrame([("a/b/c.F", "a/b/c", "x/f.go"), ("G", "", None), ("q.H", "q", "")], "fqn string, package string, file string")
    c = spark.createDataFrame([("a",), ("a/b",)], "name string")
    assert rows(mesh.ancestors(n, c), "symbol", "file", "package", "component") == [("G", "/(unknown)", "", "(root)"), ("a/b/c.F", "a/b/c/f.go", "a/b/c", "a/b"), ("q.H", "q/(unknown)", "q", "q")]


def test_similarity_against_all_pairs(spark):
    rnd = random.Random(3)
    edges = sorted({(f"c{rnd.randrange(12)}", f"s{rnd.randrange(10)}") for _ in range(45)})
    sets = {}
    for a, b in edges:
        sets.setdefault(b, set()).add(a)
    df = spark.createDataFrame(edges, "src string, dst string")
    for theta in (0.3, 0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= theta - 1e-12}
        got = {(r["a"], r["b"]) for r in impact.consumer_similarity(df, theta).collect()}
        assert got <= want and {p for p in want - got if sets[p[0]] != sets[p[1]]} == set()


def test_what_if(spark):
    e = spark.createDataFrame([("A", "B", 1, 3, 1), ("A", "C", 1, 2, 1), ("B", "C", 1, 5, 1), ("C", "D", 1, 1, 1)], "src string, dst string, weight int, call_sites int, loc_surface int")
    c = spark.createDataFrame([("A", 100, 2), ("B", 200, 1), ("C", 150, 3), ("D", 80, 1)], "name string, loc int, n_symbols int")
    r = impact.what_if(e, c, [{"delete": "B"}])
    assert r["components"].count() == 3 and rows(r["edge_diff"]) == [("A", "B", "removed"), ("B", "C", "removed")]
    m = impact.what_if(e, c, [{"rename": "B", "to": "C"}])
    assert ("C", 350, 4) in rows(m["components"]) and rows(m["edges"], "src", "dst", "call_sites") == [("A", "C", 5), ("C", "D", 1)]
    nothing = impact.what_if(e, c, [])
    assert nothing["edges"].count() == 4 and nothing["edge_diff"].isEmpty()


def test_component_queries_read_all_pairs(spark):
    import __spark_entry__ as e
    from stratagraph.plans import bind

    d, q = "/root/testdata/sf0.001", e.queries()
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    whole = {(r["src"], r["dst"]) for r in bind._nation_pairs(spark, d).collect()}
    assert {(r["src"], r["dst"]) for r in q["component_edges"](spark, d).collect()} == whole
    assert q["dependencies"](spark, d).count() == sum((a == "NATION_3") + (b == "NATION_3") for a, b in whole)
