import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import heavy_keys, orphans, radix_select, snapshot_diff

T0 = dt.datetime(2025, 1, 1)
COMP = "snapshot_no int, project string, name string, package string, trust_zone string, symbols array<struct<name:string,kind:string,exported:boolean,signature:string>>, churn int, loc int, max_nesting int, delivered_at timestamp_ntz, h int, side string"
LOG = "project string, snapshot_no int, status string, later int"


def comp(no, name, loc=1, symbols=(), at=0, project="p"):
    return (no, project, name, "k", None, [(s, "f", True, sig) for s, sig in symbols] if symbols is not None else None, None, loc, None, T0 + dt.timedelta(days=at), 9, "x")


def changes(spark, rows, log):
    c = spark.createDataFrame(rows, COMP)
    return sorted(tuple(r) for r in snapshot_diff.snapshot_changes(c, spark.createDataFrame(log, LOG)).collect())


def test_snapshot_changes(spark):
    log = [("p", 1, "complete", 0), ("p", 2, "aborted", 0), ("p", 3, "complete", 0), ("p", 4, "complete", 0)]
    rows = [
        comp(1, "a", 1, [("f", "()"), ("g", None)]),
        comp(1, "b", None),
        comp(2, "zzz"),
        comp(3, "a", 1, [("g", None), ("f", "(int)"), ("f", "(int)")]),
        comp(3, "c", 5, None),
        comp(3, "c", 6, [("h", "")], at=9),
        comp(3, "b", None),
        comp(3, "b", None),
        comp(4, "c", 6, [("h", "")]),
        comp(4, None, 6),
    ]
    assert changes(spark, rows, log) == [
        ("component", 3, "p", "c", "added"),
        ("component", 4, "p", "a", "removed"),
        ("component", 4, "p", "b", "removed"),
        ("symbol", 3, "p", "a.f", "changed"),
        ("symbol", 3, "p", "c.h", "added"),
        ("symbol", 4, "p", "a.f", "removed"),
        ("symbol", 4, "p", "a.g", "removed"),
    ]
    assert changes(spark, [], log) == [] and changes(spark, rows, []) == []
    # A complete snapshot without rows removes everything.
    assert ("component", 5, "p", "c", "removed") in changes(spark, rows, [*log, ("p", 5, "complete", 0)])


def test_null_equals_only_null(spark):
    a, b = list(comp(1, "a")), list(comp(2, "a"))
    a[6], b[8] = 3, 3  # churn 3 and no nesting against no churn and nesting 3
    assert changes(spark, [tuple(a), tuple(b)], [("p", 1, "complete", 0), ("p", 2, "complete", 0)]) == [("component", 2, "p", "a", "changed")]


def test_target_names(spark):
    cases = {
        "a/b-c/d.X": "a/b-c/d.X", "*a/b.X": "a/b.X", "[]*a/b.X": "a/b.X", "map[string]a/b.X": "a/b.X", "map[int64][]*a/b.X": "a/b.X", "Vec<a/b.X>": "a/b.X", "Promise<a/b.X[]>": "a/b.X", "a/b.X | null": "a/b.X", "a/b.X[T]": "a/b.X",
        "a/b.X<K, V>": "a/b.X", "chan a/b.X": "a/b.X", "const a/b.X *": "a/b.X", "  a/b.X ": "a/b.X", "&a/b.X": "a/b.X", "Option<Bare>": "Bare", "Bare": "Bare", "  ": None, "": None, "string": "string",
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r["raw"]: r["t"] for r in df.select("raw", orphans.target_name(F.col("raw")).alias("t")).collect()}
    assert got == cases


def test_orphans_against_brute_force(spark):
    rnd = random.Random(5)
    day = lambda n: T0 + dt.timedelta(days=n, hours=rnd.randrange(24))
    names = [f"o/p/q.N{i}" for i in range(30)]
    syms = []
    for n in names[:20]:
        a = rnd.randrange(60)
        syms.append(("o/p/q", n.split(".")[1], day(a), day(a + rnd.randrange(1, 60)) if rnd.random() < 0.6 else None, 1))
        if rnd.random() < 0.3:
            syms.append(("o/p/q", n.split(".")[1], day(a + 70), None, 1))
    syms += syms[:3] + [(None, "Bare", day(0), None, 1), ("", None, day(0), None, 1), ("o/p/q", "N1", None, None, 1)]
    calls = [(i, rnd.choice([*names, "Bare", "plat.X", None, *[names[0]] * 40]), day(rnd.randrange(120)) if i % 50 else None, "z") for i in range(600)]
    calls += calls[:20]
    decl = [(f"{p}.{n}" if p else n, a, b) for p, n, a, b, _ in syms if n and a] + [("plat.X", dt.datetime(1, 1, 1), None)]
    want = sorted({("calls", i) for i, f, t, _ in calls if f and t and not any(k == f and a <= t and (b is None or b > t) for k, a, b in decl)})
    c = spark.createDataFrame(calls, "call_id long, callee string, loaded_at timestamp_ntz, period string")
    s = spark.createDataFrame(syms, "package string, name string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, fqn int")
    p = spark.createDataFrame([("plat.X",)], "fqn string")
    empty_i = spark.createDataFrame([], "edge_id long, to_name string, loaded_at timestamp_ntz")
    empty_f = spark.createDataFrame([], "ref_id long, ref_type string, loaded_at timestamp_ntz")
    got = sorted((r["tab"], r["ref_id"]) for r in orphans.orphans(empty_i, empty_f, c, s, p).collect())
    assert got == want and want
    assert orphans.orphans(empty_i, empty_f, c.limit(0), s, p).isEmpty()
    assert orphans.orphans(empty_i, empty_f, c, s.limit(0), p.limit(0)).count() == len({i for i, f, t, _ in calls if f and t})


def test_percentiles(spark):
    rnd = random.Random(7)
    doubles = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 1.0, -1.0, 0.1, math.pi, 2.0**-1022, 2.0**52 + 0.5]
    rows = [("d", x) for x in doubles] + [("d", rnd.uniform(-1e6, 1e6)) for _ in range(300)] + [("d", 10.0 ** rnd.uniform(-300, 300)) for _ in range(100)] + [("d", None), ("d", float("nan")), (None, 3.0), ("e", None)]
    df = spark.createDataFrame(rows, "grp string, v double")
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {(r["grp"], r["p"]): r["value"] for r in radix_select.percentiles(df, "grp", "v", ps).collect()}
    vals = sorted(x for g, x in rows if g == "d" and x is not None and x == x)
    for p in ps:
        assert got["d", p] == vals[max(1, math.ceil(p * len(vals))) - 1], p
    assert got[None, 0.5] == 3.0 and ("e", 0.5) not in got
    ints = [rnd.choice([-(2**63), 2**63 - 1, 0, -1, 1, rnd.randrange(-(10**12), 10**12)]) for _ in range(200)]
    di = spark.createDataFrame([("a", x) for x in ints], "k string, x long")
    gi = {r["p"]: r["value"] for r in radix_select.percentiles(di, "k", "x", ps).collect()}
    assert gi == {p: sorted(ints)[max(1, math.ceil(p * 200)) - 1] for p in ps}
    assert radix_select.percentiles(di.limit(0), "k", "x", ps).isEmpty()


def test_sketches_combine(spark):
    rnd = random.Random(9)
    rows = [("g", i % 5, rnd.choice([-1, 1]) * 10 ** rnd.uniform(-3, 6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    got = {r["p"]: r["value"] for r in radix_select.combine(radix_select.sketch(df, "g", "day", "v"), (0.1, 0.5, 0.99)).collect()}
    vals = sorted(r[2] for r in rows)
    for p, v in got.items():
        exact = vals[max(1, math.ceil(p * len(vals))) - 1]
        assert abs(v - exact) <= abs(exact) * 2.0**-12


def test_heavy_names(spark):
    calls = [("hub", f"c{i}", "p", 1, T0, 0) for i in range(60)] + [(None, "c1", "p", None, T0, 0)] * 40 + [("rare", None, "p", 2, None, 0)]
    df = spark.createDataFrame(calls, "callee string, caller string, package string, line int, seen_at timestamp_ntz, n int")
    assert sorted(map(tuple, heavy_keys.heavy_names(df, 0.4).collect())) == [("callee", "hub"), ("caller", "c1")]
    s = {(r["field"], r["fqn"]): r for r in heavy_keys.name_stats(df).collect()}
    assert s["callee", "hub"]["partners"] == 60 and s["callee", "rare"]["partners"] == 0 and s["caller", "c1"]["n"] == 41
    assert heavy_keys.heavy_names(df.limit(0)).isEmpty()


def test_lookup_ways_agree(spark):
    from stratagraph.runtime import global_rank, lookup

    rows = spark.createDataFrame([(i, "hot" if i % 3 else None, i) for i in range(200)] + [(900, "none", 1)], "id int, k string, v int")
    table = spark.createDataFrame([("hot", 1), (None, 2)], "k string, w int")
    a, b = (sorted(map(tuple, lookup(rows, table, ["k"], "id", limit=n).select("id", "w").collect())) for n in (10, 0))
    assert a == b and (900, None) in a and (0, 2) in a and (1, 1) in a
    ranked = global_rank(rows, ["v", "id"], "n").select("id", "v", "n").collect()
    assert [r["n"] for r in sorted(ranked, key=lambda r: (r["v"], r["id"]))] == list(range(1, 202))


def test_combined_sketches_hold_all_measures(spark):
    import os

    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    exact = {(r["measure"], r["grp"], r["p"]) for r in e.queries()["p4_percentiles"](spark, d).collect()}
    assert {(r["measure"], r["grp"], r["p"]) for r in e.queries()["p4_combined"](spark, d).collect()} == exact
