"""Operators on small tables: ties, unknowns, cycles, streams."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import asof, constraint, graph, interval, match, rank, state
from ferrule.streaming import object_state


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_interval_ties(spark):
    points = spark.createDataFrame([("f", 1, 5), ("f", 2, 50)], "file string, id int, line int")
    spans = spark.createDataFrame([("f", "outer", 1, 100, 1), ("f", "inner", 4, 6, 2), ("f", "late", 1, 99, 3)], "file string, name string, lo int, hi int, seq int")
    pick = lambda tie: rows(interval.owner(points, spans, ["file"], ["id"], "line", "lo", "hi", 10, tie, "seq"), "id", "name")
    assert pick("last") == [(1, "late"), (2, "late")]
    assert pick("first") == [(1, "outer"), (2, "outer")]
    assert pick("innermost") == [(1, "inner"), (2, "late")]


def test_asof_tie_takes_the_later_definition(spark):
    use = spark.createDataFrame([("s", 10, "a"), ("s", 1, "b"), (None, 5, "c")], "scope string, line int, tag string")
    defs = spark.createDataFrame([("s", 10, 1, 7), ("s", 10, 2, 8), ("s", 11, 3, 9)], "scope string, at int, seq int, v int")
    assert rows(asof.backward(use, defs, ["scope"], "line", "at", ["v"], "seq"), "tag", "v") == [("a", 8), ("b", None), ("c", None)]


def test_best_or_null(spark):
    t = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, "x", 5), (2, "x", 5), (3, "z", 1)], "k int, a string, s int")
    assert rows(rank.best_or_null(t, ["k"], F.col("s"), "a", F.col("a")), "k", "a") == [(1, None), (2, "x"), (3, "z")]


def test_cycles_end(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    one = spark.createDataFrame([(1,)], "node int")
    assert rows(graph.closure(e, one, 8), "node", "depth") == [(2, 1), (3, 2), (4, 3)]
    assert rows(graph.components(e), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    four = spark.createDataFrame([(4,)], "node int")
    assert rows(graph.shortest_paths(e, one, four, 2, 8), "path", "length") == [("1>2>3>4", 3)]


def test_band_nearest_reads_no_frame_anew(spark):
    rng = random.Random(9)
    at = [-28801, -28800, -1, 0, 5, 28799, 28800, 57600] + [rng.randrange(-90_000, 90_000) for _ in range(60)]
    left = [(i, rng.choice(at), rng.randrange(5)) for i in range(150)] + [(900, None, 1), (901, 10**7, 1)]
    right = [(rng.randrange(1000), rng.choice(at), rng.randrange(6)) for _ in range(80)] + [(7, None, 1)]
    a, b = spark.createDataFrame(left, "id long, at long, key long"), spark.createDataFrame(right, "value long, at long, key long")
    got = interval.band_nearest(a, b, "id", "at", 9000, "key", "value")
    expect = []
    for i, t, k in left:
        near = [(k2 != k, abs(t2 - t), v) for v, t2, k2 in right if t is not None and t2 is not None and abs(t2 - t) <= 9000]
        if near:
            expect.append((i, t, k, not min(near)[0], min(near)[2]))
    assert rows(got, "id", "at", "key", "preferred", "value") == sorted(expect, key=repr)
    # Spark reads a frame that ends at its partition's end anew for each row: time by the square of a bin
    plan = got._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def _first_paths(edges, k, depth):
    """Every root's first path to each node, level by level, without any bound; then the k first of each node."""
    starts = {a for a, _ in edges} - {b for _, b in edges}
    seen = {(r, r): (r,) for r in starts}
    front = dict(seen)
    for _ in range(depth):
        step = {}
        for (r, at), p in front.items():
            for a, b in edges:
                if a == at and (r, b) not in seen:
                    step[r, b] = min(step.get((r, b), (*p, b)), (*p, b), key=">".join)
        seen |= step
        front = step
    out = {}
    for (_, at), p in seen.items():
        out.setdefault(at, []).append(p)
    return {at: sorted(ps, key=lambda p: (len(p), ">".join(p)))[:k] for at, ps in out.items()}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_prefixes_are_the_first_of_all(spark, k):
    rng = random.Random(k)
    edges = {(f"c{rng.randrange(12)}", f"s{rng.randrange(15)}") for _ in range(25)} | {(f"s{rng.randrange(15)}", f"s{rng.randrange(15)}") for _ in range(25)} | {(f"s{i}", f"n{i % 3}") for i in range(15)}
    vias = {b for _, b in edges} | {"c1", "nowhere"}
    got = {}
    for via, path in rows(graph.prefixes(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(v,) for v in vias], "node string"), k, 4), "via", "path"):
        got.setdefault(via, set()).add(tuple(path))
    assert got == {v: set(p) for v, p in _first_paths(edges, k, 4).items() if v in vias}


def test_prefixes_keep_k_roots_of_a_node(spark, monkeypatch):
    kept, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := write(df), kept.append(out))[0])
    edges = [(f"c{i}", "s0") for i in range(40)] + [("s0", f"s{j}") for j in range(1, 21)] + [(f"s{j}", "n0") for j in range(1, 21)]
    got = rows(graph.prefixes(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n0",)], "node string"), 2, 3), "via", "path")
    assert got == [("n0", ["c0", "s0", "s10", "n0"]), ("n0", ["c10", "s0", "s10", "n0"])]
    assert max(t.count() for t in kept[2:]) <= 2 * 20


def test_aliases_stop_at_cycles(spark):
    d = spark.createDataFrame([("f", "a", "b"), ("f", "b", "16"), ("f", "x", "y"), ("f", "y", "x")], "scope string, name string, value string")
    got = dict((n, v) for n, v in rows(graph.expand_alias(d), "name", "value"))
    assert got["a"] == "16" and got["b"] == "16" and got["x"] in ("x", "y")


def test_derive(spark):
    t = spark.createDataFrame([("GEQ", 3072, "keylen*8"), ("GEQ", 3072, "n+10"), ("GEQ", 3072, "f(n)"), ("LEQ", 10, "n/8"), ("GEQ", 1, "5")], "p string, t long, arg string")
    got = constraint.derive(t, "p", "t", "arg").select("derived", "confidence").collect()
    assert [tuple(r) for r in got] == [(384, "confirmed"), (3062, "confirmed"), (None, "suspect"), (87, "confirmed"), (None, "none")]


def test_contract_order_decides(spark):
    t = spark.createDataFrame([(1, 1, True), (1, 2, None), (2, 1, None), (2, 2, False), (3, 1, False), (3, 2, None), (4, 1, True)], "k int, s int, ok boolean")
    assert rows(constraint.contract_status(t, ["k"], F.col("ok"), "s"), "k", "status") == [(1, "UNKNOWN"), (2, "UNKNOWN"), (3, "UNSAT"), (4, "SAT")]


def test_conflicts(spark):
    t = spark.createDataFrame([("p", "a", "GEQ", 2048), ("p", "b", "LEQ", 512), ("p", "c", "EQ", 128), ("p", "d", "NEQ", 128)], "param string, id string, predicate string, value long")
    assert rows(constraint.conflicts(t, "param"), "id_a", "id_b") == [("a", "b"), ("a", "c"), ("c", "d")]


def test_wrapper_strategies(spark):
    a, w = spark.createDataFrame([("f", 1)], "k string, v int"), spark.createDataFrame([("f", 2), ("g", 3)], "k string, v int")
    assert rows(match.merge_wrappers(a, w, "k"), "k", "v") == [("f", 1), ("g", 3)]
    assert rows(match.merge_wrappers(a, w, "k", "wrapper_first"), "k", "v") == [("f", 2), ("g", 3)]
    assert match.merge_wrappers(a, w, "k", "both").count() == 3


def test_state_merge(spark):
    a = spark.createDataFrame([(1, ["x"], 0.8), (2, ["y"], 0.5)], "k int, values array<string>, confidence double")
    b = spark.createDataFrame([(1, ["z"], 1.0), (3, ["q"], 0.4)], "k int, values array<string>, confidence double")
    got = rows(state.merge_states(a, b, ["k"]).withColumn("confidence", F.round("confidence", 3)), "k", "values", "confidence")
    assert got == [(1, ["x", "z"], 0.72), (2, ["y"], 0.5), (3, ["q"], 0.4)]


def test_alias_resolution(spark):
    c = spark.createDataFrame([("f", "np.load"), ("f", "ld"), ("g", "np.load")], "file string, symbol string")
    a = spark.createDataFrame([("f", "np", "numpy"), ("f", "ld", "numpy.load")], "file string, alias string, target string")
    assert rows(match.resolve_alias(c, a, "file", "symbol"), "resolved") == [("np.load",), ("numpy.load",), ("numpy.load",)]


@pytest.mark.parametrize("maker,rows_", [("current_state", 2), ("windows", 2)])
def test_stream(spark, tmp_path, maker, rows_):
    t = spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:00', 7L, 'a', 1.0D), (2L, timestamp'2024-01-01 01:00:00', 7L, 'a', 2.0D), (3L, timestamp'2024-01-01 00:30:00', 7L, 'b', 3.0D) as t(event_id, ts, user_id, event_type, value)")
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    out = getattr(object_state, maker)(stream)
    mode = "update" if maker == "current_state" else "complete"
    q = out.writeStream.format("memory").queryName(f"out_{maker}").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql(f"select * from out_{maker}").collect()
    assert len(got) == rows_
    if maker == "current_state":
        assert {r.event_type: r.value for r in got} == {"a": 2.0, "b": 3.0}
