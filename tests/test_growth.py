"""Queries and steps whose results or sizes went wrong on larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrydeck.functions import text as T


def against_sql(spark, name, folder, tables):
    """The rows of a query and those of its SQL over the same tables."""
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    want = db.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_names_with_letters_that_upper_case_makes_longer(spark, tmp_path):
    texts = ["Erßie zwei drei.", "ﬁn is this here", "ᾳb of it all", "ŉa and so on", "ΑΣ ends here now", "İx is dotted too", "plain words here"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    duckdb.execute(f"copy (select * from '{tmp_path}/benchmark.parquet/*.parquet') to '{tmp_path}/b.parquet' (format parquet)")
    (tmp_path / "one").mkdir()
    (tmp_path / "b.parquet").rename(tmp_path / "one/benchmark.parquet")
    got, want = against_sql(spark, "e53_names_and_docs", f"{tmp_path}/one", ["benchmark"])
    assert got == want


def test_simple_case_against_duckdb(spark):
    every = [chr(c) for c in range(1, 0x2FFFF) if not 0xD800 <= c <= 0xDFFF and (chr(c).upper() != chr(c) or chr(c).lower() != chr(c)) and c < 0x500]
    got = spark.createDataFrame([(c,) for c in every], "c string").select("c", T.upper(F.col("c")), T.lower(F.col("c"))).collect()
    assert [tuple(r) for r in got] == duckdb.execute("select c, upper(c), lower(c) from (select unnest(?) as c)", [every]).fetchall()


@pytest.fixture(scope="module")
def plans(spark):
    return lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_a_map_broadcasts_no_table_of_its_files(spark, plans):
    from quarrydeck.plans import reviews

    m = reviews._map(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plans(m.orphans())
    rules = plans(m.ranked).count("BroadcastHashJoin [language")
    assert plans(m.ranked).count("BroadcastHashJoin") == rules
    assert m.parsed.rdd.getNumPartitions() > 1


def sets(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(60), f"s{rng.randrange(40)}") for _ in range(260)] + [(100 + k // 2, f"t{k % 2}") for k in range(8)] + [(200, "s1"), (201, "t0"), (None, "s1"), (5, None)]
    return rows, spark.createDataFrame(rows, "item long, g string")


def test_co_change_makes_its_pairs_without_moving_them(spark, plans):
    from quarrydeck.operators import changes

    rows, df = sets(spark)
    for most in (None, 5):
        by = {}
        for item, g in rows:
            by.setdefault(g, set()).add(item)
        n = {}
        for items in by.values():
            items = sorted(i for i in items if i is not None)
            if most is None or len(items) <= most:
                for k, a in enumerate(items):
                    for b in items[k + 1 :]:
                        n[a, b] = n.get((a, b), 0) + 1
        got = changes.co_change(df, "g", "item", 2, most)
        assert sorted(map(tuple, got.collect())) == sorted((a, b, k) for (a, b), k in n.items() if k >= 2)
        above = plans(got).split("Generate explode(y")[0]  # what comes after the pairs are made
        assert "Exchange" not in above


def test_components_of_co_change_without_its_pairs(spark):
    from quarrydeck.operators import changes, graph

    _, df = sets(spark)
    want = graph.components(changes.co_change(df, "g", "item", 2).select(F.col("a").alias("src"), F.col("b").alias("dst"))).collect()
    assert sorted(map(tuple, changes.co_components(df, "g", "item").collect())) == sorted(map(tuple, want))
    assert len({r["component"] for r in want}) > 1


def test_served_results_are_kept_once_for_all_that_ask(spark, tmp_path):
    from quarrydeck.streaming import requests

    made = {
        "symbols": spark.createDataFrame([("f.go", "A", "function", 1, 1)], "path string, name string, kind string, line int, end_line int"),
        "components": spark.createDataFrame([("f.go", f"c{k}", k) for k in range(500)], "path string, component string, value long"),
        "files": spark.createDataFrame([("f.go", "x")], "path string, content string"),
    }
    requests.publish(spark, made, f"{tmp_path}/map", 1)
    asks = [f'{{"id": {k}, "method": "file/explain", "params": {{"path": "{"f.go" if k % 2 else "none.go"}"}}}}' for k in range(60)]
    spark.createDataFrame([(a,) for a in asks], "value string").write.text(f"{tmp_path}/inbox")
    requests.serve(spark, f"{tmp_path}/inbox", f"{tmp_path}/map", f"{tmp_path}/out", f"{tmp_path}/state", results=f"{tmp_path}/results").awaitTermination()
    out, kept = spark.read.parquet(f"{tmp_path}/out"), spark.read.parquet(f"{tmp_path}/results")
    assert "result" not in out.columns and kept.where("method = 'file/explain'").count() == kept.select("batch").distinct().count()
    assert sorted((int(r["id"]), r["code"]) for r in out.collect()) == [(k, None if k % 2 else requests.FAILED) for k in range(60)]
    want = {(r["method"], r["asked"]): r["result"] for r in kept.collect()}
    whole = requests.answers(spark.createDataFrame([(a,) for a in asks], "value string"), made, 1).where("code is null")
    assert {r["result"] for r in whole.collect()} == {want["file/explain", "f.go"]}


@pytest.mark.parametrize("most", [100_000, 0])
def test_implementations_move_no_pairs(spark, plans, monkeypatch, most):
    import random

    from quarrydeck.operators import callers

    monkeypatch.setattr(callers, "BROADCAST_NEEDS", most)
    rng = random.Random(9)
    have = [(f"t{rng.randrange(30)}", f"m{rng.randrange(9)}") for _ in range(200)] + [("i1", "m0")]
    need = [(f"i{rng.randrange(40)}", f"m{rng.randrange(9)}") for _ in range(90)]
    methods, required = {}, {}
    for t, m in have:
        methods.setdefault(t, set()).add(m)
    for i, m in need:
        required.setdefault(i, set()).add(m)
    got = callers.implementations(spark.createDataFrame(have, "type string, method string"), spark.createDataFrame(need, "interface string, method string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, i) for t, ms in methods.items() for i, ns in required.items() if ns <= ms and t != i)
    if most:
        assert "Exchange hashpartitioning(type" not in plans(got).split("BroadcastHashJoin [method")[0]


def test_tags_are_parsed_and_moved_once(spark, plans):
    import json

    from quarrydeck.sources import tags

    tag = lambda **x: json.dumps({"_type": "tag", **x})
    lines = [tag(name="A", path="f", kind="class", line=1), tag(name="y", path="f", kind="field", scope="A", line=3), tag(name="x", path="f", kind="field", scope="A", line=2), tag(name="A", path="f", kind="function", signature="(a)", line=9), tag(name="B", path="f", kind="class", line=5), tag(name="C", kind="class", line=1), tag(name="z", kind="field", scope="C", line=2), "no json", tag(name="", path="f", kind="class"), None]
    got = tags.tag_symbols(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("f", "A", "class", "{x, y}", "", 1), ("f", "A", "function", "(a)", "", 9), ("f", "B", "class", "", "", 5), (None, "C", "class", "", "", 1)], key=repr)
    assert plans(got).count("Exchange ") == 1 and "Join" not in plans(got)


def test_relevance_moves_each_pair_of_goal_and_path_once(spark, plans, monkeypatch):
    from quarrydeck.operators import packets

    files = spark.createDataFrame([("a", "red ring red", "ring"), ("b", "blue", "none"), ("c", None, "red")], "path string, content string, package string")
    terms = spark.createDataFrame([(1, "red"), (1, "ring"), (2, "red"), (2, "x")], "goal long, term string")
    want = [(1, "a", 11), (1, "c", 5), (2, "a", 3), (2, "c", 5)]
    got = packets.relevance(files, terms, {"content": 3, "package": 5})
    assert sorted(map(tuple, got.collect())) == want
    assert plans(got).count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(packets, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, packets.relevance(files, terms, {"content": 3, "package": 5}).collect())) == want


def test_files_of_lines_are_gathered_once(spark, plans):
    from quarrydeck.plans import program

    assert "lineitem" not in plans(program._masked(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("most", [1_000_000, 20, 0])
def test_method_sets_move_what_is_declared_once_a_block(spark, plans, monkeypatch, most):
    import test_dispatch as td

    from quarrydeck.operators import dispatch

    monkeypatch.setattr(dispatch, "BLOCK_ROWS", most)
    monkeypatch.setattr(dispatch, "CELLS", 40)
    methods, embeds, fields = td.program(6)
    embeds += [(f"U{k}", "T1", False) for k in range(20)]
    got = dispatch.method_sets(spark.createDataFrame(methods, td.METHODS), spark.createDataFrame(embeds, td.EMBEDS), spark.createDataFrame(fields, "type string, name string"))
    rows = [tuple(r) for r in got.select("type", "name", "signature", "owner", "depth", "by_pointer").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == td.set_loop(methods, embeds, fields)
    if most == 1_000_000:
        assert "hashpartitioning(root" not in plans(got) and "hashpartitioning(type#" not in plans(got).split("hashpartitioning(block")[0]


@pytest.mark.parametrize("wide, most", [(2_000, 2), (2_000, 5), (1, 5)])
def test_types_meet_only_interfaces_whose_pairs_they_have(spark, plans, monkeypatch, wide, most):
    import random

    from quarrydeck.operators import dispatch

    monkeypatch.setattr(dispatch, "WIDE", wide)
    rng = random.Random(7)
    sets = [(f"T{t}", f"m{m}", rng.choice(["a", "b"]), rng.random() < 0.3) for t in range(30) for m in rng.sample(range(12), rng.randrange(8))]
    required = [(f"I{i}", f"m{rng.randrange(12)}", rng.choice(["a", "b", None])) for i in range(80) for _ in range(1 + i % most)]
    has, need = {}, {}
    for t, m, s, p in sets:
        has.setdefault(t, {})[m, s] = p
    for i, m, s in required:
        need.setdefault(i, set()).add((m, s or ""))
    want = sorted((t, i, not any(ms[x] for x in xs)) for t, ms in has.items() for i, xs in need.items() if xs <= set(ms))
    got = dispatch.satisfying(spark.createDataFrame(sets, "type string, name string, signature string, by_pointer boolean"), spark.createDataFrame(required, "interface string, name string, signature string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    assert most > 2 or wide < 9 or "MapInArrow" in plans(got)


def test_runs_of_empty_lines_are_told_once():
    from quarrydeck.functions import parsing

    text = "\n" * 30 + "package p\n" + "\n" * 5000 + "// A does\n\n// it.\nfunc A(\n\n\n\n\n\n\n\n\n\n\n\ta int,\n) {\n" + "\n" * 20 + "}\n\n\ntype B struct {\n\tX int\n}\n" + "\n" * 40
    lines = text.split("\n")
    told = list(parsing._logical(text, lines, parsing.code_lines(text, "go"), "go", parsing._runs(text)))
    assert len(told) < 30 and all(lines[n - 1] == line for n, line, _ in told if "func" not in line)
    found = [(s["name"], s["signature"], s["line"], s["end_line"], s["doc"]) for s in parsing.parse("go", text).symbols]
    at = lines.index("func A(") + 1
    assert found == [("A", "(a int)", at, at + 33, "it."), ("B", "{X int}", lines.index("type B struct {") + 1, lines.index("type B struct {") + 3, "")]
    assert parsing.parse("go", "/* a" + "\n" * 12 + "b */\nfunc C() {}\n").symbols[0]["line"] == 14


def test_files_made_from_rows_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    from quarrydeck import session

    assert session.dealt(spark.range(100), "id").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "DEALT_ROWS", 2)
    assert session.dealt(spark.range(100), "id").rdd.getNumPartitions() == 50


@pytest.mark.parametrize("rows, cells", [(50_000, 2_000_000), (1, 1), (7, 100)])
def test_implementations_are_counted_without_a_table_of_pairs(spark, plans, monkeypatch, rows, cells):
    import random

    from quarrydeck.operators import callers

    monkeypatch.setattr(callers, "TYPE_ROWS", rows)
    monkeypatch.setattr(callers, "CELLS", cells)
    rng = random.Random(4)
    have = [(f"t{rng.randrange(25)}", f"m{rng.randrange(9)}") for _ in range(300)] + [("i1", "m0"), ("i1", "m1"), ("i1", "m2"), (None, "m1"), ("t1", None), ("t2", "other")]
    need = [(f"i{rng.randrange(40)}", f"m{rng.randrange(9)}") for _ in range(90)] + [("i1", "m0"), ("n", None), ("n", "m1"), (None, "m1"), ("only", None)]
    got = callers.implementations(spark.createDataFrame(have, "type string, method string").repartition(3), spark.createDataFrame(need, "interface string, method string"))
    methods, required = {}, {}
    for t, m in have:
        methods.setdefault(t, set()).add(m)
    for i, m in need:
        required.setdefault(i, set()).add(m)
    want = sorted((t, i) for t, ms in methods.items() for i, ns in required.items() if t and i and None not in ns and ns <= ms and t != i)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert not [x for x in plans(got).splitlines() if "Aggregate(keys=[type" in x and "interface" in x]
    empty = spark.createDataFrame([], "interface string, method string")
    assert callers.implementations(spark.createDataFrame(have, "type string, method string"), empty).count() == 0


@pytest.mark.parametrize("most, seed", [(1_000_000, 1), (60, 3), (0, 4)])
def test_blocks_tell_what_is_satisfied_and_called_without_method_sets(spark, monkeypatch, most, seed):
    import random

    import test_dispatch as td

    from quarrydeck.operators import dispatch

    monkeypatch.setattr(dispatch, "BLOCK_ROWS", most)
    monkeypatch.setattr(dispatch, "BLOCK_TYPES", 10)
    rng = random.Random(seed)
    methods, embeds, fields = td.program(seed)
    methods += [(f"T{rng.randrange(30)}", f"m{k % 12}", "()", False) for k in range(60)]
    required = [(f"I{i}", f"m{rng.randrange(12)}", rng.choice(["()", "(int)", None])) for i in range(40) for _ in range(1 + i % 3)] + [("I1", None, "()"), (None, "m1", "()")]
    calls = [(f"f{rng.randrange(12)}", f"I{rng.randrange(42)}", f"m{rng.randrange(13)}", True) for _ in range(150)] + [(f"f{rng.randrange(12)}", i, n, True) for i, n, _ in required]
    calls += [(f"f{rng.randrange(12)}", f"T{rng.randrange(31)}", f"m{rng.randrange(13)}", rng.choice([False, None])) for _ in range(150)] + [(None, "T1", "m1", False), (None, "I2", "m1", True), ("f1", None, "m1", True)]
    built = spark.createDataFrame([(f"T{i}",) for i in range(0, 30, 2)], "type string")
    m, e, f = spark.createDataFrame(methods, td.METHODS), spark.createDataFrame(embeds, td.EMBEDS), spark.createDataFrame(fields, "type string, name string")
    r, c = spark.createDataFrame(required, "interface string, name string, signature string"), spark.createDataFrame(calls, "caller string, receiver string, name string, dynamic boolean")
    have, need = {}, {}
    for t, n, s, o, _, p in td.set_loop(methods, embeds, fields):
        have.setdefault(t, {})[n] = (s, o, p)
    for i, n, s in required:
        need.setdefault(i, set()).add((n, s or ""))
    ok = {(t, i): not any(xs[n][2] for n, _ in ns) for t, xs in have.items() for i, ns in need.items() if i and all(n in xs and xs[n][0] == s for n, s in ns)}
    got = dispatch.satisfied(m, e, r, f)
    assert sorted(map(tuple, got.collect())) == sorted((t, i, by) for (t, i), by in ok.items()) and len(ok) > 30
    for some in (built, None):
        made = {f"T{i}" for i in range(0, 30, 2)} if some is not None else set(have)
        runs = {(x, t, n, have[t][n][1], i) for x, i, n, dyn in calls if dyn for t, j in ok if i == j and t in made and n in have[t]}
        runs |= {(x, t, n, have[t][n][1], None) for x, t, n, dyn in calls if not dyn and n in have.get(t, ())}
        want = {}
        for x, t, n, o, i in runs:
            for k, v in enumerate((x, t, i)):
                want.setdefault((o, n), (set(), set(), set()))[k].update({v} - {None})
        got = dispatch.dispatched_counts(c, m, e, r, f, some)
        assert sorted(map(tuple, got.collect())) == sorted((*k, *map(len, v)) for k, v in want.items()) and len(want) > 30


@pytest.mark.parametrize("name", ["e97_satisfied", "e98_dispatched"])
def test_no_method_sets_are_moved_to_be_compared(spark, plans, name):
    folder = "/root/testdata/sf0.001"
    got = entry.queries()[name](spark, folder)
    above = plans(got).split("FlatMapGroupsInArrow")[0]
    assert "ScanExistingRDD" not in above and "Exchange hashpartitioning(type" not in above and "FlatMapGroupsInArrow" in plans(got)
    got, want = against_sql(spark, name, folder, ["part", "lineitem", "orders"])
    assert got == want and len(got) > 100


@pytest.mark.parametrize("kind", ["long", "string"])
def test_co_change_counts_where_the_pairs_are(spark, plans, monkeypatch, kind):
    import random
    from itertools import combinations

    import pyarrow as pa

    from quarrydeck.operators import changes

    monkeypatch.setattr(changes, "BLOCK_ITEMS", 12)
    rng = random.Random(3)
    name = int if kind == "long" else (lambda k: f"ü{k}")
    rows = [(name(k), f"g{g}") for g in range(30) for k in rng.sample(range(150), rng.choice([1, 3, 60, 140]))]
    n = {}
    for g in {g for _, g in rows}:
        for p in combinations(sorted({i for i, x in rows if x == g}, key=lambda i: i if kind == "long" else i.encode()), 2):
            n[p] = n.get(p, 0) + 1
    got = changes.co_change(spark.createDataFrame(rows + rows[:50] + [(None, "g1")], f"item {kind}, g string").repartition(5), "g", "item", 4)
    assert sorted(map(tuple, got.collect())) == sorted((*p, k) for p, k in n.items() if k >= 4)
    for kept, cells in ((1, 1), (50, 30)):
        monkeypatch.setattr(changes, "KEPT", kept)
        monkeypatch.setattr(changes, "CELLS", cells)
        cell, some = changes._Cell(False), {}
        for k in range(0, 30, 3):
            xs, ys = ([[name(rng.randrange(9) + 9 * side) for _ in range(1)] + [name(20 + side)] for _ in range(3)] for side in (0, 1))
            for x, y in zip(xs, ys, strict=True):
                for p in ((a, b) for a in x for b in y):
                    some[p] = some.get(p, 0) + 1
            cell.add(pa.array(xs), pa.array(ys))
        found = {(r["u"], v): r["n"] for b in cell.pairs(2) for r in b.to_pylist() for v in r["y"]}
        assert found == {p: k for p, k in some.items() if k >= 2}
    assert "Aggregate" not in plans(got).split("MapInArrow")[0] and got.schema["n"].dataType.simpleString() == "bigint"
