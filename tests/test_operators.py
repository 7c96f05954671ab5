"""Operators on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from quarrydeck.functions import classify, text as T
from quarrydeck.operators import audit, changes, graph, joins, ranking
from quarrydeck.operators.budget import detail_levels, greedy, running
from quarrydeck.operators.components import components
from quarrydeck.sources import snapshots
from quarrydeck.sources.files import glob_regex, scan_files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_import_score_has_a_knee_at_eight(spark):
    got = {n: one(spark, classify.import_score(F.lit(n))) for n in (0, 1, 8, 9, 20)}
    assert got == {0: 0, 1: 10, 8: 80, 9: 81, 20: 92}


def test_transitive_dependents_of_a_chain(spark):
    # a imports b and e, b imports c, c imports d
    edges = spark.createDataFrame([("a", "b"), ("a", "e"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert rows(graph.transitive_scores(edges).select("key", "score")) == [("b", 5), ("c", 10), ("d", 15), ("e", 5)]


def test_closure_ends_on_cycles_and_is_capped(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 13}") for i in range(13)], "src string, dst string")
    got = graph.transitive_scores(ring).collect()
    assert {(r["dependents"], r["score"]) for r in got} == {(12, 50)}
    assert graph.transitive_scores(ring.limit(0)).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1300)] + [(7000, 7000), (8000, None)]
    got = dict(rows(components(spark.createDataFrame(pairs, "src long, dst long"))))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_find_ladder(spark):
    s = spark.createDataFrame([("a.go", "Open", "func"), ("b.go", "open", "func"), ("c.go", "OpenFile", "func"), ("d.go", "reopened", "method"), ("e.go", "Close", "func")], "path string, name string, kind string")
    got = {r["name"]: r["match"] for r in joins.find_ladder(s, "Open").collect()}
    assert got == {"Open": 100, "open": 75, "OpenFile": 50, "reopened": 25}
    assert [r["name"] for r in joins.find_ladder(s, "Open", kind="METHOD", path="d.").collect()] == ["reopened"]


def test_goal_tokens_and_negation(spark):
    got = one(spark, T.signed_tokens(F.lit("Fix the token-refresh race, not LOGIN -x-")))
    assert [(r["token"], r["negated"]) for r in got] == [("token-refresh", False), ("race", False), ("login", True), ("x", False)]


@pytest.mark.parametrize(("name", "want"), [("HTTPServer", ["http", "server"]), ("parseURLPath", ["parse", "url", "path"]), ("snake_case-x", ["snake", "case", "x"]), ("", [])])
def test_camel_tokens(spark, name, want):
    assert one(spark, T.camel_tokens(F.lit(name))) == want


def test_text_scalars(spark):
    assert one(spark, T.slug(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, T.token_estimate(F.lit("é" * 4))) == 2
    assert one(spark, T.xml_escape(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;"
    assert one(spark, T.truncate_at_word(F.lit("one two three"), 9)) == "one two"
    assert one(spark, T.first_sentence(F.lit("Open opens a file. More."), F.lit("Open"))) == "opens a file"
    h = one(spark, T.parse_handle(F.lit("symbol:a/b.go::Run#func@12")))
    assert tuple(h) == ("a/b.go", "Run", "func", 12)
    assert tuple(one(spark, T.parse_handle(F.lit("file:x.go")))) == ("x.go", "", "", 0)
    assert tuple(one(spark, T.parse_handle(F.lit("nonsense")))) == ("", "", "", 0)
    assert one(spark, T.redact(F.lit("/home/ann/x token = abcdefgh1"))) == "<redacted>/x token = <redacted>"


@pytest.mark.parametrize(
    ("path", "test"),
    [("a/b_test.go", True), ("a/b.go", False), ("test_x.py", True), ("x_test.py", True), ("a/tests/b.rs", True), ("FooTest.java", True), ("a.spec.tsx", True), ("a.ts", False), ("x_spec.rb", True), ("ATest.php", True), ("README.md", False)],
)
def test_test_files(spark, path, test):
    assert one(spark, classify.is_test_file(F.lit(path))) is test


def test_path_predicates(spark):
    assert one(spark, classify.in_skip_dir(F.lit("a/node_modules/b.js"))) is True
    assert one(spark, classify.in_skip_dir(F.lit("node_modules.js"))) is False
    for p in ("x.min.js", "main.a1b2c3d4.js", "api.generated.ts"):
        assert one(spark, classify.is_build_artifact(F.lit(p))) is True
    assert one(spark, classify.is_build_artifact(F.lit("main.js"))) is False
    assert one(spark, classify.language(F.lit("a/b.tsx"))) == "tsx"
    assert one(spark, classify.capability(F.lit("zig"))) == "extension-only"
    assert [one(spark, classify.change_type(F.lit(p))) for p in ("dist/x.js", "go.mod", "a_test.go", "README.md", "ci/x.go", "a.go")] == ["artifact", "deps", "test", "docs", "chore", "feat"]


def test_scan_files(spark, tmp_path):
    for name, text in {"a/main.go": "package main\n", "a/node_modules/x.js": "x", "b/y.min.js": "y", "b/z.py": "z", "b/big.py": "z" * 60_000, "c/notes.txt": "n"}.items():
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = rows(scan_files(spark, str(tmp_path / "r")).select("path", "language", "size"))
    assert got == [("a/main.go", "go", 13), ("b/z.py", "python", 1)]
    assert rows(scan_files(spark, str(tmp_path / "r"), exclude=["b/*"]).select("path")) == [("a/main.go",)]
    assert rows(scan_files(spark, str(tmp_path / "r"), include=["b/**"], max_size=-1).select("path")) == [("b/big.py",), ("b/z.py",)]


def test_globs():
    import re

    assert re.match(glob_regex("a/*.go"), "a/b.go") and not re.match(glob_regex("a/*.go"), "a/c/b.go")
    assert re.match(glob_regex("a/**"), "a/c/b.go") and re.match(glob_regex("[ab].?"), "b.x")


def test_greedy_skips_and_goes_on(spark):
    rng = random.Random(1)
    items = [(i, rng.randrange(1, 60)) for i in range(9000)]
    got = {r["k"]: (r["taken"], r["used"]) for r in greedy(spark.createDataFrame(items, "k long, c long"), ["k"], "c", 5000, "k").collect()}
    used = 0
    for k, c in items:
        fits = used + c <= 5000
        used += c * fits
        assert got[k] == (fits, used)
    assert greedy(spark.createDataFrame([], "k long, c long"), ["k"], "c", 5, "k").count() == 0


def test_running_sum_is_that_of_one_window(spark):
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), 97).alias("score"), (F.col("id") % 13 + 1).alias("cost"))
    got = {r["id"]: r["used"] for r in running(df, ["-score", "id"], "cost").collect()}
    total = 0
    for r in sorted(df.collect(), key=lambda r: (-r["score"], r["id"])):
        total += r["cost"]
        assert got[r["id"]] == total


def test_detail_levels_are_monotone_in_the_budget(spark):
    files = spark.createDataFrame([(f"f{i:03}", i, 40, 20 if i % 5 else 0, 90 + i) for i in range(60)], "path string, rank int, header long, summary long, cost long")
    last = None
    for tokens in (50, 400, 1000, 4000):
        levels = {r["path"]: r["level"] for r in detail_levels(files, tokens).collect()}
        assert len(levels) == 60
        total = sum(levels.values())
        assert last is None or total >= last
        last = total
    assert set(levels.values()) == {0, 2}


def test_references_leave_out_common_names(spark):
    words = spark.createDataFrame([(f"f{i}", w) for i in range(10) for w in ("init", f"name{i}", "name0")], "path string, word string").distinct()
    names = spark.createDataFrame([(f"f{i}", "init") for i in range(10)] + [("f0", "name0")], "path string, name string")
    assert rows(joins.references(words, names, 0.4)) == [("f0", "name0", 9)]
    assert len(rows(joins.references(words, names))) == 11


def test_bm25_prefers_exact_and_adds_pairs(spark):
    post = spark.createDataFrame([("a", "token", 3.0), ("a", "refresh", 2.0), ("b", "tokens", 3.0), ("c", "tokenize", 3.0), ("d", "other", 1.0)], "path string, term string, tf double")
    got = {r["path"]: r["bm25"] for r in ranking.bm25(post, ["token", "refresh"]).collect()}
    assert got["a"] > got["b"] > got["c"] > 0 and "d" not in got
    assert ranking.bm25(post, []).count() == 0


def test_consumed_halves_toward_zero(spark):
    r = spark.createDataFrame([("a", -7), ("b", 7), ("c", 1)], "path string, score long")
    deps = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "a")], "path string, dep string")
    got = {x["path"]: x["score"] for x in ranking.consumed_rerank(r, r.where("path <> 'c'").select("path"), deps).collect()}
    assert got == {"a": -3, "b": 3, "c": 31}


def test_delta_marks_breaking(spark):
    pre = spark.createDataFrame([("f", "A", "1", True), ("f", "b", "1", False), ("f", "C", "1", True)], "p string, name string, v string, exported boolean")
    post = spark.createDataFrame([("f", "C", "2", True), ("f", "D", "1", True)], "p string, name string, v string, exported boolean")
    assert rows(changes.delta(pre, post, ["p"], "name", "v")) == [("f", "A", "removed", True), ("f", "C", "modified", True), ("f", "D", "added", False), ("f", "b", "removed", False)]


def test_clusters_join_strong_edges_only(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1, 0.8, "symbol-dep"), (1, 2, 1.0, "test-pair"), (2, 3, 0.5, "co-change"), (1, 0, 0.3, "sibling")], "a long, b long, weight double, reason string")
    best = changes.combined(edges)
    assert (0, 1, 0.8, "symbol-dep") in rows(best)
    assert rows(changes.clusters(nodes, best)) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]


def test_line_scans(spark):
    content = 'x := os.Getenv("HOME")\n  go func() {\nbody, _ := io.ReadAll(r)\nb := io.ReadAll(io.LimitReader(r, 5))\nmux.HandleFunc("GET /users", list)\nr.Post("/items", func(w) {})\nAge int `json:"-"`\n'
    ls = audit.lines(spark.createDataFrame([("a.go", content)], "path string, content string"))
    effects = {(r["line"], r["kind"]) for r in audit.scan(ls, audit.EFFECTS).collect()}
    assert {(2, "goroutine"), (3, "unbounded-read")} <= effects and (4, "unbounded-read") not in effects
    surface = {(r["kind"], r["name"]) for r in audit.scan(ls, audit.SURFACE).collect()}
    assert ("env-var", "HOME") in surface and ("schema-field", "-") not in surface
    assert rows(audit.routes(ls).select("line", "framework", "method", "pattern", "handler")) == [(5, "net/http", "GET", "/users", "list"), (6, "chi", "POST", "/items", "<inline>")]


def test_risks(spark):
    r = spark.createDataFrame([("main.go", 6, 4, True, ["HTTP", "Shell"], 90, True, "regex"), ("a_test.go", 9, 9, True, ["HTTP"], 100, True, "regex")], "path string, imported_by int, depends_on int, untested boolean, boundaries array<string>, longest int, all_dead boolean, parse_method string")
    got = audit.risks(r)
    assert got.agg(F.sum("points")).first()[0] == 20 + 15 + 10 + 10 + 14 + 12 + 8 + 8 + 6
    assert ("security",) not in rows(audit.lanes(got).select("lane"))


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    s = snapshots.status(old, new)
    assert rows(s) == [("a", "fresh"), ("b", "modified"), ("c", "deleted"), ("d", "added")]
    assert not snapshots.worth_merging(s)
    merged = snapshots.merged(old, s.where("status <> 'fresh'").join(new, "path", "left"))
    assert rows(merged) == rows(new)
    assert snapshots.digest(new).first() == snapshots.digest(new.orderBy(F.desc("path"))).first() != snapshots.digest(old).first()
    snapshots.save(new, str(tmp_path / "s"))
    assert rows(snapshots.load(spark, str(tmp_path / "s"))) == rows(new)


def test_streaming_refresh_equals_a_full_build(spark, tmp_path):
    from quarrydeck.streaming import refresh

    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    refresh.begin(old, str(tmp_path / "t"))
    stream = "path string, sha256 string, status string, version long"
    spark.createDataFrame([("b", "2", "modified", 1), ("b", "3", "modified", 2), ("c", None, "deleted", 1), ("d", "1", "added", 1)], stream).write.parquet(str(tmp_path / "in"))
    q = refresh.refresh(spark.readStream.schema(stream).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(refresh.current(spark, str(tmp_path / "t")).select("path", "sha256")) == [("a", "1"), ("b", "3"), ("d", "1")]


def test_small_scans_are_dealt_out_and_large_ones_are_not(spark, tmp_path):
    from quarrydeck.session import spread

    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    dealt = spread(df)
    assert dealt.rdd.getNumPartitions() == cores and sorted(r.id for r in dealt.collect()) == list(range(1000))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert "Exchange" not in spread(df)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
