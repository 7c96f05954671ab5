"""Listings, callers and summaries on small hand-made tables."""

import re

import pytest
from pyspark.sql import functions as F

from quarrydeck.operators import callers, summaries
from quarrydeck.sources import history


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def raw(spark, text):
    return spark.createDataFrame([(text,)], "raw string")


def test_porcelain(spark):
    text = "\0".join(["# branch.oid abc", "1 .M N... 100644 100644 100644 aaa bbb a b.go", "2 R. N... 100644 100644 100644 aaa bbb R100 new.go", "1 old.go", "? new file.txt", "! skip.log", "u UU N... 1 1 1 1 a b c both.go", ""])
    assert rows(history.porcelain(raw(spark, text))) == [("a b.go", "", ".", "M"), ("both.go", "", "U", "U"), ("new file.txt", "", "?", "?"), ("new.go", "1 old.go", "R", "."), ("skip.log", "", "!", "!")]


def test_numstat(spark):
    text = "3\t1\ta.go\n-\t-\tb.png\n2\t0\tsrc/{old => new}/c.go\n1\t1\td.go => e.go\n4\t0\ta.go\n"
    assert rows(history.numstat(raw(spark, text))) == [("a.go", 7, 1), ("b.png", 0, 0), ("e.go", 1, 1), ("src/new/c.go", 2, 0)]


def test_name_status(spark):
    text = "A\ta.go\nM\tb.go\nD\tc.go\nR100\td.go\te.go\n"
    assert rows(history.name_status(raw(spark, text))) == [("a.go", "added"), ("b.go", "modified"), ("c.go", "deleted"), ("d.go", "deleted"), ("e.go", "added")]
    with pytest.raises(Exception, match="not a name-status line"):
        history.name_status(raw(spark, "Z\tx\n")).collect()


def test_change_sets(spark):
    assert rows(history.change_sets(raw(spark, "commit 1\na\nb\n\ncommit 2\nb\n"))) == [("1", "a"), ("1", "b"), ("2", "b")]


def test_callers(spark):
    calls = spark.createDataFrame([("s.go", "Store", "Get", "a.go", 3), ("s.go", "", "Get", "b.go", 4), ("s.go", "", "Put", "b.go", 5), ("s.go", "Store", "Get", "a_test.go", 6)], "callee_path string, callee_receiver string, callee_name string, caller_path string, caller_line int")
    syms = spark.createDataFrame([("s.go", "Get", "Store"), ("s.go", "Put", "Store"), ("s.go", "Get", "")], "path string, name string, receiver string")
    got = rows(callers.callers_of(syms, calls).select("name", "receiver", "caller_path", "total"))
    assert got == [("Get", "", "b.go", 1), ("Get", "Store", "a.go", 1), ("Put", "Store", "b.go", 1)]
    assert rows(callers.caller_bonus(calls)) == [("s.go", 3, 6)]


def test_implementations(spark):
    m = spark.createDataFrame([("File", "Read"), ("File", "Close"), ("Pipe", "Read"), ("Reader", "Read")], "type string, method string")
    r = spark.createDataFrame([("Reader", "Read"), ("ReadCloser", "Read"), ("ReadCloser", "Close")], "interface string, method string")
    assert rows(callers.implementations(m, r)) == [("File", "ReadCloser"), ("File", "Reader"), ("Pipe", "Reader")]


def test_rules_and_manifests(spark):
    paths = spark.createDataFrame([("a/b/c.go",), ("d.go",)], "path string")
    rules = spark.createDataFrame([("go.mod",), ("a/go.mod",), ("x/go.mod",)], "rule string")
    assert rows(callers.applicable_rules(paths, rules)) == [("a/b/c.go", "a/go.mod"), ("a/b/c.go", "go.mod"), ("d.go", "go.mod")]
    assert rows(callers.nearest_manifest(paths, rules)) == [("a/b/c.go", "a/go.mod"), ("d.go", "go.mod")]


def test_summaries(spark):
    names = spark.createDataFrame([(1, "parseFile"), (1, "parseFolder"), (2, "one"), (3, "abc"), (3, "xyz")], "g int, n string")
    assert rows(summaries.common_prefix(names, "g", "n")) == [(1, "parse"), (2, "one"), (3, "")]
    ranked = spark.createDataFrame([("cmd/main.go", 9), ("a.go", 5), ("x/y/deep.go", 99), ("b.go", 7), ("b_test.go", 50), ("index.js", 1)], "path string, score int")
    assert [r["path"] for r in summaries.spine(ranked).orderBy("pos").collect()] == ["cmd/main.go", "b.go", "a.go"]
    groups = spark.createDataFrame([("g1", "src", 1), ("g2", "src", 5), ("g3", "doc", 1), ("g4", "src", 4)], "id string, top string, files int")
    assert rows(summaries.consolidated(groups)) == [("g1", "g2"), ("g2", "g2"), ("g3", "g3"), ("g4", "g4")]
    one = spark.range(1)
    assert one.select(summaries.subject(F.lit("feat"), F.lit("io"), F.lit(2), F.lit(1), F.lit(0))).first()[0] == "feat(io): add 2 symbols, drop 1"
    assert one.select(summaries.group_confidence(F.lit("test"), F.lit("x"), F.lit(1))).first()[0] == 0.8
    assert one.select(summaries.is_conventional(F.lit("fix(core)!: x"))).first()[0] is True
    t = spark.createDataFrame([("a",), ("b",)], "path string")
    assert dict(rows(summaries.hygiene(t, t.limit(0), t.limit(1)))) == {"tracked": 2, "untracked": 0, "ignored": 1, "tracked_but_ignored": 1}
    f = spark.createDataFrame([("b", 1, "k", "review", "x" * 300), ("a", 2, "k", "safe", "y"), ("a", 1, "k", "review", "z")], "file string, line int, kind string, action string, snippet string")
    assert [(r["file"], len(r["snippet"])) for r in summaries.triage(f).collect()] == [("a", 1), ("b", 200)]


def test_change_plan(spark):
    from quarrydeck.plans.change_plan import plan

    changed = spark.createDataFrame([("src/a.go",), ("src/a_test.go",), ("lib/b.go",), ("README.md",), ("plugins/x/p.go",), ("plugins/y/q.go",)], "path string")
    depends = spark.createDataFrame([("src/a.go", "lib/b.go"), ("plugins/x/p.go", "plugins/y/q.go"), ("src/a.go", "gone.go")], "src string, dst string")
    deltas = spark.createDataFrame([("src/a.go", "Run", "added", False), ("lib/b.go", "Old", "removed", True)], "path string, name string, change string, breaking boolean")
    got = {r["group"]: r for r in plan(changed, depends, deltas).collect()}
    assert sorted(got) == ["README.md", "lib/b.go", "plugins/x/p.go", "plugins/y/q.go"]
    g = got["lib/b.go"]
    assert g["paths"] == ["lib/b.go", "src/a.go", "src/a_test.go"] and g["type"] == "feat" and g["breaking"] and g["subject"] == "feat: add 1 symbols, drop 1"
    assert got["README.md"]["type"] == "docs" and got["plugins/x/p.go"]["scope"] == "x"


def test_overrides_and_coverage(spark):
    from quarrydeck.functions import parsing
    from quarrydeck.operators.budget import apply_overrides

    levels = spark.createDataFrame([("a/x.go", 1, 0), ("b/y.go", 2, 1)], "path string, rank int, level int")
    rules = spark.createDataFrame([("^a/.*$", 2), ("^zzz$", -1)], "pattern string, forced int")
    assert rows(apply_overrides(levels, rules)) == [("a/x.go", 1, 2), ("b/y.go", 2, 1)]
    files = spark.createDataFrame([("a.go", "go", "package a\n"), ("b.zig", "zig", "x")], "path string, language string, content string")
    assert rows(parsing.coverage(files, parsing.parsed_files(files))) == [("go", 1, 1, 0), ("zig", 1, 0, 1)]


def test_settings(spark):
    from quarrydeck.sources.config import Config

    assert Config.parse(None) == Config() == Config.parse("{}")
    c = Config.parse('{"method_blocklist": ["get*", "/^X/"], "exclude_paths": ["v/**"], "include_paths": ["**/*.go"], "file_overrides": {"a/**": "full", "b/*.go": "omit"}}')
    names = spark.createDataFrame([("getX",), ("forget",), ("Xy",)], "n string")
    assert [r[0] for r in names.select(c.blocked(F.col("n"))).collect()] == [True, False, True]
    assert rows(c.files(spark.createDataFrame([("v/a.go",), ("a/b.go",), ("a/b.py",)], "path string"))) == [("a/b.go",)]
    assert sorted(r["forced"] for r in c.overrides(spark).collect()) == [-1, 2]
    for bad in ('{"file_overrides": {"a": "most"}}', '{"method_blocklist": ["/(/"]}'):
        with pytest.raises((ValueError, re.error)):
            Config.parse(bad)


def test_tags_and_caches(spark, tmp_path):
    from quarrydeck.sources import tags
    from quarrydeck.sources.files import bounded

    lines = ["no json", '{"_type":"ptag","name":"x"}', '{"_type":"tag","name":"A","path":"a.ts","kind":"class","line":1}', '{"_type":"tag","name":"y","path":"a.ts","kind":"field","scope":"A","line":3}', '{"_type":"tag","name":"x","path":"a.ts","kind":"field","scope":"A","line":2}', '{"_type":"tag","name":"go","path":"a.ts","kind":"method","scope":"A","signature":"(n)","line":4}', '{"_type":"tag","path":"a.ts"}']
    assert rows(tags.tag_symbols(spark.createDataFrame([(x,) for x in lines], "value string"))) == [("a.ts", "A", "class", "{x, y}", "", 1), ("a.ts", "go", "method", "(n)", "A", 4)]
    files, made = spark.createDataFrame([("a", "1")], "path string, sha256 string"), []
    make = lambda: made.append(1) or spark.range(3)
    assert tags.cached(make, files, str(tmp_path)).count() == tags.cached(make, files, str(tmp_path)).count() == 3 and len(made) == 1
    tags.cached(make, files.withColumn("sha256", F.lit("2")), str(tmp_path))
    assert len(made) == 2
    assert [r[0] for r in spark.createDataFrame([("abc",), ("abcd",), (None,)], "t string").select(bounded(F.col("t"), 3, "~")).collect()] == ["abc", "abc~", None]


def test_families_and_plans(spark):
    from quarrydeck.plans.change_plan import prepared

    m = spark.createDataFrame([(1, "a/x.go"), (1, "a/y.go"), (1, "a/z.md"), (2, "r.md"), (3, "a.go"), (3, "b.md")], "g int, path string")
    assert rows(summaries.polished(m, "g")) == [(1, 3, "code", "a", 0.55), (2, 1, "docs", "", 0.75), (3, 2, "other", "", 0.4)]
    g = spark.createDataFrame([(1, 2, 0.5, 0.5), (1, 2, 0.9, 0.1), (2, 99, 0.9, 0.9), (3, 1, 0.5, 0.6)], "plan int, files int, confidence double, polished double")
    f = spark.createDataFrame([(3, "safe")] + [(1, "review")] * 6, "plan int, action string")
    assert rows(prepared(g, f).select("plan", "unsure", "status")) == [(1, 1, "abort"), (2, 0, "ready"), (3, 0, "ready")]
    assert {r["plan"]: r["status"] for r in prepared(g, f.limit(0), large=50).collect()} == {1: "needs_judgment", 2: "needs_judgment", 3: "ready"}


def test_read_queue_of_nothing_and_of_one(spark):
    from quarrydeck.operators import review

    risks = spark.createDataFrame([("a_test.go", "untested", "test-risk", 10), ("b.go", "untested", "test-risk", 10)], "path string, rule string, lane string, points int")
    hits = spark.createDataFrame([("b.go", 1, "http", "api-contracts", 8, 4)], "path string, line int, kind string, lane string, weight int, pattern int")
    ranked = spark.createDataFrame([("b.go", 40)], "path string, score long")
    got = {r["group"]: r for r in review.read_queue(risks, hits.limit(0), hits, ranked).collect()}
    assert sorted(got) == ["network-and-api-effects", "ranked-risk-packets", "test-risk"] and got["test-risk"]["files"] == ["b.go"] and got["test-risk"]["caveat"]
    assert [(r["path"], r["start"], r["end"]) for r in got["network-and-api-effects"]["ranges"]] == [("b.go", 1, 25)]
    assert review.read_queue(risks.limit(0), hits.limit(0), hits.limit(0), ranked.limit(0)).count() == 0
