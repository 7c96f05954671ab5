"""The map of a small invented code corpus."""

import json

import pytest
from pyspark.sql import functions as F

from quarrydeck.functions import parsing
from quarrydeck.plans import render, serve
from quarrydeck.plans.code_map import CodeMap, normal_path

FILES = {
    "main.go": 'package main\n\nimport (\n\t"net/http"\n\t"example.com/app/store"\n)\n\nfunc main() {\n\thttp.HandleFunc("GET /items", listItems)\n}\n\nfunc listItems(w http.ResponseWriter, r *http.Request) {\n\tstore.OpenStore("x")\n}\n',
    "store/store.go": 'package store\n\nimport "database/sql"\n\n// OpenStore opens the token store.\nfunc OpenStore(name string) (*Store, error) {\n\treturn nil, nil\n}\n\ntype Store struct {\n\tdb *sql.DB\n}\n\nfunc (s *Store) RefreshToken(id string) error {\n\treturn nil\n}\n',
    "store/store_test.go": 'package store\n\nimport "testing"\n\nfunc TestOpen(t *testing.T) {}\n',
    "web/app.ts": "import { render } from './lib/view'\nexport function start() {\n  render('x')\n}\n",
    "web/lib/view.ts": "export function render(x: string) { return x }\nexport function unusedThing() { return 1 }\n",
    "tool/run.py": "import os\nfrom tool.help import assist\n\ndef run():\n    assist(1)\n    os.remove('x')\n",
    "tool/help.py": "def assist(x):\n    return x\n",
}


@pytest.fixture(scope="module")
def code(spark):
    from quarrydeck.functions.classify import language

    files = spark.createDataFrame(list(FILES.items()), "path string, content string").withColumn("language", language(F.col("path"))).withColumn("sha256", F.sha2("content", 256))
    return CodeMap.build(files, "example.com/app")


def test_parsing():
    p = parsing.parse("go", FILES["store/store.go"])
    assert [(s["name"], s["kind"], s["receiver"], s["line"], s["end_line"]) for s in p.symbols] == [("OpenStore", "function", "", 6, 8), ("Store", "struct", "", 10, 12), ("RefreshToken", "method", "Store", 14, 16)]
    assert p.symbols[0]["doc"] == "OpenStore opens the token store." and p.imports == ["database/sql"] and p.package == "store"
    p = parsing.parse("python", '"""def no():"""\nclass A(B):\n    def go(self):\n        call(1)\n\ndef _x(): pass\n')
    assert [(s["name"], s["kind"], s["receiver"], s["exported"]) for s in p.symbols] == [("A", "class", "", True), ("go", "method", "A", True), ("_x", "function", "", False)]
    assert p.calls == [("call", 4)]
    p = parsing.parse("java", "package a.b;\nimport java.util.List;\n/* class No {} */\npublic class Foo {\n  public int bar(int x) {\n    return baz(x);\n  }\n  private void hid() {\n  }\n}\n")
    assert [(s["name"], s["exported"]) for s in p.symbols] == [("Foo", True), ("bar", True), ("hid", False)] and p.package == "a.b"
    p = parsing.parse("rust", "use std::fs;\npub struct S;\nimpl S {\n    pub fn go(&self) {\n    }\n}\nfn hid() {}\n")
    assert [(s["name"], s["kind"], s["receiver"], s["exported"]) for s in p.symbols] == [("S", "struct", "", True), ("go", "method", "S", True), ("hid", "fn", "", False)]
    assert parsing.parse("php", "<?php\nnamespace A\\B;\nuse C\\D;\nclass E {\n  public $x;\n  private function y() {\n  }\n}\n").package == "A\\B"
    assert parsing.parse("zig", "x") is None and parsing.parse("c", "").symbols == []


def test_go_whole_declarations():
    text = "package p\n" + "\n" * 700 + "// Run runs.\nfunc Run(\n\ta int,\n\tf func(struct{}) error,\n) (int, error) {\n\treturn 0, nil\n}\n\nvar (\n\tOne, two = 1, f(\n\t\tThree,\n\t)\n\t_ = x\n)\ntype (\n\tBox struct {\n\t\tWidth, Height int `json:\"w\"`\n\t\tInner struct {\n\t\t\tDeep int\n\t\t}\n\t\tEmbedded\n\t}\n\tReader interface {\n\t\tRead(p []byte) error\n\t\tclose()\n\t}\n)\ntype P struct{ X, Y int }\n"
    got = [(s["name"], s["kind"], s["signature"], s["line"] - 701, s["end_line"] - 701) for s in parsing.parse("go", text).symbols]
    assert got == [
        ("Run", "function", "(a int, f func(struct{}) error) (int, error)", 2, 7),
        ("One", "variable", "", 10, 12), ("two", "variable", "", 10, 12),
        ("Box", "struct", "{Width int, Height int, Inner struct, Embedded}", 16, 22), ("Reader", "interface", "{Read}", 23, 26), ("P", "struct", "{X int, Y int}", 28, 28),
    ]


def test_php_promoted_and_cases():
    p = parsing.parse("php", "<?php\nenum Suit: string {\n  case Hearts = 'h';\n  case Spades;\n}\nclass A {\n  public function __construct(\n    public readonly string $name,\n    private int $n,\n  ) {\n  }\n}\n")
    assert [(s["name"], s["kind"], s["receiver"], s["exported"], s["line"]) for s in p.symbols] == [("Suit", "enum", "", True, 2), ("Hearts", "case", "Suit", True, 3), ("Spades", "case", "Suit", True, 4), ("A", "class", "", True, 6), ("__construct", "method", "A", True, 7), ("name", "property", "A", True, 7), ("n", "property", "A", False, 7)]


def test_edges_and_scores(spark, code):
    edges = {tuple(r) for r in code.edges.collect()}
    assert {("main.go", "store/store.go"), ("web/app.ts", "web/lib/view.ts"), ("tool/run.py", "tool/help.py")} <= edges
    total = {r["path"]: r["s"] for r in code.components.groupBy("path").agg(F.sum("value").alias("s")).collect()}
    ranked = {r["path"]: r for r in code.ranked.collect()}
    assert set(ranked) == set(FILES)
    for path, r in ranked.items():
        assert r["score"] == total.get(path, 0)
    assert ranked["store/store.go"]["boundaries"] == ["Postgres"] and ranked["store/store.go"]["imported_by"] == 1
    assert code.top(1).first()["path"] == "main.go"
    assert ranked["store/store_test.go"]["score"] < 0


def test_queries(code):
    assert code.find("openstore").first()["name"] == "OpenStore"
    assert [r["text"] for r in code.context("RefreshToken").orderBy("line").collect()] == ["func (s *Store) RefreshToken(id string) error {", "\treturn nil", "}"]
    i = code.impact("store/store.go").first()
    assert i["importers"] == ["main.go"] and i["tests"] == ["store/store_test.go"] and i["packages"] == [".", "store"] and i["risk"] == "medium"
    assert {r["name"] for r in code.orphans().collect()} >= {"unusedThing", "RefreshToken"}
    assert code.endpoint("/items").first()["handler_line"] == 12
    assert ("tool/help.py", "assist") not in {(r["path"], r["name"]) for r in code.orphans().collect()}
    assert {r["folder"] for r in code.ownership().collect()} == {"store", "tool"}
    assert code.task("refresh the token store").first()["path"] == "store/store.go"
    goal = {r["path"]: r["intent"] for r in code.for_goal("refresh token").collect()}
    assert goal["store/store.go"] == max(goal.values()) > 0
    assert code.risks(3).count() == 3 and code.review_plan().count() > 0
    assert {r["component"] for r in code.explain("main.go").collect()} >= {"entry", "boundary"}
    assert code.effects().count() >= 1 and code.surface().count() >= 1


def test_inventory_and_brief(code):
    got = {tuple(r) for r in code.inventory("postgres").collect()}
    assert {("file", "store/store.go", ""), ("constructor", "store/store.go", "OpenStore"), ("test", "store/store_test.go", "")} <= got
    brief = [tuple(r) for r in code.brief(2).collect()]
    assert ("language", "go") in brief and ("files", str(len(FILES))) in brief and ("file", "main.go") in brief


def test_levels_and_rendering(code):
    levels = code.levels(400)
    assert {r["level"] for r in levels.collect()} <= {-1, 0, 1, 2} and levels.count() == len(FILES)
    shown = render.text(render.file_blocks(code.levels(4000), code.symbols))
    assert shown.startswith("main.go") and "OpenStore(name string)" in shown
    assert all(r["block"].endswith("</file>") for r in render.xml_blocks(levels, code.symbols).collect())
    assert json.loads(render.json_lines(code.top(2).select("rank", "path"), ["rank"]).first()["value"])["rank"] == 1
    assert render.largest_prefix(list(range(100)), 10, lambda x: json.dumps(x).encode()) == json.dumps(list(range(12))).encode()
    assert render.bounded("a\nb\nc", 2, 100).startswith("a\nb\n...")


def test_callers_evidence_and_lines(spark, code):
    from quarrydeck.operators.callers import callers_of

    calls = spark.createDataFrame([("store/store.go", "", "OpenStore", "main.go", 12)], "callee_path string, callee_receiver string, callee_name string, caller_path string, caller_line int")
    blocks = render.with_callers(render.file_blocks(code.levels(4000), code.symbols), callers_of(code.symbols, calls))
    assert "OpenStore called by main.go:12 (1)" in {r["path"]: r["block"] for r in blocks.collect()}["store/store.go"]
    seen = {(r["path"], r["relation"]) for r in render.evidence(code.ranked).collect()}
    assert {("store/store.go", "imported_by"), ("main.go", "boundaries"), ("web/app.ts", "depends_on")} <= seen
    lines = render.source_lines(code.levels(4000), code.symbols, code.files)
    assert "func OpenStore(name string) (*Store, error) {" in {r["text"] for r in lines.collect()}


def test_serving(code):
    asks = ['{"id":1,"method":"map.find","params":{"name":"OpenStore"}}', '{"id":2,"method":"nope"}', '{"id":3,"method":"map.impact"}', "broken"]
    out = [json.loads(x) for x in serve.answer(code, asks)]
    assert out[0]["result"]["total"] == 1 and out[0]["result"]["rows"][0]["name"] == "OpenStore" and [x["error"]["code"] for x in out[1:]] == [-32601, -32602, -32700]


def test_normal_path(spark):
    assert spark.range(1).select(normal_path(F.lit("a/./b/../c")).alias("x")).first()["x"] == "a/c"


def test_packets_of_goals_over_the_map(spark, code):
    goals = spark.createDataFrame([(1, "refresh the token store"), (2, "assist"), (3, "nothing here matches zzz"), (4, None)], "goal int, text string")
    found = {r["goal"]: r for r in code.packets(goals, 600).collect()}
    assert set(found) == {1, 2}
    assert found[1]["targets"][0]["path"] == "store/store.go" and found[1]["targets"][0]["variant"] == "full"
    assert found[2]["targets"][0]["path"] == "tool/help.py" and all(r["used"] <= 600 for r in found.values())
    tight = {r["goal"]: r for r in code.packets(goals, 48).collect()}  # less than the file and its source take
    assert tight[2]["targets"][0]["variant"] == "minimum" and tight[2]["omissions"][0]["reason"] == "packed as minimum"
