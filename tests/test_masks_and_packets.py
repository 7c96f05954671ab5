"""Masks of lines, packets, capped reports, merged plans, log files, marks of folders and the parser's strings, against plain loops."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrydeck.functions import parsing, text as T
from quarrydeck.operators import masks, packets, summaries
from quarrydeck.sources import files as scans, history, snapshots


def mask_loop(content, blocks, line_comment, quotes, strings=True):
    """A scanner that goes character by character. blocks: opens, closes, string, escapes."""
    out, state = [], None
    for line in content.split("\n"):
        kept, i = "", 0
        while i < len(line):
            if state:
                opens, closes, _, escapes = state
                if escapes and line[i] == "\\":
                    i += 2
                elif line.startswith(closes, i):
                    i, state = i + len(closes), None
                else:
                    i += 1
                continue
            b = next((b for b in blocks if line.startswith(b[0], i)), None)
            if line.startswith(line_comment, i):
                break
            if b or line[i] in quotes:
                opens, closes, is_string, escapes = b or (line[i], line[i], True, True)
                j = i + len(opens)
                while j < len(line) and not line.startswith(closes, j):
                    j += 2 if escapes and line[j] == "\\" else 1
                closed = j < len(line) and line.startswith(closes, j)
                end = j + len(closes) if closed else len(line)
                if b and not closed:
                    state = b
                elif is_string and strings:
                    kept += line[i:end]
                i = end
                continue
            kept, i = kept + line[i], i + 1
        out.append(re.sub(r"^[ \t\r\f]+|[ \t\r\f]+$", "", kept))
    return out


STYLES = {
    "go": ([("/*", "*/", False, False), ("`", "`", True, False)], "//", "\"'"),
    "typescript": ([("/*", "*/", False, False), ("`", "`", True, True)], "//", "\"'"),
    "java": ([("/*", "*/", False, False)], "//", "\"'"),
    "python": ([('"""', '"""', True, True), ("'''", "'''", True, True)], "#", "\"'"),
}
PIECES = ["a", "x := 1", " ", "/*", "*/", "//", "`", '"', "'", "\\", "\n", "\n", "\n", "* /", '"""', "'''", "#", "é", "f(", ")"]


@pytest.mark.parametrize("style", STYLES)
@pytest.mark.parametrize("strings", [True, False])
def test_masked_lines_against_a_scanner(spark, style, strings):
    rng = random.Random(style)
    # a line's last character isn't a backslash: what it does to the next line differs between languages
    texts = {f"f{i}": re.sub(r"\\+(\n|$)", r"\1", "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 120)))) for i in range(120)} | {"empty": "", "blank": "\n\n"}
    rows = list(texts.items()) + [("none", None), (None, "x")]
    got = defaultdict(dict)
    for r in masks.masked_lines(spark.createDataFrame(rows, "path string, content string"), style, strings=strings, block=4).collect():
        got[r["path"]][r["line"]] = r["text"]
    assert set(got) == set(texts)
    for p, t in texts.items():
        assert [got[p][i + 1] for i in range(len(got[p]))] == mask_loop(t, *STYLES[style], strings), repr(t)


def test_a_long_file_is_scanned_in_many_tasks(spark):
    """The states of 200,000 lines of one file, against a loop; the widest block that a task holds is 64 lines."""
    n = 200_000
    i = F.col("id")
    rows = spark.range(n).select(F.lit("f").alias("path"), i.alias("pos"), F.when(i % 977 == 3, F.array(F.lit(1), F.lit(1))).when(i % 977 == 400, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("f")).repartition(16)
    got = masks.start_states(rows, 2, block=64)
    assert got.groupBy("state").count().orderBy("state").collect()[1]["count"] == sum(4 <= k % 977 <= 400 for k in range(n))
    assert got.where("state <> cast(pos % 977 between 4 and 400 as int)").count() == 0


def test_long_lines_need_no_deep_stack(spark):
    text = "/*" + "* x" * 50_000 + '*/ y := "' + "\\n" * 50_000 + '"'
    assert masks.masked_lines(spark.createDataFrame([("f", text)], "path string, content string")).first()["text"].startswith('y := "')


def packet_loop(rows, budget, reserve):
    goals = defaultdict(list)
    for g, p, rel, score, costs in rows:
        goals[g].append((-rel, -score, p, costs))
    out = {}
    for g, xs in goals.items():
        used, taken, omissions, why = 0, [], [], "target limit"
        for k, (_, _, p, costs) in enumerate(sorted(xs, key=lambda x: x[:3])[: packets.TARGETS]):
            v = next((v for v, c in enumerate(costs) if c is not None and used + c <= budget - reserve), None)
            if v is None:
                why = "token budget"
                break
            used += costs[v]
            taken.append((k + 1, p, packets.VARIANTS[v], costs[v], used))
            if v:
                omissions.append((f"targets[{p}]", v, 4, f"packed as {packets.VARIANTS[v]}"))
        if len(taken) < len(xs):
            omissions.append(("targets", len(taken), len(xs), why))
        out[g] = (taken, used, omissions)
    return out


def test_packets_of_many_goals(spark):
    rng = random.Random(2)
    rows = [(g, f"p{k}", rng.randrange(5), rng.randrange(3), [rng.choice([rng.randrange(100, 400), 2000]), rng.choice([None, 90]), rng.choice([60, 900]), rng.choice([None, 12])]) for g in range(40) for k in range(rng.randrange(1, 15))]
    got = packets.packets(spark.createDataFrame(rows, "goal int, path string, relevance long, score long, costs array<bigint>"), 500, 20)
    want = packet_loop(rows, 500, 20)
    assert {r["goal"]: ([tuple(t) for t in r["targets"]], r["used"], [tuple(o) for o in r["omissions"]]) for r in got.collect()} == want
    assert {o[3] for w in want.values() for o in w[2]} >= {"token budget", "target limit", "packed as minimum"}


def test_relevance_of_goals(spark):
    rows = [("a/token.go", "refresh the token of a store", "store"), ("b.go", "nothing", "other"), ("c.go", None, None)]
    files = spark.createDataFrame(rows, "path string, content string, package string")
    goals = packets.goal_terms(spark.createDataFrame([(1, "fix token refresh"), (2, "the store, the STORE"), (3, None)], "id int, text string"), "id")
    got = {tuple(r) for r in packets.relevance(files, goals, {"content": 3, "package": 5}).collect()}
    assert got == {(1, "a/token.go", 6), (2, "a/token.go", 8)}


def test_capped_reports_start_from_all_hits(spark):
    rng = random.Random(3)
    hits = [(f"f{rng.randrange(6)}", k, rng.choice(["command", "flag"]), rng.choice("xy")) for k in range(900)]
    df = spark.createDataFrame(hits, "path string, line int, kind string, lane string").repartition(7)
    caps = packets.report_caps()
    shown, left = packets.capped(df, caps, ["path", "line"]).collect(), {(r["cap"], r["key"]): (r["shown"], r["total"]) for r in packets.omitted(df, caps).collect()}
    for cap, column, most in (("files", 0, lambda k: 12), ("kinds", 2, lambda k: 80 if k == "command" else 120), ("lanes", 3, lambda k: 120)):
        for key in {h[column] for h in hits}:
            own = sorted((h for h in hits if h[column] == key), key=lambda h: h[:2])
            assert [(r["pos"], r["path"], r["line"]) for r in sorted((r for r in shown if (r["cap"], r["key"]) == (cap, key)), key=lambda r: r["pos"])] == [(k + 1, *h[:2]) for k, h in enumerate(own[: most(key)])]
            assert left[cap, key] == (most(key), len(own))


def plan_loop(groups):
    out = {}
    for plan in {g[0] for g in groups}:
        gs = sorted([[-(f or 0), i, (tops or [""])[0] or "", tops or [], [i]] for p, i, f, tops in groups if p == plan], key=lambda x: x[:2])
        if len(gs) > 3:
            kept = [g for g in gs if -g[0] > 2]
            for r in (g for g in gs if -g[0] <= 2):
                at = next((g for g in kept if g[2] in r[3]), None)
                if at is None:
                    kept.append(r)
                else:
                    at[0], at[4] = at[0] + r[0], at[4] + r[4]
            gs = sorted(kept, key=lambda x: x[:2])
            while len(gs) > 3:
                a, b = gs[-2:]
                gs = sorted(gs[:-2] + [[a[0] + b[0], a[1], a[2], a[3], a[4] + b[4]]], key=lambda x: x[:2])
        for g in gs:
            for i in g[4]:
                out[plan, i] = (g[1], -g[0])
    return out


def test_merged_plans(spark):
    rng = random.Random(4)
    groups = [(p, i, rng.choice([None, 1, 1, 2, 3, 5, 8]), rng.choice([None, [], ["a"], ["b", "a"], ["c", "d"], ["d"]])) for p in range(40) for i in range(rng.randrange(1, 14))]
    got = summaries.merged_plans(spark.createDataFrame(groups, "plan int, id int, files int, tops array<string>"))
    want = plan_loop(groups)
    assert {(r["plan"], r["id"]): (r["into"], r["files"]) for r in got.collect()} == want
    assert max(len({v[0] for (p, _), v in want.items() if p == plan}) for plan in range(40)) == 3


def test_a_log_is_read_in_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    sets = {f"{k:040x}": [f"{rng.choice(['src', 'docs', 'src2'])}/f{rng.randrange(50)}.go" for _ in range(rng.randrange(5))] for k in range(100_000)}
    path = tmp_path / "log.txt"
    path.write_text("".join(f"commit {k}\n\n" + "".join(f"{i}\n" for i in v) for k, v in sets.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        spark.conf.set("spark.sql.files.openCostInBytes", "64k")
        got = history.log_sets(spark, str(path))
        assert got.rdd.getNumPartitions() >= 5
        assert sorted(map(tuple, got.collect())) == sorted((k, i) for k, v in sets.items() for i in v)
        assert history.log_sets(spark, str(path), under="src/").count() == sum(i.startswith("src/") for v in sets.values() for i in v)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = history.change_sets(spark.createDataFrame([("".join(f"commit {k}\n" + "\n".join(v) + "\n" for k, v in list(sets.items())[:500]),)], "raw string"))
    assert sorted(map(tuple, whole.collect())) == sorted((k, i) for k, v in list(sets.items())[:500] for i in v)


def test_tracked_files(spark):
    files = spark.createDataFrame([("a",), ("b c",), ("d",)], "path string")
    assert {r[0] for r in history.tracked(spark.createDataFrame([("a\0b c\0gone\0",)], "raw string"), files).collect()} == {"a", "b c"}


def test_staleness_reads_contents_of_touched_files_alone(spark, tmp_path):
    for name, text in {"a/x.go": "one", "a/y.go": "two", "z.go": "three"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    plan = scans.stat_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert {(r["path"], r["size"]) for r in scans.stat_files(spark, str(tmp_path)).collect()} == {("a/x.go", 3), ("a/y.go", 3), ("z.go", 5)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    old = spark.createDataFrame([("same", 1, 5, sha("not read")), ("touched", 1, 5, sha("t")), ("changed", 1, 5, sha("c")), ("gone", 1, 5, sha("g"))], "path string, size long, mtime long, sha256 string")
    now = spark.createDataFrame([("same", 1, 5, "other"), ("touched", 1, 6, "t"), ("changed", 2, 5, "cc"), ("new", 1, 5, None)], "path string, size long, mtime long, content string")
    got = {r["path"]: (r["status"], r["sha256"]) for r in snapshots.refreshed(old, now).collect()}
    assert got == {"same": ("fresh", sha("not read")), "touched": ("fresh", sha("t")), "changed": ("modified", sha("cc")), "gone": ("deleted", None), "new": ("added", None)}


def test_marks_follow_changes(spark):
    rng = random.Random(7)
    rows = {f"{rng.choice('abc')}/{rng.choice('xy')}/f{k}" if k % 5 else f"f{k}": str(rng.random()) for k in range(300)}
    later = dict(rows)
    for p in list(rows)[:40]:
        del later[p]
    for p in list(later)[:30]:
        later[p] = "changed"
    later |= {f"new/f{k}": "v" for k in range(9)}
    df = lambda d: spark.createDataFrame(list(d.items()), "path string, sha256 string").repartition(5)
    gone = {p: v for p, v in rows.items() if later.get(p) != v}
    come = {p: v for p, v in later.items() if rows.get(p) != v}
    moved = snapshots.moved_marks(snapshots.folder_marks(df(rows)), snapshots.folder_marks(df(gone)), snapshots.folder_marks(df(come)))
    anew = snapshots.folder_marks(df(later))
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, anew.collect()))
    assert snapshots.corpus_mark(moved).first() == snapshots.corpus_mark(anew).first() != snapshots.corpus_mark(snapshots.folder_marks(df(rows))).first()


def test_stop_words_by_letters():
    rx, rng = re.compile(T.either(T.STOP_WORDS) + r"\Z"), random.Random(1)
    for w in T.STOP_WORDS:
        for _ in range(30):
            v = w[: rng.randrange(1, len(w) + 1)] + rng.choice(["", "", "s", "e", "an"])
            assert bool(rx.match(v)) == (v in T.STOP_WORDS), v


def test_parser_is_not_misled_by_strings_and_comments():
    go = 'package a\nfunc A() string { return "(" }\nfunc B() { x := "}"\n}\n/* a */ func D() {}\nconst (\n\tK = "("\n\tL = 2\n)\nfunc C() {\n\ts := `\nfunc Fake() {\n`\n\t// }\n}\nfunc E(\n\ta int, // (\n\tb string,\n) int {\n\treturn 1\n}\n'
    got = [(s["name"], s["kind"], s["signature"], s["line"], s["end_line"]) for s in parsing.parse("go", go).symbols]
    assert got == [("A", "function", "() string", 2, 2), ("B", "function", "()", 3, 4), ("D", "function", "()", 5, 5), ("K", "constant", "", 7, 7), ("L", "constant", "", 8, 8), ("C", "function", "()", 10, 15), ("E", "function", "(a int, b string) int", 16, 21)]
    assert parsing.parse("python", 'def f():\n    go("a(b)")  # no(1)\n').calls == [("go", 2)]


def test_parser_is_linear_in_calls():
    def took(n):
        t = time.perf_counter()
        assert len(parsing.parse("javascript", "\n".join(f"f{i}(g{i}(x))" for i in range(n))).calls) == 2 * n
        return time.perf_counter() - t

    took(1000)
    assert took(40_000) < 40 * max(took(4000), 0.01)
