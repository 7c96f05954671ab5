"""Streamed requests against a plain loop, with a snapshot that moves halfway; fitting prefixes."""

import json
import random

from pyspark.sql import functions as F

from quarrydeck.plans import render
from quarrydeck.streaming import requests


def tables(spark, step):
    names = ["Open", "open", "Close", "run", "Run", "x'y", "ünï"]
    symbols = [(f"f{k % 5}.go", names[k % 7], "function", 1 + k + step, 1 + k + step + (k % 3) * 40) for k in range(21)]
    components = [(f"f{k % 5}.go", f"c{k}", k + step) for k in range(11)]
    files = [(f"f{k}.go", "\n".join(f"line {i} of {k} at {step}" for i in range(1, 140))) for k in range(5)]
    made = {
        "symbols": spark.createDataFrame(symbols, "path string, name string, kind string, line int, end_line int"),
        "components": spark.createDataFrame(components, "path string, component string, value long"),
        "files": spark.createDataFrame(files, "path string, content string"),
    }
    return (symbols, components, dict(files)), made


def loop(line, data, version):
    symbols, components, files = data
    try:
        r = json.loads(line)
        number, method, p = str(r["id"]), r["method"], r.get("params") or {}
    except (ValueError, KeyError, TypeError):
        return None, None, requests.PARSE, None
    if method not in requests.METHODS:
        return number, method, requests.NO_METHOD, None
    asked = p.get("path") if method == "file/explain" else p.get("query")
    if method == "map/status":
        return number, method, None, {"version": version, "files": len(files), "symbols": len(symbols)}
    if not asked:
        return number, method, requests.BAD_PARAMS, None
    if method == "file/explain":
        own = sorted((c, v) for q, c, v in components if q == asked)
        return number, method, *((None, {"score": sum(v for _, v in own), "components": [{"component": c, "value": v} for c, v in own]}) if own else (requests.FAILED, None))
    met = sorted((s[1] != asked, s[0], s[3], s[1], s[2], s[4]) for s in symbols if s[1].lower() == asked.lower())
    if method == "symbol/find":
        return number, method, None, {"total": len(met), "matches": [{"path": m[1], "name": m[3], "kind": m[4], "line": m[2]} for m in met[: requests.ROWS]]}
    if not met:
        return number, method, requests.FAILED, None
    _, path, line, name, _, end = met[0]
    n = end - line + 1
    return number, method, None, {"path": path, "name": name, "line": line, "total": len(met), "source": files[path].split("\n")[line - 1 : line - 1 + min(n, requests.LINES)], "truncated": n > requests.LINES, "lines": n}


def test_a_thousand_requests_with_a_snapshot_moved_halfway(spark, tmp_path):
    rng = random.Random(1)

    def ask(k):
        method = rng.choice([*requests.METHODS, "map/other"])
        params = {"query": rng.choice(["Open", "OPEN", "close", "run", "none", "x'y", "ÜNÏ", ""]), "path": rng.choice(["f0.go", "f3.go", "none.go", ""])}
        return rng.choice(["{bad", "[]", '"text"']) if k % 50 == 7 else json.dumps({"jsonrpc": "2.0", "id": k, "method": method, "params": params} if k % 40 else {"id": k, "method": method})

    inbox, want = tmp_path / "inbox", []
    inbox.mkdir()
    for step in (0, 1):
        data, made = tables(spark, step)
        requests.publish(spark, made, f"{tmp_path}/map", step)
        lines = [ask(k) for k in range(500 * step, 500 * step + 500)]
        for part in range(10):
            (inbox / f"{step}-{part}.txt").write_text("\n".join(lines[part::10]) + "\n")
        want += [(line, step, *loop(line, data, step)) for line in lines]
        requests.serve(spark, str(inbox), f"{tmp_path}/map", f"{tmp_path}/out", f"{tmp_path}/state", queue=4).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()] == [200, 200, 100] * 2  # four files a batch
    rows = out.collect()
    got = [(r["value"], r["version"], r["id"], r["method"], r["code"], json.loads(r["result"]) if r["result"] else None) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_answers_of_no_requests_and_an_empty_snapshot(spark):
    _, made = tables(spark, 0)
    none = {k: df.where("false") for k, df in made.items()}
    assert requests.answers(spark.createDataFrame([], "value string"), made, 1).count() == 0
    got = requests.answers(spark.createDataFrame([('{"id": 1, "method": "symbol/find", "params": {"query": "a"}}',), (None,), ("",)], "value string"), none, 1).orderBy("id").collect()
    assert [(r["code"], r["result"]) for r in got] == [(requests.PARSE, None), (requests.PARSE, None), (None, '{"total":0,"matches":[]}')]


def test_fitting_prefix_against_a_loop(spark):
    rng = random.Random(2)
    blocks = [(k, "é" * rng.randrange(30)) for k in range(400)]
    used, want = 0, []
    for k, b in blocks:
        used += len(b.encode()) + 1
        if used <= 4 * 900 - 30:
            want.append((k, used))
    got = render.fitting(spark.createDataFrame(blocks, "rank int, block string").repartition(5), 900, 30)
    assert sorted((r["rank"], r["used"]) for r in got.select("rank", F.col("used")).collect()) == want
