"""Filter audit, whitening and decontamination against plain loops, and on nulls, empty and long texts, repeated rows, hash clashes, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrydeck.llm import decontamination as dc, filter_audit as fa, whitening as wh

DOCS = "doc_id long, text string, lang string"
VOCAB = "the of and house River stone Walks under bridge light never again because morning café Straße".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", ",", ".", str(rng.randrange(400))]) for _ in range(n))


def save(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)


# 11 filter audit


def audit_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([0, 20, 99, 100, 101, 300])), rng.choice(["en", "de", None, ""])) for i in range(90)]
    rows += [(100, None, "en"), (101, "", "en"), (102, " \t\n\x0b\x1c", "fr"), (103, "A" * 9 + "b" * 81, "en"), (104, "A" * 10 + "b" * 80, "en"), (105, "pipe | here", "de"), (106, prose(rng, 30_000), "en")]
    rows += [(110 + i, rows[5][1], "en") for i in range(40)] + [rows[5], rows[7], (None, rows[7][1], "en"), (None, "alone", None), (-4, rows[9][1], "de")]
    return rows


def audit_loop(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        taken = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                kept = [x for x in left if f not in x[0]]
                taken[f] += len(gone)
                redundant = sum(f in x[0] for x in docs) - len(gone)
                out[part, order, step] = [len(kept), len(gone), redundant, sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                left = kept
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(taken[f])
    return out


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(9)
    return [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)] + [(4, 1, None), (4, 1, None), (None, 1, 1), (6, None, 1)]


def test_filter_audit_query_against_a_plain_loop(spark, labels, tmp_path):
    rows = audit_rows()
    save(spark, rows, DOCS, f"{tmp_path}/documents.parquet")
    save(spark, labels, "doc_id long, quality int, toxic int", f"{tmp_path}/labels.parquet")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in fa.op11_filter_audit(spark, str(tmp_path)).collect()}
    assert got == audit_loop(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_of_clashing_hashes_and_columns(spark, labels, monkeypatch):
    rows = audit_rows(2)
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("t", "h1", "h2", "first", "part", "mask", "_h1")])
    monkeypatch.setattr(fa.F, "xxhash64", lambda *a: F.lit(5).cast("long") + F.length(a[-1]) % 3)  # almost all texts clash
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in fa.interactions(fa.mask_counts(fa.flagged(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert got == audit_loop(rows, labels)


def test_the_bloom_prepass_clears_unique_texts_and_no_repeat(spark):
    rng = random.Random(3)
    texts = [f"text {i}" for i in range(6000)] + [f"text {i}" for i in range(100)] + ["text 7"] * 3000
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(5).select("*", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")).cache()
    segments = 3
    twice = fa.repeated_cells(docs.select("h1", "h2"), segments)
    left = {r["doc_id"] for r in fa._maybe_repeated(docs, twice, segments).collect()}
    n = Counter(texts)
    repeats = {i for i, t in enumerate(texts) if n[t] > 1}
    assert repeats <= left
    assert len(left - repeats) < 0.1 * sum(v == 1 for v in n.values())
    docs.unpersist()


def test_filter_audit_shuffles_beyond_its_bounds(spark, labels, monkeypatch):
    rows = audit_rows(4)
    monkeypatch.setattr(fa, "BROADCAST_SEGMENTS", 0)
    monkeypatch.setattr(fa, "BROADCAST_REPEATS", 0)
    monkeypatch.setattr(fa, "SEGMENT_TEXTS", 16)
    got = fa.interactions(fa.mask_counts(fa.flagged(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got.collect()} == audit_loop(rows, labels)


# 12 whitening


def vectors(seed=5, n=400, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 3
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


def whiten_loop(rows, top=32):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    cent = np.array([[float(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    e, u = np.linalg.eigh(cent.T @ cent / n)
    order = np.argsort(-e)
    k = min(top, int((e > 1e-9 * e.max()).sum()))
    e, u = e[order], u[:, order]
    return [i for i, _ in kept], n, deviation, (cent @ u[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


def held(df):
    rows = sorted(df.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"]))
    k = max(r["component"] for r in rows)
    return rows, np.array([r["whitened"] for r in rows]).reshape(-1, k), k


def test_whitening_query_against_a_dense_solver(spark, tmp_path):
    rows = vectors() + [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [])]
    save(spark, [(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int", f"{tmp_path}/embeddings.parquet")
    got, z, k = held(wh.op12_whitening(spark, str(tmp_path)))
    ids, n, deviation, want, share = whiten_loop(rows)
    assert k == 12 and [r["vec_id"] for r in got[::k]] == ids
    assert {r["n"] for r in got} == {n} and [r["deviation"] for r in got[::k]] == deviation
    signs = np.sign((z * want).sum(axis=0))
    assert np.abs(z * signs - want).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:k]], share, rtol=1e-10)
    cov = (z - z.mean(0)).T @ (z - z.mean(0)) / n
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-10 and np.abs(cov - np.eye(k)).max() < 1e-10


def test_whitening_of_dependent_dimensions_repeated_rows_and_odd_lengths(spark):
    base = [(i, v[:4] + [v[0], 2.0, 0.0]) for i, v in vectors(6, 80)]
    rows = base + base[:30] + [(None, base[3][1]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(2).alias(c) for c in ("v", "d", "n", "component", "deviation")])
    got, z, k = held(wh.whiten(df))
    assert k == 4 and len(got) == 4 * (len(rows) - 1)
    by_id = defaultdict(set)
    for r in got:
        by_id[r["vec_id"], r["component"]].add(r["whitened"])
    assert all(len(v) == 1 for v in by_id.values()) and by_id[None, 1] == by_id[3, 1]
    assert got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [None])]])
def test_whitening_without_spread_gives_no_rows(spark, rows):
    assert wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_huge_entries_stays_exact(spark):
    rows = [(1, [1e30, 0.5]), (2, [-1e30, 0.25]), (3, [3e9, -0.125])]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    x = [[max(-wh.LIMIT, min(wh.LIMIT, math.floor(64 * c))) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert [r["deviation"] if r["deviation"] is None else int(r["deviation"]) for r in got] == [v if v < 10**38 else None for v in (sum((3 * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x)]


def test_cholesky_and_jacobi_on_close_and_tiny_eigenvalues():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    values = np.array([5.0, 5.0, 5.0 - 1e-9, 1.0, 1e-3, 1e-6, 1e-8, 0.0, 0.0])
    factor = wh.pivoted_cholesky(q @ np.diag(values) @ q.T)
    got, unit = wh.jacobi(factor)
    assert np.allclose(got[:7], values[:7], rtol=1e-6) and (got[7:] < 1e-12).all()
    assert np.abs(unit[:, :7].T @ unit[:, :7] - np.eye(7)).max() < 1e-12


# 13 decontamination


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def leak_loop(docs, items, window=10, shingle=3, num=1, den=1):
    wins = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[s : s + window])].add(i)
    out = []
    for d, t in docs:
        w = bench_words(t)
        hit, found = set(), set()
        for win, ids in wins.items():
            size = min(shingle, len(win))
            k = len(win) - size + 1
            for s in range(len(w) - len(win) + 1):
                same = sum(tuple(w[s + j : s + j + size]) == win[j : j + size] for j in range(k))
                if same >= max(1, math.ceil(k * num / den)):
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        found = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_case(seed=7):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([10, 11, 25]))) for i in range(12)] + [(20, "Lone"), (21, "two words"), (22, "of the house"), (23, None), (24, "  .,"), (25, ""), (None, "nobody owns this row of nine words here"), (3, "another row of item three"), (26, "a b a b a b a b a b a b a b")]
    items += [(30 + i, items[2][1]) for i in range(5)] + [(9, items[2][1])]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice([x for x in items if x[1]])[1].split()
            a = rng.randrange(len(w))
            parts += [rng.choice([str.upper, str, str.lower])(" ".join(w[a:] if rng.random() < 0.3 else w)), prose(rng, rng.randrange(8))]
        docs.append((i, " - ".join(parts)))
    docs += [(70, None), (71, ""), (72, "!!"), (73, items[0][1]), (74, items[0][1][1:]), (75, "É " + items[1][1] + "É"), (76, "a b " * 300), (77, "x" * 40_000), (78, prose(rng, 3000) + " " + items[4][1])]
    docs += [docs[5]] * 3 + [(None, items[0][1]), (None, items[0][1]), (None, "nothing"), (5, items[3][1])]
    return docs, items


@pytest.mark.parametrize("bound", [dc.BROADCAST_ROWS, 0])
def test_decontamination_query_against_a_plain_loop(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", bound)
    docs, items = leak_case()
    save(spark, docs, "doc_id long, text string", f"{tmp_path}/documents.parquet")
    save(spark, items, "item_id long, text string", f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in dc.op13_decontamination(spark, str(tmp_path)).collect()), key=repr)
    assert got == leak_loop(docs, items)


@pytest.mark.parametrize("num", [50, 80])
def test_partial_containment_and_clashing_columns(spark, num):
    docs, items = leak_case(8)
    rng = random.Random(1)
    for i in range(20):  # items with a word changed
        w = items[i % 12][1].split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((200 + i, "so " + " ".join(w)))
    extra = [F.lit(3).alias(c) for c in ("h1", "h2", "t", "at", "size", "n_words", "items", "owners", "w0", "g", "start")]
    left = spark.createDataFrame(docs, "doc_id long, text string").select("*", *extra)
    right = spark.createDataFrame(items, "item_id long, text string").select("*", *extra)
    rows = dc.decontaminate(left, right, num=num, den=100).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in rows), key=repr)
    assert got == leak_loop(docs, items, num=num, den=100)


def test_empty_tables_of_the_audits(spark, tmp_path):
    for name, schema in {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for op in (fa.op11_filter_audit, wh.op12_whitening, dc.op13_decontamination):
        assert op(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    got = dc.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(3, 0, []), (0, 0, [])]


def test_decontamination_runs_no_python(spark, tmp_path):
    docs, items = leak_case(2)
    plan = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 4 near-dedup: links of very large sets


@pytest.mark.parametrize(("n", "linked"), [(850_000, True), (849_999, False)])
def test_links_of_very_large_sets_are_exact(n, linked):
    from quarrydeck.llm import near_dedup

    a = np.arange(1_000_000, dtype=np.uint64)
    sets = [a[:n], a] + [a[i * 10 : i * 10 + 20] for i in range(70)]  # enough pairs for the product of matrices
    at, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    found = near_dedup._compare(sets, sizes, at, at, 85, 100, list(range(len(sets))))
    assert any(set(p) == {0, 1} for p in found) == linked
