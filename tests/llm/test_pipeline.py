"""The corpus pipeline, stage by stage and whole."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_dealt import DOCS, brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(1)
    rows = [(i, prose(rng, 80), "en", "s", 1) for i in range(150)]
    rows += [(200, None, "en", "s", 0), (201, "12 34 !!", "en", "s", 0), (202, rows[4][1], "en", "t", 1), (203, rows[5][1] + " one more", "en", "t", 1), (204, f"{prose(rng, 50)} token = abcdef0123456789abcdef0123 {prose(rng, 9)}", "en", "s", 1), rows[9]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in rows] for n, rows in kept.items()}
    assert set(range(150)) | {202, 203, 204} == set(ids["language ID"])
    comps = brute_components([(r["doc_id"], r["text"]) for r in kept["language ID"]], 5, 80)
    assert sorted(ids["MinHash near-dedup"]) == sorted(i for i, (_, c) in comps.items() if i == c)
    assert 202 not in ids["MinHash near-dedup"] and 203 not in ids["MinHash near-dedup"]
    masked = {r["doc_id"]: r for r in kept["secret scans"]}
    assert "[secret]" in masked[204]["text"] and "abcdef0123" not in masked[204]["text"] and masked[204]["n_chars"] == len(masked[204]["text"])
    assert sorted(ids["secret scans"]) == sorted(ids["MinHash near-dedup"])
    assert set(ids["mixing"]) <= set(ids["secret scans"]) and len(ids["mixing"]) > 0.8 * len(ids["secret scans"])
    assert set(ids["packing"]) == set(ids["mixing"])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_private_keys_are_masked_whole(spark, tmp_path):
    body = "\n".join("MIIEvQ+/Ab09" * 5 for _ in range(2000))
    head, end = "-----BEGIN {}PRIVATE KEY-----", "-----END {}PRIVATE KEY-----"
    rsa = f"{head.format('RSA ')}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0F\n\n{body}\n{end.format('RSA ')}"
    texts = [f"a {head.format('')}\n{body}\n{end.format('')} b {rsa} c", f"a {head.format('')} b", f"a {head.format('EC ')} b {end.format('')} c", f"{head.format('')} " * 3000]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, str(tmp_path)).collect()}
    assert got == {0: "a [secret] b [secret] c", 1: "a [secret] b", 2: f"a [secret] b {end.format('')} c", 3: "[secret] " * 3000}


def test_without_labels_texts_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12 ½", None, "s", 1), (3, None, None, "s", 1)], DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()] == [1]


def test_different_texts_of_one_id_stay(spark, tmp_path):
    rng = random.Random(3)
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, None, "en", "s", 1)], DOCS)
    got = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, (r["text"] for r in got))) == sorted(map(str, [a, b, c, None]))


def test_columns_of_any_name_stay(spark, folder, tmp_path):
    names = ["row", "changed", "lang_pred", "score", "_tokens", "_p0", "__p1", "copies", "copy", "blob", "spans", "_blob", "kept"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(-k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [tuple(-k for k in range(len(names)))]


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_a_kept_ledger_is_read_and_added_to(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "en", "s", 1), (2, "é" * 9, "en", "s", 9)], DOCS)
    spark.conf.set("spark.quarrydeck.secretLedger", f"{tmp_path}/ledger")
    try:
        for _ in range(2):
            assert {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, str(tmp_path)).collect()} == {1: "[secret]", 2: "é" * 9}
        assert spark.read.parquet(f"{tmp_path}/ledger").count() == 2
    finally:
        spark.conf.unset("spark.quarrydeck.secretLedger")


def test_what_a_worker_keeps_between_stages_is_small():
    import tracemalloc

    from quarrydeck.llm import near_dedup, packing

    texts = [" ".join(f"w{k}x" for k in range(at, at + 1000)) for at in range(0, 300_000, 1000)]
    encode = packing.encoder.__wrapped__()  # a worker's own, which nothing has filled
    near_dedup._WORD.clear()
    for use, most in ((near_dedup.shingles, 20), (encode, 40)):
        use("warm up")
        tracemalloc.start()
        for t in texts:
            use(t)
        kept = tracemalloc.get_traced_memory()[0] / 1e6
        tracemalloc.stop()
        assert kept < most, (use, kept)
    near_dedup._WORD.clear()


def test_words_of_few_texts_are_held_at_a_time():
    from quarrydeck.llm import lang_id

    texts = ["a" * 3, None, "", "b" * 9, "c" * 2, "d" * 2, "e" * 4]
    assert list(lang_id._slices(texts, 5)) == [["aaa", None, ""], ["b" * 9], ["cc", "dd"], ["eeee"]]
    assert list(lang_id._slices([], 5)) == []
