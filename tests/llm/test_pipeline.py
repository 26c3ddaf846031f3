"""Each stage of the pipeline against a plain version of it on its own input."""

import re

import corpus_pipeline
from shelfmark.llm import byte_bpe, near
from shelfmark.llm.common import table
from tests.llm.test_operators import brute_near

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, copy string, digest string, stays boolean"


def put(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z", None) for i, t, s in rows], DOCS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_run_on_rows_of_every_kind(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(50))
    rows = [(1, long, "a"), (2, long + " end", "a"), (2, "a text like no other of them all", "b"), (2, "a text like no other of them all", "b"), (None, None, None), (None, "null id and null source", None), (3, "", "a"), (4, " \n", "b"), (5, "w " * 40_000, "b"), (6, long, None)]
    folder = put(spark, tmp_path, rows, [(None, None, None), (1, None, 0)])
    out = corpus_pipeline.run(spark, folder).collect()
    kept = [(1, long), (2, "a text like no other of them all"), (None, "null id and null source"), (5, "w " * 40_000)]
    known = {(i, len(byte_bpe.codec().base.encode_ordinary(t))) for i, t in kept} | {(3, 0), (4, len(byte_bpe.codec().base.encode_ordinary(" \n"))), (None, 0)}
    assert out and {(r["doc_id"], r["n_tokens"]) for r in out} <= known
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, folder)
        assert got.schema.names == docs.schema.names, name
        docs = got


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, put(spark, tmp_path, [], [])).collect() == []


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    held = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        held.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = held[-1][1]
        if k < 4:
            assert docs.columns == table(spark, sf, "documents").columns
    (raw, good), (_, single), (_, unlike), (_, mixed), (_, coded) = held
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert sum((i in kept) == (y == 1) for i, y in labels.items()) >= 0.95 * len(labels)

    groups = {}
    for r in good.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(min(g)[1] for g in groups.values())

    found = brute_near({r["doc_id"]: r["text"] for r in single.collect()}, 5, 80)
    assert sorted(r["doc_id"] for r in unlike.collect()) == sorted(i for i, (_, c) in found.items() if c == i)

    ids = {r["doc_id"] for r in unlike.collect()}
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts) <= ids and max(counts.values()) <= 2
    assert mixed.count() == coded.count()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(r["n_tokens"] == len(byte_bpe.codec().base.encode_ordinary(texts[r["doc_id"]])) for r in coded.collect())
    assert near.least_overlap(10, 80) == 8
