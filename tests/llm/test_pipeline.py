"""The pipeline's stages, each against what its own input calls for."""

import random
import zlib

import pytest

import corpus_pipeline as pipeline
from strandlake.llm.common import materialize

from .test_dedup import near_by_hand

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows, marks = [], []
    for i in range(240):
        bad = i % 6 == 0
        text = " ".join(word() + "###" * bad for _ in range(40))
        rows.append((i, text, "en", f"s{i % 4}" if i > 120 else "s0", len(text)))
        marks.append((i, int(not bad), 0))
    for i in range(240, 280):
        text = rows[i - 239][1]
        rows.append((i, text if i % 2 else text.replace(" ", "  ", 3) + " tail", "en", "s1", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s2", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    good = materialize(pipeline.good_documents(spark, docs, folder), "a")
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    assert not ids & {i for i in range(240) if i % 6 == 0} and {i for i in range(240) if i % 6} <= ids
    distinct = materialize(pipeline.distinct_documents(spark, good, folder), "b")
    key = lambda t: "".join((t or "").split())
    assert distinct.columns == columns
    texts = [key(r.text) for r in distinct.collect()]
    assert len(texts) == len(set(texts)) == len({key(r.text) for r in good.collect()})
    unlike = materialize(pipeline.unlike_documents(spark, distinct, folder), "c")
    want = {k for k, v in near_by_hand([(r.doc_id, r.text) for r in distinct.collect()], 80).items() if v[2]}
    assert unlike.columns == columns and {r.doc_id for r in unlike.collect()} == want
    mixed = materialize(pipeline.mixed_documents(spark, unlike, folder), "d")
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == want
    packed = pipeline.packed_sequences(spark, mixed, folder).collect()
    assert {p.doc_id for p in packed} == want


def test_stages_keep_columns_whose_names_clash(spark, folder):
    rows = [(1, "a b c d e f g", "x", 7), (2, "a b c d e f g", "y", 8), (None, None, None, None), (4, "p q r s t u v", "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _K string, _digest int")
    distinct = materialize(pipeline.distinct_documents(spark, docs, folder), "a")
    assert sorted(distinct.collect(), key=str) == sorted([r for r in docs.collect() if r.doc_id != 2], key=str)
    unlike = pipeline.unlike_documents(spark, docs, folder)
    assert unlike.columns == docs.columns and sorted((r["_K"] or "") for r in unlike.collect()) == ["", "x", "z"]


def test_stages_of_no_documents_and_of_odd_names(spark, folder):
    names = "doc_id long, text string, source string, `a.b` string, `c d` int"
    rows = [(1, "a b c d e f g", "s", "x", 7), (2, "h i j k l m n " * 3_000, "t", "y", 8), (3, "", None, None, None)]
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        for stage in (pipeline.good_documents, pipeline.distinct_documents, pipeline.unlike_documents, pipeline.mixed_documents):
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns
            if stage is not pipeline.good_documents:
                assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.collect()}
        assert {r.doc_id for r in pipeline.packed_sequences(spark, docs, folder).collect()} == {r.doc_id for r in docs.collect()}


def test_near_stage_drops_similarity_of_four_fifths(spark, folder):
    rows = []
    for i in range(8):
        base = [f"d{i}x{n}" for n in range(104)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base[:-4] + ["y"] * (i + 2))), (10 * i + 2, " ".join(base[:-18]))]
        rows.append((10 * i + 3, " ".join([f"z{n}" for n in range(10 + i)] + base)))
    want = {k for k, v in near_by_hand(rows, 80).items() if v[2]}
    assert want < {k for k, v in near_by_hand(rows, 85).items() if v[2]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.unlike_documents(spark, docs, folder).collect()} == want


def test_run_equals_stages(spark, folder):
    got = pipeline.run(spark, folder)
    total = sum(zlib.crc32(repr((r.doc_id, r.start, r.length)).encode()) for r in got.collect())
    again = pipeline.run(spark, folder)
    assert total == sum(zlib.crc32(repr((r.doc_id, r.start, r.length)).encode()) for r in again.collect())
    assert [name for name, _ in pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"] and pipeline.ORACLE_SQL is None
