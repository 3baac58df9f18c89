"""The stages of the pipeline on small and odd tables."""

import shutil

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_packing import check_packed
from tests.llm.test_repeats import want_bytes
from tests.llm.test_shingles import keep_first

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good_rows = good.collect()
    kept = {r.doc_id for r in good_rows}
    assert all(d in kept for d, q in labels.items() if q == 1)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())

    single = stages["near_duplicates"](spark, good, SF)
    assert single.columns == docs.columns
    single_rows = single.collect()
    kept = keep_first([(r.doc_id, r.text) for r in good_rows])
    assert sorted(single_rows) == sorted(good_rows[k] for k in kept)

    cut = stages["repeated_strings"](spark, single, SF)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    want = {d: k.decode(errors="ignore") for d, _, _, _, k in want_bytes([(r.doc_id, r.text) for r in single_rows], 200)}
    cut_rows = cut.collect()
    assert {r.doc_id: r.text for r in cut_rows} == want
    assert all(r.n_chars == len(r.text) for r in cut_rows)

    packed = pipeline.run(spark, SF).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in cut_rows], 2048)


@pytest.fixture
def odd_dir(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("labels", [(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    yield tmp_path, write
    shutil.rmtree(tmp_path)


def test_odd_documents(spark, odd_dir):
    folder, write = odd_dir
    e = "é" * 120
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, None, None, None, None), (3, "x " + e, "fr", "b", 5),
        (4, "y " + e + "z", None, "b", 5), (5, "a b c d e f", "en", "a", 11), (5, "a b c d e f", "en", "a", 11),
    ]
    write("documents", rows, SCHEMA)
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(folder)).columns == docs.columns
    single = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in single) == [(1, None), (3, "x " + e), (4, "y " + e + "z"), (5, "a b c d e f")]
    # the passage and the blank before it occur in both
    cut = {r.doc_id: (r.text, r.n_chars) for r in pipeline.cut_repeats(spark, docs, "").collect() if r.doc_id in (1, 2, 3, 4)}
    assert cut == {1: (None, None), 2: ("", 0), 3: ("x", 1), 4: ("yz", 2)}
    assert pipeline.run(spark, str(folder)).count() >= 1


def test_columns_of_any_name(spark, odd_dir):
    folder, write = odd_dir
    names = ["llm_place", "llm_null", "row", "place", "kept", "spans", "new_text", "id", "text_2", "predicted", "score"]
    rows = [(i, f"text {i} " + "é" * 150 * (i > 1), "en", "a", 5, *[f"{n}{i}" for n in names]) for i in range(4)]
    write("documents", rows, SCHEMA + "".join(f", {n} string" for n in names))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(folder))
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_no_documents(spark, odd_dir):
    folder, write = odd_dir
    write("documents", [], SCHEMA)
    assert pipeline.run(spark, str(folder)).count() == 0
