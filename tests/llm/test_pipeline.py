from pathlib import Path

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corvine.llm import neardup, textops
from tests.llm.conftest import prose, table

SF = "/root/testdata/sf0.001"


def test_stages_in_order_on_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    final = corpus_pipeline.run(spark, SF)
    rows = final.collect()
    assert final.columns[: len(docs.columns)] == docs.columns and 0 < len(rows) <= docs.count()
    assert all(r.taken == r.copies * r.size and r.copies >= 1 for r in rows)
    assert not any("@mail" in r.text for r in rows)


def test_each_stage_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(3, 30)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(last.columns)
    kept = {n: {str(r.doc_id) for r in stage(spark, odd, str(tmp_path)).collect()} for n, stage in corpus_pipeline.STAGES}
    every = {str(r.doc_id) for r in odd.collect()}
    assert kept["toxicity"] == kept["pii"] == every and every - kept["near_duplicates"] == {"2", "8"}
    assert every - kept["decontamination"] == {"None"} and {"3", "4", "5"}.isdisjoint(kept["mixing"])


def test_run_deletes_what_it_has_read(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} <= {r.doc_id for r in odd.collect()} and "copies" in final.columns
    (folder,) = {Path(f.removeprefix("file://")).parent.parent for f in final.inputFiles()}
    assert [p.name for p in folder.iterdir()] == ["mixing"]


def test_near_duplicates_do_not_hang_on_the_size_of_a_bucket(spark, monkeypatch):
    # Two texts at the limit meet only in buckets that a third, unlike both, leads; sketches drawn afresh would not meet.
    hashes = lambda words: textops.words(*textops.utf8(pa.array([" ".join(words)])))[3]
    for seed in range(100_000):
        a = [f"{w}{seed}x{i}" for i, w in enumerate(prose(seed, 35).split())]
        b = [f"new{i}" if i % 5 == 2 else w for i, w in enumerate(a)]
        x, y = hashes(a), hashes(b)
        if not len(np.intersect1d(neardup.sketches(x, 1), neardup.sketches(y, 1))):
            met = np.intersect1d(neardup.sketches(x), neardup.sketches(y))
            if len(met) and np.isin(met, neardup.sketches(hashes(a[:26]))).all():
                break
    docs = table(spark, [(1, " ".join(a[:26]), "en", "s"), (2, " ".join(a), "en", "s"), (3, " ".join(b), "en", "s")])
    for large in (neardup.LARGE, 0):
        monkeypatch.setattr(neardup, "LARGE", large)
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_stages_send_few_texts_to_python_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = table(spark, [(i, prose(i, 5), "en", "s") for i in range(2500)]).coalesce(1), spark.conf.get(name)
    rows = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    try:
        for own, most in (("10000", 1000), ("0", 1000), ("700", 700)):
            spark.conf.set(name, own)
            redacted = corpus_pipeline.redact_personal_data(spark, docs, "")
            sent = [r.n for r in redacted.select("text").mapInArrow(rows, "n long").collect()]
            assert max(sent) <= most and sum(sent) == 2500
    finally:
        spark.conf.set(name, before)
