"""The pipeline against the plain versions, stage after stage."""

import __spark_entry__
import corpus_pipeline

from . import brute
from .test_operators import SCHEMA, corpus


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.collect()}
    assert ids == {4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 17, 18, 19}
    texts = brute.lines([(i, t) for i, t in corpus() if i in ids])
    groups = brute.groups(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    words = brute.passages(list(texts.items()))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(words)
    for name in list(stage)[:-1]:
        docs = stage[name](spark, docs, str(tmp_path))
    assert {r["doc_id"]: brute.WORD.findall(r["text"]) for r in docs.collect()} == words


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(n for n in names if n.startswith("op")) and len([n for n in names if n.startswith("op") and n[2].isdigit()]) == 13
