"""The pipeline's stages one after another, and the subpackage's place in the library."""

import os
import re

from llm_data import SMALL, PASSAGE, frame

import corpus_pipeline
from sheafline.llm import streaming_viterbi


def test_stages_take_effect(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = [(f"Sentence {i} of a calm text about topic {i * 7}, " * 1) + " ".join(f"plain{i}word{j}" for j in range(90)) for i in range(4)]
    near = clean[0].replace("plain0word40", "changed")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (10**6, clean[0], "en", "x"),
        (10**6 + 1, near, "en", "x"),
        (10**6 + 2, clean[1] + " " + PASSAGE, "en", "x"),
        (10**6 + 3, PASSAGE + " " + clean[2], "en", "x"),
        (10**6 + 4, clean[3] + " " + item, "en", "x"),
    ]
    docs = base.unionByName(frame(spark, rows).select(*base.columns))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == base.columns
        docs = spark.createDataFrame(docs.collect(), base.schema)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got[10**6] == clean[0] and 10**6 + 1 not in got
    assert "passage30" not in got[10**6 + 2] + got[10**6 + 3] and "plain2word5" in got[10**6 + 3]
    assert got[10**6 + 4].strip() == clean[3]


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    out = corpus_pipeline.run(spark, SMALL)
    assert out.filter("not same").count() == 0
    text = streaming_viterbi.decode(out, streaming_viterbi.default_vocabulary())
    assert text.filter("text is null").count() == out.filter("ids is null").count()
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.collect()}


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(top, "sheafline")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(folder, name)).read()), name
