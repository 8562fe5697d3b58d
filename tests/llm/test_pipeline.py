"""The pipeline, stage by stage, against plain versions on its own input."""

import hashlib
import zlib  # noqa: F401
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from revsift.llm.quality import classify_documents
from revsift.llm.queries import piece_model

from .conftest import SMALL, documents
from .test_minhash import plain_set
from .test_mixing import plain_mix

LIB = sentencepiece.SentencePieceProcessor(model_file=piece_model())


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "source_mix", "sentencepiece"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    outs = []
    for n, f in corpus_pipeline.STAGES:
        f(spark, docs, SMALL).write.parquet(str(tmp_path / n))
        docs = spark.read.parquet(str(tmp_path / n))
        outs.append([r.asDict() for r in docs.collect()])
        assert n == "sentencepiece" or docs.columns == names
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    good = {r["doc_id"] for r in classify_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).filter("kept").collect()}
    assert sorted(r["doc_id"] for r in outs[0]) == sorted(good) and len(good) < len(rows)
    # near duplicates of the kept rows, all pairs
    sets = {r["doc_id"]: plain_set(r["text"], 5) for r in outs[0]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in outs[1]) == [i for i in ids if find(i) == i]
    # the mix of those
    src = [(r["doc_id"], r["text"], r["source"]) for r in outs[1]]
    size, _, _, taken = plain_mix(src)
    want = Counter({src[k][0]: taken[k] // size[k] for k in taken if size[k] and taken[k]})
    assert Counter(r["doc_id"] for r in outs[2]) == want
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    assert Counter(r["doc_id"] for r in outs[3]) == want
    for r in outs[3]:
        t = LIB.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(t) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, t)).encode()).hexdigest()
    assert sorted((r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()), key=str) == sorted(outs[3], key=str)


def test_dedup_stage_edges(spark):
    t = "some words that make a text of more than five words"
    df = documents(spark, [t, t, t, None, None, "", t + " x"], [4, 4, 9, 5, None, None, None])
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in stage("near_duplicates")(spark, df, "").collect())
    assert got == [(-1, ""), (-1, ""), (-1, t + " x"), (4, t), (5, "")]
    clash = df.withColumn("Rows", F.lit(7)).withColumn("kept", F.lit("x"))
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["Rows"], r["kept"]) for r in stage("near_duplicates")(spark, clash, "").collect()) == [
        (*g, 7, "x") for g in got]
    for n in ("quality", "near_duplicates", "source_mix", "sentencepiece"):
        assert stage(n)(spark, df.limit(0), "").count() == 0
