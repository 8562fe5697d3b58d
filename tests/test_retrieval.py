import math
import re

from pyspark.sql import functions as F

from revsift.operators import retrieval as rt
from revsift.operators.embed import hash_embed, hash_embed_sparse, normalize
from tests.conftest import rows

DOCS = [(1, "The cat sat on the mat."), (2, "Dogs chase cats in the park."),
        (3, "A quiet mat for a quiet cat."), (4, "Stock markets fell sharply today."),
        (5, "")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def _bm25_reference(queries, docs, k1=1.5, b=0.75, stop=None, stem=None):
    """Brute-force BM25 in plain Python (the definition, not the plan)."""
    import re
    stop = set(stop or [])

    def toks(t):
        words = [w for w in re.findall(r"[^\W_]+", t.lower()) if w not in stop]
        return [stem(w) for w in words] if stem else words
    dt = {d: toks(t) for d, t in docs}
    n = len(dt)
    avgdl = sum(len(v) for v in dt.values()) / n
    df = {}
    for v in dt.values():
        for w in set(v):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in queries:
        for d, v in dt.items():
            s, hit = 0.0, False
            for w in set(toks(text)):
                if w in df and w in v:
                    hit = True
                    tf = v.count(w)
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += toks(text).count(w) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(v) / avgdl))
            if hit:
                out[(q, d)] = round(s, 6)
    return out


def test_bm25_matches_brute_force(spark):
    from revsift.functions.text import STOP_WORDS
    queries = [(10, "cat on a mat"), (11, "cats cats park"), (12, "the of and"), (13, "unknownword")]
    q = spark.createDataFrame(queries, "q long, text string")
    got = {(r.q, r.doc): r.score for r in rt.bm25_topk(q, _docs(spark), k=50).collect()}
    assert got == _bm25_reference(queries, DOCS, stop=STOP_WORDS)
    assert not any(k[0] in (12, 13) for k in got)  # empty after stop words / absent term


def test_bm25_salted_path_equals_broadcast_path(spark):
    q = spark.createDataFrame([(10, "cat mat"), (11, "dogs park cats")], "q long, text string")
    a = rows(rt.bm25_topk(q, _docs(spark), k=5))
    b = rows(rt.bm25_topk(q, _docs(spark), k=5, max_broadcast_rows=0, salt_buckets=4))
    assert a == b


def test_pruned_bm25_beyond_the_broadcast_bound(spark):
    q = spark.createDataFrame([(10, "cat mat"), (11, "dogs park cats")], "q long, text string")
    got, status = rt.bm25_topk_pruned(q, _docs(spark), k=5, max_broadcast_rows=0, with_status=True)
    assert rows(got) == rows(rt.bm25_topk(q, _docs(spark), k=5)) and rows(status) == [(10, False), (11, False)]


def test_query_equal_to_a_document_ranks_it_first(spark):
    docs = _docs(spark)
    q = spark.createDataFrame([(7, DOCS[3][1])], "q long, text string")
    top = rt.bm25_topk(q, docs, k=1).collect()
    assert top[0].doc == 4
    dv = hash_embed(docs, "doc_id", "text")
    qv = hash_embed(q, "q", "text")
    dtop = rt.dense_topk(qv, dv, k=1, id_col="doc_id").collect()
    assert dtop[0].id == 4 and abs(dtop[0].score - 1.0) < 1e-9


def test_hash_embed_unit_vectors_and_empty_text(spark):
    docs = _docs(spark)
    v = {r.doc_id: r.embedding for r in hash_embed(docs, "doc_id", "text").collect()}
    assert 5 not in v  # no tokens -> no vector
    for vec in v.values():
        assert len(vec) == 64 and abs(sum(x * x for x in vec) - 1) < 1e-9
    sp = hash_embed_sparse(docs, ["doc_id"], "text").groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in sp.collect())


def test_dense_topk_exact_against_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "id long, embedding array<double>")
    q = df.withColumnRenamed("id", "q")
    got = rt.dense_topk(q, df.repartition(3), k=5, exclude_self=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    for r in got.filter("rank = 1").collect():
        assert r.id == int(np.argmax(sims[r.q]))
    assert got.groupBy("q").count().filter("count != 5").count() == 0
    # many small query blocks and corpus cells give the same rows
    blocked = rt.dense_topk(q, df, k=5, exclude_self=True, block_bytes=700, parts=40)
    assert rows(blocked) == rows(got)


def test_dense_topk_of_any_vectors_and_ids(spark):
    """Cosine on vectors of any length, text ids, unusable vectors, repeated
    ids and rows on either side, extra columns."""
    import numpy as np
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 5)) * rng.uniform(0.01, 100, size=(40, 1))
    corpus = [(f"n:{i}", m[i].tolist()) for i in range(40)]
    corpus += [("n:3", m[7].tolist()), ("n:5", m[5].tolist()), ("zero", [0.0] * 5), ("null", None), (None, m[1].tolist()),
               ("nan", [float("nan")] * 5), ("hole", [1.0, None, 1.0, 1.0, 1.0]), ("empty", [])]
    queries = [(i, (m[i] * 3).tolist()) for i in range(10)] + [(0, m[20].tolist()), (4, (m[4] * 3).tolist()), (99, [0.0] * 5), (98, None), (None, m[0].tolist())]
    c = spark.createDataFrame([(*r, 1) for r in corpus], "id string, embedding array<double>, q int").repartition(4)
    q = spark.createDataFrame([(*r, "x") for r in queries], "q long, embedding array<double>, id string")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = []
    for i in range(10):
        mine = [unit[i]] + ([unit[20]] if i == 0 else [])
        score = {f"n:{j}": max(float(u @ unit[j]) for u in mine) for j in range(40)}
        score["n:3"] = max(score["n:3"], *(float(u @ unit[7]) for u in mine))
        best = sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:6]
        want += [(i, r, n, round(s, 6)) for r, (n, s) in enumerate(best, 1)]
    for kw in ({}, {"block_bytes": 100, "parts": 12}):
        got = rows(rt.dense_topk(q, c, k=6, **kw), "q", "rank", "id", "score")
        assert [(a, b, i, round(s + 0.0, 6)) for a, b, i, s in got] == sorted(want, key=repr)
    assert rt.dense_topk(q.limit(0), c, k=6).count() == 0 and rt.dense_topk(q, c.limit(0), k=6).count() == 0
    # one query far longer than a corpus row of its own direction
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [10.0, 10.0])], "id int, embedding array<float>")
    first = rt.dense_topk(two.limit(1).withColumnRenamed("id", "q"), two, k=2).collect()
    assert [(r.id, r.score) for r in sorted(first, key=lambda r: r.rank)] == [(1, 1.0), (2, round(2 ** -0.5, 6))]


def test_dense_cell_holds_few_rows_of_many_copies():
    """2,000 copies of each of three vectors: a cell keeps the smallest ids of
    the nearest, whatever the order of arrival, and little else."""
    import numpy as np
    import pyarrow as pa

    from revsift.operators import dense
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 16))
    ids = rng.permutation(6000)
    cell = dense._Cell(4, True)
    keys = np.arange(0, 6000, 7)
    cell.queries(pa.array(keys), pa.array(list(base[keys % 3])))
    for s in range(0, 6000, 512):
        part = ids[s:s + 512]
        cell.corpus(pa.array(part), pa.array(list(base[part % 3])))
    out = cell.result((pa.int64(), pa.int64())).to_pandas()
    assert len(out) <= 8 * 4 * len(keys)
    out["score"] = out["score"].round(6)
    best = out.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q")["id"].apply(lambda x: list(x[:4]))
    assert all(best[q] == [i for i in range(q % 3, 6000, 3) if i != q][:4] for q in keys)


def test_mmr_with_text_ids_and_long_vectors(spark):
    vecs = [("a", [10.0, 0.0]), ("b", [0.999, 0.0447]), ("c", [60.0, 80.0]), ("z", [0.0, 0.0])]
    v = spark.createDataFrame(vecs, "id string, embedding array<double>")
    cands = spark.createDataFrame([("x", "a", 0.99), ("x", "b", 0.98), ("x", "c", 0.70), ("x", "z", 0.9)], "q string, id string, score double")
    out = [r.id for r in rt.mmr_topk(cands, v, k=2).orderBy("rank").collect()]
    assert out == ["a", "c"]


def test_rrf_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, doc long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q long, doc long, rank int")
    out = rows(rt.rrf([a, b], k=10), "rank", "doc", "score")
    # 11 is in both lists; 10 and 12 tie exactly and the id breaks it
    assert out == [(1, 11, round(1 / 62 + 1 / 61, 6)), (2, 10, round(1 / 61, 6)), (3, 12, round(1 / 62, 6))]
    swapped = rows(rt.rrf([b, a], k=10), "rank", "doc", "score")
    assert swapped == out


def test_score_cutoff_none_and_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.1,), (0.5,)], "score double")
    assert rt.score_cutoff(df, None).count() == 3
    assert rt.score_cutoff(df, 0).count() == 2


def test_mmr_prefers_diverse_items(spark):
    vecs = [(1, [1.0, 0.0]), (2, [0.999, 0.0447]), (3, [0.6, 0.8])]
    v = spark.createDataFrame(vecs, "id long, embedding array<double>")
    cands = spark.createDataFrame([(0, 1, 1, 0.99), (0, 2, 2, 0.98), (0, 3, 3, 0.70)],
                                  "q long, rank int, id long, score double")
    out = [r.id for r in rt.mmr_topk(cands, v, k=2).orderBy("rank").collect()]
    assert out == [1, 3]


def test_overlap_rerank_and_normalize(spark):
    df = spark.createDataFrame([("cat mat", "a cat on a mat"), ("the", "x")], "q string, d string")
    got = [r.s for r in df.select(rt.overlap_score(F.col("q"), F.col("d")).alias("s")).collect()]
    assert got == [1.0, 0.0]
    z = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.n for r in z.select(normalize(F.col("v")).alias("n")).collect()] == [None, [0.6, 0.8]]


def test_porter_stemmer_and_stemmed_bm25(spark):
    from revsift.functions.stem import stem_vocabulary
    from tests.porter_plain import porter
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
             "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi",
             "relational": "relat", "conditional": "condit", "generalization": "gener", "adjustment": "adjust",
             "controlling": "control", "rolling": "roll", "électricité": "électricité", "a": "a"}
    assert {w: porter(w) for w in cases} == cases
    v = stem_vocabulary(spark.createDataFrame([("running",), ("runs",), (None,)], "term string"))
    assert rows(v) == [("running", "run"), ("runs", "run")]
    q = spark.createDataFrame([(1, "cat")], "q long, text string")
    plain = {r.doc for r in rt.bm25_topk(q, _docs(spark), k=10).collect()}
    stemmed = {r.doc for r in rt.bm25_topk(q, _docs(spark), k=10, stem=True).collect()}
    assert plain == {1, 3} and stemmed == {1, 2, 3}  # "cats" in doc 2 now matches


def test_postings_rerank_equals_text_rerank(spark):
    from revsift.operators.distributed import cut_lineage
    docs = _docs(spark)
    q = spark.createDataFrame([(10, "cat on a mat"), (11, "dogs park cats"), (12, "the of")], "q long, text string")
    corpus = cut_lineage(rt.corpus_postings(docs))
    cands = rt.bm25_topk(q, docs, k=5, index=rt.bm25_index(docs, corpus=corpus))
    cands = cands.unionByName(spark.createDataFrame([(12, 1, 1, 0.0)], "q long, rank int, doc long, score double"))
    a = rows(rt.rerank_overlap_postings(cands, q, corpus, k=3))
    b = rows(rt.rerank(cands, q, docs, k=3))
    assert a == b


def test_persisted_index_matches_one_shot_search(spark, tmp_path):
    from revsift.operators.index import HybridIndex
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS q", "text")
    idx = HybridIndex.build_or_load(spark, str(tmp_path / "idx"), docs)
    a = rows(idx.search(q))
    b = rows(rt.hybrid_search(q, docs))
    assert a == b and len(a) > 0
    again = HybridIndex.build_or_load(spark, str(tmp_path / "idx"), docs.limit(0))  # reused, not rebuilt
    assert again.postings.count() == idx.postings.count()
    assert rows(idx.bm25(q, k=5)) == rows(rt.bm25_topk(q, docs, k=5))


def test_bm25_dedupe_equals_plain(spark):
    q = spark.createDataFrame([(1, "Cat mat"), (2, "the cat, mat!"), (3, "dogs park"), (4, "the")],
                              "q long, text string")
    assert rows(rt.bm25_topk(q, _docs(spark), k=3, dedupe=True)) == rows(rt.bm25_topk(q, _docs(spark), k=3))


def test_bm25_dedupe_with_repeated_rows(spark):
    q = spark.createDataFrame([(1, "cat mat"), (1, "cat mat"), (2, "mat cat"), (3, "cat mat cat mat")], "q long, text string")
    assert rows(rt.bm25_topk(q, _docs(spark), k=3, dedupe=True)) == rows(rt.bm25_topk(q, _docs(spark), k=3))


def test_fusion_counts_the_lists_of_both_forms(spark):
    """The question and its keyword form each give a list by words and one by vectors."""
    q = spark.createDataFrame([("a", "the cat on a mat"), ("b", "dogs park")], "q string, text string")
    forms = rt.query_variants(q).select("qv", "text")
    words = rt.bm25_topk(forms.withColumnRenamed("qv", "q"), _docs(spark))
    vectors = rt.dense_topk(hash_embed(forms, "qv", "text"), hash_embed(_docs(spark), "doc_id", "text"), q_col="qv", id_col="doc_id")
    want = {}
    for r in words.select("q", "rank", "doc").collect() + vectors.select("q", "rank", "id").collect():
        key = (r["q"][2:], r[2])
        want[key] = want.get(key, 0.0) + 1.0 / (60 + r["rank"])
    got = {(r["q"], r["doc"]): r["score"] for r in rt.hybrid_candidates(q, _docs(spark)).collect()}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_pruned_bm25_equals_exhaustive(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS q", "text")
    q = q.unionByName(spark.createDataFrame([(900, "the of"), (901, "zzzunknown")], "q long, text string"))
    a = rows(rt.bm25_topk(q, docs, k=10, prune=True))
    b = rows(rt.bm25_topk(q, docs, k=10, prune=False))
    assert a == b and len(a) > 0
    # a generous rare fraction settles most queries through candidates only
    c = rows(rt.bm25_topk_pruned(q, docs, k=10, rare_fraction=0.5))
    assert c == b


def test_persisted_index_auto_prunes_exactly(spark, tmp_path):
    from revsift.operators.index import HybridIndex
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS q", "text")
    idx = HybridIndex.build_or_load(spark, str(tmp_path / "idx"), docs)
    auto = rows(idx.bm25(q, k=10, prune_min_rows=0))      # estimate > 0 -> pruned path
    plain = rows(idx.bm25(q, k=10, prune=False))
    assert auto == plain == rows(rt.bm25_topk(q, docs, k=10))


def test_stemmed_bm25_matches_brute_force(spark):
    from tests.porter_plain import porter
    from revsift.functions.text import STOP_WORDS
    docs = DOCS + [(6, "Running runners ran; the cats are running.")]
    queries = [(20, "running cat"), (21, "runs"), (22, "the")]
    q = spark.createDataFrame(queries, "q long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.q, r.doc): r.score for r in rt.bm25_topk(q, d, k=50, stem=True).collect()}
    assert got == _bm25_reference(queries, docs, stop=STOP_WORDS, stem=porter)


def test_stemmer_columns_match_word_by_word(spark):
    import random
    from revsift.functions.stem import STEP2, STEP3, STEP4, stem_vocabulary
    from tests.porter_plain import porter
    rng = random.Random(3)
    ends = [a for a, _ in STEP2 + STEP3] + list(STEP4) + ["s", "es", "sses", "ies", "ed", "eed", "ing", "y", "e", "ll", "ly", ""]
    words = {"".join(rng.choices("aeiouybcdlstwxz", k=rng.randint(0, 7))) + rng.choice(ends) + rng.choice(ends) for _ in range(20000)}
    words |= {"y" * k for k in range(1, 9)} | {"by" + "y" * k + "ing" for k in range(4)} | {"", "Ünïcode", "x1s", "is", "falling", "a" * 100_000 + "tional"}
    v = stem_vocabulary(spark.createDataFrame([(w,) for w in sorted(words)] + [(None,), ("is",)], "word string"), "word")
    got = {r["word"]: r["stem"] for r in v.collect()}
    assert got == {w: porter(w) for w in words}
    assert "Python" not in v._jdf.queryExecution().executedPlan().toString()


def test_stem_twin_matches_word_by_word():
    import duckdb
    from revsift.plans.oracle_stem import stem_ctes
    from tests.porter_plain import porter
    words = ["caresses", "ponies", "feed", "agreed", "hopping", "filing", "sky", "syzygy", "relational", "adoption", "controll", "é", "is", "byyying"]
    src = " UNION ALL ".join(f"SELECT '{w}' AS term" for w in words)
    got = dict(duckdb.sql(f"WITH {stem_ctes(src)} SELECT term, stem FROM stems").fetchall())
    assert got == {w: porter(w) for w in words}


def test_stemmer_sees_every_word_once(spark, monkeypatch):
    """the words are distinct before they are stemmed, whatever joins follow;
    a stem spelled as a stop word counts, and N and avgdl stay those of all words."""
    from revsift.functions import stem as st
    from revsift.functions.text import STOP_WORDS
    from tests.porter_plain import porter
    docs = DOCS + [(6, "Ins and outs: ins, outs!"), (7, "the in on"), (8, ""), (9, None)] + [(100 + i, "running runs outs " * 40) for i in range(20)]
    queries = [(20, "ins outs"), (21, "runs"), (22, "the in")]
    q = spark.createDataFrame(queries, "q long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    seen, plain = spark.sparkContext.accumulator(0), st.stem

    def counted(word):
        def one(w):
            seen.add(1)
            return w
        return plain(F.udf(one, "string")(word))
    monkeypatch.setattr(st, "stem", counted)
    got = {(r.q, r.doc): r.score for r in rt.bm25_topk(q, d, k=50, stem=True).collect()}
    words = {w for _, t in docs for w in re.findall(r"\w+", (t or "").lower())}
    assert seen.value <= 3 * (len(words) + 3)  # of 2400 occurrences and more
    monkeypatch.undo()
    index = rt.bm25_index(d, stem=True, query_stems=spark.createDataFrame([("in",), ("out",), ("run",)], "term string"))
    assert got == {(r.q, r.doc): r.score for r in rt.bm25_topk(q, d, k=50, index=index, stem=True).collect()}
    assert (20, 6) in got and (21, 100) in got and not any(k[0] == 22 for k in got)
    want = _bm25_reference(queries, [(i, t or "") for i, t in docs if t is not None], stop=STOP_WORDS, stem=porter)
    assert set(got) == set(want)
