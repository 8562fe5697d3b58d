import pytest
from pyspark.sql import functions as F

from revsift.operators import answers as an
from revsift.operators import chunking as ch
from revsift.sources.io import VectorTable
from tests.conftest import rows

TEXTS = [(1, "Only one sentence here."), (2, "First one. Second one!"), (3, ""),
         (4, "no terminator at all"), (5, "Alpha beta. Alpha beta. Gamma delta? Epsilon zeta. Eta theta.")]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_sentence_windows(spark):
    got = rows(ch.sentence_windows(_docs(spark)), "doc", "i", "window_text")
    assert (1, 0, "Only one sentence here.") in got
    assert (2, 0, "First one. Second one!") in got and (2, 1, "First one. Second one!") in got
    assert not any(r[0] == 3 for r in got)
    w5 = [r for r in got if r[0] == 5]
    assert w5[0][2] == "Alpha beta. Alpha beta." and w5[2][2] == "Alpha beta. Gamma delta? Epsilon zeta."


def test_semantic_chunks_cover_all_sentences(spark):
    out = ch.semantic_chunks(_docs(spark), partitions=3)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc, []).append((r.chunk_no, r.n_sentences, r.text))
    assert got[1] == [(0, 1, "Only one sentence here.")]  # one sentence -> one chunk
    assert 3 not in got  # empty text -> no chunk
    assert [c[2] for c in got[4]] == ["no terminator at all"]
    # chunks concatenate back to the sentence sequence, in order
    five = " ".join(t for _, _, t in sorted(got[5]))
    assert five == TEXTS[4][1]
    assert sum(n for _, n, _ in got[5]) == 5


def test_fixed_chunks_windows(spark):
    text = " ".join(f"w{i}" for i in range(1030))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "a b c")], "doc_id long, text string")
    got = rows(ch.fixed_chunks(df, size=512, overlap=10), "doc", "chunk_no", "n_tokens")
    # starts 0, 502, 1004; 1004 + 10 < 1030 so the third window is emitted
    assert got == [(1, 0, 512), (1, 1, 512), (1, 2, 26), (3, 0, 3)]
    df2 = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(512)))], "doc_id long, text string")
    # the second window would hold only the first window's overlap
    assert ch.fixed_chunks(df2, size=512, overlap=10).count() == 1


def test_build_index_writes_nodes_and_vectors(spark, tmp_path):
    path = str(tmp_path / "idx")
    nodes = ch.build_index(spark, _docs(spark), path, recreate=True)
    n = nodes.count()
    table = VectorTable(path + "/vectors", 64)
    assert n == table.read(spark).count() == table.count(spark)
    again = ch.build_index(spark, _docs(spark).limit(1), path, recreate=False)  # reused, not rebuilt
    assert again.count() == n


def test_citation_context_and_render(spark):
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first {query_str}")], "q long, rank int, text string")
    ctx = an.citation_context(hits).first().context
    assert ctx == "Source 1:\nfirst {query_str}\n\nSource 2:\nsecond"
    q = spark.createDataFrame([(1, "what?"), (2, "none")], "q long, text string")
    p = {r.q: r.prompt for r in an.render_prompts(an.citation_context(hits), q, "C={context_str}|Q={query_str}").collect()}
    assert p[1] == "C=Source 1:\nfirst {query_str}\n\nSource 2:\nsecond|Q=what?"  # braces in values stay
    assert p[2] == "C=|Q=none"
    with pytest.raises(KeyError):
        an.render("{missing}", query_str=F.lit("x"))


def test_reference_block_of_cut_texts_is_the_same(spark):
    hits = [(1, i, "biz", f"r{i}", text) for i, text in enumerate(["x" * n for n in (0, 900, 963, 964, 999, 1000, 1001, 5000)] + [None])]
    df = spark.createDataFrame(hits, "q long, rank int, biz_name string, review_id string, text string").withColumn("score", F.lit(1.0))
    cut = df.withColumn("text", an.reference_text("text"))
    assert cut.filter("length(text) > 1000").count() == 0
    assert an.reference_block(cut).first()["block"] == an.reference_block(df).first()["block"]


def test_reference_block_truncation_and_order(spark):
    suffix = len(" (Review ID: <REVIEW_ID>r</REVIEW_ID>)")
    t999, t1000 = "a" * (999 - suffix), "b" * (1000 - suffix)
    hits = spark.createDataFrame(
        [(1, 1, 0.9, "Cafe", "r", t999), (1, 2, 0.8, "Bar", "r", t1000), (1, 3, 0.7, "Cafe", "r", "c" * 1001),
         (2, 1, 0.1, "Low", "r", "x")],
        "q long, rank int, score double, biz_name string, review_id string, text string")
    blocks = {r.q: r.block for r in an.reference_block(hits).collect()}
    b = blocks[1]
    assert b.startswith("\n#### Referenced Paragraphs\n**Cafe**\n\n> " + t999 + " (Review ID")
    assert b.index("**Cafe**") < b.index("**Bar**")  # business order = best rank
    assert "\n\n> ..." + ("b" * (1000 - suffix)) in b  # exactly 1000 chars still gets ellipses
    assert b.count("**Cafe**") == 1
    assert 2 not in {r.q for r in an.reference_block(hits, min_score=0.5).collect()}
    answers = spark.createDataFrame([(1, "ans"), (3, "plain")], "q long, response string")
    out = {r.q: r.response for r in an.append_references(answers, an.reference_block(hits)).collect()}
    assert out[3] == "plain" and out[1].startswith("\nans\n\n\n#### Referenced")


def test_pair_turns(spark):
    conv = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "user", "u2"), (1, 3, "assistant", "a2"),
         (1, 4, "user", "u3")], "conv_id long, turn long, role string, text string")
    pairs = an.pair_turns(conv)
    assert rows(pairs, "turn", "user_text", "reply_text") == [(1, "u1", None), (2, "u2", "a2"), (4, "u3", None)]
    msgs = rows(an.pairs_to_messages(pairs), "turn", "k", "role", "text")
    assert msgs == [(1, 0, "user", "u1"), (2, 0, "user", "u2"), (2, 1, "assistant", "a2"), (4, 0, "user", "u3")]


def test_semantic_chunks_rows_stand_alone(spark):
    """Repeated ids, null texts, one sentence, sentences without words, a very
    long sentence: every row is cut for itself, as plain Python cuts it."""
    import hashlib
    import math
    import random
    import re
    from revsift.functions.text import SENTENCE_PATTERN, TOKEN_PATTERN
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(" ".join(rng.choices(vocab[k:k + 12], k=rng.randint(1, 9))) + rng.choice(".!?") for k in rng.choices(range(28), k=m))
             for m in (1, 2, 3, 4, 30, 60)]
    texts += ["", None, "One.", "... !!! ???", " ".join(rng.choices(vocab, k=30000)) + ". Then two. And three.", texts[4]]
    df = spark.createDataFrame([(i % 7, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, doc string")

    def plain(text):
        sents = [x for x in (s.strip(" ") for s in re.findall(SENTENCE_PATTERN, text or "")) if x]
        vecs = []
        for s in sents:
            v = [0] * 64
            for t in re.findall(TOKEN_PATTERN.replace(r"\p{L}\p{N}", r"a-z0-9"), s.lower()):
                h = hashlib.md5(t.encode()).hexdigest()
                v[int(h[:8], 16) % 64] += 1 - 2 * (int(h[8], 16) % 2)
            vecs.append(v)
        groups = [[sum(x) for x in zip(*vecs[max(0, i - 1):i + 2])] for i in range(len(vecs))]
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))
        d = []
        for a, b in zip(groups, groups[1:]):
            na, nb = dot(a, a), dot(b, b)
            d.append(round(1 - (dot(a, b) / (math.sqrt(na) * math.sqrt(nb)) if na and nb else 0.0), 9))
        place = 0.95 * (len(d) - 1)
        o = sorted(d)
        thr = None if not d else o[int(place)] if o[int(place)] == o[math.ceil(place)] else (
            (math.ceil(place) - place) * o[int(place)] + (place - int(place)) * o[math.ceil(place)])
        out = []
        for i, s in enumerate(sents):
            if i == 0 or d[i - 1] > thr:
                out.append([])
            out[-1].append(s)
        return [(k, len(c), " ".join(c)) for k, c in enumerate(out)]

    want = sorted((i % 7, *c) for i, t in enumerate(texts) for c in plain(t))
    got = sorted((r["doc"], r["chunk_no"], r["n_sentences"], r["text"]) for r in ch.semantic_chunks(df).collect())
    assert got == want and max(c[1] for c in want) >= 2
    assert ch.semantic_chunks(df.limit(0)).count() == 0


def test_semantic_chunks_count_words_once(spark, monkeypatch):
    """No expression over pairs of words is left, and a batch of sentences cut
    into slices gives the numbers of whole documents (F17)."""
    from tests.test_plans import plan_of
    p = plan_of(ch.semantic_chunks(_docs(spark)))
    assert "ArrowEvalPython" in p and "array_remove" not in p

    import pyarrow as pa
    texts = [[["a", "b"], ["c"], [], ["a", "a", "d"], ["b"]], None, [], [["e", "a"]], [["b"], ["a", "c"]]]
    docs = pa.array(texts, pa.list_(pa.list_(pa.string())))
    run = ch._group_dots(8)
    whole = run(docs).to_pylist()
    assert [len(x) for x in whole] == [5, 0, 0, 1, 2] and any(g["ahead"] for g in whole[0])
    assert [g["square"] for g in whole[3]] == [sum(c * c for c in _counts(["e", "a"], 8))]
    both = sum(c * c for c in _counts(["b", "a", "c"], 8))  # two sentences: both groups hold both
    assert whole[4] == [{"square": both, "ahead": both}, {"square": both, "ahead": 0}]
    for size in (1, 2, 3):
        monkeypatch.setattr(ch, "BATCH_TEXTS", size)
        assert run(docs).to_pylist() == whole


def _counts(toks, dim):
    import hashlib
    v = [0] * dim
    for t in toks:
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += 1 - 2 * (int(h[8], 16) % 2)
    return v


def test_reference_blocks_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    """Texts too large for the driver are looked up where the line items
    are: the same rows, for repeated, missing and null keys, no broadcast and no
    other shuffle."""
    from revsift.plans import queries_more as qm
    d = str(tmp_path)
    li = [(o, n, (o * n) % 7, None if o == 3 else (o * 5 + n) % 40, 20000.0 + 1000 * ((o * 7 + n) % 20)) for o in range(60) for n in range(1, 5)] + [(5, 1, 2, 9, 35000.0)]
    spark.createDataFrame(li, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, f"part {i % 3}") for i in range(6)], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    docs = [(i, f"text {i} é " * (i * 5), "x") for i in range(35)] + [(4, "again", "x"), (7, None, "x"), (None, "none", "x"), (900, "unused", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(o, "F", "1-URGENT") for o in range(62)], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    want = [rows(f(spark, d)) for f in (qm.q_reference_block, qm.q_append_references)]
    monkeypatch.setattr(qm, "TEXT_BYTES", 100)
    monkeypatch.setattr("revsift.operators.lookup.BUCKET_BYTES", 5000)
    assert [rows(f(spark, d)) for f in (qm.q_reference_block, qm.q_append_references)] == want
    assert sum("again" in r[1] for r in want[0]) > 1 and len(want[0]) == 60
    plan = qm.q_reference_block(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Join ") == 1  # names of parts
    plan = qm.q_append_references(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("ArrowEvalPython")]
    monkeypatch.undo()
    assert qm.TEXT_BYTES <= 64 << 20  # with its hash table it must fit the driver beside all else
