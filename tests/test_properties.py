"""Property-based checks (hypothesis) on small random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from revsift.operators import evaluate as ev
from revsift.operators import prepare as pp
from revsift.operators import retrieval as rt
from tests.conftest import rows

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

ranked_lists = st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12, unique=True), min_size=2, max_size=3)


@SETTINGS
@given(lists=ranked_lists)
def test_rrf_is_invariant_to_list_order(spark, lists):
    dfs = [spark.createDataFrame([(1, d, r + 1) for r, d in enumerate(l)], "q long, doc long, rank int")
           for l in lists]
    a = rows(rt.rrf(dfs, k=50))
    b = rows(rt.rrf(list(reversed(dfs)), k=50))
    assert a == b
    # scores follow the definition
    want = {}
    for l in lists:
        for r, d in enumerate(l):
            want[d] = want.get(d, 0.0) + 1.0 / (60 + r + 1)
    assert {doc: sc for _, _, doc, sc in a} == {d: round(v, 6) for d, v in want.items()}


@SETTINGS
@given(n=st.integers(0, 40), parts=st.integers(1, 7), seed=st.integers(0, 99))
def test_sample_exact_is_exact_and_partition_free(spark, n, parts, seed):
    df = spark.range(25).withColumnRenamed("id", "k")
    a = rows(pp.sample_exact(df, n, "k", seed))
    b = rows(pp.sample_exact(df.repartition(parts), n, "k", seed))
    assert a == b and len(a) == min(n, 25)


@SETTINGS
@given(ret=st.lists(st.integers(0, 15), max_size=10, unique=True),
       rel=st.lists(st.integers(0, 15), max_size=6, unique=True), k=st.integers(1, 10))
def test_metric_invariants(spark, ret, rel, k):
    q = spark.createDataFrame([(1,)], "q long")
    ranked = spark.createDataFrame([(1, r + 1, d) for r, d in enumerate(ret)], "q long, rank int, doc long")
    qrels = spark.createDataFrame([(1, d) for d in rel], "q long, doc long")
    r = ev.retrieval_metrics(q, ranked, qrels, k=k).first()
    if not rel:
        assert r.hit_rate is None
        return
    for m in ev.METRICS:
        assert 0.0 <= getattr(r, m) <= 1.0
    hits = [d for d in ret[:k] if d in rel]
    assert (r.hit_rate == 1.0) == bool(hits) == (r.mrr > 0)
    assert r.recall == round(len(hits) / len(rel), 6)
