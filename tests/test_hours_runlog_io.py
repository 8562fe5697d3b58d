import json
import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from revsift.operators import hours as hr
from revsift.operators import runlog as rl
from revsift.sources import io as sio
from tests.conftest import rows


def _hours(spark):
    data = [("b1", {"Monday": "9:30-22:30", "Tuesday": None, "Wednesday": "18:0-2:0", "Thursday": "0:0-0:0"})]
    return hr.parse_hours(spark.createDataFrame(data, "business_id string, hours map<string,string>"))


def _py_slots(bid, t):
    seed = int(hashlib.sha256(f"{bid}_{t.strftime('%Y-%m-%d_%H')}".encode()).hexdigest(), 16) % 10 ** 8
    return 0 if seed % 5 == 0 else 1 + (seed // 5) % 10


def test_is_open_rules(spark):
    # 2024-01-01 is a Monday
    reqs = [(1, "b1", dt.datetime(2024, 1, 1, 22, 15)), (2, "b1", dt.datetime(2024, 1, 1, 9, 0)),
            (3, "b1", dt.datetime(2024, 1, 2, 12, 0)), (4, "b1", dt.datetime(2024, 1, 3, 23, 0)),
            (5, "b1", dt.datetime(2024, 1, 4, 0, 0)), (6, "b1", dt.datetime(2024, 1, 5, 12, 0)),
            (7, "zz", dt.datetime(2024, 1, 1, 12, 0))]
    df = spark.createDataFrame(reqs, "id int, business_id string, ts timestamp_ntz")
    got = dict(rows(hr.is_open(df, _hours(spark)), "id", "is_open"))
    # closes 22:30 -> closed at 22:15; opens 9:30 -> open at 9:00; NULL day; overnight; 0-0; absent day; unknown
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    over = dict(rows(hr.is_open(df, _hours(spark), overnight=True), "id", "is_open"))
    assert over[4] is True


def test_slots_match_python_sha256(spark):
    ts = [dt.datetime(2024, 1, 1, h, 7) for h in range(24)]
    df = spark.createDataFrame([("b1", t) for t in ts], "business_id string, ts timestamp_ntz")
    got = [r.s for r in df.select(hr.slots(F.col("business_id"), F.col("ts")).alias("s")).collect()]
    assert got == [_py_slots("b1", t) for t in ts]
    assert 0 in got or all(s >= 1 for s in got)


def test_availability_range_inclusive_and_empty(spark):
    reqs = [(1, "b1", dt.datetime(2024, 1, 1, 20, 45), dt.datetime(2024, 1, 1, 22, 45), 1),
            (2, "b1", dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 1, 10, 0), 1),
            (3, "b1", dt.datetime(2024, 1, 1, 11, 0), dt.datetime(2024, 1, 1, 10, 0), 1)]
    df = spark.createDataFrame(reqs, "id int, business_id string, start timestamp_ntz, end timestamp_ntz, pax int")
    out = hr.availability_range(df, _hours(spark))
    got = rows(out, "id", "hour", "ok")
    assert [(i, h) for i, h, _ in got] == [(1, "2024-01-01 20:00"), (1, "2024-01-01 21:00"),
                                          (1, "2024-01-01 22:00"), (2, "2024-01-01 10:00")]
    assert got[2][2] is False  # 22:45 is past the 22 close hour
    assert got[0][2] == (_py_slots("b1", dt.datetime(2024, 1, 1, 20, 45)) >= 1)
    js = hr.availability_json(out, ["id"]).filter("id = 1").first().availability
    assert list(__import__("json").loads(js)) == ["2024-01-01 20:00", "2024-01-01 21:00", "2024-01-01 22:00"]


def test_sql_functions_and_now_label(spark):
    names = hr.register_functions(spark)
    assert names[:3] == ["is_open_hour", "slot_count", "now_label"]
    r = spark.sql("SELECT is_open_hour(9, 22, 21) AS a, is_open_hour(9, 22, 22) AS b, "
                  "is_open_hour(NULL, 22, 10) AS c, "
                  "slot_count('b1', TIMESTAMP_NTZ'2024-01-01 20:45:00') AS s, now_label() AS n").first()
    assert (r.a, r.b, r.c) == (True, False, False)
    assert r.s == _py_slots("b1", dt.datetime(2024, 1, 1, 20, 45))
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{6})? \([A-Z][a-z]+day\)", r.n)
    stamps = spark.createDataFrame([(dt.datetime(2024, 8, 17, 12, 34, 56),), (dt.datetime(2024, 8, 17, 12, 34, 56, 5),)],
                                   "t timestamp_ntz")
    got = [x.s for x in stamps.select(hr.iso_micros("t").alias("s")).collect()]
    assert got == ["2024-08-17T12:34:56", "2024-08-17T12:34:56.000005"]
    assert re.fullmatch(r".* \([A-Z][a-z]+day\)", spark.range(1).select(hr.now_label().alias("n")).first().n)


def test_parse_collect_rules(spark):
    lines = spark.createDataFrame([
        (1, "no tag here"), (2, "[COLLECT] a.b=1 "), (3, "[COLLECT] c=2"), (4, "x [COLLECT]  d=hello tail"),
        (5, "[COLLECT] a.b=2.5 and [COLLECT] e=9 "), (6, "[COLLECT] f=1_000 ")], "line_no long, line string")
    got = dict(rows(rl.parse_collect(lines)))
    # c has no whitespace after its value -> no match; repeated key -> last; text -> NULL
    assert got == {"a_b": 2.5, "d": None, "f": None}


def test_flatten_struct(spark):
    df = spark.sql("SELECT named_struct('a', named_struct('b', named_struct('c', 1)), 'l', array(1, 2), "
                   "'e', named_struct()) AS cfg, 5 AS top")
    out = rl.flatten_struct(df)
    assert out.columns == ["cfg__a__b__c", "cfg__l", "top"]
    assert tuple(out.first()) == (1, [1, 2], 5)


def test_log_metrics_and_spans(spark, tmp_path):
    wide = spark.createDataFrame([(0.5, 3)], "mrr double, n long")
    long_ = rl.log_metrics(wide, prefix="top_5_retrieval_eval_", run="r1")
    assert rows(long_) == [("top_5_retrieval_eval_mrr", 0.5, "r1"), ("top_5_retrieval_eval_n", 3.0, "r1")]
    rl.write_metrics(long_, str(tmp_path / "m"))
    rl.write_metrics(long_, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4
    ev = spark.createDataFrame([
        ("e1", None, "query", "start", 1), ("e1", None, "query", "end", 5),
        ("e2", "e1", "retrieve", "start", 2), ("e2", "e1", "retrieve", "end", 3),
        ("e3", None, "embedding", "start", 2), ("e4", "e3", "function_call", "start", 3),
        ("e5", None, "retrieve", "end", 4)], "event_id string, parent_id string, event_type string, "
                                             "phase string, ts int")
    got = rows(rl.assemble_spans(ev), "event_id", "parent_id", "start_ts", "end_ts")
    assert got == [("e1", None, 1, 5), ("e2", "e1", 2, 3), ("e4", None, 3, None)]


def test_sources_round_trips(spark, tmp_path):
    base = str(tmp_path)
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    sio.write_jsonl(lab, base + "/lab")
    schema = "doc_id long, quality int, toxic int"
    from pyspark.sql.types import _parse_datatype_string
    back = sio.read_jsonl(spark, base + "/lab", _parse_datatype_string(schema), first_n=1, order_by=["doc_id"])
    assert rows(back) == [(1, 1, 0)]
    sio.write_table(lab, base + "/t")
    assert rows(spark.read.parquet(base + "/t")) == rows(lab)
    sio.write_report(lab, base + "/csv", "csv")
    assert sio.read_report(spark, base + "/csv").count() == 2
    queries = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, text string")
    corpus = spark.createDataFrame([(10, "doc")], "doc_id long, text string")
    qrels = spark.createDataFrame([(1, 10)], "query_id long, doc_id long")
    sio.save_qa(sio.qa_rows(queries, corpus, qrels), base + "/qa")
    q2, c2, r2 = sio.load_qa(spark, base + "/qa")
    assert (q2.count(), c2.count(), rows(r2)) == (2, 1, [("1", "10")])
    ex = spark.createDataFrame([(1, "q", "a", [], "human")], sio.EXAMPLE_SCHEMA)
    sio.save_examples(ex, base + "/ex")
    assert sio.load_examples(spark, base + "/ex").first().query_by == "human"


def test_vector_table_dimension_check(spark, tmp_path):
    vt = sio.VectorTable(str(tmp_path / "v"), dim=2)
    ok = spark.createDataFrame([(1, [0.6, 0.8])], "id long, embedding array<float>")
    vt.write(ok)
    assert vt.exists(spark) and vt.count(spark) == 1
    bad = spark.createDataFrame([(2, [1.0, 0.0, 0.0])], "id long, embedding array<float>")
    try:
        vt.write(bad, recreate=False)
        raise AssertionError("expected a dimension error")
    except Exception as e:  # the write job fails on the raise_error
        assert "vector dimension" in str(e)
    st = sio.vector_stats(vt.read(spark)).first()
    assert (st.n, st.dim, st.min_norm) == (1, 2, 1.0)


def test_build_or_load_and_recreate_cascade(spark, tmp_path):
    p = str(tmp_path / "b")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    sio.build_or_load(spark, p, build)
    sio.build_or_load(spark, p, build)
    assert len(calls) == 1
    sio.build_or_load(spark, p, build, recreate=True)
    assert len(calls) == 2
    assert sio.recreate_flags(True, False, False) == {"recreate_index": True, "recreate_retrieval_eval": True,
                                                      "recreate_response_eval": True}


def test_node_store_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("1:0", 1, 0, "a b", {"biz_name": "X"}, [0.6, 0.8])], sio.NODE_SCHEMA)
    sio.save_nodes(nodes, str(tmp_path / "n"))
    back = sio.load_nodes(spark, str(tmp_path / "n"))
    assert back.schema == sio.NODE_SCHEMA and back.first().metadata == {"biz_name": "X"}


def test_depunct_and_to_number(spark):
    import string

    from revsift.functions.text import depunct, to_number
    df = spark.createDataFrame([(string.punctuation + "aZ9 é",)], "s string")
    assert df.select(depunct("s").alias("x")).first().x == "_" * 32 + "aZ9 é"
    nums = spark.createDataFrame([("12",), (" 3.5 ",), ("abc",), (None,)], "s string")
    assert [r.v for r in nums.select(to_number("s").alias("v")).collect()] == [12.0, 3.5, None, None]


def test_named_availability_functions(spark):
    hr.register_functions(spark)
    r = spark.sql("""SELECT check_availability('b1', 8, 22, TIMESTAMP_NTZ'2024-01-01 20:45:00', 0) AS a,
        check_availability('b1', 8, 20, TIMESTAMP_NTZ'2024-01-01 20:45:00', 0) AS shut,
        check_availability('b1', 8, 22, TIMESTAMP_NTZ'2024-01-01 20:45:00', 99) AS full,
        check_availability_range('b1', 8, 21, TIMESTAMP_NTZ'2024-01-01 20:00:00', TIMESTAMP_NTZ'2024-01-01 21:30:00', 0) AS r,
        check_availability_range('b1', 8, 21, TIMESTAMP_NTZ'2024-01-01 21:00:00', TIMESTAMP_NTZ'2024-01-01 20:00:00', 0) AS none,
        get_business_id(array('x', 'y', 'x'), array('1', '2', '3'), 'x') AS id,
        get_business_id(array('x'), array('1'), 'z') AS missing""").first()
    assert (r.a, r.shut, r.full, r.id, r.missing) == (True, False, False, "3", None)
    assert json.loads(r.r) == {"2024-01-01 20:00": True, "2024-01-01 21:00": False} and json.loads(r.none) == {}
