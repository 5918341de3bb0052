import uuid

from pyspark.sql import functions as F

from qualab.plans.fixtures import table
from qualab.session import ensure_checkpoint_dir
from qualab.sources import files as S
from qualab.sources.store import Store


def test_catalog_roundtrip(spark, sf):
    st = Store(spark, f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}")
    a = st.save_dataset(table(spark, sf, "region"), "regions", "r", "u1")
    b = st.save_dataset(table(spark, sf, "nation"), "nations", "n", "u2")
    assert st.datasets().count() == 2 and st.datasets("u2").first()["name"] == "nations"
    assert st.load_dataset(a).count() == table(spark, sf, "region").count()
    assert st.delete_dataset(a) and st.load_dataset(a) is None and st.datasets().count() == 1
    assert st.dataset(b).count() == 1
    assert st.audit("u1", "TEST", "store") is True
    assert st.audit_log().count() == 1


def test_report_store(spark):
    st = Store(spark, f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}")
    sec = spark.createDataFrame([("quality", "score", "90.1")], "section string, item string, value string")
    rid = st.save_report(sec, "rep")
    rows = st.report(rid).collect()
    assert {r["section"] for r in rows} == {"quality", "_content"}


def test_guard_empty(spark):
    df, err = S.guard_empty(spark.createDataFrame([], "a int"))
    assert df is None and err["error"] == "empty_input"


def test_entry_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() == 1 and "score" in out.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150


def test_config_latest_and_align(spark, sf):
    from qualab.operators.features import align_columns, candidate_targets
    from qualab.sources.store import latest
    st = Store(spark, f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}")
    st.save_config({"user_id": "u1", "problem_type": "regresion", "target": "o_totalprice", "predictors": ["a"]})
    st.save_config({"user_id": "u1", "problem_type": "clasificacion", "target": "o_orderstatus", "predictors": ["b"]})
    assert latest(st.configs(), user_id="u1").count() == 1
    o = table(spark, sf, "orders")
    out, missing, extra = align_columns(o, ["o_totalprice", "zz"])
    assert out.columns == ["o_totalprice", "zz"] and missing == ["zz"] and "o_orderkey" in extra
    assert "o_orderstatus" not in candidate_targets(o, "regresion")


def _store(spark):
    return Store(spark, f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}")


def test_writers_at_once_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    st, schema = _store(spark), "writer int, n int"
    one = lambda w: [st.append("log", spark.createDataFrame([(w, i)], schema)) for i in range(5)]
    with ThreadPoolExecutor(6) as pool:
        writers = [pool.submit(one, w) for w in range(4)]
        merging = [pool.submit(st.compact, "log", schema) for _ in range(2)]
        [f.result() for f in [*writers, *merging]]
    rows = sorted(tuple(r) for r in st.table("log", schema).collect())
    assert rows == [(w, i) for w in range(4) for i in range(5)]


def test_one_compaction_of_the_same_parts_wins(spark):
    import datetime as dt

    st, schema = _store(spark), "k int"
    for i in range(4):
        st.append("t", spark.createDataFrame([(i,)], schema))
    old = st.parts("t")
    assert st.compact("t", schema) and len(st.parts("t")) == 1
    late = "part=late"                                   # another process had read the same four parts
    spark.createDataFrame([(i,) for i in range(4)], schema).write.parquet(st.path(f"t/{late}"))
    st._publish("t", [late], old)
    assert late not in st.parts("t") and sorted(r["k"] for r in st.table("t", schema).collect()) == [0, 1, 2, 3]
    assert not st.compact("t", schema)
    assert st.sweep("t", schema) == 0 and st.sweep("t", schema, dt.timedelta(0)) == 5
    assert sorted(r["k"] for r in st.table("t", schema).collect()) == [0, 1, 2, 3]


def test_a_write_that_was_not_published_is_not_read(spark):
    st, schema = _store(spark), "k int"
    st.append("t", spark.createDataFrame([(1,)], schema))
    spark.createDataFrame([(2,)], schema).write.parquet(st.path("t/part=half"))
    assert [r["k"] for r in st.table("t", schema).collect()] == [1]


def test_partitioned_parts_are_read_together(spark):
    st = _store(spark)
    for i in range(3):
        assert st.audit("u", "A", "e", str(i))
    assert st.compact("audit", "user_id string, action string, entity string, entity_id string, details string, "
                      "created_at timestamp_ntz, session_id string, event_date date", ["event_date"])
    assert st.audit("u", "B", "e")
    log = st.audit_log()
    assert log.count() == 4 and log.where("event_date is null").count() == 0
