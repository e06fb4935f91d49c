"""Records dealt by (entity, salt) once: the dedupes and the join add no exchange of records; results unchanged."""

import datetime as dt

from retrospark.config import CleanSchema, CohortConfig, RawSchema
from retrospark.operators import cleaning as CL
from retrospark.operators import cohort as C

KEYS = ("k",)


def _visits(spark):
    base = dt.datetime(2015, 1, 1)
    rows = []
    for e in range(1, 41):
        for i in range(400 if e == 1 else 12):
            code = "I63.9" if (e % 3 == 0 and i == 7) else "A00"
            rows.append((e, base + dt.timedelta(days=37 * i % 900), code, None if i % 4 else "B10", float(90 + i % 50), i))
    rows += rows[::5]  # copies
    rows += [(None, base, "A00", None, 1.0, 0), (50, None, "A00", None, 1.0, 0)]
    return spark.createDataFrame(rows, "hn long, vstdate timestamp, PrincipleDiagnosis string, ComorbidityDiagnosis string, bps double, k long")


def _cleaned(spark, placed):
    cfg = CohortConfig(schema=RawSchema(order_keys=KEYS), core_numeric=("bps",), hot_entity_rows=100, salts=8)
    prepared = C.prepare_records(_visits(spark), cfg, placed=placed)
    cohort, _, long = C.build_windowed_records(prepared, cfg)
    return cohort, long, CL.clean_records(long, CleanSchema(order_keys=KEYS))


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_placed_records_give_the_same_rows(spark):
    plain, placed = _cleaned(spark, False), _cleaned(spark, True)
    assert _rows(plain[0]) == _rows(placed[0])
    assert sorted(plain[2].columns) == sorted(placed[2].columns)
    assert _rows(plain[2]) == _rows(placed[2])
    assert placed[1].where("hn = 1").select(C.PLACE).distinct().count() > 1  # the hot entity is spread
    assert placed[1].where("hn <> 1").select(C.PLACE).distinct().count() == 1


def test_records_cross_the_network_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = spark.createDataFrame(_visits(spark).collect(), _visits(spark).schema)
        cfg = CohortConfig(schema=RawSchema(order_keys=KEYS), core_numeric=("bps",), hot_entity_rows=100, salts=8)
        _, _, long = C.build_windowed_records(C.prepare_records(records, cfg, placed=True), cfg)
        plan = CL.clean_records(long, CleanSchema(order_keys=KEYS))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by_place = [line for line in exchanges if "__salt" in line and "REPARTITION" in line]
    rest = [line for line in exchanges if line not in by_place]
    assert len(by_place) == 2  # one plan read twice: the cohort and the records (reused when it runs)
    # partial counts and cohort rows by entity, copies of the cohort rows by (entity, salt)
    assert all("hashpartitioning(hn" in line for line in rest) and sum("__salt" in line for line in rest) == 1


def test_repeated_rows_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    out, report = CL.drop_exact_duplicates(df)
    assert out.count() == 2
    assert [tuple(r) for r in report.collect()] == [("drop_exact_duplicates", 3, 2, 1)]
    empty = CL.drop_exact_duplicates(df.where("a > 5"))[1]
    assert [tuple(r) for r in empty.collect()] == [("drop_exact_duplicates", 0, 0, 0)]


def test_several_tables_read_one_stored_aggregate(spark):
    from retrospark.plans import catalog as K

    from conftest import SF001

    tables = K._policy_tables(spark, SF001)
    for t in tables.values():  # nothing of the visits is computed again
        assert "lineitem" not in t._jdf.queryExecution().executedPlan().toString()
