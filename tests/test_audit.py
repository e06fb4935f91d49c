"""Schema-only audit operators: column list, field availability by alias list."""

from conftest import SF001


def test_column_list_and_availability(spark):
    from retrospark.operators import audit as AU
    from retrospark.sources.visits import fixture_visits

    raw = fixture_visits(spark, SF001)
    cl = AU.column_list(raw).collect()
    assert [r.column for r in cl] == raw.columns and cl[0].ordinal == 1
    av = {r.required_field: (r.status, r.matched_column) for r in AU.column_availability(raw).collect()}
    assert av["patient_identifier"] == ("available", "hn")
    assert av["body_weight"] == ("missing", "")
    assert sum(1 for s, _ in av.values() if s == "missing") == 3


def test_first_examples_sort_candidates_only(spark):
    from retrospark.config import RawSchema
    from retrospark.operators import audit as AU

    rows = [(i % 50 if i % 9 else None, f"v{i}" if i % 4 else None, float(i), "x" if i in (7, 400) else None, 1) for i in range(500)] * 2
    df = spark.createDataFrame(rows, "hn long, vstdate string, a double, b string, c int").repartition(5)
    schema = RawSchema(order_keys=("a",))
    found = {r["column"]: r for r in AU.schema_summary(df, schema, examples=3).collect()}
    key = lambda r: tuple((x is not None, x) for x in (r[0], r[1], r[2]))  # noqa: E731  (nulls first)
    for i, c in enumerate(df.columns):
        values = [r[i] for r in sorted(rows, key=key) if r[i] is not None]
        assert found[c].example_values == "; ".join(map(str, values[:3]))
        assert found[c].unique_count == len(set(values))
    kept = AU._first_candidates(df, df.columns, "hn", 3)
    assert kept.where("__k0").count() < 400  # of 888: those of the first entities
    assert kept.where("__k3").count() == 4  # fewer values than classes: all of them
