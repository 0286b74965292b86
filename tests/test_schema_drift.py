from datetime import datetime

from conftest import rows_of

from helixframe.operators.schema_drift import INTEGER, LIST, REAL, cast_value, conform, field_types, migration_rules, parse_record, schema_changes, schema_versions, type_rank

T = [datetime(2020, 1, d) for d in range(1, 10)]
RECORDS = "record_id long, file_id long, instrument string, record_no int, written_at timestamp, payload string, field_name string"
WORDS = [("Hole", "H"), ("zmw", "H"), ("IPD", "I"), ("S", "S")]


def make(spark, rows):
    return spark.createDataFrame([(i, f, inst, i, T[f], p, "clash") for i, (f, inst, p) in enumerate(rows)], RECORDS), spark.createDataFrame(WORDS, "col_name string, field_name string")


def test_changes(spark):
    rows = [
        (0, "a", '{"Hole": 1, "IPD": 2}'), (1, "a", '{" zMW ": 1, "IPD": null, "other": 3}'), (2, "a", '{"zmw": 1, "IPD": 2.5}'), (2, "a", '{"S": [1'), (3, "a", None),
        (4, "a", '{"S": [1], "zmw": "7"}'), (5, "b", '{"S": 1}'), (1, "a", '{" zMW ": 1, "IPD": null, "other": 3}'),
    ]
    got = rows_of(schema_changes(*make(spark, rows)).select("file_id", "field_name", "change"))
    assert got == sorted([(1, "H", "renamed"), (2, "I", "retyped"), (3, "H", "removed"), (3, "I", "removed"), (4, "H", "added"), (4, "S", "added")])
    versions = schema_versions(*make(spark, rows))
    assert versions.where("instrument = 'a'").count() == 5 and versions.agg({"n_files": "sum"}).first()[0] == 6


def test_widest_type_last_known(spark):
    rows = [(0, "a", '{"IPD": 1}'), (0, "a", '{"IPD": "x"}'), (1, "a", '{"IPD": null}'), (2, "a", '{"IPD": 3}')]
    assert rows_of(schema_changes(*make(spark, rows)).select("file_id", "change")) == [(2, "retyped")]


def test_empty(spark):
    records, words = make(spark, [])
    assert schema_changes(records, words).count() == 0 and conform(records, words, {}).count() == 0


def test_conform(spark):
    rows = [(0, "a", '{"Hole": " 0042", "S": 5, "IPD": "3.0"}'), (0, "a", '{"zmw": 2.5, "S": [1, 2.5]}'), (0, "a", "[]"), (0, "a", "x" * 100_000)]
    records, words = make(spark, rows)
    df = conform(records.unionByName(records), words, {"H": INTEGER, "S": LIST, "I": REAL}, {"I": 9})
    got = [(r.record_id, r.H, r.I, r.S, r.n_uncast) for r in df.orderBy("record_id").collect()]
    assert got == [(0, 42, 3.0, [5.0], 0), (1, None, 9.0, [1.0, 2.5], 1), (2, None, 9.0, None, 0), (3, None, 9.0, None, 0)]


def test_values():
    assert parse_record('{"a": NaN}') == [] and parse_record("") == [] and parse_record("[" * 100_000) == []
    assert [type_rank(x) for x in (None, 1, 1.5, "a", [1], True)] == [None, 1, 2, 3, 4, 3]
    assert cast_value("1e400", INTEGER) == (None, False) and cast_value([7], INTEGER) == (7, True) and cast_value("", REAL) == (None, True)


def test_rules_route_each_file(spark):
    rows = [(0, "a", '{"Hole": 1, "IPD": 2}'), (1, "a", '{"zmw": 2, "IPD": 2.5}'), (2, "a", '{"zmw": 3}'), (3, "b", '{"S": "x", "Hole": 4}')]
    records, words = make(spark, rows)
    assert field_types(records, words) == {"H": INTEGER, "I": REAL, "S": 3}
    rules = {(r.instrument, r.version, r.field_name): (r.steps, r.names) for r in migration_rules(records, words).collect()}
    assert rules["a", 1, "H"] == ("rename", ["Hole"]) and rules["a", 2, "H"] == ("rename", ["zmw"]) and rules["a", 1, "I"] == ("rename,cast", ["IPD"])
    assert rules["a", 3, "I"] == ("default", None) and rules["b", 1, "S"] == ("", ["S"]) and len(rules) == 12
    got = {r.record_id: (r.schema_version, r.H, r.I, r.S) for r in conform(records, words).collect()}
    assert got == {0: (1, 1, 2.0, None), 1: (2, 2, 2.5, None), 2: (3, 3, None, None), 3: (1, 4, None, "x")}


def test_records_without_id_stay(spark):
    records, words = make(spark, [(0, "a", '{"Hole": 1}'), (0, "a", '{"Hole": 2}')])
    records = records.withColumn("record_id", records.record_id * None)
    assert sorted(r.H for r in conform(records.unionByName(records), words).collect()) == [1, 2]
    assert conform(records.withColumn("file_id", records.file_id * None), words).where("schema_version is null").count() == 2


def test_field_types(spark):
    rows = [(0, "a", p) for p in ('{"S": "12"}', '{"S": " 7.5 "}', '{"S": "n/a"}', '{"IPD": [1, 2]}', '{"IPD": 3}', '{"Hole": "x"}', '{"Hole": null}')]
    assert field_types(*make(spark, rows)) == {"S": REAL, "I": LIST, "H": 3}
