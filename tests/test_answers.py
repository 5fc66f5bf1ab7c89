"""JSON in answers, and the round trip of a CSV export."""

from pyspark.sql import functions as F

from vellum.functions import answers
from vellum.sources import reports


def test_answers(spark):
    rows = [
        ('{"a": 1}', '{"a":1}'), ("```json\n[1, 2]\n```", "[1,2]"), ("<think>{x}</think> {\"b\": 2, \"a\": {\"d\": 1, \"c\": null}}", '{"a":{"c":null,"d":1},"b":2}'), ('So: {"a": "}"} .', '{"a":"}"}'),
        ('{"a": 1} or {"a": 2}', None), ("none", None), ("", None), (None, None), ("{broken", None), ("3", "3"), ('3 of {"a": 1}', '{"a":1}'), ('1] {"a": 2}', '{"a":2}'), ("1, 2", None), ('{"a": 1}, "w": {"b": 2}', None), ("1} x", None), ("null", "null"), ("```\n{\"a\": \"é\"}```", '{"a":"é"}'),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").withColumn("v", answers.parsed(F.col("t"))).orderBy("i").select(answers.canonical(F.col("v")), answers.answer_key(F.col("v"))).collect()
    assert [r[0] for r in got] == [e for _, e in rows]
    assert (got[1][1] is None, got[5][1]) == (False, None)


def test_keys_of_equal_values_are_equal(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1,2]}',), ('{ "a":[1, 2],"b":1 }',), ('{"a":[2,1],"b":1}',)], "t string").select(answers.answer_key(answers.parsed(F.col("t"))))
    one, two, three = (r[0] for r in df.collect())
    assert one == two != three


def test_csv_keeps_empty_strings_and_nulls_apart(spark, tmp_path):
    rows = [("a", "", 'q "x", y', ""), ("", "b", None, "c"), (None, "", '"', None), (" a ", "\\N", "null", "é")]
    kinds = "a string, b string, c string, d string"
    reports.write_csv(spark.createDataFrame(rows, kinds), str(tmp_path / "x"))
    assert {tuple(r) for r in reports.read_csv(spark, str(tmp_path / "x"), kinds).collect()} == set(rows)


def test_reports_by_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"key": "k1", "status": "done", "result": {"measures": []}}\n{"key": "k2", "status": "done", "result": {\n\n{"key": "k3", "status": "running"}\n{"key": "k4", "status": "done"}\n')
    assert [r["key"] for r in reports.read_reports(spark, str(tmp_path), lines=True).collect()] == ["k1"]
