"""Work for each row is done once and by all tasks: long lines, texts without numbers, plans that repeat no pattern."""

import time

import pytest
from pyspark.sql import functions as F

from tidewright.functions import documents, extract, text
from tidewright.functions.dates import parse_numeric_date
from tidewright.operators import ingest
from tidewright.plans import intake, records

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_lines_take_linear_time():
    line = "Name: A  FIR No.: 7/2023   " + "a word  " * 60_000
    began = time.process_time()
    found = extract._segments(line + "\n" + line.replace(":", " "))
    assert time.process_time() - began < 2
    assert [(s[0], s[1].split(" ")[0]) for s in found] == [("Name", "A"), ("FIR No.", "7/2023")]


def test_texts_without_numbers_are_not_read_token_by_token(monkeypatch):
    read = []
    tokens = extract._tokenised
    monkeypatch.setattr(extract, "_tokenised", lambda t: (read.append(x) or x for x in tokens(t)))
    assert extract._section_runs("words of IPC and sections " * 1_000) == [] and not read
    assert [r["sections"] for r in extract._section_runs("u/s 379 r/w 34 IPC; " + "words " * 1_000)] == [["379", "34"]]
    assert len(read) < 20


def test_labels_names_and_classes_are_matched_once(spark):
    df = spark.createDataFrame([(1, "Accused: Sri Ravi @ Raju s/o Late Md. Khan\nDate of release: 31/12/2023  Brief facts: none")], "id long, t string")
    f = extract.labelled_fields(df, "id", "t", F.lit("2024-06-01").cast("date"))
    assert plan(f).count("brief facts") == 1
    assert sorted((r.field, str(r.date_value)) for r in f.collect()) == [("accused", "None"), ("brief_facts", "None"), ("release_date", "2023-12-31")]
    assert plan(df.select(text.name_tokens(F.col("t")).alias("n"))).count("[^a-z]+") == 1
    assert plan(df.select(documents.document_class(F.col("t")).alias("c"))).count("arrest memo") == 1


def test_days_that_do_not_exist(spark):
    rows = [("31/02/2024", None), ("29/02/2023", None), ("29/02/2024", "2024-02-29"), ("02/29/2024", "2024-02-29"), ("00/01/2023", None), ("13/13/2023", None), ("31.12.9999", "9999-12-31"), ("1-1-00", "2000-01-01"), (None, None)]
    df = spark.createDataFrame(rows, "t string, d string")
    got = df.select("d", parse_numeric_date(F.col("t"), F.lit("2024-06-01").cast("date"))["value"].cast("string").alias("v"))
    assert all(r.v == r.d for r in got.collect())
    assert "gettimestamp" not in plan(got)


@pytest.mark.parametrize("name", ["date_parse", "section_parse", "label_fields", "name_parts", "quoted_evidence"])
def test_one_file_is_work_of_all_tasks(spark, name):
    assert getattr(intake if name == "quoted_evidence" else records, name)(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_shared_steps_are_computed_once(spark):
    assert plan(intake.quoted_evidence(spark, SF)).count("split(") == 1
    assert "dates_in" not in plan(intake.dates_in_context(spark, SF))
    assert "lineitem" not in plan(intake.field_conflicts(spark, SF)) and "parquet" not in plan(intake.field_conflicts(spark, SF))
    assert "(?iu)" not in plan(intake.delay_attribution(spark, SF))


def test_pages_are_counted_without_the_text(spark):
    rows = [(1, 1, None, "a.txt", b"one\n\fRelease order\nset at liberty\n\f\fDate of release: 20/01/2024\nName: Ravi", None)]
    up = spark.createDataFrame(rows, "upload_id long, person_id long, case_id long, filename string, content binary, confidences array<double>")
    names, cases = spark.createDataFrame([(1, "Ravi")], "person_id long, name string"), spark.createDataFrame([], "case_id long, person_id long, fir_number string, cnr string")
    facts = ingest.ingest(up, names, cases, F.lit("2024-06-01").cast("date")).facts
    assert {(r.field, r.page) for r in facts.collect()} == {("release_date", 4), ("accused", 4)}
    assert "[^\f]" not in plan(facts)
