from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paroxys.catalog import QUERIES
from paroxys.operators import annotations, matching
from paroxys.sources import records

SIENA = """
Data for patient
File name: PNO0-1.edf
Registration start time: 19.39.33
Registration end time: 20.22.58
Seizure start time: 19.58.36
Seizure end time: 19.59.46

file name:  PN00-2.edf
Registration start time: 23:50:00
Start time: 00.10.00
End time: 00.11.30
Seizure start time: 23.55.00
Seizure end time: 23.56.00
Seizure end time: 23.57.00
File name: PN00-3.edf
Seizure start time: 100
Seizure end time: 160.5
File name: PN00-4.edf
Registration start time: bad
Seizure start time: 10.00.xx
Seizure end time: 10.01.00
Seizure start time: 00.00.10
Seizure end time: nonsense
Seizure start time: 00.00.20
Registration start time: 00.00.05
Seizure end time: 00.00.40
"""

CHB = """
File Name: chb01_03.edf
File Start Time: 13:43:04
File End Time: 14:43:04
Number of Seizures in File: 1
Seizure Start Time: 2996 seconds
Seizure End Time: 3036 seconds

File Name: chb01_02.edf
File Start Time: broken
Number of Seizures in File: 0
Seizure Start Time: 5 seconds
Seizure End Time: 9 seconds

File Name: sub/chb01_04.EDF
File Start Time: 24:01:02
Number of Seizures in File: 3
Seizure 2 Start Time: 500 seconds
Seizure 2 End Time: 520 seconds
Seizure 1 Start Time: 100 seconds
Seizure 1 Start Time: 110 seconds
Seizure 1 End Time: 120 seconds
Seizure 1 End Time: 130 seconds
Seizure 3 End Time: 600 seconds
"""


def texts(spark, txt, path="root/PN00/Seizures-list-PN00.txt"):
    return spark.createDataFrame([(path, path.split("/")[-2], txt)], "path string, subject string, txt string")


def spans(df):
    rows = [(r["recording"], r["onset_sec"], r["offset_sec"]) for r in df.collect()]
    return sorted(rows)


def test_siena(spark):
    assert spans(annotations.siena_intervals(texts(spark, SIENA))) == [
        ("PN00-1.edf", 1143.0, 1213.0),
        ("PN00-2.edf", 300.0, 360.0),
        ("PN00-2.edf", 1200.0, 1290.0),
        ("PN00-3.edf", 100.0, 160.5),
        ("PN00-4.edf", 15.0, 35.0),
    ]


def test_siena_without_file_line_uses_the_file_stem(spark):
    got = annotations.siena_intervals(texts(spark, "Start time: 1\nEnd time: 2"))
    assert spans(got) == [("Seizures-list-PN00", 1.0, 2.0)]


def test_chbmit(spark):
    got = annotations.chbmit_intervals(texts(spark, CHB))
    assert spans(got) == [
        ("chb01_03", 2996.0, 3036.0),
        ("chb01_04", 110.0, 120.0),
        ("chb01_04", 500.0, 520.0),
    ]
    row = got.where("recording = 'chb01_03'").first()
    assert row["duration_sec"] == 40.0
    assert tuple(row["file_start"]) == (13, 43, 4) and tuple(row["file_end"]) == (14, 43, 4)
    late = got.where("onset_sec = 500").first()
    assert tuple(late["file_start"]) == (24, 1, 2) and late["file_end"] is None


def test_counts_include_subjects_without_seizures(spark):
    both = texts(spark, CHB, "r/chb01/a.txt").unionByName(texts(spark, "nothing", "r/chb02/b.txt"))
    rows = annotations.seizure_counts(both, annotations.chbmit_intervals(both)).collect()
    assert {r["subject"]: r["n_seizures"] for r in rows} == {"chb01": 3, "chb02": 0}


def test_corpus_on_disk(spark, tmp_path):
    folder = tmp_path / "PN00"
    folder.mkdir()
    (folder / "Seizures-list-PN00.txt").write_text(SIENA)
    (folder / "PN00-1.edf").write_bytes(b"x" * 10)
    (folder / "PN00-2.edf").write_bytes(b"y" * 3)
    found = annotations.siena_intervals(records.siena_texts(spark, str(tmp_path)))
    assert found.count() == 5 and found.first()["subject"] == "PN00"
    paths = records.discover_records(spark, str(tmp_path))
    assert sorted(r["length"] for r in paths.collect()) == [3, 10]
    index = records.record_index(paths, "siena").orderBy("record_id").collect()
    assert [r["record_id"] for r in index] == ["siena_000000", "siena_000001"]
    assert index[0]["path"].endswith("PN00-1.edf")
    with pytest.raises(FileNotFoundError):
        records.chbmit_texts(spark, str(tmp_path))


def test_missing_root_is_empty(spark, tmp_path):
    assert records.discover_records(spark, str(tmp_path / "none")).count() == 0


def test_fuzzy_match_pairs(spark):
    """Names that are part of each other, with the file ending or trailing dashes aside."""
    stems = ["PN00-1", "PN00-10", "PN01-1", "x", "chb01_03"]
    names = ["PN00-1.edf", "PN00-", "PN00--.edf", "", "chb01_03.EDF", "01", "zz", "---", "axb"]
    left = spark.createDataFrame([("s", v) for v in stems], "subject string, stem string")
    right = spark.createDataFrame([("s", v) for v in names] + [("t", "PN00-1")], "subject string, recording string")
    got = {(r["stem"], r["recording"]) for r in matching.match_recordings(left, right).collect()}
    expected = {
        "PN00-1": ["PN00-1.edf", "PN00-", "PN00--.edf", "", "---"],
        "PN00-10": ["PN00-1.edf", "PN00-", "PN00--.edf", "", "---"],
        "PN01-1": ["", "01", "---"],
        "x": ["", "---", "axb"],
        "chb01_03": ["", "chb01_03.EDF", "01", "---"],
    }
    assert got == {(stem, name) for stem, found in expected.items() for name in found}


def test_names_are_cut_into_pieces_that_can_match_and_merged(spark):
    """Not into all substrings, and their table is never broadcast."""
    names = spark.createDataFrame([("s", "x" * 20 + "abc" * 7)], "subject string, stem string")
    sought = spark.createDataFrame([("s", "abc"), ("s", ""), ("t", "a")], "subject string, piece string")
    assert {len(r["piece"]) for r in matching._with_pieces(names, "stem", sought, "subject", "piece").collect()} == {3}
    pairs = matching.match_recordings(names, sought.withColumnRenamed("piece", "recording"))
    assert {r["recording"] for r in pairs.collect()} == {"abc", ""}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [subject") >= 2


def test_exact_match_is_default(spark):
    left = spark.createDataFrame([("s", "PN00-1"), ("s", "PN00-10")], "subject string, stem string")
    right = spark.createDataFrame([("s", "PN00-1.edf", 1.0)], "subject string, recording string, onset_sec double")
    assert [r["stem"] for r in matching.seizures_of_recordings(left, right).collect()] == ["PN00-1"]
    fuzzy = matching.seizures_of_recordings(left, right, "fuzzy")
    assert {r["stem"] for r in fuzzy.collect()} == {"PN00-1", "PN00-10"}
    with pytest.raises(ValueError):
        matching.seizures_of_recordings(left, right, "other")


def test_stored_annotations_are_written_by_many_tasks(spark, tmp_path):
    """the file of each subject is what costs, so small files are not merged into one task."""
    rows = [(i, f"2024-01-01 10:{i % 60:02d}:00", i, "purchase", 160.0 + i) for i in range(40)]
    table = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
    table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(shared.glob("annotations-*"))
    assert QUERIES["stored_annotations"](spark, str(tmp_path)).count() == 40
    folder, = set(shared.glob("annotations-*")) - known
    files = sorted(folder.glob("subject=*/part-*.txt"))
    assert len(files) == len({f.parent for f in files}) == 40
    assert len({f.name.split("-")[1] for f in files}) > 8
