import csv
import glob
import io

import pytest

from tidemark.operators import overrides
from tidemark.sources import csv_sink, export
from tidemark.sources.shared import new_folder

ROWS = [(i * 3, f'name "{i}"' if i % 5 else f"=SUM({i})", None if i % 7 == 0 else "x\ny") for i in range(95)]
SCHEMA = "id long, name string, note string"


def text(df):
    return "".join(r.body for r in df.orderBy("chunk").collect())


def test_broken_off_export_goes_on_as_it_began(spark):
    rows = spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(4)
    whole = export.export(rows, new_folder(spark, "job"), "id", 10, 3)
    path = new_folder(spark, "job")
    first = export.export(rows, path, "id", 10, 3, most_parts=1)
    assert first.count() == 3 and not export.complete(path, spark)
    # rows that came and went since move nothing
    later = rows.unionByName(spark.createDataFrame([(-5, "new", None), (1, "new", None), (9999, "new", None)], SCHEMA))
    out = export.export(later.where("id <> -5 AND id <> 1"), path, "id", 10, 3)
    assert export.complete(path, spark) and text(out) == text(whole)
    parsed = list(csv.reader(io.StringIO(text(out).removeprefix("﻿"), newline="")))
    assert parsed[0] == ["id", "name", "note", "csv_fields_truncated"] and [int(r[0]) for r in parsed[1:]] == [r[0] for r in ROWS]
    assert [(r.chunk, r.row_count, r.object_key[-12:]) for r in out.orderBy("chunk").collect()] == [(i, 10 if i < 9 else 5, f"{i:08d}.csv") for i in range(10)]
    assert text(out).count("csv_fields_truncated") == 1 and text(export.export(rows.limit(0), path, "id", 10, 3)) == text(out)


def test_parts_are_written_in_few_jobs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = new_folder(spark, "job")
    first = export.export(rows, path, "id", 2, 1, most_parts=3)
    assert sorted(r.chunk for r in first.collect()) == [0, 1, 2]
    # what a job left that broke off is neither read nor taken for written; a row between two keys of a chunk is exported with it
    spark.createDataFrame([(7,)], "chunk long").coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/chunks/7-7")
    spark.sparkContext.setJobGroup("export", "export")
    out = export.export(rows.unionByName(spark.createDataFrame([(19, "new", None)], SCHEMA)), path, "id", 2, 1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("export")
    spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) < 48 * 2 and export.complete(path, spark)  # 48 parts
    assert sorted(r.chunk for r in out.collect()) == list(range(48))
    whole = export.export(rows, new_folder(spark, "job"), "id", 2, 1)
    assert text(out).replace('"19","new","",""\r\n', "") == text(whole) != text(out)
    assert export._jobs([0, 1, 2, 4, 5, 9], 1) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (9, 9)] and export._jobs([*range(20)], 64) == [(0, 2), (3, 5), (6, 8), (9, 11), (12, 14), (15, 17), (18, 19)]


def test_empty_export_has_its_header(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = new_folder(spark, "job")
    (one,) = export.export(none, path, "id").collect()
    assert one.body == csv_sink.header(none) + "\r\n" and (one.chunk, one.row_count) == (0, 0) and export.complete(path, spark)


@pytest.mark.parametrize("n", [0, 1, 95])
def test_written_csv_begins_with_its_header(spark, tmp_path, n):
    csv_sink.write(spark.createDataFrame(ROWS[:n], SCHEMA).repartition(3), str(tmp_path / "out"), ["id"])
    body = "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(str(tmp_path / "out/part-*"))))
    parsed = list(csv.reader(io.StringIO(body.removeprefix("﻿"), newline="")))
    assert body.startswith('﻿"id"') and [r[0] for r in parsed] == ["id", *(str(r[0]) for r in ROWS[:n])]


def test_corrections_outlive_folds(spark):
    listings = spark.createDataFrame([(1, "tad", "candidate", "none", 5), (2, "lux", "resolved", "alias", 6), (3, None, None, None, None)], "listing_id long, manufacturer_id string, manufacturer_status string, manufacturer_method string, price_yen long")
    o = spark.createDataFrame([(1, "manufacturer_id", "denon", 1), (1, "price_yen", "7", 1), (2, "manufacturer_id", "x", 1), (2, "manufacturer_id", None, 2), (3, "manufacturer_id", "y", 2), (3, "manufacturer_id", "z", 1), (9, "manufacturer_id", "gone", 1), (1, "no field of theirs", "q", 1)], "listing_id long, field string, value string, version long")
    fields = ["manufacturer_id", "price_yen"]
    shown = lambda l, o: {r.listing_id: tuple(r)[1:] for r in overrides.effective(l, o, fields).collect()}
    assert shown(listings, o) == {1: ("denon", "resolved", "admin_override", 7), 2: ("lux", "resolved", "alias", 6), 3: ("y", "resolved", "admin_override", None)}
    # what a crawl finds next stays below; when the correction is taken back it shows
    folded = listings.replace("tad", "teac")
    assert shown(folded, o)[1][0] == "denon"
    back = o.unionByName(spark.createDataFrame([(1, "manufacturer_id", None, 2)], o.schema))
    assert shown(folded, back)[1] == ("teac", "candidate", "none", 7)
    assert sorted((r.listing_id, r.field, r.found, r.corrected) for r in overrides.overridden(listings, o, fields).collect()) == [(1, "manufacturer_id", "tad", "denon"), (1, "price_yen", "5", "7"), (3, "manufacturer_id", None, "y")]
