"""Readers, writers and the staged build."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from careerloom import schemas
from careerloom.plans import stages
from careerloom.plans.fixtures import GENERIC_SUFFIX, HOST, load
from careerloom.sources import readers, writers
from conftest import rows

CSV = '''company_name,label,confidence,reason
"Acme, ""the"" firm", visual,0.5,ok
Beta,visual,0.25,one,too,many
Gamma,visual,high,bad number
Delta,  non_visual,1,
'''


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text(CSV)
    return str(path)


def test_tolerant_csv(spark, csv):
    got = rows(readers.tolerant_csv(spark, csv, schemas.LABEL_LINE))
    assert [r[:3] for r in got] == [('Acme, "the" firm', "visual", 0.5), ("Delta", "non_visual", 1.0)]
    assert readers.malformed_csv_lines(spark, csv, schemas.LABEL_LINE).count() == 2


def test_csv_scan_parses_listed_columns_only(spark, csv):
    df = readers.csv_table(spark, csv, schemas.LABEL_LINE, ["company_name"])
    assert "ReadSchema: struct<company_name:string>" in df._jdf.queryExecution().executedPlan().toString()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.json"
    lines = [json.dumps({"company_name": "a", "label": "x"}), "", "{broken", json.dumps({"label": "y"})]
    path.write_text("\n".join(lines))
    assert rows(readers.label_lines(spark, str(path)).select("company_name", "label")) == [("a", "x")]


def test_optional_source(spark, tmp_path):
    assert readers.optional_snapshot(spark, None) is None
    assert readers.optional_snapshot(spark, str(tmp_path / "no")) is None
    spark.range(3).write.parquet(str(tmp_path / "yes"))
    assert readers.optional_snapshot(spark, str(tmp_path / "yes")).count() == 3


def test_snapshot_can_replace_its_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_snapshot(spark.range(5), path)
    writers.write_snapshot(readers.snapshot(spark, path).where("id > 2"), path)
    assert rows(readers.snapshot(spark, path)) == [(3,), (4,)]


@pytest.mark.parametrize("n", [0, 1, 20000])
def test_size_cap(spark, tmp_path, n):
    path, cap = str(tmp_path / "t"), 30_000
    df = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("x")).coalesce(1)
    writers.write_size_capped(df, path, max_bytes=cap)
    sizes = [r.length for r in writers.file_sizes(spark, path).collect()]
    assert sizes and max(sizes) <= cap
    assert rows(readers.snapshot(spark, path).select("id")) == rows(df.select("id"))


def test_size_cap_leaves_small_parts(spark, tmp_path):
    path, cap = str(tmp_path / "t"), 20_000
    text = F.concat_ws(" ", *[F.md5((F.col("id") + i).cast("string")) for i in range(4)])
    df = spark.range(1200).select("id", text.alias("x")).repartitionByRange(2, F.col("id") < 100)
    df.write.parquet(path + "-first")
    small = min(r.length for r in writers.file_sizes(spark, path + "-first").collect())
    writers.write_size_capped(df, path, max_bytes=cap)
    sizes = [r.length for r in writers.file_sizes(spark, path).collect()]
    assert small in sizes and max(sizes) <= cap and len(sizes) > 2
    assert rows(readers.snapshot(spark, path).select("id")) == rows(df.select("id"))


def test_labels_follow_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_labelled(spark.range(2).toDF("unitid"), path, {"unitid": "School id", "absent": "x"})
    assert readers.snapshot(spark, path).schema["unitid"].metadata["comment"] == "School id"
    assert rows(readers.snapshot(spark, path + "_dictionary")) == [("unitid", "bigint", "School id")]


def test_export_types(spark, tmp_path):
    df = spark.createDataFrame([(True, ["a"], 'q"x')], "f boolean, l array<string>, s string")
    writers.write_export(df, str(tmp_path / "t"))
    assert rows(readers.inferred_csv(spark, str(tmp_path / "t"))) == [(1, '["a"]', 'q"x')]


def test_dated_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(9).withColumn("snapshot_date", F.lit("20200101")).write.partitionBy("snapshot_date").parquet(path)
    writers.write_dated(spark.range(2), path)
    writers.write_dated(spark.range(3), path)
    assert readers.snapshot(spark, path).count() == 12 and writers.latest_dated(spark, path).count() == 3
    assert spark.range(1).select(writers.run_date()).first()[0] in {
        (datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(hours=h)).strftime("%Y%m%d") for h in (-1, 0)}


def test_appended_log(spark, tmp_path):
    for i in range(2):
        writers.append_log(spark.range(2).toDF("company_name"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_stages(spark, sf, tmp_path):
    root = str(tmp_path)
    sources = {n: load(spark, sf, n) for n in ("education", "experience", "companies")}
    names = [s.name for s in stages.STAGES]
    options = dict(host=HOST, generic_suffix=GENERIC_SUFFIX)
    assert stages.run(spark, sources, root, **options) == names
    assert stages.run(spark, sources, root, redo=False, **options) == []
    before = rows(readers.snapshot(spark, f"{root}/person"))
    assert stages.run(spark, {}, root, start=6, **options) == names[5:]
    assert rows(readers.snapshot(spark, f"{root}/person")) == before
    with pytest.raises(ValueError):
        stages.run(spark, sources, root, start=9)
