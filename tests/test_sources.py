"""Readers and writers on small files."""

import glob

from pyspark.sql import functions as F

from jobsift import schemas
from jobsift.operators import changes
from jobsift.sources import intake, sinks, tables


def results(spark, rows):
    return spark.createDataFrame(
        rows, "id string, batch_id string, seq int, job_title string, company string, job_url string, ats_score int,"
        " role_level_score int, composite_score int, verdict string, hard_reject_reasons array<string>, t string"
    ).withColumn("created_at", F.to_timestamp_ntz("t")).drop("t")


ROWS = [
    ("1", "b", 1, 'Say "hi", all', None, None, 44, 58, 52, "WEAK", [], "2024-01-02 03:04:05.5"),
    ("2", "b", 2, "Lead\r\nDev\n", "A, Inc", "http://x", 82, 88, 85, "STRONG", [], "2024-01-02"),
    ("3", "b", 3, None, "B", None, 0, 0, 0, "REJECT", ["one", "two; three"], "2024-01-02"),
    ("4", "c", 1, "t", "C", None, 82, 88, 85, "STRONG", [], "2024-01-02"),
]


def read_all(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*.csv"))).decode()


def test_batch_export_bytes(spark, tmp_path):
    only_b = spark.createDataFrame([("b",)], "batch_id string")
    sinks.export_batches_csv(results(spark, ROWS), str(tmp_path / "out"), only_b)
    assert [p.split("/")[-1] for p in glob.glob(str(tmp_path / "out" / "batch_id=*"))] == ["batch_id=b"]
    assert read_all(tmp_path / "out" / "batch_id=b") == (
        "Job Title,Company,URL,ATS Score,Role Level Score,Composite Score,Verdict,Hard Reject Reasons,Screened At\n"
        '"Lead\r\nDev\n","A, Inc",http://x,82,88,85,STRONG,,2024-01-02T00:00:00.000000\n'
        '"Say ""hi"", all",,,44,58,52,WEAK,,2024-01-02T03:04:05.500000\n'
        ",B,,0,0,0,REJECT,one; two; three,2024-01-02T00:00:00.000000\n")


def test_large_batch_keeps_its_order_over_files(spark, tmp_path):
    rows = spark.range(0, 20_000, numPartitions=4).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") >= 0, F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("b"), (F.col("id") % 50).cast("string")))).alias("batch_id"),
        F.col("id").alias("seq"), F.lit("t").alias("job_title"), F.lit("c").alias("company"), F.lit(None).cast("string").alias("job_url"),
        *[(F.col("id") * 37 % 101).cast("int").alias(c) for c in ("ats_score", "role_level_score", "composite_score")],
        F.lit("WEAK").alias("verdict"), F.array().cast("array<string>").alias("hard_reject_reasons"),
        F.timestamp_seconds("id").alias("created_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.export_batches_csv(rows, str(tmp_path / "out"), rows.where("batch_id IN ('hot', 'b7')"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(glob.glob(str(tmp_path / "out" / "batch_id=hot" / "part-*.csv")))
    lines = [line.split(",") for p in files for line in open(p).read().splitlines()[1:]]
    got = [(-int(x[5]), x[8]) for x in lines]
    assert len(files) > 1 and len(got) == 6667 and got == sorted(got)


def test_ranked_export_bytes(spark, tmp_path):
    sinks.export_ranked_csv(results(spark, ROWS).where("batch_id = 'b'").coalesce(1), str(tmp_path / "out"))
    assert read_all(tmp_path / "out" / "rows" / "batch_id=b").split("\n")[1] == ',"Say ""hi"", all",44,58,52,WEAK'
    assert read_all(tmp_path / "out" / "summary") == "batch_id,rejects,saved\nb,1,12 min\n"


def test_document_intake(spark, tmp_path):
    files = {
        "ok.pdf": b"%PDF-1.4\nbody", "ok.TXT": b"text", "bad.pdf": b"<html>", "js.pdf": b"%PDF-1.4 /JavaScript \n(x)",
        "aa.pdf": b"%PDF-1.4 \xff /AA<<", "js.txt": b"/JS (x)", "word.docx": b"PK", "big.txt": b"x" * (5 * 1024 * 1024 + 1),
        "edge.txt": b"x" * (5 * 1024 * 1024), "noext": b"x",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].split("/")[-1]: r["problem"] for r in intake.intake_documents(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    assert {n for n, p in got.items() if p is None} == {"ok.pdf", "ok.TXT", "js.txt", "edge.txt"}
    assert "valid PDF" in got["bad.pdf"] and "active content" in got["js.pdf"] and "active content" in got["aa.pdf"]
    assert "Only PDF" in got["word.docx"] and "Only PDF" in got["noext"] and "5.0 MB" in got["big.txt"]


def test_decode_analysis_defaults(spark):
    docs = [("{}",), (None,), ('{"headline":"h","extra":1,"fake_em_detection":{"is_fake_em":null}}',), ("nope",)]
    got = tables.decode_analysis(spark.createDataFrame(docs, "analysis_json string")).select(
        "analysis_ok", "analysis.headline", "analysis.matching_skills", "analysis.fake_em_detection.is_fake_em").collect()
    assert [tuple(r) for r in got] == [
        (True, None, None, None), (True, None, None, None), (True, "h", None, None), (False, None, None, None)]


def test_model_output(spark):
    docs = [(1, '```json\n{"title_floor":"Lead","geography_allowed":["x"]}\n```'), (2, "sorry"), (3, ""), (4, None), (5, "{}")]
    ok, bad = tables.parse_model_output(spark.createDataFrame(docs, "n int, raw string"), "raw")
    assert sorted((r["n"], r["parsed"]["title_floor"]) for r in ok.collect()) == [(1, "Lead"), (5, None)]
    assert sorted(r["n"] for r in bad.collect()) == [2, 3, 4]


def test_append_is_partitioned_and_refuses(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = results(spark, ROWS).withColumns(
        {"user_id": F.lit("u"), "jd_text": F.lit("x"), "analysis_json": F.lit("{}")})
    bad = rows.limit(1).withColumn("verdict", F.lit("GREAT"))
    assert sinks.append_screenings(rows, path).count() == 0
    assert [r["problems"] for r in sinks.append_screenings(bad, path).collect()] == [["verdict is not allowed: GREAT"]]
    again = tables.scan_screenings(spark, path)
    assert again.count() == 4
    assert glob.glob(path + "/created_date=2024-01-02/*.parquet")
    plan = again.where("created_date = date'2024-01-02' and user_id = 'u'").select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan and "EqualTo(user_id,u)" in plan


def test_large_snapshot_is_split_and_whole(spark, tmp_path):
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.lit("b").alias("batch_id"),
        *[F.lit("x").alias(f.name) if f.dataType == schemas.S else F.lit(None).cast(f.dataType).alias(f.name)
          for f in schemas.SCREENING if f.name not in ("id", "user_id", "batch_id")])
    asked = spark.createDataFrame([("q", "u", "b")], "request_id string, user_id string, batch_id string")
    headers, frozen, _ = changes.publish_reports(rows, asked, F.to_timestamp(F.lit("2024-01-01")), "secret")
    nested = changes.nest_snapshots(headers, frozen)
    sizes = [r["n"] for r in nested.select(F.size("results_snapshot").alias("n")).collect()]
    assert len(sizes) == 5 and sum(sizes) == 1000 and max(sizes) < 300
    nested.select(*[f.name for f in schemas.REPORT]).write.parquet(str(tmp_path / "r"))
    back = changes.flatten_snapshots(tables.scan_reports(spark, str(tmp_path / "r")))
    assert back.select("id").distinct().count() == 1000
    slug = headers.first()["slug"]
    assert len(slug) == 16 and not set(slug) & set("+/=")
