"""Links and posting ids from hand-written pages."""

import pytest
from pyspark.sql import functions as F

from jobsift.operators import ingest

PAGE = "https://Jobs.example.com/careers-list/page.html?p=1#top"


def links(spark, html, url=PAGE):
    df = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    return [r["job_url"] for r in ingest.extract_job_links(df).orderBy("seq").collect()]


@pytest.mark.parametrize("href, want", [
    ("/jobs/1", "https://Jobs.example.com/jobs/1"),
    ("//x.org/job/2", "https://x.org/job/2"),
    ("http://x.org/role/3?a=1", "http://x.org/role/3?a=1"),
    ("jobs/4", "https://Jobs.example.com/careers-list/jobs/4"),
    ("../openings/./5/../6", "https://Jobs.example.com/openings/6"),
    ("/a/b/../../../apply/7?x=../y", "https://Jobs.example.com/apply/7?x=../y"),
    ("?q=/jobs/8", "https://Jobs.example.com/careers-list/page.html?q=/jobs/8"),
])
def test_resolution(spark, href, want):
    assert links(spark, f"<a class='c' href='{href}'>x</a>") == [want]


def test_only_postings_first_seen_once(spark):
    html = """
      <a href="/about">no</a> <A HREF = "/JOBS/b">b</A> <a href=/jobs/a>a</a> <a href="/JOBS/b">again</a>
      <a href="mailto:jobs@x.org?/jobs/1">m</a> <a data-href="/jobs/no">n</a> <abbr href="/jobs/no">n</abbr>
      <!-- <a href="/jobs/hidden">h</a> --> <script>var x = '<a href="/jobs/script">';</script>
      <a href="/jobs/c?x=1&amp;y=2">c</a> <a href="#top">t</a> <a href="">e</a> <a>none</a>
      <a href="https://boards.greenhouse.io/acme/jobs/12">g</a> <a href="https://acme.icims.com/jobs/">i</a>"""
    assert links(spark, html) == [
        "https://Jobs.example.com/JOBS/b", "https://Jobs.example.com/jobs/a",
        "https://Jobs.example.com/jobs/c?x=1&y=2", "https://boards.greenhouse.io/acme/jobs/12"]


def test_page_that_is_a_posting_keeps_its_fragments(spark):
    assert links(spark, '<a href="#apply">x</a>', "https://x.org/jobs/1?a=2#top") == ["https://x.org/jobs/1?a=2#apply"]


def ids(spark, html, url="https://www.linkedin.com/jobs/"):
    df = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    return [r["posting_id"] for r in ingest.extract_posting_ids(df).orderBy("seq").collect()]


def test_posting_ids_in_order_of_kind(spark):
    html = """<a href="/jobs/view/30001/?x">l</a><a href="/x?currentJobId=40001">l</a>
      <div data-entity-urn="urn:li:fsd_jobPosting:20001"></div><div data-entity-urn="urn:li:person:9"></div>
      <li data-occludable-job-id="10002" data-job-id=""></li><li data-job-id="10001" data-occludable-job-id="7777777"></li>
      <li data-job-id="1234"></li><li data-job-id='search'></li><a href="/jobs/view/10001/">again</a>"""
    url = "https://www.linkedin.com/jobs/?a=1&currentJobId=50001"
    assert ids(spark, html, url) == ["10002", "10001", "20001", "30001", "40001", "50001"]


def test_posting_ids_cap(spark):
    html = "".join(f'<li data-job-id="{10000 + i}"></li>' for i in range(30))
    assert ids(spark, html) == [str(10000 + i) for i in range(20)]
    assert ids(spark, "<p>none</p>", "https://x.org/?currentJobId=abc") == []


def test_cap_batch_counts_per_batch(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("batch_id"), F.col("id").alias("seq"))
    kept = ingest.cap_batch(df, 10).groupBy("batch_id").agg(F.count("*").alias("n"), F.max("seq").alias("m")).collect()
    assert {(r["batch_id"], r["n"], r["m"]) for r in kept} == {(0, 10, 27), (1, 10, 28), (2, 10, 29)}
