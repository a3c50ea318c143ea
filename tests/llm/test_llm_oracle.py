"""Every query of the subpackage that has SQL, against the second engine."""

import os

import pytest

from compare import connect, differences
from jobsift.llm.oracle import ORACLE
from jobsift.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) == ""


def test_entry_has_all_queries():
    import __spark_entry__ as entry_points

    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())


def test_references_of_odd_pages(spark, tmp_path):
    """Names with and without semicolon, numbers of any kind, spaces, pages that repeat or are null."""
    bodies = ["&copy; &middot;&eacute;", "&#8217;&#xE9;&#XE9;&#x1F600;", "&amp;copy; &amp;amp;lt;", "&copy2 &notit; &notin; &unknown; &", "a&nbsp;b&Tab;c&NewLine;d &#10;e",
              "&#0;&#55296;&#1114112;&#99999999;&#x110000;", "&#128;&#150;&#159;&#129;", "&ltx &LT &AMPamp; &CounterClockwiseContourIntegral;", "&NotEqualTilde;&fjlig;&lt;b&gt;",
              "<title>A&quot;&#39;&apos; &ccedil</title><p>x&thinsp;y</p>", "&#x;&#;&# 5; &;", "", None]
    rows = [(i, f"http://a.example/{i}", b if b is None else f"<html lang='fr'><body>{b}</body></html>") for i, b in enumerate(bodies)]
    rows += [(0, "http://a.example/0", "another page"), (0, "http://a.example/0", rows[0][2]), (None, None, "<p>&eacute;")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/out")
    os.rename(next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".parquet"), tmp_path / "pages.parquet")
    found = QUERIES["op8_warc_derivatives"](spark, str(tmp_path))
    assert differences(found, connect(str(tmp_path)), ORACLE["op8_warc_derivatives"]) == ""
    same = [r.record_id for r in found.where("page_id = 0 AND record_type = 'conversion'").collect()]
    assert len(same) == 3 and len(set(same)) == 2
