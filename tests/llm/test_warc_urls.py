"""Urls that end in the version text."""

import pytest

from marginalia.llm import warc
from marginalia.llm.common import Scratch

from .test_warc import SCHEMA


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_version_at_the_end_of_a_url(spark, compression):
    urls = ["http://e/0", "http://e/WARC/1.0", "WARC/1.0", "http://e/WARC/%1.0", "http://e/WARC/%%1.0", "http://e/WARC/1.0/x", "http://e/WARC/1.0\r", "http://e/9"]
    scratch = Scratch(spark, "warc-test")
    path = scratch.path("archive")
    warc.write_warc(spark.createDataFrame([(i, u, f"page {i}", None, None) for i, u in enumerate(urls)], SCHEMA).coalesce(1), path, scratch, compression=compression)
    got = {r["record_id"]: (r["url"], bytes(r["payload"])) for r in warc.read_warc(spark, path, scratch).collect()}
    assert got == {str(i): (u.replace("\r", "%0D"), b"page %d" % i) for i, u in enumerate(urls)}
