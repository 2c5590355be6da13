import gzip
import re
from pathlib import Path

from quillmark.llm import queries, warc

SF = "/root/testdata/sf0.001"


def test_records_carry_source_and_own_headers(spark):
    got = queries.QUERIES["op1_warc_records"](spark, SF).collect()
    assert len(got) == 2 * spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.source_headers.startswith("HTTP/1.1 200 OK\r\n") for r in got)
    assert all(f"WARC-Record-ID: {r.record_id}\r\n" in r.warc_headers and f"Content-Length: {r.content_length}\r\n" in r.warc_headers for r in got)


def test_written_records_are_read_again(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>one</p><p>tw\u00f6</p>"), (2, None, None)], "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages))
    warc.write_warc(derived, str(tmp_path / "out"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "out").glob("*.gz"))
    found = []
    while data:
        header, rest = data.split(b"\r\n\r\n", 1)
        n = int(re.search(rb"Content-Length: (\d+)", header)[1])
        found.append((header.decode() + "\r\n", rest[:n].decode()))
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    assert sorted(found) == sorted((r.warc_headers, r.block) for r in derived.collect())
