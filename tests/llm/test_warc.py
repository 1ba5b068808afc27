import hashlib
import re

from fiberloom.llm import warc
from tests.llm.fixtures import PAGES

HTML = '<!DOCTYPE html><html><head><title>A &amp;\n b</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One<br>two <b>bold</b>&lt;3</p><ul><li><a href="/u">L</a></li></ul></body></html>'
ROWS = [(1, "http://x.org/a", HTML, "h", "v", "t"), (2, None, None, "h", "v", "t"), (3, "http://y.org", "", "h", "v", "t"), (3, "http://y.org", "", "h", "v", "t"), (4, "http://z.org", "plain é \r\n\r\n text" + "x" * 9000, "h", "v", "t")]


def test_records(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    got = warc.derive(warc.responses_from_pages(pages), keep=("page_id",)).collect()
    assert len(got) == 10
    text = {r.page_id: r.block for r in got if r.record_type == "conversion"}
    assert text[1] == "A & b\nOne\ntwo bold<3\nL" and text[2] == "" and text[4].startswith("plain é text")
    meta = next(r for r in got if r.page_id == 1 and r.record_type == "metadata")
    assert "outlink: /u\r\n" in meta.block and "title: A &amp; b\r\n" in meta.block
    for r in got:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.block_bytes == len(r.block.encode())
        source = next(x[2] or "" for x in ROWS if x[0] == r.page_id)
        assert r.source_digest == "sha256:" + hashlib.sha256(source.encode()).hexdigest()
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id) and r.refers_to != r.record_id
    assert len({r.refers_to for r in got}) == 4 and len({r.record_id for r in got}) == 8


def test_round_trip(spark, tmp_path):
    records = warc.derive(warc.responses_from_pages(spark.createDataFrame(ROWS, PAGES)))
    warc.write_records(records, str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert all(r.complete for r in back)
    assert sorted((r.headers["WARC-Record-ID"], r.headers["WARC-Refers-To"], r.headers["WARC-Type"], r.block) for r in back) == sorted((r.record_id, r.refers_to, r.record_type, r.block) for r in records.collect())


def test_empty(spark):
    assert warc.derive(warc.responses_from_pages(spark.createDataFrame([], PAGES))).count() == 0
