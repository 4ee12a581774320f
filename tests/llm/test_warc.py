import hashlib

from chronofold.llm import warc
from chronofold.llm._common import shared_dir

from tests.conftest import SF_TINY
from tests.oracle import connect, rows_of, rows_of_sql

SCHEMA = "page_id long, url string, html string, payload_bytes int, path string, copies int, refers_to string"


def run(spark, rows, **how):
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    index = warc.write_bundles(warc.plan_records(pages, **how), shared_dir(spark, "test-warc"))
    return index, sorted((tuple(r) for r in warc.read_bundles(index).drop("record_id").collect()), key=str)


def test_equals_its_sql(spark):
    assert rows_of(spark, warc.op2_warc_bundles, SF_TINY) == rows_of_sql(connect(SF_TINY), warc.OP2_SQL)


def page(i, html, url="http://x/"):
    return (i, url, html, 1, "p", 2, "r")


def test_edge_rows_by_broadcast_and_by_shuffle(spark):
    big, odd = "é" * 60, "<p>\r\n\r\nWARC/1.1\r\n</p>"
    rows = [page(5, big), page(3, big), page(3, big), page(9, big, None), page(1, "small"), page(2, "small"), page(None, big), page(7, None), page(8, "", "a b\r\nX: 1"), page(11, odd * 3000), page(None, "n" * 100), page(None, "n" * 100)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, _, html, *_ in rows:
        text = html or ""
        refers = 3 if text == big and i != 3 else None
        want.append((i, len(text.encode()), sha(text), "response" if refers is None else "revisit", refers))
    for how in ({}, {"broadcast_rows": 0}):
        assert run(spark, rows, **how)[1] == sorted(want, key=str)
    assert run(spark, [])[1] == []


def test_one_record_from_one_frame(spark):
    rows = [page(i, f"<html>{i}</html>" * 900) for i in range(60)]
    index = warc.write_bundles(warc.plan_records(spark.createDataFrame(rows, SCHEMA)), shared_dir(spark, "test-warc"), frame_bytes=40_000)
    for r in index.where("page_id IN (0, 17, 59)").collect():
        fields, block = warc.read_record(index, r["record_id"])
        assert block.endswith(rows[r["page_id"]][2].encode()) and fields["WARC-Type"] == "response"
    reader = warc.BundleReader(index.first()["path"])
    assert len(reader.frames) > 1 and max(f[2] for f in reader.frames) <= 40_000


def test_bundles_are_plain_zstandard(spark):
    import io

    import zstandard

    index, _ = run(spark, [page(1, "x" * 200), page(2, "x" * 200)])
    path = index.first()["path"].removeprefix("file:")
    data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open("/" + path.lstrip("/"), "rb").read()), read_across_frames=True).read()
    assert data.count(b"WARC/1.1\r\n") == 2
