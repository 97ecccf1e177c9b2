import hashlib

from tidemark.llm import warc
from tidemark.llm.common import fresh_path
from tidemark.llm.queries import op4_warc


def test_pages(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = {}
    for i, p in pages.items():
        again = len(p) >= 100 and first[p] != i
        want[i] = (i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None)
    assert {r["page_id"]: tuple(r) for r in op4_warc(spark, sf_dir).collect()} == want


def test_round_trip_and_edges(spark):
    long, short = "é" * 60, "tiny"
    rows = [(4, "u4", long, "a"), (2, "u\r\n2", long, "b"), (None, "n", long, "c"), (7, None, None, "d"), (8, "u8", "", "e"), (9, "u9", short, "f"), (1, "u1", short, "g")]
    rows += [(i, f"h{i}", "hot " * 50, "h") for i in range(1000, 1700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = warc.write_archive(pages, fresh_path(spark, "warc"))
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = {r["page_id"]: r for r in warc.read_records(spark, path).collect()}
    assert len(records) == len(rows)
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        r = records[i]
        assert bytes(r["payload"]) == payload and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and body == (payload if r["record_type"] == "response" else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(body) - 4}".encode() in head
    assert (records[4]["record_type"], records[4]["refers_to"]) == ("revisit", 2)
    assert records[2]["record_type"] == records[None]["record_type"] == records[9]["record_type"] == "response"
    assert records[2]["target_uri"] == "u 2"
    assert sum(r["record_type"] == "revisit" for i, r in records.items() if i and i >= 1000) == 699
    empty = warc.write_archive(pages.limit(0), fresh_path(spark, "warc"))
    assert warc.read_index(spark, empty).count() == 0
