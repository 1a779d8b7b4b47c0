import gzip

import pytest

from brindle.llm import warc
from tests.compare import same

RECORDS = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload string"


def test_agrees_with_sql(spark, small, duck):
    same(warc.resolve(warc.captures(spark.read.parquet(f"{small}/pages.parquet"))), duck, warc.oracle())


def test_written_archives_read_back(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    fresh = warc.resolve(warc.captures(pages)).cache()
    where = str(tmp_path / "out")
    places = warc.write(fresh, where).collect()
    back = {r.record_id: r for r in warc.read(spark, where + "/*.warc.gz").collect()}
    assert set(back) == {r.record_id for r in fresh.collect()} == {r.record_id for r in places}
    for r in fresh.collect():
        b = back[r.record_id]
        assert (b.warc_type, b.target_uri, b.warc_date, b.payload_digest, b.refers_to) == (r.warc_type, r.target_uri, r.warc_date, r.payload_digest, r.refers_to)
        if r.refers_to:
            assert back[r.refers_to].warc_type == "response" and back[r.refers_to].payload_digest == r.payload_digest
    assert {r.html for r in pages.collect()} == {b.payload for b in back.values() if b.warc_type == "response"}
    assert len({b.payload_digest for b in back.values() if b.warc_type == "response"}) == sum(b.warc_type == "response" for b in back.values())


def test_odd_rows(spark):
    rows = [
        ("b", "response", "u1", "2024-01-01", "d1", "x"),
        ("a", "response", "u2", "2024-01-01", "d1", "x"),  # a tie of dates: the lesser id is the original
        ("c", "revisit", None, None, "d1", None),
        ("d", "revisit", "u4", "2024-02-01", "lost", None),
        ("e", "response", "u5", "2024-01-01", None, None),
        ("e", "response", "u5", "2024-01-01", None, None),
        ("f", "request", "u6", "2024-01-01", "d1", "x"),
        (None, "response", "u7", "2024-01-01", "d9", "y"),
        ("g", None, "u8", "2024-01-01", "d9", "y"),
        ("h", "response", "u9", "2024-03-01", "d2", "é" * 200_000),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    for name in ("o", "body", "refers_to", "count"):
        df = df.withColumn(name, df.record_id)
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    assert {k: (r.warc_type, r.refers_to, r.resolved) for k, r in got.items()} == {
        "a": ("response", None, True), "b": ("revisit", "a", True), "c": ("revisit", "a", True), "d": ("revisit", None, False), "e": ("response", None, True), "h": ("response", None, True),
    }
    assert warc.resolve(df).count() == 6
    head, _, body = got["h"].record.partition("\r\n\r\n")
    assert f"Content-Length: {len(body.encode()) - 4}" in head
    assert warc.resolve(df.limit(0)).count() == 0


def record(k, body, length=None):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{k}>\r\nContent-Length: {len(http) if length is None else length}\r\n\r\n".encode() + http + b"\r\n\r\n"


@pytest.mark.parametrize("step", [64, 1 << 20])
def test_damaged_files_give_what_is_whole(monkeypatch, step):
    monkeypatch.setattr(warc, "READ", step)
    bodies = [b"x" * n for n in (0, 1, 700, 70_000)]
    whole = [record(k, b) for k, b in enumerate(bodies)]
    said = lambda raw: [(r["record_id"], len(r["payload"])) for r in warc.parse(raw)]
    every = [(f"r{k}", len(b)) for k, b in enumerate(bodies)]
    assert said(b"".join(whole)) == every
    packed = b"".join(gzip.compress(r) for r in whole)
    assert said(packed) == every and said(gzip.compress(b"".join(whole))) == every
    assert said(packed[:-20]) == every[:-1] and said(b"".join(whole)[:-5000]) == every[:-1] and said(b"") == [] and said(b"junk" * 50) == []
    assert said(whole[0] + record(9, b"odd", "many") + whole[1]) == [every[0], every[1]]
    assert said(b"junk" * 100 + whole[2] + b"more junk" + whole[3]) == every[2:]
    monkeypatch.setattr(warc, "MOST", 1000)
    assert [r["payload"] is None for r in warc.parse(b"".join(whole))] == [False, False, False, True]
