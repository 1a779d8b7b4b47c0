"""WARC revisit resolution: headers meet by payload digest, archives are written anew without repeated payloads.

Only headers are shuffled.  Of the responses of one payload digest the earliest is the original; every other response and every
revisit record of that digest becomes a revisit that refers to it, with headers made anew.  Payloads stay with
the response they came with and are read once more when the archive is written.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, written

CRAWLS = ("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def record_id(*parts: Column) -> Column:
    """A name-based record id: the MD5 of what tells the record apart, written as a UUID."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    at = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *at))


def digest(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def captures(pages: DataFrame, crawls: tuple[str, ...] = CRAWLS) -> DataFrame:
    """Records of the crawls of pages: the first wrote responses, later ones found each page unchanged and wrote revisits, without payload.

    Null html is an empty payload, a null url is urn:unknown.  Columns: record_id, warc_type, target_uri, warc_date, payload_digest, payload.
    """
    uri, page = F.coalesce("url", F.lit("urn:unknown")), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    payload = F.coalesce("html", F.lit(""))
    base = pages.select(uri.alias("target_uri"), page.alias("page"), payload.alias("payload"), digest(payload).alias("payload_digest"))
    out = None
    for k, date in enumerate(crawls):
        one = base.select(
            record_id(F.lit(date), "page", "target_uri", "payload_digest").alias("record_id"), F.lit("revisit" if k else "response").alias("warc_type"), "target_uri",
            F.lit(date).alias("warc_date"), "payload_digest", (F.lit(None).cast("string") if k else F.col("payload")).alias("payload"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def header(kind: str, length: Column, refers: bool) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.col("warc_date")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Payload-Digest: "), F.col("payload_digest")),
    ]
    if refers:
        lines += [
            F.lit(f"WARC-Profile: {PROFILE}"),
            F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(">")),
            F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("refers_to_uri")),
            F.concat(F.lit("WARC-Refers-To-Date: "), F.col("refers_to_date")),
        ]
    lines += [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat_ws(CRLF, *lines)


HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"


def resolve(records: DataFrame) -> DataFrame:
    """Fresh records: record_id, warc_type, target_uri, warc_date, payload_digest, refers_to, resolved and record.

    Of the responses of a digest the one of least date, then record_id, stays a response; the others and all
    revisits become revisits of it.  A revisit whose original isn't there stays one that refers to nothing, and resolved is
    false.  A null digest is that of the payload; a null payload of a response is empty.  Rows repeated with a record_id
    count once.  Null record_ids, types other than response and revisit: left out.  Other columns aren't looked at.
    """
    own = records.where("record_id is not null and warc_type in ('response', 'revisit')").select(
        "record_id", "warc_type", F.coalesce("target_uri", F.lit("urn:unknown")).alias("target_uri"), F.coalesce("warc_date", F.lit("1970-01-01T00:00:00Z")).alias("warc_date"),
        F.coalesce("payload_digest", digest(F.coalesce("payload", F.lit("")))).alias("payload_digest"), "payload",
    )
    heads = written(own.drop("payload"), "warc-headers")
    first = F.min(F.struct("warc_date", "record_id", "target_uri")).alias("o")
    originals = heads.where("warc_type = 'response'").groupBy("payload_digest").agg(first)
    linked = heads.distinct().join(originals, "payload_digest", "left").select(
        *heads.columns, F.col("o.record_id").alias("refers_to"), F.col("o.target_uri").alias("refers_to_uri"), F.col("o.warc_date").alias("refers_to_date")
    )
    linked = written(linked.where("warc_type = 'revisit' or record_id <> refers_to"), "warc-revisits")
    dropped = small_side(linked.where("warc_type = 'response'").select("record_id"), 1 << 18)
    again = small_side(written(heads.where("warc_type = 'response'").groupBy("record_id").count().where("count > 1").select("record_id"), "warc-repeated"), 1 << 18)
    kept = own.where("warc_type = 'response'").join(dropped, "record_id", "left_anti")
    kept = kept.join(again, "record_id", "left_anti").unionByName(kept.join(again, "record_id", "left_semi").dropDuplicates(["record_id"]))
    body = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF), F.col("payload"))
    full = kept.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("body", body)
    nothing = F.lit(None).cast("string")
    responses = full.select(
        "record_id", "warc_type", "target_uri", "warc_date", "payload_digest", nothing.alias("refers_to"), F.lit(True).alias("resolved"),
        F.concat(header("response", F.octet_length("body"), False), F.lit(CRLF + CRLF), F.col("body"), F.lit(CRLF + CRLF)).alias("record"),
    )
    found = F.col("refers_to").isNotNull()
    bare = HTTP + CRLF
    size = F.lit(len(bare))
    revisits = linked.select(
        "record_id", F.lit("revisit").alias("warc_type"), "target_uri", "warc_date", "payload_digest", "refers_to", found.alias("resolved"),
        F.concat(F.when(found, header("revisit", size, True)).otherwise(header("revisit", size, False)), F.lit(CRLF + CRLF + bare + CRLF + CRLF)).alias("record"),
    )
    return responses.unionByName(revisits)


def write(fresh: DataFrame, folder: str) -> DataFrame:
    """Writes a .warc.gz per partition to ``folder``, which all executors share, one gzip member a record; returns record_id, file, offset and length.

    A file gets its name when it is whole, so a task that is run again does no harm; files are written when the result is used.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        own, at = Path(folder, f".{name}"), 0
        own.parent.mkdir(parents=True, exist_ok=True)
        ids, offsets, lengths = [], [], []
        with own.open("wb") as out:
            for b in batches:
                for i, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = gzip.compress(record.encode(), 6, mtime=0)
                    out.write(raw)
                    ids.append(i)
                    offsets.append(at)
                    lengths.append(len(raw))
                    at += len(raw)
        if not ids:
            own.unlink()
            return
        own.replace(Path(folder, name))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name] * len(ids)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["record_id", "file", "offset", "length"])

    return fresh.select("record_id", "record").mapInArrow(save, "record_id string, file string, offset long, length long")


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)
#: Bytes read at once; bytes in which a record's header must end; and of a record's block, beyond which it is passed over.
READ, HEAD, MOST = 1 << 20, 1 << 16, 1 << 30


class Unpacked:
    """A WARC file, gzipped by member or not, as bytes to be taken in order; what is damaged or cut off ends it."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.held, self.ended = file, bytearray(), False
        first = file.read(READ)
        self.gzip = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        self._take(first)

    def _take(self, raw: bytes) -> None:
        if not raw:
            self.ended = True
        elif self.gzip is None:
            self.held += raw
        else:
            try:
                while raw:
                    self.held += self.gzip.decompress(raw)
                    raw = self.gzip.unused_data
                    if self.gzip.eof:
                        self.gzip = zlib.decompressobj(31)
            except zlib.error:
                self.ended = True

    def fill(self, n: int) -> bool:
        """Are n bytes there?"""
        while len(self.held) < n and not self.ended:
            self._take(self.file.read(READ))
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        """Passes over n bytes, however many."""
        while n > len(self.held) and not self.ended:
            n -= len(self.held)
            self.held.clear()
            self._take(self.file.read(READ))
        del self.held[:n]

    def find(self, what: bytes, within: int) -> int:
        at = self.held.find(what)
        while at < 0 and len(self.held) < within and not self.ended:
            seen = max(0, len(self.held) - len(what))
            self._take(self.file.read(READ))
            at = self.held.find(what, seen)
        return at


def parse(file: BinaryIO | bytes) -> Iterator[dict[str, str | None]]:
    """Records of a WARC file, one at a time; the payload is what follows the HTTP header of a response.

    A record without a length, or cut off, is left out; so is the payload of one of over a GB.
    """
    own = Unpacked(io.BytesIO(file) if isinstance(file, bytes) else file)
    while True:
        at = own.find(b"WARC/1.", READ)
        if at < 0:
            if own.ended:
                return
            own.drop(max(1, len(own.held) - 6))
            continue
        own.drop(at)
        stop = own.find(b"\r\n\r\n", HEAD)
        fields = {} if stop < 0 else {k.lower().decode(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(bytes(own.held[:stop]))}
        length = fields.get("content-length", "").strip()
        if not (length.isascii() and length.isdigit()):
            own.drop(7)  # to the next that begins like a record
            if stop < 0 and own.ended:
                return
            continue
        own.drop(stop + 4)
        size, kind = int(length), fields.get("warc-type")
        body = None
        if size <= MOST:
            if not own.fill(size):
                return
            body = bytes(own.held[:size])
        own.drop(size)
        payload = body.partition(b"\r\n\r\n")[2] if kind == "response" and body is not None else None
        yield {
            "record_id": fields.get("warc-record-id", "").strip("<>") or None,
            "warc_type": kind,
            "target_uri": fields.get("warc-target-uri"),
            "warc_date": fields.get("warc-date"),
            "payload_digest": fields.get("warc-payload-digest"),
            "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
            "payload": None if payload is None else payload.decode("utf-8", "replace"),
        }


RECORD = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files of a path, which are read as streams: a file may be of any size, only a record is held at once."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                system, where = fs.FileSystem.from_uri(unquote(name))
                rows, size = [], 0
                with system.open_input_stream(where, compression=None) as file:
                    for r in parse(file):
                        rows.append(r)
                        size += len(r["payload"] or "") + 500
                        if size > 8 * READ:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], pa.string()) for n in names], names=names)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], pa.string()) for n in names], names=names)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(records, RECORD)


def oracle() -> str:
    """``resolve(captures(pages))`` as DuckDB SQL."""
    crlf = "chr(13) || chr(10)"
    uid = "'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"
    http = f"'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf}"
    tail = f"'Content-Type: application/http; msgtype=response' || {crlf} || 'Content-Length: ' || strlen(body) || {crlf} || {crlf} || body || {crlf} || {crlf}"
    return f"""
        with base as (select coalesce(url, 'urn:unknown') as target_uri, coalesce(page_id::varchar, 'null') as page, coalesce(html, '') as payload,
                             'sha256:' || sha256(coalesce(html, '')) as payload_digest from pages),
        crawl as (select unnest(['{CRAWLS[0]}', '{CRAWLS[1]}']) as warc_date),
        named as (select *, md5(warc_date || chr(10) || page || chr(10) || target_uri || chr(10) || payload_digest) as h from base, crawl),
        records as (select distinct {uid} as record_id, target_uri, warc_date, payload_digest, payload, warc_date = '{CRAWLS[0]}' as response from named),
        ranked as (select *, first_value(record_id) over w as first_id, first_value(target_uri) over w as first_uri
                   from records where response window w as (partition by payload_digest order by record_id)),
        originals as (select distinct payload_digest, first_id, first_uri from ranked),
        fresh as (select r.*, o.first_id, o.first_uri, r.record_id = o.first_id as original,
                         case when r.record_id = o.first_id then {http} || 'Content-Length: ' || strlen(payload) || {crlf} || {crlf} || payload
                              else {http} || {crlf} end as body
                  from records as r join originals as o using (payload_digest))
        select record_id, case when original then 'response' else 'revisit' end as warc_type, target_uri, warc_date, payload_digest,
               case when not original then first_id end as refers_to, true as resolved,
               'WARC/1.1' || {crlf} || 'WARC-Type: ' || case when original then 'response' else 'revisit' end || {crlf} || 'WARC-Record-ID: <' || record_id || '>' || {crlf}
               || 'WARC-Date: ' || warc_date || {crlf} || 'WARC-Target-URI: ' || target_uri || {crlf} || 'WARC-Payload-Digest: ' || payload_digest || {crlf}
               || case when original then '' else 'WARC-Profile: {PROFILE}' || {crlf} || 'WARC-Refers-To: <' || first_id || '>' || {crlf}
                  || 'WARC-Refers-To-Target-URI: ' || first_uri || {crlf} || 'WARC-Refers-To-Date: {CRAWLS[0]}' || {crlf} end
               || {tail} as record
        from fresh"""
