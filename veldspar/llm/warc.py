"""WARC archives without repeated payloads: writing, revisit resolution and reading back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldspar.operators.graph import joined_back
from veldspar.storage import stage

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_url string, refers_date string, payload string, intact boolean"
#: Bytes of records that a file holds before it is compressed, about, and revisits that may be broadcast.
FILE_BYTES, BROADCAST_ROWS = 64 << 20, 1_000_000


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal digits: five of them are four letters."""
    letters = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add record_type, refers_to, refers_url and refers_date to ``headers`` (page_id, url, date, payload_digest,
    payload_bytes, ...), which hold no payloads.

    Of the records with equal payloads of at least ``least_bytes`` that with the largest page_id is the response
    and others revisit it; smaller ones are all responses. Records without a page_id are responses; so are all that
    share the largest page_id, of which the revisits name one. Originals are found with a partial maximum in each
    task and staged, so the join back is one that Spark can split where a digest is hot.
    """
    first = headers.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "date")).alias("_first"), F.min("page_id").alias("_least"))
    first = first.where(F.col("_first.page_id") > F.col("_least")).select(F.col("payload_digest").alias("_digest"), "_first")
    kept = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest"))
    joined = joined_back(headers.withColumn("_key", kept), "_key", first, "_digest", "left").drop("_key")
    revisit = F.col("page_id") < F.col("_first.page_id")
    told = {"refers_to": "page_id", "refers_url": "url", "refers_date": "date"}
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response")} | {name: F.when(revisit, F.col(f"_first.{c}")) for name, c in told.items()}).drop("_first")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _uris(url: Column) -> Column:
    """White space and controls of a URL percent-encoded."""
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def header_text() -> tuple[Column, Column]:
    """The WARC/1.1 header and the HTTP header of a row (page_id, url, date, payload_digest in hexadecimal digits,
    payload_bytes and what ``resolve_revisits`` adds), all fresh: a revisit names its original's URI and date. A
    revisit's block is the HTTP header alone."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END + _END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    warc = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "), "record_type", F.lit(_END),
        _field("WARC-Record-ID", _uri(F.col("page_id"))), _field("WARC-Target-URI", _uris(F.col("url"))), _field("WARC-Date", F.col("date")),
        F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("payload_digest")), F.lit(_END),
        _field("WARC-Refers-To", _uri(F.col("refers_to"))), _field("WARC-Refers-To-Target-URI", _uris(F.col("refers_url"))), _field("WARC-Refers-To-Date", F.col("refers_date")),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}Content-Length: "), length.cast("string"), F.lit(_END + _END),
    )
    return warc, http


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write a WARC record for each row of ``pages`` (page_id, url, html and, if there is one, date as text) into
    files under ``path``; ``date`` stands for a missing or null one.

    Only headers are shuffled by digest. The rows that turn out to be revisits, by number, are then taken out of the
    table of payloads: by a broadcast where they are counted and few, by a join on the row's number otherwise, which
    has no hot key. Null html is an empty payload; repeated and null page_ids are records of their own; an empty
    table gives no records.

    The files are compressed by gzip, as archives are kept. Spark's own text writer ends each record with the two line
    ends that the format asks for; its committer makes sure that a task that is run again leaves no second copy. A
    file takes as many records as make up ``file_bytes`` by their mean size.
    """
    payload = F.coalesce("html", F.lit(""))
    told = F.coalesce(F.col("date"), F.lit(date)) if "date" in pages.columns else F.lit(date)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", told.alias("date"), payload.alias("html"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = stage(rows, "payloads")
    revisits = stage(resolve_revisits(rows.drop("html"), least_bytes).where("record_type = 'revisit'"), "revisits")
    taken = revisits.select("row")
    responses = rows.join(F.broadcast(taken) if revisits.count() <= BROADCAST_ROWS else taken, "row", "left_anti")
    none = {name: F.lit(None).cast(revisits.schema[name].dataType) for name in ("refers_to", "refers_url", "refers_date")}
    responses = responses.withColumns({"record_type": F.lit("response")} | none)
    warc, http = header_text()
    lines = responses.select(F.concat(warc, http, "html").alias("value")).unionByName(revisits.select(F.concat(warc, http).alias("value")))
    mean = rows.agg(F.avg(F.col("payload_bytes") + 400)).first()[0] or 1  # about 400 bytes of headers
    lines.write.option("lineSep", _END + _END).option("maxRecordsPerFile", max(1, int(file_bytes / mean))).option("compression", "gzip").text(path)


def _inflated(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """What a gzip file holds, some at a time, member after member."""
    engine, at = zlib.decompressobj(31), 0
    while at < len(data):
        yield engine.decompress(data[at : at + step])
        at += step
        while engine.eof:
            rest, engine = engine.unused_data, zlib.decompressobj(31)
            if not rest:
                break
            yield engine.decompress(rest)


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; no more is held than a record and a chunk."""
    held = bytearray()

    def fill(enough) -> bool:
        while not enough():
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(lambda: b"\r\n\r\n" in held) or held:
        end = held.find(b"\r\n\r\n")
        lines = bytes(held[: max(end, 0)]).decode("utf-8", "replace").split(_END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if not fill(lambda need=end + 4 + size + 4: len(held) >= need) or held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def _page(uri: str | None) -> int | None:
    return int(uri.rpartition(":")[2].rstrip(">")) if uri else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """Read archives that write_archives() wrote: READ_SCHEMA. ``intact`` tells whether a response's payload has
    the size and digest that its headers name; a revisit's payload is null and its size that of the HTTP header.
    If ``strict``, a record that isn't intact is an error; one that is cut short always is. Records are found by their
    Content-Length, so payloads may hold anything; what is held is a file as it is compressed, and a record."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                out = []
                for fields, block in _records(_inflated(memoryview(cell.as_buffer()))):
                    raw = block
                    head = raw.index(b"\r\n\r\n") + 4
                    size = int(next(x for x in raw[:head].split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
                    digest, revisit = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"] == "revisit"
                    body = raw[head:]
                    intact = not body if revisit else len(body) == size and base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                    if strict and not intact:
                        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
                    out.append((_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-date"), fields["warc-type"], size, digest, _page(fields.get("warc-refers-to")), fields.get("warc-refers-to-target-uri"), fields.get("warc-refers-to-date"), body.decode() if payloads and not revisit else None, intact))
                    if len(out) == 256:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    return files.mapInArrow(run, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.bool_()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
