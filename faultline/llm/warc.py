"""Operator 10 - WARC archives with segmented, chunked records.

``write`` turns each page into an HTTP response in a WARC file (one gzip member per record).  Of pages with
equal payloads the one with the smallest id is a response and the others are revisits of it, without payload.
A response's body is framed in HTTP chunks; a block longer than ``segment_bytes`` is cut into a first record
and continuation records.  ``read`` parses the files, groups segments by origin identifier, orders them by
segment number, verifies that they are all there and add up to the stated total length, and decodes the chunks.

Archives are written under a temporary name and renamed; the manifest of files is small and is what is read.

Defined results: a null payload is empty; payloads under ``least`` bytes are always responses; rows that repeat
an id and a payload are all responses, or all revisits of a smaller id; a page with a null id revisits a page
with an id, or is a response.  A record that fails verification is returned with its ``fault`` and no digest; a file
that breaks off, or is no archive from some point on, gives the records before that point and one row with a fault.
Records of other types (warcinfo, request, metadata) are no pages and give no row.
A response whose digest is absent or not SHA-256 is taken as it is; a revisit then has a fault, and so has one whose
response is not in the archives or has another digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, partitions, with_facts
from .tokenfiles import _store

LEAST, SEGMENT, CHUNK = 100, 8192, 2048
#: Slots that tell digests that may repeat: a bit each, so at most 2^18 rows are broadcast, whatever the corpus.
SLOTS = 1 << 24
DATE = "2024-01-01T00:00:00Z"
#: The kind of the row that stands for what can't be read of a file.
DAMAGED = "damaged"
RECORD = "origin string, segment int, total long, page_id long, kind string, refers_to long, stated string, block binary"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, fault string"


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The pages with their payload, its digest and the page they revisit (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # only digests that repeat are met, and of those a hot one's rows are dealt over all tasks
    repeated = keep(rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    # payloads are moved for that only where the digest's slot is one of a repeated digest; other rows stay where they are read
    marks = repeated.select(_slot()).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    told = rows.withColumn("slot", _slot()).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(marks), "word", "left")
    told = told.withColumn("maybe", F.expr("coalesce(shiftright(bits, cast(slot % 64 as int)) & 1L, 0L) = 1L"))
    alone = told.where("not maybe").select(*rows.columns, F.lit(None).cast("long").alias("first"))
    met = with_facts(told.where("maybe").select(*rows.columns), repeated, "digest", F.coalesce(F.col("page_id"), F.xxhash64("url")))
    met = alone.unionByName(met)
    return met.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))).drop("first")


def _slot() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).alias("slot")


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [body[k : k + size] for k in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = data.index(b"\r\n", at)
        size, at = int(data[at:line].split(b";")[0], 16), line + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(data[at : at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_records(name: str, page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one page: one, or a first segment and its continuations."""
    origin = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    uri = "".join(c for c in url or "" if c > " ")
    common = {"WARC-Date": DATE, "WARC-Target-URI": uri, "X-Page-Id": page_id, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": origin, **common, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": refers_to, "Content-Type": "application/http;msgtype=response"}, head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    first = {"WARC-Type": "response", "WARC-Record-ID": origin, **common, "Content-Type": "application/http;msgtype=response"}
    if len(parts) == 1:
        yield record(first, block)
        return
    yield record(first | {"WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{k}')}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": k}
        yield record(own | ({"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}), part)


def _writer(out_dir: str, segment: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, n = f"pages-{task.partitionId():05d}.warc.gz", 0
        store, path = _store(out_dir)
        store.create_dir(path, recursive=True)
        temporary = f"{path}/.{name}.{task.taskAttemptId()}"
        with store.open_output_stream(temporary) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "payload")), strict=True):
                    for data in page_records(f"{out_dir}/{name}/{n}", *row, segment, chunk):
                        z = zlib.compressobj(4, zlib.DEFLATED, 31)
                        out.write(z.compress(data) + z.flush())
                    n += 1
        if n:
            store.move(temporary, f"{path}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "n_pages": n}])
        else:
            store.delete_file(temporary)

    return run


def write(pages: DataFrame, out_dir: str, least: int = LEAST, segment_bytes: int = SEGMENT, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write the archives; the manifest has file, n_pages."""
    return keep(decide(pages, least).mapInArrow(_writer(out_dir, segment_bytes, chunk_bytes), "file string, n_pages long"))


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a stream that has read and readline; ValueError where it is no archive."""
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := data.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields.get("content-length", "?"))
        block = data.read(size)
        if len(block) != size or not line:
            raise ValueError("the file ends within a record")
        yield fields, block


def _number(x: str | None) -> int | None:
    """A header's number; a header that is none counts as absent."""
    return int(x) if x is not None and x.isascii() and x.isdigit() else None


def _row(f: dict[str, str], block: bytes) -> tuple:
    origin = f.get("warc-segment-origin-id", f.get("warc-record-id"))
    return origin, _number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length")), _number(f.get("x-page-id")), f.get("warc-type"), _number(f.get("x-refers-to-page-id")), f.get("warc-payload-digest"), block


def _parse(out_dir: str):
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = {"segment": pa.int32(), "total": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "block": pa.binary()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in names])
        store, path = _store(out_dir)
        rows, size = [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with store.open_input_file(f"{path}/{file}") as raw, gzip.GzipFile(fileobj=raw, mode="rb") as data:
                    found = records(data)
                    while True:
                        try:
                            if (record := next(found, None)) is None:
                                break
                            if record[0].get("warc-type") not in ("response", "revisit", "continuation"):
                                continue  # what describes the archive, or a request, is no page
                            rows.append(_row(*record))
                        except (ValueError, EOFError, OSError, zlib.error) as error:
                            if isinstance(error, OSError) and not isinstance(error, gzip.BadGzipFile):
                                raise  # the store's fault, not the archive's: the task is tried again
                            # what stood before the damage is kept; the rest of the file is one faulty record
                            rows.append((f"{file}#damaged", None, None, None, DAMAGED, None, str(error), b""))
                            break
                        size += len(rows[-1][-1])
                        if size >= 2 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _algorithm(stated: str | None) -> str | None:
    """What a digest was made with; one that is absent or made otherwise is not compared."""
    return stated.partition(":")[0].lower() if stated and ":" in stated else None


def page_of(parts: list[dict]) -> dict:
    """One page from its records, in any order."""
    parts = sorted(parts, key=lambda p: p["segment"] or 0)
    head = parts[0]
    out = {"page_id": head["page_id"], "payload_bytes": None, "payload_digest": None, "record_type": head["kind"], "refers_to": head["refers_to"], "fault": None}
    if head["kind"] == DAMAGED:
        return out | {"record_type": None, "fault": f"the archive is damaged: {head['stated']}"}
    if head["kind"] == "continuation":
        return out | {"record_type": None, "fault": "segments are missing"}
    block = b"".join(p["block"] for p in parts)
    if head["segment"] is not None:
        if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
            return out | {"fault": "segments are missing"}
        if parts[-1]["total"] != len(block):
            return out | {"fault": "the segments' length is not the total"}
    elif len(parts) > 1:
        return out | {"fault": "more than one record"}
    try:
        line, _, body = block.partition(b"\r\n\r\n")
        fields = dict(x.lower().split(b": ", 1) for x in line.split(b"\r\n")[1:])
        if head["kind"] == "revisit":
            if _algorithm(head["stated"]) != "sha256":
                return out | {"fault": "the revisit states no SHA-256 digest"}
            return out | {"payload_bytes": int(fields[b"content-length"]), "payload_digest": head["stated"].partition(":")[2].lower()}
        body = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    except (ValueError, KeyError):
        return out | {"fault": "the framing is broken"}
    digest = hashlib.sha256(body).hexdigest()
    if _algorithm(head["stated"]) == "sha256" and head["stated"].partition(":")[2].lower() != digest:
        return out | {"fault": "the payload is not what its digest says"}
    return out | {"payload_bytes": len(body), "payload_digest": digest}


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    schema = pa.schema([(c.split()[0], types.get(c.split()[0], pa.string())) for c in PAGE.split(", ")])
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield pa.RecordBatch.from_pylist([page_of(parts) for parts in batch.slice(a, 256).column("parts").to_pylist()], schema=schema)


def read(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, fault: a row per page of the archives.
    Whole records are decoded where they are read; only segments are shuffled, by their origin identifier."""
    found = manifest.repartition(partitions(spark)).mapInArrow(_parse(out_dir), RECORD)
    parts = F.struct("segment", "total", "page_id", "kind", "refers_to", "stated", "block")
    whole = found.where("segment is null").select(F.array(parts).alias("parts"))
    cut = found.where("segment is not null").groupBy("origin").agg(F.collect_list(parts).alias("parts")).select("parts")
    pages = keep(whole.union(cut).mapInArrow(_assemble, PAGE))
    # a revisit stands for a response: one row per response that is revisited, met by its revisits
    revisits = F.col("record_type") == "revisit"
    wanted = pages.where(revisits & F.col("refers_to").isNotNull()).groupBy(F.col("refers_to").alias("_at")).agg(F.count("*").alias("n"))
    have = pages.where((F.col("record_type") == "response") & F.col("fault").isNull()).select(F.col("page_id").alias("_at"), "payload_digest")
    # rows that repeat an id may hold several payloads, each of which can be revisited
    there = wanted.join(have, "_at").groupBy("_at").agg(F.first("n").alias("n"), F.collect_set("payload_digest").alias("_said"))
    met = with_facts(pages.withColumn("_at", F.when(revisits, F.col("refers_to"))), keep(there), "_at", F.col("page_id"))
    lost = revisits & F.col("fault").isNull() & ~F.coalesce(F.array_contains("_said", F.col("payload_digest")), F.lit(False))
    return met.select("page_id", *(F.when(~lost, F.col(c)).alias(c) for c in ("payload_bytes", "payload_digest")), "record_type", "refers_to", F.when(lost, "the response it names is not there").otherwise(F.col("fault")).alias("fault"))
