"""WARC archives: writing captures, reading archives, assembling transactions.

A capture becomes three records: a request, a response (or a revisit, where an
equal payload is stored already) and metadata. Request and metadata name the
response in WARC-Concurrent-To. Each record is a gzip member of its own, in files
of bounded size, so a reader never holds more than a file and a record. Records are cut
by Content-Length, never by content.

Which payloads are equal is settled on digests alone; pages are joined with that by
their row number, so the commonest payload is no task's burden.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm.common import new_path, written

_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORDS = "kind string, record_id string, concurrent_to string, target_uri string, date string, refers_to string, declared_digest string, http_head string, fields string, payload binary"


def _uuid(*cols) -> Column:
    h = F.sha2(F.concat_ws("|", *cols), 256)
    return F.concat(F.lit("urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.substring(h, a, n)] if n == 12 else [F.substring(h, a, n), F.lit("-")])))


def _record(kind: str | Column, own: Column, uri: Column, date: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: <"), own, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Date: "), date)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # concat_ws leaves out nulls
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), body)


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int, date: Column) -> DataFrame:
    """(request, main, metadata) of each page: the texts of its three records."""
    tagged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("body"), date.alias("date"), F.monotonically_increasing_id().alias("tag"))
    tagged = tagged.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("bytes", F.octet_length("body"))
    slim = written(tagged.filter(F.col("bytes") >= least_bytes).select("tag", "id", "digest"), "digests")
    shared = slim.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")).alias("first")).filter("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.tag").alias("first_tag"))
    again = written(slim.join(shared, "digest").filter("tag <> first_tag").select("tag", "first_id", "first_tag"), "revisits")
    response_id = lambda i, tag: _uuid(F.lit("response"), F.coalesce(F.col(i).cast("string"), F.lit("")), F.col(tag).cast("string"))
    revisit = F.col("first_tag").isNotNull()
    rows = tagged.join(again, "tag", "left").select("id", "url", "body", "date", "digest", "bytes", revisit.alias("revisit"), response_id("id", "tag").alias("rid"), F.when(revisit, response_id("first_id", "first_tag")).alias("to"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    head = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    body = F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("body")))
    own, link = F.col("rid"), [("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("rid"), F.lit(">")))]
    main = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Refers-To", F.concat(F.lit("<"), F.col("to"), F.lit(">"))), ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", F.lit("application/http;msgtype=response"))]
    ask = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n"))
    about = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "url", F.col("bytes").cast("string").alias("payload_bytes")))
    when = F.col("date")
    return rows.select(
        _record("request", _uuid(F.lit("request"), own), uri, when, [*link, ("Content-Type", F.lit("application/http;msgtype=request"))], ask).alias("request"),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"), own, uri, when, main, body).alias("main"),
        _record("metadata", _uuid(F.lit("metadata"), own), uri, when, [*link, ("Content-Type", F.lit("application/json"))], about).alias("metadata"),
    )


def _gzipped(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, date: str | Column = "2024-01-01T00:00:00Z", file_bytes: int = 64_000_000) -> str:
    """Write three records for each row of ``pages``, which must give the same rows
    each time it is read. Of equal payloads of ``least_bytes`` and more, the one with
    the smallest id (nulls last) becomes the response and all others revisits of it;
    of repeated rows with that id one is the response. A null payload is empty, a null
    url too. ``date`` is text or a column of it; a fixed one makes reruns equal.

    Tasks write ``*.warc.gz`` of about ``file_bytes`` (a larger record gets a file of its
    own); a task that runs again writes the same files again. Where pyarrow has no
    access to the store, Spark's text writer makes files that are gzipped as a whole."""
    records = _records(pages, id_col, url_col, payload_col, least_bytes, F.lit(date) if isinstance(date, str) else date)
    try:
        store, folder = FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
    except (pa.ArrowException, OSError, ValueError):
        records.select(F.concat_ws(_CRLF * 2, "request", "main", "metadata").alias("value")).write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)
        return path

    def run(batches):
        store, folder = FileSystem.from_uri(path)
        part, made, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush():
            name = f"part-{part:05d}-{len(made):05d}.warc.gz"
            attempt = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(attempt, compression=None) as out:
                for member in held:
                    out.write(member)
            store.move(attempt, f"{folder}/{name}")
            made.append((name, size))

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(3))):
                members = [_gzipped(x.as_py().encode("utf-8", "surrogatepass")) for x in row]
                more = sum(map(len, members))
                if held and size + more > file_bytes:
                    flush()
                    held, size = [], 0
                held += members
                size += more
        if held:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made]), pa.array([s for _, s in made], pa.int64())], names=["file", "bytes"])

    written(records.mapInArrow(run, "file string, bytes bigint"), "manifest")
    return path


def parse_records(data: bytes):
    """The records of one archive, as (headers, block); ``data`` may be gzipped, as a
    whole or record by record. See :func:`stream_records`."""
    return stream_records([data])


def _plain(chunks, window: int = 1 << 14):
    """Bytes of gzipped or plain chunks, a megabyte at a time at most. Packed bytes go
    in by windows, as what is left behind a member's end is copied."""
    packed, unpacker = None, None
    for chunk in chunks:
        if packed is None:
            packed = bytes(chunk[:2]) == b"\x1f\x8b"
        if not packed:
            yield chunk
            continue
        view, at = memoryview(chunk), 0
        while at < len(view):
            unpacker = unpacker or zlib.decompressobj(31)
            part = view[at : at + window]
            out = unpacker.decompress(part, 1 << 20)
            # behind a member's end an older unconsumed_tail may stay, beside unused_data
            at += len(part) - len(unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail)
            if unpacker.eof:
                unpacker = None
            if out:
                yield out
        while unpacker is not None and (out := unpacker.decompress(unpacker.unconsumed_tail, 1 << 20)):
            yield out


def stream_records(chunks):
    """The records of one archive, as (headers, block), from chunks of its bytes; no
    more than a record is held. Names are lower-cased. Raises ValueError where the
    bytes aren't a WARC archive."""
    held, at, source = bytearray(), 0, _plain(chunks)

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    def upto(n: int) -> bool:
        while len(held) < n:
            if not more():
                return False
        return True

    done = 0
    while True:
        while upto(2) and held[:2] == b"\r\n":
            del held[:2]
            done += 2
        if not held:
            return
        upto(5)
        at = 0
        while (end := held.find(b"\r\n\r\n", max(0, at - 3))) < 0 and held.startswith(b"WARC/"):
            at = len(held)
            if not more():
                break
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {done}")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not upto(end + 4 + size):
            raise ValueError("a record ends early")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        done += end + 4 + size


def _row(headers: dict, block: bytes) -> tuple:
    kind = headers.get("warc-type")
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    head = fields = payload = None
    if kind in ("response", "revisit", "request") and "http" in headers.get("content-type", ""):
        head, _, payload = block.partition(b"\r\n\r\n")
        head = head.decode("utf-8", "replace")
        payload = payload if kind == "response" else None
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    return kind, bare("warc-record-id"), bare("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"), bare("warc-refers-to"), headers.get("warc-payload-digest"), head, fields, payload


def read_archives(spark: SparkSession, path: str, batch_bytes: int = 8_000_000) -> DataFrame:
    """One row (:data:`RECORDS`) for each record of the archives in ``path``; files
    may be gzipped, as a whole or record by record. A task holds one file as it lies
    there, and a record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{*.warc,*.warc.gz,part-*.txt.gz}").load(path).select("content")
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "payload" else pa.string()) for k, c in zip(names, cols)], names=names)

    def run(batches):
        for got in batches:
            for content in got.column(0):
                rows, held = [], 0
                for headers, block in stream_records([content.as_py()]):
                    rows.append(_row(headers, block))
                    held += len(block) + 500
                    if held >= batch_bytes:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: ``capture_id``, ``request`` and ``metadata`` (arrays of
    structs, by record id, empty where there are none) and ``response`` (a response or
    revisit, or null). Records belong together if they name the same record in
    WARC-Concurrent-To, or are it; so one shuffle joins all three kinds, and captures with
    parts missing stay. A record that archives hold twice counts once."""
    fields = F.struct("record_id", "kind", "target_uri", "date", "refers_to", "declared_digest", "http_head", "fields", "payload")
    slim = F.struct("record_id", "kind", "target_uri", "date", "http_head", "fields")
    several = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, slim)))
    return (
        records.filter(F.col("record_id").isNotNull())
        .groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
        .agg(several("request").alias("request"), F.max(F.when(F.col("kind").isin("response", "revisit"), fields)).alias("response"), several("metadata").alias("metadata"))
    )


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: the
    nested rows of :func:`assemble`, from the archives alone."""
    spark = pages.sparkSession
    path = write_archives(pages, new_path(spark, "warc"), id_col, url_col, payload_col, least_bytes)
    return assemble(read_archives(spark, path))


def capture_facts(nested: DataFrame, id_type: str = "bigint") -> DataFrame:
    """For each capture with a response: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type`` and ``refers_to`` (the id of the capture whose
    response a revisit names). Bytes and digest of a response come from the payload
    read back, those of a revisit from the response that it refers to."""
    slim = written(
        nested.filter(F.col("response").isNotNull()).select(
            F.col("response.record_id").alias("record_id"),
            F.get_json_object(F.get("metadata", F.lit(0))["fields"], "$.id").cast(id_type).alias("page_id"),
            F.octet_length("response.payload").cast("bigint").alias("payload_bytes"),
            F.sha2("response.payload", 256).alias("payload_digest"),
            F.col("response.kind").alias("record_type"),
            F.col("response.refers_to").alias("to_record"),
        ),
        "captures",
    )
    target = slim.filter("record_type = 'response'").select(F.col("record_id").alias("to_record"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"))
    plain = slim.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    again = slim.filter("record_type = 'revisit'").join(target, "to_record", "left").select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"))
    return plain.unionByName(again)


__all__ = ["assemble", "capture_facts", "captures", "parse_records", "read_archives", "stream_records", "write_archives"]
