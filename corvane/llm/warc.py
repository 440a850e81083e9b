"""WARC archives: writing captures, reading records, assembling transactions.

Writing: one row holds the request, the response (or revisit) and the metadata
record of a page, as bytes built by SQL functions, and Spark's text writer stores
them with the record terminator as line separator. So archives go to any store that
Spark writes to, a lost task is simply run again, and no Python sees a payload.

Reading: each archive file is one binary row; records are cut by Content-Length, so
a payload may hold anything, record marks included. Files are kept small while
writing (``FILE_BYTES`` on average, at most ``LARGE`` times that), which bounds the
memory of a reading task; a page of more than that many mean sizes is a file of its own.

Assembly: request, response and metadata records meet through WARC-Concurrent-To,
and each capture becomes one nested row.

Revisits: of rows with equal payloads of at least ``min_revisit`` bytes, those with
the smallest page_id are responses and all others revisits of it, which store no
payload and refer to the response's record id. Digests with copies are found by a
pre-aggregated count of digests. Record ids are made of the page id and of hashes of
URL and payload, so that writing again names records alike. Reading back, a payload
that does not fit its digest, or a revisit without a response of its digest, is an error;
the bytes of a response are counted, those of a revisit told by its metadata record.

Defined cases: a null html is an empty payload; a null url is an empty target; rows
with a null page_id are captures of their own that come back with a null page_id;
repeated rows are written each (both are responses if theirs is the smallest page_id)
and share their record ids if page, URL and payload are equal; a page must stay below
2 GB, the limit of a value in Spark; an empty table makes no archive and gives an empty
result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import beside, cut, new_path

END = "\r\n\r\n"
FILE_BYTES = 16 << 20
#: A page of more than so many mean sizes has a file of its own, which bounds every
#: other file by so many times FILE_BYTES.
LARGE = 32
#: Up to so many duplicated digests (about 100 bytes each) are sent to every task.
BROADCAST_ROWS = 50_000
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "content_type string, payload_bytes long, payload_digest string, fields map<string,string>, "
    "intact boolean, payload binary"
)


def _record(kind: str, capture: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:capture:"), capture, F.lit(f":{kind}>\r\n")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    length = F.octet_length(block).cast("string")
    lines += [F.lit("Content-Length: "), length, F.lit(END), block]
    return F.concat(*[x.cast("binary") for x in lines])


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit: int = 100,
    compression: str = "none",
) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row."""
    url = F.regexp_replace(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), "[\\r\\n]", "")
    raw = F.col(f"`{html_col}`")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(raw.cast("binary"), F.lit("").cast("binary")).alias("body"))
    base = base.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    base = base.withColumn("at", F.hex(F.xxhash64("url")))
    some = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "at"))
    copies = (
        base.where(F.col("size") >= min_revisit)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(some).alias("first"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    copies = cut(copies, "warc-copies")
    sizes = base.agg(F.avg("size").alias("mean"), F.max("size").alias("largest")).first()
    if sizes["mean"] is None:
        return
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = base.join(F.broadcast(copies), "digest", "left") if small else beside(base, copies, "digest", "at", "left")
    revisit = F.coalesce(F.col("first.page_id") != F.col("page_id"), F.col("first").isNotNull())
    capture = lambda page, at: F.concat(F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), at, F.lit(":"), F.substring("digest", 1, 16))
    rows = rows.withColumn("capture", capture(F.col("page_id"), F.col("at")))
    original = capture(F.col("first.page_id"), F.col("first.at"))
    name, digest = F.col("capture"), F.concat(F.lit("sha256:"), F.col("digest"))
    target, date = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))
    link = F.concat(F.lit("<urn:capture:"), name, F.lit(":"), F.when(revisit, "revisit").otherwise("response"), F.lit(">"))
    host = F.regexp_extract("url", "^[a-zA-Z]+://([^/]*)", 1)
    request = _record(
        "request", name,
        [target, date, ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)).cast("binary"),
    )
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n").cast("binary")
    kind = ("Content-Type", F.lit("application/http;msgtype=response"))
    response = _record("response", name, [target, date, ("WARC-Payload-Digest", digest), kind], F.concat(http, F.col("body")))
    again = _record(
        "revisit", name,
        [
            target, date, ("WARC-Payload-Digest", digest), kind,
            ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), original, F.lit(":response>"))),
        ],
        http,
    )
    about = _record(
        "metadata", name,
        [target, date, ("WARC-Concurrent-To", link), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload-length: "), F.col("size").cast("string"), F.lit("\r\n")).cast("binary"),
    )
    gap = F.lit(END).cast("binary")
    value = F.concat(request, gap, F.when(revisit, again).otherwise(response), gap, about).cast("string")
    def store(part: DataFrame, per_file: int, mode: str) -> None:
        out = part.select(value.alias("value")).write.mode(mode).option("lineSep", END).option("compression", compression)
        out.option("maxRecordsPerFile", per_file).text(path)

    # files hold FILE_BYTES on average; a page so large that a file of such could be huge has its own
    mean = float(sizes["mean"])
    large = max(1 << 16, int(LARGE * mean))
    store(rows.where(F.col("size") <= large), max(1, int(FILE_BYTES / (mean + 1500))), "errorifexists")
    if sizes["largest"] > large:
        store(rows.where(F.col("size") > large), 1, "append")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive (plain or gzipped)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.index(end, at)
        first, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = stop + len(end)
        length = int(headers["content-length"])
        if data[start + length : start + length + len(end)] != end:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield headers, data[start : start + length]
        at = start + length + len(end)


def _reader(keep_payload: bool):
    names = ["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "content_type", "payload_bytes", "payload_digest", "fields", "intact", "payload"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse(content.as_py()):
                    kind, told = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha256:")
                    payload = block.partition(END.encode())[2] if "application/http" in h.get("content-type", "") else block
                    digest = hashlib.sha256(payload).hexdigest()
                    full = kind != "revisit"
                    fields = dict(x.split(": ", 1) for x in payload.decode("utf-8", "replace").split("\r\n") if ": " in x) if kind == "metadata" else {}
                    rows.append((
                        h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("content-type"),
                        len(payload) if full else None, digest if full else told, list(fields.items()), not told or not full or told == digest,
                        payload if keep_payload and full else None,
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    return read


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record; ``intact`` is false where a digest does not fit its payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_reader(keep_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    Records whose capture lacks a response or revisit are left out; a missing request
    or metadata record is null; of several, the one with the smallest id is taken.
    """
    slim = F.struct("record_id", "target_uri", "content_type", "payload_bytes", "payload_digest", "fields", "intact", "payload")

    def side(kind: str) -> DataFrame:
        found = records.where(F.col("record_type") == kind).where("concurrent_to is not null")
        return found.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(slim, "record_id").alias(kind))

    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id", "record_type", "refers_to", "target_uri", "payload_digest", slim.alias("capture")
    )
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def unfounded(records: DataFrame) -> DataFrame:
    """refers_to and payload_digest of revisits without a response of that id and digest."""
    asked = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest")
    return asked.join(held, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives of ``pages``, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    try:
        records = cut(read_archives(spark, path, keep_payload=False), "warc-records")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        records = spark.createDataFrame([], RECORD)
    dangling = unfounded(records).limit(1).collect()
    if dangling:
        raise ValueError(f"a revisit's original is missing or has another digest: {dangling[0]['refers_to']}")
    rows = assemble(records)
    number = lambda c: F.expr(f"try_cast({c} as long)")
    torn = F.raise_error(F.concat(F.lit("a payload does not fit its digest: "), F.col("record_id"))).cast("long")
    told = number("metadata.fields['payload-length']")
    return rows.select(
        number("metadata.fields['page-id']").alias("page_id"),
        F.when(~F.col("capture.intact"), torn).when(F.col("record_type") == "revisit", told).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", number("regexp_extract(refers_to, 'capture:(-?[0-9]+):', 1)")).alias("refers_to"),
        "target_uri",
        F.col("capture.intact").alias("intact"),
    )
