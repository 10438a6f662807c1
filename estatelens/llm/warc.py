"""A deterministic sharded writer of WARC archives, and their reader."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import running, whole_text, with_row_id
from estatelens.session import scratch_path, settle

LEAST_BYTES = 1000  # of payloads that are stored once
SHARD_BYTES = 64 << 20  # of payload that one task writes
ROLL_BYTES = 16 << 20  # compressed size from which a file is closed
DATE = "2024-01-01T00:00:00Z"  # of every record, so that reruns write the same bytes
LEVEL = 6
MOST_SHARDS = 20_000  # whose first keys every task holds
MOST_TASKS = 50_000  # that read files; with more files a task reads several

MANIFEST = "file string, shard long, part int, records long, bytes long, sha256 string"


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, by its URI."""
    return arrow_fs.FileSystem.from_uri(path if re.match(r"[a-zA-Z][\w+.-]*:", path) else f"file://{os.path.abspath(path)}")


def record_id(kind: str, page_id: str | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{digest}/{nth}')}>"


def record(page_id: str | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, refers_url: str | None, nth: int) -> bytes:
    """One record: a response with its payload, or without one a revisit with the HTTP headers only.

    A response's length and digests are taken from its payload; ``size`` and ``digest`` are
    those of the payload that a revisit refers to.
    """
    if payload is not None:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    kind = "revisit" if payload is None else "response"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page_id, digest, nth)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id('response', refers_to, digest, 0)}", f"WARC-Refers-To-Target-URI: {header_value(refers_url)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_value(value: str | None) -> str:
    """A value without line breaks, which would end the header; null is empty."""
    return re.sub(r"[\r\n]+", " ", value or "")


def packed(data: bytes, level: int = LEVEL) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=level, mtime=0) as z:
        z.write(data)
    return out.getvalue()


def place_of(page_id: str | int | None, digest: bytes, file: str, row: int) -> tuple:
    """The sort key of a row, null ids first."""
    return (page_id is not None, int(page_id or 0), bytes(digest), file, int(row))


def responses(begins, page_id: Column, url: str, html: Column) -> Column:
    """Each row as a packed response record, with its digest and its shard among those that begin at ``begins``."""

    @F.pandas_udf("member binary, digest binary, shard long")
    def each(ids: pd.Series, urls: pd.Series, pages: pd.Series, files: pd.Series, rows: pd.Series) -> pd.DataFrame:
        out, starts = [], begins.value
        blank = lambda v: None if pd.isna(v) else v
        for p, u, h, f, r in zip(ids, urls, pages, files, rows):
            payload = h.encode("utf-8")
            digest = hashlib.sha1(payload).digest()
            shard = starts[bisect_right(starts, place_of(blank(p), digest, f, r), key=lambda s: s[0]) - 1][1]
            out.append((packed(record(blank(p), blank(u), payload, 0, "", None, None, 0)), digest, shard))
        return pd.DataFrame(out, columns=["member", "digest", "shard"])

    return each(page_id, url, html, "__file", "__row")


def written(rows: Iterator[dict], folder: str, roll: int) -> Iterator[tuple]:
    """Write a shard's sorted records and give a manifest row for each file.

    Each record is a gzip member of its own. A file is written under a name that no other
    attempt has and moved to its final name when it is whole, so a repeated task replaces
    files by equal ones. A file is closed when its compressed size reaches ``roll``.
    """
    system, root = opened(folder)
    out, digest, state = None, None, {}

    def close():
        out.close()
        name = f"part-{state['shard']:08d}-{state['part']:05d}.warc.gz"
        system.move(state["temporary"], f"{root}/{name}")
        return name, state["shard"], state["part"], state["records"], state["bytes"], digest.hexdigest()

    seen = {"key": None, "nth": 0}
    for row in rows:
        if out is not None and row["_shard"] != state["shard"]:
            yield close()
            out, state = None, {}
        if out is None:
            part = state["part"] + 1 if state else 0
            state = {"shard": row["_shard"], "part": part, "records": 0, "bytes": 0, "temporary": f"{root}/.tmp-{uuid.uuid4().hex}"}
            digest = hashlib.sha256()
            out = system.open_output_stream(state["temporary"], compression=None)
        key = (row["_page_id"], row["_digest"], row["_type"])
        seen = {"key": key, "nth": seen["nth"] + 1 if seen["key"] == key else 0}
        data = row["member"]
        if data is None:
            data = packed(record(row["_page_id"], row["url"], None, int(row["_size"]), bytes(row["_digest"]).hex(), row["_refers_to"], row["_refers_url"], seen["nth"]))
        elif seen["nth"]:  # a repeated row is a record of its own, with an id of its own
            payload = gzip.decompress(data).split(b"\r\n\r\n", 2)[2][:-4]
            data = packed(record(row["_page_id"], row["url"], payload, 0, "", None, None, seen["nth"]))
        out.write(data)
        digest.update(data)
        state["records"] += 1
        state["bytes"] += len(data)
        if state["bytes"] >= roll:
            yield close()
            out = None
    if out is not None:
        yield close()


def plan(pages: DataFrame, least: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What becomes of each row: its shard, its type and the record it refers to.

    Payloads are equal if their SHA-1 and length are. Of equal payloads of ``least`` bytes
    or more, the row with the largest page_id (null ids last; of equal ids the first row)
    is the response. Rows are sorted by page_id and digest over the whole table, and a new
    shard begins each ``shard_bytes`` of payload, so shards depend on the rows alone. Beyond
    about MOST_SHARDS shards these are larger instead.
    """
    html = whole_text("html")
    rows = settle(pages.select(
        F.col("page_id").alias("_page_id"), F.unhex(F.sha1(html.cast("binary"))).alias("_digest"),
        F.octet_length(html).cast("long").alias("_size"), F.col("url").alias("_url"), "__file", "__row"))
    total = rows.agg(F.sum(F.greatest("_size", F.lit(256)))).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    big = F.col("_size") >= least
    # larger ids first, then the earlier row: the least of complemented ids, null ids last
    order = F.struct(F.col("_page_id").isNull().alias("z"), F.bitwise_not("_page_id").alias("i"), F.col("__file").alias("f"), F.col("__row").alias("r"), F.col("_url").alias("u"))
    kept = rows.where(big).groupBy("_digest", "_size").agg(F.min(order).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    marked = rows.drop("_url").join(kept.select("_digest", "_size", "_best"), ["_digest", "_size"], "left")
    is_best = (F.col("_best.f") == F.col("__file")) & (F.col("_best.r") == F.col("__row"))
    revisit = F.col("_best").isNotNull() & ~is_best
    marked = marked.select(
        "__file", "__row", "_page_id", "_digest", "_size", F.when(revisit, "revisit").otherwise("response").alias("_type"),
        F.when(revisit, F.bitwise_not("_best.i")).alias("_refers_to"), F.when(revisit, F.col("_best.u")).alias("_refers_url"),
        F.greatest("_size", F.lit(256)).cast("long").alias("_stored"))
    placed = running(marked, ["_page_id", "_digest", "__file", "__row"], {"_before": "_stored"})
    # a record counts 256 bytes at least, so a shard also has a bounded number of records
    shard = F.expr(f"_before div {shard_bytes}L")
    return settle(placed.withColumn("_shard", shard).drop("_before", "_stored", "_n"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES, roll: int = ROLL_BYTES) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a record into archives in ``folder``; gives the manifest.

    Null html is an empty payload. A shard is written by one task in the order of page_id;
    the same rows give the same files, byte for byte. The manifest is written last, as
    Parquet in ``folder``/manifest: files it does not list are no part of the archive.
    """
    spark = pages.sparkSession
    named = with_row_id(pages.select("page_id", "url", "html")).select("row.*", "__file", "__row")
    steps = plan(named, least, shard_bytes)
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    # what each shard begins with, as every task's map from rows to shards
    key = F.struct("_page_id", "_digest", "__file", "__row")
    firsts = steps.groupBy("_shard").agg(F.min(key).alias("k")).orderBy("_shard").collect()
    begins = spark.sparkContext.broadcast([(place_of(*r["k"]), r["_shard"]) for r in firsts])
    # records are packed before they move, and move once: a row's plan comes just before its record
    made = named.select(
        F.col("page_id").alias("_page_id"), "url", "__file", "__row", F.lit(1).alias("_side"),
        responses(begins, F.col("page_id").cast("string"), "url", whole_text("html")).alias("_r"))
    made = made.select("*", F.col("_r.digest").alias("_digest"), F.col("_r.shard").alias("_shard"), F.col("_r.member").alias("member")).drop("_r")
    rows = made.unionByName(steps.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    n_shards = firsts[-1]["_shard"] + 1 if firsts else 1
    rows = rows.repartitionById(n_shards, F.col("_shard").cast("int")).sortWithinPartitions("_page_id", "_digest", "__file", "__row", "_side")
    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  pandas has no whole numbers beside nulls
    rows = rows.select("_side", text("_page_id"), "url", "member", "_digest", "_shard", "_type", text("_size"), text("_refers_to"), "_refers_url")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            known = {}
            for part in parts:
                for values in zip(*(part[c] for c in part.columns)):
                    row = {k: None if pd.isna(v) else v for k, v in zip(part.columns, values)}
                    if row["_side"] == 0:
                        known = row
                    else:
                        yield known | {"url": row["url"], "member": row["member"] if known["_type"] == "response" else None}

        for line in written(each(), folder, roll):
            yield pd.DataFrame([line], columns=["file", "shard", "part", "records", "bytes", "sha256"])

    rows.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    place = 0
    while place < len(data):
        unpack = zlib.decompressobj(wbits=31)
        member = unpack.decompress(data[place:place + (64 << 10)])
        used = 64 << 10
        while not unpack.eof and place + used < len(data):
            member += unpack.decompress(data[place + used:place + used + (1 << 20)])
            used += 1 << 20
        place = min(len(data), place + used) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError("an archive ends within a record")
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        yield headers, rest[:int(headers["content-length"])]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest in ``folder`` lists, each digest checked.

    A revisit has no payload of its own: its digest and length are those of the record it
    refers to. Without ``payloads`` the payload column is null.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "sha256")
    n = min(max(1, manifest.count()), MOST_TASKS)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = opened(folder)
        for part in parts:
            for name, sha256 in zip(part["file"], part["sha256"]):
                with system.open_input_stream(f"{root}/{name}", compression=None) as source:
                    data = source.read()
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{name} is not what the manifest lists")
                rows = []
                for headers, block in records(data):
                    if f"sha1:{hashlib.sha1(block).hexdigest()}" != headers["warc-block-digest"]:
                        raise ValueError(f"{name}: a block is damaged")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: a payload is damaged")
                    number = lambda k: int(headers[k]) if k in headers else None
                    rows.append((number("x-page-id"), length, digest, headers["warc-type"], number("x-refers-to-page-id"),
                                 headers.get("warc-target-uri"), payload if payloads and not revisit else None))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pd.DataFrame(rows, columns=names, dtype=object).astype({"page_id": "Int64", "refers_to": "Int64"})

    return manifest.repartition(n).mapInPandas(read, READ)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    ``folder`` must be empty or absent; by default a new one in the shared folder is used.
    Null page ids are written without an id and read as null; repeated rows are records of
    their own, one of which is the response if they are large enough.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder, payloads=False).drop("url", "payload")


ARCHIVED_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes)
"""
