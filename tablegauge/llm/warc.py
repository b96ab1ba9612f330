"""Write pages as WARC records and read archives back in parallel.

Writing: each part file of Spark's text writer is one uncompressed archive; a record is one row, its closing blank lines
are the line separator. Of records with equal payloads the one with the largest id is the
response, the others revisit it and carry no payload.

Reading: Spark's text reader cuts the archives at the record magic, in splits of any size. The magic may stand inside a
payload, so each cut is only a candidate record: it is real if a chain of record lengths leads to it from the
start of its file. Tasks emit the candidates of their split with the offset at which their chain leaves the
split; pointer jumping over those offsets finds where the true chain enters each split, doubling
its reach every round. A second scan follows each split's chain from there and holds one record at a time; a record
that crosses splits is put together from one piece per split.

Defined results: a null payload is empty; a record cut off by the end of its file is not returned, nor is anything after
a break in the chain; rows that repeat an id with the same payload are all responses if the id is the largest; rows without an id
are responses only if no row with their payload has one; line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.session import durable, shared_folder

MAGIC = b"WARC/1.0\r\n"
CLOSE = b"\r\n\r\n"
# Payloads that are surely alone stay out of the shuffle: a bitmap of this many bits marks the others.
BITS = 1 << 22
_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", re.I)


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add digest, bytes and refers_to (null for a response) to (page_id, url, payload)."""
    sized = pages.withColumn("digest", payload_digest("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    shared = (
        sized.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    shared = durable(shared)
    bit = F.pmod(F.xxhash64("digest"), F.lit(BITS)).cast("int")
    bits = np.zeros(BITS, bool)
    bits[shared.select(bit.alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True  # BITS numbers at most
    marked = F.pandas_udf(lambda s: pd.Series(bits[s.to_numpy()]), "boolean")
    flagged = sized.withColumn("marked", marked(bit))
    alone = flagged.where("not marked").withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    paired = flagged.where("marked").join(shared, ["digest", "bytes"], "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    columns = ["page_id", "url", "payload", "digest", "bytes"]
    return alone.select(*columns, "refers_to").union(paired.select(*columns, other.alias("refers_to")))


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """The text of a record up to its closing blank lines."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def urn(value: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))

    address = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    body = F.when(refers_to.isNull(), payload).otherwise(F.lit("").cast("binary"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(refers_to.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn(page_id)),
        line("WARC-Target-URI", address),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", urn(refers_to)),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), body).cast("string")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write (page_id, url, payload binary) as archives into a new folder."""
    rows = roles(pages, least_bytes)
    text = record(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers_to"))
    rows.select(text.alias("value")).write.option("lineSep", CLOSE.decode()).text(folder)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """What stands between magics, in file order within a split."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(folder)
    return lines.select(
        F.col("value").cast("binary").alias("value"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def record_bytes(segment: bytes) -> int | None:
    """Length of the record whose content after the magic starts the segment, magic and closing lines included."""
    end = segment.find(CLOSE)
    found = _LENGTH.search(segment[:end]) if end >= 0 else None
    return len(MAGIC) + end + 2 * len(CLOSE) + int(found[1]) if found else None


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split its bytes (offset null), and per candidate its offset and where its chain leaves the split."""
    last, at, offsets, nexts = None, 0, [], []

    def flush():
        size = at
        exits: dict[int, int] = {}
        for offset, follows in zip(reversed(offsets), reversed(nexts)):
            # a successor inside the split that is no candidate ends the chain there
            if follows is not None:
                exits[offset] = follows if follows + len(MAGIC) >= size else exits.get(follows, follows)
        rows = [(None, size), *exits.items()]
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([last[0]] * n, pa.int64()), pa.array([last[1]] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
            ["file", "block", "offset", "leaves"],
        )

    for batch in batches:
        for value, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            if (file, block) != last:
                if last is not None:
                    yield flush()
                last, at, offsets, nexts = (file, block), 0, [], []
            segment = value.as_buffer()
            if at or block:  # what stands before a file's first magic is no candidate
                length = record_bytes(segment.to_pybytes())
                offsets.append(at - len(MAGIC))
                nexts.append(at - len(MAGIC) + length if length is not None else None)
            at += len(segment) + len(MAGIC)
    if last is not None:
        yield flush()


def entries(segments: DataFrame) -> DataFrame:
    """(file, block, base, entry, closes): the split's first byte, the first true record that starts in it, the end of what it starts within.

    Offsets count from the file's start; a split's bytes begin after the magic that the split before it ends with.
    """
    found = durable(segments.mapInArrow(_chained, "file long, block long, offset long, leaves long"))
    by_file = Window.partitionBy("file").orderBy("block")
    # rows: as many as splits
    placed = found.where("offset is null").select(
        "file", "block", F.coalesce(F.sum("leaves").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    placed = durable(placed)
    chains = found.where("offset is not null").join(placed, ["file", "block"]).select(
        "file", "block", (F.col("base") + F.col("offset")).alias("offset"), (F.col("base") + F.col("leaves")).alias("leaves")
    )
    # only where a chain leaves a split can another be entered
    doors = chains.select("file", F.col("leaves").alias("offset")).distinct()
    starts = chains.where("offset = 0").select("file", "offset")
    jumps = durable(chains.join(doors.union(starts).distinct(), ["file", "offset"]).select("file", "block", "offset", "leaves"))
    where = jumps.select("file", "block", "offset")
    reached = durable(starts)
    count = reached.count()
    while True:
        hop = jumps.select("file", "offset", "leaves")
        reached = durable(
            reached.join(hop, ["file", "offset"]).select("file", F.col("leaves").alias("offset")).union(reached).distinct()
        )
        grown = reached.count()
        if grown == count:
            break
        count = grown
        further = hop.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("beyond"))
        # twice as far; a chain that ends keeps its last offset
        jumps = durable(
            jumps.join(further, ["file", "leaves"], "left").select("file", "block", "offset", F.coalesce("beyond", "leaves").alias("leaves"))
        )
    entered = where.join(reached, ["file", "offset"]).groupBy("file", "block").agg(F.min("offset").alias("entry"))
    ahead = by_file.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ends = reached.groupBy("file").agg(F.max("offset").alias("last"))
    rows = placed.join(entered, ["file", "block"], "left").join(ends, "file")
    return rows.select("file", "block", "base", "entry", F.coalesce(F.first("entry", True).over(ahead), "last").alias("closes"))


def _parsed(content: bytes, payload: bool) -> tuple:
    """Fields of a whole record, given from after its magic."""
    end = content.find(CLOSE)
    fields = {}
    for part in content[:end].decode("utf-8", "replace").split("\r\n"):
        name, _, value = part.partition(":")
        fields[name.strip().lower()] = value.strip()
    body = content[end + len(CLOSE) : -len(CLOSE)]

    def number(name):
        text = fields.get(name, "").rpartition(":")[2].rstrip(">")
        return int(text) if text.lstrip("-").isdigit() else None

    return (
        number("warc-record-id"),
        fields.get("warc-target-uri"),
        fields.get("warc-type"),
        number("warc-refers-to"),
        fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        base64.b32encode(hashlib.sha1(body).digest()).decode(),
        len(body),
        body if payload else None,
    )


_FIELDS = ("page_id", "url", "record_type", "refers_to", "stated_digest", "digest", "bytes", "payload")
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
_SCHEMA = "page_id long, url string, record_type string, refers_to long, stated_digest string, digest string, bytes long, payload binary"


def _table(rows: list[tuple], pieces: list[tuple]) -> pa.RecordBatch:
    rows = [r + (None, None, None, None) for r in rows] + [(None,) * len(_FIELDS) + p for p in pieces]
    names = [*_FIELDS, "file", "closes", "order", "piece"]
    types = [*_TYPES, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _followed(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    """Whole records of each split's chain, and the pieces of those that cross splits.

    A piece is keyed by the file and the offset at which its record ends, and ordered by its split. The magic after a
    split's last segment belongs to the record that is open there.
    """
    last, base, at, closes, due = None, 0, 0, None, None
    parts: list[bytes] | None = None
    lead: list[bytes] = []
    rows, pieces, held = [], [], 0

    def leave():
        if parts is not None:
            pieces.append((last[0], due, base, b"".join(parts) + MAGIC))
        elif lead and closes is not None:
            ends_here = at - len(MAGIC) == closes  # then the magic after it is the next record's
            pieces.append((last[0], closes, base, b"".join(lead) + (b"" if ends_here else MAGIC)))

    for batch in batches:
        info = [batch.column(c).to_pylist() for c in ("file", "block", "base", "entry", "closes")]
        for value, file, block, new_base, entry, new_closes in zip(batch.column("value"), *info):
            segment = value.as_py()
            if (file, block) != last:
                leave()
                last, base, at, closes, due = (file, block), new_base, new_base, new_closes, entry
                parts, lead, started = None, [], not block
            if due is not None and at - len(MAGIC) == due:
                if lead:
                    pieces.append((file, due, base, b"".join(lead)))
                length = record_bytes(segment)
                parts, lead, started = ([segment] if length else None), [], True
                due = due + length if length else None
            elif parts is not None:
                parts.append(MAGIC + segment)
            elif not started:
                lead.append(segment if at == base else MAGIC + segment)
            at += len(segment)
            if parts is not None and at >= due:
                content = b"".join(parts)
                rows.append(_parsed(content[: len(content) - (at - due)], payload))
                parts = None
            at += len(MAGIC)
            held += len(segment)
            if held > 4_000_000:
                yield _table(rows, pieces)
                rows, pieces, held = [], [], 0
    if last is not None:
        leave()
    yield _table(rows, pieces)


def _assembled(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            content = b"".join(p["piece"] for p in parts)
            if record_bytes(content) == len(content) + len(MAGIC) and content.endswith(CLOSE):
                rows.append(_parsed(content, payload))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], list(_FIELDS))


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, stated_digest, digest and bytes of the record's own payload, payload."""
    segments = _segments(spark, folder)
    # as many rows as input splits: a bounded broadcast, which also keeps the segments' order
    where = F.broadcast(durable(entries(segments)))
    schema = f"{_SCHEMA}, file long, closes long, order long, piece binary"
    followed = segments.join(where, ["file", "block"]).mapInArrow(lambda batches: _followed(batches, payload), schema)
    followed = durable(followed)
    whole = followed.where("piece is null").select(*_FIELDS)
    crossing = (
        followed.where("piece is not null")
        .groupBy("file", "closes")
        .agg(F.array_sort(F.collect_list(F.struct("order", "piece"))).alias("parts"))
        .select("parts")
        .mapInArrow(lambda batches: _assembled(batches, payload), _SCHEMA)
    )
    return whole.union(crossing)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page (page_id, url, html) and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A revisit's payload is that of the response it refers to, as read.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    write_archives(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")), folder, least_bytes)
    read = read_archives(spark, folder, payload=False)
    responses = (
        read.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("stated_digest"))
        .agg(F.max("bytes").alias("first_bytes"))
    )
    joined = read.join(responses, ["refers_to", "stated_digest"], "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.when(revisit, F.col("first_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )
