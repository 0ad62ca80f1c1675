"""Merkle fixity audit of WARC archives.

A replica is a table of records (archive, offset, payload): the bytes of each
record and where it starts in its archive.  Records are hashed, and the hashes
of ordered offset ranges are hashed again, ``fanout`` children to a node, up
to the root of each archive; ranges of archives are joined the same way up to
one root of the replica.  An audit compares the roots and goes down only from
nodes that differ, so equal branches are never opened, and ends at the records
that differ.

The nodes of a level are one table; a level is aggregated from the one below
by (archive, range), so no task holds more than a node's children.  Below the
record, nothing of the payload is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written
from .text import BATCH_BYTES, bounded_batches, likely, table


@dataclass
class Replica:
    """``levels[0]`` has the records (archive, node, offset, length, hash); the others the nodes (archive, node, hash) above."""

    levels: list[DataFrame]
    archive_levels: int
    root: str


def _above(below: DataFrame, archive: Column, node: Column) -> DataFrame:
    """One level up: nodes hash their children's places and hashes in order."""
    child = F.struct(F.col("archive").alias("a"), F.col("node").alias("n"), F.col("hash").alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_fx_child")), lambda c: F.concat_ws(":", c["a"], c["n"], c["h"])), ";")
    return below.select(archive.alias("archive"), node.alias("node"), child.alias("_fx_child")).groupBy("archive", "node").agg(F.sha2(text, 256).alias("hash"))


def leaves(records: DataFrame) -> DataFrame:
    """Records (archive, offset, payload) hashed: (archive, node, length, hash), node being the offset.

    Records that come with ``length`` and ``hash`` (sha256, hexadecimal) need
    no payload.  A null payload counts as a record of no bytes whose hash is
    that of the empty string; a null archive or offset counts as 0.  Records
    that start at the same place, however many, are hashed together without
    regard to their order: by their number and the sums of the four quarters
    of their hashes, so they are never gathered.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    if {"length", "hash"} <= set(records.columns):
        length, hash_ = zero("length"), F.col("hash")
    else:
        length, hash_ = F.coalesce(F.length("payload"), F.lit(0)).cast("long"), F.sha2(F.coalesce("payload", F.lit(b"")), 256)
    rows = records.select(zero("archive").alias("archive"), zero("offset").alias("node"), length.alias("length"), hash_.alias("hash"))
    quarters = [F.sum(F.conv(F.substring("hash", i, 16), 16, 10).cast("decimal(20,0)")) for i in (1, 17, 33, 49)]
    several = F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[q.cast("string") for q in quarters]), 256)
    one = F.when(F.count(F.lit(1)) == 1, F.min("hash")).otherwise(several)
    return written(rows.groupBy("archive", "node").agg(F.sum("length").alias("length"), one.alias("hash")), "fixity-records")


def tree(leaf: DataFrame, span: int = 1 << 16, fanout: int = 16, tall: tuple[int, int] | None = None) -> Replica:
    """The tree over :func:`leaves`; its lowest nodes cover ``span`` bytes of an archive each.

    ``tall`` has the levels within an archive and over the archives, by
    default as many as it takes; replicas that are compared need the same.
    """
    ranges, archives = heights(leaf, span=span, fanout=fanout) if tall is None else tall
    levels = [leaf, written(_above(leaf, F.col("archive"), F.expr(f"node div {span}")), "fixity-ranges")]
    for _ in range(ranges):
        levels.append(written(_above(levels[-1], F.col("archive"), F.expr(f"node div {fanout}")), "fixity-ranges"))
    for _ in range(archives):
        levels.append(written(_above(levels[-1], F.expr(f"archive div {fanout}"), F.lit(0).cast("long")), "fixity-archives"))
    top = levels[-1].first()
    return Replica(levels, archives, top["hash"] if top else "")


def heights(*leaves: DataFrame, span: int, fanout: int) -> tuple[int, int]:
    """Levels that lead to one node for each archive, and from there to one root, for all of the replicas."""
    far = last = 0
    for leaf in leaves:
        got = leaf.agg(F.max("node"), F.max("archive")).first()
        far, last = max(far, (got[0] or 0) // span), max(last, got[1] or 0)
    steps = lambda n: 0 if n == 0 else 1 + steps(n // fanout)
    return steps(far), steps(last)


def audit(a: DataFrame, b: DataFrame, span: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """The records in which two replicas differ: archive, offset, length_a, length_b, hash_a, hash_b and status.

    status is ``changed``, or ``missing`` (from b) or ``extra`` (in b).  Equal
    replicas, empty ones too, give no rows.
    """
    spark = a.sparkSession
    empty = "archive long, offset long, length_a long, length_b long, hash_a string, hash_b string, status string"
    own = [leaves(r) for r in (a, b)]
    tall = heights(*own, span=span, fanout=fanout)
    left, right = (tree(r, span, fanout, tall) for r in own)
    if left.root == right.root:
        return spark.createDataFrame([], empty)
    wrong: DataFrame | None = None
    for i in range(len(left.levels) - 1, -1, -1):
        x, y = left.levels[i], right.levels[i]
        if wrong is not None:
            # only the children of nodes that differ
            above = len(left.levels) - left.archive_levels
            if i + 1 >= above:
                up = (F.expr(f"archive div {fanout}"), F.lit(0).cast("long"))
            else:
                up = (F.col("archive"), F.expr(f"node div {span if i == 0 else fanout}"))
            keys = wrong.select(F.col("archive").alias("_fx_a"), F.col("node").alias("_fx_n"))
            x, y = (d.join(keys, (up[0] == F.col("_fx_a")) & (up[1] == F.col("_fx_n")), "left_semi") for d in (x, y))
        name = lambda d, s: d.select("archive", "node", *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in ("archive", "node")])
        wrong = name(x, "a").join(name(y, "b"), ["archive", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if i:
            wrong = written(wrong.select("archive", "node"), "fixity-differs")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return wrong.select("archive", F.col("node").alias("offset"), "length_a", "length_b", "hash_a", "hash_b", status.alias("status"))


def _rendered(pages: DataFrame, per_archive: int) -> DataFrame:
    """(page_id, archive, payload) of pages as WARC response records."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    page = F.coalesce(F.col("page_id"), F.lit(0)).cast("long")
    body = text("html").cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page.cast("string"), F.lit(">\r\nWARC-Target-URI: "), text("url"), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(page.alias("page_id"), F.floor(page / per_archive).cast("long").alias("archive"), F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("payload"))


def _offset(length: Column, *by: str) -> Column:
    """Where a record starts in its archive."""
    order = Window.partitionBy("archive").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(order), F.lit(0)).cast("long")


def warc_records(pages: DataFrame, per_archive: int = 512) -> DataFrame:
    """Pages (page_id, url, html) as WARC response records (archive, offset, page_id, payload), for writing.

    Pages go to archives of ``per_archive`` ids each and follow each other by
    id (then url and html).  A null url or html counts as empty, a null id as 0.
    """
    rows = _rendered(pages, per_archive)
    return rows.withColumn("offset", _offset(F.length("payload"), "page_id", "payload")).select("archive", "offset", "page_id", "payload")


def replicas(pages: DataFrame, damage: Callable[[Column, Column], Column], lost: Column, per_archive: int = 512) -> tuple[DataFrame, DataFrame]:
    """The records of :func:`warc_records` hashed (archive, offset, length, hash), as they are and in a replica with damage.

    Payloads are hashed where they are read, so none is shuffled, but those of
    pages with a repeated id, whose order they decide.
    """
    rows = _rendered(pages, per_archive)
    several = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id")
    sha = lambda c: F.sha2(c, 256)
    hit, rest = likely(rows, ["page_id"], several, ["page_id"])
    narrow = lambda r, tie: r.select("page_id", "archive", tie.cast("binary").alias("_fx_tie"), F.length("payload").cast("long").alias("length"), sha(F.col("payload")).alias("a"), sha(damage(F.col("page_id"), F.col("payload"))).alias("b"))
    narrow = narrow(hit, F.col("payload")).unionByName(narrow(rest, F.lit(None)))
    placed = written(narrow.withColumn("offset", _offset(F.col("length"), "page_id", "_fx_tie")).select("page_id", "archive", "offset", "length", "a", "b"), "fixity-placed")
    return placed.select("archive", "offset", "length", F.col("a").alias("hash")), placed.where(~lost).select("archive", "offset", "length", F.col("b").alias("hash"))


def _unpacked(raw: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in bounded pieces; gzip, one member after another, is inflated."""
    if raw[:2] != b"\x1f\x8b":
        for i in range(0, len(raw), piece):
            yield raw[i : i + piece]
        return
    view = memoryview(raw)
    while view[:2] == b"\x1f\x8b":
        stream, at = zlib.decompressobj(31), 0
        while not stream.eof and at < len(view):
            rest = view[at : at + piece]
            at += len(rest)
            while True:
                yield stream.decompress(rest, piece)
                rest = stream.unconsumed_tail
                if not rest:
                    break
        view = view[at - len(stream.unused_data) :] if stream.eof else view[:0]


def records_of(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a WARC file, offsets in the uncompressed file; a record without its end is taken as far as it goes."""
    buffer, start, pieces = bytearray(), 0, _unpacked(raw)

    def more() -> bool:
        part = next(pieces, None)
        buffer.extend(part or b"")
        return part is not None

    while buffer or more():
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(buffer) - 3)
            if not more():
                break
        if end < 0:
            stop = len(buffer)
        else:
            sizes = [int(x.split(b":")[1]) for x in bytes(buffer[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()]
            stop = end + 4 + (sizes[0] if sizes else 0) + 4
            while len(buffer) < stop and more():
                pass
            stop = min(stop, len(buffer))
        if stop:
            yield start, bytes(buffer[:stop])
        del buffer[:stop]
        start += stop


def read_warc(spark: SparkSession, paths: dict[int, str] | list[str]) -> DataFrame:
    """WARC files, plain or gzip, one archive number each, as records (archive, offset, payload).

    A file is one row of Spark's binary reader, so 2 GB compressed is its
    limit; inflated it may be larger, and records leave in bounded batches.
    """
    numbered = paths if isinstance(paths, dict) else dict(enumerate(paths))
    bounded_batches(spark)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for number, raw in zip(df["archive"], df["content"], strict=True):
                rows, size = [], 0
                for at, record in records_of(raw):
                    rows.append((number, at, record))
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["archive", "offset", "payload"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["archive", "offset", "payload"])

    found = None
    for number, path in numbered.items():
        df = spark.read.format("binaryFile").load(path).select(F.lit(number).cast("long").alias("archive"), "content")
        found = df if found is None else found.unionByName(df)
    schema = "archive long, offset long, payload binary"
    return spark.createDataFrame([], schema) if found is None else found.mapInPandas(split, schema)


def hurt(page_id: Column, payload: Column) -> Column:
    """The query's damage: one byte is overwritten in every record whose page_id leaves 13 on division by 97."""
    return F.when(page_id % 97 == 13, F.overlay(payload, F.lit(b"\x00"), F.lit(6), F.lit(1))).otherwise(payload)


def result(spark, sf_dir: str) -> DataFrame:
    """The pages as WARC records against a replica with damage (:func:`hurt`) and without those whose page_id leaves 14 on division by 389."""
    return audit(*replicas(table(spark, sf_dir, "pages"), hurt, F.col("page_id") % 389 == 14))


#: The same audit without a tree: every record of one replica against the other.
ORACLE = """
WITH body AS (
  SELECT coalesce(page_id, 0) AS page_id, coalesce(page_id, 0) // 512 AS archive, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(page_id, 0) || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS payload
  FROM pages),
placed AS (
  SELECT page_id, archive, payload, octet_length(payload) AS length,
    coalesce(sum(octet_length(payload)) OVER (PARTITION BY archive ORDER BY page_id, payload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
  FROM body)
SELECT CAST(archive AS BIGINT) AS archive, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length_a,
  CASE WHEN page_id % 389 <> 14 THEN CAST(length AS BIGINT) END AS length_b, sha256(payload) AS hash_a,
  CASE WHEN page_id % 389 <> 14 THEN sha256(payload[1:5] || '\\x00'::BLOB || payload[7:]) END AS hash_b,
  CASE WHEN page_id % 389 = 14 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE page_id % 97 = 13 OR page_id % 389 = 14
"""
