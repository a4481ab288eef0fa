"""WARC records and a Merkle fixity audit of two replicas of an archive.

A record is a WARC/1.0 resource record of a page. Records lie in archive files of RECORDS_PER_ARCHIVE ids, ordered by id. A leaf
of the tree stands for one record id: its number of records, bytes and digest. A node stands for an ordered
range of FANOUT neighbouring children, that is for a range of offsets, and hashes their positions, bytes and hashes in
order; the last level is one root. Replicas with equal roots are equal. Otherwise the audit descends: at each
level only the children of nodes that differ are compared, so the work below the first levels follows the
damage, not the archive. All levels are small tables in the shared folder.

Edge cases: null URLs and pages are empty strings; rows without an id are kept under id -1; several records of one
id form one leaf whose digest ignores their order (sums and xor, so a hot id needs no gathering); empty replicas give no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.tables import materialize

RECORDS_PER_ARCHIVE = 1_024
FANOUT = 64
#: How a record begins, and what follows it in a file.
#: The pages carry no date, so all records have the same one.
HEAD, TAIL = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:", "\r\n\r\n"
_ID, _LENGTH = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r\n"), re.compile(rb"\r\nContent-Length: (\d+)\r\n\r\n")


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    body = F.coalesce(html, F.lit(""))
    # A line break would end the header field.
    target = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(HEAD), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def records(pages: DataFrame) -> DataFrame:
    """(record_id, record) of each page."""
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(-1).cast("long"))
    return pages.select(key.alias("record_id"), record_text(key, F.col("url"), F.col("html")).alias("record"))


def archive_of(record_id: str = "record_id") -> Column:
    return F.floor(F.col(record_id) / RECORDS_PER_ARCHIVE).cast("long")


def write_warc(rows: DataFrame, path: str) -> None:
    """One folder per archive below path; its part files, in name order, are the records byte by byte, each followed by TAIL."""
    (
        rows.withColumn("archive", archive_of()).repartitionByRange("archive", "record_id").sortWithinPartitions("archive", "record_id")
        .select("archive", "record").write.partitionBy("archive").option("lineSep", TAIL).option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path))


def parse(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(record_id, record) of one file; where a record ends is told by its Content-Length, not by what its page holds."""
    at = 0
    while at < len(data):
        length = _LENGTH.search(data, at)
        name = _ID.search(data, at)
        if length is None or name is None or name.start() > length.start():
            raise ValueError(f"no record at byte {at}")
        end = length.end() + int(length[1])
        if end > len(data):
            raise ValueError(f"record at byte {at} ends beyond the file")
        yield int(name[1]), data[at:end]
        at = end + len(TAIL)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record) of WARC files written as above; one task reads a file of at most RECORDS_PER_ARCHIVE records as a whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = list(parse(content.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in found], pa.int64()), pa.array([r.decode() for _, r in found], pa.string())], ["record_id", "record"])

    return files.mapInArrow(run, "record_id long, record string")


def leaves(rows: DataFrame) -> DataFrame:
    """(node, n, bytes, hash) per record id, from rows (record_id, record); combinable, no group is gathered."""
    digest = F.sha2("record", 256)

    def piece(at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")

    parts = rows.select("record_id", F.octet_length("record").cast("long").alias("bytes"), *[piece(8 * i + 1).alias(f"d{i}") for i in range(8)])
    folded = [f(F.col(f"d{i}")).alias(f"{f.__name__}{i}") for i in range(8) for f in (F.sum, F.bit_xor)]
    summed = parts.groupBy("record_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *folded)
    names = [f"{f}{i}" for i in range(8) for f in ("sum", "bit_xor")]
    return summed.select(F.col("record_id").alias("node"), "n", "bytes", F.sha2(F.concat_ws(",", "n", "bytes", *names), 256).alias("hash"))


def _parents(level: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("node", "bytes", "hash")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["node"].cast("string"), x["bytes"].cast("string"), x["hash"])), ";")
    return level.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(text, 256).alias("hash"))


def trees(left: DataFrame, right: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Levels of both trees, leaves first; the last level has one node on each side, or none.

    A node has at most FANOUT children, so no list grows.
    """
    levels = [(materialize(leaves(left)), materialize(leaves(right)))]
    while True:
        spread = levels[-1][0].select("node").unionByName(levels[-1][1].select("node")).agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
        # Ids -1 and 0 never share a parent under floor division; their paths end at -1 and 0.
        if spread["a"] is None or spread["a"] == spread["b"] or (spread["a"], spread["b"]) == (-1, 0):
            return levels
        levels.append(tuple(materialize(_parents(x)) for x in levels[-1]))


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("node", *[F.col(c).alias(f"l_{c}") for c in ("n", "bytes", "hash")])
    b = right.select("node", *[F.col(c).alias(f"r_{c}") for c in ("n", "bytes", "hash")])
    return a.join(b, "node", "full").filter(~F.col("l_hash").eqNullSafe(F.col("r_hash")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(record_id, archive, offset, bytes, replica_bytes, kind) of each leaf that differs.

    kind: changed, missing (not in the right replica) or extra (only there). offset and bytes are where the left replica
    holds the record in its archive, as ``write_warc`` lays it out (its files one after the other); null for extra ones.
    """
    levels = trees(left, right)
    marked = None
    for a, b in reversed(levels):
        if marked is not None:
            inside = marked.select(F.col("node").alias("_up"))
            a, b = (x.join(inside, F.floor(F.col("node") / FANOUT).cast("long") == F.col("_up"), "left_semi") for x in (a, b))
        marked = _differing(a, b)
        if (a, b) != levels[0]:
            marked = materialize(marked)
            if marked.isEmpty():
                break
    line = Window.partitionBy("archive").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    damaged = marked.withColumn("archive", F.floor(F.col("node") / RECORDS_PER_ARCHIVE).cast("long"))
    touched = damaged.select("archive").distinct()
    places = (
        levels[0][0].withColumn("archive", F.floor(F.col("node") / RECORDS_PER_ARCHIVE).cast("long")).join(touched, "archive", "left_semi")
        .select("node", F.coalesce(F.sum(F.col("bytes") + len(TAIL) * F.col("n")).over(line), F.lit(0)).alias("offset")))
    kind = F.when(F.col("r_hash").isNull(), "missing").when(F.col("l_hash").isNull(), "extra").otherwise("changed")
    return damaged.join(places, "node", "left").select(
        F.col("node").alias("record_id"), "archive", "offset", F.col("l_bytes").alias("bytes"), F.col("r_bytes").alias("replica_bytes"), kind.alias("kind"))


def damaged_copy(rows: DataFrame, seed: str = "fixity-1") -> DataFrame:
    """A replica with seeded faults in about 8 of 256 records: two each of a changed byte, a cut tail, a lost and a doubled record."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("record_id").cast("string"))), 1, 2), 16, 10).cast("int")
    flipped = F.concat(F.lit("X"), F.expr("substring(record, 2)"))
    cut = F.expr("substring(record, 1, length(record) - 9)")
    faulty = rows.withColumn("record", F.when(draw < 2, flipped).when(draw < 4, cut).otherwise(F.col("record")))
    times = F.when((draw >= 4) & (draw < 6), 0).when((draw >= 6) & (draw < 8), 2).otherwise(1)
    return faulty.select("record_id", "record", F.explode(F.array_repeat(F.lit(1), times)).alias("_")).select("record_id", "record")
