"""Fixity audit of web archives by Merkle trees.

Pages become WARC records, and records, in order, files. Every record is hashed; hashes of
sixteen neighbours, with the range of offsets they cover, are hashed again, and so on up to one root per file. Two
replicas of an archive are compared root against root, and only below roots that differ
child against child, down to the records that changed or are gone.

The tree of a replica is built over the offsets of the archive's manifest, so one lost record does not
shift all others. Rows are grouped by file and node; a node has sixteen children, so no group grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headroom.session import settle

RECORDS_PER_FILE = 1024
FANOUT = 16
END = "\r\n\r\n"
GONE = "gone"  # in place of the hash of a record that a replica lacks


def record_text() -> Column:
    """A page as a WARC record without the four bytes that end it; nulls are empty."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(END),
    )
    return F.concat(head, html)


def archive(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """``page_id, file, number, offset, length, record`` of every page.

    Pages with neighbouring ids share a file, in the order of id and record; equal rows are records of their
    own, and those without an id are in file -1. Rows of an id that alone would overfill a file are
    spread by hash over files with smaller numbers, as many as they fill.
    """
    rows = pages.select("page_id", record_text().alias("record"), F.monotonically_increasing_id().alias("row"))
    crowded = settle(pages.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > per_file))
    files = -(-(crowded.agg(F.sum("n")).first()[0] or 0) // per_file)
    file = F.coalesce(F.floor(F.col("page_id") / F.lit(per_file)), F.lit(-1)).cast("long")
    if files:
        known = crowded.select(F.col("page_id").alias("crowded_id"), F.lit(True).alias("crowded"))
        rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("crowded_id")), "left")
        file = F.when(F.col("crowded"), F.lit(-2) - F.pmod(F.xxhash64("row"), F.lit(files))).otherwise(file)
    in_file = Window.partitionBy("file").orderBy("page_id", "record")
    length = F.octet_length("record") + F.lit(len(END))
    placed = rows.withColumn("file", file).withColumn("length", length.cast("long"))
    before = F.sum("length").over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(
        "page_id",
        "file",
        (F.row_number().over(in_file) - 1).cast("long").alias("number"),
        F.coalesce(before, F.lit(0)).cast("long").alias("offset"),
        "length",
        "record",
    )


def leaves(records: DataFrame) -> DataFrame:
    """``file, number, offset, length, digest``: the lowest level, without the records."""
    return records.select("file", "number", "offset", "length", F.sha2("record", 256).alias("digest"))


def _parents(level: DataFrame) -> DataFrame:
    children = F.sort_array(F.collect_list(F.struct("number", "offset", "length", "digest")))
    grouped = level.groupBy("file", F.floor(F.col("number") / FANOUT).cast("long").alias("node")).agg(children.alias("c"))
    first, last = F.get("c", F.lit(0)), F.get("c", F.size("c") - 1)
    length = last["offset"] + last["length"] - first["offset"]
    digests = F.array_join(F.transform("c", lambda c: c["digest"]), ",")
    text = F.concat_ws(":", first["offset"].cast("string"), length.cast("string"), digests)
    return grouped.select(
        "file", F.col("node").alias("number"), first["offset"].alias("offset"), length.alias("length"), F.sha2(text, 256).alias("digest")
    )


def tree(lowest: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to one root per file, each written once.

    The number of levels follows from the largest file; a root that is reached early is hashed
    once more per level above, so all files end on the same one.
    """
    levels = [settle(lowest)]
    largest = levels[0].agg(F.max("number")).first()[0] or 0
    while largest > 0 or len(levels) == 1:
        levels.append(settle(_parents(levels[-1])))
        largest //= FANOUT
    return levels


def replica_leaves(manifest: DataFrame, replica: DataFrame) -> DataFrame:
    """The replica's hashes at the manifest's offsets."""
    found = replica.select("file", "offset", F.sha2("record", 256).alias("found"))
    joined = manifest.select("file", "number", "offset", "length").join(found, ["file", "offset"], "left")
    return joined.select("file", "number", "offset", "length", F.coalesce("found", F.lit(GONE)).alias("digest"))


def compare(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """``file, number, offset, state`` of the records that differ: ``changed`` or ``gone``.

    Both trees cover the same manifest. Below the roots only children of nodes that differ are read
    into a comparison.
    """
    wrong = None
    for mine, other in zip(reversed(ours), reversed(theirs)):
        if wrong is not None:
            parent = F.floor(F.col("number") / FANOUT).cast("long")
            keep = wrong.select("file", F.col("number").alias("parent"))
            mine, other = (
                side.withColumn("parent", parent).join(keep, ["file", "parent"], "left_semi").drop("parent") for side in (mine, other)
            )
        other = other.select("file", "number", F.col("digest").alias("other"))
        wrong = settle(mine.join(other, ["file", "number"]).where("digest != other"))
    state = F.when(F.col("other") == GONE, GONE).otherwise("changed")
    return wrong.select("file", "number", "offset", state.alias("state"))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record with its place, hash, the roots of its file on both sides, and its ``state``.

    ``records`` and ``replica`` have ``file, offset, record``, ``records`` also ``page_id, number, length``.
    States are ``same``, ``changed`` and ``gone``; records that only the replica has are not in
    the manifest and not judged.
    """
    kept = settle(records.select("page_id", "file", "number", "offset", "length", F.sha2("record", 256).alias("digest")))
    ours = tree(kept.drop("page_id"))
    theirs = tree(replica_leaves(ours[0], replica))
    wrong = compare(ours, theirs).select("file", "number", "state")
    roots = ours[-1].select("file", F.col("digest").alias("root"))
    roots = roots.join(theirs[-1].select("file", F.col("digest").alias("replica_root")), "file")
    found = kept.join(roots, "file").join(wrong, ["file", "number"], "left")
    return found.select(
        "page_id", "file", "offset", "length", "digest", "root", "replica_root", F.coalesce("state", F.lit("same")).alias("state")
    )


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, to audit against: of every 101 ids one has lost its record's last
    letter to a question mark, and of every 103 one is gone."""
    kept = records.where("page_id IS NULL OR page_id % 103 != 7")
    spoiled = F.concat(F.expr("left(record, length(record) - 1)"), F.lit("?"))
    return kept.withColumn("record", F.when(F.col("page_id") % 101 == 5, spoiled).otherwise(F.col("record")))


def write_files(records: DataFrame, path: str) -> None:
    """WARC files, one folder per file number; the text writer ends each record with its four bytes."""
    ordered = records.select("file", "number", "record").repartition("file").sortWithinPartitions("file", "number")
    ordered.select("file", F.col("record").alias("value")).write.partitionBy("file").option("lineSep", END).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, record`` of written files, record by record by their stated length.

    A file whose bytes are no record is read up to there: what follows is gone.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                offset, rows = 0, []
                while content.startswith(b"WARC/", offset):
                    head = content.find(END.encode(), offset)
                    found = _LENGTH.search(content, offset, head + 2) if head >= 0 else None
                    if not found:
                        break
                    end = head + len(END) + int(found[1])
                    rows.append((offset, content[offset:end].decode("utf-8", "replace")))
                    offset = end + len(END)
                columns = list(zip(*rows)) or [(), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(rows), pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())],
                    ["file", "offset", "record"],
                )

    files = spark.read.format("binaryFile").load(path).select(F.col("file").cast("long").alias("file"), "content")
    return files.mapInArrow(parse, "file bigint, offset bigint, record string")
