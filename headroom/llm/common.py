"""What several corpus operators share: tables, words, row identity, packed text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headroom.session import settle

#: Words of the contracts: runs of anything but blank, tab, line feed and their like.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """Rows never learned from: a fifth by checksum, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns next to the whole row, so that any other column passes through untouched."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def schema_of(rows: DataFrame, kept: list[str], added: str) -> T.StructType:
    """Fields of ``rows`` as they are, whatever their names, then the added ones."""
    return T.StructType([rows.schema[name] for name in kept] + T.StructType.fromDDL(added).fields)


def batches_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts sum up to ``most`` bytes; a longer text is a slice of its own."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)


NO_ID = -(2**63)  # stands for a null id, before all others
_PACKED_TOGETHER = 1 << 24
PLACE_BITS = 36  # of a place inside a document; the tie of its document stands above


def numbered(docs: DataFrame) -> DataFrame:
    """``doc, tie, doc_id, text``: a key for every different document, null texts as empty ones.

    Rows of equal id and text are one document. Different texts of one id are told apart by
    ``tie``, the rank of the text's hash, 0 for nearly all; ids are whole numbers, and a
    null id comes before all others. Only ids with several texts are ranked and joined.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    rows = docs.select(key, "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    hashes = rows.select("doc", "hash")
    several = hashes.groupBy("doc").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least != most")
    several = settle(several.select("doc"))
    if several.isEmpty():  # the usual case: no join
        return rows.select("doc", F.lit(0).cast("long").alias("tie"), "doc_id", "text")
    ranked = hashes.join(several, "doc", "left_semi").distinct()
    order = Window.partitionBy("doc").orderBy("hash")
    ties = settle(ranked.select("doc", "hash", (F.row_number().over(order) - 1).cast("long").alias("tie")))
    return rows.join(ties, ["doc", "hash"], "left").select("doc", F.coalesce("tie", F.lit(0)).alias("tie"), "doc_id", "text")


def with_packed_text(docs: DataFrame) -> DataFrame:
    """``text`` (never null) as ``packed``, a third of its size, for a shuffle of whole documents."""
    columns_before = docs.columns
    names = ["packed" if name == "text" else name for name in columns_before]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "text", _PACKED_TOGETHER):
                packed = pa.array([pack(t.encode()) for t in part.column("text").to_pylist()], pa.binary())
                columns = [packed if name == "text" else column for name, column in zip(columns_before, part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField("packed", T.BinaryType()) if n == "packed" else docs.schema[n] for n in names]
    return docs.mapInArrow(convert, T.StructType(fields))


def pack(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolled(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of every run of ``size`` values; put together from runs of powers of two."""
    found, have, run, width = None, 0, values.astype(np.uint64), 1
    while width <= size:
        if size & width:
            if found is None:
                found = run
            else:  # the run of ``width`` values comes after the ``have`` values found so far
                n = min(len(found), len(run) - have)
                found = found[: max(n, 0)] * np.uint64(pow(base, width, 1 << 64)) + run[have : have + max(n, 0)]
            have += width
        if len(run) > width:
            run = run[:-width] * np.uint64(pow(base, width, 1 << 64)) + run[width:]
        else:
            run = run[:0]
        width *= 2
    return found[: max(0, len(values) - size + 1)]


def covered(begins: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
