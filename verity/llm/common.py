"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd base of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_STEP = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only a local session may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/verity-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows, and bytes, of whole texts that go to a Python task at once; Spark's own defaults are for narrow rows.
ROWS, BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python ``ROWS`` or ``BYTES`` at a time, unless the session has settings of its own.

    Workers, and the pools of the executor that fill the batches, keep the memory of their largest batch between stages,
    so this bounds what they hold together. A text of more bytes is a batch of its own.
    """
    for name, value in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verity-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table made by ``cut`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` doesn't have in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def flag_words(keys: DataFrame, bits: int) -> DataFrame:
    """(w, flags): 2**bits flags in words of 64, with the flag of each hash in the one column of ``keys`` set.

    At most 2**bits / 64 rows, whatever the number of keys, and tasks send no more than that each.
    """
    place = F.col(keys.columns[0]).bitwiseAND((1 << bits) - 1)
    placed = keys.select(place.alias("x")).select(F.shiftright("x", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(x & 63 AS INT))").alias("f"))
    return placed.groupBy("w").agg(F.bit_or("f").alias("flags"))


def maybe_in(keys: DataFrame, bits: int = 24) -> Callable[[Column], Column]:
    """A test of hashes: true for all in the one column of ``keys``, and for few others while those are below 2**bits.

    It keeps rows that a join would drop anyway out of the join's shuffle. What is broadcast has a fixed size; more keys
    only let more rows through, so the join after it decides.
    """
    words = keys.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w")).join(flag_words(keys, bits), "w", "left")
    all_words = words.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("flags", F.lit(0).cast("long")).alias("flags")))).alias("a")).select(F.transform("a", lambda x: x["flags"]).alias("a"))
    table = all_words.scalar()
    mask = (1 << bits) - 1

    def test(h: Column) -> Column:
        place = h.bitwiseAND(mask)
        return F.bit_get(F.get(table, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1

    return test


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


#: Bytes that end a word: white space; or all ASCII but letters and digits.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_FORWARD, _BACKWARD = powers(BASE, _STEP), powers(INVERSE, _STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: 64-bit hash, start, end, and the rows' offsets into the words.

    A word is a longest run of bytes for which ``apart`` is false; by default ``[^\\x20\\x09-\\x0D]+``.

    The hash is a polynomial over the bytes, taken from prefix sums, so a whole batch needs a few numpy passes.
    With ``lower`` the letters A-Z count as a-z.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = np.ones(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~apart[data]
    first = np.zeros(n + 1, bool)
    first[offsets[1:-1]] = True  # a row's start ends the word before it
    begins = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    x = data + np.uint8(32) * ((data >= 65) & (data <= 90)) if lower else data
    at = np.arange(n, dtype=np.int64) % _STEP
    sums = np.zeros(n + 1, np.uint64)
    # Each stretch of _STEP bytes has powers of its own; a word that crosses its end is summed from two parts.
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _FORWARD[at], out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * _BACKWARD[at[begins]] if len(begins) else np.zeros(0, np.uint64)
    crossing = np.flatnonzero(begins // _STEP != (ends - 1) // _STEP)
    for k in crossing:
        b, e = int(begins[k]), int(ends[k])
        part = (x[b:e].astype(np.uint64) + np.uint64(1)) * powers(BASE, e - b)
        hashes[k] = part.sum(dtype=np.uint64)
    hashes = mix(hashes + (ends - begins).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return hashes, begins, ends, np.searchsorted(begins, offsets)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch whose texts hold about ``limit`` bytes at most (one longer text is a slice of its own)."""
    lengths = utf8(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(lengths, lengths[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
