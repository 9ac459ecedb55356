"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

#: Runs of these six characters (tab to carriage return, and space) part words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one vectorised step works on.
SLICE_BYTES = 3 << 20

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


#: Rows of one Arrow batch. Spark's own setting counts rows as if they were short; documents aren't, and
#: the JVM and Python each hold a batch.
BATCH_ROWS, BATCH_KEY = "1500", "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches suit documents, unless the session's owner chose their size."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == "10000":
        conf.set(BATCH_KEY, BATCH_ROWS)
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine that names none (a test) gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievework-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the cluster's shared checkpoint folder and reads on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared checkpoint folder, read again, and its path; for frames with whole texts."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what ``written`` wrote; nothing may read it later."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for temporary columns that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, k = f"_{stem}", 0
        while name.lower() in taken:
            name, k = f"_{stem}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out


def without_keys(df: DataFrame, gone: DataFrame, key: list[Column]) -> DataFrame:
    """The rows of ``df`` whose ``key`` (expressions over its columns; rows with a null part stay) isn't a row of ``gone``.

    A filter over the keys, of bounded size, lets most rows pass without a shuffle; the others are held
    against the keys themselves. Beyond some three million keys the filter lets ever more rows through to
    the join, which shuffles them whole.
    """
    df = bounded(df)
    names = fresh(df, *(f"key{k}" for k in range(len(key))))
    may, *spots = fresh(df, "may", *(f"place{k}" for k in range(len(Bits.SALTS))))
    gone = cut(gone.toDF(*names).distinct())
    count = gone.count()
    if not count:
        return df
    (one,) = fresh(df, "hash")
    shared = df.sparkSession.sparkContext.broadcast(Bits.of(gone.select(F.xxhash64(*names).alias(one)), one, count))
    columns = df.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hit = shared.value.has([rows.column(c).to_numpy() for c in spots])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(hit)], [*columns, may])

    asked = df.withColumn(one, F.xxhash64(*key)).withColumns(dict(zip(spots, shared.value.places(one), strict=True)))
    marked = asked.drop(one).mapInArrow(mark, StructType([*df.schema.fields]).add(may, BooleanType()))
    unsure = marked.where(F.col(may)).drop(may).withColumns(dict(zip(names, key, strict=True)))
    kept = unsure.join(gone, names, "left_anti").select(*("`" + c.replace("`", "``") + "`" for c in columns))
    return marked.where(~F.col(may)).drop(may).unionByName(kept)


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of frames that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which a driver with little to do puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives freed memory back to the system, as idle workers stay beside the JVM for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows of about ``most`` text bytes; one longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, one after the other, and the number of words of each row (null: none)."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    rows = np.repeat(np.arange(len(text)), lengths)[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), np.bincount(rows, minlength=len(text)).astype(np.int64)


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words that the codes name."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    codes, names = encoded(words)
    if not len(names):
        return np.zeros(0, np.uint64)
    seen = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names.cast(pa.binary()).to_pylist()), np.uint64, len(names))
    return seen[codes]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs."""
    return mix(a * GOLD + mix(b + GOLD))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Bits:
    """A Bloom filter over longs: bits that the executors set and the driver gathers.

    Its size follows the number of keys and never exceeds ``most_bits``; beyond that more keys pass
    wrongly, so whoever asks must still check what passes.
    """

    SALTS = (17, 71)

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, keys: DataFrame, column: str, count: int, most_bits: int = 1 << 25, plain: bool = False) -> Bits:
        """plain: the keys are hashes themselves, and one bit a key is enough."""
        bits = min(most_bits, 1 << max(13, (12 * count).bit_length()))
        spots = [F.pmod(F.col(column), F.lit(bits))] if plain else [F.pmod(F.xxhash64(F.lit(s), F.col(column)), F.lit(bits)) for s in cls.SALTS]
        places = F.explode(F.array(*spots)).alias("p")
        found = (
            keys.where(F.col(column).isNotNull())
            .select(places)
            .groupBy(F.floor(F.col("p") / 32).cast("int").alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 AS int))")).alias("m"))
            .toArrow()
        )
        words = np.zeros(bits // 32, np.int64)
        words[found["w"].to_numpy()] = found["m"].to_numpy()
        return cls(words.astype(np.uint32), bits)

    def has_plain(self, hashes: np.ndarray) -> np.ndarray:
        return self.has([np.mod(hashes, self.bits)])

    def places(self, column: str) -> list:
        """Expressions of a key's bits, for the frame that is asked about."""
        return [F.pmod(F.xxhash64(F.lit(s), F.col(column)), F.lit(self.bits)) for s in self.SALTS]

    def has(self, places: list[np.ndarray]) -> np.ndarray:
        """Whether keys whose bits are at ``places`` may be among the keys."""
        found = np.ones(len(places[0]), bool)
        for p in places:
            found &= (self.words[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) == 1
        return found
