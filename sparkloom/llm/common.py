"""What several operators share: Arrow batches in and out, written tables, hashing of words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch. Texts can be long, so the default of 10,000 is too many.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches keep a Python worker's memory bounded when rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df into the shared folder and read it back: the plan above it starts from files that
    outlive any executor. Parquet is far smaller than checkpoint()'s row files."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_run_dirs: set[str] = set()


def _run_dir(spark: SparkSession) -> str:
    """One folder for all tables of a Spark application. Results read from them lazily, so they are kept as long as the driver
    lives, which deletes the folder as it ends; what nothing reads any more goes before, by dropped()."""
    path = f"{shared_dir(spark)}/sparkloom-{spark.sparkContext.applicationId}"
    if path not in _run_dirs:
        _run_dirs.add(path)
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


Columns = dict[str, list]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[Columns]], Iterator[Columns]], schema: str, arrays: bool = False) -> DataFrame:
    """mapInArrow with plain columns: fn gets an iterator over batches (name -> list) of one
    partition and yields batches of the result's columns. arrays: numpy arrays instead of lists, for numbers without nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        for batch in batches:
            if batch.num_rows:
                yield {name: batch.column(i).to_numpy(zero_copy_only=False) if arrays else batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(columns(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def as_bytes(name: str = "text") -> Column:
    """A text as UTF-8; a null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0. A null id is in the held-out part: it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def first_by_hash(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """The first n rows in the order of a hash of their ids, which must be distinct. Rows are counted and those that can't be
    among them are left out first, so that not every task sends n rows to the driver."""
    space = 1 << 40
    place = F.pmod(F.xxhash64(id_col), F.lit(space))
    total = df.count()
    if total > n:
        df = df.where(place < min(space, int(space * ((1.2 * n + 100) / total))))
    return df.orderBy(place, id_col).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_id, _t, _y): texts with labels outside the held-out fold, n at most, the first by a hash of the id.

    Each id counts once: of several labels the smaller, of several texts the first in byte order. So neither repeated labels nor
    repeated documents make the sample larger or smaller. The chosen ids, n at most, are broadcast.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    chosen = F.broadcast(first_by_hash(known, n, "_id"))
    body = docs.select(docs[id_col].alias("_doc"), as_bytes(text_col).alias("_t"))
    return body.join(chosen, body["_doc"] == chosen["_id"]).groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y"))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, kept for words seen before; the size is bounded."""

    def __init__(self, most: int = 300_000):
        import xxhash

        self._hash, self._most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        self[word] = h = self._hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+`. bytes.split() and bytes.lower() know ASCII only."""
    return text.lower().split()


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; for fewer words, one for the whole sequence; none without words."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        acc = np.uint64(n)
        with np.errstate(over="ignore"):
            out = np.full(1, acc, np.uint64)
            for x in h:
                out = mix64(out * _MULT + x)
        return out
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix64(out * _MULT + h[i : n - k + 1 + i])
    return out
