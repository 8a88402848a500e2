"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.session import small_batches as small_batches  # the operators take it from here

#: Pattern of a word: a run of anything but space and \\t..\\r. Fixed by the operators' contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The characters between words.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in sf_dir, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent (a local session, such as in tests) a temporary folder is made
    and set, once for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("uttera.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="uttera-")
        spark.conf.set("uttera.shared.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/uttera/{name}-{uuid.uuid4().hex}"


#: For each thread, the open scopes of passing(): the paths written in each.
_OPEN = threading.local()
#: Lets a query's shuffle files go when it has ended, not when the driver collects its garbage.
_BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_table(spark: SparkSession, name: str, up: int = 0) -> str:
    """A new path in the shared folder for a table that is written at once or by appending. Inside passing() it goes with the scope; `up` as in written()."""
    path = shared_path(spark, name)
    scopes = getattr(_OPEN, "scopes", [])
    if up < len(scopes):
        scopes[-1 - up].append(path)
    return path


def written(df: DataFrame, name: str, up: int = 0) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, lost executors cost nothing.

    Inside passing() the table goes with the scope; `up` leaves it to the scope so many further out, to the application where there is none.
    """
    path = new_table(df.sparkSession, name, up)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def in_parts(df: DataFrame, name: str, part: Column, parts: int) -> Iterator[DataFrame]:
    """df written once and read back in `parts` parts, by the number that the column `part` gives a row. The files of a part go when the next is asked for."""
    spark, path = df.sparkSession, new_table(df.sparkSession, name)
    df = df.withColumn("_part", part.cast("int"))
    df.write.partitionBy("_part").parquet(path)
    for k in range(parts):
        yield spark.read.schema(df.schema).parquet(path).where(F.col("_part") == k).drop("_part")
        deleted(spark, f"{path}/_part={k}")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A scope whose tables of written() are deleted when it ends, and whose queries' shuffle files when each has ended."""
    _OPEN.scopes = [*getattr(_OPEN, "scopes", []), []]
    before = spark.conf.get(_BRIEF, None)
    spark.conf.set(_BRIEF, "true")
    try:
        yield
    finally:
        *_OPEN.scopes, made = _OPEN.scopes
        spark.conf.unset(_BRIEF) if before is None else spark.conf.set(_BRIEF, before)
        for path in made:
            deleted(spark, path)


def salted_lookup(rows: DataFrame, small: DataFrame, on: list[str], salt_of: Column, salts: int = 32) -> DataFrame:
    """Left join of rows with small on the columns `on`, spread over `salts` partitions a key.

    `small` has one row for each key and is repeated `salts` times; a key that holds a large part of
    `rows` is then dealt to many tasks. Keys are compared null-safe on neither side: a null key finds nothing.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*on, "_salt"], "left").drop("_salt")


#: What empties each operator's caches in this Python worker, by operator.
_CACHES: dict[str, Callable[[], None]] = {}


def worker_cache(owner: str, empty: Callable[[], None]) -> None:
    """Names a worker-wide cache of the operator `owner`, so that another operator's task can empty it."""
    _CACHES[owner] = empty


@contextmanager
def worker_memory(owner: str) -> Iterator[None]:
    """Around the work of one task in a Python worker, which Spark hands on to later tasks of any operator.

    Other operators' caches are emptied first; afterwards what is free goes back to the system, for workers wait beside a full heap.
    """
    for name, empty in _CACHES.items():
        if name != owner:
            empty()
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def tidy(owner: str, fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """fn, from batches to batches, inside worker_memory(owner)."""

    def run(batches: Iterator) -> Iterator:
        with worker_memory(owner):
            yield from fn(batches)

    return run


class Recent(dict):
    """A worker's cache of two generations, `most` entries each: what is met again moves to the younger, the older is dropped.

    One entry is in both at times. Call age() between uses; within one, nothing that unknown() left out goes. The entries
    of `always` stay for good.
    """

    def __init__(self, most: int, always: dict | None = None):
        super().__init__(always or {})
        self.most, self.old, self.always = most, {}, always or {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def unknown(self, keys: set) -> set:
        return keys.difference(self).difference(self.old)

    def age(self) -> None:
        if len(self) > len(self.always) + self.most:
            self.old = {k: v for k, v in self.items() if k not in self.always}
            self.clear()
            self.update(self.always)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D ]+", -1), "")
