"""Helpers that every operator of this subpackage uses: shared storage and batch slicing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Rows in an Arrow batch. Texts are long, and a Python worker holds a batch at a time.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """What a session needs before these operators run on it."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session may do without that
    setting; it gets a folder of its own, as everything runs on one machine there.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found


def _path(spark: SparkSession, uri: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, uri: str) -> None:
    fs, p = _path(spark, uri)
    fs.delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            drop_path(spark, uri)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(clean)
    return uri


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a
    lost executor loses nothing."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``table`` that nothing reads any more, and has Spark's cleaner delete the
    shuffle files of plans that are gone; else these stay until the driver's next collection."""
    for t in tables:
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            drop_path(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def lean(f):
    """f, a function of Arrow batches, that gives freed memory back after each batch: workers are kept from task to
    task, and what their allocators hold would add up over the operators of a pipeline."""

    def run(batches):
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        for out in f(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            if trim is not None:
                trim(0)

    return run


#: Most cells of a bitmap: 16 MB are broadcast, 32 MB pass the driver. It has 8 cells for each id up to 16 million ids;
#: with more it lets more through, and from FULL cells on it isn't made.
CELLS = 1 << 27
FULL = 0.6


class Bitmap:
    """Which 64-bit values may be among those of a column, for functions on executors.

    What isn't among them mostly gives False, what is always True. The size follows the number of values; where they'd
    fill CELLS, everything passes. What passes must still be joined, or be harmless.
    """

    def __init__(self, values: DataFrame):
        import numpy as np

        spark, (column,) = values.sparkSession, values.columns
        n = values.count()
        cells = min(CELLS, max(1 << 16, 1 << (8 * n).bit_length()))
        self.mask = cells - 1
        self._sent, self._held = None, None
        if 1 - np.exp(-n / cells) > FULL:
            return
        cell = values.select(F.col(column).bitwiseAND(F.lit(self.mask)).alias("c"))
        words = cell.groupBy(F.shiftright("c", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(c & 63)))").alias("bits")).toArrow()  # at most CELLS / 64 rows
        packed = np.zeros(cells // 64, np.int64)
        packed[words.column("w").to_numpy()] = words.column("bits").to_numpy()
        del words
        self._sent = spark.sparkContext.broadcast(packed.tobytes())

    def __getstate__(self):
        return self.__dict__ | {"_held": None}

    def __call__(self, values):
        """For an array of values (uint64 or int64), an array of bool."""
        import numpy as np

        if self._sent is None:
            return np.ones(len(values), bool)
        if self._held is None:
            self._held = np.frombuffer(self._sent.value, np.uint8)
        at = values.view(np.int64) & np.int64(self.mask)
        return (self._held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, among: bool = True) -> DataFrame:
    """Those rows whose key may be among ids (a table with a column of the same name), before any shuffle; with among=False,
    all other rows.

    Rows whose key isn't wanted may pass, wanted ones always do. A join that decides must follow.
    """
    cell = F.xxhash64(F.col(key).cast("long"))
    wanted = Bitmap(ids.select(cell.alias("c")))

    def keep(batches):
        for b in batches:
            passed = wanted(b.column(b.num_columns - 1).to_numpy())
            yield b.filter(pa.array(passed if among else ~passed)).select(list(range(b.num_columns - 1)))

    return rows.withColumn(fresh(rows, "cell"), cell).mapInArrow(lean(keep), rows.schema)


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that rows doesn't have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Tables of one operator: written in the shared folder, dropped by name as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables (all, without names) and has shuffle files of plans that are gone deleted."""
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                drop_path(self.spark, path)
        release(self.spark)


def slices(column: pa.Array, most_bytes: int = 1 << 20):
    """Yields (first row, rows) so that each piece of a string column holds about most_bytes;
    a longer text is a piece by itself."""
    import numpy as np

    n = len(column)
    if n == 0:
        return
    ends = np.cumsum(_lengths(column), dtype=np.int64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, base + most_bytes, "right")), at + 1)
        yield at, to - at
        at = to


def _lengths(column: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
