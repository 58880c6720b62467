"""What the operators share: storage that survives lost executors, bounded Arrow batches, and text columns without NULLs."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from itertools import islice
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches to Python hold no more rows and bytes than this, so that very long texts do not fill a worker.
BATCH_ROWS, BATCH_BYTES = "1024", "16m"


def _ship(spark: SparkSession) -> None:
    """Give executors this package, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():  # else it came as an archive, which executors have
        folder = Path(tempfile.mkdtemp(prefix="marlstone-"))
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(archive := folder / "marlstone.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))
    sc._marlstone_shipped = True


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on, which stay set: bounded Arrow batches, and shuffle files that go when the query that wrote them ends, since what is kept between steps is in stored tables."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; only where the session names none and runs on one machine, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = os.path.join(tempfile.gettempdir(), f"marlstone-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> int:
    """Delete all that the operators have left in the shared folder since the last call; results not read or written by then are lost. The number of tables."""
    paths = list(_made)
    for path in paths:
        _delete(spark, path)
        _made.discard(path)
    return len(paths)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and a lost executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def newest(entries: dict, n: int) -> list:
    """The keys last put into a dictionary, in order."""
    return list(islice(reversed(entries), n))[::-1]


def least_hashed(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most ``n`` rows, those with the least hashes of ``by``. A threshold that some ``4 * n`` rows of a large table pass comes first, so that its tasks do not all send ``n`` rows on."""
    steps = 1 << 30
    total, place = df.count(), F.pmod(F.xxhash64(*by), F.lit(steps))
    few = df.where(place < max(1, steps * 4 * n // total)) if total > 16 * n else df
    return few.orderBy(place, *by).limit(n)


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def held_out(divisor: int, c: str = "doc_id") -> Column:
    """crc32 of the id as text leaves remainder 1; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % divisor == 1, F.lit(False))
