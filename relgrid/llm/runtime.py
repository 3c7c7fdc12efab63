"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it anywhere.

    Batches for Python get 1000 rows at most where the session has the default of 10,000: whole texts fill them.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, whose workers give memory back to the system when a task ends, as they live on for others."""
    ship(df.sparkSession)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def hidden(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty() and spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="shared-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again, and let Spark drop the shuffle files that led to them."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    jvm.System.gc()
    give_back()


_STEADY = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range"}


def steady(docs: DataFrame) -> DataFrame:
    """docs if it is a scan with projections and filters, whose rows keep their places when read again; else a stored copy."""
    plans = [docs._jdf.queryExecution().analyzed()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() not in _STEADY or not plan.deterministic():
            return stored(docs, "rows")
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id"):
    """CRC-32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; TOKENIZER_DIR overrides the installed package."""
    if base := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(base, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
