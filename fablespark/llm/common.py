"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) modulo HOLDOUT_FOLDS is 0 never train a model.
HOLDOUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder, whatever file system it lies in."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that is kept from training; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % HOLDOUT_FOLDS == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session is a local one (tests) a temporary
    folder serves.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fablespark-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage that every executor shares."""
    folder = shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def columns_but(df: DataFrame, *names: str) -> list[str]:
    """The frame's columns without those named, upper or lower case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def free_prefix(*frames: DataFrame) -> str:
    """Underscores that no column of the frames begins with, for columns of our own."""
    prefix = "_"
    while any(c.startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return prefix


def literal_rows(spark: SparkSession, rows: list[tuple] | tuple, names: list[str]) -> DataFrame:
    """A few fixed rows as a plan of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def quoted(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col(f"`{c}`") for c in names]


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
