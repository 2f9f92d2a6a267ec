"""Reading the given tables, splitting by a checksum, and drawing bounded samples of labelled rows."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether a row may not be learned from; a row without a key is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(True))


def sample_by_label(narrow: DataFrame, label: str, most: int, key: str = "doc_id", rows: DataFrame | None = None):
    """About `most` rows of each label (all, if it has fewer), chosen by a hash of the key, so the same in every run.

    The counts read the two columns of `narrow`; the choice filters `rows` (or `narrow`), without sort or shuffle.
    """
    counts = {r[label]: r["count"] for r in narrow.groupBy(label).count().collect() if r[label] is not None}
    chance = F.lit(0.0)
    for value, n in counts.items():
        chance = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(chance)
    point = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (narrow if rows is None else rows).where(F.col(label).isNotNull() & (point < chance))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, so that its Python functions can be loaded there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp()) / "ebbtide.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted((root / "ebbtide").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
