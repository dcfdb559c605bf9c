"""Small helpers shared by the corpus operators."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bytes that count as white space, and the map that lower-cases A-Z only.
SPACE = b" \t\n\v\f\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, as spark-submit --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_barloom_shipped", None) != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()).resolve() / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._barloom_shipped = context.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """`stem`, or `stem` with underscores, so that no input column is shadowed."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def octets(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_codes(seed: int) -> np.ndarray:
    """A random odd-looking 64-bit code for each byte value, the same in every process."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]
