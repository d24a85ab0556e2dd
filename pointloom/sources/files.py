"""Readers and writers of raw clouds, frame folders, pose and voxel files. Files are read by Spark's own reader, so any store it knows works; Parquet is the native table format."""

from __future__ import annotations

import contextlib
import re
import struct
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import COV, NORMAL, XYZ

POSE_COLUMNS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
# Files of a frame folder: kind of number, numbers a point, columns and their places.
FULL = {"points": ("<f8", 4, XYZ, (0, 1, 2)), "times": ("<f8", 1, ("t",), (0,)), "normals": ("<f8", 4, NORMAL, (0, 1, 2)), "covs": ("<f8", 16, COV, (0, 1, 2, 5, 6, 10)), "intensities": ("<f8", 1, ("intensity",), (0,))}
COMPACT = {"points": ("<f4", 3, XYZ, (0, 1, 2)), "times": ("<f4", 1, ("t",), (0,)), "normals": ("<f4", 3, NORMAL, (0, 1, 2)), "covs": ("<f4", 6, COV, (0, 1, 2, 3, 4, 5)), "intensities": ("<f4", 1, ("intensity",), (0,))}


#: A file of records is written by one process; larger maps and frames are refused here and belong in Parquet.
MOST_ROWS = 50_000_000


@contextlib.contextmanager
def created(spark: SparkSession, path: str) -> Iterator[Callable[[bytes], None]]:
    """A new file of any store that Spark knows: yields its write()."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        yield out.write
    finally:
        out.close()


def bounded(df: DataFrame, most: int = MOST_ROWS) -> Iterator:
    """The rows of df one by one, a partition at a time, after a check of their number."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for one file; write Parquet")
    return df.toLocalIterator()


def _raw(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    width = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                a = np.frombuffer(content[: len(content) // (4 * width) * 4 * width], "<f4").reshape(-1, width).astype(float)
                yield pd.DataFrame({"path": name, "point_id": np.arange(len(a))} | {c: a[:, i] for i, c in enumerate(columns)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, point_id long, " + ", ".join(f"{c} double" for c in columns))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, x, y, z) of files of float32 triples without a header; point_id is the place in the file. A missing path is an error of Spark's reader."""
    return _raw(spark, path, XYZ)


def read_points4(spark: SparkSession, path: str) -> DataFrame:
    """With intensity, float32 quadruples."""
    return _raw(spark, path, (*XYZ, "intensity"))


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """(path, point_id, t): a float32 a point."""
    return _raw(spark, path, ("t",))


def load_frame(spark: SparkSession, path: str, frame_id: int = 0) -> DataFrame:
    """A frame folder: points.bin (float64 quadruples) or points_compact.bin (float32 triples), with the attributes whose files are there and aux_<name>.bin as binary columns (names may hold underscores)."""
    files = {r.path.rsplit("/", 1)[1]: r.length for r in spark.read.format("binaryFile").load(f"{path}/*.bin").select("path", "length").collect()}  # a folder's few names
    full = "points.bin" in files
    layout, suffix = (FULL, "") if full else (COMPACT, "_compact")
    if f"points{suffix}.bin" not in files:
        raise FileNotFoundError(f"no points in {path}")
    out = None
    kind, width, _, _ = layout["points"]
    n = files[f"points{suffix}.bin"] // (np.dtype(kind).itemsize * width)
    parts = [(f"{name}{suffix}.bin", *layout[name]) for name in layout if f"{name}{suffix}.bin" in files]
    for file, number, size, columns, places in parts:

        def run(batches: Iterator[pd.DataFrame], number=number, size=size, columns=columns, places=places) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for content in pdf.content:
                    a = np.frombuffer(content, number).reshape(-1, size).astype(float)
                    yield pd.DataFrame({"point_id": np.arange(len(a))} | {c: a[:, p] for c, p in zip(columns, places, strict=True)})

        table = spark.read.format("binaryFile").load(f"{path}/{file}").select("content").mapInPandas(run, "point_id long, " + ", ".join(f"{c} double" for c in columns))
        out = table if out is None else out.join(table, "point_id", "left")
    for file in sorted(files):
        if m := re.fullmatch(r"aux_(.+)\.bin", file):

            def aux(batches: Iterator[pd.DataFrame], name=m[1], size=files[file] // n if n else 0) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for content in pdf.content:
                        yield pd.DataFrame({"point_id": np.arange(len(content) // size), name: [content[i : i + size] for i in range(0, len(content), size)]} if size else {"point_id": [], name: []})

            table = spark.read.format("binaryFile").load(f"{path}/{file}").select("content").mapInPandas(aux, f"point_id long, `{m[1]}` binary")
            out = out.join(table, "point_id", "left")
    return out.withColumn("frame_id", F.lit(frame_id).cast("long"))


def save_frame(df: DataFrame, path: str, compact: bool = False) -> None:
    """One frame as a folder, which must not be there yet: its rows stream through one task. frames.py writes many, and says which stores it knows."""
    from .frames import save_frames

    folder, _, name = path.rstrip("/").rpartition("/")
    save_frames(df.withColumn("frame", F.lit(name)), folder, compact)


VOXEL = "<3i i 3f 6f f"


def save_voxelmap(voxels: DataFrame, path: str, resolution: float, lru: tuple[int, int, int] = (0, 10, 10)) -> None:
    """A text header and a packed record for each voxel, for exchange; the native form is the Parquet table. lru: count, cycle and threshold of an incremental map."""
    size = voxels.count()
    with created(voxels.sparkSession, path) as write:
        write(f"compact 1\nresolution {resolution!r}\nlru_count {lru[0]}\nlru_cycle {lru[1]}\nlru_thresh {lru[2]}\nvoxel_bytes {struct.calcsize(VOXEL)}\nnum_voxels {size}\n".encode())
        held: list[bytes] = []
        for r in bounded(voxels):
            held.append(struct.pack(VOXEL, r.vx, r.vy, r.vz, r.n, r.mx, r.my, r.mz, *[r[c] for c in COV], r.intensity))
            if len(held) == 65_536:
                write(b"".join(held))
                held.clear()
        write(b"".join(held))


def load_voxelmap(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(voxels, resolution)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["vx", "vy", "vz", "n", "mx", "my", "mz", *COV, "intensity"]
        for pdf in batches:
            for content in pdf.content:
                head = re.match(rb"(?:[a-z_]+ [^\n]*\n)+?num_voxels \d+\n", content)[0]
                yield pd.DataFrame(list(struct.iter_unpack(VOXEL, content[len(head) :])), columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.select(F.substring("content", 1, 400).cast("string").alias("h")).head().h
    columns = "vx long, vy long, vz long, n long, " + ", ".join(f"{c} double" for c in ("mx", "my", "mz", *COV, "intensity"))
    from ..functions import expr as E

    return files.mapInPandas(run, columns).withColumn("vkey", F.expr(E.pack("vx", "vy", "vz"))), float(re.search(r"resolution (\S+)", head)[1])


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """poses(frame_id, tx..qw) of lines `v<i> tx ty tz qx qy qz qw`; others are ignored."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*v\d+\s")).select(parts.alias("p"))
    return rows.select(F.substring(F.col("p")[0], 2, 20).cast("long").alias("frame_id"), *[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate(POSE_COLUMNS)])


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """traj(ts, tx..qw) of lines of eight numbers; comment lines are ignored. Warns where a file's stamps are not in order."""
    out = spark.read.csv(path, sep=" ", schema=", ".join(f"{c} double" for c in ("ts", *POSE_COLUMNS)), comment="#")
    placed = out.select("ts", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    # within a partition; lines of one file come in order
    before = F.lag("ts").over(W.partitionBy("file", F.shiftright("line", 33)).orderBy("line"))
    if placed.withColumn("before", before).where("ts < before").head(1):
        warnings.warn(f"stamps of {path} are not in order", stacklevel=2)
    return out


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="ts double", comment="#")


def _lines(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.orderBy("ts").select(F.format_string("%.9f" + " %.6f" * (len(columns) - 1), *columns).alias("value"))


def write_tum(df: DataFrame, path: str) -> None:
    _lines(df, ("ts", *POSE_COLUMNS)).write.text(path)


def write_imu(df: DataFrame, path: str) -> None:
    _lines(df, ("ts", "ax", "ay", "az", "wx", "wy", "wz")).write.text(path)
