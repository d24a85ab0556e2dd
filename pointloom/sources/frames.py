"""Frame folders as a data source: `<path>/<frame>/<attribute>.bin`, one file of fixed-size records for each attribute of a frame.

Reading, each frame is cut into ranges of points, and a task reads the same range of all its files: no join, no shuffle, no file in
one piece. Writing, a task streams the frames it was given to a folder of its own, and the driver moves what succeeded into place.
Files are reached by pyarrow's file systems (local and mounted paths, hdfs, s3, gs) from the tasks; load_frame of files.py
reads single frames of any other store that Spark knows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

from .files import COMPACT, FULL

#: Points that a task reads at most, and points of one Arrow batch.
RANGE, BATCH = 4_000_000, 65_536
#: The open parts of a frame that is being written begin with this; readers pass them over.
PENDING = "_pending-"
AUX = re.compile(r"aux_(.+)\.bin")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Frame:
    """A frame's folder: its number of points, whether compact, the bytes a point of each aux file, attributes there."""

    name: str
    points: int
    compact: bool
    attributes: tuple[str, ...]
    aux: dict[str, int] = field(default_factory=dict)


def frames_of(path: str) -> list[Frame]:
    """The frames of a folder, by name. Only names and lengths come to the driver; a folder without points is no frame."""
    store, root = _store(path)
    sizes: dict[str, dict[str, int]] = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        frame, _, file = info.path[len(root.rstrip("/")) + 1 :].rpartition("/")
        if info.type == fs.FileType.File and frame and "/" not in frame and not frame.startswith(("_", ".")):
            sizes.setdefault(frame, {})[file] = info.size
    out = []
    for name, files in sorted(sizes.items()):
        compact = "points.bin" not in files
        layout, suffix = (COMPACT, "_compact") if compact else (FULL, "")
        if f"points{suffix}.bin" not in files:
            continue
        n = files[f"points{suffix}.bin"] // _width(layout["points"])
        there = [a for a in layout if f"{a}{suffix}.bin" in files]
        short = [a for a in there if files[f"{a}{suffix}.bin"] < n * _width(layout[a])]
        if short:
            raise ValueError(f"frame {name} has {n} points, but fewer {', '.join(short)}")
        aux = {m[1]: size // n if n else 0 for file, size in sorted(files.items()) if (m := AUX.fullmatch(file))}
        out.append(Frame(name, n, compact, tuple(there), aux))
    return out


def _width(layout: tuple) -> int:
    return np.dtype(layout[0]).itemsize * layout[1]


class FrameSource(DataSource):
    """Options: path; attributes, a list by commas of those to read (all); range, points a task (RANGE); compact, for writing.

    Rows: frame (the folder's name), frame_id (that as a number, else null), point_id (place in the file), the columns of the attributes that any frame
    has (null where a frame has not), and aux files as binary columns. Writing takes frame or frame_id, and point_id, whose order is the file's; see save_frames.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def _wanted(self) -> set[str] | None:
        said = self.options.get("attributes")
        return {"points", *(a.strip() for a in said.split(","))} if said else None

    def schema(self) -> StructType:
        found, wanted = frames_of(self.options["path"]), self._wanted()
        if not found:
            raise FileNotFoundError(f"no frames in {self.options['path']}")
        out = StructType().add("frame", StringType()).add("frame_id", LongType()).add("point_id", LongType())
        for attribute, (_, _, columns, _) in FULL.items():
            if any(attribute in f.attributes for f in found) and (wanted is None or attribute in wanted):
                for c in columns:
                    out = out.add(c, DoubleType())
        for name in sorted({a for f in found for a in f.aux}):
            if wanted is None or name in wanted:
                out = out.add(name, BinaryType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options["path"], schema, int(self.options.get("range") or RANGE))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FrameWriter(self.options["path"], self.options.get("compact", "false").lower() == "true", overwrite)


class Piece(InputPartition):
    def __init__(self, frame: Frame, start: int, end: int) -> None:
        self.frame, self.start, self.end = frame, start, end


class FrameReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, points: int) -> None:
        self.path, self.columns, self.points = path, schema.fieldNames(), points
        self.kinds = {f.name: f.dataType for f in schema}

    def partitions(self) -> list[Piece]:
        return [Piece(f, at, min(f.points, at + self.points)) for f in frames_of(self.path) for at in range(0, f.points, self.points)] or [Piece(Frame("", 0, False, ()), 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        frame, (store, root) = partition.frame, _store(self.path)
        layout, suffix = (COMPACT, "_compact") if frame.compact else (FULL, "")
        files: dict[str, Any] = {}
        for a in frame.attributes:
            if set(layout[a][2]) & set(self.columns):
                files[a] = store.open_input_file(f"{root}/{frame.name}/{a}{suffix}.bin")
        for a, size in frame.aux.items():
            if size and a in self.columns:
                files[f"aux_{a}"] = store.open_input_file(f"{root}/{frame.name}/aux_{a}.bin")
        kinds = {StringType: pa.string(), LongType: pa.int64(), DoubleType: pa.float64(), BinaryType: pa.binary()}
        number = int(frame.name) if re.fullmatch(r"-?[0-9]{1,18}", frame.name) else None
        try:
            for at in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                made = {"frame": pa.array([frame.name] * n), "frame_id": pa.array([number] * n, pa.int64()), "point_id": pa.array(np.arange(at, at + n))}
                for a in frame.attributes:
                    if a in files:
                        kind, width, columns, places = layout[a]
                        values = np.frombuffer(files[a].read_at(n * _width(layout[a]), at * _width(layout[a])), kind).reshape(n, width).astype(float)
                        made |= {c: pa.array(values[:, p]) for c, p in zip(columns, places, strict=True)}
                for a, size in frame.aux.items():
                    if f"aux_{a}" in files:
                        raw = files[f"aux_{a}"].read_at(n * size, at * size)
                        made[a] = pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, kinds[type(self.kinds[c])]) for c in self.columns], self.columns)
        finally:
            for f in files.values():
                f.close()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    frames: tuple[str, ...]


class FrameWriter(DataSourceArrowWriter):
    """Tasks hold the open files of one frame and one batch of rows, whatever the frame's size."""

    def __init__(self, path: str, compact: bool, overwrite: bool) -> None:
        self.path, self.compact, self.overwrite, self.job = path, compact, overwrite, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/{PENDING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        folder = f"{self._pending(root)}/{uuid.uuid4().hex}"  # of this attempt alone: what a lost one left is never moved
        done: dict[str, dict[str, int]] = {}
        files: dict[str, Any] = {}
        now: Any = self  # no name yet
        try:
            for batch in iterator:
                names = batch.column("frame").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    if names[lo] != now:
                        now = names[lo]
                        if not now or now in done or "/" in now or now.startswith(("_", ".")):
                            raise ValueError(f"not the name of one frame, or its rows are apart: {now}")
                        for f in files.values():
                            f.close()
                        files, done[now] = {}, {}
                        store.create_dir(f"{folder}/{now}", recursive=True)
                    for file, content in self._records(batch.slice(lo, hi - lo)):
                        if file not in files:
                            files[file] = store.open_output_stream(f"{folder}/{now}/{file}")
                        files[file].write(content)
                        if file.startswith("aux_") and done[now].setdefault(file, len(content) // (hi - lo)) * (hi - lo) != len(content):
                            raise ValueError(f"{file} of frame {now} has values of different lengths")
        finally:
            for f in files.values():
                f.close()
        return Written(folder, tuple(done))

    def _records(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        n, there = batch.num_rows, batch.schema.names
        for name, (kind, width, columns, places) in (COMPACT if self.compact else FULL).items():
            if not set(columns) <= set(there):
                continue
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            a = np.zeros((n, width), kind)
            a[:, list(places)] = np.stack(values, axis=1)
            if not self.compact and name == "points":
                a[:, 3] = 1
            if not self.compact and name == "covs":
                for place, c in ((4, 1), (8, 2), (9, 4)):  # the lower half
                    a[:, place] = values[c]
            yield f"{name}{'_compact' if self.compact else ''}.bin", a.tobytes()
        for c in batch.schema:
            if c.type in (pa.binary(), pa.large_binary()):
                values = batch.column(c.name).to_pylist()
                if len({None if v is None else len(v) for v in values}) != 1 or values[0] is None:
                    raise ValueError(f"values of {c.name} are null or of different lengths")
                yield f"aux_{c.name}.bin", b"".join(values)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        frames = [(m.folder, frame) for m in messages if m for frame in m.frames]
        if len({f for _, f in frames}) < len(frames):
            self.abort(messages)
            raise ValueError("two tasks wrote one frame: save_frames() brings a frame's rows together")
        if self.overwrite:
            for old in frames_of(self.path):
                store.delete_dir(f"{root}/{old.name}")
        clash = [i.base_name for i in store.get_file_info([f"{root}/{f}" for _, f in frames]) if i.type != fs.FileType.NotFound]
        if clash:
            self.abort(messages)
            raise FileExistsError(f"{', '.join(clash[:5])} are there already")
        for folder, frame in frames:
            store.move(f"{folder}/{frame}", f"{root}/{frame}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            store.delete_dir(self._pending(root))


def load_frames(spark: SparkSession, path: str, attributes: tuple[str, ...] = (), points: int = RANGE) -> DataFrame:
    """All frames of a folder (see FrameSource); attributes: those to read, beside points; points: at most so many a task."""
    spark.dataSource.register(FrameSource)
    wanted = {"attributes": ",".join(attributes)} if attributes else {}
    return spark.read.format("frames").options(path=path, range=points, **wanted).load()


def save_frames(df: DataFrame, path: str, compact: bool = False, mode: str = "append") -> None:
    """A folder for each frame: of `frame` (the folder's name) or `frame_id` (six digits at least), its points by point_id.

    One shuffle brings the rows of a frame together in order; frames are the unit of parallel work, and each streams through its task. Null frames, and null
    or unequally long aux values, are refused; null numbers become nan; columns that are neither an attribute's nor binary are left out. A frame that is there already is an
    error with mode append; overwrite deletes the folder's frames first. An empty table writes no frame.
    """
    spark = df.sparkSession
    spark.dataSource.register(FrameSource)
    if "frame" not in df.columns:
        df = df.withColumn("frame", F.when(F.col("frame_id").isNotNull(), F.format_string("%06d", "frame_id")))
    numbers = [F.col(c).cast("double").alias(c) for _, _, columns, _ in FULL.values() for c in columns if c in df.columns]
    aux = [F.col(f"`{c}`") for c, kind in df.dtypes if kind == "binary"]
    df.select(F.col("frame").cast("string").alias("frame"), "point_id", *numbers, *aux).repartition("frame").sortWithinPartitions("frame", "point_id").write.format("frames").mode(mode).options(path=path, compact=str(compact).lower()).save()
