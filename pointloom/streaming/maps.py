"""Incremental maps: batches of points change a table of state; each state is written to the shared folder, so any executor may be lost.

State is kept in PARTS parts. A batch reads and rewrites only the parts that it changes; the others' files stay as they are. What is saved after a batch
is its number and where its parts lie, in one small file: a batch that comes again changes nothing. Parts that a later state took the place of are deleted,
with saved states once the later one is saved.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import scratch
from ..functions import expr as E
from ..operators import features
from ..operators.neighbors import as_queries, knn_voxel
from ..operators.voxels import gaussian_voxelmap, merge_voxelmaps, with_voxel
from ..schema import COV, XYZ
from ..scratch import cut, drop

#: Parts of a map's state.
PARTS = 64
#: Voxels of a block are in one part, so that the neighbours of a voxel are in few: 8 along each side.
BLOCK_BITS = 3


def part_of(vkey: str = "vkey") -> Column:
    return F.pmod(F.xxhash64(vkey), F.lit(PARTS)).cast("int")


def _block(resolution: float) -> list[Column]:
    return [F.expr(f"{E.voxel(c, resolution)} >> {BLOCK_BITS}") for c in XYZ]


def part_of_block(block: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*block), F.lit(PARTS)).cast("int")


@dataclass
class Parts:
    """A table in parts, each a folder of its own."""

    name: str
    tables: dict[int, str] = field(default_factory=dict)
    schema: str | None = None
    replaced: set[str] = field(default_factory=set)

    def read(self, spark: SparkSession, parts: Iterable[int] | None = None) -> DataFrame:
        paths = sorted({p for k, p in self.tables.items() if parts is None or k in parts})
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, part: Column, changed: Iterable[int]) -> None:
        """df takes the place of the changed parts; a part without rows has no folder."""
        spark = df.sparkSession
        self.schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        path = f"{scratch.root(spark)}/pointloom/{self.name}-{uuid.uuid4().hex}"
        df.withColumn("part", part).write.partitionBy("part").parquet(path)
        scratch.register(path, spark)
        written = [int(str(x.getPath().getName()).split("=")[1]) for x in scratch.found(spark, f"{path}/part=*")]
        changed = set(changed)
        self.replaced |= {p for k, p in self.tables.items() if k in changed}
        self.tables = {k: v for k, v in self.tables.items() if k not in changed} | {k: f"{path}/part={k}" for k in written}

    def prune(self, spark: SparkSession) -> None:
        """Delete the parts that later ones took the place of."""
        used = {p.rsplit("/", 1)[0] for p in self.tables.values()}
        for path in self.replaced:
            folder = path.rsplit("/", 1)[0]
            scratch.delete(spark, path if folder in used else folder)
        self.replaced = set()

    def keep(self) -> None:
        """The parts outlive the session: a saved state refers to them."""
        for path in self.tables.values():
            scratch.keep(path.rsplit("/", 1)[0])

    def document(self) -> dict:
        return {"tables": self.tables, "schema": self.schema}

    def load(self, document: dict) -> None:
        self.tables, self.schema, self.replaced = {int(k): v for k, v in document["tables"].items()}, document["schema"], set()


class SavedMap:
    """What the maps share: their parts, and saving them with the number of the batch that led to them."""

    saved: bool = False

    def _parts(self) -> list[Parts]:
        raise NotImplementedError

    def _document(self) -> dict:
        return {"parts": [p.document() for p in self._parts()]}

    def _load(self, document: dict) -> None:
        for parts, found in zip(self._parts(), document["parts"], strict=True):
            parts.load(found)

    def _inserted(self, spark: SparkSession) -> None:
        """After an insert: a state that nobody saves has no use for what it replaced."""
        if not self.saved:
            for parts in self._parts():
                parts.prune(spark)

    def save(self, batch: int, folder: str) -> None:
        """Which batch was applied and where its state lies, in one small file written under a new name: both or neither. Former states go then."""
        spark = SparkSession.active()
        for parts in self._parts():
            parts.keep()
        log = spark.createDataFrame([(batch, json.dumps(self._document()))], "batch long, state string")
        path = f"{folder}/applied-{batch:012d}"
        log.coalesce(1).write.mode("overwrite").json(path)
        self.saved = True
        for parts in self._parts():
            parts.prune(spark)
        for old in scratch.found(spark, f"{folder}/applied-*"):
            if str(old.getPath().getName()) < f"applied-{batch:012d}":
                scratch.delete(spark, str(old.getPath()))

    def restore(self, folder: str) -> int:
        """The state of the last batch that was saved; its number, or -1."""
        spark = SparkSession.active()
        names = sorted(str(x.getPath().getParent()) for x in scratch.found(spark, f"{folder}/applied-*/_SUCCESS"))
        if not names:
            return -1
        last = spark.read.schema("batch long, state string").json(names[-1]).head()
        self._load(json.loads(last.state))
        self.saved = True
        return last.batch


@dataclass
class VoxelPoints(SavedMap):
    """Points by voxel: a point is kept unless its voxel is full or one kept before lies too near; voxels not touched for a while go."""

    spark: SparkSession
    resolution: float = 1.0
    least_distance: float = 0.1
    most_points: int = 20
    horizon: int = 10
    clear_cycle: int = 10
    inserts: int = 0
    parts: Parts = field(default_factory=lambda: Parts("voxel-points", schema=VoxelPoints.COLUMNS))
    touched: list[int] = field(default_factory=list)

    COLUMNS = "vkey long, point_id long, x double, y double, z double, seq long, lru long"

    @property
    def tables(self) -> dict[int, str]:
        return self.parts.tables

    @property
    def state(self) -> DataFrame | None:
        return self.parts.read(self.spark) if self.parts.tables else None

    def _parts(self) -> list[Parts]:
        return [self.parts]

    def _document(self) -> dict:
        return super()._document() | {"inserts": self.inserts}

    def _load(self, document: dict) -> None:
        super()._load(document)
        self.inserts = document["inserts"]

    def insert(self, points: DataFrame) -> VoxelPoints:
        """One batch. Within a voxel points come in the order of point_id; a voxel holds at most most_points.

        The points of a voxel come sorted, in frames of an Arrow batch's size, and only what is kept of a voxel is remembered while they pass: a voxel that
        gets very many points in one batch takes time in proportion, but no more memory.
        """
        self.inserts += 1
        now = self.inserts
        new = with_voxel(points, self.resolution).select("vkey", "point_id", *XYZ, F.lit(now).cast("long").alias("seq"), F.lit(now).cast("long").alias("lru"))
        new = cut(new, "batch")
        part = part_of_block(_block(self.resolution))
        clear = now % self.clear_cycle == 0
        self.touched = list(range(PARTS)) if clear else [r.part for r in new.select(part.alias("part")).distinct().collect()]  # PARTS rows at most
        hit = new.select("vkey").distinct().withColumn("_hit", F.lit(True))
        both = self.parts.read(self.spark, set(self.touched)).unionByName(new).join(hit, "vkey", "left")
        both = both.withColumn("lru", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("lru")).cast("long")).drop("_hit")
        if self.least_distance > 0:
            state = both.repartition("vkey").sortWithinPartitions("vkey", "seq", "point_id").mapInPandas(self._fold(now), self.COLUMNS)
        else:
            place = F.row_number().over(W.partitionBy("vkey").orderBy("seq", "point_id"))
            state = both.withColumn("_place", place).where(F.col("_place") <= self.most_points).drop("_place")
        if clear:
            state = state.where(F.col("lru") + self.horizon >= now)
        self.parts.write(state, part, self.touched)
        drop(new)
        self._inserted(self.spark)
        return self

    def _fold(self, now: int):
        d2, most = self.least_distance**2, self.most_points

        def thin(kept: np.ndarray, rest: np.ndarray) -> np.ndarray:
            """Which of the rest are kept, in their order, besides those kept already."""
            keep, n = np.zeros(len(rest), bool), len(kept)
            if n >= most:
                return keep
            alive = np.ones(len(rest), bool)
            for p in kept:
                alive &= ((rest - p) ** 2).sum(1) >= d2
            while n < most and (left := np.flatnonzero(alive)).size:
                keep[left[0]] = True
                alive[: left[0] + 1] = False
                alive &= ((rest - rest[left[0]]) ** 2).sum(1) >= d2
                n += 1
            return keep

        def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            voxel, kept = None, np.zeros((0, 3))
            for pdf in frames:
                if pdf.empty:
                    continue
                keys, old, xyz = pdf.vkey.to_numpy(), pdf.seq.to_numpy() < now, pdf[list(XYZ)].to_numpy()
                keep = old.copy()
                starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
                for a, z in zip(starts, starts[1:], strict=False):
                    if keys[a] != voxel:
                        voxel, kept = keys[a], np.zeros((0, 3))
                    fresh = a + int(old[a:z].sum())
                    kept = np.concatenate([kept, xyz[a:fresh]])
                    keep[fresh:z] = thin(kept, xyz[fresh:z])
                    kept = np.concatenate([kept, xyz[fresh:z][keep[fresh:z]]])
                yield pdf[keep]

        return fold

    def knn(self, queries: DataFrame, k: int, neighbourhood: int = 7) -> DataFrame:
        return knn_voxel(queries, self.state, k, self.resolution, neighbourhood)


def apply_batch(target: SavedMap, df: DataFrame, batch: int, folder: str) -> bool:
    """Insert a micro-batch unless it was applied before a restart or retry; whether it was inserted now."""
    if batch <= target.restore(folder):
        return False
    target.insert(df)
    target.save(batch, folder)
    return True


def map_stream(stream: DataFrame, target: SavedMap, checkpoint: str):
    """A streaming query that inserts each micro-batch of a stream of points, once: state and batch number are kept together below the
    checkpoint folder, which driver and executors share, so a retried batch changes nothing and a restarted query goes on from the state."""
    return stream.writeStream.foreachBatch(lambda df, batch: apply_batch(target, df, batch, f"{checkpoint}/map") and None).option("checkpointLocation", f"{checkpoint}/query")


voxel_points_stream = map_stream


@dataclass
class StreamedVoxelMap(SavedMap):
    """A Gaussian voxel map that grows: each batch's map is merged into the parts that its voxels fall into."""

    resolution: float
    parts: Parts = field(default_factory=lambda: Parts("voxelmap"))

    @property
    def state(self) -> DataFrame | None:
        return self.parts.read(SparkSession.active()) if self.parts.tables else None

    def _parts(self) -> list[Parts]:
        return [self.parts]

    def insert(self, points: DataFrame) -> StreamedVoxelMap:
        spark = points.sparkSession
        new = cut(gaussian_voxelmap(points, self.resolution), "batch-map")
        touched = [r.part for r in new.select(part_of().alias("part")).distinct().collect()]  # PARTS rows at most
        known = set(touched) & set(self.parts.tables)
        self.parts.write(merge_voxelmaps(self.parts.read(spark, known), new) if known else new, part_of(), touched)
        drop(new)
        self._inserted(spark)
        return self


def streaming_voxelmap(stream: DataFrame, resolution: float) -> DataFrame:
    """The same as a streaming aggregation, for complete or update mode."""
    keyed = with_voxel(stream, resolution)
    means = [F.avg(c).alias(f"m{c}") for c in XYZ]
    intensity = F.max("intensity") if "intensity" in stream.columns else F.lit(0.0)
    return keyed.groupBy("vx", "vy", "vz", "vkey").agg(F.count(F.lit(1)).alias("n"), *means, intensity.alias("intensity"))


@dataclass
class CovarianceMap(SavedMap):
    """Voxel points with covariances: young points, and invalid ones at ages that are powers of two times a base, are estimated anew; implausible covariances stay invalid, and old invalid points go.

    When each part of the points was touched is remembered; only parts that have points to estimate, or to let go, are read and rewritten, and the parts
    of the blocks of voxels round such points are read for their neighbours.
    """

    points: VoxelPoints
    k: int = 20
    least: int = 5
    warmup: int = 3
    base_age: int = 16
    forget: int = 64
    window: int = 10
    enough: int = 1024
    parts: Parts = field(default_factory=lambda: Parts("covariance-map"))
    history: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)
    births: dict[int, list[int]] = field(default_factory=dict)

    @property
    def state(self) -> DataFrame | None:
        return self.parts.read(self.points.spark) if self.parts.tables else None

    def _parts(self) -> list[Parts]:
        return [self.points.parts, self.parts]

    def _document(self) -> dict:
        history = [(n, list(map(float, s)), list(map(float, q))) for n, s, q in self.history]
        return super()._document() | {"inserts": self.points.inserts, "births": self.births, "history": history}

    def _load(self, document: dict) -> None:
        super()._load(document)
        self.points.inserts = document["inserts"]
        self.births = {int(k): v for k, v in document["births"].items()}
        self.history = [(n, np.array(s), np.array(q)) for n, s, q in document["history"]]

    def _is_due(self, age: int) -> bool:
        """Whether points of that age are estimated now, or have become too old to stay invalid."""
        doubled = age > 0 and age % self.base_age == 0 and (age // self.base_age).bit_count() == 1
        return age < self.warmup or doubled or age == self.forget + 1

    def insert(self, new: DataFrame) -> CovarianceMap:
        spark, points = self.points.spark, self.points
        points.saved = True  # what it replaces is pruned here, after both tables are written
        points.insert(new)
        now = points.inserts
        for part in points.touched:
            self.births.setdefault(part, []).append(now)
        last = max(self.forget + 1, self.warmup)
        oldest = 2 ** max(now // self.base_age, 1).bit_length() * self.base_age
        self.births = {k: [t for t in v if now - t <= max(last, oldest)] for k, v in self.births.items()}
        changed = {k for k, v in self.births.items() if any(self._is_due(now - t) for t in v)} | set(points.touched)
        known = points.parts.read(spark, changed).select("point_id", *XYZ, F.col("seq").alias("birth"), "vkey")
        if self.parts.tables:
            known = known.join(self.parts.read(spark, changed).select("point_id", "valid", *COV), "point_id", "left")
        else:
            known = known.select("*", F.lit(None).cast("boolean").alias("valid"), *[F.lit(None).cast("double").alias(c) for c in COV])
        known = cut(known.withColumn("valid", F.coalesce("valid", F.lit(False))), "known")
        age = F.lit(now) - F.col("birth")
        again = F.expr(f"({now} - birth) > 0 AND ({now} - birth) % {self.base_age} = 0 AND bit_count(CAST(({now} - birth) / {self.base_age} AS BIGINT)) = 1")
        due = known.where((age < self.warmup) | (~F.col("valid") & again))
        around = self._around(due)
        field_ = points.parts.read(spark, around).select("point_id", *XYZ)
        near = knn_voxel(as_queries(due), field_, self.k, points.resolution, 27)
        moments = features.neighbor_moments(near, field_).where(F.col("n") >= self.least).select(F.col("qid").alias("point_id"), *COV)
        judged = cut(moments.select("point_id", *COV, *[F.expr(e).alias(f"l{i}") for i, e in enumerate(E.eigenvalues(COV))]), "moments")
        stats = judged.agg(F.count(F.lit(1)).alias("n"), *[f(f"l{i}").alias(f"{name}{i}") for i in range(3) for name, f in (("s", F.sum), ("q", lambda c: F.sum(F.col(c) * F.col(c))))]).head()
        if stats.n:
            self.history = [*self.history, (stats.n, np.array([stats[f"s{i}"] for i in range(3)]), np.array([stats[f"q{i}"] for i in range(3)]))][-self.window :]
        n = sum(h[0] for h in self.history)
        plausible = F.lit(True)
        if n > self.enough:
            mean = sum(h[1] for h in self.history) / n
            std = np.sqrt(np.maximum(sum(h[2] for h in self.history) / n - mean**2, 0))
            for i in range(3):
                plausible = plausible & F.col(f"l{i}").between(float(mean[i] - std[i]), float(mean[i] + std[i]))
        fresh = judged.select("point_id", plausible.alias("ok"), *[F.col(c).alias(f"n{c}") for c in COV])
        joined = known.join(fresh, "point_id", "left")
        merged = joined.select("point_id", *XYZ, "birth", "vkey", F.coalesce("ok", "valid").alias("valid"), *[F.coalesce(f"n{c}", c).alias(c) for c in COV])
        kept = merged.where(F.col("valid") | (F.lit(now) - F.col("birth") <= self.forget))
        self.parts.write(kept, part_of_block(_block(points.resolution)), changed)
        drop(known)
        drop(judged)
        self._inserted(spark)
        return self

    def _around(self, due: DataFrame) -> set[int]:
        """The parts of the blocks of voxels in which the points' neighbours lie."""
        voxel = [F.expr(E.voxel(c, self.points.resolution)) for c in XYZ]
        steps = F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)])
        blocks = due.select(*[v.alias(f"v{c}") for c, v in zip(XYZ, voxel, strict=True)]).distinct()
        for c in XYZ:
            blocks = blocks.withColumn(f"s{c}", F.explode(steps)).withColumn(f"b{c}", F.shiftright(F.col(f"v{c}") + F.col(f"s{c}"), BLOCK_BITS)).drop(f"s{c}", f"v{c}").distinct()
        found = blocks.select(part_of_block([F.col(f"b{c}") for c in XYZ]).alias("part")).distinct()
        return {r.part for r in found.collect()}  # PARTS rows at most

    def valid(self) -> DataFrame:
        return self.state.where("valid")

    def knn(self, queries: DataFrame, k: int, force: bool = False) -> DataFrame:
        """Among points of valid covariance, or all with force."""
        return knn_voxel(queries, self.state if force else self.valid(), k, self.points.resolution, 27)


class SlidingWindow:
    """A list whose items keep their numbers while the oldest go."""

    def __init__(self) -> None:
        self.base, self.items = 0, []

    def append(self, item) -> int:
        self.items.append(item)
        return self.base + len(self.items) - 1

    def erase(self, index: int) -> None:
        self[index]
        self.items[index - self.base] = None
        while self.items and self.items[0] is None:
            self.items.pop(0)
            self.base += 1

    def __getitem__(self, index: int):
        if not self.base <= index < self.base + len(self.items):
            raise IndexError(index)
        return self.items[index - self.base]

    def __len__(self) -> int:
        return len(self.items)
