"""Poses and inertial values of a trajectory at other times, as a command:

python -m pointloom.interpolate IN OUT_POSES OUT_IMU [--start S] [--end E] [--step D] [--stamps FILE] [--interval KNOTS] [--smoothness S]

IN and the poses are text of `t x y z qx qy qz qw`; a negative start, end or interval is taken from the input (its first or last stamp, its median gap).
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import lie
from .operators.stats import stamp_gaps
from .plans.trajectory import arange_timestamps, fit_knots
from .sources.files import POSE_COLUMNS, read_timestamps, read_tum, write_imu, write_tum


#: Poses of one trajectory (some 300 bytes each with its knots) that the driver fits at once.
MOST_POSES = 1_000_000


def interpolate(spark: SparkSession, source: str, poses: str, imu: str, start: float = -1.0, end: float = -1.0, step: float = 0.1, stamps: str | None = None, interval: float = -1.0, smoothness: float = 1e-3) -> int:
    """The number of stamps with an unusual gap before them. A trajectory's poses are the driver's, who fits the knots, at most MOST_POSES; the stamps asked are a table."""
    given = read_tum(spark, source)
    gaps = stamp_gaps(given.select("ts"), "ts")
    rows = given.orderBy("ts").limit(MOST_POSES + 1).collect()
    if len(rows) > MOST_POSES:
        raise ValueError(f"{source} has more than {MOST_POSES} poses; interpolate it in parts")
    if len(rows) < 2:
        raise ValueError(f"too few poses in {source}")
    times = np.array([r.ts for r in rows])
    found = [lie.pose(lie.from_quaternion(np.array([r.qx, r.qy, r.qz, r.qw])), np.array([r.tx, r.ty, r.tz])) for r in rows]
    if interval < 0:
        dts = np.sort(np.diff(times))
        interval = float(dts[len(dts) // 2])
    traj = fit_knots(times, found, interval, smoothness)
    asked = read_timestamps(spark, stamps) if stamps else arange_timestamps(spark, start, end, step, (times[0], times[-1])).withColumnRenamed("stamp", "ts")
    out = traj.evaluate(asked)
    write_tum(out.select("ts", *POSE_COLUMNS), poses)
    write_imu(out, imu)
    return gaps.where(F.col("anomaly")).count()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("source", "poses", "imu"):
        p.add_argument(name)
    for name, value in (("start", -1.0), ("end", -1.0), ("step", 0.1), ("interval", -1.0), ("smoothness", 1e-3)):
        p.add_argument(f"--{name}", type=float, default=value)
    p.add_argument("--stamps")
    odd = interpolate(SparkSession.builder.getOrCreate(), **vars(p.parse_args(argv)))
    if odd:
        print(f"{odd} stamps have an unusual gap before them")


if __name__ == "__main__":
    main()
