"""Stops, constraints and the order of a route. Problems are independent, so they are spread by their key; the search
inside a problem is sequential, on the stops of one ship."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.scalars import confident_location

ORDER = "problem_id string, stop_id string, place int, total_distance double, has_missing boolean, infeasible boolean"
EPSILON = 1e-9


def stops(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs of open missions that aren't done."""
    mine = missions.filter(F.col("status").isin("accepted", "in_progress")).select(F.col("id").alias("mission_id"))
    return legs.filter(~F.col("completed")).join(mine, "mission_id", "left_semi").select(
        F.concat_ws(":", "mission_id", "objective_id").alias("stop_id"), "kind", "location", "pos_x", "pos_y", "pos_z", "commodity", F.col("scu_total").alias("scu"), "mission_id", F.col("objective_id").alias("leg_id")
    )


def start_position(stops: DataFrame, current: Column) -> DataFrame:
    """The position of the first stop at the current place."""
    here = stops.filter(F.col("pos_x").isNotNull() & confident_location(current, F.col("location")))
    return here.groupBy("problem_id").agg(F.min_by(F.struct(F.col("pos_x").alias("x"), F.col("pos_y").alias("y"), F.col("pos_z").alias("z")), "stop_id").alias("start"))


def path_distance(visits: DataFrame, by: str = "problem_id", order: str = "place") -> DataFrame:
    """by, distance over the stops that have a position, in order."""
    known = visits.filter("pos_x IS NOT NULL AND pos_y IS NOT NULL AND pos_z IS NOT NULL")
    w = Window.partitionBy(by).orderBy(order)
    steps = [F.col(c) - F.lag(c).over(w) for c in ("pos_x", "pos_y", "pos_z")]
    return known.select(by, F.sqrt(sum((s * s for s in steps[1:]), steps[0] * steps[0])).alias("d")).groupBy(by).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance"))


def running_load(visits: DataFrame, by: str = "problem_id", order: str = "place") -> DataFrame:
    """Each stop with the load after it: pickups add, dropoffs take away, never below nothing. The sum less its least
    value so far, where that is negative, is the clamped sum."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("kind") == "pickup", F.col("scu")).otherwise(-F.col("scu"))
    total = visits.withColumn("__s", F.sum(signed).over(w))
    return total.withColumn("load", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).cast("long")).drop("__s")


def capacity_ok(visits: DataFrame, capacity: int, by: str = "problem_id") -> DataFrame:
    loads = running_load(visits, by).groupBy(by).agg(F.max(F.when(F.col("kind") == "pickup", F.col("load"))).alias("m"))
    return loads.select(by, (F.lit(capacity <= 0) | (F.coalesce("m", F.lit(0)) <= capacity)).alias("ok"))


def precedence_ok(visits: DataFrame, pairs: DataFrame, by: str = "problem_id") -> DataFrame:
    """pairs: by, dropoff, pickup (stop ids). Whether each pickup comes before its dropoff."""
    at = visits.select(by, "stop_id", "place")
    d, p = at.withColumnRenamed("stop_id", "dropoff").withColumnRenamed("place", "d"), at.withColumnRenamed("stop_id", "pickup").withColumnRenamed("place", "p")
    bad = pairs.join(d, [by, "dropoff"]).join(p, [by, "pickup"]).groupBy(by).agg(F.max((F.col("p") >= F.col("d")).cast("int")).alias("bad"))
    return visits.select(by).distinct().join(bad, by, "left").select(by, (F.coalesce("bad", F.lit(0)) == 0).alias("ok"))


class Problem:
    """Stops of one ship as arrays, in the order of their ids; an order is an array of their numbers.

    A turn of the stretch i..j is weighed for all j at once: the way changes only at the stretch's ends; a pickup may not
    stand with its dropoff inside (of every place the last of its pickups is kept, so its greatest value up to j tells);
    and as long as no load is clamped at nothing, the highest load inside is a difference of prefix sums. Where a clamp
    may act, the turned order's loads are summed up anew.
    """

    def __init__(self, stops: list[dict], capacity: float = 0, start: tuple[float, float, float] | None = None):
        self.capacity, self.start = capacity, None if start is None else np.array(start, float)
        stops = sorted(stops, key=lambda s: s["stop_id"])
        self.ids = [s["stop_id"] for s in stops]
        self.point = np.array([[np.nan if s[f"pos_{c}"] is None else s[f"pos_{c}"] for c in "xyz"] for s in stops], float).reshape(-1, 3)
        self.pickup = np.array([s["kind"] == "pickup" for s in stops], bool)
        self.scu = np.array([s["scu"] for s in stops], float)
        self.weight = np.where(self.pickup, self.scu, -self.scu)
        self.known = ~np.isnan(self.point).any(axis=1)
        self.drop, self.pick = self._pairs(stops)

    def _pairs(self, stops: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Dropoffs with each of the pickups they need, in the order of the dropoffs; both have a position."""
        by_mission: dict = {}
        for n, s in enumerate(stops):
            if self.known[n]:
                by_mission.setdefault(s["mission_id"], ([], []))[0 if s["kind"] == "pickup" else 1].append((n, s["commodity"]))
        pairs = [(d, p) for picks, drops in by_mission.values() for d, dc in drops for p, pc in picks if not pc or not dc or pc == dc]
        out = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = self.point[b] - (self.point[a] if a.dtype.kind == "i" else a)
        return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])

    def length(self, order: np.ndarray) -> float:
        first = self._far(self.start, order[:1]).sum() if self.start is not None else 0.0
        return float(first + self._far(order[:-1], order[1:]).sum())

    def fits(self, order: np.ndarray) -> bool:
        if not self.capacity > 0 or not len(order):
            return True
        sums = np.cumsum(self.weight[order])
        loads = sums - np.minimum(0, np.minimum.accumulate(sums))
        return not (self.pickup[order] & (loads > self.capacity)).any()

    def seed(self) -> np.ndarray:
        """The nearest stop that may be visited next; one that would overload the ship, or lacks a pickup, only at last."""
        left, out, load, now = np.flatnonzero(self.known), [], 0.0, self.start
        waits = np.bincount(self.drop, minlength=len(self.ids))
        follow = np.argsort(self.pick, kind="stable")
        edges = np.searchsorted(self.pick[follow], np.arange(len(self.ids) + 1))
        while len(left):
            room = ~self.pickup[left] | (not self.capacity > 0) | (load + self.scu[left] <= self.capacity)
            tier = np.where(waits[left] > 0, 2, np.where(room, 0, 1))
            far = self._far(now, left) if now is not None else np.zeros(len(left))
            best = np.flatnonzero(tier == tier.min())
            at = best[np.argmin(far[best])]  # the first, so the least id
            n = left[at]
            left = np.delete(left, at)
            out.append(n)
            load = load + self.scu[n] if self.pickup[n] else max(0.0, load - self.scu[n])
            now = self.point[n]
            np.subtract.at(waits, self.drop[follow[edges[n] : edges[n + 1]]], 1)
        return np.array(out, np.int64)

    def _last_pick(self, order: np.ndarray) -> np.ndarray:
        """Of each place in the order the last place of a pickup that its stop needs; -1 if it needs none."""
        place = np.full(len(self.ids), -1)
        place[order] = np.arange(len(order))
        out = np.full(len(order), -1)
        np.maximum.at(out, place[self.drop], place[self.pick])
        return out

    def improved(self, order: np.ndarray) -> np.ndarray:
        """Stretches are turned round as long as that shortens the way and breaks nothing, the first that does."""
        n, turned, rounds = len(order), True, 0
        while turned and rounds <= n * n:
            turned, rounds = False, rounds + 1
            last_pick = self._last_pick(order)
            for i in range(n - 1):
                j = i + 1
                while j < n and (found := self._turn(order, last_pick, i, j)) is not None:
                    order, j, turned = np.concatenate([order[:i], order[i : found + 1][::-1], order[found + 1 :]]), found + 1, True
                    last_pick = self._last_pick(order)
        return order

    def _turn(self, order: np.ndarray, last_pick: np.ndarray, i: int, j: int) -> int | None:
        """The first place from j on up to which the order from i on can be turned."""
        within = np.flatnonzero(np.maximum.accumulate(last_pick[i:]) >= i)
        end = i + within[0] if len(within) else len(order)  # a stretch up to here would hold a pickup and its dropoff
        if end <= j:
            return None
        ends = order[j:end]
        after = order[j + 1 : end + 1]
        before = self.start if i == 0 else self.point[order[i - 1]]
        now = np.zeros(len(ends))
        then = np.zeros(len(ends))
        if before is not None:
            now += self._far(before, order[i : i + 1])
            then += self._far(before, ends)
        now[: len(after)] += self._far(ends[: len(after)], after)
        then[: len(after)] += self._far(self.point[order[i]], after)
        shorter = np.flatnonzero(then < now - EPSILON)
        if not len(shorter) or not self.capacity > 0:
            return j + int(shorter[0]) if len(shorter) else None
        sums = np.concatenate([[0.0], np.cumsum(self.weight[order])])
        plain = sums.min() >= 0 and sums.max() <= self.capacity  # no clamp acts now, and all fits
        high = sums[i] + sums[j + 1 : end + 1] - np.minimum.accumulate(sums[i:end])[j - i :]
        low = sums[i] + sums[j + 1 : end + 1] - np.maximum.accumulate(sums[i:end])[j - i :]
        for k in shorter.tolist():
            if plain and low[k] >= 0:
                good = high[k] <= self.capacity
            else:
                good = self.fits(np.concatenate([order[:i], order[i : j + k + 1][::-1], order[j + k + 1 :]]))
            if good:
                return j + k
        return None

    def solved(self) -> tuple[list[str], float, bool, bool]:
        order = np.flatnonzero(self.known)
        order = self.improved(self.seed()) if len(order) > 1 else order
        missing = np.flatnonzero(~self.known)
        too_big = self.capacity > 0 and (self.pickup & (self.scu > self.capacity)).any()
        return [self.ids[n] for n in [*order, *missing]], self.length(order), bool(len(missing)), bool(too_big or not self.fits(order))


def optimized(stops: DataFrame, capacity: int = 0) -> DataFrame:
    """problem_id, stop_id, place, total_distance, has_missing, infeasible. stops: the columns of stops() and problem_id,
    and start_x, start_y, start_z if there is a start."""
    started = "start_x" in stops.columns

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        start = tuple(float(first[f"start_{c}"]) for c in "xyz") if started and not pd.isna(first["start_x"]) else None
        order, length, missing, infeasible = Problem(group.to_dict("records"), capacity, start).solved()
        return pd.DataFrame([(first["problem_id"], s, i, length, missing, infeasible) for i, s in enumerate(order)], columns=[c.split()[0] for c in ORDER.split(", ")])

    return stops.groupBy("problem_id").applyInPandas(solve, ORDER)


def visit_order(visits: DataFrame) -> DataFrame:
    """problem_id, location, number: places numbered in the order in which they are first visited."""
    first = visits.filter("location IS NOT NULL").groupBy("problem_id", "location").agg(F.min("place").alias("first"))
    return first.select("problem_id", "location", F.row_number().over(Window.partitionBy("problem_id").orderBy("first")).alias("number"))


def next_stops(groups: DataFrame, numbers: DataFrame) -> DataFrame:
    """stop_groups that aren't done, by the route's numbering, then in their own order; lines by what is left."""
    todo = groups.filter("NOT all_done AND state = 'todo'")
    return todo.join(numbers.select("location", "number"), "location", "left").orderBy(F.asc_nulls_last("number"), F.desc("needs_location"), F.desc("group_remaining"), "location", F.desc("scu"))
