"""Payouts and the missions they pay: awards, in order of arrival, each claim the oldest unpaid completion of their window.

In a log that is written in order of time the claims are a queue: completions are numbered as they arrive, and all that
an award has to know is the number p of the first one that no earlier award has taken or passed. With a the number of
completions that have left the window and b of those that have arrived, it takes max(p, a) if that is below b, so that
p becomes min(max(p, a) + 1, b) in either case. Steps of that form compose: any run of awards is one function
min(max(p + c, low), high). So a log is cut into ranges of time of about RANGE_ROWS rows wherever that may be, each range is
folded into its three numbers, the ranges' numbers are run through in order (a row a range), and then every range knows
its own p and is worked out by itself. Completions that no award can find are left out before. A log whose events are still
not in order of time is cut only at gaps longer than the window, and each cluster between gaps is one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.scalars import is_hauling_giver
from ledgerline.operators.reduce import reduce_events
from ledgerline.sources.scratch import written

WINDOW_MS = 2000
ROW = "mission_id string, amount long, ts long, seq long, confidence string"
FAR = 1 << 62
#: About how many rows of a log a range has, which is what a task holds at a time.
RANGE_ROWS = 50_000


def claims(timeline: pd.DataFrame, window: int = WINDOW_MS) -> pd.DataFrame:
    """ROW of each award and of each completion that an award left over, from one cluster: rows with a mission_id are
    completions, the others awards. The award that finds one completion confirms it, whatever was said of it before."""
    done = timeline[timeline["mission_id"].notna()].sort_values(["ts", "seq", "mission_id"])
    unpaid = list(zip(done["mission_id"], done["seq"], strict=True))
    times = done["ts"].tolist()
    paid: set[str] = set()
    left: dict[str, None] = {}
    out = []
    for amount, ts, seq in timeline[timeline["mission_id"].isna()].sort_values("seq")[["amount", "ts", "seq"]].itertuples(index=False):
        near = [m for m, s in unpaid[bisect_left(times, ts - window) : bisect_right(times, ts)] if m not in paid and s < seq]
        out.append((near[0] if near else None, int(amount), ts, seq, "unknown" if not near else "confirmed" if len(near) == 1 else "approximate"))
        paid.update(near[:1])
        left |= dict.fromkeys(near)
    out += [(m, None, None, None, "approximate") for m in left if m not in paid]
    return pd.DataFrame(out, columns=["mission_id", "amount", "ts", "seq", "confidence"]).astype({"amount": "Int64", "ts": "Int64", "seq": "Int64"})


def _clusters(events: DataFrame, window: int, by: tuple[str, ...]) -> DataFrame:
    """Claims of logs in any order, cut at gaps between time cells of a window's length, of which only the first and
    last event is needed."""
    events = events.withColumn("__cell", F.floor(F.col("ts") / max(window, 1)))
    cells = events.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(by)], F.col("__cell").alias("__at")).agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    order = Window.partitionBy(*[f"__{i}" for i in range(len(by))]).orderBy("__at")
    gap = (F.col("__first") - F.lag("__last").over(order) > window).cast("int")
    cluster = F.sum(F.coalesce(gap, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__cell") == F.col("__at")
    for i, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    grouped = events.join(cells.withColumn("cluster", cluster), same).select(*by, "cluster", "mission_id", "ts", "seq", "amount")

    def work(x: pd.DataFrame) -> pd.DataFrame:
        out = claims(x, window)
        for i, k in enumerate(by):
            out.insert(i, k, x[k].iloc[0])
        return out

    return grouped.groupBy(*by, "cluster").applyInPandas(work, _schema(events, by, ROW))


def _schema(df: DataFrame, by: tuple[str, ...], rest: str) -> str:
    return ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by] + [rest])


def _counted(x: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A range in its order; of each of its rows how many completions have left, have arrived, and how many awards were before."""
    x = x.sort_values(["ts", "late", "seq", "mission_id"], na_position="first")
    award = x["mission_id"].isna().to_numpy()
    late = x["late"].to_numpy() == 1
    start = x[["gone", "come", "awards"]].iloc[0].tolist()
    gone, come, awards = (int(s) + np.cumsum(k) - k for s, k in zip(start, (late, ~award & ~late, award), strict=True))
    return x, gone, come, awards


def fold(x: pd.DataFrame) -> tuple[int, int, int]:
    """c, low, high of a range's awards."""
    x, gone, come, _ = _counted(x)
    award = x["mission_id"].isna().to_numpy()
    c, low, high = 0, -FAR, FAR
    for a, b in zip(gone[award].tolist(), come[award].tolist(), strict=True):
        c, low, high = c + 1, min(max(low, a) + 1, b), min(max(high, a) + 1, b)
    return c, low, high


def replay(x: pd.DataFrame, p: int) -> pd.DataFrame:
    """Rows of number, mission_id, amount, ts, seq, near (unpaid ones that an award found), born, died (awards before)."""
    x, gone, come, awards = _counted(x)
    mission, late = x["mission_id"].tolist(), (x["late"] == 1).tolist()
    rows = []
    for i, (m, left, amount, ts, seq) in enumerate(zip(mission, late, x["amount"].tolist(), x["ts"].tolist(), x["seq"].tolist(), strict=True)):
        if pd.isna(m):
            at, near = max(p, int(gone[i])), int(come[i]) - max(p, int(gone[i]))
            rows.append((at if near > 0 else None, None, int(amount), ts, seq, near, None, None))
            p = at + (near > 0)
        else:
            rows.append((int(gone[i] if left else come[i]), m, None, None, None, None, *((None, int(awards[i])) if left else (int(awards[i]), None))))
    return pd.DataFrame(rows, columns=REPLAYED).astype({c: "Int64" for c in REPLAYED if c != "mission_id"})


REPLAYED = ["number", "mission_id", "amount", "ts", "seq", "near", "born", "died"]


def _in_reach(done: DataFrame, asked: DataFrame, window: int, by: tuple[str, ...]) -> DataFrame:
    """Completions but for those that no award can find: none of the awards of their time cell and the next one arrives
    after them. Such a completion has no effect, wherever it stands."""
    cell = F.floor(F.col("ts") / max(window, 1))
    last = asked.select(*by, F.explode(F.array(cell, cell - 1)).alias("__cell"), F.col("seq").alias("__last")).groupBy(*by, "__cell").agg(F.max("__last").alias("__last"))
    return _beside(done.withColumn("__cell", cell), last, [*by, "__cell"]).filter("seq IS NULL OR seq < __last").drop("__cell", "__last")


def claim_rows(awards: DataFrame, missions: DataFrame, window: int = WINDOW_MS, by: tuple[str, ...] = ()) -> DataFrame:
    """The log's columns (`by`; one log without) and ROW: every award, once for each amount and time, with the mission it
    pays (none: other income), and without an amount the missions that an award left over.

    Candidates are missions that the game completed and a hauling giver gave, of no payout yet, at completed_at; they
    arrive at end_seq (missing: before all awards).
    """
    ended = missions.filter((F.col("status") == "complete") & (F.col("terminal_source") == "game") & is_hauling_giver(F.col("giver")) & F.col("completed_at").isNotNull())
    if "payout" in missions.columns:
        ended = ended.filter("payout IS NULL")
    seq = F.col("end_seq") if "end_seq" in missions.columns else F.lit(-1).cast("long")
    none = F.lit(None)
    done = ended.select(*by, F.col("completed_at").cast("long").alias("ts"), F.lit(0).alias("late"), seq.cast("long").alias("seq"), F.col("id").cast("string").alias("mission_id"), none.cast("long").alias("amount"))
    once = awards.filter("ts IS NOT NULL AND amount IS NOT NULL").groupBy(*by, F.col("amount").cast("long").alias("amount"), F.col("ts").cast("long").alias("ts")).agg(F.min("seq").cast("long").alias("seq"))
    asked = once.select(*by, "ts", F.lit(0).alias("late"), "seq", none.cast("string").alias("mission_id"), "amount")
    done = _in_reach(done, asked, window, by)
    both = written(done.unionByName(asked), "claims-rows")
    late = both.filter("mission_id IS NOT NULL").withColumn("ts", F.col("ts") + window).withColumn("late", F.lit(1))
    both = both.unionByName(late)
    ranges = max(both.sparkSession.sparkContext.defaultParallelism, -(-both.count() // RANGE_ROWS))
    timeline = written(both.repartitionByRange(ranges, *by, "ts", "late", "seq", "mission_id").withColumn("part", F.spark_partition_id()), "claims-timeline")
    keys = [*by, "part"]

    late, award = F.col("late") == 1, F.col("mission_id").isNull()
    count = lambda x: F.sum(x.cast("long"))
    sizes = timeline.groupBy(*keys).agg(count(late).alias("__gone"), count(~late & ~award).alias("__come"), count(award).alias("__awards"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select(*keys, *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(c) for c in ("gone", "come", "awards")]), "claims-offsets")
    with_offsets = _beside(timeline, offsets, keys)

    def folded(x: pd.DataFrame) -> pd.DataFrame:
        seqs = x[x["late"] == 0].sort_values(["ts", "seq"])["seq"]
        first, last = (int(seqs.iloc[i]) if len(seqs) else None for i in (0, -1))
        ordered = bool((seqs.diff().iloc[1:] > 0).all())
        return pd.DataFrame([(*x[keys].iloc[0], *fold(x), ordered, first, last)], columns=[*keys, "c", "low", "high", "ordered", "first", "last"]).astype({"first": "Int64", "last": "Int64"})

    functions = with_offsets.groupBy(*keys).applyInPandas(folded, _schema(timeline, tuple(keys), "c long, low long, high long, ordered boolean, first long, last long"))

    def started(x: pd.DataFrame) -> pd.DataFrame:
        p, seen, ordered, rows = 0, None, True, []
        for r in x.sort_values("part").itertuples(index=False):
            rows.append(p)
            p = min(max(p + r.c, r.low), r.high)
            ordered &= bool(r.ordered) and (seen is None or pd.isna(r.first) or r.first > seen)
            seen = seen if pd.isna(r.last) else r.last
        return x.sort_values("part")[keys].assign(p=rows, in_order=ordered)

    starts = functions.groupBy(*by)  # a row a range
    starts = written(starts.applyInPandas(started, _schema(timeline, tuple(keys), "p long, in_order boolean")), "claims-starts")
    held = _beside(with_offsets, starts.filter("in_order"), keys)

    def worked(x: pd.DataFrame) -> pd.DataFrame:
        out = replay(x, int(x["p"].iloc[0]))
        for i, k in enumerate(by):
            out.insert(i, k, x[k].iloc[0])
        return out

    rows = held.groupBy(*keys).applyInPandas(worked, _schema(timeline, by, "number long, mission_id string, amount long, ts long, seq long, near long, born long, died long"))
    met = rows.filter("number IS NOT NULL").groupBy(*by, "number").agg(*[F.max(c).alias(c) for c in REPLAYED[1:]])
    sure = F.when(F.col("amount").isNull(), F.when(F.col("died") > F.col("born"), "approximate")).when(F.col("near") == 1, "confirmed").otherwise("approximate")
    columns = [*by, "mission_id", "amount", "ts", "seq"]
    out = met.select(*columns, sure.alias("confidence")).filter("confidence IS NOT NULL")
    out = out.unionByName(rows.filter("number IS NULL").select(*columns, F.lit("unknown").alias("confidence")))
    odd = starts.filter("NOT in_order").select(*by).distinct() if by else starts.filter("NOT in_order").limit(1)
    if odd.isEmpty():
        return out
    rest = timeline.filter("late = 0")
    return out.unionByName(_clusters(_beside(rest, written(odd, "claims-odd"), list(by), "left_semi") if by else rest, window, by))


def _beside(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with a table of a row a key, of which null is one."""
    other = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(other, same, how).drop(*[f"__{k}" for k in keys])


def attributed(awards: DataFrame, missions: DataFrame, window: int = WINDOW_MS, by: tuple[str, ...] = ()) -> DataFrame:
    """mission_id, payout, payout_confidence."""
    rows = claim_rows(awards, missions, window, by).filter("mission_id IS NOT NULL")
    return rows.select("mission_id", F.col("amount").alias("payout"), F.col("confidence").alias("payout_confidence"))


def ledger(awards: DataFrame, missions: DataFrame, window: int = WINDOW_MS, by: tuple[str, ...] = ()) -> DataFrame:
    """The earnings: amount, ts, mission_id, confidence (`unknown` where no mission is paid)."""
    return claim_rows(awards, missions, window, by).filter("amount IS NOT NULL").select(*by, "amount", "ts", "mission_id", "confidence")


def other_income(awards: DataFrame, missions: DataFrame, window: int = WINDOW_MS, by: tuple[str, ...] = ()) -> DataFrame:
    """Awards that found no unpaid completion of a hauling mission in their window."""
    return ledger(awards, missions, window, by).filter("mission_id IS NULL").select(*by, "amount", "ts")


def with_payouts(missions: DataFrame, payouts: DataFrame) -> DataFrame:
    """missions with the attributed payouts where they had none."""
    new = payouts.select(F.col("mission_id").alias("id"), F.col("payout").alias("__p"), F.col("payout_confidence").alias("__c"))
    kept = F.col("payout").isNotNull()
    return missions.join(new, "id", "left").withColumn("payout_confidence", F.when(kept, F.col("payout_confidence")).otherwise(F.coalesce("__c", "payout_confidence"))).withColumn("payout", F.coalesce("payout", "__p")).select(*missions.columns)


def settled(missions: DataFrame, events: DataFrame, awards: DataFrame, window: int = WINDOW_MS) -> tuple[DataFrame, DataFrame]:
    """The reducer's missions with their payouts, and the earnings ledger. events: of the same log, for the arrival of ends."""
    ends = events.filter("type = 'missionEnded'").groupBy(F.col("mission_id").alias("id")).agg(F.max("seq").alias("end_seq"))
    rows = written(claim_rows(awards, missions.join(ends, "id", "left"), window), "claims")
    payouts = rows.filter("mission_id IS NOT NULL").select("mission_id", F.col("amount").alias("payout"), F.col("confidence").alias("payout_confidence"))
    return with_payouts(missions, payouts), rows.filter("amount IS NOT NULL").select("amount", "ts", "mission_id", "confidence")


def settled_log(events: DataFrame, window: int = WINDOW_MS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """missions with their payouts, legs, the earnings ledger and fines of one log's events."""
    events = written(events, "claims-events")
    missions, legs, awards, fines = reduce_events(events)
    missions, earnings = settled(written(missions, "claims-missions"), events, awards, window)
    return missions, legs, earnings, fines
