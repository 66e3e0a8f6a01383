"""Recognised contracts: word boxes to lines, objectives to legs, and the queue of captures that wait for their mission."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise
from statistics import median
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import leg_key
from ledgerline.operators.correlate import nearest_missions

#: Shares of a word's height, of the page's width; labels of rows that cross both columns; times in ms.
ROW_SHARE, MARGIN_SHARE, GUTTER_SHARE, ROWS_A_SIDE = 0.6, 0.03, 0.08, 2
WIDE_LABELS = ["REWARD", "PAYOUT", "PAY", "CONTRACT", "CONTRACTED", "DEADLINE", "BONUS"]
SETTLE_MS, TTL_MS, NEAR_MS = 3000, 60_000, 30_000


def loosely(text: str, label: str) -> bool:
    """Equal by their letters, or one is the other's beginning and a letter short of the label at most."""
    upper = text.upper()
    if label[0] not in upper:
        return False
    letters = "".join(c for c in upper if "A" <= c <= "Z")
    short, long = sorted((letters, label), key=len)
    return bool(letters) and (letters == label or (long.startswith(short) and len(short) >= len(label) - 1))


class Word(NamedTuple):
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    cx: float
    cy: float


BOX = Word._fields[:5]
_last = lambda x: (x != x, x)  # noqa: E731  not a number: at the end


class Page:
    def __init__(self, words: Iterable[tuple] | pd.DataFrame):
        """words: text, x0, y0, x1, y1 each. Those without a text don't count."""
        rows = words[list(BOX)].itertuples(index=False, name=None) if isinstance(words, pd.DataFrame) else words
        self.words = [Word(t, a, b, c, d, (a + c) / 2, (b + d) / 2) for t, a, b, c, d in rows if isinstance(t, str) and t]

    @staticmethod
    def tolerance(w: list[Word]) -> float:
        heights = [h for x in w if (h := x.y1 - x.y0) > 0]
        return max(1.0, (median(heights) if heights else 0.0) * ROW_SHARE)

    @classmethod
    def rows(cls, w: list[Word]) -> list[list[Word]]:
        """Words whose centre is near that of a row's first word, rows from the top."""
        near, rows, first = cls.tolerance(w), [], None
        for x in sorted(w, key=lambda x: _last(x.cy)):
            if first is None or abs(x.cy - first) > near:
                rows.append([])
                first = x.cy
            rows[-1].append(x)
        return [sorted(r, key=lambda x: _last(x.x0)) for r in rows]

    @staticmethod
    def joined(row: list[Word]) -> str:
        return " ".join(" ".join([x.text for x in row]).split())

    @classmethod
    def lines(cls, w: list[Word]) -> list[str]:
        return [t for r in cls.rows(w) if (t := cls.joined(r))] if w else []

    def anchor(self) -> tuple[float, float] | None:
        """Left edge and top of the heading over the objectives."""
        heads = [x for x in self.words if loosely(x.text, "OBJECTIVES")]
        firsts = [x for x in self.words if loosely(x.text, "PRIMARY")] if heads else []
        for h in heads:
            for p in firsts:
                if abs(p.cy - h.cy) <= max(1.0, (h.y1 - h.y0) * ROW_SHARE) and p.x0 < h.x0:
                    return p.x0, min(p.y0, h.y0)
        return (heads[0].x0, heads[0].y0) if heads else None

    def header(self, w: list[Word], edge: float) -> list[str]:
        """Title first, then rows under wide labels, then what stands right of the edge."""
        title, wide, right = [], [], []
        for row in self.rows(w):
            a, b = [x for x in row if x.cx < edge], [x for x in row if x.cx >= edge]
            labelled = any(loosely(row[0].text, x) for x in WIDE_LABELS)
            if a and b and not labelled:
                title.append(self.joined(a))
                right.append(self.joined(b))
            elif row[0].cx < edge:
                (wide if labelled else title).append(self.joined(row))
            else:
                right.append(self.joined(row))
        return [x for x in [" ".join(" ".join(title).split()), *wide, *right] if x]

    def gutter(self, width: float) -> float | None:
        """The middle of the widest gap, if it is wide enough and parts two columns of rows."""
        centres = sorted(x.cx for x in self.words)
        if len(centres) < 2:
            return None
        i = max(range(len(centres) - 1), key=lambda i: centres[i + 1] - centres[i])
        middle = (centres[i] + centres[i + 1]) / 2
        if not centres[i + 1] - centres[i] >= width * GUTTER_SHARE:
            return None

        def count(w: list[Word]) -> int:
            near, ys = self.tolerance(w), sorted(x.cy for x in w)
            return 1 + sum(b - a > near for a, b in pairwise(ys)) if w else 0

        sides = [x for x in self.words if x.cx < middle], [x for x in self.words if x.cx >= middle]
        return middle if min(map(count, sides)) >= ROWS_A_SIDE else None

    def objectives(self, width: float) -> str:
        if found := self.anchor():
            edge, top = found
            body = [x for x in self.words if x.cy >= top and x.cx >= edge - width * MARGIN_SHARE]
            return "\n".join(self.header([x for x in self.words if x.cy < top], edge) + self.lines(body))
        middle = self.gutter(width)
        return "\n".join(self.lines(self.words if middle is None else [x for x in self.words if x.cx >= middle]))


def objectives_columns(pages: DataFrame) -> DataFrame:
    """pages with text, the lines of the column with the objectives, instead of their words: an array of structs of text,
    x0, y0, x1, y1, in this order. img_w is a page's width. A page is a row; a task has the words of one at a time."""
    kept = [c for c in pages.columns if c not in ("img_w", "words")]
    words = F.col("words").cast(f"array<struct<text: string, {', '.join(f'{c}: double' for c in BOX[1:])}>>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, widths = batch.column("words"), batch.column("img_w").to_pylist()
            texts = []
            for i, width in enumerate(widths):
                fields = found[i].values.flatten() if found[i].is_valid else []
                page = Page(zip(fields[0].to_pylist(), *[x.to_numpy(zero_copy_only=False).tolist() for x in fields[1:]], strict=True) if fields else [])
                texts.append(page.objectives(width) if page.words else "")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["text string"])
    return pages.select(*kept, F.col("img_w").cast("double").alias("img_w"), words.alias("words")).mapInArrow(work, schema)


def objectives_column(words: DataFrame) -> DataFrame:
    """page_id, text of pages that come as a row a word. A page is a few hundred words."""
    pages = words.groupBy("page_id").agg(F.first("img_w").alias("img_w"), F.collect_list(F.struct(*BOX)).alias("words"))
    return objectives_columns(pages)


TIERS = [(True, "full"), (True, "same"), (True, "blank"), (True, "any"), (False, "full"), (False, "same"), (False, "any")]
APPLIED = "mission_id string, objective_id string, kind string, commodity string, scu_total long, location string, action string"


def _match(leg: dict, o: dict, how: str) -> bool:
    low = lambda x: (x or "").strip().lower()
    same = (leg["commodity"] or "").lower() == (o["commodity"] or "").lower()
    return {"full": low(leg["commodity"]) == low(o["commodity"]) and low(leg["location"]) == low(o["location"]), "same": same, "blank": not low(leg["commodity"]), "any": True}[how]


def assigned(legs: list[dict], objectives: list[dict], at: int) -> list[tuple]:
    """Objectives to the open legs without override, the best tier first, each leg once; the rest are inserted, and hand
    made legs that none took are pruned."""
    free = [x for x in legs if not x["completed"] and x["manual_override"] is None]
    manual = lambda x: x["objective_id"].startswith("manual_")
    out, ids = [], {x["objective_id"] for x in legs}
    for n, o in enumerate(objectives):
        same = [x for x in free if x["kind"] == o["kind"]]
        pick = next((x for real, how in TIERS for x in same if (not real or not manual(x)) and _match(x, o, how)), None)
        known = o["scu"] is not None and o["scu"] > 0
        if pick:
            free.remove(pick)
            out.append((pick["mission_id"], pick["objective_id"], pick["kind"], o["commodity"] or pick["commodity"], int(o["scu"]) if known else int(pick["scu_total"]), o["location"] or pick["location"], "filled"))
        else:
            k = n
            while (new := f"manual_{o['kind']}_{at}_{k}") in ids:
                k += 1
            ids.add(new)
            out.append((o["mission_id"], new, o["kind"], o["commodity"], int(o["scu"]) if known else 0, o["location"] or None, "inserted"))
    return out + [(x["mission_id"], x["objective_id"], x["kind"], x["commodity"], int(x["scu_total"]), x["location"], "pruned") for x in free if manual(x)]


#: Rows of missions that a task holds as Python values at a time.
AT_ONCE = 500


def applied_objectives(legs: DataFrame, objectives: DataFrame, at: int) -> DataFrame:
    """What becomes of each leg or objective: filled, inserted or pruned. objectives: mission_id, pos, kind, commodity,
    scu, location; pickups of one key are merged before (rollups.deduped_pickups). A mission's legs and objectives, a
    bounded handful, meet as two arrays of one row, which tasks take in batches."""
    leg = F.struct("mission_id", "objective_id", "kind", "commodity", "scu_total", "location", "completed", "manual_override")
    both = legs.select("mission_id", leg.alias("leg"), F.lit(None).alias("o")).unionByName(objectives.select("mission_id", F.lit(None).alias("leg"), F.struct("mission_id", "pos", "kind", "commodity", "scu", "location").alias("o")))
    rows = both.groupBy("mission_id").agg(F.collect_list("leg").alias("legs"), F.collect_list("o").alias("objectives")).filter(F.size("objectives") > 0)
    names = [c.split()[0] for c in APPLIED.split(", ")]
    order = lambda c: lambda x: (x[c] is None, x[c])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if c == "scu_total" else pa.string()) for c in names])
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                out = [x for r in batch.slice(i, AT_ONCE).to_pylist() for x in assigned(sorted(r["legs"], key=order("objective_id")), sorted(r["objectives"], key=order("pos")), at)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.select("legs", "objectives").mapInArrow(work, APPLIED)


def reconciled(pending: DataFrame, missions: DataFrame, now: int, review_open: bool = False) -> DataFrame:
    """pending (pending_id, mission_id, title, ts, enqueued_at, reviewed_once) with `state`: expired, kept, review, deferred."""
    found = nearest_missions(pending, missions, NEAR_MS)
    age = F.lit(now) - F.col("enqueued_at")
    ready = F.col("match").isNotNull() | (age >= SETTLE_MS)
    return pending.join(found, "pending_id", "left").withColumn(
        "state", F.when(age >= TTL_MS, "expired").when(F.col("reviewed_once"), "kept").when(ready, "deferred" if review_open else "review").otherwise("kept")
    )


def adopted(legs: DataFrame, declared: DataFrame) -> DataFrame:
    """legs in which hand made ones take the id of a declared objective (mission_id, objective_id, kind, commodity,
    location) of their key that has no leg yet; the first of several."""
    key = leg_key(F.col("kind"), F.col("commodity"), F.col("location"))
    new = declared.join(legs.select("mission_id", "objective_id"), ["mission_id", "objective_id"], "left_anti").select("mission_id", key.alias("key"), F.col("objective_id").alias("real"))
    hand = legs.filter(F.col("objective_id").startswith("manual_")).select("mission_id", key.alias("key"), "objective_id")
    pairs = hand.groupBy("mission_id", "key").agg(F.min("objective_id").alias("objective_id")).join(new.groupBy("mission_id", "key").agg(F.min("real").alias("real")), ["mission_id", "key"]).drop("key")
    return legs.join(pairs, ["mission_id", "objective_id"], "left").withColumn("objective_id", F.coalesce("real", "objective_id")).drop("real").select(*legs.columns)
