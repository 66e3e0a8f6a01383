"""Missions kept up to date from a stream of log lines, at the cost of what a batch brings.

Lines are numbered, parsed and landed as a table of events, a folder a batch that a repeated batch overwrites. A second
query reads that table as it grows and holds one folded state a mission: of each field the first or last value and its
seq, of each leg the same, the times of completions. Every rule is a minimum or maximum over seq, so the
state doesn't depend on how events are split into batches or in which order they come, an event that comes again changes
nothing, and no old event is read. The missions that a batch touches are upserted into keyed tables, which are flipped
to their next version as a whole. A damaged bucket of these is rebuilt from the events of its own missions.

The state of a mission grows with its legs, completions and changes of declared sizes, and is kept for good, as later
events of a mission must find it; it lies in the state store, on disk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline import schemas
from ledgerline.functions import logparse as P
from ledgerline.operators.reduce import reduce_events, with_title_places
from ledgerline.sources.logs import numbered
from ledgerline.sources.scratch import written
from ledgerline.sources.store import KeyedTable

LEG = f"{schemas.LEGS}, first_seq long, done_seq long"
FOLDED = f"{schemas.MISSIONS}, legs array<struct<{', '.join(c.replace(' ', ':', 1) for c in LEG.split(', '))}>>"
#: What the fold reads of an event.
FOLD_INPUT = ("mission_id", "seq", "source", "type", "ts", "objective_id", "kind", "title", "title_pickup", "title_dropoff", "giver", "contract_template", "contract_definition_id", "variant", "grade", "token", "x", "y", "z", "commodity", "scu_total", "location", "completion_type")


def land_events(lines: DataFrame, path: str, trigger: dict | None = None) -> StreamingQuery:
    """Start the query that lands the events of LANDED lines under path/events."""

    def land(batch: DataFrame, batch_id: int) -> None:
        events = P.with_events(numbered(batch, batch_id)).drop("file")
        events.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", f"{path}/checkpoint-events")
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events that have landed."""
    return spark.read.schema(schemas.EVENTS).option("recursiveFileLookup", "true").parquet(f"{path}/events")


def fold(state: dict, e) -> dict:
    """The state after an event; a state begins as {}."""
    seq = int(e.seq)

    def first(of: dict, name: str, value) -> None:
        if value is not None and (name not in of or seq < of[name][0]):
            of[name] = [seq, value]

    def last(of: dict, name: str, value) -> None:
        if value is not None and (name not in of or seq > of[name][0]):
            of[name] = [seq, value]

    first(state, "born", [e.type, int(e.ts)])
    if e.source == "live":
        state["live"] = True
    if e.type == "missionAccepted":
        first(state, "title", e.title or None)
        first(state, "accepted", int(e.ts))
        first(state, "title_pickup", e.title_pickup)
        first(state, "title_dropoff", e.title_dropoff)
    elif e.type == "missionMarker":
        last(state, "marker", [e.giver, e.contract_template, e.variant, e.grade])
        last(state, "contract_definition_id", e.contract_definition_id)
    elif e.type == "missionEnded":
        last(state, "end", [e.completion_type, int(e.ts)])
        if e.completion_type == "complete":
            last(state, "finished", True)
    if e.objective_id is not None:
        leg = state.setdefault("legs", {}).setdefault(e.objective_id, {})
        first(leg, "born", True)
        last(leg, "kind", e.kind)
        if e.type == "objectiveDeclared":
            last(leg, "commodity", e.commodity or None)
            last(leg, "location", e.location)
            if pd.notna(e.scu_total):
                leg["sizes"] = sorted({**dict(leg.get("sizes", [])), seq: int(e.scu_total)}.items())
        elif e.type == "missionMarker":
            first(leg, "token", e.token or None)
            last(leg, "position", None if pd.isna(e.x) else [e.x, e.y, e.z])
        elif e.type == "objectiveCompleted":
            first(leg, "done", True)
            last(leg, "redone", True)
            state["done"] = sorted({**dict(state.get("done", [])), seq: int(e.ts)}.items())
    return state


def running(state: dict) -> tuple[str, int | None]:
    """Status by the legs at the last completion, and the time since when it is complete."""
    status, since = "accepted", None
    legs = state.get("legs", {}).values()
    for seq, ts in state.get("done", []):
        here = sum(leg["born"][0] <= seq for leg in legs)
        closed = sum("done" in leg and leg["done"][0] <= seq for leg in legs)
        if here and here == closed:
            since = ts if since is None else since
            status = "complete"
        else:
            since, status = None, "in_progress" if closed else "accepted"
    return status, since


def mission_of(mission_id: str, state: dict) -> dict:
    """A row of FOLDED."""
    of = lambda d, name: d[name][1] if name in d else None
    legs = []
    for objective, leg in sorted(state.get("legs", {}).items()):
        ended = state["finished"][0] if "finished" in state and leg["born"][0] < state["finished"][0] else None
        at = max((x for x in (leg["redone"][0] if "redone" in leg else None, ended) if x is not None), default=None)
        sizes = leg.get("sizes", [])
        x, y, z = of(leg, "position") or (None, None, None)
        legs.append(
            {
                "mission_id": mission_id, "objective_id": objective, "kind": of(leg, "kind") or "dropoff", "commodity": of(leg, "commodity") or of(leg, "token") or "", "scu_total": sizes[-1][1] if sizes else 0,
                "scu_delivered": next((n for s, n in reversed(sizes) if at is not None and s < at), 0), "location": of(leg, "location"), "pos_x": x, "pos_y": y, "pos_z": z, "completed": at is not None,
                "manual_override": None, "first_seq": leg["born"][0], "done_seq": leg["done"][0] if "done" in leg else None,
            }
        )
    status, since = running(state)
    end = of(state, "end")
    giver, template, variant, grade = of(state, "marker") or (None, None, "MANUAL", "UNKNOWN")
    kind, ts = state["born"][1]
    return {
        "id": mission_id, "title": of(state, "title") or "", "giver": giver, "variant": variant, "grade": grade, "contract_template": template, "contract_definition_id": of(state, "contract_definition_id"),
        "status": ("complete" if end[0] == "complete" else "abandoned") if end else status, "payout": None, "payout_confidence": None, "reward": None, "source": "log",
        "accepted_at": ts if kind in ("missionAccepted", "missionMarker") else of(state, "accepted"), "completed_at": end[1] if end else since, "notes": None, "created_seq": state["born"][0],
        "title_pickup": of(state, "title_pickup"), "title_dropoff": of(state, "title_dropoff"), "session": "live" if state.get("live") else "historical", "terminal_source": "game" if end else None, "legs": legs,
    }


class MissionFold(StatefulProcessor):
    """The folded state of each mission; a row of FOLDED for each mission that a batch touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.folded = handle.getValueState("folded", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = json.loads(self.folded.get()[0]) if self.folded.exists() else {}
        for batch in rows:
            whole = batch.astype(object).where(batch.notna(), None)
            for e in whole.itertuples(index=False):
                state = fold(state, e)
        self.folded.update((json.dumps(state),))
        out = pd.DataFrame([mission_of(key[0], state)])
        for c in ("payout", "reward", "accepted_at", "completed_at", "created_seq"):
            out[c] = out[c].astype("Int64")
        yield out

    def close(self) -> None:
        pass


def folded_missions(events: DataFrame) -> DataFrame:
    """FOLDED rows of a stream of schemas.EVENTS, one for each mission and batch that touches it."""
    template = F.col("contract_template")
    token = F.nullif(P.commodity_name(P.commodity_token(template)), F.lit(""))
    mine = events.filter("mission_id IS NOT NULL").select("*", P.stored_variant(template).alias("variant"), P.stored_grade(template).alias("grade"), token.alias("token"), *[F.col("position")[c].alias(c) for c in "xyz"])
    return mine.select(*FOLD_INPUT).groupBy("mission_id").transformWithStateInPandas(MissionFold(), FOLDED, "Update", "None")


def tables(spark: SparkSession, path: str, buckets: int = 64) -> tuple[KeyedTable, KeyedTable]:
    """missions, and legs in the buckets of their missions (a mission's legs are one row, so that they change as a whole)."""
    kept = f"{path}/missions-table"
    legs = f"id string, legs array<struct<{', '.join(c.replace(' ', ':', 1) for c in LEG.split(', '))}>>"
    return KeyedTable(spark, kept, schemas.MISSIONS, ("id",), buckets), KeyedTable(spark, f"{path}/legs-table", legs, ("id",), buckets)


def _placed(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """missions, and id with legs, whose places the title may give."""
    missions = folded.select(*[c.split(" ")[0] for c in schemas.MISSIONS.split(", ")])
    legs = with_title_places(missions, folded.select(F.inline("legs")))
    return missions, _gathered(missions, legs)


def _gathered(missions: DataFrame, legs: DataFrame) -> DataFrame:
    rows = legs.groupBy(F.col("mission_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*[c.split(" ")[0] for c in LEG.split(", ")]))).alias("legs"))
    return missions.select("id").join(rows, "id", "left")


def keep_missions(spark: SparkSession, path: str, trigger: dict | None = None, max_files: int = 1000) -> StreamingQuery:
    """Start the query that keeps the mission tables under path from the events landed there."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        missions, legs = _placed(written(batch, "folded"))
        for table, rows in zip(tables(spark, path), (missions, legs), strict=True):
            table.upsert(rows, batch_id)

    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").rpartition(".")[2] != "RocksDBStateStoreProvider":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    fs, where = tables(spark, path)[0]._fs(f"{path}/events")
    fs.mkdirs(where)  # nothing may have landed yet
    events = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(f"{path}/events")
    writer = folded_missions(events).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint-missions")
    return (writer.trigger(**trigger) if trigger else writer).start()


def current(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """missions and legs as of the last batch."""
    missions, legs = (t.read() for t in tables(spark, path))
    return missions, legs.select(F.inline("legs"))


def rebuild(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Check the tables; damaged buckets are made anew from the events of their missions. Returns the buckets."""
    missions, legs = tables(spark, path)

    def made(buckets: list[int]) -> tuple[DataFrame, DataFrame]:
        bucket = F.pmod(F.xxhash64("mission_id"), F.lit(missions.buckets)).cast("int")  # as of the tables' key
        mine = read_events(spark, path).filter(bucket.isin(buckets)).dropDuplicates(["seq"])
        whole, places, _, _ = reduce_events(mine)
        whole = written(whole, "rebuilt")
        return whole, _gathered(whole, places)

    return {"missions": missions.rebuild(lambda b: made(b)[0]), "legs": legs.rebuild(lambda b: made(b)[1])}


def awards_stream(lines: DataFrame) -> DataFrame:
    """Awards, once each, as they come: repeated (amount, ts) pairs are dropped from state. lines: logs.LINES or LANDED."""
    events = P.with_events(lines)
    return events.filter("type = 'payoutAwarded'").select("amount", "ts").dropDuplicates(["amount", "ts"])
