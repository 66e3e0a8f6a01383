"""The queue of captures as a stateful stream, and the current place of each log.

Captures and missions of a log come in one stream; a capture waits for its mission, by id or by an equal title accepted
near it in time, and is shown for review once: when it correlates, or has settled. While a review is open it is put off.
After TTL_MS it expires. Missions are remembered for `remember` ms, as captures are taken when a mission is accepted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline.operators.capture import NEAR_MS, SETTLE_MS, TTL_MS

#: What comes in: kind is capture (id, mission_id, title, ts, at: when it was queued), mission (id, title, ts: accepted;
#: at), opened or closed (a review; at).
INPUT = "key string, kind string, id string, mission_id string, title string, ts long, at long"
OUTCOME = "key string, pending_id string, state string, preselect_mission_id string"
PLACE = "key string, location string, changed boolean"
REMEMBER_MS = 600_000


def title_key(title: str | None) -> str:
    return " ".join((title or "").split()).lower()


def correlated(waiting: dict, missions: dict, near: int = NEAR_MS) -> str | None:
    """The mission of the capture's id, else the one of its title accepted nearest in time; the first of equally near ones."""
    if waiting["mission_id"] in missions:
        return waiting["mission_id"]
    want = title_key(waiting["title"])
    fits = [(abs(m["ts"] - waiting["ts"]), n, i) for n, (i, m) in enumerate(missions.items()) if want and m["ts"] is not None and waiting["ts"] is not None and title_key(m["title"]) == want]
    gap, _, found = min(fits, default=(near + 1, 0, None))
    return found if gap <= near else None


def step(state: dict, rows: Iterable[dict], now: int, remember: int = REMEMBER_MS) -> list[tuple[str, str, str | None]]:
    """Take in rows (INPUT, in order) and look at the queue at the time `now`. Returns (pending_id, state, mission to
    preselect): expired, review, deferred (once, until it is reviewed). Only a mission of the capture's own id is preselected."""
    waiting, missions = state.setdefault("waiting", {}), state.setdefault("missions", {})
    for r in rows:
        if r["kind"] == "capture":
            waiting.setdefault(r["id"], {"mission_id": r["mission_id"], "title": r["title"], "ts": r["ts"], "at": r["at"], "state": "new"})
        elif r["kind"] == "mission":
            missions.setdefault(r["id"], {}).update(title=r["title"], ts=r["ts"], at=r["at"])
        else:
            state["open"] = r["kind"] == "opened"
    out = []
    for pending, w in list(waiting.items()):
        if now - w["at"] >= TTL_MS:
            del waiting[pending]
            out.append((pending, "expired", None))
        elif w["state"] != "review" and (correlated(w, missions) or now - w["at"] >= SETTLE_MS):
            new = "deferred" if state.get("open") else "review"
            if new != w["state"]:
                w["state"] = new
                out.append((pending, new, w["mission_id"] if new == "review" and w["mission_id"] in missions else None))
    for i in [i for i, m in missions.items() if now - m["at"] >= remember]:
        del missions[i]
    return out


def next_look(state: dict) -> int | None:
    """When the queue changes by time alone."""
    return min((w["at"] + (SETTLE_MS if w["state"] == "new" else TTL_MS) for w in state["waiting"].values()), default=None)


class CaptureQueue(StatefulProcessor):
    """The queue of one log; timers look at it when nothing comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("queue", "state string")

    def _look(self, key: str, rows: list[dict], now: int) -> pd.DataFrame:
        state = json.loads(self.held.get()[0]) if self.held.exists() else {}
        out = step(state, rows, now)
        if state["waiting"] or state["missions"] or state.get("open"):
            self.held.update((json.dumps(state),))
        else:
            self.held.clear()
        at = next_look(state)
        if at is not None:
            self.handle.registerTimer(max(at, now + 1))
        return pd.DataFrame([(key, *x) for x in out], columns=["key", "pending_id", "state", "preselect_mission_id"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        whole = pd.concat(rows)
        whole = whole.astype(object).where(whole.notna(), None)
        # of one time missions come before the captures that look for them
        order = sorted(whole.to_dict("records"), key=lambda r: (r["at"], r["kind"] == "capture", r["id"] or ""))
        plain = [{k: int(v) if k in ("ts", "at") and v is not None else v for k, v in r.items()} for r in order]
        yield self._look(key[0], plain, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._look(key[0], [], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def reconcile_stream(captures: DataFrame, missions: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """OUTCOME of streams of captures (key, id, mission_id, title, ts, at), missions (key, id, title, ts, at) and, where there
    are, openings and closings of reviews (key, kind, at)."""
    names = [c.split(" ") for c in INPUT.split(", ")]
    wide = lambda df, kind: df.select(*[(F.lit(kind) if c == "kind" and kind else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in names])
    both = wide(captures, "capture").unionByName(wide(missions, "mission"))
    both = both.unionByName(wide(reviews, None)) if reviews is not None else both
    return both.groupBy("key").transformWithStateInPandas(CaptureQueue(), OUTCOME, "Append", "processingTime")


class CurrentPlace(StatefulProcessor):
    """The last place of each key; a row a change. Rows: key, seq, location."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "location string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = self.place.get()[0] if self.place.exists() else None
        out = []
        for location in pd.concat(rows).sort_values("seq")["location"]:
            if isinstance(location, str) and location.strip() and location != now:
                now = location
                out.append((key[0], location, True))
        if now is not None:
            self.place.update((now,))
        yield pd.DataFrame(out, columns=["key", "location", "changed"])

    def close(self) -> None:
        pass


def current_places(places: DataFrame) -> DataFrame:
    return places.groupBy("key").transformWithStateInPandas(CurrentPlace(), PLACE, "Append", "None")
