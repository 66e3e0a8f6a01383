"""Events applied to stored missions and legs, under who has the last word.

What the game ended is ended; what the user ended stays unless the game ends it; what only the legs say is worked out
again at each completion. A leg that the user has edited keeps its commodity, size, place and progress from events of
old logs, not from live ones; the end of a mission completes all its legs all the same. A leg that the user added by
hand is taken over by the first declared objective of its kind, commodity and place. As in the reducer every rule is an
ordered aggregate over events that meets the stored row once. Stored rows and events are dealt by mission once, in as many
parts as their rows need; every aggregate, meeting and window after that works within these parts, sorted, without
another shuffle.

Also what was decided: which missions and legs are new, which legs changed, what was skipped and why.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline import schemas
from ledgerline.functions import logparse as P
from ledgerline.functions.scalars import leg_key
from ledgerline.operators.reduce import first_of, last_of, with_title_places
from ledgerline.sources.scratch import FILE_ROWS, written
from ledgerline.sources.sizes import parts_of

MISSION = [c.split(" ")[0] for c in schemas.MISSIONS.split(", ")]
LEG = [c.split(" ")[0] for c in schemas.LEGS.split(", ")]
DECISION = "kind string, what string, mission_id string, objective_id string, reason string, n long"
KEYS = ["mission_id", "objective_id"]
#: Objective ids of legs that the user added.
BY_HAND = "manual_"


class Replayed(NamedTuple):
    missions: DataFrame
    legs: DataFrame
    decisions: DataFrame


def _merged(own: DataFrame, said: DataFrame, *keys: str) -> DataFrame:
    """own full joined with said (a row a key) on keys, where both are dealt to parts by the first of them: a full join
    would forget that and what follows would shuffle again. own has `stored`, which is null in rows only told of. A row
    of said without all its keys meets none."""
    rows = own.unionByName(said, allowMissingColumns=True)
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).isNotNull()
    over = Window.partitionBy(*keys)
    told = {c: F.when(met | F.col("stored").isNull(), F.first(c, ignorenulls=True).over(over)).alias(c) for c in said.columns if c not in keys}
    rows = rows.select(*[told.get(c, F.col(c)) for c in rows.columns], F.max("stored").over(over).alias("__has"), met.alias("__met"))
    return rows.filter("stored OR NOT __met OR __has IS NULL").drop("__has", "__met")


def _said(events: DataFrame, parts: int, whole: bool) -> DataFrame:
    """What the events of a mission say of each objective, dealt by mission, as `e`: first_seq, new (whether it begins as
    declared), key, end_seq, and of all events (`_all`) and of those that an edited leg follows (`_free`): done; if whole,
    also kind, position, guarded (events that an edited leg is kept from), and of both: commodity, token, scu, location,
    moved (the size told last before the leg was done last), redone. Without objective_id: only end_seq."""
    ended = (F.col("type") == "missionEnded") & (F.col("completion_type") == "complete")
    declared, marker, closed = F.col("type") == "objectiveDeclared", F.col("type") == "missionMarker", F.col("type") == "objectiveCompleted"
    what = F.when(declared, 1).when(marker, 2).when(closed, 3).when(ended, 4).when(F.col("type").isNotNull(), 0).cast("byte").alias("what")
    token = F.nullif(P.commodity_name(P.commodity_token(F.col("contract_template"))), F.lit(""))
    key = F.when(declared, leg_key(F.col("kind"), F.col("commodity"), F.col("location"))).alias("key")
    mine = events.filter(F.col("mission_id").isNotNull() & (F.col("objective_id").isNotNull() | ended))
    mine = mine.select(*KEYS, "seq", what, (F.col("source") == "historical").alias("old"), *(["kind", "commodity", "scu_total", "location", "position", F.when(marker, token).alias("token")] if whole else [key])).repartition(parts, "mission_id")
    declared, marker, closed, old = F.col("what") == 1, F.col("what") == 2, F.col("what") == 3, F.col("old")
    key = F.when(declared, leg_key(F.col("kind"), F.col("commodity"), F.col("location"))) if whole else F.col("key")
    free = {"all": F.lit(True), "free": ~old}
    ending = F.when(F.col("what") == 4, F.col("seq"))
    values = {"first_seq": F.min("seq"), "new": F.min_by(declared, "seq"), "key": F.min_by(key, "seq"), "end_seq": F.max(ending)}
    values |= {f"done_{v}": F.min(F.when(closed & ok, F.col("seq"))) for v, ok in free.items()}
    if whole:
        each, mission = Window.partitionBy(*KEYS), Window.partitionBy("mission_id")
        mine = mine.select("*", *[F.max(F.when(closed & ok, F.col("seq"))).over(each).alias(f"redone_{v}") for v, ok in free.items()])
        mine = mine.withColumn("end_seq", F.max(ending).over(mission))
        values |= {"end_seq": F.max("end_seq"), "kind": last_of(F.col("kind")), "position": last_of(F.col("position"), marker), "guarded": F.sum((old & ~marker).cast("long"))}
        for v, ok in free.items():
            before = F.col("seq") < F.greatest(f"redone_{v}", "end_seq")
            of = {
                "commodity": last_of(F.nullif(F.col("commodity"), F.lit("")), declared & ok), "token": first_of(F.col("token"), ok), "scu": last_of(F.col("scu_total"), declared & ok),
                "location": last_of(F.col("location"), declared & ok), "moved": last_of(F.col("scu_total"), declared & ok & before), "redone": F.max(f"redone_{v}"),
            }
            values |= {f"{name}_{v}": c for name, c in of.items()}
    return mine.groupBy(*KEYS).agg(*[c.alias(name) for name, c in values.items()]).select(*KEYS, F.struct(*values).alias("e"))


def _adopted(rows: DataFrame) -> DataFrame:
    """Declared objectives that no event and no stored leg has named before, in order, take over the legs by hand of their
    mission, kind, commodity and place, in the order of these legs' ids. What events say of such a leg's own id is another leg."""
    new = F.col("stored").isNull() & F.col("e.new") & F.col("objective_id").isNotNull()
    rows = rows.withColumn("role", F.when(F.col("mission_id").isNull(), None).when(F.col("hand").isNotNull(), 1).when(new, 2)).withColumn("key", F.coalesce("hand", F.when(F.col("role") == 2, F.col("e.key"))))
    by_hand, fresh = F.col("role") == 1, F.col("role") == 2
    order = Window.partitionBy("mission_id", "key", "role").orderBy(F.when(fresh, F.col("e.first_seq")), F.when(by_hand, F.col("objective_id")))
    rows = rows.withColumn("place", F.when(F.col("role").isNotNull(), F.row_number().over(order)))
    pair = Window.partitionBy("mission_id", "key", "place")
    rows = rows.select("*", F.when(by_hand, F.max(fresh).over(pair)).alias("gone"), F.when(fresh, F.first(F.when(by_hand, F.col("own")), ignorenulls=True).over(pair)).alias("taken"))
    own = F.coalesce("taken", F.when(~F.coalesce("gone", F.lit(False)), F.col("own")))
    return rows.select(*KEYS, own.alias("own"), "e", "end_seq")


def _met(legs: DataFrame, events: DataFrame, parts: int, whole: bool = True) -> DataFrame:
    """All legs, dealt by mission: `own` as stored and `e` as told, of which one can be null, after legs by hand are taken
    over. Not whole: what the running status needs."""
    hand = F.when(F.col("objective_id").startswith(BY_HAND), leg_key(F.col("kind"), F.col("commodity"), F.col("location"))).alias("hand")
    fields = LEG[2:] if whole else ["completed", "manual_override"]
    own = legs.select(*KEYS, *fields, hand).repartition(parts, "mission_id").select(*KEYS, F.struct(*fields).alias("own"), "hand", F.lit(True).alias("stored"))
    rows = _merged(own, _said(events, parts, whole), *KEYS)
    rows = rows.withColumn("end_seq", F.when(F.col("mission_id").isNotNull(), F.max("e.end_seq").over(Window.partitionBy("mission_id"))))
    return _adopted(rows).filter("own IS NOT NULL OR (objective_id IS NOT NULL AND e IS NOT NULL)")


def _e(name: str) -> Column:
    """What the events say that this leg follows."""
    return F.when(F.col("own.manual_override").isNotNull(), F.col(f"e.{name}_free")).otherwise(F.col(f"e.{name}_all"))


def _legs(met: DataFrame) -> DataFrame:
    """All legs after the events, dealt by mission: LEG, stored, changed, guarded."""
    o = lambda c: F.col(f"own.{c}")
    stored = F.col("own").isNotNull()
    both = met.withColumn("at", F.greatest(_e("redone"), F.when(stored | (F.col("e.first_seq") < F.col("end_seq")), F.col("end_seq"))))
    done = F.coalesce(o("completed"), F.lit(False)) | F.col("at").isNotNull()
    delivered = F.when(F.col("at").isNull(), F.coalesce(o("scu_delivered"), F.lit(0))).otherwise(F.coalesce(_e("moved"), o("scu_total"), F.lit(0)))
    new = {
        "kind": F.coalesce("e.kind", o("kind"), F.lit("dropoff")), "commodity": F.coalesce(_e("commodity"), F.nullif(o("commodity"), F.lit("")), _e("token"), F.lit("")), "scu_total": F.coalesce(_e("scu"), o("scu_total"), F.lit(0)).cast("long"),
        "scu_delivered": delivered.cast("long"), "location": F.coalesce(_e("location"), o("location")), **{f"pos_{c}": F.coalesce(F.col("e.position")[c], o(f"pos_{c}")) for c in "xyz"}, "completed": done, "manual_override": o("manual_override"),
    }
    after = F.struct(*[new[c].alias(c) for c in LEG[2:]])
    guarded = F.when(o("manual_override").isNotNull(), F.coalesce("e.guarded", F.lit(0))).otherwise(0)
    return both.select(*KEYS, *[new[c].alias(c) for c in LEG[2:]], stored.alias("stored"), (stored & ~F.col("own").eqNullSafe(after)).alias("changed"), guarded.alias("guarded"))


def _running(events: DataFrame, met: DataFrame, parts: int) -> DataFrame:
    """mission_id, status at the last completion, since (the first completion of the last run of complete ones), broken
    (whether a completion before that run found the mission incomplete)."""
    zero, none = F.lit(0), F.lit(None)
    moment = lambda seq, ts, leg, done, look: [seq.alias("seq"), ts.cast("long").alias("ts"), leg.alias("leg"), done.cast("int").alias("done"), F.lit(look).alias("look")]
    closed = events.filter("type = 'objectiveCompleted' AND mission_id IS NOT NULL").select("mission_id", *moment(F.col("seq"), F.col("ts"), zero, zero, True)).repartition(parts, "mission_id")
    start, was_done = F.when(F.col("own").isNotNull(), F.lit(-(1 << 62))).otherwise(F.col("e.first_seq")), F.coalesce("own.completed", F.lit(False))
    born = F.struct(*moment(start, none, F.lit(1), was_done, False))
    done = F.when(_e("done").isNotNull() & ~was_done, F.struct(*moment(_e("done"), none, zero, F.lit(1), False)))
    changes = met.select("mission_id", F.inline(F.array(born, done))).filter("look IS NOT NULL")
    order = Window.partitionBy("mission_id").orderBy("seq", "look").rowsBetween(Window.unboundedPreceding, 0)
    seen = closed.unionByName(changes).withColumn("legs", F.sum("leg").over(order)).withColumn("closed", F.sum("done").over(order)).filter("look")
    state = seen.withColumn("all", (F.col("legs") > 0) & (F.col("legs") == F.col("closed")))
    over = Window.partitionBy("mission_id")
    state = state.withColumn("broken", F.max(F.when(~F.col("all"), F.col("seq"))).over(over))
    tail = F.col("all") & (F.col("seq") > F.coalesce("broken", F.lit(-(1 << 62))))
    out = state.groupBy("mission_id").agg(F.max_by("all", "seq").alias("last"), F.max_by("closed", "seq").alias("n"), F.min_by(F.when(tail, F.col("ts")), F.when(tail, F.col("seq"))).alias("since"), F.max("broken").isNotNull().alias("broken"))
    return out.select(F.col("mission_id").alias("id"), F.when(F.col("last"), "complete").when(F.col("n") > 0, "in_progress").otherwise("accepted").alias("running"), "since", "broken")


def _told(missions: DataFrame, events: DataFrame, parts: int) -> DataFrame:
    """Stored missions and what the events say of each, dealt by mission."""
    accepted, marker, ended = (F.col("type") == t for t in ("missionAccepted", "missionMarker", "missionEnded"))
    mine = events.filter("mission_id IS NOT NULL").withColumnRenamed("mission_id", "id")
    tells = F.coalesce(accepted | marker | ended, F.lit(False))
    live = (F.col("source") == "live").cast("int").alias("live")
    tell = mine.filter(tells).select("id", "seq", "type", "ts", live, "title", "title_pickup", "title_dropoff", "giver", "contract_template", "contract_definition_id", "completion_type").repartition(parts, "id")
    rest = mine.filter(~tells).select("id", "seq", F.lit("").alias("type"), live).repartition(parts, "id")  # only when, and whether live
    said = tell.unionByName(rest, allowMissingColumns=True).groupBy("id").agg(
        first_of(F.nullif("title", F.lit("")), accepted).alias("e_title"), last_of(F.struct("giver", "contract_template"), marker).alias("m"), last_of(F.col("contract_definition_id"), marker).alias("e_definition"),
        F.min_by(F.when(accepted | marker, F.col("ts")), "seq").alias("begun"), first_of(F.col("ts"), accepted).alias("e_accepted"), first_of(F.col("title_pickup"), accepted).alias("e_pickup"), first_of(F.col("title_dropoff"), accepted).alias("e_dropoff"),
        F.max("live").alias("live"), F.min("seq").alias("said_seq"), last_of(F.struct("completion_type", "ts"), ended).alias("end"), F.sum(accepted.cast("long")).alias("accepts"), F.min_by(accepted.cast("long"), "seq").alias("opened"),
    )
    return _merged(missions.select(*MISSION, F.lit(True).alias("stored")).repartition(parts, "id"), said, "id")


def _routes(missions: DataFrame, events: DataFrame, parts: int) -> DataFrame:
    """id, variant, title_pickup, title_dropoff of missions of which a title is told, where the titles name a place."""
    accepted, marker = F.col("type") == "missionAccepted", F.col("type") == "missionMarker"
    titled = events.filter("mission_id IS NOT NULL").filter(accepted | marker).select(F.col("mission_id").alias("id"), "seq", "type", "contract_template", F.col("title_pickup").alias("pickup"), F.col("title_dropoff").alias("dropoff")).repartition(parts, "id")
    titled = titled.groupBy("id").agg(F.max_by(F.when(marker, F.col("contract_template")), F.when(marker, F.col("seq"))).alias("template"), first_of(F.col("pickup"), accepted).alias("pickup"), first_of(F.col("dropoff"), accepted).alias("dropoff"))
    own = missions.select("id", "variant", "title_pickup", "title_dropoff").repartition(parts, "id")
    return titled.join(own, "id", "left").select(
        "id", _variant(F.col("template")).alias("variant"), F.coalesce("title_pickup", "pickup").alias("title_pickup"), F.coalesce("title_dropoff", "dropoff").alias("title_dropoff")
    ).filter("title_pickup IS NOT NULL OR title_dropoff IS NOT NULL")


def _variant(template: Column) -> Column:
    return F.when(template.isNotNull(), P.stored_variant(template)).otherwise(F.coalesce("variant", F.lit("MANUAL")))


def replayed(missions: DataFrame, legs: DataFrame, events: DataFrame) -> Replayed:
    """missions (schemas.MISSIONS) and legs (schemas.LEGS) after the events (schemas.EVENTS), in order of seq.

    A mission or leg that is not stored begins with its first event. created_seq of new missions follows the stored ones.
    Running this again over its own result changes nothing but what a later event of the same kind would have changed.
    Events are written out; each of the three tables is worked out when it is read.
    """
    events = written(events, "replay-events", FILE_ROWS)
    parts = parts_of(events.sparkSession, events.count() + legs.count())
    whole = _legs(_met(legs, events, parts))
    told = _told(missions, events, parts)
    base = missions.agg(F.coalesce(F.max("created_seq"), F.lit(-1)).alias("base"))
    both = told.join(_running(events, _met(legs, events, parts, whole=False), parts), "id", "left").crossJoin(F.broadcast(base))  # one row
    stored, over = F.coalesce("stored", F.lit(False)), F.col("end").isNotNull()
    sticky = F.coalesce(F.col("terminal_source").isin("game", "manual"), F.lit(False))
    template = F.col("m.contract_template")
    status = F.when(over & (F.col("end.completion_type") == "complete"), "complete").when(over, "abandoned").when(sticky | F.col("running").isNull(), F.coalesce("status", F.lit("accepted"))).otherwise(F.col("running"))
    kept_run = F.when((F.col("status") == "complete") & ~F.col("broken"), F.col("completed_at")).when(F.col("broken"), F.col("since")).otherwise(F.coalesce("completed_at", "since"))
    completed = F.when(over, F.col("end.ts")).when(sticky | F.col("running").isNull(), F.col("completed_at")).when(F.col("running") == "complete", kept_run)
    new = {
        "id": F.col("id"), "title": F.coalesce(F.nullif("title", F.lit("")), "e_title", F.lit("")), "giver": F.when(F.col("m").isNull(), F.col("giver")).otherwise(F.col("m.giver")),
        "variant": _variant(template), "grade": F.when(template.isNotNull(), P.stored_grade(template)).otherwise(F.coalesce("grade", F.lit("UNKNOWN"))),
        "contract_template": F.coalesce(template, "contract_template"), "contract_definition_id": F.coalesce("e_definition", "contract_definition_id"), "status": status, "payout": F.col("payout"), "payout_confidence": F.col("payout_confidence"),
        "reward": F.col("reward"), "source": F.coalesce("source", F.lit("log")), "accepted_at": F.when(stored, F.coalesce("accepted_at", "e_accepted")).otherwise(F.coalesce("begun", "e_accepted")), "completed_at": completed, "notes": F.col("notes"),
        "created_seq": F.coalesce("created_seq", F.col("base") + 1 + F.col("said_seq")), "title_pickup": F.coalesce("title_pickup", "e_pickup"), "title_dropoff": F.coalesce("title_dropoff", "e_dropoff"),
        "session": F.when((F.col("live") == 1) | (F.col("session") == "live"), "live").otherwise("historical"), "terminal_source": F.when(over, "game").otherwise(F.col("terminal_source")),
    }
    after = both.select(*[new[c].alias(c) for c in MISSION])
    placed = with_title_places(_routes(missions, events, parts), whole.select(*LEG))

    none = F.lit(None).cast("string")
    case = lambda which, kind, what, objective, reason, n: F.when(which, F.struct(F.lit(kind).alias("kind"), F.lit(what).alias("what"), F.col("mission_id"), objective.alias("objective_id"), F.lit(reason).cast("string").alias("reason"), n.cast("long").alias("n")))
    m = told.select(F.col("id").alias("mission_id"), stored.alias("stored"), "accepts", "opened")
    again, one = F.col("accepts") - F.when(F.col("stored"), 0).otherwise(F.col("opened")), F.lit(1)
    decisions = m.select(F.inline(F.array(case(~F.col("stored"), "added", "mission", none, None, one), case(again > 0, "skipped", "mission", none, "already stored", again))))
    own = F.col("objective_id")
    of_legs = whole.select(F.inline(F.array(case(~F.col("stored"), "added", "leg", own, None, one), case(F.col("changed"), "updated", "leg", own, None, one), case(F.col("guarded") > 0, "skipped", "leg", own, "edited by the user", F.col("guarded")))))
    return Replayed(after, placed, decisions.unionByName(of_legs).filter("kind IS NOT NULL"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """kind, what, reason, n: how often each was decided."""
    return decisions.groupBy("kind", "what", "reason").agg(F.sum("n").alias("n"))
