"""Replay onto stored tables against the events applied one by one."""

import random

import pytest

from ledgerline import schemas
from ledgerline.functions import logparse
from ledgerline.operators import replay
from ledgerline.plans import adapter
from ledgerline.sources import scratch, sizes
from tests.conftest import SF

NAMES = lambda schema: [c.split(" ")[0] for c in schema.split(", ")]
VARIANT = {"HaulCargo_AToB_X_Waste_Sys1_SupplyGrade": ("A_TO_B", "SUPPLY", "Waste"), "HaulCargo_AToB_X_Ice_Sys1_SmallGrade": ("A_TO_B", "SMALL", "Ice")}


def mission(i, **more):
    return dict.fromkeys(NAMES(schemas.MISSIONS)) | {"id": i, "title": "", "variant": "MANUAL", "grade": "UNKNOWN", "status": "accepted", "source": "log", "session": "historical"} | more


def leg(m, o, **more):
    return dict.fromkeys(NAMES(schemas.LEGS)) | {"mission_id": m, "objective_id": o, "kind": "dropoff", "commodity": "", "scu_total": 0, "scu_delivered": 0, "completed": False} | more


def event(seq, what, m, o=None, source="historical", **more):
    return dict.fromkeys(NAMES(schemas.EVENTS)) | {"seq": seq, "type": what, "ts": 1000 + seq, "mission_id": m, "objective_id": o, "source": source} | more


def key(x):
    return (x["kind"], (x["commodity"] or "").strip().lower(), (x["location"] or "").strip().lower())


def one_by_one(missions, legs, events):
    ms, ls = {m["id"]: dict(m) for m in missions}, {(x["mission_id"], x["objective_id"]): dict(x) for x in legs}
    told = set()
    for e in sorted(events, key=lambda e: e["seq"]):
        m, o, kind = e["mission_id"], e["objective_id"], e["type"]
        new = m not in ms
        if new:
            ms[m] = mission(m, accepted_at=e["ts"] if kind in ("missionAccepted", "missionMarker") else None)
        row = ms[m]
        if e["source"] == "live":
            row["session"] = "live"
        if kind == "missionAccepted":
            row["title"] = row["title"] or e["title"] or ""
            row["accepted_at"] = row["accepted_at"] if row["accepted_at"] is not None else e["ts"]
            for c in ("title_pickup", "title_dropoff"):
                row[c] = row[c] if row[c] is not None else e[c]
        if kind == "missionMarker":
            row["giver"], row["contract_template"] = e["giver"], e["contract_template"]
            row["variant"], row["grade"], _ = VARIANT[e["contract_template"]]
        if kind in ("missionAccepted", "missionMarker"):
            told.add(m)
        if o is not None:
            if kind == "objectiveDeclared" and (m, o) not in ls:
                hand = sorted(q for p, q in ls if p == m and q.startswith("manual_") and key(ls[p, q]) == key(e))
                if hand:
                    ls[m, o] = ls.pop((m, hand[0])) | {"objective_id": o}
            found = ls.get((m, o))
            guard = found is not None and e["source"] == "historical" and found["manual_override"] is not None
            if found is None:
                found = ls[m, o] = leg(m, o, kind=e["kind"] or "dropoff")
            found["kind"] = e["kind"] or found["kind"]
            if not guard:
                if kind == "objectiveDeclared":
                    found["commodity"] = e["commodity"] or found["commodity"]
                    found["scu_total"] = found["scu_total"] if e["scu_total"] is None else e["scu_total"]
                    found["location"] = found["location"] if e["location"] is None else e["location"]
                elif kind == "missionMarker":
                    found["commodity"] = found["commodity"] or VARIANT[e["contract_template"]][2]
                elif kind == "objectiveCompleted":
                    found["completed"], found["scu_delivered"] = True, found["scu_total"]
        if kind == "missionEnded":
            row["status"], row["completed_at"], row["terminal_source"] = {"complete": "complete", "abandon": "abandoned"}[e["completion_type"]], e["ts"], "game"
            if e["completion_type"] == "complete":
                for (p, _), x in ls.items():
                    if p == m:
                        x["completed"], x["scu_delivered"] = True, x["scu_total"]
        if kind == "objectiveCompleted" and row["terminal_source"] is None:
            own = [x["completed"] for (p, _), x in ls.items() if p == m]
            status = "complete" if all(own) else "in_progress" if any(own) else "accepted"
            if status != row["status"]:
                row["status"] = status
                row["completed_at"] = (row["completed_at"] if row["completed_at"] is not None else e["ts"]) if status == "complete" else None
    for m in told:
        for side, kind in (("title_pickup", "pickup"), ("title_dropoff", "dropoff")):
            own = [x for (p, _), x in ls.items() if p == m and x["kind"] == kind]
            if ms[m]["variant"] == "A_TO_B" and len(own) == 1 and not own[0]["location"]:
                own[0]["location"] = ms[m][side] or own[0]["location"]
    return ms, ls


MCOLS = [c for c in NAMES(schemas.MISSIONS) if c != "created_seq"]


def result(spark, missions, legs, events):
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c] for c in NAMES(schema)) for r in rows], schema)
    return replay.replayed(frame(missions, schemas.MISSIONS), frame(legs, schemas.LEGS), frame(events, schemas.EVENTS))


def same(spark, missions, legs, events):
    got = result(spark, missions, legs, events)
    ms, ls = one_by_one(missions, legs, events)
    m = sorted((tuple(r[c] for c in MCOLS) for r in got.missions.collect()), key=str)
    l = sorted((tuple(r[c] for c in NAMES(schemas.LEGS)) for r in got.legs.collect()), key=str)
    assert l == sorted((tuple(x[c] for c in NAMES(schemas.LEGS)) for x in ls.values()), key=str)
    assert m == sorted((tuple(x[c] for c in MCOLS) for x in ms.values()), key=str)
    return got


def random_case(seed, n=30):
    r = random.Random(seed)
    missions, legs, events = [], [], []
    for k in range(n):
        m = f"c{seed}-{k}"
        if r.random() < 0.7:
            terminal = r.choice([None, None, "game", "manual"])
            own = [leg(m, o, kind=r.choice(["pickup", "dropoff"]), commodity=r.choice(["", "Waste", "Tin"]), scu_total=r.randint(0, 9), location=r.choice([None, "", "Port A", "port a "]), manual_override=r.choice([None, None, 7])) for o in r.sample(["a", "b", "manual_1", "manual_2", "manual_3"], r.randint(0, 4))]
            for x in own:
                x["completed"] = r.random() < 0.4
                x["scu_delivered"] = x["scu_total"] if x["completed"] else 0
            done = [x["completed"] for x in own]
            status = r.choice(["complete", "abandoned"]) if terminal else "complete" if done and all(done) else "in_progress" if any(done) else "accepted"
            missions.append(mission(m, status=status, terminal_source=terminal, completed_at=5 if status in ("complete", "abandoned") else None, title=r.choice(["", "T"]), title_dropoff=r.choice([None, "There"]), variant=r.choice(["MANUAL", "A_TO_B"]), created_seq=k, payout=r.choice([None, 3])))
            legs += own
        for _ in range(r.randint(0, 7)):
            o, source = r.choice(["a", "b", "c"]), r.choice(["historical", "live"])
            kind = r.choice(["missionAccepted", "missionMarker", "objectiveDeclared", "objectiveDeclared", "objectiveCompleted", "objectiveCompleted", "missionEnded"])
            more = {
                "missionAccepted": lambda: {"o": None, "title": r.choice(["N1", "N2"]), "title_pickup": r.choice([None, "Here"]), "title_dropoff": r.choice([None, "There"])},
                "missionMarker": lambda: {"kind": r.choice(["pickup", "dropoff"]), "giver": "Covalex", "contract_template": r.choice(list(VARIANT))},
                "objectiveDeclared": lambda: {"kind": r.choice(["pickup", "dropoff"]), "commodity": r.choice(["Waste", "tin"]), "scu_total": r.randint(1, 9), "location": r.choice(["Port A", "Port B"])},
                "objectiveCompleted": dict,
                "missionEnded": lambda: {"o": None, "completion_type": r.choice(["complete", "abandon"])},
            }[kind]()
            if kind == "missionEnded" and r.random() < 0.5:
                continue
            events.append(event(r.randrange(1 << 40), kind, m, source=source, **({"o": o} | more)))
    return missions, legs, events


def test_the_stand_in_for_templates(spark):
    df = spark.createDataFrame([(t,) for t in VARIANT], "t string").select("t", logparse.stored_variant(logparse.F.col("t")).alias("v"), logparse.stored_grade(logparse.F.col("t")).alias("g"), logparse.commodity_name(logparse.commodity_token(logparse.F.col("t"))).alias("c"))
    assert {r.t: (r.v, r.g, r.c) for r in df.collect()} == VARIANT


def test_replay_equals_events_one_by_one(spark):
    missions, legs, events = [], [], []
    for seed in range(12):
        for whole, part in zip((missions, legs, events), random_case(seed), strict=True):
            whole += part
    got = same(spark, missions, legs, events)
    counts = {(r.kind, r.what): r.n for r in replay.decision_counts(got.decisions).collect()}
    stored = {m["id"] for m in missions}
    new = {e["mission_id"] for e in events} - stored
    first = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        first.setdefault(e["mission_id"], e)
    accepts = [e for e in events if e["type"] == "missionAccepted"]
    assert counts["added", "mission"] == len(new)
    assert counts["skipped", "mission"] == len(accepts) - sum(first[m]["type"] == "missionAccepted" for m in new)
    assert {m["id"] for m in missions} | new == {r.id for r in got.missions.collect()}


def test_edited_legs_adoption_and_a_second_replay(spark):
    missions = [mission("m1", created_seq=4), mission("m2", created_seq=9, status="complete", terminal_source="manual", completed_at=77)]
    legs = [leg("m1", "a", commodity="Mine", scu_total=3, location="Mine", manual_override=1), leg("m1", "manual_7", commodity="Waste", scu_total=5, location=" port A", manual_override=2), leg("m2", "a", scu_total=4)]
    events = [
        event(1, "objectiveDeclared", "m1", "a", kind="pickup", commodity="Waste", scu_total=40, location="Port A"), event(2, "objectiveDeclared", "m1", "d1", kind="dropoff", commodity="waste", scu_total=60, location="Port A"),
        event(3, "objectiveCompleted", "m1", "a"), event(4, "objectiveDeclared", "m1", "a", source="live", kind="pickup", commodity="Tin", scu_total=41, location="Port B"), event(5, "objectiveCompleted", "m2", "a"),
    ]
    got = same(spark, missions, legs, events)
    rows = {(r.mission_id, r.objective_id): r for r in got.legs.collect()}
    assert (rows["m1", "a"].commodity, rows["m1", "a"].scu_total, rows["m1", "a"].completed) == ("Tin", 41, False)
    assert (rows["m1", "d1"].commodity, rows["m1", "d1"].scu_total, rows["m1", "d1"].manual_override) == ("Waste", 5, 2)
    assert ("m1", "manual_7") not in rows and rows["m2", "a"].completed
    assert {r.id: (r.status, r.completed_at) for r in got.missions.collect()} == {"m1": ("accepted", None), "m2": ("complete", 77)}
    again = result(spark, [r.asDict() for r in got.missions.collect()], [r.asDict() for r in got.legs.collect()], events)
    assert sorted(map(tuple, again.missions.collect())) == sorted(map(tuple, got.missions.collect()))
    assert sorted(map(tuple, again.legs.collect())) == sorted(map(tuple, got.legs.collect()))


@pytest.mark.parametrize("missions, legs", [([], []), ([mission("m", created_seq=1)], [leg("m", "x")])])
def test_no_events_and_no_tables(spark, missions, legs):
    got = same(spark, missions, legs, [])
    assert got.decisions.collect() == []
    same(spark, missions, legs, random_case(3)[2])


def shuffled(spark, act):
    """How many rows are written to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    act()
    return sum(n for k, n in stages().items() if k not in before)


def test_legs_and_events_are_shuffled_once(spark):
    missions, legs, events = random_case(21, n=400)
    n = shuffled(spark, lambda: result(spark, missions, legs, events).legs.collect())
    titled = [e for e in events if e["type"] in ("missionAccepted", "missionMarker")]
    assert n <= len(legs) + len(events) + len(missions) + len(titled) + 20  # counts are a row a task


def test_lines_are_not_shuffled_for_a_small_dimension_and_meet_a_large_one_in_parts(spark, monkeypatch):
    whole = sorted(map(tuple, adapter.legs(spark, SF).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        plan = adapter.legs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_suppkey" not in plan
    monkeypatch.setattr(sizes, "SENT_ROWS", 1)
    monkeypatch.setattr(sizes, "TASK_ROWS", 500)
    parted = adapter.legs(spark, SF)
    assert "SortMergeJoin" in parted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, parted.collect())) == whole


def test_missions_are_worked_out_without_another_shuffle_of_legs_or_events(spark):
    missions, legs, events = random_case(22, n=400)
    n = shuffled(spark, lambda: result(spark, missions, legs, events).missions.collect())
    closed = [e for e in events if e["type"] == "objectiveCompleted"]
    assert n <= len(legs) + 2 * len(events) + len(closed) + len(missions) + 20  # events once by leg and once by mission


def test_written_files_have_a_bounded_number_of_rows(spark):
    back = scratch.written(spark.range(0, 95, 1, 2), "files", 10)
    counts = back.groupBy("_metadata.file_path").count().collect()
    assert sum(r["count"] for r in counts) == 95 and max(r["count"] for r in counts) <= 10
