"""Parsers, reducer, correlation, routing and captures against small goldens with invented names."""

import math
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import fuzzy, logparse, noisytext, redact, scalars
from ledgerline.operators import capture, claims, correlate, mutate, reduce, rollups, route, salvage
from ledgerline.plans import catalog, graph_queries
from ledgerline.sources import logs, reference, sizes, state
from tests.conftest import SF
from tests.oracle import oracle, rows

T = "<2026-01-02T03:04:{:02d}.500Z> "
NOTE = '<SHUDEvent_OnNotification> Added notification "{}" [3] to queue. MissionId: [{}], ObjectiveId: [{}]'


def story():
    """Lines of two missions: one declared and delivered leg by leg, one ended by the game with a phantom leg."""
    return [
        T.format(1) + NOTE.format("Contract Accepted: <EM4>[X]*</EM4> Cargo run | Alpha > Beta :", "m1", ""),
        T.format(2) + "<CLocalMissionPhaseMarker::CreateMarker> missionId [m1], generator name [Covalex_H], contract [HaulCargo_AToB_Waste_PressIce_Sys1_SupplyGrade], objectiveId [pickup_a_0], position [x: 1, y: 2.5, z: -3]",
        T.format(3) + NOTE.format("New Objective: Deliver 0/40 SCU of Waste to Port Beta:", "m1", "dropoff_a_0"),
        T.format(4) + "<ObjectiveUpserted> mission_id m1 objective_id pickup_a_0 MISSION_OBJECTIVE_STATE_COMPLETED",
        T.format(5) + "<ObjectiveComplete> mission_id m1 objective_id dropoff_a_0 MISSION_OBJECTIVE_STATE_COMPLETED",
        T.format(6) + "<CLocalMissionPhaseMarker::CreateMarker> missionId [m2], generator name [Redwind], contract [Redwind_Sys_SmallGrade_Multi3ToSingle_RefinedOre], objectiveId [dropoff_b_0]",
        T.format(7) + "<ObjectiveComplete> mission_id m2 objective_id phase_9 MISSION_OBJECTIVE_STATE_COMPLETED",
        T.format(8) + "<EndMission> MissionId[m2] CompletionType[Complete] Reason[ok]",
        T.format(9) + NOTE.format("Awarded 700 aUEC: x", "0", ""),
        T.format(10) + NOTE.format("Fined 30 UEC", "0", ""),
        T.format(11) + "<RequestLocationInventory> Location[Stanton1_DistributionCentre_Hurston_farnesway]",
    ]


NOISE = ["", "no time <EndMission> MissionId[m] CompletionType[Complete]", T.format(1) + "<MissionEnded> m1", T.format(1) + "<EndMission> MissionId[m] CompletionType[Odd]", T.format(1) + "<CommsNotifications> hello", "<2026-13-01T00:00:00Z> " + NOTE.format("Fined 30 UEC", "0", "")]


def lines(spark, values, source="live"):
    return spark.createDataFrame([(source, 0, i, v) for i, v in enumerate(values)], logs.LINES)


def test_parse(spark):
    events = logparse.parse_lines(lines(spark, story()))
    got = events.orderBy("seq").collect()
    assert [e.type for e in got] == ["missionAccepted", "missionMarker", "objectiveDeclared", "objectiveCompleted", "objectiveCompleted", "missionMarker", "objectiveCompleted", "missionEnded", "payoutAwarded", "fined", "locationInventory"]
    assert (got[0].title, got[0].title_pickup, got[0].title_dropoff) == ("Cargo run | Alpha > Beta", "Alpha", "Beta")
    assert got[1].position.z == -3 and got[2].scu_total == 40 and got[2].location == "Port Beta" and got[8].amount == 700 and got[10].location_id.startswith("Stanton1")
    assert logparse.parse_lines(lines(spark, NOISE)).count() == 0


def test_reduce(spark):
    m, legs, awards, fines = reduce.reduce_events(logparse.parse_lines(lines(spark, story())))
    m = {r.id: r for r in m.collect()}
    legs = {(r.mission_id, r.objective_id): r for r in legs.collect()}
    assert (m["m1"].status, m["m1"].variant, m["m1"].grade, m["m1"].terminal_source) == ("complete", "A_TO_B", "SUPPLY", None)
    assert m["m1"].completed_at % 100_000 == 45_500 % 100_000 or m["m1"].completed_at is not None
    assert (m["m2"].status, m["m2"].variant, m["m2"].terminal_source) == ("complete", "MANUAL", "game")
    assert legs["m1", "pickup_a_0"].location == "Alpha" and legs["m1", "pickup_a_0"].commodity == "Pressurized Ice"
    assert (legs["m1", "dropoff_a_0"].location, legs["m1", "dropoff_a_0"].scu_delivered) == ("Port Beta", 40)
    assert legs["m2", "phase_9"].kind == "dropoff" and legs["m2", "phase_9"].completed and legs["m2", "dropoff_b_0"].completed
    assert awards.count() == 1 and fines.count() == 1


def state_of(spark, values):
    m, legs, awards, fines = reduce.reduce_events(logparse.parse_lines(lines(spark, values)))
    return sorted(m.drop("created_seq").collect(), key=str), sorted(legs.drop("first_seq", "done_seq").collect(), key=str), sorted(awards.drop("seq").collect()), sorted(fines.collect())


def test_replay_changes_nothing(spark):
    once, twice = state_of(spark, story()), state_of(spark, story() + story())
    assert once[1:] == twice[1:] and [r.asDict() | {"completed_at": 0} for r in once[0]] == [r.asDict() | {"completed_at": 0} for r in twice[0]]


def test_declared_beats_the_template_in_any_order(spark):
    rows = story()[1:3]
    swapped = [rows[1].replace("dropoff_a_0", "pickup_a_0"), rows[0]]
    for order in (swapped, swapped[::-1]):
        _, legs, _, _ = reduce.reduce_events(logparse.parse_lines(lines(spark, order)))
        assert [r.commodity for r in legs.collect()] == ["Waste"]


@pytest.mark.parametrize("done, awards, want", [
    ([("a", 5000)], [], {}),
    ([("a", 5000)], [(50, 5100)], {"a": (50, "confirmed")}),
    ([("a", 5000), ("b", 5000), ("c", 5000)], [(1, 5100), (2, 5200)], {"a": (1, "approximate"), "b": (2, "approximate"), "c": (None, "approximate")}),
    ([("a", 5000)], [(50, 7001)], {}),
    ([("a", 5000), ("b", 9000)], [(1, 5000), (2, 11000)], {"a": (1, "confirmed"), "b": (2, "confirmed")}),
    ([("a", 5000), ("b", 5000)], [(1, 5100), (2, 5200)], {"a": (1, "approximate"), "b": (2, "confirmed")}),
])
def test_payouts(spark, done, awards, want):
    m = spark.createDataFrame([(i, t, "complete", "game", "Covalex", n) for n, (i, t) in enumerate(done)], "id string, completed_at long, status string, terminal_source string, giver string, end_seq long")
    a = spark.createDataFrame([(x, t, 100 + n) for n, (x, t) in enumerate(awards)], "amount long, ts long, seq long")
    assert {r.mission_id: (r.payout, r.payout_confidence) for r in claims.attributed(a, m).collect()} == want


def greedy(awards, done, window):
    """All awards against all completions: (amount, ts, seq) and (id, ts, seq)."""
    paid, sure = {}, {}
    for amount, ts, seq in sorted(awards, key=lambda x: x[2]):
        near = [i for i, t, s in sorted(done, key=lambda x: x[1:]) if i not in paid and ts - window <= t <= ts and s < seq]
        if near:
            paid[near[0]] = amount
            for i in near:
                sure[i] = "approximate" if len(near) > 1 else "confirmed"
    return {i: (paid.get(i), c) for i, c in sure.items()}


def test_payout_query_meets_every_completion(spark):
    from ledgerline.plans import graph_queries as Q
    from tests.conftest import SF

    done = [(r.id, r.completed_at, r.end_seq) for r in Q._completions(spark, SF).collect() if r.giver != "Other"]
    want = greedy([(r.amount, r.ts, r.seq) for r in Q._awards(spark, SF).collect()], done, Q.HOUR)
    got = {r.mission_id: (r.payout, r.payout_confidence) for r in Q.payout_greedy(spark, SF).collect()}
    assert got == want and len({c for _, c in want.values()}) == 2


@pytest.mark.parametrize("step, jumble", [(3, 0), (40, 0), (400, 0), (40, 25)])
def test_payouts_of_logs(spark, step, jumble):
    """Logs in order of time, cut into ranges; and one that is not in order beside them."""
    r = random.Random(step)
    done, awards, want, earned = [], [], {}, set()
    for log in ("x", "y", None):
        t, mine, his = 0, [], []
        for seq in range(60):
            t += r.randint(0, step)
            at = t + (r.randint(-jumble, jumble) if log == "y" else 0)
            if r.random() < 0.5:
                mine.append((f"{log}{seq}", at, seq))
            else:
                his.append((seq, at, seq))
        done += [(log, *x) for x in mine]
        awards += [(log, *x) for x in his]
        found = greedy(his, mine, 100)
        want |= found
        payer = {p: i for i, (p, _) in found.items() if p is not None}
        earned |= {(log, a, t, payer.get(a), found[payer[a]][1] if a in payer else "unknown") for a, t, _ in his}
    m = spark.createDataFrame([(k, i, t, "complete", "game", "Covalex", s) for k, i, t, s in done], "log string, id string, completed_at long, status string, terminal_source string, giver string, end_seq long")
    a = spark.createDataFrame(awards, "log string, amount long, ts long, seq long")
    got = {x.mission_id: (x.payout, x.payout_confidence) for x in claims.attributed(a, m, 100, ("log",)).collect()}
    assert got == want
    book = claims.ledger(a.unionByName(a.withColumn("seq", F.col("seq") + 1000)), m, 100, ("log",)).collect()  # an award that comes again
    assert len(book) == len(earned) and {tuple(x) for x in book} == earned
    rest = {tuple(x) for x in claims.other_income(a, m, 100, ("log",)).collect()}
    assert rest == {x[:3] for x in earned if x[3] is None}


def test_functions_of_ranges_compose():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 40)
        kinds, ts, out = [r.choice(["m", None]) for _ in range(n)], 0, []
        for i, k in enumerate(kinds):
            ts += r.randint(0, 4)
            out.append((ts, 0, i, f"m{i}" if k else None, None if k else 1))
            if k:
                out.append((ts + 9, 1, i, f"m{i}", None))
        out.sort(key=lambda x: x[:3])
        cut = r.randint(1, len(out))
        p, whole = 0, []
        for part in (out[:cut], out[cut:]):
            if part:
                earlier = out[: out.index(part[0])]
                x = pd.DataFrame(part, columns=["ts", "late", "seq", "mission_id", "amount"]).assign(gone=sum(e[1] == 1 for e in earlier), come=sum(e[1] == 0 and e[3] is not None for e in earlier), awards=sum(e[3] is None for e in earlier))
                x["mission_id"] = x["mission_id"].astype(object).where(x["mission_id"].notna(), None)
                c, low, high = claims.fold(x)
                whole += [row.number for row in claims.replay(x, p).itertuples() if pd.isna(row.mission_id)]
                p = min(max(p + c, low), high)
        done = [(f"m{s}", t, s) for t, late, s, m, _ in out if m and not late]
        awards = [(s, t, s) for t, _, s, m, _ in out if m is None]
        number = {m: i for i, (m, _, _) in enumerate(sorted(done, key=lambda d: d[1:]))}
        want = {p: number[m] for m, (p, _) in greedy(awards, done, 9).items() if p is not None}
        assert [None if pd.isna(x) else int(x) for x in whole] == [want.get(s) for s, _, _ in sorted(awards, key=lambda a: a[1:])]


def test_payouts_reach_the_missions_of_a_log(spark):
    told = [
        T.format(1) + "<CLocalMissionPhaseMarker::CreateMarker> missionId [m2], generator name [Redwind], contract [Redwind_Sys_SmallGrade_Multi3ToSingle_RefinedOre], objectiveId [dropoff_b_0]",
        T.format(2) + "<CLocalMissionPhaseMarker::CreateMarker> missionId [m3], generator name [Bounty], contract [X], objectiveId [dropoff_b_0]",
        T.format(3) + "<EndMission> MissionId[m3] CompletionType[Complete] Reason[ok]", T.format(8) + "<EndMission> MissionId[m2] CompletionType[Complete] Reason[ok]",
        T.format(4) + NOTE.format("Awarded 50 aUEC: x", "0", ""), T.format(9) + NOTE.format("Awarded 700 aUEC: x", "0", ""), T.format(9) + NOTE.format("Awarded 700 aUEC: x", "0", ""),
    ]
    events = logparse.parse_lines(lines(spark, told)).cache()
    m, _, awards, _ = reduce.reduce_events(events)
    missions, book = claims.settled(m, events, awards)
    assert {r.id: (r.payout, r.payout_confidence) for r in missions.collect()} == {"m2": (700, "confirmed"), "m3": (None, None)}
    assert {(r.amount, r.mission_id, r.confidence) for r in book.collect()} == {(50, None, "unknown"), (700, "m2", "confirmed")}


@pytest.mark.parametrize("within", [0, 1, 7, 100])
def test_nearest_missions_meet_in_time_cells(spark, within):
    r = random.Random(within)
    m = [(f"m{i}", r.choice(["A  b", "c"]), r.choice([None, r.randint(-300, 300)]), i) for i in range(120)]
    p = [(i, "m5" if i % 9 == 0 else "none", r.choice([" a B ", "C"]), r.choice([None, r.randint(-300, 300)])) for i in range(120)]
    key = lambda x: " ".join(x.lower().split())
    want = {}
    for i, mission, title, ts in p:
        near = [(abs(at - ts), seq, name) for name, t, at, seq in m if ts is not None and at is not None and key(t) == key(title) and abs(at - ts) <= within]
        want[i] = mission if mission == "m5" else min(near)[2] if near else None
    pending = spark.createDataFrame(p, "pending_id long, mission_id string, title string, ts long")
    got = correlate.nearest_missions(pending, spark.createDataFrame(m, "id string, title string, accepted_at long, created_seq long"), within)
    assert {x.pending_id: x.match for x in got.collect()} == want
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and "__cell" in joins[0]


def test_stop_groups_golden(spark):
    m = spark.createDataFrame([("m1", "accepted", "live"), ("m2", "accepted", "live")], "id string, status string, session string")
    rows = [("m1", "d0", "Ice", 13, "Cass", True), ("m1", "d1", "Food", 188, "Teasa", False), ("m1", "d2", "Ice", 9, "Farn", False), ("m1", "d3", "Food", 150, "Cass", False), ("m2", "d0", "Ice", 20, "Cass", False)]
    legs = spark.createDataFrame([(a, b, "dropoff", c, n, 0, p, d) for a, b, c, n, p, d in rows], "mission_id string, objective_id string, kind string, commodity string, scu_total long, scu_delivered long, location string, completed boolean")
    got = {(r.location, r.commodity, r.state): r for r in rollups.stop_groups(m, legs).collect()}
    r = got["Cass", "Ice", "todo"]
    assert (r.scu, r.group_remaining, r.pct_delivered, got["Cass", "Ice", "delivered"].scu) == (20, 170, 7, 13)


def test_scalars(spark):
    ratios = [1.0, 0.76, 0.75, 0.5, 0.25, 0.26]
    df = spark.createDataFrame([(x,) for x in ratios], "x double")
    assert [r[0] for r in df.select(scalars.payout_factor(F.col("x"))).collect()] == [1.0, 0.76, 0.45, 0.15, 0.0, 0.15]
    tiers = spark.createDataFrame([(80,), (100,), (150,), (10,)], "t long").select(scalars.capacity_status(F.col("t"), F.lit(100)).alias("c")).select("c.*").collect()
    assert [(r.tier, r.trips) for r in tiers] == [("warn", 1), ("warn", 1), ("over", 2), ("ok", 1)]


NOISY = [
    ("Deliver 32 SCU of Titanium to Baijini Point", [("dropoff", 32, "Titanium", "Baijini Point")], None),
    ("Collect 18 SCU of Aluminum from Seraphim Station", [("pickup", 18, "Aluminum", "Seraphim Station")], None),
    ("Payout: 12,5OO auec", [], 12500), ("Bonus 500 aUEC\nReward 30,000 aUEC", [], 30000),
    ("Deliver 07106 SCU of Waste to Area Depot", [("dropoff", 106, "Waste", "Area Depot")], None),
    ("Deliver 0/900 SCU of Waste to Hub", [("dropoff", None, "Waste", "Hub")], None), ("", [], None),
]


def test_noisy_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NOISY)], "i int, t string").withColumn("c", noisytext.contract(F.col("t")))
    for r in df.collect():
        assert ([tuple(o) for o in r.c.objectives], r.c.reward) == NOISY[r.i][1:]


def test_fuzzy(spark):
    d = spark.createDataFrame([(0, "Aluminum"), (1, "Seraphim Station"), (2, "Stims")], "idx int, value string")
    got = {r.input: r for r in fuzzy.fuzzy_match(spark.createDataFrame([("Aluminun",), ("Seraphim",), ("5tirns",), ("zzz",), (None,)], "input string"), d).collect()}
    assert got["Aluminun"].match == "Aluminum" and 0.6 < got["Aluminun"].score < 1 and got["Seraphim"].match == "Seraphim Station" and got["5tirns"].match == "Stims" and got["zzz"].match is None and got[None].score == 0
    assert fuzzy.confusable_distance("rn", "m") == fuzzy.confusable_distance("m", "rn") == 0.4


def test_redaction(spark):
    rows = [("l", 0, "Player[77] PlayerId[123] C:\\Users\\Jo\\x"), ("l", 1, "spawn Abc_d[123] seen by abc_d"), ("k", 0, "nothing")]
    got = [r.value for r in redact.redacted_lines(spark.createDataFrame(rows, "log string, seq int, value string"), ["log"]).orderBy("log", "seq").collect()]
    assert got == ["nothing", "Player[<PLAYER>] PlayerId[<PLAYERID>] C:\\Users\\<USER>\\x", "spawn <PLAYER>[<PLAYERID>] seen by abc_d"]


def plain_route(stops, capacity, start):
    """Nearest stop first, then every turn of a stretch tried in order on a copy of the whole order."""
    stops = sorted(stops, key=lambda s: s["stop_id"])
    here = [s for s in stops if s["pos_x"] is not None]
    at = lambda s: (s["pos_x"], s["pos_y"], s["pos_z"])
    far = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    match = lambda p, d: p["mission_id"] == d["mission_id"] and (not p["commodity"] or not d["commodity"] or p["commodity"] == d["commodity"])
    needs = {d["stop_id"]: {p["stop_id"] for p in here if p["kind"] == "pickup" and match(p, d)} for d in here if d["kind"] == "dropoff"}

    def good(order):
        load, seen = 0, set()
        for s in order:
            if needs.get(s["stop_id"], set()) - seen:
                return False
            seen.add(s["stop_id"])
            load = load + s["scu"] if s["kind"] == "pickup" else max(0, load - s["scu"])
            if s["kind"] == "pickup" and 0 < capacity < load:
                return False
        return True

    def length(order):
        points = ([start] if start else []) + [at(s) for s in order]
        return sum(far(a, b) for a, b in zip(points, points[1:], strict=False))

    left, order, load, now, seen = list(here), [], 0, start, set()
    while left:
        rank = lambda s: (2 if needs.get(s["stop_id"], set()) - seen else 0 if s["kind"] != "pickup" or capacity <= 0 or load + s["scu"] <= capacity else 1, far(now, at(s)) if now else 0.0, s["stop_id"])  # noqa: B023, E731
        s = min(left, key=rank)
        left.remove(s)
        order.append(s)
        seen.add(s["stop_id"])
        load = load + s["scu"] if s["kind"] == "pickup" else max(0, load - s["scu"])
        now = at(s)
    turned = True
    while turned:
        turned = False
        for i in range(len(order) - 1):
            for j in range(i + 1, len(order)):
                trial = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if good(trial) and length(trial) < length(order) - 1e-9:
                    order, turned = trial, True
    fits = good(order)
    return [s["stop_id"] for s in order] + [s["stop_id"] for s in stops if s["pos_x"] is None], length(order), fits


def stop(i, kind, at, m="m", scu=1, c=""):
    return {"stop_id": i, "kind": kind, "pos_x": at[0], "pos_y": at[1], "pos_z": at[2], "mission_id": m, "scu": scu, "commodity": c, "location": i}


@pytest.mark.parametrize("seed", range(40))
def test_routes_equal_those_of_the_plain_search(seed):
    r = random.Random(seed)
    n, capacity = r.randint(0, 16), r.choice([0, 0, 9, 15, 30])
    stops = [stop(f"s{i:02d}", r.choice(["pickup", "dropoff"]), tuple(r.choice([r.uniform(0, 9), float(r.randint(0, 3))]) for _ in range(3)) if r.random() < 0.9 else (None,) * 3, r.choice("abc"), r.randint(1, 9), r.choice(["", "x", "y"])) for i in range(n)]
    start = r.choice([None, (0.0, 0.0, 0.0)])
    got = route.Problem(stops[::-1], capacity, start).solved()
    want = plain_route(stops, capacity, start)
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-6
    assert got[2] == any(s["pos_x"] is None for s in stops)
    assert got[3] == (not want[2] or any(0 < capacity < s["scu"] for s in stops if s["kind"] == "pickup"))


@pytest.mark.parametrize("capacity", [0, 900, 5000])
def test_a_route_of_hundreds_of_stops(capacity):
    r = random.Random(1)
    stops = [stop(f"s{i:03d}", "pickup" if i % 2 else "dropoff", (r.random(), r.random(), r.random()), f"m{i // 4}", r.randint(1, 9)) for i in range(400)]
    problem = route.Problem(stops, capacity)
    seed = problem.seed()
    order = problem.improved(seed)
    place = {n: k for k, n in enumerate(order)}
    assert sorted(order) == list(range(400)) and problem.length(order) < problem.length(seed)
    assert problem.fits(order) and all(place[p] < place[d] for d, p in zip(problem.drop, problem.pick, strict=True))


def test_captures(spark):
    leg = lambda i, c, loc=None, over=None: {"mission_id": "m", "objective_id": i, "kind": "dropoff", "commodity": c, "location": loc, "completed": False, "manual_override": over, "scu_total": 0}
    o = lambda c, n, loc: {"mission_id": "m", "kind": "dropoff", "commodity": c, "scu": n, "location": loc}
    got = capture.assigned([leg("manual_x", "Ice"), leg("dropoff_1", ""), leg("dropoff_2", "Waste")], [o("Waste", 5, "Hub"), o("Ice", None, "Bay"), o("Ice", 7, "Bay")], 9)
    assert [(x[1], x[3], x[4], x[6]) for x in got] == [("dropoff_2", "Waste", 5, "filled"), ("dropoff_1", "Ice", 0, "filled"), ("manual_x", "Ice", 7, "filled")]
    words = pd.DataFrame([("left", 0, 0), ("left", 0, 40), ("right", 600, 0), ("side", 600, 40)], columns=["text", "x0", "y0"])
    words["x1"], words["y1"] = words["x0"] + 80, words["y0"] + 20
    assert capture.Page(words).objectives(1000) == "right\nside"


def test_commands(spark):
    m = spark.createDataFrame([("a", "accepted", None, None, None, None, 1, None, None)], "id string, status string, payout long, payout_confidence string, reward long, completed_at long, created_seq long, notes string, terminal_source string")
    p = spark.createDataFrame([("a", 77, "complete", 5)], "id string, at long, status string, payout long")
    r = mutate.patched_missions(m, p).first()
    assert (r.status, r.payout, r.payout_confidence, r.completed_at, r.terminal_source) == ("complete", 5, "confirmed", 77, "manual")
    legs = spark.createDataFrame([("a", "o", "dropoff", "c", 9, 0, "L", False)], "mission_id string, objective_id string, kind string, commodity string, scu_total long, scu_delivered long, location string, completed boolean")
    on = mutate.check_off(m, legs, legs.select("kind", "location", "commodity"), 5)
    assert [(x.completed, x.scu_delivered, x.manual_override) for x in on.collect()] == [(True, 9, 5)]
    added = mutate.with_legs(legs, spark.createDataFrame([("a", "pickup", "c", 3, "Q", 5)], "mission_id string, kind string, commodity string, scu_total long, location string, at long"))
    assert {x.objective_id for x in added.collect()} == {"o", "manual_pickup_5_0"}


def test_salvage(spark):
    runs = spark.createDataFrame([("r", 4, "active", 10.0, 5.0)], "id string, crew_size int, status string, rmc_scu double, cmat_scu double")
    parts = spark.createDataFrame([("r", 2, 3000, True), ("r", 1, 5000, False), ("r", 4, 1000, True)], "run_id string, qty int, sell_price_each long, sold boolean")
    t = salvage.run_totals(runs, parts).first()
    assert (t.materials_value, t.components_value, t.per_crew) == (132000.0, 10000.0, 35500.0)


def test_reference_and_state(spark, tmp_path):
    (tmp_path / "rocks.csv").write_text('RockName,Rarity,1,2,3,4,5,6\n"Gold 1",Rare,1,2,3,4,5,6\n')
    rock = reference.rocks_of(reference.read_csv(spark, str(tmp_path / "rocks.csv"))).first()
    assert (rock.name, rock.scan_values) == ("Gold", [1, 2, 3, 4, 5, 6])
    (tmp_path / "dep.csv").write_text('Name,Type,FoundAt\nGold,Ship,"A, B ,,C"\n')
    assert reference.deposits_of(reference.read_csv(spark, str(tmp_path / "dep.csv"))).first().found_at == ["A", "B", "C"]
    old = spark.createDataFrame([("a", "complete")], "id string, status string")
    assert state.migrated(old, "missions").first().terminal_source == "game"


def test_geometry(spark):
    from ledgerline.functions import geometry as G

    df = spark.createDataFrame([((0.1, 0.2, 0.5, 0.9), (80.0, 10.0, -40.0, 30.0), 1000.0, 500.0)], "r struct<x:double,y:double,w:double,h:double>, s struct<x:double,y:double,width:double,height:double>, w double, h double")
    row = df.select(
        G.crop_rect(F.col("r"), F.col("w"), F.col("h")).alias("crop"), G.selection_to_source(F.col("s"), F.lit(100.0), F.lit(50.0), F.col("w"), F.col("h")).alias("sel"),
        G.full_frame_scale(F.col("w"), F.col("h")).alias("scale"), G.crop_rect(F.col("r"), F.lit(0.0), F.col("h")).alias("none"), G.capture_delay(F.lit(99_999.0)).alias("delay"), G.nearest_option(F.lit(750), [500, 1000]).alias("option"),
    ).first()
    assert tuple(row.crop) == (100, 100, 500, 400) and tuple(row.sel) == (400, 100, 400, 300) and row.scale == 2.4 and tuple(row.none) == (0, 0, 0, 0) and row.delay == 3000 and row.option == 500


def test_reports(spark):
    from ledgerline.operators import reports

    m = spark.createDataFrame([("a", "T", None, "A_TO_B", "BULK", "accepted", "log", None, None)], "id string, title string, giver string, variant string, grade string, status string, source string, payout long, payout_confidence string")
    legs = spark.createDataFrame([("a", "o", "dropoff", "", 9, 4, None, False)], "mission_id string, objective_id string, kind string, commodity string, scu_total long, scu_delivered long, location string, completed boolean")
    text = reports.mission_blocks(m, legs).first().text
    assert text.splitlines()[0] == "mission a" and text.splitlines()[-1] == "    - [dropoff] (no commodity) 4/9 SCU -> (no location) (open) [o]" and "  payout   : — (unknown)" in text
    assert tuple(reports.status_line(m).first()) == (1, "accepted=1")
    assert [r.title for r in reports.manual_drafts(spark.createDataFrame([(" ",), (" x ",)], "title string")).collect()] == [reports.DEFAULT_TITLE, "x"]


def test_objectives_snap_to_names_and_lines_lose_identities(spark):
    from ledgerline.operators import reports

    o = spark.createDataFrame([("m", "Alurninum", "Sera phim Station"), ("m", None, " "), ("n", "Zzz", None)], "mission_id string, commodity string, location string")
    names = spark.createDataFrame([(0, "Aluminum"), (1, "Stims")], "idx int, value string")
    places = spark.createDataFrame([(0, "Seraphim Station"), (1, "Everus Harbor")], "idx int, value string")
    got = {tuple(r) for r in reports.objectives_to_apply(o, names, places).collect()}
    assert got == {("m", "Aluminum", "Seraphim Station"), ("m", None, None), ("n", "Zzz", None)}
    assert {r.location for r in reports.objectives_to_apply(o).collect()} == {"Sera phim Station", None}
    rows = [("l", 0, i, x) for i, x in enumerate(["Player[Abc] PlayerId[77]", "Awarded to Abc", "nothing", "New Objective of 77"])]
    lines = spark.createDataFrame(rows, "log string, file_rank int, line_no int, value string")
    assert [r.value for r in reports.mission_line_extract(lines, ["log"]).collect()] == ["Awarded to <PLAYER>", "New Objective of <PLAYERID>"]


@pytest.mark.parametrize("confusable", [True, False])
def test_the_trie_finds_what_all_pairs_find(confusable):
    r = random.Random(confusable)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    for _ in range(60):
        letters = r.choice(["ab1l", "rnmo0", "abcdefgh5s"])
        entries = [(i, word(r.randint(0, 9), letters)) for i in range(r.randint(0, 40))]
        names = fuzzy.Names(entries, confusable)
        for _ in range(10):
            key = r.choice([word(r.randint(1, 10), letters), (r.choice(entries)[1] + word(1, letters))[:9] if entries else "a"])
            want = []
            for i, e in entries:
                if e:
                    far = round(fuzzy.confusable_distance(key, e) if confusable else plain_distance(key, e), 6)
                    score = max(0.0, 1 - far / max(len(key), len(e)))
                    if confusable and min(len(key), len(e)) >= 3 and (key in e or e in key):
                        score = max(score, 0.5 + 0.5 * min(len(key), len(e)) / max(len(key), len(e)))
                    if score > 0:
                        want.append((-score, i))
            got = names.best(key, 3)
            assert [(round(s, 9), i) for s, i in got] == [(round(-s, 9), i) for s, i in sorted(want)[:3]], (key, entries)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_a_large_dictionary_is_searched_in_little_time():
    r = random.Random(3)
    entries = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(6, 16)))) for i in range(20_000)]
    names = fuzzy.Names(entries)
    began = time.time()
    for i, e in r.sample(entries, 200):
        at = r.randrange(len(e))
        (_, got), = names.best(e[:at] + "q" + e[at + 1 :])
        assert got == i
    assert time.time() - began < 90


def test_a_dictionary_beyond_the_limit_is_searched_whole(spark, monkeypatch):
    d = spark.createDataFrame([(i, n) for i, n in enumerate(["Aluminum", "Seraphim Station", "Stims", "Quartz", "Iron Ore", "Waste", "Agricium"])], "idx int, value string")
    i = spark.createDataFrame([(x,) for x in ("Aluminun", "Seraphim", "5tirns", "qartz", "zzz", None, "iron ore")], "input string")
    want = sorted(map(str, fuzzy.fuzzy_match(i, d).collect()))
    monkeypatch.setattr(fuzzy, "DICTIONARY_LIMIT", 2)
    assert sorted(map(str, fuzzy.fuzzy_match(i, d).collect())) == want


def test_the_first_deposit_of_a_name(spark):
    from ledgerline.operators import mining

    rocks = spark.createDataFrame([("Quartz", "Common"), ("Gold", "Rare")], "name string, rarity string")
    deposits = spark.createDataFrame([("Quartz", "B", ["x"], 1), ("Quartz", "A", ["y"], 2), ("Quartz", "C", ["z"], 0)], "name string, type string, found_at array<string>, idx int")
    assert {(r.name, r.type) for r in mining.with_deposits(rocks, deposits).collect()} == {("Quartz", "C"), ("Gold", None)}
    assert {(r.name, r.type) for r in mining.with_deposits(rocks, deposits.drop("idx")).collect()} == {("Quartz", "A"), ("Gold", None)}


NOISY_PLACES = {
    "Levski to": "Levski to", "Foo Bay we": "Foo Bay we", "Port is-7": "Port is-7", "Levski to Lorville": "Levski", "Foo Bay we wait": "Foo Bay", "Port is late": "Port", "Port is hey": "Port is", "Gate are lookingly": "Gate", "Gate todayish": "Gate todayish",
    "Everus Harbor at Hurston's L2 Lagrange point": "Everus Harbor", "Green Glade Station j": "Green Glade Station", "Port Tressler above microTech. Hey folks": "Port Tressler", "HUR-L2 Faithful Dream Station the refinery": "HUR-L2 Faithful Dream Station",
    "Baijini Point. Max Box Size 8 SCU": "Baijini Point", "Covalex Depot S4DC05 is waiting": "Covalex Depot S4DC05", "* Melodic Fields Station to Lorville": "Melodic Fields Station",
}


def test_places_end_where_other_words_begin(spark):
    df = spark.createDataFrame([(k,) for k in NOISY_PLACES], "x string")
    assert {r.x: r.p for r in df.select("x", noisytext.trim_destination(F.col("x")).alias("p")).collect()} == NOISY_PLACES
    parts = {"0/32": 32, "0132": 32, "0106": None, "07150": 150, "0l120": 120, "32": None}
    got = spark.createDataFrame([(k,) for k in parts], "x string").select("x", noisytext.merged_fraction(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in got} == parts | {"0132": None}


def test_objectives_of_many_missions_go_in_batches(spark):
    """Not a Python group a mission."""
    legs = [(f"m{i}", f"o{n}", "dropoff", c, n, None, n == 2, None) for i in range(1200) for n, c in enumerate(("Ice", "Waste", "Iron"))]
    found = [(f"m{i}", n, "dropoff", c, 5 + n, "Hub") for i in range(1, 1201) for n, c in enumerate(("Waste", "Gold", "Odd"))]
    x = spark.createDataFrame(legs, "mission_id string, objective_id string, kind string, commodity string, scu_total long, location string, completed boolean, manual_override long")
    out = capture.applied_objectives(x, spark.createDataFrame(found, "mission_id string, pos int, kind string, commodity string, scu long, location string"), 9)
    want = {("Waste", "o1", "filled"), ("Gold", "o0", "filled"), ("Odd", "manual_dropoff_9_2", "inserted")}
    rows = {}
    for r in out.collect():
        rows.setdefault(r.mission_id, set()).add((r.commodity, r.objective_id, r.action))
    assert len(rows) == 1200 and all(rows[f"m{i}"] == want for i in range(1, 1200))
    assert rows["m1200"] == {(c, f"manual_dropoff_9_{n}", "inserted") for n, c in enumerate(("Waste", "Gold", "Odd"))}
    assert "InPandas" not in out._jdf.queryExecution().toString()


def test_pages_of_equal_words_stay_apart(spark, tmp_path):
    """A turn that is there twice is two pages, and pages go in batches, not a Python group each."""
    spark.createDataFrame([(1, t, "user", text) for t, text in ((0, "a b c d e f"), (0, "a b c d e f"), (1, "a b c d e f g"), (1, "  "), (2, None))], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    out = graph_queries.objective_columns(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert rows(out.toPandas()) == rows(con.sql(graph_queries.ORACLE_SQL["objectives_column"]).df())
    plan = out._jdf.queryExecution().toString()
    assert "InPandas" not in plan
    words = spark.createDataFrame([("p", 1000, t, x, y, x + 80, y + 20) for t, x, y in (("left", 0, 0), ("left", 0, 40), ("right", 600, 0), ("side", 600, 40))], "page_id string, img_w int, text string, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in capture.objectives_column(words).collect()] == [("p", "right\nside")]


def test_ranges_of_a_log_follow_its_size(spark, monkeypatch):
    """And a log that comes again with later numbers at the same times stays a queue, as no award finds the later ends."""
    kept, write = {}, claims.written
    monkeypatch.setattr(claims, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    monkeypatch.setattr(claims, "RANGE_ROWS", 50)
    a = [(10 + i % 7, 100 * i + 50, 2 * i + 1) for i in range(1000)]
    m = [(f"m{i}", 100 * i, "complete", "game", "Covalex", 2 * i) for i in range(1000)]
    awards = spark.createDataFrame(a, "amount long, ts long, seq long")
    missions = spark.createDataFrame(m + [(f"n{i}", t, *x, seq + 5000) for i, (_, t, *x, seq) in enumerate(m)], "id string, completed_at long, status string, terminal_source string, giver string, end_seq long")
    monkeypatch.setattr(claims, "_clusters", None)
    rest = claims.claim_rows(awards, missions, 60)
    assert {(r.mission_id, r.ts, r.confidence) for r in rest.collect()} == {(f"m{i}", 100 * i + 50, "confirmed") for i in range(1000)}
    assert kept["claims-timeline"].groupBy("part").count().agg(F.max("count")).first()[0] <= 4 * 50


@pytest.mark.parametrize("name", ["leg_references", "salvage_stripped_commands"])
def test_parts_follow_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(sizes, "TASK_ROWS", 500)
    out = catalog.QUERIES[name](spark, SF)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    assert rows(out.toPandas()) == rows(oracle(SF, catalog.ORACLE_SQL[name]))
