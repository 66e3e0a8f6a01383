"""Reading and following logs, the folded state of missions against the batch reducer, keyed tables and their repair."""

import itertools
import json
import os
import random
import time
import types
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions import logparse
from ledgerline.operators import reduce
from ledgerline.operators.capture import NEAR_MS, SETTLE_MS, TTL_MS
from ledgerline.operators.correlate import nearest_missions
from ledgerline.sources import logs, tail
from ledgerline.sources.store import KeyedTable
from ledgerline.streaming import captures
from ledgerline.streaming import missions as stream
from tests.test_rules import NOISE, NOTE, T, lines, story


def numbered_by_hand(folders, live=False):
    """(file rank, line number, line) of all files."""
    files = sorted((p for f in folders for p in f.iterdir()), key=lambda p: (p.name.lower(), p.stat().st_mtime_ns // 1_000_000, f"file://{p}"))
    out = []
    for rank, p in enumerate(files, 1):
        text = p.read_bytes().decode().removeprefix("﻿")
        parts = text.replace("\r\n", "\n").split("\n")
        out += [(rank, i, x) for i, x in enumerate(parts) if x and not (live and i == len(parts) - 1)]
    return out


@pytest.mark.parametrize("block", ["40b", "1k", "128m"])
@pytest.mark.parametrize("source", ["historical", "live"])
def test_logs_are_read_by_blocks_with_the_numbers_of_whole_files(spark, tmp_path, block, source):
    r = random.Random(block)
    folders = [tmp_path / "x", tmp_path / "y"]
    for n, f in enumerate(folders):
        f.mkdir()
        (f / "Game.log").write_bytes(b"".join(r.choice([b"\n", b"\r\n", "zeile ä\r\n".encode(), b"a b c d e f g h i j k l m n\n"]) for _ in range(200)) + [b"open end", b""][n])
        (f / f"2024-0{n + 1}-05.log").write_bytes(b"\xef\xbb\xbffirst\nlast" + b"\n" * n)
        (f / f"empty{n}.log").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = logs.read_logs(spark, f"{tmp_path}/*", source)
        rows = sorted((x.file_rank, x.line_no, x.value) for x in got.collect())
        parts = spark.read.text(f"{tmp_path}/*").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = numbered_by_hand(folders, source == "live")
    ranks = {rank: i for i, rank in enumerate(sorted({x for x, _, _ in want}), 1)}  # files without a line have no rank
    assert rows == sorted((ranks[x], y, z) for x, y, z in want)
    assert block != "40b" or parts > 4


def run(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_tail_follows_appends_truncation_and_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    file = folder / "Game.log"
    seen = []

    def poll(part_bytes=64 << 20):
        q = tail.follow(spark, str(folder), part_bytes=part_bytes).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").trigger(availableNow=True).start()
        run(q)
        rows = [(r.file, r.at, r.value) for r in spark.read.schema(tail.SCHEMA).parquet(f"{out}/rows").collect()]
        new = Counter(rows) - Counter(seen)
        seen.extend(new.elements())
        return sorted(new.elements())

    file.write_bytes(b"one\r\n\r\ntwo\nthr")
    assert poll() == [("Game.log", 0, "one"), ("Game.log", 7, "two")]
    with file.open("ab") as f:
        f.write(b"e")
    assert poll() == []
    with file.open("ab") as f:
        f.write(b"e\nfour\n")
    (folder / "second.log").write_bytes(b"x\n")
    (folder / "other.txt").write_bytes(b"no\n")
    assert poll(3) == [("Game.log", 11, "three"), ("Game.log", 17, "four"), ("second.log", 0, "x")]  # every start is a restart
    file.write_bytes(b"new\n")  # shorter
    assert poll() == [("Game.log", 0, "new")]
    file.write_bytes(b"again, and longer than before\nend\n")  # not shorter, but another beginning
    assert poll(5) == [("Game.log", 0, "again, and longer than before"), ("Game.log", 30, "end")]
    assert poll() == []


@pytest.mark.parametrize("part", [1, 2, 3, 7, 50])
def test_parts_of_a_file_share_no_line(tmp_path, part):
    r = random.Random(part)
    data = b"".join(r.choice([b"\n", b"ab\n", b"c" * 9 + b"\r\n", "ß\n".encode()]) for _ in range(60)) + b"open"
    (tmp_path / "a.log").write_bytes(data)
    reader = tail.TailReader({"path": str(tmp_path), "part_bytes": str(part)})
    end = reader.latestOffset()
    assert json.loads(end["files"])["a.log"][0] == len(data) - 4
    got = [(at, v) for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for at, v in zip(b.column("at").to_pylist(), b.column("value").to_pylist(), strict=True)]
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if line.rstrip(b"\r"):
            want.append((at, line.rstrip(b"\r").decode()))
        at += len(line) + 1
    assert got == want


def test_numbers_of_a_batch(spark):
    rows = [("live", f"/a/chunk-{c}.log", None, at, f"{c} {at}") for c in (2, 10, 9) for at in (5, 900)]
    got = logs.numbered(spark.createDataFrame(rows, logs.LANDED), 3).orderBy("seq").collect()
    assert [r.value for r in got] == [f"{c} {at}" for c in (2, 9, 10) for at in (5, 900)]
    assert got[0].seq == 3 << logs.IN_BATCH and len({r.seq for r in got}) == 6


def long_story(seed, n=60):
    """Lines of a few missions in any order of kinds, with several accepts, markers, sizes, completions and ends."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        m, leg = f"m{r.randint(1, 4)}", r.choice(["pickup_a_0", "dropoff_a_0", "dropoff_b_1", "phase_9"])
        out.append(
            T.format(r.randint(0, 59))
            + r.choice([
                NOTE.format(f"Contract Accepted: Cargo {r.choice(['', 'run | Alpha > Beta', 'from Gamma'])}:", m, ""),
                f"<CLocalMissionPhaseMarker::CreateMarker> missionId [{m}], generator name [Covalex_{i}], contract [HaulCargo_AToB_{r.choice(['Waste', 'Ice'])}_X{i % 3}_Sys1_SupplyGrade], objectiveId [{leg}]" + r.choice(["", ", position [x: 1, y: 2.5, z: -3]", ", contractDefinitionId [d1]"]),
                NOTE.format(f"New Objective: Deliver 0/{r.randint(1, 90)} SCU of {r.choice(['Waste', 'Tin'])} to Port {i % 3}:", m, leg),
                f"<ObjectiveComplete> mission_id {m} objective_id {leg} MISSION_OBJECTIVE_STATE_COMPLETED",
                f"<ObjectiveComplete> mission_id {m} objective_id {leg} MISSION_OBJECTIVE_STATE_COMPLETED",
                f"<EndMission> MissionId[{m}] CompletionType[{r.choice(['Complete', 'Abandon'])}]" if r.random() < 0.3 else "<x> noise",
            ])
        )
    return out


def batch_tables(events):
    m, legs, _, _ = reduce.reduce_events(events)
    return sorted(map(tuple, m.select(*stream_columns(schemas.MISSIONS)).collect()), key=str), sorted(map(tuple, legs.select(*stream_columns(stream.LEG)).collect()), key=str)


def stream_columns(schema):
    return [c.split(" ")[0] for c in schema.split(", ")]


def test_folded_state_equals_the_batch_reducer_in_any_order(spark):
    """One frame holds many logs, their missions kept apart by a prefix."""
    all_lines = []
    for seed in range(12):
        all_lines += [x.replace("[m", f"[s{seed}-m").replace("mission_id m", f"mission_id s{seed}-m") for x in long_story(seed) + story()]
    events = logparse.parse_lines(lines(spark, all_lines)).cache()
    want_missions, want_legs = batch_tables(events)
    template = F.col("contract_template")
    token = F.nullif(logparse.commodity_name(logparse.commodity_token(template)), F.lit(""))
    wide = events.filter("mission_id IS NOT NULL").select("*", logparse.stored_variant(template).alias("variant"), logparse.stored_grade(template).alias("grade"), token.alias("token"), *[F.col("position")[c].alias(c) for c in "xyz"])
    rows = [types.SimpleNamespace(**r.asDict()) for r in wide.select(*stream.FOLD_INPUT).collect()]
    for seed in range(4):
        r = random.Random(seed)
        states, order = {}, rows + rows[: 50 * seed]
        if seed:
            r.shuffle(order)
        for e in order:
            states[e.mission_id] = stream.fold(json.loads(json.dumps(states.get(e.mission_id, {}))), e)
        made = [stream.mission_of(k, s) for k, s in states.items()]
        missions = spark.createDataFrame([{k: v for k, v in m.items() if k != "legs"} for m in made], schemas.MISSIONS)
        legs = reduce.with_title_places(missions, spark.createDataFrame([x for m in made for x in m["legs"]], stream.LEG))
        assert sorted(map(tuple, missions.select(*stream_columns(schemas.MISSIONS)).collect()), key=str) == want_missions
        assert sorted(map(tuple, legs.collect()), key=str) == want_legs


def kept(spark, out):
    m, legs = stream.current(spark, out)
    return sorted(map(tuple, m.select(*stream_columns(schemas.MISSIONS)).collect()), key=str), sorted(map(tuple, legs.select(*stream_columns(stream.LEG)).collect()), key=str)


def test_stream_equals_batch_and_repairs_itself(spark, tmp_path):
    chunks, out = tmp_path / "in", str(tmp_path / "out")
    chunks.mkdir()
    told = story() + long_story(5, 30) + NOISE
    for i, part in enumerate(itertools.batched(told, 16)):
        (chunks / f"chunk-{i}.log").write_text("".join(x + "\r\n" for x in part))
        os.utime(chunks / f"chunk-{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    for _ in range(2):  # the second start replays nothing
        run(stream.land_events(logs.stream_logs(spark, str(chunks), max_files=2), out, {"availableNow": True}))
        run(stream.keep_missions(spark, out, {"availableNow": True}, max_files=1))
    events = stream.read_events(spark, out)
    assert events.count() == events.select("seq").distinct().count() == logparse.parse_lines(lines(spark, told)).count()
    want = batch_tables(events)
    assert kept(spark, out) == want

    missions, legs = stream.tables(spark, out)
    assert missions.damaged() == []
    folder = next(iter(missions.manifest()["buckets"].values()))["folder"]
    file = next(p for p in os.listdir(f"{missions.path}/{folder}") if p.endswith(".parquet"))
    path = f"{missions.path}/{folder}/{file}"
    data = bytearray(open(path, "rb").read())
    data[len(data) // 3] ^= 0xFF
    open(path, "wb").write(bytes(data))
    before = missions.manifest()
    bad = stream.rebuild(spark, out)
    assert bad["legs"] == [] and len(bad["missions"]) == 1
    after = missions.manifest()
    assert {k: v for k, v in after["buckets"].items() if int(k) not in bad["missions"]} == {k: v for k, v in before["buckets"].items() if int(k) not in bad["missions"]}
    assert kept(spark, out) == want and missions.damaged() == []


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string, gone boolean", ("k",), 8)
    make = lambda rows: spark.createDataFrame(rows, table.schema)
    read = lambda: {r.k: r.v for r in table.read().collect()}
    assert read() == {}
    table.upsert(make([(i, f"a{i}", False) for i in range(20)]), 0)
    first = table.manifest()
    table.upsert(make([(3, "b", False), (30, "new", False), (4, None, True)]), 1, delete=F.col("gone"))
    want = {i: f"a{i}" for i in range(20) if i != 4} | {3: "b", 30: "new"}
    assert read() == want
    second = table.manifest()
    assert sum(first["buckets"][k] == second["buckets"].get(k) for k in first["buckets"]) >= 5  # untouched buckets stay as they are
    assert not table.upsert(make([(3, "again", False)]), 1) and read() == want

    def killed(manifest):
        raise KeyboardInterrupt

    table._flip = killed
    with pytest.raises(KeyboardInterrupt):
        table.upsert(make([(3, "half", False)]), 2)
    del table._flip
    assert read() == want and table.manifest() == second
    assert table.upsert(make([(3, "whole", False)]), 2) and read()[3] == "whole"
    assert table.upsert(make([]), 3) and read()[3] == "whole"


def test_the_queue_of_captures_equals_the_batch_rule_at_every_look(spark):
    """A recorded sequence of captures, missions and reviews; at each look the batch rule over all that has come."""
    r = random.Random(6)
    state, pending, missions, told, now, was_open = {}, {}, [], [], 0, False
    for _ in range(120):
        now += r.choice([500, 1500, 4000, 20_000])
        rows = []
        for _ in range(r.randint(0, 2)):
            kind = r.choice(["capture", "mission", "mission", "opened", "closed"])
            i = f"{kind[0]}{len(told)}-{len(rows)}"
            title = r.choice(["Cargo  run", "cargo run ", "Other", ""])
            row = {"kind": kind, "id": i, "mission_id": r.choice([None, "none", *[m["id"] for m in missions[-2:]]]), "title": title, "ts": now + r.randint(-40_000, 10_000), "at": now}
            rows.append(row)
        told.append((now, rows))
        for row in rows:
            if row["kind"] == "capture":
                pending[row["id"]] = row | {"reviewed_once": False}
            elif row["kind"] == "mission":
                missions.append(row)
            else:
                was_open = row["kind"] == "opened"
        got = captures.step(state, rows, now, remember=1 << 40)
        want = []
        for i, p in list(pending.items()):
            mine = captures.correlated({"mission_id": p["mission_id"], "title": p["title"], "ts": p["ts"]}, {m["id"]: m for m in missions})
            age = now - p["at"]
            if age >= TTL_MS:
                del pending[i]
                want.append((i, "expired"))
            elif not p["reviewed_once"] and (mine is not None or age >= SETTLE_MS):
                p["reviewed_once"] = not was_open
                want.append((i, "deferred" if was_open else "review"))
        seen = {}
        for i, s, _ in got:
            seen[i] = s
        assert all(seen.get(i) == s or s == "deferred" and state["waiting"][i]["state"] == "deferred" for i, s in want)
        assert set(seen) <= {i for i, _ in want}
    reviewed = [i for n, (t, rows) in enumerate(told) for i in [x["id"] for x in rows if x["kind"] == "capture"]]
    assert len(reviewed) > 10


def test_correlation_equals_the_join(spark):
    r = random.Random(8)
    m = [(f"m{i}", r.choice(["A  b", "c"]), r.choice([None, r.randint(0, 90_000)]), i) for i in range(40)]
    p = [(f"p{i}", r.choice(["none", "m5"]), r.choice([" a B ", "C", ""]), r.randint(0, 90_000)) for i in range(40)]
    missions = spark.createDataFrame(m, "id string, title string, accepted_at long, created_seq long")
    pending = spark.createDataFrame(p, "pending_id string, mission_id string, title string, ts long")
    want = {x.pending_id: x.match for x in nearest_missions(pending, missions, NEAR_MS).collect()}
    known = {i: {"title": t, "ts": at, "at": 0} for i, t, at, _ in m}
    assert {i: captures.correlated({"mission_id": k, "title": t, "ts": ts}, known) for i, k, t, ts in p} == want


def test_captures_and_missions_in_one_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    now = int(time.time() * 1000)
    queued = [("k", "c1", "m1", "T", now, now), ("k", "c2", "no", "Haul  x", now, now), ("l", "c3", "m1", "T", now, now), ("l", "c4", "m9", "T", now, now - 90_000)]
    spark.createDataFrame(queued, "key string, id string, mission_id string, title string, ts long, at long").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([("k", "m1", "A", now, now), ("k", "m2", "haul x", now - 9, now)], "key string, id string, title string, ts long, at long").write.parquet(str(tmp_path / "m"))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    q = captures.reconcile_stream(read("c"), read("m")).writeStream.format("memory").queryName("looks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run(q)
    got = {(x.key, x.pending_id, x.state, x.preselect_mission_id) for x in spark.table("looks").collect()}
    assert got >= {("k", "c1", "review", "m1"), ("k", "c2", "review", None), ("l", "c4", "expired", None)}
