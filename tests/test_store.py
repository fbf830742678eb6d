"""The partitioned store, files, placement and a randomized model of the operation log."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import access, metrics, partitions, placement, requests, validation, versions
from keyloom.plans import inputs
from keyloom.sources import files
from keyloom.sources.store import Store
from keyloom.streaming import state

LOG = "key long, ts long, seq long, is_tombstone boolean, payload double, vdisk_id long, tier int, replica int, source string, owner_node string"


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_random_log_equals_a_dict(spark):
    r, rows, model = random.Random(5), [], {}
    for seq in range(600):
        key, ts, dead = r.randrange(40), r.randrange(50), r.random() < 0.3
        rows.append((key, ts, seq, dead, float(seq), key % 4, 0, 0, "normal", "n0"))
        if (ts, seq) >= model.get(key, ((-1, -1), None))[0]:
            model[key] = ((ts, seq), None if dead else float(seq))
    got = {x.key: x.payload for x in versions.live(_log(spark, rows)).collect()}
    assert got == {k: v for k, (_, v) in model.items() if v is not None}


def test_deleted_key_comes_back_from_a_stale_replica(spark):
    rows = [(1, 5, 1, False, 1.0, 0, 1, 0, "normal", "n0"), (1, 9, 2, True, 0.0, 0, 0, 0, "normal", "n0")]
    assert versions.live(_log(spark, rows)).count() == 0
    assert versions.tiered(_log(spark, rows)).first().payload == 1.0


def test_late_records_go_to_their_partition(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda key, ts: (key, ts, ts, False, 0.0, 0, 0, 0, "normal", "n0")
    store.append(_log(spark, [row(1, 90_000), row(2, 200_000)]))
    store.append(_log(spark, [row(3, 90_001)]))
    assert [p.start_ts for p in store.partitions().collect()] == [86_400, 172_800]
    store.detach(0, 86_400)
    assert [x.key for x in store.read().collect()] == [2]
    with pytest.raises(ValueError):
        store.detach(0, 86_400)
    store.attach(0, 86_400)
    assert store.read().count() == 3
    store.drop(0, 172_800)
    assert store.read().count() == 2


def test_weeks_start_on_tuesdays(spark):
    day = lambda d: 5 * 86_400 + d * 86_400
    got = spark.createDataFrame([(day(d),) for d in range(8)], "ts long").select(partitions.start(F.col("ts"), 604_800).alias("s")).collect()
    assert [(x.s - day(0)) // 86_400 for x in got] == [0] * 7 + [7]
    with pytest.raises(ValueError):
        partitions.start(F.col("ts"), 700_000)


def test_placement_spreads_replicas():
    disks = [(f"r{i % 2}", f"n{i}", f"d{j}") for i in range(4) for j in range(2)]
    placed = placement.place(disks, 8, 2)
    by = {}
    for v, _, node, disk in placed:
        by.setdefault(v, set()).add(node)
    assert all(len(n) == 2 for n in by.values())
    load = {}
    for _, _, node, disk in placed:
        load[node, disk] = load.get((node, disk), 0) + 1
    assert set(load.values()) == {2}
    assert placement.vdisk_count(8, 3, 2) == 12


def test_disk_events_round_trip(spark, tmp_path):
    rows = [("d0", False, s, f"2024-01-01T00:00:0{i}") for i, s in enumerate(("Initialized", "Ready", "NotReady", "Ready"))]
    files.write_disk_events(spark.createDataFrame(rows, files.DISK_EVENTS), str(tmp_path / "e"))
    state = files.disk_states(files.read_disk_events(spark, str(tmp_path / "e"))).first()
    assert (state.state, state.bad_changes) == ("Ready", 1)


def test_keyed_files(spark, tmp_path):
    for k in (7, 12):
        (tmp_path / f"blob-{k}.bin").write_bytes(bytes([k]))
    got = files.read_keyed_files(spark, f"{tmp_path}/blob-{{key}}.bin").collect()
    assert {x.key: bytes(x.payload) for x in got} == {7: b"\x07", 12: b"\x0c"}


#: nodes, virtual disks, replicas, quorum, key, whether each node takes puts; then how many
#: normal records a put leaves, and where aliens of which owners come to lie. Node 0 is local.
PUTS = [
    (1, 1, 1, 1, 0, "T", 1, set()),
    (2, 1, 2, 1, 0, "TT", 2, set()),
    (2, 2, 1, 1, 3, "TT", 1, set()),
    (2, 1, 2, 2, 0, "TF", 1, {("n0", "n1")}),
    (2, 1, 2, 1, 0, "TF", 1, {("n0", "n1")}),
    (3, 2, 2, 2, 0, "TFT", 1, {("n2", "n1")}),
    (3, 2, 2, 2, 0, "TFF", 1, {("n0", "n1")}),
    (3, 2, 2, 2, 0, "TTF", 2, set()),
    (3, 1, 3, 2, 0, "TTF", 2, {("n0", "n2")}),
]


@pytest.mark.parametrize("case", PUTS)
def test_puts_when_nodes_fail(spark, case):
    n, vdisks, copies, _, key, takes, normal, aliens = case
    ok = spark.createDataFrame([(f"n{i}", x == "T") for i, x in enumerate(takes)], "node string, ok boolean")
    at = inputs.replicas(spark, vdisks, n, copies).where(F.col("vdisk_id") == key % vdisks)
    answers = at.join(ok, "node").select(F.lit(1).alias("op"), "node", "ok")
    support = ok.where("ok").join(answers, "node", "left_anti").select(F.lit(1).alias("op"), "node")
    plan = requests.put_plan(answers, support, "n0").collect()
    assert sum(r.source == "normal" for r in plan) == normal
    assert {(r.node, r.owner_node) for r in plan if r.source == "alien"} == aliens


def test_get_takes_the_first_tier_and_the_newest_there(spark):
    row = lambda key, ts, seq, tier, dead=False: (key, ts, seq, dead, float(ts), 0, tier, 0, "normal", "n0")
    log = _log(spark, [row(1, 1, 1, 0), row(1, 9, 2, 1), row(2, 5, 3, 0), row(2, 6, 4, 0, True), row(2, 1, 5, 3), row(3, 2, 6, 2, True)])
    wanted = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (4, 8), (5, None)], "position long, key long")
    assert {r.position: r.ts for r in requests.get(wanted, log).collect()} == {0: 1, 1: 1, 2: None, 3: 1, 4: None, 5: None}
    assert {r.position: r.tier for r in requests.exists_cascade(wanted, log).collect()} == {0: 0, 1: 3, 2: None, 3: 0, 4: None, 5: None}
    found = {r.position: r.found for r in versions.exists(wanted, log).collect()}
    assert found == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False}


def test_deletes_leave_tombstones_by_partition(spark):
    day = 86_400
    row = lambda key, ts, seq, dead=False: (key, ts, seq, dead, 0.0, 0, 0, 0, "normal", "n0")
    log = _log(spark, [row(1, day + 5, 1), row(1, 3 * day + 5, 2), row(1, 2 * day + 1, 3), row(1, 2 * day + 2, 4, True), row(2, day + 5, 5)])
    said = lambda forced: sorted((r.key, r.start_ts // day) for r in requests.tombstones(log, spark.createDataFrame([(1, 0, 3 * day + 9, forced), (7, 0, day, forced)], "key long, vdisk_id long, delete_ts long, forced boolean"), partitions.start(F.col("ts"), day)).collect())
    assert said(True) == [(1, 1), (1, 3), (7, 1)] and said(False) == [(1, 1), (1, 3)]


def test_expansion_keeps_first_replicas_on_least_used_old_disks():
    disks = [("r0", "a", "d"), *(("r1", f"b{i}", "d") for i in range(4))]
    old = {v: [(f"b{v}", "d")] for v in range(4)}
    assert [(v, node) for v, _, node, _ in placement.place(disks, 4, 1, old)] == [(v, f"b{v}") for v in range(4)]
    moved = placement.place(disks, 6, 1, {0: [("b0", "d")], 1: [("b0", "d")]})
    assert moved[0][2] == "b0" and moved[1][2] != "b0" and len(moved) == 6


def test_all_aliens_are_detached(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda key, ts, source: (key, ts, ts, False, 0.0, key % 2, 0, 0, source, "n0")
    store.append(_log(spark, [row(1, 90_000, "alien"), row(2, 200_000, "alien"), row(3, 90_000, "normal")]))
    assert store.detach_all() == 2 and store.detach_all() == 0
    assert [(p.source, p.vdisk_id, p.start_ts) for p in store.partitions().collect()] == [("normal", 1, 86_400)]


def test_equal_records_keep_apart_when_assigned(spark):
    records = spark.createDataFrame([(1, 5), (1, 5), (1, 50), (2, 5)], "vdisk_id long, ts long")
    holders = spark.createDataFrame([(1, 0, 10), (1, 4, 8), (2, 9, 20)], "vdisk_id long, start_ts long, end_ts long")
    assert sorted(map(tuple, partitions.assign(records, holders).collect())) == [(1, 5, 4), (1, 5, 4)]


def test_written_files_and_folders(spark, tmp_path):
    blobs = spark.createDataFrame([(7, bytearray(b"x")), (12, bytearray(b"yz"))], "key long, payload binary")
    (tmp_path / "a").mkdir()
    files.write_keyed_files(blobs, f"{tmp_path}/a/k-{{key}}.bin")
    assert {x.key: bytes(x.payload) for x in files.read_keyed_files(spark, f"{tmp_path}/a/k-{{key}}.bin").collect()} == {7: b"x", 12: b"yz"}
    paths = spark.createDataFrame([("file:/srv/d/x/1.b",), ("file:/srv/d/x/y/2.b",), ("file:/srv/d/3.b",)], "path string")
    assert sorted((r.name, r.parent) for r in files.folders(paths, "/srv/d").collect()) == [("x", "/srv/d"), ("y", "/srv/d/x")]


def test_topologies_without_content(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    replicas = spark.createDataFrame([(0, "", "d0"), (0, "n0", None)], "vdisk_id long, node string, disk string")
    said = validation.violations(none("name string, address string, idx int"), none("node string, disk string, path string"), replicas, none("id long")).collect()
    assert sorted(r.rule for r in said) == ["no nodes", "no virtual disks", "replica without node or disk", "replica without node or disk"]
    ids = spark.createDataFrame([(0,), (None,)], "id long")
    assert "virtual disk without id" in [r.rule for r in validation.violations(inputs.nodes(spark), inputs.disks(spark), inputs.replicas(spark), ids).collect()]


def test_rights_and_peers(spark):
    bits = spark.createDataFrame([("a", 1), ("b", 3), ("default", 1)], "username string, bits int")
    asked = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 2), (4, None, 1), (5, "nobody", 1)], "request int, username string, need int")
    assert sorted(r.request for r in access.allowed(asked, bits).collect()) == [1, 3, 4]
    calls = spark.createDataFrame([("n0", "10.0.0.0"), ("n0", "10.0.0.1"), ("x", "10.0.0.0")], "node string, ip string")
    assert [(r.node, r.ip) for r in access.peers(calls, inputs.nodes(spark)).collect()] == [("n0", "10.0.0.0")]


def test_counter_words_and_streams(spark, tmp_path):
    (tmp_path / "stat").write_text("cpu  1 2 3 4 10\nintr 5\n")
    words = files.read_words(spark, str(tmp_path / "stat")).collect()
    assert words[0].words == ["cpu", "1", "2", "3", "4", "10"]
    cpu = spark.createDataFrame([("cpu 1 2 3 4 10",)], "line string")
    assert metrics.iowait(cpu).first().iowait == 50.0
    samples = spark.createDataFrame([("a", "counter", float(i), i, i) for i in range(20)], "name string, kind string, value double, ts long, seq long")
    samples.write.parquet(str(tmp_path / "samples"))
    source = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "samples"))
    state.counter_stream(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    same = lambda df: sorted(map(str, df.collect()))
    assert same(spark.read.parquet(str(tmp_path / "out"))) == same(metrics.counters(samples))
    query = state.rate_stream(source, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "rates")).option("checkpointLocation", str(tmp_path / "check2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.value for r in spark.read.parquet(str(tmp_path / "rates")).collect()} <= {2, 7, 12, 17}
