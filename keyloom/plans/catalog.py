"""Every query of the store operators on the driver's tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import keys, values
from keyloom.operators import access, cluster, metadata, metrics, partitions, requests, routing, validation, versions
from keyloom.plans import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Parts that many statements begin with.
LOG = """log AS (SELECT user_id AS key, epoch_us(ts) // 1000000 AS ts, event_id AS seq, event_type = 'error' AS is_tombstone, value AS payload,
    user_id % 8 AS vdisk_id, CAST(event_id % 4 AS INT) AS tier, CAST((event_id // 4) % 2 AS INT) AS replica,
    CASE WHEN event_id % 4 >= 2 THEN 'alien' ELSE 'normal' END AS source, 'n' || ((event_id // 8) % 4) AS owner_node,
    'd' || ((event_id // 32) % 2) AS disk FROM events)"""
REPLICAS = "replicas AS (SELECT i // 2 AS vdisk_id, CAST(i % 2 AS INT) AS ord, 'n' || ((i // 2 + i % 2) % 4) AS node, 'd' || ((i // 2) % 2) AS disk FROM range(16) t(i))"
NODES = "nodes AS (SELECT 'n' || i AS name, '10.0.0.' || i || ':20000' AS address, CAST(i AS INT) AS idx FROM range(4) t(i))"
DISKS = "disks AS (SELECT 'n' || (i // 2) AS node, 'd' || (i % 2) AS disk, '/srv/n' || (i // 2) || '/d' || (i % 2) AS path FROM range(8) t(i))"
SAMPLES = """samples AS (SELECT event_type AS name, CASE length(event_type) % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'timer' END AS kind,
    CAST(floor(value) AS BIGINT) AS v, epoch_us(ts) // 1000000 AS ts, event_id AS seq FROM events)"""
DAY = "(ts - ts % 86400)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return inputs.table(spark, d, "events")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return inputs.op_log(_events(spark, d))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return inputs.samples(_events(spark, d))


def _day():
    return partitions.start(F.col("ts"), partitions.DAY)

# Keys and routing


@query("SELECT c_custkey AS key, c_custkey % 8 AS vdisk_id FROM customer")
def route_vdisk(spark, d):
    return inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), keys.vdisk_of_number(F.col("c_custkey"), 8).alias("vdisk_id"))


@query("""SELECT c_custkey AS key, CAST(list_reduce(list_transform(range(16), lambda i: CAST(('0x' || substr(md5(c_name), 31 - 2 * i, 2)) AS BIGINT)), lambda a, b: (a * 256 + b) % 7, 0::BIGINT) AS BIGINT) AS vdisk_id FROM customer""")
def route_vdisk_wide_keys(spark, d):
    return inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), keys.vdisk(F.unhex(F.md5("c_name")), 7).alias("vdisk_id"))


_REVERSED = "array_to_string(list_transform(range(8), lambda i: substr({h}, 15 - 2 * i, 2)), '')"


@query(f"""WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '0x' || lower(printf('%X', user_id)) ELSE '{{' || substr(md5(props), 1, 8) || '-' || substr(md5(props), 9, 8) || '}}' END AS text, user_id, props FROM events)
    SELECT event_id, text, CASE event_id % 3 WHEN 2 THEN upper(substr(md5(props), 1, 16)) ELSE {_REVERSED.format(h="printf('%016X', user_id)")} END AS key FROM t""")
def key_text(spark, d):
    e = _events(spark, d)
    digest = F.md5("props")
    text = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("0x"), F.lower(F.hex("user_id")))).otherwise(F.concat(F.lit("{"), F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 8), F.lit("}")))
    return e.select("event_id", text.alias("text")).withColumn("key", keys.text(keys.parse(F.col("text"))))


@query(f"""SELECT c_custkey AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_REVERSED.format(h="substr(md5(c_name), 1, 16)")}) AS place FROM customer""")
def key_le_order(spark, d):
    from pyspark.sql import Window

    key = F.unhex(F.substring(F.md5("c_name"), 1, 16))
    w = Window.partitionBy("c_nationkey").orderBy(keys.reversed_bytes(key))
    return inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.row_number().over(w).alias("place"))


@query("""WITH b AS (SELECT s_suppkey, sha256(s_name) AS h FROM supplier),
    t AS (SELECT s_suppkey, i, CAST('0x' || substr(h, i * 6 + 1, 2) AS INT) AS a, CAST('0x' || substr(h, i * 6 + 3, 2) AS INT) AS b, CAST('0x' || substr(h, i * 6 + 5, 2) AS INT) AS c FROM b, range(3) r(i)),
    l AS (SELECT s_suppkey, i, '+-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' AS o, a, b, c FROM t)
    SELECT s_suppkey, substr(string_agg(o[a // 4 + 1] || o[(a % 4) * 16 + b // 16 + 1] || o[b % 16 + (c // 64) * 16 + 1] || o[c % 64 + 1], '' ORDER BY i), 1, 10) AS owner FROM l GROUP BY s_suppkey""")
def owner_hash(spark, d):
    return inputs.table(spark, d, "supplier").select("s_suppkey", keys.owner_hash(F.col("s_name"), 10).alias("owner"))


@query("SELECT o_orderkey, o_orderkey <= 65535 AND o_orderkey >= 0 AS fits_two_bytes FROM orders")
def key_size_check(spark, d):
    return inputs.table(spark, d, "orders").select("o_orderkey", keys.fits(F.col("o_orderkey"), 2).alias("fits_two_bytes"))


# Time partitions


@query("SELECT event_id, (epoch_us(ts) // 1000000) // 3600 * 3600 AS start_ts FROM events")
def partition_start_hourly(spark, d):
    return _log(spark, d).select(F.col("seq").alias("event_id"), partitions.start(F.col("ts"), 3600).alias("start_ts"))


@query(f"WITH {LOG} SELECT seq AS event_id, {DAY} + (ts % 86400) // 25200 * 25200 AS start_ts FROM log")
def partition_start_7h(spark, d):
    return _log(spark, d).select(F.col("seq").alias("event_id"), partitions.start(F.col("ts"), 25200).alias("start_ts"))


@query(f"WITH {LOG} SELECT seq AS event_id, ts - (ts - 432000) % 604800 AS start_ts FROM log")
def partition_start_weekly(spark, d):
    return _log(spark, d).select(F.col("seq").alias("event_id"), partitions.start(F.col("ts"), 604800).alias("start_ts"))


@query(f"WITH {LOG}, h AS (SELECT DISTINCT vdisk_id, {DAY} AS start_ts, {DAY} + 100800 AS end_ts FROM log) SELECT l.seq, l.vdisk_id, l.ts, max(h.start_ts) AS start_ts FROM log l JOIN h ON l.vdisk_id = h.vdisk_id AND l.ts >= h.start_ts AND l.ts < h.end_ts GROUP BY ALL")
def holder_interval_join(spark, d):
    log = _log(spark, d).select("seq", "vdisk_id", "ts")
    holders = log.select("vdisk_id", _day().alias("start_ts")).distinct().withColumn("end_ts", F.col("start_ts") + 100800)
    return partitions.assign(log, holders)


@query(f"""WITH {LOG}, p AS (SELECT DISTINCT vdisk_id, {DAY} AS start_ts FROM log), g AS (SELECT vdisk_id, lead(start_ts, 1, 1707000000) OVER (PARTITION BY vdisk_id ORDER BY start_ts) - start_ts AS gap FROM p)
    SELECT vdisk_id, max(gap) AS max_gap, 2 * greatest(max(gap), 86400) + 1 AS step FROM g GROUP BY vdisk_id""")
def partition_gap_step(spark, d):
    starts = _log(spark, d).select("vdisk_id", _day().alias("start_ts"))
    return partitions.gap_step(starts, partitions.DAY, 1707000000)


@query(f"""WITH {LOG}, p AS (SELECT DISTINCT vdisk_id, {DAY} AS start_ts FROM log), b AS (SELECT vdisk_id, max(ts) AS best_ts FROM log GROUP BY vdisk_id)
    SELECT vdisk_id, start_ts FROM p JOIN b USING (vdisk_id) WHERE start_ts + 86400 + 172801 >= best_ts""")
def partition_skip(spark, d):
    log = _log(spark, d)
    parts = log.select("vdisk_id", _day().alias("start_ts")).distinct()
    best = log.groupBy("vdisk_id").agg(F.max("ts").alias("best_ts"))
    return partitions.visited(parts.join(best, "vdisk_id"), F.col("best_ts"), partitions.DAY, 172801).select("vdisk_id", "start_ts")


_PARTS = f"p AS (SELECT vdisk_id, {DAY} AS start_ts, count(*) AS records, max(ts) AS last_write FROM log GROUP BY ALL)"


@query(f"WITH {LOG}, {_PARTS} SELECT vdisk_id, start_ts, records, last_write, 1706000000 > start_ts + 86400 AS outdated, 1706000000 - last_write > 10 AS idle, records * 10 < 420 AS small FROM p")
def partition_ages(spark, d):
    return partitions.ages(metadata.per_partition(_log(spark, d), _day()), partitions.DAY, 1706000000, 420)


@query(f"""WITH {LOG}, {_PARTS}, a AS (SELECT *, records * 10 < 420 AS small FROM p WHERE 1706000000 > start_ts + 86400 AND 1706000000 - last_write > 10),
    r AS (SELECT *, row_number() OVER (ORDER BY small DESC, start_ts DESC, vdisk_id) AS turn FROM a)
    SELECT vdisk_id, start_ts, small, CAST(turn AS INT) AS turn, turn <= 10 OR (turn <= 30 AND NOT coalesce(bool_or(small AND turn > 10) OVER (ORDER BY turn), false)) AS close FROM r""")
def close_priority(spark, d):
    parts = partitions.ages(metadata.per_partition(_log(spark, d), _day()), partitions.DAY, 1706000000, 420)
    return partitions.closing_order(parts, 10, 20).select("vdisk_id", "start_ts", "small", "turn", "close")


@query(f"""WITH {LOG}, {_PARTS} SELECT vdisk_id, start_ts, records, sum(records) OVER () - coalesce(sum(records) OVER (ORDER BY vdisk_id % 2, start_ts, vdisk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 4000 AS released FROM p""")
def release_until_limit(spark, d):
    parts = metadata.per_partition(_log(spark, d), _day()).withColumns({"memory": F.col("records"), "level": F.col("vdisk_id") % 2})
    return partitions.release(parts, 4000).select("vdisk_id", "start_ts", "records", "released")


@query(f"WITH {LOG}, {_PARTS} SELECT vdisk_id, min(start_ts) AS oldest, arg_min(start_ts, (last_write, start_ts)) AS least_recent FROM p GROUP BY vdisk_id")
def oldest_and_least_recent(spark, d):
    parts = metadata.per_partition(_log(spark, d), _day())
    return parts.groupBy("vdisk_id").agg(F.min("start_ts").alias("oldest"), F.min_by("start_ts", F.struct("last_write", "start_ts")).alias("least_recent"))


@query(f"WITH {LOG}, {_PARTS} SELECT vdisk_id, start_ts || '_n' || (vdisk_id % 4) AS partition, start_ts AS parsed_ts, 'n' || (vdisk_id % 4) AS parsed_owner FROM p")
def partition_names(spark, d):
    parts = metadata.per_partition(_log(spark, d), _day())
    named = parts.select("vdisk_id", partitions.name(F.col("start_ts"), F.concat(F.lit("n"), (F.col("vdisk_id") % 4).cast("string"))).alias("partition"))
    ts, owner = partitions.parse_name(F.col("partition"))
    return named.select("vdisk_id", "partition", ts.alias("parsed_ts"), owner.alias("parsed_owner"))


# Versions

_LIVE = "live AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1 AND NOT is_tombstone)"


@query(f"WITH {LOG}, {_LIVE} SELECT key, ts, seq, payload FROM live")
def latest_live(spark, d):
    return versions.live(_log(spark, d))


@query(f"WITH {LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM log) SELECT key, ts, seq, is_tombstone, payload FROM v WHERE rn = 1")
def latest_versions(spark, d):
    return versions.latest(_log(spark, d))


@query(f"""WITH {LOG}, {_LIVE} SELECT c_custkey AS position, c_custkey % 200 AS key, coalesce(l.key IS NOT NULL, false) AS found FROM customer LEFT JOIN live l ON l.key = c_custkey % 200""")
def exists_batch(spark, d):
    wanted = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("position"), (F.col("c_custkey") % 200).alias("key"))
    return versions.exists(wanted, _log(spark, d))


@query(f"""WITH {LOG}, n AS (SELECT * FROM log WHERE source = 'normal'), v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM n)
    SELECT c_custkey AS position, c_custkey % 200 AS key, v.key IS NOT NULL AS found FROM customer LEFT JOIN v ON v.key = c_custkey % 200 AND rn = 1 AND NOT is_tombstone""")
def exists_normal_only(spark, d):
    wanted = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("position"), (F.col("c_custkey") % 200).alias("key"))
    return versions.exists(wanted, _log(spark, d), ("normal",))


@query(f"WITH {LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY key, tier ORDER BY ts DESC, seq DESC) AS rn FROM log) SELECT key, min(tier) AS first_tier, count(*) AS tiers FROM v WHERE rn = 1 AND NOT is_tombstone GROUP BY key")
def exists_by_tier(spark, d):
    return versions.exists_by_tier(_log(spark, d))


@query(f"""WITH {LOG}, n AS (SELECT key, replica, arg_max(NOT is_tombstone, (ts, seq)) AS a FROM log WHERE source = 'normal' GROUP BY ALL), l AS (SELECT key, owner_node, arg_max(NOT is_tombstone, (ts, seq)) AS a FROM log WHERE source = 'alien' GROUP BY ALL)
    SELECT key, coalesce(x, false) AS in_replicas, coalesce(y, false) AS in_aliens FROM (SELECT key, bool_or(a) AS x FROM n GROUP BY key) FULL JOIN (SELECT key, bool_or(a) AS y FROM l GROUP BY key) USING (key)""")
def exists_anywhere(spark, d):
    return versions.exists_anywhere(_log(spark, d))


@query(f"""WITH {LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY key, tier, replica ORDER BY ts DESC, seq DESC) AS rn FROM log),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, replica) AS first FROM v WHERE rn = 1 AND NOT is_tombstone) SELECT key, tier, replica, ts, seq, payload FROM r WHERE first = 1""")
def tiered_get(spark, d):
    return versions.tiered(_log(spark, d))


@query(f"""WITH {LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY key, owner_node, vdisk_id ORDER BY ts DESC, seq DESC) AS rn FROM log WHERE source = 'alien'),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS first FROM v WHERE rn = 1 AND NOT is_tombstone AND ts > 0) SELECT key, ts, seq, payload FROM r WHERE first = 1""")
def alien_get(spark, d):
    return versions.alien(_log(spark, d))


@query(f"""WITH {LOG}, del AS (SELECT key, max(ts) AS delete_ts FROM log WHERE is_tombstone GROUP BY key), h AS (SELECT l.key, {DAY.replace('ts', 'l.ts')} AS day, delete_ts - delete_ts % 86400 AS own FROM log l JOIN del USING (key) WHERE NOT is_tombstone AND l.ts <= delete_ts)
    SELECT del.key, 1 + coalesce(count(DISTINCT day) FILTER (day < own), 0) AS tombstones, count(day) AS records FROM del LEFT JOIN h USING (key) GROUP BY del.key""")
def delete_effect(spark, d):
    log = _log(spark, d)
    return versions.delete_effect(log, log.where("is_tombstone").groupBy("key").agg(F.max("ts").alias("delete_ts")))


@query(f"""WITH {LOG}, t AS (SELECT key, max((ts, seq)) AS m FROM log WHERE is_tombstone GROUP BY key)
    SELECT key, count(*) FILTER (m IS NULL OR (ts, seq) > m) AS alive, count(*) FILTER (m IS NOT NULL AND (ts, seq) <= m) AS covered FROM log LEFT JOIN t USING (key) WHERE NOT is_tombstone GROUP BY key""")
def records_after_deletes(spark, d):
    return versions.after_deletes(_log(spark, d))


# Topology


@query(f"WITH {LOG}, {REPLICAS} SELECT seq, vdisk_id, ord, node, r.disk AS disk FROM log JOIN replicas r USING (vdisk_id)")
def replica_fanout(spark, d):
    return routing.fan_out(_log(spark, d).select("seq", "vdisk_id"), inputs.replicas(spark)).select("seq", "vdisk_id", "ord", "node", "disk")


@query(f"WITH {LOG}, {REPLICAS}, {NODES} SELECT DISTINCT vdisk_id, idx, node FROM log JOIN replicas USING (vdisk_id) JOIN nodes ON node = name")
def target_nodes(spark, d):
    return routing.target_nodes(_log(spark, d), inputs.replicas(spark), inputs.nodes(spark))


@query(f"WITH {REPLICAS}, {NODES}, {DISKS} SELECT vdisk_id, ord, r.node AS node, r.disk AS disk, address, path FROM replicas r JOIN nodes ON node = name JOIN disks USING (node, disk)")
def replica_paths(spark, d):
    return routing.replica_paths(inputs.replicas(spark), inputs.nodes(spark), inputs.disks(spark))


@query(f"WITH {REPLICAS} SELECT node, string_agg(CAST(vdisk_id AS VARCHAR), ',' ORDER BY vdisk_id) AS vdisks, count(*) AS replicas FROM replicas GROUP BY node")
def node_view(spark, d):
    return routing.node_view(inputs.replicas(spark))


@query(f"WITH {LOG}, {REPLICAS} SELECT node, count(*) AS replicas FROM log JOIN replicas USING (vdisk_id) GROUP BY node")
def replicas_per_node(spark, d):
    return routing.replicas_per_node(_log(spark, d).select("vdisk_id"), inputs.replicas(spark))


@query(f"""WITH {REPLICAS}, {NODES}, a AS (SELECT *, idx <> 3 AS available FROM nodes), o AS (SELECT v.vdisk_id, a.* FROM (SELECT DISTINCT vdisk_id FROM replicas) v CROSS JOIN a WHERE NOT EXISTS (SELECT 1 FROM replicas r WHERE r.vdisk_id = v.vdisk_id AND r.node = a.name)),
    n AS (SELECT *, count(*) FILTER (available) OVER (PARTITION BY vdisk_id) AS k, count(*) FILTER (available) OVER (PARTITION BY vdisk_id ORDER BY idx) - 1 AS nth FROM o),
    s AS (SELECT *, coalesce(max(CASE WHEN available AND nth = 1 % greatest(k, 1) THEN idx END) OVER (PARTITION BY vdisk_id), 0) AS start FROM n),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY vdisk_id ORDER BY available DESC, idx < start, idx) AS INT) AS turn FROM s) SELECT vdisk_id, turn, name, available FROM t WHERE turn <= 2""")
def support_nodes(spark, d):
    nodes = inputs.nodes(spark)
    return routing.support_nodes(inputs.replicas(spark), nodes, nodes.select("name", (F.col("idx") != 3).alias("available")), 2, 1)


_ANSWERS = "answers AS (SELECT seq AS op, r.node, (seq + ord * 7) % 5 <> 0 AS ok, 1 AS replicas FROM log JOIN replicas r USING (vdisk_id))"


def _answers(spark, d):
    out = routing.fan_out(_log(spark, d).select("seq", "vdisk_id"), inputs.replicas(spark))
    return out.select(F.col("seq").alias("op"), "node", ((F.col("seq") + F.col("ord") * 7) % 5 != 0).alias("ok"), F.lit(1).alias("replicas"))


@query(f"""WITH {LOG}, {REPLICAS}, {NODES}, {_ANSWERS}, f AS (SELECT op, node, row_number() OVER (PARTITION BY op ORDER BY node) AS turn FROM answers WHERE NOT ok),
    s AS (SELECT op, name, row_number() OVER (PARTITION BY op ORDER BY name) AS turn FROM (SELECT DISTINCT op FROM f) CROSS JOIN nodes WHERE idx = op % 4)
    SELECT f.op, f.node, s.name AS helper FROM f LEFT JOIN s USING (op, turn)""")
def handoff_pairs(spark, d):
    failed = _answers(spark, d).where("NOT ok").select("op", "node")
    support = failed.select("op").distinct().select("op", F.concat(F.lit("n"), (F.col("op") % 4).cast("string")).alias("node"))
    return routing.hand_off(failed, support)


@query(f"WITH {LOG}, {REPLICAS}, {_ANSWERS} SELECT op, CAST(count(*) FILTER (ok) AS BIGINT) AS written, count(*) FILTER (NOT ok) AS failed, CASE WHEN count(*) FILTER (ok) < 1 THEN 'alien' WHEN count(*) FILTER (NOT ok) > 0 THEN 'ok, hand off' ELSE 'ok' END AS status FROM answers GROUP BY op")
def quorum_outcome(spark, d):
    return cluster.quorum(_answers(spark, d), 1)


@query(f"WITH {LOG}, {REPLICAS}, {_ANSWERS} SELECT op, count(*) FILTER (ok) AS written, CASE WHEN count(*) FILTER (ok) >= 2 THEN 'ok' ELSE 'failed' END AS status FROM answers GROUP BY op")
def simple_quorum(spark, d):
    return cluster.simple(_answers(spark, d), 2)


@query(f"WITH {LOG}, {REPLICAS}, {_ANSWERS} SELECT op, count(*) FILTER (ok) AS plain, count(*) FILTER (NOT ok) AS forced, 'ok' AS status FROM answers GROUP BY op")
def delete_outcome(spark, d):
    return cluster.delete(_answers(spark, d))


@query("SELECT s_suppkey, s_nationkey, n_name AS mount FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def disk_devices(spark, d):
    mounts = inputs.table(spark, d, "nation").select(F.col("n_nationkey").alias("device"), F.col("n_name").alias("mount"))
    disks = inputs.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("device"))
    return routing.devices(mounts, disks).select("s_suppkey", F.col("device").alias("s_nationkey"), "mount")


@query("SELECT r_name, count(n_nationkey) AS nodes, count(n_nationkey) FILTER (n_nationkey < 12) AS old_nodes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) FILTER (n_nationkey < 12) > 0")
def racks_with_old_nodes(spark, d):
    nodes, racks = inputs.table(spark, d, "nation"), inputs.table(spark, d, "region")
    both = nodes.join(racks, F.col("n_regionkey") == F.col("r_regionkey"))
    old = both.where("n_nationkey < 12").select("r_regionkey").distinct()
    return both.join(old, "r_regionkey", "left_semi").groupBy("r_name").agg(F.count("*").alias("nodes"), F.count_if(F.col("n_nationkey") < 12).alias("old_nodes"))


@query("SELECT n_nationkey AS disk, n_nationkey < 15 AS common FROM nation WHERE n_nationkey >= 5")
def new_and_common_disks(spark, d):
    all_disks = inputs.table(spark, d, "nation").select(F.col("n_nationkey").alias("disk"))
    now, before = all_disks.where("disk >= 5"), all_disks.where("disk < 15")
    return now.join(before, "disk", "left_semi").withColumn("common", F.lit(True)).union(now.join(before, "disk", "left_anti").withColumn("common", F.lit(False)))


# Validation


@query("""WITH i AS (SELECT s_suppkey - CASE WHEN s_suppkey % 10 = 7 THEN 1 ELSE 0 END AS id FROM supplier), o AS (SELECT id, id - (row_number() OVER (ORDER BY id) - 1) AS off FROM i), l AS (SELECT *, lag(off, 1, 0) OVER (ORDER BY id, off DESC) AS was FROM o) SELECT id, CASE WHEN off < was THEN 'dup' ELSE 'gap' END AS problem FROM l WHERE off <> was""")
def id_gap_check(spark, d):
    ids = inputs.table(spark, d, "supplier").select((F.col("s_suppkey") - F.when(F.col("s_suppkey") % 10 == 7, 1).otherwise(0)).alias("id"))
    return validation.id_gaps(ids)


@query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_check(spark, d):
    return validation.duplicates(inputs.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT c_nationkey AS id FROM (SELECT c_nationkey, lag(c_nationkey) OVER (ORDER BY c_nationkey) AS b FROM customer) WHERE b = c_nationkey")
def adjacent_duplicates(spark, d):
    return validation.adjacent_duplicates(inputs.table(spark, d, "customer").select(F.col("c_nationkey").alias("id")), "id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority < '3')")
def subset_difference(spark, d):
    orders = inputs.table(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderpriority < '3'")
    return validation.missing(inputs.table(spark, d, "customer"), orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(f"""WITH {REPLICAS}, {DISKS} SELECT 'replica on unknown disk' AS rule, vdisk_id || '/' || r.node || '/' || r.disk AS subject FROM replicas r WHERE r.node = 'n3' AND r.disk = 'd1'
    UNION ALL SELECT 'duplicate replica', '0/n0/d0' UNION ALL SELECT 'virtual disk without replicas', '9' UNION ALL SELECT 'gap before virtual disk', '9' UNION ALL SELECT 'duplicate node', 'n1'""")
def topology_violations(spark, d):
    nodes, replicas = inputs.nodes(spark), inputs.replicas(spark)
    disks = inputs.disks(spark).where("NOT (node = 'n3' AND disk = 'd1')")
    vdisks = spark.range(8).union(spark.range(9, 10))
    again = replicas.where("vdisk_id = 0 AND ord = 0")
    return validation.violations(nodes.union(nodes.where("idx = 1")), disks, replicas.union(again), vdisks)


# Metadata


@query("SELECT user_id % 8 AS vdisk_id, count(*) AS records FROM events GROUP BY ALL")
def vdisk_record_counts(spark, d):
    return metadata.per_vdisk(_log(spark, d))


@query(f"WITH {LOG}, {_PARTS} SELECT * FROM p")
def partition_record_counts(spark, d):
    return metadata.per_partition(_log(spark, d), _day())


@query(f"WITH {LOG}, {_PARTS} SELECT vdisk_id, count(*) AS partitions, min(start_ts) AS first_start, max(start_ts) AS last_start FROM p GROUP BY vdisk_id")
def partitions_per_vdisk(spark, d):
    return metadata.partitions_of_vdisk(_log(spark, d), _day())


@query(f"WITH {LOG} SELECT vdisk_id, count(*) AS records, count(DISTINCT key) AS unique_keys, count(*) FILTER (is_tombstone) AS deleted, count(DISTINCT key) FILTER (is_tombstone) AS unique_deleted FROM log GROUP BY vdisk_id")
def blob_summary(spark, d):
    return metadata.blob_summary(_log(spark, d))


@query(f"WITH {LOG} SELECT source, count(DISTINCT (vdisk_id, disk, owner_node, {DAY})) AS blobs FROM log GROUP BY source")
def blobs_by_source(spark, d):
    return metadata.blobs_by_source(_log(spark, d), _day())


@query(f"WITH {LOG} SELECT disk, count(*) * 1040 AS used FROM log GROUP BY disk")
def space_by_disk(spark, d):
    return metadata.space_by_disk(_log(spark, d), 1040)


@query("SELECT CAST(sum(p_size * 4096) AS BIGINT) AS total, CAST(sum(p_size // 2 * 4096) AS BIGINT) AS free, CAST(sum((p_size - p_size // 2 - 1) * 4096) AS BIGINT) AS used FROM part")
def filesystem_space(spark, d):
    part = inputs.table(spark, d, "part").select(F.lit(4096).alias("block_size"), F.col("p_size").alias("blocks"), F.expr("p_size div 2").alias("available"), F.expr("p_size div 2 + 1").alias("free"))
    return metadata.space(part)


@query("SELECT source, count(*) AS blobs, CAST(sum(octet_length(encode(text)) + 16) AS BIGINT) AS bytes FROM documents GROUP BY source")
def blob_bytes_by_source(spark, d):
    return inputs.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("blobs"), F.sum(F.octet_length("text") + 16).alias("bytes"))


# Metrics


@query(f"WITH {SAMPLES} SELECT name, CAST(sum(v) AS BIGINT) AS value, max(ts) AS ts FROM samples GROUP BY name")
def counter_sum(spark, d):
    return metrics.counters(_samples(spark, d))


@query(f"WITH {SAMPLES} SELECT name, arg_max(v, seq) AS value, max(ts) AS ts FROM samples GROUP BY name")
def gauge_last(spark, d):
    return metrics.gauges(_samples(spark, d))


@query(f"WITH {SAMPLES} SELECT name, ts // 3600 * 3600 AS flush_ts, CAST(sum(v) // count(*) AS BIGINT) AS mean FROM samples GROUP BY ALL")
def timer_mean(spark, d):
    return metrics.timers(_samples(spark, d), 3600)


@query(f"WITH {SAMPLES} SELECT name || '_rate' AS name, ts // 5 * 5 AS window_ts, CAST(sum(v) // 5 AS BIGINT) AS value FROM samples GROUP BY ALL")
def rate_5s(spark, d):
    return metrics.rates(_samples(spark, d))


_MERGED = f"{SAMPLES}, m AS (SELECT name, CAST(CASE any_value(kind) WHEN 'counter' THEN sum(v) WHEN 'gauge' THEN arg_max(v, seq) ELSE sum(v) // count(*) END AS BIGINT) AS value, max(ts) AS ts FROM samples GROUP BY name)"


@query(f"WITH {_MERGED} SELECT * FROM m")
def metrics_union(spark, d):
    return metrics.merged(_samples(spark, d))


@query(f"WITH {_MERGED} SELECT 'node_1.' || name || ' ' || value || ' ' || ts AS line FROM m")
def graphite_lines(spark, d):
    return metrics.graphite_lines(metrics.merged(_samples(spark, d)), "node_1")


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def sample_delta(spark, d):
    return metrics.deltas(_events(spark, d), "user_id", ("ts", "event_id"), "value").select("event_id", "delta")


@query("""WITH s AS (SELECT 'd' || (user_id % 4) AS disk, epoch_us(ts) // 1000 AS ms, event_id * 1000003 % 4294967296 AS ops, event_id * 7919 % 4294967296 AS busy_ms, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4, epoch_us(ts) // 1000 ORDER BY event_id) = 1),
    w AS (SELECT disk, ms, ms - lag(ms) OVER o AS e, ops - lag(ops) OVER o AS a, busy_ms - lag(busy_ms) OVER o AS b FROM s WINDOW o AS (PARTITION BY disk ORDER BY ms))
    SELECT disk, ms, ((a + 4294967296) % 4294967296) * 1000 / e AS iops, ((b + 4294967296) % 4294967296) * 100 / e AS util FROM w WHERE e > 500""")
def disk_load(spark, d):
    e = _events(spark, d)
    s = e.select(F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("disk"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id")
    s = s.groupBy("disk", "ms").agg(F.min("event_id").alias("i"))
    return metrics.disk_load(s.select("disk", "ms", (F.col("i") * 1000003 % (1 << 32)).alias("ops"), (F.col("i") * 7919 % (1 << 32)).alias("busy_ms")))


@query("SELECT p_partkey, p_partkey % 7 * 100.0 / (p_size + p_partkey % 13 + 5 + 1000 + p_partkey % 7 + 3) AS iowait FROM part")
def cpu_iowait(spark, d):
    line = F.concat_ws(" ", F.lit("cpu "), F.col("p_size"), F.col("p_partkey") % 13, F.lit(5), F.lit(1000), F.col("p_partkey") % 7, F.lit(3))
    return metrics.iowait(inputs.table(spark, d, "part").select("p_partkey", line.alias("line")))


@query(f"WITH {LOG} SELECT ts AS second, count(*) AS ops, round(avg(payload), 6) AS mean_value FROM log GROUP BY ts")
def throughput_lines(spark, d):
    return metrics.throughput(_log(spark, d).withColumn("value", F.col("payload"))).withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT event_type AS code, count(*) AS times FROM events GROUP BY event_type")
def error_histogram(spark, d):
    return metrics.error_histogram(_events(spark, d).withColumnRenamed("event_type", "code"), "code")


@query(f"WITH {LOG} SELECT count(*) AS ops, max(ts) - min(ts) + 1 AS seconds, count(*) / (max(ts) - min(ts) + 1) AS rps, round(avg(payload), 6) AS mean_value FROM log")
def bench_averages(spark, d):
    return metrics.averages(_log(spark, d).withColumn("value", F.col("payload"))).withColumn("mean_value", F.round("mean_value", 6))


@query(f"WITH {SAMPLES} SELECT name, ts // 600 * 600 AS since, count(*) AS times, max(ts) AS last FROM samples GROUP BY ALL")
def rate_limited_log(spark, d):
    return metrics.rate_limited(_samples(spark, d), "name", 600)


# Scalar rules


@query("SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'image/png' WHEN starts_with(upper(hex(encode(html))), '3C21444F43545950452068746D6C') OR starts_with(html, '<html') THEN 'text/html' ELSE '*/*' END AS mime FROM pages")
def payload_types(spark, d):
    png = F.unhex(F.lit("89504E470D0A1A0A00"))
    return inputs.table(spark, d, "pages").select("page_id", values.mime_type(F.when(F.col("page_id") % 4 == 1, png).otherwise(F.encode("html", "UTF-8"))).alias("mime"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey * 10 > o_orderkey THEN 304 WHEN o_custkey * 20 < o_orderkey THEN 412 ELSE 200 END AS INT) AS status FROM orders")
def cond_get_status(spark, d):
    return inputs.table(spark, d, "orders").select("o_orderkey", values.conditional_status(F.col("o_orderkey"), F.col("o_custkey") * 10, F.col("o_custkey") * 20).alias("status"))


@query("SELECT event_id, hex(from_hex(printf('%016x', epoch_us(ts) // 1000000)) || encode(props)) AS raw, epoch_us(ts) // 1000000 AS ts, props AS payload FROM events")
def record_codec(spark, d):
    log = _events(spark, d).select("event_id", values.encode_record(F.unix_seconds(F.col("ts").cast("timestamp")), F.encode("props", "UTF-8")).alias("r"))
    ts, payload = values.decode_record(F.col("r"))
    return log.select("event_id", F.hex("r").alias("raw"), ts.alias("ts"), payload.cast("string").alias("payload"))


_KINDS = ["KeyNotFound", "DuplicateKey", "Timeout", "VDiskNotFound", "Storage", "Internal", "Unauthorized", "HolderTemporaryUnavailable"]


@query(f"""WITH k AS (SELECT c_custkey, {_KINDS}[c_custkey % 8 + 1] AS kind FROM customer)
    SELECT c_custkey, kind, CASE kind WHEN 'KeyNotFound' THEN 'NOT_FOUND' WHEN 'VDiskNotFound' THEN 'NOT_FOUND' WHEN 'DuplicateKey' THEN 'ALREADY_EXISTS' WHEN 'Timeout' THEN 'DEADLINE_EXCEEDED' WHEN 'Unauthorized' THEN 'UNAUTHENTICATED' WHEN 'HolderTemporaryUnavailable' THEN 'UNAVAILABLE' ELSE 'INTERNAL' END AS grpc,
    CAST(CASE kind WHEN 'DuplicateKey' THEN 409 WHEN 'Internal' THEN 500 WHEN 'KeyNotFound' THEN 404 WHEN 'HolderTemporaryUnavailable' THEN 503 ELSE 400 END AS INT) AS http FROM k""")
def error_codes(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    return inputs.table(spark, d, "customer").select("c_custkey", kind.alias("kind")).withColumns({"grpc": values.looked_up(F.col("kind"), values.GRPC_CODES, "INTERNAL"), "http": values.looked_up(F.col("kind"), values.HTTP_CODES, 400)})


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Storage' ELSE 'Failed' END AS kind, replace(s_name, ' ', '') || 'x' AS detail FROM supplier")
def status_text(spark, d):
    kind, detail = values.error_of_status(F.concat_ws(" ", F.when(F.col("s_suppkey") % 2 == 0, "Storage").otherwise("Odd"), F.col("s_name"), F.lit("x")))
    return inputs.table(spark, d, "supplier").select("s_suppkey", kind.alias("kind"), detail.alias("detail"))


@query("SELECT n_nationkey, 'srv.' || replace(replace('10.0.0.' || n_nationkey, '.', '_'), ' ', '_') || '.' || replace(n_name, ' ', '_') || '.get_count' AS prefix FROM nation")
def metric_prefix(spark, d):
    p = values.metric_prefix(F.lit("srv.{local_address}.{node_name}.{metrics_name}"), F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")), F.col("n_name"), F.lit("get.count"))
    return inputs.table(spark, d, "nation").select("n_nationkey", p.alias("prefix"))


@query("""SELECT c_custkey, CAST((CASE WHEN coalesce(CASE WHEN c_custkey % 3 = 0 THEN false END, c_nationkey % 2 = 0) THEN 1 ELSE 0 END) + (CASE WHEN coalesce(CASE WHEN c_custkey % 5 = 0 THEN true END, c_nationkey % 3 = 0) THEN 2 ELSE 0 END) + (CASE WHEN c_nationkey % 5 = 0 THEN 4 ELSE 0 END) AS INT) AS bits FROM customer""")
def user_permissions(spark, d):
    claim = lambda rule, value: F.when(F.expr(rule), F.lit(value))
    no = F.lit(None).cast("boolean")
    users = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("username"), F.col("c_nationkey").alias("role"), claim("c_custkey % 3 = 0", False).alias("read"), claim("c_custkey % 5 = 0", True).alias("write"), no.alias("read_rest"), no.alias("write_rest"))
    roles = inputs.table(spark, d, "nation").select(F.col("n_nationkey").alias("role"), (F.col("n_nationkey") % 2 == 0).alias("read"), (F.col("n_nationkey") % 3 == 0).alias("write"), (F.col("n_nationkey") % 5 == 0).alias("read_rest"), no.alias("write_rest"))
    return access.effective(users, roles).withColumnRenamed("username", "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 = 0 ELSE c_custkey % 3 = 0 END AS ok FROM customer")
def password_check(spark, d):
    given = F.col("c_name")
    stored = F.when(F.col("c_custkey") % 2 == 0, F.when(F.col("c_custkey") % 4 == 0, given).otherwise("other"))
    hashed = F.sha2(F.concat(F.when(F.col("c_custkey") % 3 == 0, given).otherwise("other"), F.lit("salt")), 512)
    return inputs.table(spark, d, "customer").select("c_custkey", values.password_ok(given, stored, hashed, "salt").alias("ok"))


@query("SELECT p_partkey, CAST(unnest(CASE p_partkey % 3 WHEN 0 THEN [p_size] WHEN 1 THEN range(p_size, p_size + 4) ELSE [p_size, 7, 7] END) AS BIGINT) AS key FROM part")
def key_ranges(spark, d):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, s).when(F.col("p_partkey") % 3 == 1, F.concat_ws("-", s, (F.col("p_size") + 3).cast("string"))).otherwise(F.concat_ws(",", s, F.lit("7"), F.lit("7")))
    return inputs.table(spark, d, "part").select("p_partkey", F.explode(values.keys_of_range(text)).alias("key"))


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(CAST(c_custkey AS VARCHAR))) - 1) // 10 AS packet FROM customer")
def packet_batches(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.md5(F.col("c_custkey").cast("string")))
    return inputs.table(spark, d, "customer").select("c_custkey", F.expr("0L").alias("_"), F.row_number().over(w).alias("n")).select("c_custkey", F.expr("(n - 1) div 10").alias("packet"))


# Requests for many keys, and what writes and deletes leave

_WANTED = "wanted AS (SELECT c_custkey AS position, c_custkey % 1500 AS key FROM customer)"


def _wanted(spark, d):
    return inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("position"), (F.col("c_custkey") % 1500).alias("key"))


@query(f"""WITH {LOG}, {_WANTED}, v AS (SELECT *, row_number() OVER (PARTITION BY key, tier, replica ORDER BY ts DESC, seq DESC) AS rn FROM log),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, replica) AS first FROM v WHERE rn = 1 AND NOT is_tombstone)
    SELECT position, w.key, tier, ts, seq, payload FROM wanted w JOIN r ON r.key = w.key AND first = 1""")
def get_keys(spark, d):
    return requests.get(_wanted(spark, d), _log(spark, d)).where("tier IS NOT NULL")


@query(f"""WITH {LOG}, {_WANTED}, v AS (SELECT *, row_number() OVER (PARTITION BY key, tier ORDER BY ts DESC, seq DESC) AS rn FROM log),
    t AS (SELECT key, min(tier) AS tier FROM v WHERE rn = 1 AND NOT is_tombstone GROUP BY key) SELECT position, w.key, tier FROM wanted w LEFT JOIN t ON t.key = w.key""")
def exists_cascade(spark, d):
    return requests.exists_cascade(_wanted(spark, d), _log(spark, d))


@query(f"""WITH {LOG}, {_LIVE} SELECT c_custkey + 1000000 AS key, CAST(1800000000 AS BIGINT) AS ts, c_custkey AS seq, false AS is_tombstone, payload FROM customer JOIN live l ON l.key = c_custkey % 200""")
def copy_objects(spark, d):
    copies = inputs.table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("key"), (F.col("c_custkey") + 1000000).alias("to_key"), F.lit(1800000000).cast("long").alias("ts"), F.col("c_custkey").alias("seq"))
    return requests.copied(_log(spark, d), copies)


def _tombstone_sql(by: str, where: str, forced: str) -> str:
    return f"""WITH {LOG}, del AS (SELECT key, {by}, max(ts) AS delete_ts, {forced} AS forced FROM log WHERE {where} GROUP BY key, {by}),
    h AS (SELECT key, {by}, ts - ts % 86400 AS start_ts, arg_max(is_tombstone, (ts, seq)) AS dead FROM log WHERE {where} GROUP BY ALL)
    SELECT key, {by}, start_ts, delete_ts AS ts FROM h JOIN del USING (key, {by}) WHERE NOT dead AND CASE WHEN forced THEN start_ts < delete_ts - delete_ts % 86400 ELSE start_ts < delete_ts END
    UNION ALL SELECT key, {by}, delete_ts - delete_ts % 86400, delete_ts FROM del WHERE forced"""


def _tombstones(spark, d, by, where, forced):
    log = _log(spark, d).where(where)
    deletes = log.groupBy("key", by).agg(F.max("ts").alias("delete_ts")).withColumn("forced", forced)
    return requests.tombstones(log, deletes, _day(), (by,))


@query(_tombstone_sql("vdisk_id", "true", "key % 2 = 0"))
def delete_tombstones(spark, d):
    """Deletes of every key at its last time, forced for even keys."""
    return _tombstones(spark, d, "vdisk_id", "true", F.col("key") % 2 == 0)


@query(_tombstone_sql("disk", "source = 'normal'", "true"))
def delete_on_each_disk(spark, d):
    return _tombstones(spark, d, "disk", "source = 'normal'", F.lit(True))


@query(_tombstone_sql("owner_node", "source = 'alien'", "owner_node = 'n1'"))
def delete_aliens_by_owner(spark, d):
    return _tombstones(spark, d, "owner_node", "source = 'alien'", F.col("owner_node") == "n1")


_SUPPORT = """support AS (SELECT op, 'n' || ((op + 2) % 4) AS node FROM (SELECT DISTINCT op FROM answers)),
    f AS (SELECT op, node, row_number() OVER (PARTITION BY op ORDER BY node) AS turn FROM answers WHERE NOT ok),
    kept AS (SELECT f.op, coalesce(CASE WHEN turn = 1 THEN s.node END, 'n0') AS node, f.node AS owner_node FROM f LEFT JOIN support s USING (op))"""


def _support(answers):
    return answers.select("op").distinct().select("op", F.concat(F.lit("n"), ((F.col("op") + 2) % 4).cast("string")).alias("node"))


@query(f"WITH {LOG}, {REPLICAS}, {_ANSWERS}, {_SUPPORT} SELECT op, node, 'normal' AS source, node AS owner_node FROM answers WHERE ok UNION ALL SELECT op, node, 'alien', owner_node FROM kept")
def put_plan(spark, d):
    answers = _answers(spark, d)
    return requests.put_plan(answers, _support(answers), "n0")


_DELETES = f"""{_ANSWERS}, {_SUPPORT}, used AS (SELECT op, node FROM answers UNION SELECT op, node FROM kept UNION SELECT op, 'n0' FROM answers),
    plan AS (SELECT op, node, NULL AS owner_node, true AS forced FROM answers WHERE ok UNION ALL SELECT op, node, owner_node, true FROM kept
    UNION ALL SELECT a.op, n.name, a.node, false FROM answers a CROSS JOIN nodes n WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.op = a.op AND u.node = n.name))"""


def _delete_plan(spark, d):
    answers = _answers(spark, d)
    return requests.delete_plan(answers, _support(answers), inputs.nodes(spark), "n0")


@query(f"WITH {LOG}, {REPLICAS}, {NODES}, {_DELETES} SELECT op, node, owner_node, forced FROM plan")
def delete_plan(spark, d):
    return _delete_plan(spark, d)


@query(f"""WITH {LOG}, {REPLICAS}, {NODES}, {_DELETES} SELECT op, count(*) FILTER (owner_node IS NULL) AS plain, count(*) FILTER (owner_node IS NOT NULL AND forced) AS forced, count(*) FILTER (NOT forced) AS asked,
    CASE WHEN bool_or(owner_node IS NOT NULL AND forced AND node = 'n0') AND op % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM plan GROUP BY op""")
def delete_plan_outcome(spark, d):
    return requests.delete_outcome(_delete_plan(spark, d), "n0", F.col("op") % 3 != 0)


@query(f"WITH {LOG}, {REPLICAS}, {NODES}, {_ANSWERS} SELECT o.op, n.name AS node FROM (SELECT DISTINCT op FROM answers) o CROSS JOIN nodes n WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.op = o.op AND a.node = n.name)")
def remaining_nodes(spark, d):
    answers = _answers(spark, d)
    return routing.remaining(answers.select("op").distinct(), inputs.nodes(spark), answers.select("op", "node"))


@query(f"WITH {LOG}, {REPLICAS} SELECT seq, owner_node, vdisk_id FROM log l WHERE source = 'alien' AND EXISTS (SELECT 1 FROM replicas r WHERE r.node = l.owner_node AND r.vdisk_id = l.vdisk_id)")
def alien_scan(spark, d):
    return routing.hosted_aliens(_log(spark, d), inputs.replicas(spark)).select("seq", "owner_node", "vdisk_id")


_OF = "vdisk_id = 3 AND CASE WHEN seq % 2 = 0 THEN {alien} ELSE source <> 'alien' AND {other} END"


def _operation():
    return {"alien": F.col("seq") % 2 == 0, "vdisk_id": F.lit(3), "node": F.when(F.col("seq") % 4 == 0, F.lit("n1")), "disk": F.lit("d1")}


@query(f"WITH {LOG} SELECT seq, {_OF.format(alien="source = 'alien' AND (seq % 4 <> 0 OR owner_node = 'n1')", other="disk = 'd1'")} AS matches FROM log")
def group_match(spark, d):
    alien = F.col("source") == "alien"
    return _log(spark, d).select("seq", partitions.group_matches(alien, F.col("vdisk_id"), F.col("owner_node"), F.col("disk"), _operation()).alias("matches"))


@query(f"WITH {LOG} SELECT seq, CASE WHEN seq % 2 = 0 THEN source = 'alien' ELSE source <> 'alien' AND vdisk_id = 3 END AS matches FROM log")
def controller_match(spark, d):
    return _log(spark, d).select("seq", partitions.controller_matches(F.col("source") == "alien", F.col("vdisk_id") == 3, _operation()).alias("matches"))


@query("SELECT n_name, n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey >= 12 DESC, n_nationkey) AS INT) AS turn FROM nation")
def old_nodes_first(spark, d):
    nodes = inputs.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("idx"), "n_regionkey")
    return routing.old_first(nodes, nodes.where("idx >= 12"), "n_regionkey").select(F.col("name").alias("n_name"), "n_regionkey", "turn")


@query("""SELECT c_custkey, array_to_string([CASE WHEN regexp_full_match(x, '[0-9a-f]{2}') THEN x ELSE '00' END FOR x IN [lower(substr(t, 1, 2)), lower(substr(t, 3, 2)), lower(substr(t, 5, 2)), lower(substr(t, 7, 2))]], '') AS key
    FROM (SELECT c_custkey, substr(c_name, 8, 1) || CAST(c_custkey AS VARCHAR) || 'Ab' AS t FROM customer)""")
def key_lenient(spark, d):
    text = F.concat(F.substring("c_name", 8, 1), F.col("c_custkey").cast("string"), F.lit("Ab"))
    return inputs.table(spark, d, "customer").select("c_custkey", keys.lenient(text, 4).alias("key"))


# State of the backend


@query("SELECT CAST(coalesce(sum(s_suppkey % 4) FILTER (s_nationkey % 3 <> 0), 0) AS BIGINT) AS corrupted FROM supplier")
def corrupted_blobs(spark, d):
    return metadata.corrupted(inputs.table(spark, d, "supplier").select((F.col("s_nationkey") % 3 == 0).alias("is_alien"), (F.col("s_suppkey") % 4).alias("corrupted")))


@query(f"WITH {LOG}, {_PARTS} SELECT vdisk_id AS disk, CAST(sum(records * 24) AS BIGINT) AS index_memory, CAST(sum(records // 8) AS BIGINT) AS filter_memory FROM p GROUP BY vdisk_id")
def index_and_filter_memory(spark, d):
    parts = metadata.per_partition(_log(spark, d), _day())
    return metadata.memory(parts.select(F.col("vdisk_id").alias("disk"), (F.col("records") * 24).alias("index_bytes"), F.expr("records div 8").alias("filter_bytes")))


@query("SELECT count(*) AS disks, count(*) FILTER (s_suppkey % 5 < 3) AS active FROM supplier")
def active_disks(spark, d):
    return metadata.active_disks(inputs.table(spark, d, "supplier").select(F.col("s_suppkey").alias("disk"), F.when(F.col("s_suppkey") % 5 < 3, "Ready").otherwise("NotReady").alias("state")))


@query(f"WITH {LOG}, {REPLICAS}, {_ANSWERS} SELECT op AS round, count(*) FILTER (ok) AS available FROM answers GROUP BY op")
def nodes_available(spark, d):
    return metadata.nodes_available(_answers(spark, d).withColumnRenamed("op", "round"))


@query(f"WITH {LOG}, {_LIVE}, {_WANTED} SELECT position // 1000 AS packet, count(*) AS asked, count(l.key) AS present FROM wanted w LEFT JOIN live l ON l.key = w.key GROUP BY ALL")
def present_keys(spark, d):
    found = versions.exists(_wanted(spark, d), _log(spark, d))
    return metadata.present(found.select(F.expr("position div 1000").alias("packet"), "found"))


@query("""SELECT l || '.' || o || '_' || w AS name, CASE w WHEN 'timer' THEN 'timer' ELSE 'counter' END AS kind FROM unnest(['cluster_grinder', 'client']) a(l), unnest(['put', 'get', 'exist', 'delete']) b(o), unnest(['count', 'error_count', 'timer']) c(w)
    UNION ALL SELECT l || '.exist_' || w, 'counter' FROM unnest(['cluster_grinder', 'client']) a(l), unnest(['keys_count', 'error_keys_count']) c(w)
    UNION ALL SELECT g, 'gauge' FROM unnest([%s]) g(g)""" % ", ".join(f"'{g}'" for g in metrics.GAUGES))
def metric_catalogue(spark, d):
    return metrics.catalogue(spark)


@query("""SELECT 'duplicate user' AS rule, CAST(c_nationkey AS VARCHAR) AS subject FROM customer WHERE c_custkey <= 30 GROUP BY c_nationkey HAVING count(*) > 1
    UNION ALL SELECT 'not one of password and hash', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey <= 30 AND c_custkey % 4 IN (0, 3)
    UNION ALL SELECT 'hash of wrong length', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey <= 30 AND c_custkey % 2 = 0 AND c_custkey % 6 <> 0
    UNION ALL SELECT 'unknown role', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey <= 30 AND c_custkey % 5 > 2""")
def user_violations(spark, d):
    """Thirty users, a configuration; who has a password, a hash, or both, goes by the number."""
    users = inputs.table(spark, d, "customer").where("c_custkey <= 30").select(
        F.col("c_nationkey").alias("username"), F.when(F.col("c_custkey") % 4 < 2, "p").alias("password"), F.when(F.col("c_custkey") % 2 == 0, F.when(F.col("c_custkey") % 6 == 0, F.repeat(F.lit("a"), F.lit(128))).otherwise("short")).alias("password_hash"), F.concat(F.lit("role"), (F.col("c_custkey") % 5).cast("string")).alias("role")
    )
    return validation.user_violations(users, spark.range(3).select(F.concat(F.lit("role"), F.col("id").cast("string")).alias("role")))


@query("""SELECT s_suppkey AS node, unnest(list_filter([CASE WHEN s_suppkey % 4 < 1 THEN 'no quorum' END, CASE WHEN s_suppkey % 4 > 2 THEN 'quorum above replicas' END, CASE WHEN s_suppkey % 7 = 0 THEN 'no timeout' END,
    CASE WHEN s_suppkey % 9 = 0 THEN 'no interval' END, CASE WHEN s_suppkey % 5 > 1 THEN 'unknown policy' END], lambda x: x IS NOT NULL)) AS rule FROM supplier""")
def node_violations(spark, d):
    n = F.col("s_suppkey")
    policy = F.element_at(F.array(F.lit("quorum"), F.lit("simple"), F.lit("other"), F.lit(None), F.lit("")), (n % 5 + 1).cast("int"))
    return validation.node_violations(inputs.table(spark, d, "supplier").select(n.alias("node"), (n % 4).alias("quorum"), F.lit(2).alias("replicas"), (n % 7).alias("timeout_ms"), (n % 9).alias("check_interval_ms"), F.lit(5).alias("count_interval_ms"), policy.alias("policy")))


# On a stream, in files, and on the driver: no SQL


@query(f"WITH {LOG}, v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM log) SELECT key, ts, seq, is_tombstone, payload FROM v WHERE rn = 1")
def stream_latest(spark, d):
    """The newest versions again, kept by a stream over the same table."""
    from keyloom.sources import shared
    from keyloom.streaming import state

    schema = _events(spark, d).schema
    source = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    path = shared.new_path(spark, "stream-latest")
    state.latest_stream(inputs.op_log(source), path).awaitTermination()
    return spark.read.parquet(path)


@query()
def placement(spark, d):
    """Replicas of 24 virtual disks on the nations as nodes and the regions as racks."""
    from keyloom.operators import placement as greedy

    nodes = inputs.table(spark, d, "nation").orderBy("n_nationkey").collect()  # a topology
    disks = [(str(r.n_regionkey), r.n_name, f"d{i}") for r in nodes for i in (0, 1)]
    return spark.createDataFrame(greedy.place(disks, 24, 3), "vdisk_id long, ord int, node string, disk string")
