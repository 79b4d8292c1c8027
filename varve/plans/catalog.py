"""The registered queries and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.functions import hashing, ids, positions
from varve.operators import collection, integrity, metrics, profile, restore, retention, scan, snapshot, store, upkeep
from varve.plans import tables as t
from varve.sources import codecs
from varve.streaming import snapshotter

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = COMMON + sql
        return f

    return add


#: The notions of ``tables`` in SQL; each statement uses some of them.
COMMON = r"""WITH RECURSIVE changes AS (SELECT event_type AS dim, user_id AS pos, ts, event_id AS seq, md5(concat_ws('|', CAST(event_id AS VARCHAR), props)) AS hash FROM events),
versions AS (SELECT *, lead(ts) OVER (PARTITION BY dim, pos ORDER BY ts, seq) AS until FROM changes),
cuts AS (SELECT CAST(unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY)) AS DATE) AS day),
manifest AS (SELECT c.day, v.dim, v.pos, v.hash FROM versions v JOIN cuts c ON v.ts < c.day + INTERVAL 1 DAY AND (v.until IS NULL OR v.until >= c.day + INTERVAL 1 DAY)),
stored AS (SELECT doc_id, source, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS length FROM documents),
objects AS (SELECT hash, min(doc_id) AS doc_id, max(length) AS length, min(doc_id) // 32 AS pack_id FROM stored GROUP BY hash),
refs AS (SELECT printf('snap-%02d', doc_id % 7) AS snapshot_id, hash, CASE WHEN toxic = 1 THEN 'file' ELSE 'chunk' END AS kind FROM stored JOIN labels USING (doc_id)),
live AS (SELECT DISTINCT hash FROM refs),
marked AS (SELECT o.*, l.hash IS NOT NULL AS is_live FROM objects o LEFT JOIN live l USING (hash)),
packs AS (SELECT pack_id, count(*) FILTER (WHERE is_live) AS live, count(*) FILTER (WHERE NOT is_live) AS dead,
  CAST(coalesce(sum(length + 36) FILTER (WHERE is_live), 0) AS BIGINT) AS live_bytes, CAST(coalesce(sum(length + 36) FILTER (WHERE NOT is_live), 0) AS BIGINT) AS dead_bytes FROM marked GROUP BY pack_id),
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
headers AS (SELECT strftime(day, '%Y-%m-%dT%H-%M-%SZ') AS snapshot_id, day, day(day) % 2 = 0 AS baseline_complete, day(day) = 3 AS incomplete, CAST(epoch(day) * 1000 AS BIGINT) AS created_ms FROM days),
waiting AS (SELECT min(snapshot_id) AS snapshot_id FROM headers),
quotas AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id DESC) <= 24 AS hourly,
  row_number() OVER (PARTITION BY day ORDER BY snapshot_id DESC) = 1 AND dense_rank() OVER (ORDER BY day DESC) <= 7 AS daily,
  row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY snapshot_id DESC) = 1 AND dense_rank() OVER (ORDER BY date_trunc('week', day) DESC) <= 4 AS weekly,
  row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY snapshot_id DESC) = 1 AND dense_rank() OVER (ORDER BY date_trunc('month', day) DESC) <= 12 AS monthly FROM headers),
kept AS (SELECT *, hourly OR daily OR weekly OR monthly AS keep FROM quotas),
guards AS (SELECT max(snapshot_id) AS snapshot_id FROM headers UNION SELECT max(snapshot_id) FROM headers WHERE baseline_complete UNION SELECT snapshot_id FROM waiting),
cells AS (SELECT o_orderpriority AS dim, o_custkey - 700 AS x, o_orderkey % 4001 - 2000 AS z, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders),
slots AS (SELECT dim, x >> 5 AS rx, z >> 5 AS rz, (x & 31) + 32 * (z & 31) AS slot, max(length) * 4 AS length FROM cells GROUP BY ALL),
log AS (SELECT 'region' AS channel, l_linestatus AS dim, printf('r.%d.%d.mca', l_suppkey % 8, l_partkey) AS file,
  CASE l_returnflag WHEN 'N' THEN 'committed' WHEN 'R' THEN 'scanned' END AS status FROM lineitem),
progress AS (SELECT channel, dim, file, CASE WHEN max(CASE WHEN status = 'committed' THEN 2 ELSE 1 END) = 2 THEN 'committed' ELSE 'scanned' END AS status FROM log GROUP BY ALL),
shoppers AS (SELECT c_custkey, c_nationkey AS n, n_regionkey AS r, n_name, c_mktsegment, CAST(abs(round(c_acctbal)) AS BIGINT) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
nodes AS (SELECT CAST(r AS VARCHAR) AS thread, CAST(r AS BIGINT) AS idx, 'java.lang.Thread' AS cls, 'run' AS method, CAST(sum(t) * 2 AS BIGINT) AS total FROM shoppers GROUP BY r
  UNION ALL SELECT CAST(r AS VARCHAR), n + 100, 'net.land.' || lower(n_name), 'tick', CAST(sum(t) * 3 // 4 AS BIGINT) FROM shoppers GROUP BY r, n, n_name
  UNION ALL SELECT CAST(r AS VARCHAR), c_custkey + 1000, 'org.shop.' || lower(c_mktsegment), 'pay', t FROM shoppers),
links AS (SELECT CAST(r AS VARCHAR) AS thread, CAST(n + 100 AS BIGINT) AS parent, c_custkey + 1000 AS child FROM shoppers
  UNION ALL SELECT DISTINCT CAST(r AS VARCHAR), CAST(r AS BIGINT), n + 100 FROM shoppers),
timed AS (SELECT n.*, greatest(n.total - coalesce(i.t, 0), 0) AS self FROM nodes n
  LEFT JOIN (SELECT l.thread, l.parent, sum(c.total) AS t FROM links l JOIN nodes c ON c.thread = l.thread AND c.idx = l.child GROUP BY ALL) i ON i.thread = n.thread AND i.parent = n.idx)
"""


# --- Stores -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, hash, length FROM stored")
def hash_objects(spark, sf):
    return t.stored(spark, sf).select("doc_id", "hash", "length")


@query("""SELECT source, CAST(sum(n) AS BIGINT) AS received, count(*) AS unique_objects, CAST(sum(n) - count(*) AS BIGINT) AS deduped,
  CAST(sum(n * length) AS BIGINT) AS received_bytes, CAST(sum(length) AS BIGINT) AS unique_bytes
FROM (SELECT source, hash, count(*) AS n, max(length) AS length FROM stored GROUP BY ALL) GROUP BY source""")
def dedup_stats_by_source(spark, sf):
    return store.dedup_stats(t.stored(spark, sf), "source")


@query("SELECT hash, min(doc_id) AS doc_id, max(length) AS length, arg_min(source, doc_id) AS source FROM stored GROUP BY hash")
def object_first_writer(spark, sf):
    return store.first_writers(t.stored(spark, sf), "doc_id", "source").select("hash", "doc_id", "length", "source")


@query("SELECT hash, count(*) AS refs FROM refs GROUP BY hash")
def object_refcounts(spark, sf):
    return store.reference_counts(t.references(spark, sf))


@query("SELECT DISTINCT hash FROM stored s WHERE doc_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM stored o WHERE o.doc_id % 3 <> 0 AND o.hash = s.hash)")
def dedup_put(spark, sf):
    s = t.stored(spark, sf)
    return store.new_objects(s.where("doc_id % 3 = 0"), s.where("doc_id % 3 <> 0")).select("hash")


@query("SELECT hash, 'chunks/' || hash[1:2] || '/' || hash[1:6] || '/' || hash AS path FROM objects")
def bucket_paths(spark, sf):
    return t.objects(spark, sf).select("hash", hashing.bucket_path(F.col("hash")).alias("path"))


@query("SELECT count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes FROM objects")
def store_size(spark, sf):
    return t.objects(spark, sf).agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))


@query(r""", seq AS (SELECT hash, doc_id, length + 20 AS size, source, row_number() OVER (PARTITION BY source ORDER BY doc_id, hash) AS k
  FROM (SELECT hash, min(doc_id) AS doc_id, max(length) AS length, arg_min(source, doc_id) AS source FROM stored GROUP BY hash)),
fold AS (SELECT source, hash, k, 0 AS pack_id, CAST(size AS BIGINT) AS used, CAST(size AS BIGINT) AS size FROM seq WHERE k = 1
  UNION ALL SELECT s.source, s.hash, s.k, CASE WHEN f.used >= 65536 THEN f.pack_id + 1 ELSE f.pack_id END,
    CASE WHEN f.used >= 65536 THEN 0 ELSE f.used END + s.size, CAST(s.size AS BIGINT) FROM fold f JOIN seq s ON s.source = f.source AND s.k = f.k + 1)
SELECT source, hash, pack_id, size FROM fold""")
def pack_assignment(spark, sf):
    first = store.first_writers(t.stored(spark, sf), "doc_id", "source")
    return store.assign_packs(first, "source", F.col("doc_id"), t.PACK_BYTES)


# --- Positions --------------------------------------------------------------------------------------------------


#: A packed position in SQL: the upper half counts as negative where z does.
_POS = "(x & 4294967295) | CAST((CAST(z & 4294967295 AS HUGEINT) * 4294967296 - CASE WHEN z < 0 THEN 18446744073709551616 ELSE 0 END) AS BIGINT)"


@query(f"SELECT dim, x, z, {_POS} AS pos, x AS x2, z AS z2 FROM (SELECT DISTINCT dim, x, z FROM cells)")
def position_pack_unpack(spark, sf):
    c = t.cells(spark, sf).select("dim", "x", "z").distinct().withColumn("pos", positions.pack(F.col("x"), F.col("z")))
    return c.withColumn("x2", positions.unpack_x(F.col("pos"))).withColumn("z2", positions.unpack_z(F.col("pos")))


@query("SELECT dim, rx, rz, slot, length FROM slots")
def region_slots(spark, sf):
    return t.slots(spark, sf)


@query("SELECT dim, rx, rz, count(*) AS slots, CAST(sum(length) AS BIGINT) AS bytes FROM slots GROUP BY ALL")
def region_occupancy(spark, sf):
    return t.slots(spark, sf).groupBy("dim", "rx", "rz").agg(F.count("*").alias("slots"), F.sum("length").alias("bytes"))


# --- Snapshots --------------------------------------------------------------------------------------------------


@query("SELECT dim, pos, arg_max(hash, (ts, seq)) AS hash FROM changes GROUP BY dim, pos")
def lww_state(spark, sf):
    return snapshot.last_writer(t.changes(spark, sf), F.struct("ts", "seq"))


def _manifest(spark, sf):
    c = t.changes(spark, sf)
    return snapshot.manifests_as_of_days(c, c.agg(F.to_date(F.max("ts"))).first()[0])


@query("SELECT CAST(day AS VARCHAR) AS snapshot_day, count(*) AS entries, count(DISTINCT hash) AS hashes FROM manifest GROUP BY day")
def snapshot_manifest_asof(spark, sf):
    m = _manifest(spark, sf).groupBy(F.col("day").cast("string").alias("snapshot_day"))
    return m.agg(F.count("*").alias("entries"), F.count_distinct("hash").alias("hashes"))


@query("SELECT CAST(max(day) AS VARCHAR) AS latest_day, count(DISTINCT day) AS snapshots, count(*) AS entries, count(DISTINCT hash) AS hashes FROM manifest")
def snapshot_info(spark, sf):
    m = _manifest(spark, sf)
    return m.agg(F.max("day").cast("string").alias("latest_day"), F.count_distinct("day").alias("snapshots"), F.count("*").alias("entries"), F.count_distinct("hash").alias("hashes"))


@query("SELECT CAST(day AS VARCHAR) AS snapshot_day, dim, count(*) AS entries FROM manifest GROUP BY ALL")
def snapshot_dim_counts(spark, sf):
    return _manifest(spark, sf).groupBy(F.col("day").cast("string").alias("snapshot_day"), "dim").agg(F.count("*").alias("entries"))


DAY_A, DAY_B = "2024-01-10", "2024-01-20"


def _asof(spark, sf, day):
    """One manifest: each key's latest version before the day's end."""
    before = t.changes(spark, sf).where(F.col("ts") < F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz"))
    return snapshot.last_writer(before, F.struct("ts", "seq"))


@query(f""", a AS (SELECT dim, pos, hash AS old_hash FROM manifest WHERE day = DATE '{DAY_A}'), b AS (SELECT dim, pos, hash AS new_hash FROM manifest WHERE day = DATE '{DAY_B}')
SELECT dim, pos, old_hash, new_hash, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM a FULL JOIN b USING (dim, pos) WHERE old_hash IS DISTINCT FROM new_hash""")
def snapshot_diff(spark, sf):
    return snapshot.diff(_asof(spark, sf, DAY_A), _asof(spark, sf, DAY_B))


@query(f""", a AS (SELECT dim, pos, hash AS old FROM manifest WHERE day = DATE '{DAY_A}'),
b AS (SELECT dim, pos, arg_max(hash, (ts, seq)) AS new FROM changes WHERE ts >= DATE '{DAY_A}' + INTERVAL 1 DAY GROUP BY dim, pos)
SELECT dim, pos, coalesce(new, old) AS hash, CASE WHEN new IS NULL THEN 'inherited' WHEN old IS NULL THEN 'added' ELSE 'replaced' END AS status FROM a FULL JOIN b USING (dim, pos)""")
def snapshot_overlay(spark, sf):
    late = t.changes(spark, sf).where(F.col("ts") >= F.date_add(F.lit(DAY_A).cast("date"), 1).cast("timestamp_ntz"))
    return snapshot.overlay(_asof(spark, sf, DAY_A), snapshot.last_writer(late, F.struct("ts", "seq")))


@query("""SELECT conv_id, role, arg_max(sha256(text), turn) AS hash FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id) GROUP BY ALL""")
def snapshot_files_replace(spark, sf):
    """Files are replaced as a whole: of each sequence only the last batch's entries stand."""
    c = t.read(spark, sf, "conversations").select("conv_id", "turn", "role", hashing.hash_hex(F.col("text")).alias("hash"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return c.join(last, ["conv_id", "turn"]).groupBy("conv_id", "role").agg(F.max_by("hash", "turn").alias("hash"))


@query("""SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN hash END, CASE WHEN quality = 1 THEN hash[1:8] END, 'inherited') AS level_hash
FROM stored LEFT JOIN labels USING (doc_id)""")
def leveldat_precedence(spark, sf):
    d = t.stored(spark, sf).join(t.read(spark, sf, "labels"), "doc_id", "left")
    level = snapshot.level_file(F.when(F.col("toxic") == 1, F.col("hash")), F.when(F.col("quality") == 1, F.substring("hash", 1, 8)), F.lit("inherited"))
    return d.select("doc_id", level.alias("level_hash"))


@query("SELECT snapshot_id, bool_or(incomplete) OVER (ORDER BY snapshot_id) AS incomplete FROM headers")
def snapshot_incomplete_latch(spark, sf):
    h = t.headers(spark, sf).withColumnRenamed("incomplete", "degraded")
    return snapshot.latch(h, "snapshot_id", "degraded").select("snapshot_id", "incomplete")


@query("""SELECT max(snapshot_id) AS latest, max(snapshot_id) FILTER (WHERE baseline_complete) AS latest_baseline,
  CAST(coalesce(max(created_ms) FILTER (WHERE NOT incomplete), 0) AS BIGINT) AS cutoff_ms FROM headers""")
def last_complete_cutoff(spark, sf):
    return snapshot.last_complete(t.headers(spark, sf))


@query("""SELECT snapshot_id, CAST(sum(length) AS BIGINT) AS unique_bytes FROM (SELECT DISTINCT snapshot_id, hash FROM refs) JOIN objects USING (hash) GROUP BY snapshot_id""")
def snapshot_unique_bytes(spark, sf):
    refs = t.references(spark, sf).select("snapshot_id", "hash").distinct()
    return refs.join(t.objects(spark, sf), "hash").groupBy("snapshot_id").agg(F.sum("length").alias("unique_bytes"))


# --- Retention --------------------------------------------------------------------------------------------------


def _retention(name: str):
    @query(f"SELECT snapshot_id FROM kept WHERE {name}")
    def run(spark, sf):
        return retention.flags(t.headers(spark, sf), retention.Quotas()).where(name).select("snapshot_id")

    return run


for _name, _flag in (("hourly", "hourly"), ("daily", "daily"), ("weekly", "weekly"), ("monthly", "monthly"), ("union", "keep")):
    _run = _retention(_flag)
    QUERIES[f"retention_{_name}"], ORACLES[f"retention_{_name}"] = _run, ORACLES["run"]
QUERIES.pop("run"), ORACLES.pop("run")


@query("SELECT snapshot_id FROM kept WHERE NOT keep")
def retention_doomed(spark, sf):
    return retention.doomed(t.headers(spark, sf), retention.Quotas())


@query("SELECT snapshot_id FROM guards WHERE snapshot_id IS NOT NULL")
def retention_protected(spark, sf):
    return retention.protected(t.headers(spark, sf), t.pending_restore(spark, sf))


@query("""SELECT k.snapshot_id, CASE WHEN keep THEN 'keep' WHEN g.snapshot_id IS NOT NULL THEN 'guarded' ELSE 'delete' END AS fate FROM kept k LEFT JOIN guards g USING (snapshot_id)""")
def retention_preview(spark, sf):
    return retention.preview(t.headers(spark, sf), t.pending_restore(spark, sf), retention.Quotas())


@query("SELECT snapshot_id FROM kept JOIN guards USING (snapshot_id) WHERE NOT keep")
def retention_saved_by_guard(spark, sf):
    return retention.preview(t.headers(spark, sf), t.pending_restore(spark, sf), retention.Quotas()).where("fate = 'guarded'").select("snapshot_id")


@query("""SELECT snapshot_id, CASE WHEN snapshot_id IN (SELECT snapshot_id FROM waiting) THEN 'pending restore'
  WHEN snapshot_id = (SELECT max(snapshot_id) FROM headers WHERE baseline_complete) THEN 'latest baseline' WHEN snapshot_id = (SELECT max(snapshot_id) FROM headers) THEN 'latest' END AS reason FROM headers""")
def delete_refusal_reason(spark, sf):
    return retention.refusal(t.headers(spark, sf), t.pending_restore(spark, sf))


# --- Collection -------------------------------------------------------------------------------------------------


@query("SELECT hash FROM live")
def live_set(spark, sf):
    return collection.live_set(t.references(spark, sf))


@query("SELECT DISTINCT hash FROM refs WHERE hash NOT IN (SELECT hash FROM objects WHERE doc_id % 5 <> 0)")
def missing_references(spark, sf):
    return collection.missing(t.references(spark, sf), t.objects(spark, sf).where("doc_id % 5 <> 0"))


@query("SELECT hash, length FROM marked WHERE NOT is_live")
def dead_objects(spark, sf):
    return collection.dead(t.objects(spark, sf), collection.live_set(t.references(spark, sf))).select("hash", "length")


@query("""SELECT count(*) AS scanned, count(*) FILTER (WHERE is_live) AS retained, count(*) FILTER (WHERE NOT is_live) AS deleted,
  CAST(coalesce(sum(length) FILTER (WHERE NOT is_live), 0) AS BIGINT) AS bytes_freed FROM marked""")
def gc_result(spark, sf):
    return collection.totals(t.objects(spark, sf), collection.live_set(t.references(spark, sf)))


@query("SELECT * FROM packs")
def pack_live_dead(spark, sf):
    return collection.per_pack(t.objects(spark, sf), collection.live_set(t.references(spark, sf)), hash_bytes=32)


@query("""SELECT *, CASE WHEN live_bytes + dead_bytes = 0 THEN 'skip' WHEN pack_id % 9 = 0 THEN 'skip' WHEN live = 0 THEN 'delete'
  WHEN dead_bytes / (live_bytes + dead_bytes) <= 0.5 THEN 'skip' ELSE 'rewrite' END AS action FROM packs""")
def compaction_plan(spark, sf):
    return collection.compaction(pack_live_dead(spark, sf), t.DEAD_SHARE, F.col("pack_id") % t.ACTIVE_PACK_ROWS == 0)


@query(""", alive AS (SELECT DISTINCT hash FROM refs WHERE snapshot_id NOT IN ('snap-00', 'snap-01', 'snap-02')),
sizes AS (SELECT pack_id, count(*) FILTER (WHERE a.hash IS NOT NULL) AS live, CAST(coalesce(sum(length + 36) FILTER (WHERE a.hash IS NOT NULL), 0) AS BIGINT) AS live_bytes,
  CAST(coalesce(sum(length + 36) FILTER (WHERE a.hash IS NULL), 0) AS BIGINT) AS dead_bytes FROM objects o LEFT JOIN alive a USING (hash) GROUP BY pack_id),
whole AS (SELECT CAST(sum(live_bytes + dead_bytes) AS BIGINT) AS before, CAST(coalesce(sum(dead_bytes) FILTER (WHERE live = 0 OR dead_bytes / (live_bytes + dead_bytes) > 0.5), 0) AS BIGINT) AS freed FROM sizes)
SELECT before, before > 1000000 AS triggered, CASE WHEN before > 1000000 THEN (SELECT count(DISTINCT snapshot_id) FROM refs WHERE snapshot_id IN ('snap-00', 'snap-01', 'snap-02')) ELSE 0 END AS pruned,
  CASE WHEN before > 1000000 THEN freed ELSE 0 END AS bytes_freed, before - CASE WHEN before > 1000000 THEN freed ELSE 0 END AS after,
  before - CASE WHEN before > 1000000 THEN freed ELSE 0 END > 1000000 AS still_over FROM whole""")
def store_size_guard(spark, sf):
    refs = t.references(spark, sf)
    headers = refs.select("snapshot_id").distinct()
    return collection.size_guard(t.objects(spark, sf), refs, headers, headers.where("snapshot_id < 'snap-03'"), t.STORE_LIMIT, t.DEAD_SHARE, hash_bytes=32)


@query("""SELECT DISTINCT hash FROM stored WHERE hash NOT IN (SELECT hash FROM stored WHERE doc_id % 4 = 0) AND hash NOT IN (SELECT hash FROM live)""")
def dead_window(spark, sf):
    s = t.stored(spark, sf)
    return collection.dead_in_window(s, s.where("doc_id % 4 = 0"), collection.live_set(t.references(spark, sf)))


@query(r""", per AS (SELECT pack_id, dead, row_number() OVER (ORDER BY pack_id) AS k FROM packs),
fold AS (SELECT pack_id, k, CAST(dead AS BIGINT) AS accumulated FROM per WHERE k = 1
  UNION ALL SELECT p.pack_id, p.k, CASE WHEN f.accumulated >= 50 THEN 0 ELSE f.accumulated END + p.dead FROM fold f JOIN per p ON p.k = f.k + 1)
SELECT pack_id, accumulated, accumulated >= 50 AS collects FROM fold""")
def gc_trigger(spark, sf):
    return collection.triggers(pack_live_dead(spark, sf), "pack_id", "dead", 50)


# --- Integrity --------------------------------------------------------------------------------------------------


@query(""", lost AS (SELECT snapshot_id, count(DISTINCT hash) AS n FROM refs WHERE hash NOT IN (SELECT hash FROM objects WHERE doc_id % 50 <> 0) GROUP BY snapshot_id)
SELECT snapshot_id, CASE WHEN snapshot_id = 'snap-03' THEN 'CORRUPT' WHEN n > 0 THEN 'INCOMPLETE' ELSE 'OK' END AS status, coalesce(n, 0) AS missing
FROM (SELECT DISTINCT snapshot_id FROM refs) LEFT JOIN lost USING (snapshot_id)""")
def verify_snapshots(spark, sf):
    refs = t.references(spark, sf)
    headers = refs.select("snapshot_id").distinct().withColumn("readable", F.col("snapshot_id") != "snap-03")
    return integrity.verify(headers, refs, t.objects(spark, sf).where("doc_id % 50 <> 0"))


def _fsck(spark, sf):
    o = t.objects(spark, sf).withColumn("rehash", F.when(F.col("doc_id") % 97 == 1, "tampered").otherwise(F.col("hash"))).withColumn("inflates", F.col("doc_id") % 41 != 2)
    return integrity.classify(o, t.references(spark, sf))


_FSCK = """, kinds AS (SELECT hash, bool_or(kind = 'chunk') AS chunk FROM refs GROUP BY hash),
classes AS (SELECT hash, CASE WHEN doc_id % 97 = 1 THEN 'mismatch' WHEN chunk IS NULL THEN 'orphan' WHEN chunk AND doc_id % 41 = 2 THEN 'corrupt' WHEN chunk THEN 'chunk' ELSE 'file' END AS class
  FROM objects LEFT JOIN kinds USING (hash)) """


@query(_FSCK + "SELECT hash, class FROM classes")
def fsck_classes(spark, sf):
    return _fsck(spark, sf)


@query(_FSCK + """SELECT count(*) AS scanned, count(*) FILTER (WHERE class IN ('chunk', 'file')) AS ok, count(*) FILTER (WHERE class = 'chunk') AS chunks,
  count(*) FILTER (WHERE class = 'file') AS files, count(*) FILTER (WHERE class = 'mismatch') AS mismatches, count(*) FILTER (WHERE class = 'corrupt') AS corrupts,
  count(*) FILTER (WHERE class = 'orphan') AS orphans FROM classes""")
def fsck_counters(spark, sf):
    return integrity.counters(_fsck(spark, sf))


@query("""SELECT snapshot_id, concat_ws(' ', snapshot_id, 'OK', '0', CAST(c AS VARCHAR), '0', CAST(f AS VARCHAR), '0') AS line
FROM (SELECT snapshot_id, count(*) FILTER (WHERE kind = 'chunk') AS c, count(*) FILTER (WHERE kind = 'file') AS f FROM refs GROUP BY snapshot_id)""")
def snapshot_index_lines(spark, sf):
    per = t.references(spark, sf).groupBy("snapshot_id").agg(F.count_if(F.col("kind") == "chunk").alias("chunks"), F.count_if(F.col("kind") == "file").alias("files"))
    return integrity.index_lines(per.select("snapshot_id", F.lit("OK").alias("status"), F.lit(0).alias("created_ms"), "chunks", F.lit(0).alias("entities"), "files", F.lit(0).alias("missing")))


# --- Restores ---------------------------------------------------------------------------------------------------

_TARGETS = """, targets AS (SELECT dim, x, z, (x & 4294967295) | CAST((CAST(z & 4294967295 AS HUGEINT) * 4294967296 - CASE WHEN z < 0 THEN 18446744073709551616 ELSE 0 END) AS BIGINT) AS pos
  FROM (SELECT 'click' AS dim, unnest(range(17, 24)) AS x), (SELECT unnest(range(-3, 4)) AS z)) """


def _targets(spark):
    return restore.area_targets(spark.createDataFrame([("click", 20, 0)], "dim string, x int, z int"), 3)


@query(_TARGETS + "SELECT dim, CAST(x AS INT) AS x, CAST(z AS INT) AS z, pos FROM targets")
def restore_area_targets(spark, sf):
    return _targets(spark)


def _restored(spark, sf):
    manifest = snapshot.last_writer(t.changes(spark, sf), F.struct("ts", "seq"))
    return restore.resolve(_targets(spark), manifest, manifest.where("pos % 11 <> 0").select("hash").distinct())


_RESOLVE = _TARGETS + """, m AS (SELECT dim, pos, arg_max(hash, (ts, seq)) AS hash FROM changes WHERE {when} GROUP BY dim, pos)
SELECT dim, CAST(x AS INT) AS x, CAST(z AS INT) AS z, m.hash, CASE WHEN m.hash IS NULL THEN 'not_captured' WHEN pos % 11 = 0 THEN 'object_missing' ELSE 'restored' END AS outcome FROM targets LEFT JOIN m USING (dim, pos)"""


@query(_RESOLVE.format(when=f"ts < DATE '{DAY_A}' + INTERVAL 1 DAY"))
def restore_partial(spark, sf):
    manifest = _asof(spark, sf, DAY_A)
    targets = _targets(spark).withColumn("explicit", F.lit(False))
    return restore.restore_partial(targets, manifest, manifest.where("pos % 11 <> 0").select("hash").distinct()).select("dim", "x", "z", "hash", "outcome")


@query(_RESOLVE.format(when="true"))
def restore_latest(spark, sf):
    return _restored(spark, sf).select("dim", "x", "z", "hash", "outcome")


@query(""", sized AS (SELECT *, CAST(ceil((length + 5) / 4096) AS BIGINT) AS need FROM slots)
SELECT dim, rx, rz, slot, length, need > 255 AS external, CASE WHEN need > 255 THEN 1 ELSE need END AS sectors,
  CAST(coalesce(sum(CASE WHEN need > 255 THEN 1 ELSE need END) OVER (PARTITION BY dim, rx, rz ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS BIGINT) AS first_sector FROM sized""")
def region_layout(spark, sf):
    return restore.region_layout(t.slots(spark, sf)).select("dim", "rx", "rz", "slot", "length", "external", "sectors", "first_sector")


@query("""SELECT dim, rx, rz, slot, CASE WHEN slot % 5 = 0 THEN 'new' ELSE CAST(length AS VARCHAR) END AS payload FROM slots""")
def region_replace_slots(spark, sf):
    s = t.slots(spark, sf).withColumn("payload", F.col("length").cast("string"))
    return restore.replace_slots(s, s.where("slot % 5 = 0").withColumn("payload", F.lit("new")))


# --- Scans ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM progress")
def progress_merge(spark, sf):
    return scan.progress(t.scan_log(spark, sf))


@query("SELECT DISTINCT channel, dim, file FROM log WHERE (channel, dim, file) NOT IN (SELECT (channel, dim, file) FROM progress WHERE status = 'committed')")
def baseline_pending(spark, sf):
    log = t.scan_log(spark, sf)
    return scan.pending(log.select("channel", "dim", "file").distinct(), scan.progress(log))


@query("SELECT bool_and(status = 'committed') AS complete FROM progress")
def baseline_complete(spark, sf):
    return scan.is_complete(scan.progress(t.scan_log(spark, sf)), finished=True)


@query("SELECT channel, dim, file, CASE WHEN file LIKE 'r.1.%' THEN 'committed' ELSE status END AS status FROM progress")
def baseline_promote(spark, sf):
    p = scan.progress(t.scan_log(spark, sf))
    return scan.promote(p, p.where("file LIKE 'r.1.%'"))


@query("""SELECT coalesce(k.pack_id, f.pack_id) AS pack_id, CASE WHEN k.pack_id IS NULL THEN 'new' WHEN f.pack_id IS NULL THEN 'gone' WHEN k.size = f.size THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT pack_id, live_bytes AS size FROM packs WHERE pack_id % 5 <> 0) k FULL JOIN (SELECT pack_id, live_bytes + CASE WHEN pack_id % 3 = 0 THEN 1 ELSE 0 END AS size FROM packs WHERE pack_id % 7 <> 0) f ON k.pack_id = f.pack_id""")
def pack_set_diff(spark, sf):
    p = pack_live_dead(spark, sf).select("pack_id", F.col("live_bytes").alias("size"))
    now = p.where("pack_id % 7 <> 0").withColumn("size", F.col("size") + F.when(F.col("pack_id") % 3 == 0, 1).otherwise(0))
    return scan.pack_set_diff(p.where("pack_id % 5 <> 0"), now)


@query("""SELECT hash, pack_id FROM objects WHERE doc_id % 10 > 1 UNION ALL SELECT hash, pack_id + 1000 FROM objects WHERE doc_id % 10 = 1""")
def index_merge(spark, sf):
    o = t.objects(spark, sf)
    delta = o.where("doc_id % 10 = 1").select("hash", (F.col("pack_id") + 1000).alias("pack_id"))
    return scan.merge_index(o.select("hash", "pack_id"), delta, o.where("doc_id % 10 = 0").select("hash"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def rescan_changed_since(spark, sf):
    files = t.read(spark, sf, "events").select("event_id", F.col("ts").alias("modified"))
    return scan.changed_since(files, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


# --- Profiles ---------------------------------------------------------------------------------------------------


def _timed(spark, sf):
    return profile.self_time(*t.call_tree(spark, sf))


@query("""SELECT thread, cls, method, CAST(self AS BIGINT) AS self, CAST(rank AS INT) AS rank, CASE WHEN whole > 0 THEN round(100.0::DOUBLE * self / whole, 4) ELSE 0.0 END AS percent FROM (
  SELECT thread, cls, method, sum(self) AS self, sum(sum(self)) OVER (PARTITION BY thread) AS whole, row_number() OVER (PARTITION BY thread ORDER BY sum(self) DESC, cls, method) AS rank
  FROM timed GROUP BY thread, cls, method) WHERE rank <= 25""")
def profile_self_time(spark, sf):
    return profile.hotspots(_timed(spark, sf), 25, "cls", "method")


SUBSYSTEMS = [("jdk", "starts", "java."), ("world", "has", ".land."), ("trade", "has", "shop")]


@query("""SELECT CASE WHEN starts_with(cls, 'java.') THEN 'jdk' WHEN contains(cls, '.land.') THEN 'world' WHEN contains(cls, 'shop') THEN 'trade' ELSE 'other' END AS subsystem,
  CAST(sum(self) AS BIGINT) AS self FROM timed GROUP BY 1""")
def profile_subsystem(spark, sf):
    return _timed(spark, sf).groupBy(profile.first_match(F.col("cls"), SUBSYSTEMS, "other").alias("subsystem")).agg(F.sum("self").alias("self"))


@query("""SELECT CASE WHEN cls = 'org.shop.building' THEN 'builders' WHEN starts_with(cls, 'java.') THEN '(library)' ELSE array_to_string(string_split(cls, '.')[1:3], '.') END AS mod,
  CAST(sum(self) AS BIGINT) AS self FROM timed GROUP BY 1""")
def profile_attribution(spark, sf):
    sources = spark.createDataFrame([("org.shop.building", "builders")], "cls string, mod string")
    return profile.attributed(_timed(spark, sf), sources, ["java."]).groupBy("mod").agg(F.sum("self").alias("self"))


@query(""", best AS (SELECT l.thread, l.parent AS idx, arg_max(l.child, (c.total, -l.child)) AS next FROM links l JOIN nodes c ON c.thread = l.thread AND c.idx = l.child GROUP BY ALL),
path AS (SELECT thread, idx AS root, 0 AS depth, idx FROM nodes WHERE idx < 100 UNION ALL SELECT p.thread, p.root, p.depth + 1, b.next FROM path p JOIN best b ON b.thread = p.thread AND b.idx = p.idx WHERE p.depth < 24)
SELECT p.thread, p.root, p.depth, p.idx, n.total FROM path p JOIN nodes n ON n.thread = p.thread AND n.idx = p.idx""")
def profile_heaviest_path(spark, sf):
    return profile.heaviest_paths(*t.call_tree(spark, sf), roots=3).select("thread", "root", "depth", "idx", "total")


@query("""SELECT keyword, CAST(sum(total) AS BIGINT) AS total, count(*) AS nodes FROM nodes, (SELECT unnest(['shop', 'tick', 'land', 'pay']) AS keyword) WHERE contains(lower(cls || '.' || method), keyword) GROUP BY keyword""")
def profile_keyword_inclusive(spark, sf):
    return profile.by_keyword(t.call_tree(spark, sf)[0], ["shop", "tick", "land", "pay"])


@query("""SELECT * FROM (SELECT l.thread, l.child, c.cls, c.method, c.total, CAST(row_number() OVER (PARTITION BY l.thread ORDER BY c.total DESC, l.child) AS INT) AS rank
  FROM links l JOIN (SELECT thread, min(idx) AS parent FROM nodes WHERE contains(lower(cls || '.' || method), 'land') GROUP BY thread) m USING (thread, parent)
  JOIN nodes c ON c.thread = l.thread AND c.idx = l.child) WHERE rank <= 10""")
def profile_top_children(spark, sf):
    return profile.top_children(*t.call_tree(spark, sf), "land").select("thread", "child", "cls", "method", "total", "rank")


# --- Metrics and flow -------------------------------------------------------------------------------------------


@query("""SELECT source AS channel, count(*) AS received, count(*) FILTER (WHERE k = 1 AND hash IS NOT NULL) AS unique_objects,
  count(*) FILTER (WHERE k > 1 AND hash IS NOT NULL) AS deduped, count(*) FILTER (WHERE hash IS NULL) AS failed
FROM (SELECT source, hash, row_number() OVER (PARTITION BY source, hash ORDER BY doc_id) AS k FROM (SELECT source, doc_id, CASE WHEN doc_id % 29 <> 0 THEN hash END AS hash FROM stored)) GROUP BY source""")
def worker_counters(spark, sf):
    a = t.stored(spark, sf).select(F.col("source").alias("channel"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 29 != 0, F.col("hash")).alias("hash"))
    return metrics.worker_counters(a)


@query("""SELECT 'varve_objects_' || source AS name, '# HELP varve_objects_' || source || ' objects received' || chr(10) || '# TYPE varve_objects_' || source || ' counter' || chr(10) || 'varve_objects_' || source || ' ' || count(*) AS text
FROM stored GROUP BY source""")
def metrics_exposition(spark, sf):
    per = t.stored(spark, sf).groupBy("source").agg(F.count("*").alias("value"))
    return metrics.exposition(per.select(F.concat(F.lit("objects_"), "source").alias("name"), F.lit("counter").alias("kind"), F.lit("objects received").alias("help"), "value"))


@query(_RESOLVE.format(when="true").replace("SELECT dim, CAST(x AS INT)", ", o AS (SELECT dim, CAST(x AS INT)") + ") SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def outcome_tally(spark, sf):
    return metrics.outcome_tally(_restored(spark, sf))


@query(r""", lv AS (SELECT event_type AS channel, event_id AS seq, CAST(floor(value) AS BIGINT) AS level, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
fold AS (SELECT channel, seq, level, k, level >= 60 AS shut FROM lv WHERE k = 1
  UNION ALL SELECT l.channel, l.seq, l.level, l.k, CASE WHEN f.shut THEN l.level > 30 ELSE l.level >= 60 END FROM fold f JOIN lv l ON l.channel = f.channel AND l.k = f.k + 1)
SELECT channel, seq, level, shut FROM fold""")
def gate_hysteresis(spark, sf):
    e = t.read(spark, sf, "events").where("value IS NOT NULL")
    return snapshotter.gate(e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), F.floor("value").alias("level"), F.lit(60).alias("high")))


@query(r""", cl AS (SELECT event_type AS channel, event_id AS seq, CAST(event_id * 1000000 AS BIGINT) AS now_ns, 1 + event_id % 300 AS rate, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
fold AS (SELECT channel, seq, k, now_ns AS go_ns, now_ns + 1000000000 // rate AS free FROM cl WHERE k = 1
  UNION ALL SELECT c.channel, c.seq, c.k, greatest(c.now_ns, f.free), greatest(c.now_ns, f.free) + 1000000000 // c.rate FROM fold f JOIN cl c ON c.channel = f.channel AND c.k = f.k + 1)
SELECT channel, seq, go_ns FROM fold""")
def rate_limit_spacing(spark, sf):
    e = t.read(spark, sf, "events")
    return snapshotter.spacing(e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), (F.col("event_id") * 1000000).alias("now_ns"), (1 + F.col("event_id") % 300).alias("rate")))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'corrupt: payload is cut short' WHEN 2 THEN 'corrupt: bad data' WHEN 3 THEN 'corrupt: unknown payload kind 7' ELSE 'ok' END AS status FROM documents""")
def payload_integrity(spark, sf):
    """Documents as payloads: whole, cut short, damaged or of no known kind by their id."""
    import zlib

    import pandas as pd

    def pack(batches):
        for b in batches:
            out = []
            for i, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                data = zlib.compress((text or "").encode())
                out.append([b"\2" + data, b"\2" + data[:-3], b"\2" + data[:2] + b"\xff" + data[3:], b"\7" + data, b"\3" + data][i % 5])
            yield pd.DataFrame({"doc_id": b["doc_id"], "payload": out})

    payloads = t.read(spark, sf, "documents").select("doc_id", "text").mapInPandas(pack, "doc_id long, payload binary")
    return payloads.select("doc_id", codecs.payload_integrity("payload").alias("status"))


@query("SELECT dim, pos, arg_max(hash, seq) AS hash FROM changes GROUP BY dim, pos")
def stream_snapshot(spark, sf):
    """The changes as a stream, each run's snapshots in one folder, and the manifest they leave."""
    path = t.shared_path(spark, "stream")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = f"{sf}/events.parquet" if _is_folder(spark, f"{sf}/events.parquet") else sf
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if source != sf else "events.parquet").parquet(source)
    hash_ = F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "props").cast("binary"))
    rows = stream.select(F.col("event_type").alias("dim"), F.col("user_id").alias("pos"), F.col("event_id").alias("seq"), hash_.alias("hash"), F.octet_length("props").cast("long").alias("length"))
    snapshotter.start(rows, f"{path}/snapshots", f"{path}/checkpoint").awaitTermination()
    return snapshotter.manifest(spark, f"{path}/snapshots")


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# --- Upkeep -----------------------------------------------------------------------------------------------------


@query("SELECT snapshot_id FROM headers ORDER BY snapshot_id DESC LIMIT 20")
def snapshot_list(spark, sf):
    return upkeep.newest(t.headers(spark, sf).select("snapshot_id"))[0]


@query("""SELECT name, arg_min(lang, r) AS dim, arg_min(doc_id, r) AS doc_id FROM (SELECT source AS name, lang, min(doc_id) AS doc_id, list_position(['fr', 'en', 'de'], lang) AS r FROM documents GROUP BY ALL)
WHERE r IS NOT NULL GROUP BY name""")
def saved_data_probe(spark, sf):
    d = t.read(spark, sf, "documents").groupBy(F.col("source").alias("name"), F.col("lang").alias("dim")).agg(F.min("doc_id").alias("doc_id"))
    return upkeep.first_existing(d, ["fr", "en", "de"])


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def change_only_log(spark, sf):
    return upkeep.changed_only(t.read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""SELECT count(*) AS checked, count(*) FILTER (WHERE o.hash IS NULL) AS missing, count(*) FILTER (WHERE o.doc_id % 97 = 1) AS mismatches
FROM live l LEFT JOIN (SELECT * FROM objects WHERE doc_id % 13 <> 0) o USING (hash)""")
def window_self_check(spark, sf):
    o = t.objects(spark, sf).where("doc_id % 13 <> 0").withColumn("rehash", F.when(F.col("doc_id") % 97 == 1, "tampered").otherwise(F.col("hash")))
    return upkeep.self_check(t.references(spark, sf), o)


@query("SELECT count(*) AS dirty FROM (SELECT DISTINCT dim, pos FROM changes)")
def dirty_size(spark, sf):
    c = t.changes(spark, sf).select(F.lit("chunk").alias("channel"), "dim", "pos", F.lit(None).cast("string").alias("path"))
    return upkeep.dirty_size(c)


@query("SELECT doc_id AS key, CAST(toxic + 1 AS INT) AS attempt FROM labels WHERE quality = 0")
def capture_retries(spark, sf):
    a = t.read(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("attempt"), (F.col("quality") == 1).alias("ok"))
    return upkeep.retries(a)


@query("SELECT url, starts_with(url, 'https://') AND length(url) > 40 AS inside FROM pages")
def store_location(spark, sf):
    p = t.read(spark, sf, "pages").select("url", F.concat(F.when(F.col("url").startswith("https://") & (F.length("url") > 40), "/world//a/").otherwise("/world-b/"), F.lit("x")).alias("path"))
    return p.select("url", upkeep.is_nested(F.col("path"), F.lit("/world/")).alias("inside"))
