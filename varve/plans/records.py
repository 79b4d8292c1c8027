"""Registered queries for the small operators on records: codecs, keys, markers, guards, scans and restores of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from varve.functions import hashing, ids, positions
from varve.operators import profile, restore, scan, snapshot, upkeep, world
from varve.plans import catalog
from varve.plans import tables as t
from varve.plans.catalog import query
from varve.sources.codecs import read_region

# --- Hashes and keys --------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, sha1(coalesce(text, '')) AS sha1, md5(coalesce(text, '')) AS md5 FROM documents")
def hash_strategies(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return t.read(spark, sf, "documents").select("doc_id", *[hashing.hash_hex(text, name).alias(name) for name in ("sha256", "sha1", "md5")])


@query("""SELECT hash, regexp_full_match(hash[1:doc_id % 9], '([0-9a-fA-F]{2})+') AS valid, CAST(octet_length(unhex(hash)) AS INT) AS bytes, lower(hex(unhex(upper(hash)))) AS again FROM objects""")
def hash_codecs(spark, sf):
    h, some = F.col("hash"), F.expr("substring(hash, 1, cast(doc_id % 9 as int))")
    return t.objects(spark, sf).select("hash", hashing.is_hash(some).alias("valid"), F.octet_length(hashing.from_hex(h)).alias("bytes"), hashing.to_hex(hashing.from_hex(F.upper("hash"))).alias("again"))


@query("""SELECT dim, CASE dim WHEN 'minecraft:overworld' THEN '' WHEN 'minecraft:the_nether' THEN 'DIM-1' WHEN 'minecraft:the_end' THEN 'DIM1' ELSE 'dimensions/' || replace(dim, ':', '/') END AS folder
FROM (SELECT ['minecraft:overworld', 'minecraft:the_nether', 'minecraft:the_end', 'mod:' || lower(replace(n_name, ' ', '_'))][n_nationkey % 4 + 1] AS dim FROM nation)""")
def dimension_folders(spark, sf):
    other = F.concat(F.lit("mod:"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))
    names = F.array(*map(F.lit, ("minecraft:overworld", "minecraft:the_nether", "minecraft:the_end")), other)
    dims = t.read(spark, sf, "nation").select(F.get(names, (F.col("n_nationkey") % 4).cast("int")).alias("dim"))
    return dims.select("dim", positions.dimension_folder(F.col("dim")).alias("folder"))


@query("""SELECT key, CASE WHEN contains(key, '/') THEN key ELSE 'data/' || key || '.dat' END AS path FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'DIM1/data/' || n_name || '.dat' ELSE n_name END AS key FROM nation)""")
def saved_data_targets(spark, sf):
    key = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("DIM1/data/"), "n_name", F.lit(".dat"))).otherwise(F.col("n_name"))
    return t.read(spark, sf, "nation").select(key.alias("key")).select("key", positions.saved_data_target(F.col("key")).alias("path"))


@query("SELECT o_orderkey, CAST(k AS INT) AS kind, k >= 128 AS external, CAST(k % 128 AS INT) AS base FROM (SELECT o_orderkey, (o_orderkey * 37) % 256 AS k FROM orders)")
def payload_kinds(spark, sf):
    payload = F.unhex(F.concat(F.lpad(F.hex((F.col("o_orderkey") * 37) % 256), 2, "0"), F.lit("ff00")))
    kind = positions.type_byte(payload)
    return t.read(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), positions.is_external(kind).alias("external"), positions.payload_kind(kind).alias("base"))


_PAIR = "CASE o_orderkey % 4 WHEN 0 THEN (o_custkey - 700) || ',' || (o_orderkey % 4001 - 2000) WHEN 1 THEN o_custkey || ',' WHEN 2 THEN o_custkey || ',' || o_orderkey || ',1' ELSE o_custkey || ';' || o_orderkey END"


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 AS is_pair, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey - 700 AS INT) ELSE 0 END AS x,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 4001 - 2000 AS INT) ELSE 0 END AS z FROM orders""")
def coordinate_pairs(spark, sf):
    pairs = t.read(spark, sf, "orders").select("o_orderkey", positions.parse_pair(F.expr(_PAIR)).alias("p"))
    return pairs.select("o_orderkey", F.col("p").isNotNull().alias("is_pair"), F.coalesce("p.x", F.lit(0)).alias("x"), F.coalesce("p.z", F.lit(0)).alias("z"))


@query("""SELECT radius, CAST((2 * radius + 1) * (2 * radius + 1) AS BIGINT) AS cells, x + radius <= 2147483647 AND (2 * radius + 1) * (2 * radius + 1) <= 10000 AS offline,
  x + radius <= 2147483647 AND radius <= 8 AS online, (2 * radius + 1) * (2 * radius + 1) > 9 AS confirm, x
FROM (SELECT CAST(n_nationkey * 3 AS BIGINT) AS radius, CASE WHEN n_nationkey % 5 = 0 THEN 2147483640 ELSE n_nationkey END AS x FROM nation)""")
def area_guards(spark, sf):
    n = F.col("n_nationkey").cast("long")
    rows = t.read(spark, sf, "nation").select((n * 3).alias("radius"), F.when(n % 5 == 0, 2147483640).otherwise(n).alias("x"))
    return rows.select("radius", "x", positions.area_check(F.col("x"), F.lit(0), F.col("radius")).alias("c")).select("radius", "x", "c.*")


# --- Texts ------------------------------------------------------------------------------------------------------


@query("SELECT source, hash, CAST(length // 1024 AS BIGINT) AS kib, round(100.0::DOUBLE * length / sum(length) OVER (PARTITION BY source), 2) AS percent FROM (SELECT source, hash, max(length) AS length FROM stored GROUP BY ALL)")
def size_shares(spark, sf):
    own = t.stored(spark, sf).groupBy("source", "hash").agg(F.max("length").alias("length"))
    whole = own.groupBy("source").agg(F.sum("length").alias("whole"))
    return own.join(whole, "source").select("source", "hash", ids.kib(F.col("length")).alias("kib"), ids.percent(F.col("length"), F.col("whole")).alias("percent"))


@query("SELECT doc_id, md5(translate(text, chr(10) || chr(9), '  ')) AS line FROM documents")
def one_line_reasons(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", F.md5(ids.one_line(F.col("text")).cast("binary")).alias("line"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN doc_id * 1000 ELSE -1 END AS at_ms, CASE doc_id % 4 WHEN 0 THEN 'disk full' WHEN 1 THEN '' END AS reason,
  CASE WHEN doc_id % 4 IN (1, 2) THEN doc_id * 1000 ELSE -1 END AS degraded_ms, CASE WHEN doc_id % 4 <> 3 THEN 'snap-' || doc_id END AS pending FROM documents""")
def marker_reads(spark, sf):
    d = t.read(spark, sf, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 4 WHEN 0 THEN concat(doc_id * 1000, '\\tdisk full') WHEN 1 THEN string(doc_id * 1000) WHEN 2 THEN 'torn' ELSE '' END AS failure",
        "CASE doc_id % 4 WHEN 0 THEN 'x1' WHEN 3 THEN '' ELSE concat(doc_id * 1000, '\\n') END AS degraded",
        "CASE WHEN doc_id % 4 = 3 THEN ' \\n' ELSE concat('snap-', doc_id, '\\n') END AS flag",
    )
    read = upkeep.parse_marker(F.col("failure"))
    none = F.lit(-1).cast("long")  # where a marker is damaged
    out = d.select("doc_id", read.alias("m"), F.coalesce(upkeep.parse_degraded(F.col("degraded")), none).alias("degraded_ms"), upkeep.parse_pending(F.col("flag")).alias("pending"))
    return out.select("doc_id", F.coalesce("m.at_ms", none).alias("at_ms"), "m.reason", "degraded_ms", "pending")


@query(catalog._RESOLVE.format(when="true").replace("SELECT dim, CAST(x AS INT)", ", o AS (SELECT dim, CAST(x AS INT)") + """) SELECT x, z, CASE outcome WHEN 'restored' THEN 'restored'
  WHEN 'not_captured' THEN 'not in this snapshot' ELSE 'its object is missing from the store' END AS message FROM o""")
def outcome_messages(spark, sf):
    return catalog._restored(spark, sf).select("x", "z", restore.message(F.col("outcome")).alias("message"))


# --- Snapshots and scans ----------------------------------------------------------------------------------------


@query(""", own AS (SELECT DISTINCT snapshot_id, hash FROM refs), before AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS prior FROM (SELECT DISTINCT snapshot_id FROM own))
SELECT o.snapshot_id, CAST(sum(length) AS BIGINT) AS unique_bytes, CAST(coalesce(sum(length) FILTER (WHERE p.hash IS NULL), 0) AS BIGINT) AS delta_bytes
FROM own o JOIN before b ON b.snapshot_id = o.snapshot_id JOIN objects USING (hash) LEFT JOIN own p ON p.snapshot_id = b.prior AND p.hash = o.hash GROUP BY o.snapshot_id""")
def snapshot_byte_stats(spark, sf):
    return snapshot.byte_stats(t.references(spark, sf), t.objects(spark, sf))


@query(""", latched AS (SELECT *, bool_or(incomplete) OVER (ORDER BY snapshot_id) AS degraded FROM headers)
SELECT o_orderkey FROM orders WHERE epoch_ms(CAST(o_orderdate AS TIMESTAMP)) > (SELECT coalesce(max(created_ms) FILTER (WHERE NOT degraded), 0) FROM latched)""")
def rescan_after_complete(spark, sf):
    latched = snapshot.latch(t.headers(spark, sf).withColumnRenamed("incomplete", "degraded"), "snapshot_id", "degraded")
    files = t.read(spark, sf, "orders").select("o_orderkey", (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).alias("modified"))
    return scan.changed_since(files, snapshot.last_complete(latched).select("cutoff_ms").scalar()).select("o_orderkey")


@query(""", found AS (SELECT dim, pos, arg_max(hash, seq) AS hash FROM changes GROUP BY dim, pos)
SELECT dim, pos, hash, hash NOT IN (SELECT hash FROM changes WHERE pos % 3 = 0) AS stored FROM found WHERE pos % 7 <> 0""")
def baseline_scan_new(spark, sf):
    c = t.changes(spark, sf)
    slots = snapshot.last_writer(c, F.col("seq")).withColumn("channel", F.lit("region"))
    objects = c.where("pos % 3 = 0").select("hash").distinct()
    return scan.scan_new(slots, slots.where("pos % 7 = 0"), objects).select("dim", "pos", "hash", "stored")


@query("SELECT dim, pos, arg_max(hash, seq) AS hash FROM (SELECT dim, pos, seq, hash FROM changes WHERE pos % 2 = 0 UNION ALL SELECT dim, pos, -1, md5('scan' || pos) FROM (SELECT DISTINCT dim, pos FROM changes)) GROUP BY dim, pos")
def backfill_blind_window(spark, sf):
    c = t.changes(spark, sf).select("dim", "pos", "seq", "hash")
    found = c.select("dim", "pos").distinct().select("dim", "pos", F.md5(F.concat(F.lit("scan"), F.col("pos").cast("string")).cast("binary")).alias("hash"))
    return snapshot.last_writer(upkeep.backfill(c.where("pos % 2 = 0"), found.select("dim", "pos", "hash")), F.col("seq"))


@query("SELECT DISTINCT hash FROM (SELECT hash FROM changes UNION ALL SELECT hash FROM stored WHERE doc_id % 4 = 0 UNION ALL SELECT md5(role) FROM conversations) WHERE hash IS NOT NULL")
def pending_hashes(spark, sf):
    said = t.read(spark, sf, "conversations").select(F.md5(F.col("role").cast("binary")).alias("hash"))
    return upkeep.pending_hashes(t.changes(spark, sf), t.stored(spark, sf).where("doc_id % 4 = 0"), said)


@query("SELECT 'f' || event_id || '.tmp' AS path FROM events WHERE event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-15 00:00:00'")
def orphan_files(spark, sf):
    e = t.read(spark, sf, "events")
    files = e.select(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".tmp").otherwise(".dat")).alias("path"), F.col("ts").alias("modified"))
    return upkeep.orphans(files, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("path")


@query("""SELECT l_orderkey, l_linenumber, 0.0::DOUBLE + CAST(l_quantity AS DOUBLE) + CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) AS total FROM lineitem""")
def profile_node_totals(spark, sf):
    times = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    return t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", profile.node_totals(times).alias("total"))


@query("""SELECT '{"keyword":"' || keyword || '","nodes":' || nodes || ',"total":' || total || '}' AS line FROM (
  SELECT keyword, CAST(sum(total) AS BIGINT) AS total, count(*) AS nodes FROM nodes, (SELECT unnest(['shop', 'tick']) AS keyword) WHERE contains(lower(cls || '.' || method), keyword) GROUP BY keyword)""")
def profile_json(spark, sf):
    return profile.as_json(profile.by_keyword(t.call_tree(spark, sf)[0], ["shop", "tick"]))


@query("SELECT event_id, value * 1000 <= 30000 AS holds FROM events WHERE value IS NOT NULL")
def area_confirmations(spark, sf):
    e = t.read(spark, sf, "events").where("value IS NOT NULL")
    return e.select("event_id", positions.still_confirmed(F.lit(0.0), F.col("value") * 1000).alias("holds"))


# --- Restores ---------------------------------------------------------------------------------------------------


@query("SELECT snapshot_id, created_ms, true AS allowed FROM headers WHERE snapshot_id = (SELECT max(snapshot_id) FROM headers WHERE baseline_complete)")
def restore_gate(spark, sf):
    h = t.headers(spark, sf)
    latest = snapshot.last_complete(h).first().latest_baseline  # one short text
    return restore.gate(h, latest).select("snapshot_id", "created_ms", "allowed")


@query("""SELECT count(*) FILTER (WHERE kind = 'chunk') AS chunks, 0 AS entities, 0 AS saved_data, count(*) FILTER (WHERE kind = 'file') AS files,
  count(*) FILTER (WHERE kind = 'file' AND hash < '8') AS suspect, false AS level FROM refs""")
def restore_counts(spark, sf):
    channel = F.when(F.col("kind") == "file", "files").otherwise("chunk")
    return world.counts(t.references(spark, sf).select(channel.alias("channel"), (F.col("hash") < "8").alias("suspect")))


@query("""SELECT 'dimensions/mod/' || lower(replace(dim, ' ', '_')) || '/region/r.' || rx || '.' || rz || '.mca' AS path, slot, length % 500 + 2 AS bytes, 'ok' AS status FROM slots""")
def region_files_read_back(spark, sf):
    """Slots of uncompressed payloads written as region files, and these read again."""
    dim = F.concat(F.lit("mod:"), F.lower(F.replace("dim", F.lit(" "), F.lit("_"))))
    payload = F.concat(F.unhex(F.lit("03")), F.repeat(F.lit("x"), (F.col("length") % 500 + 1).cast("int")).cast("binary"))
    slots = t.slots(spark, sf).select(dim.alias("dim"), F.lit("region").alias("channel"), "rx", "rz", "slot", payload.alias("payload"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, slot, len(payload), status) for path, content in zip(b["path"], b["content"], strict=True) for slot, payload, status in read_region(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "slot", "bytes", "status"])

    return world.region_files(slots).mapInPandas(read, "path string, slot long, bytes long, status string")
