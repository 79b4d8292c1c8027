"""Files in and out: sinks, restores, packs, snapshots of all channels, profiler reports and payloads."""

from __future__ import annotations

import gzip
import hashlib
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from varve.operators import restore, scan, world
from varve.sources import codecs, file_sink, manifests, region_files
from varve.streaming import snapshotter

OBJECT = "hash string, length long, payload binary"
ENTRY = "snapshot_id string, channel string, dim string, pos long, path string, hash string, suspect boolean"


def at(x, z):
    return (x & 0xFFFFFFFF) | (z << 32)


def test_files_are_written_whole_and_below_the_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"one"), ("c", b"")], file_sink.SCHEMA)
    for _ in range(2):
        file_sink.write_files(rows, f"{tmp_path}/out")
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(tmp_path / "out") for f in names}
    assert found == {"a/b.txt": b"one", "c": b""}
    for path in ("../x", "/x", "a//b", ""):
        with pytest.raises(Exception, match="not a path"):
            file_sink.write_files(spark.createDataFrame([(path, b"x")], file_sink.SCHEMA), f"{tmp_path}/out")


@pytest.fixture
def store(spark):
    payloads = {"h1": b"\2" + zlib.compress(b"one"), "h2": b"\3two", "h3": b"\3" + bytes(300 * 4096), "h4": b"saved", "h5": b"stats", "h6": b"level"}
    objects = spark.createDataFrame([(h, len(b), b) for h, b in payloads.items()], OBJECT)
    rows = [
        ("s1", "chunk", "minecraft:overworld", at(0, 0), None, "h1", False), ("s1", "chunk", "minecraft:overworld", at(-1, -1), None, "h3", False),
        ("s1", "chunk", "mod:deep", at(40, 3), None, "h2", False), ("s1", "entity", "minecraft:the_end", at(5, -40), None, "h2", False),
        ("s1", "savedData", None, None, "map_0", "h4", False), ("s1", "files", None, None, "stats/a.json", "h5", True), ("s1", "levelDat", None, None, "level.dat", "h6", False),
        ("s2", "chunk", "minecraft:overworld", at(0, 0), None, "lost", False), ("s3", "chunk", "minecraft:overworld", at(0, 0), None, "h1", False),
    ]
    headers = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)], "snapshot_id string, baseline_complete boolean")
    return payloads, headers, spark.createDataFrame(rows, ENTRY), objects


def test_a_world_is_restored_and_read_again(spark, store, tmp_path):
    payloads, headers, entries, objects = store
    root = tmp_path / "world"
    (root / "region").mkdir(parents=True)
    (root / "region" / "old").write_bytes(b"old")
    (root / "keep").write_bytes(b"keep")
    place = f"file://{root}"
    run = lambda s: world.restore_world(spark, headers, entries, objects, s, place, now_ms=7)
    for name, error in (("s0", "no snapshot"), ("s2", "missing: lost"), ("s3", "no complete baseline")):
        with pytest.raises((FileNotFoundError, ValueError), match=error):
            run(name)
    assert (root / "region" / "old").exists()  # nothing was moved
    world.set_pending(spark, place, "s2")
    with pytest.raises(ValueError):
        world.run_pending(spark, place, run)
    assert world.pending(spark, place) == "s2"
    world.set_pending(spark, place, "s1")
    got = world.run_pending(spark, place, run)
    assert (got.chunks, got.entities, got.saved_data, got.files, got.suspect, got.level, got.backup) == (3, 1, 1, 1, 1, True, f"{place}.bak-7")
    assert world.pending(spark, place) is None and world.run_pending(spark, place, run) is None
    assert (tmp_path / "world.bak-7" / "region" / "old").read_bytes() == b"old" and (root / "keep").exists() and not (root / "region" / "old").exists()
    assert (root / "data" / "map_0.dat").read_bytes() == b"saved" and (root / "stats" / "a.json").read_bytes() == b"stats" and (root / "level.dat").read_bytes() == b"level"
    slots = region_files.with_external(region_files.read_slots(region_files.list_regions(spark, place)), spark, place)
    read = {(r.dim, r.channel, r.x, r.z): bytes(r.payload) for r in slots.collect()}
    assert read.pop(("minecraft:overworld", "region", -1, -1)) == b"\x83" + payloads["h3"][1:]  # 300 sectors: a file of its own
    assert read == {("minecraft:overworld", "region", 0, 0): payloads["h1"], ("mod:deep", "region", 40, 3): payloads["h2"], ("minecraft:the_end", "entities", 5, -40): payloads["h2"]}
    assert [r.hash for r in region_files.level_file(spark, place).collect()] == [hashlib.sha256(b"level").hexdigest()]
    assert region_files.level_file(spark, f"{place}.bak-7").count() == 0
    names = region_files.by_name(region_files.list_regions(spark, place)).select("path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in names] == ["r.-1.-1.mca", "r.0.-2.mca", "r.0.0.mca", "r.1.0.mca"]


def test_a_failed_move_is_taken_back(spark, tmp_path, monkeypatch):
    root = tmp_path / "world"
    for part in ("region", "data"):
        (root / part).mkdir(parents=True)
    real = world._path

    class Broken:
        def __init__(self, fs):
            self.exists, self.mkdirs, self.fs = fs.exists, fs.mkdirs, fs

        def rename(self, source, target):
            return not target.toString().endswith("bak-1/data") and self.fs.rename(source, target)

    monkeypatch.setattr(world, "_path", lambda spark, path: (real(spark, path)[0], Broken(real(spark, path)[1])))
    with pytest.raises(OSError, match="data could not be moved"):
        world.move_aside(spark, f"file://{root}", now_ms=1)
    assert (root / "region").is_dir() and (root / "data").is_dir() and not (tmp_path / "world.bak-1" / "region").exists()


def test_packs_are_a_source_and_objects_are_found(spark, tmp_path):
    records = [(bytes([k]) * 16, b"x" * k) for k in range(1, 40)]
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "7.pack").write_bytes(codecs.write_pack(records[:20]))
    (tmp_path / "packs" / "8.pack").write_bytes(codecs.write_pack(records[20:])[:-1])
    (tmp_path / "packs" / "9.idx").write_bytes(b"not a pack")
    found = codecs.scan_packs(spark, f"file://{tmp_path}/packs")
    assert {(r.pack_id, r.hash, r.length, bytes(r.payload)) for r in found.collect()} == {(7 if k < 20 else 8, h.hex(), len(b), b) for k, (h, b) in enumerate(records[:-1])}
    codecs.write_objects(found, f"file://{tmp_path}/objects")
    objects = spark.read.parquet(f"file://{tmp_path}/objects")
    assert [r.length for r in codecs.look_up(objects, ["05" * 16, "09" * 16, "05" * 16]).orderBy("hash").collect()] == [5, 9]
    with pytest.raises(Exception, match="no such object: ff"):
        codecs.look_up(objects, ["ff" * 16]).collect()
    import pyarrow.parquet as pq

    parts = [pq.ParquetFile(tmp_path / "objects" / f).metadata for f in os.listdir(tmp_path / "objects") if f.endswith(".parquet")]
    ranges = sorted((m.row_group(0).column(2).statistics.min, m.row_group(0).column(2).statistics.max) for m in parts if m.num_rows)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert [r.hash for r in scan.in_hash_order(objects.select("hash")).collect()] == sorted(h.hex() for h, _ in records[:-1])


def test_manifests_are_written_and_read_again(spark, store, tmp_path):
    _, headers, entries, _ = store
    full = headers.selectExpr("snapshot_id", "5L AS created_ms", "CAST(NULL AS LONG) AS world_game_time", "IF(snapshot_id = 's1', '0a', NULL) AS level_dat", "7L AS total_unique_bytes", "1L AS delta_bytes", "baseline_complete", "snapshot_id = 's2' AS incomplete")
    hexed = entries.withColumn("hash", F.hex(F.col("hash").cast("binary")))
    manifests.write_manifests(full, hexed.where("snapshot_id <> 's3'"), f"{tmp_path}/m")
    read = {r.snapshot_id: r for r in manifests.read_headers(spark, f"file://{tmp_path}/m").collect()}
    assert [(read[s].readable, read[s].level_dat, read[s].baseline_complete, read[s].incomplete, read[s].created_ms, read[s].world_game_time) for s in ("s1", "s2", "s3")] == [(True, "0a", True, False, 5, 0), (True, None, True, True, 5, 0), (True, None, False, False, 5, 0)]
    want = {tuple(r) for r in hexed.where("snapshot_id <> 's3' AND channel <> 'levelDat'").withColumn("hash", F.lower("hash")).collect()}
    assert {tuple(r) for r in manifests.read_entries(spark, f"file://{tmp_path}/m").collect()} == want | {("s1", "levelDat", None, None, "level.dat", "0a", False)}


def test_rewritten_regions_keep_their_other_slots(spark, tmp_path):
    schema = "dim string, channel string, rx int, rz int, slot int, payload binary"
    old = [("minecraft:overworld", "region", 0, 0, s, b"\3old%d" % s) for s in range(5)] + [("minecraft:overworld", "region", 1, 0, 0, b"\3far"), ("minecraft:overworld", "entities", 0, 0, 2, b"\3entity")]
    new = [("minecraft:overworld", "region", 0, 0, 2, b"\3new"), ("minecraft:overworld", "region", 0, 0, 9, b"\3added")]
    files = world.rewrite_regions(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    assert [f.path for f in files] == ["region/r.0.0.mca"]
    assert {s: p for s, p, _ in codecs.read_region(bytes(files[0].content))} == {**{s: b"\3old%d" % s for s in (0, 1, 3, 4)}, 2: b"\3new", 9: b"\3added"}


def test_payloads_are_decoded_and_checked_leniently(spark):
    tags = gzip.decompress(manifests.write_tags({"a": {"b": True, "c": 5}, "version": 3, "d": b"\xff", "e": [{"f": "é"}]}))
    body = tags[:-1] + b"\x0b" + struct.pack(">H", 1) + b"g" + struct.pack(">iii", 2, -1, 7) + b"\x06" + struct.pack(">H", 1) + b"h" + struct.pack(">d", 1.5) + b"\0"
    rows = [(1, b"\2" + zlib.compress(body)), (2, b"\x83" + body), (3, b"\1" + gzip.compress(body)), (4, None)]
    got = spark.createDataFrame(rows, "k int, payload binary").select("k", manifests.payload_json("payload").alias("j"))
    got = got.select("k", F.get_json_object("j", "$.a.c").alias("c"), F.get_json_object("j", "$.g[0]").alias("g"), F.get_json_object("j", "$.h").alias("h"), F.get_json_object("j", "$.e[0].f").alias("f")).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [("5", "-1", "1.5", "é")] * 3 + [(None,) * 4]
    data = codecs.write_region({1: b"\2broken", 2: b"\3ok"})[0]
    assert [s for _, _, s in codecs.read_region(data)][1] == "ok" and [s for _, _, s in codecs.read_region(data)][0].startswith("corrupt")
    assert [s for _, _, s in codecs.read_region(data, validate=False)] == ["ok", "ok"]


def test_files_that_change_while_they_are_read_are_suspect(spark):
    reads = iter([[("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("c", "2")], [("a", "9"), ("b", "2"), ("c", "3")], [("c", "4"), ("a", "9"), ("b", "8")]])
    got = region_files.collect_stable(lambda: spark.createDataFrame(next(reads), "path string, hash string"))
    assert sorted(map(tuple, got.collect())) == [("a", "1", False), ("b", "2", False), ("c", "4", True)]


def test_scans_read_torn_files_again(spark, tmp_path):
    files = spark.createDataFrame([("region", "d", f) for f in ("a", "b", "c")], "channel string, dim string, file string")
    calls = []

    def read(some):
        calls.append(sorted(r.file for r in some.collect()))
        bad = {1: ["b", "c"], 2: ["c"]}.get(len(calls), [])
        return some.withColumn("slot", F.lit(1)).withColumn("status", F.when(F.col("file").isin(bad), "torn: length").otherwise("ok"))

    slots, complete = scan.scan_passes(read, files, f"file://{tmp_path}/scan")
    assert complete and calls == [["a", "b", "c"], ["b", "c"], ["c"]] and sorted(r.file for r in slots.collect()) == ["a", "b", "c"]
    slots, complete = scan.scan_passes(lambda some: some.withColumn("status", F.lit("torn: header")), files, f"file://{tmp_path}/torn", passes=2)
    assert not complete and slots.count() == 0


def test_snapshots_of_all_channels(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    schema = "channel string, dim string, pos long, path string, seq long, hash string, length long"
    steps = []
    after = (lambda spark, where, n: steps.append((n, spark.read.parquet(f"{where}/headers/batch={n}").count())),)
    files = lambda *names: lambda: spark.createDataFrame([(n, f"f-{n}", 3, n == "b") for n in names], "path string, hash string, length long, suspect boolean")
    level = lambda *h: lambda: spark.createDataFrame([(x, 2) for x in h], "hash string, length long")
    first = [("chunk", "d", 1, None, 1, "aa", 5), ("chunk", "d", 1, None, 2, "ab", 7), ("entity", "d", 1, None, 1, "aa", 5), ("savedData", None, None, "data/x.dat", 1, "ca", 1)]
    snapshotter.create(spark.createDataFrame(first, schema), path, 0, files("a", "b"), level("l0"), after)
    snapshotter.create(spark.createDataFrame([("chunk", "d", 2, None, 3, "aa", 5)], schema), path, 1, files("c"), level(), after)
    for _ in range(2):  # a batch that is run again replaces what it wrote
        snapshotter.create(spark.createDataFrame([], schema), path, 2, None, level("l2"), after)
    assert steps == [(0, 1), (1, 1), (2, 1), (2, 1)]
    got = {(r.channel, r.pos, r.path): (r.hash, r.suspect) for r in snapshotter.entries(spark, path).collect()}
    assert got == {
        ("chunk", 1, None): ("ab", False), ("chunk", 2, None): ("aa", False), ("entity", 1, None): ("aa", False), ("savedData", None, "data/x.dat"): ("ca", False),
        ("files", None, "c"): ("f-c", False), ("levelDat", None, "level.dat"): ("l2", False),
    }
    h = {r.batch: r for r in spark.read.parquet(f"{path}/headers").collect()}
    assert [(h[k].n_entries, h[k].n_files, h[k].n_suspect, h[k].delta_bytes) for k in range(3)] == [(3, 2, 1, 5 + 7 + 1 + 3 + 3 + 2), (1, 1, 0, 3), (0, 0, 0, 2)]
    assert spark.read.parquet(f"{path}/objects").groupBy("hash").count().where("count > 1").count() == 0
    assert {(r.dim, r.pos, r.hash) for r in snapshotter.manifest(spark, path).collect()} == {("d", 1, "ab"), ("d", 2, "aa")}


def test_a_corrupt_header_stops_the_next_snapshot_before_it_writes(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    changes = spark.createDataFrame([("d", 1, 1, "aa", 5)], "dim string, pos long, seq long, hash string, length long")
    snapshotter.create(changes, path, 0)
    drained = []
    spark.createDataFrame([(99, 1)], "version int, n_entries long").write.mode("overwrite").parquet(f"{path}/headers/batch=0")
    with pytest.raises(snapshotter.CorruptBaseline):
        snapshotter.create(changes, path, 1, files=lambda: drained.append(1))
    folder = tmp_path / "out" / "headers" / "batch=0"
    for f in os.listdir(folder):
        os.remove(folder / f)
    (folder / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="header|parquet|Parquet|PARQUET"):
        snapshotter.create(changes, path, 1, files=lambda: drained.append(1))
    assert not drained and not os.path.exists(tmp_path / "out" / "entries" / "batch=1")


def test_the_source_of_changes_waits_and_drops_nothing(spark, tmp_path):
    schema = "dim string, pos long, seq long, hash string, length long"
    for k in range(6):
        spark.createDataFrame([("d", k, k, f"a{k}", 1)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = snapshotter.read_changes(spark, f"file://{tmp_path}/in", schema, files_a_batch=2)
    query = snapshotter.start(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check", interval="1 second")
    query.processAllAvailable()
    query.stop()
    headers = spark.read.parquet(f"file://{tmp_path}/out/headers").collect()
    assert [h.n_entries for h in headers].count(0) == 0 and max(h.n_entries for h in headers) <= 2 and sum(h.n_entries for h in headers) == 6
    with pytest.raises(ValueError):
        snapshotter.read_changes(spark, "x", schema, files_a_batch=1, bytes_a_batch="1m")


def field(n, b):
    key, size = [n << 3 | 2], []
    length = len(b)
    while True:
        size.append(length & 127 | (128 if length > 127 else 0))
        length >>= 7
        if not length:
            return bytes(key if n < 16 else [n << 3 & 127 | 2 | 128, n >> 4]) + bytes(size) + b


def number(n, v):
    return (bytes([n << 3]) if n < 16 else bytes([n << 3 & 127 | 128, n >> 4])) + bytes([v])


def real(n, v):
    return bytes([n << 3 | 1]) + struct.pack("<d", v)


def test_profiler_reports_are_a_source(spark, tmp_path):
    node = field(3, b"a.B") + field(4, b"run") + real(8, 1.5) + real(8, 2.0) + field(9, b"\x01\x02")
    thread = field(1, b"main") + field(3, node) + field(3, field(3, b"c.D"))
    mod = lambda i, name, builtin: field(13, field(1, i) + field(2, field(1, name) + field(2, b"1.0") + number(5, builtin)))
    platform = field(1, field(1, number(1, 3) + number(2, 4) + number(4, 9))) + field(2, field(1, b"G1") + field(2, number(1, 6) + real(2, 0.5))) + field(4, real(1, 20.0) + real(2, 19.5) + real(3, 18.0) + number(4, 20)) + number(7, 2)
    system = field(1, number(1, 8) + field(4, b"cpu")) + field(6, field(4, b"-Xmx"))
    meta = field(1, field(2, b"me")) + number(2, 1) + number(3, 4) + number(11, 9) + number(12, 7) + number(15, 1) + mod(b"z", b"Zed", 0) + mod(b"m", b"Core", 1) + mod(b"b", b"Bee", 0) + field(8, platform) + field(9, system)
    (tmp_path / "x.sparkprofile").write_bytes(field(1, meta) + field(2, thread))
    (tmp_path / "y.sparkprofile").write_bytes(field(1, b""))
    folder = f"file://{tmp_path}"
    nodes = manifests.read_profiles(spark, folder)
    assert sorted((r.thread, r.idx, r.cls, r.method, r.total, r.refs) for r in nodes.collect()) == [("main", 0, "a.B", "run", 3.5, [1, 2]), ("main", 1, "c.D", "", 0.0, [])]
    got = {r.path.rsplit("/", 1)[1]: r for r in manifests.read_profile_metadata(spark, folder).collect()}
    x, y = got["x.sparkprofile"], got["y.sparkprofile"]
    assert (x.creator, x.start_ms, x.interval_us, x.end_ms, x.ticks, x.mode, x.engine, x.players, x.tps, x.target_tps) == ("me", 1, 4, 9, 7, "ALLOC", "JAVA", 2, [20.0, 19.5, 18.0], 20)
    assert (x.heap_used, x.heap_committed, x.heap_max, x.cpu_threads, x.cpu_model, x.vm_args, x.mod_count) == (3, 4, 9, 8, "cpu", "-Xmx", 3)
    assert [m.name for m in x.mods] == ["Bee", "Zed"] and [(g.name, g.total, g.avg_ms, g.avg_freq_s) for g in x.gc] == [("G1", 6, 0.5, None)]
    assert (y.creator, y.tps, y.mod_count, y.mods) == (None, None, 0, [])


def test_a_gate_stops_a_restore_without_a_baseline(spark):
    headers = spark.createDataFrame([("a", True), ("b", False)], "snapshot_id string, baseline_complete boolean")
    assert restore.gate(headers, "a").first().allowed
    with pytest.raises(Exception, match="no complete baseline"):
        restore.gate(headers, "b").collect()
