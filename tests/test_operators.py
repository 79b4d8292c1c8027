"""Edge cases of the engine's operators, with their results written out."""

from __future__ import annotations

import os
import zlib

import pytest
from pyspark.sql import functions as F

from varve.functions import hashing, ids, positions
from varve.operators import collection, integrity, restore, retention, scan, snapshot, store
from varve.sources import codecs, region_files
from varve.streaming import snapshotter


def kept(spark, names, *quotas):
    df = spark.createDataFrame([(n,) for n in names], "snapshot_id string")
    return {r.snapshot_id for r in retention.flags(df, retention.Quotas(*quotas)).where("keep").collect()}


def day(d, h=8):
    return f"{d}T{h:02d}-00-00Z"


def test_newest_ids_fill_the_hourly_quota(spark):
    names = [day("2026-05-10", h) for h in range(19, 24)]
    assert kept(spark, names, 3, 0, 0, 0) == set(names[2:])


def test_daily_keeps_the_newest_of_each_day(spark):
    names = [day("2026-05-10", h) for h in (8, 12, 20)] + [day("2026-05-09", h) for h in (9, 18)]
    assert kept(spark, names, 0, 2, 0, 0) == {day("2026-05-10", 20), day("2026-05-09", 18)}


def test_weeks_are_iso_weeks(spark):
    names = [day("2026-01-05"), day("2026-01-04", 20), day("2026-01-04"), day("2025-12-30", 12)]
    assert kept(spark, names, 0, 0, 2, 0) == {day("2026-01-05"), day("2026-01-04", 20)}


def test_no_quota_keeps_everything_and_no_ids_give_none(spark):
    assert kept(spark, [day("2026-01-05"), day("2025-01-05")], 0, 0, 0, 0) == {day("2026-01-05"), day("2025-01-05")}
    assert kept(spark, [], 24, 7, 4, 12) == set()


def test_one_bad_id_stops_everything(spark):
    with pytest.raises(Exception, match="not a snapshot id"):
        kept(spark, [day("2026-01-05"), "latest"], 1, 0, 0, 0)
    with pytest.raises(ValueError):
        retention.Quotas(-1, 0, 0, 0)


def test_positions_pack_negative_cells(spark):
    df = spark.createDataFrame([(-1, 5), (0, 0), (2**31 - 1, -(2**31)), (-33, -32)], "x long, z long")
    pos = positions.pack(F.col("x"), F.col("z"))
    out = df.select("x", "z", positions.unpack_x(pos).alias("x2"), positions.unpack_z(pos).alias("z2"), positions.region(F.col("x")).alias("rx"), positions.slot(F.col("x"), F.col("z")).alias("slot")).collect()
    assert all((r.x, r.z) == (r.x2, r.z2) and r.rx == r.x >> 5 and r.slot == (r.x & 31) + 32 * (r.z & 31) for r in out)


def test_dimension_folders_and_saved_data(spark):
    df = spark.createDataFrame([("minecraft:the_nether", "map_0"), ("mod:deep/dark", "DIM1/data/x.dat")], "d string, k string")
    got = df.select(positions.dimension_folder(F.col("d")), positions.saved_data_target(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("DIM-1", "data/map_0.dat"), ("dimensions/mod/deep/dark", "DIM1/data/x.dat")]


def test_hash_strategies_and_hex(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    for name, (_, size) in hashing.STRATEGIES.items():
        assert len(df.select(hashing.hash_hex(F.col("t"), name)).first()[0]) == 2 * size
    assert [r[0] for r in spark.createDataFrame([("ab",), ("abc",), ("",), ("zz",)], "t string").select(hashing.is_hash(F.col("t"))).collect()] == [True, False, False, False]


def test_ids_round_trip(spark):
    df = spark.createDataFrame([(day("2026-01-05"),), ("x",)], "s string")
    assert [r[0] for r in df.select(ids.snapshot_id(ids.id_time(F.col("s")))).collect()] == [day("2026-01-05"), None]


def test_overlay_never_deletes_and_diff_names_changes(spark):
    p = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "dim string, pos long, hash string")
    b = spark.createDataFrame([("d", 2, "c"), ("d", 3, "e")], "dim string, pos long, hash string")
    over = snapshot.overlay(p, b)
    assert {tuple(r) for r in over.collect()} == {("d", 1, "a", "inherited"), ("d", 2, "c", "replaced"), ("d", 3, "e", "added")}
    assert {(r.pos, r.kind) for r in snapshot.diff(p, over).collect()} == {(2, "changed"), (3, "added")}


def test_packs_roll_before_a_write_and_may_overshoot(spark):
    df = spark.createDataFrame([("w", 1, "a", 60), ("w", 2, "b", 60), ("w", 3, "c", 60), ("v", 1, "d", 500), ("v", 2, "e", 1)], "g string, k long, hash string, length long")
    got = {r.hash: r.pack_id for r in store.assign_packs(df, "g", F.col("k"), 100).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 0, "e": 1}


def test_compaction_keeps_a_pack_at_the_threshold(spark):
    rows = [(0, 0, 0, 0, 0), (1, 0, 2, 0, 80), (2, 1, 1, 50, 50), (3, 1, 2, 40, 80), (4, 0, 1, 0, 9)]
    df = spark.createDataFrame(rows, "pack_id long, live long, dead long, live_bytes long, dead_bytes long")
    got = {r.pack_id: r.action for r in collection.compaction(df, 0.5, F.col("pack_id") == 4).collect()}
    assert got == {0: "skip", 1: "delete", 2: "skip", 3: "rewrite", 4: "skip"}


def test_trigger_sum_begins_anew(spark):
    df = spark.createDataFrame([(1, 30), (2, 30), (3, 10)], "k long, n long")
    assert [tuple(r) for r in collection.triggers(df, "k", "n", 50).orderBy("k").collect()] == [(1, 30, False), (2, 60, True), (3, 10, False)]


def test_classes_go_in_order_and_chunk_wins(spark):
    o = spark.createDataFrame([("a", "a", False), ("b", "x", True), ("c", "c", True), ("d", "d", False), ("e", "e", True)], "hash string, rehash string, inflates boolean")
    r = spark.createDataFrame([("a", "file"), ("a", "chunk"), ("b", "chunk"), ("d", "file"), ("e", "chunk")], "hash string, kind string")
    assert {x.hash: x["class"] for x in integrity.classify(o, r).collect()} == {"a": "corrupt", "b": "mismatch", "c": "orphan", "d": "file", "e": "chunk"}


def test_partial_restore_fails_only_for_explicit_cells(spark):
    m = spark.createDataFrame([("d", 1, "h")], "dim string, pos long, hash string")
    o = spark.createDataFrame([("h",)], "hash string")
    t = lambda explicit: spark.createDataFrame([("d", 1, explicit), ("d", 2, explicit)], "dim string, pos long, explicit boolean")
    assert {r.pos: r.outcome for r in restore.restore_partial(t(False), m, o).collect()} == {1: "restored", 2: "not_captured"}
    with pytest.raises(Exception, match="never captured"):
        restore.restore_partial(t(True), m, o).collect()
    with pytest.raises(ValueError):
        positions.area(F.lit(0), F.lit(0), 50)


def test_progress_never_goes_back(spark):
    log = spark.createDataFrame([("c", "d", "f", "committed"), ("c", "d", "f", None), ("c", "d", "g", None)], "channel string, dim string, file string, status string")
    p = scan.progress(log)
    assert {r.file: r.status for r in p.collect()} == {"f": "committed", "g": "scanned"}
    assert scan.is_complete(p, True).first()[0] is False
    assert scan.is_complete(p.where("file = 'f'"), True).first()[0] is True


def test_gate_and_spacing_fold_in_order(spark):
    levels = spark.createDataFrame([("c", k, v, 10) for k, v in enumerate([9, 10, 6, 5, 9])], "channel string, seq long, level long, high long")
    assert [r.shut for r in snapshotter.gate(levels).orderBy("seq").collect()] == [False, True, True, False, False]
    calls = spark.createDataFrame([("c", 1, 0, 10), ("c", 2, 1, 10), ("c", 3, 10**9, 10)], "channel string, seq long, now_ns long, rate long")
    assert [r.go_ns for r in snapshotter.spacing(calls).orderBy("seq").collect()] == [0, 10**8, 10**9]


def test_folds_in_blocks_give_what_one_block_gives(spark):
    import random

    rng = random.Random(4)
    seqs = {c: rng.sample(range(10_000), 400) for c in ("a", "b", None)}
    levels = spark.createDataFrame([(c, k, rng.randint(0, 14), 10) for c in seqs for k in seqs[c]], "channel string, seq long, level long, high long").repartition(3)
    calls = spark.createDataFrame([(c, k, 10**6 * (k // 3), rng.choice([1, 50, 10**4])) for c in seqs for k in seqs[c]], "channel string, seq long, now_ns long, rate long").repartition(3)
    for fold, rows in ((snapshotter.gate, levels), (snapshotter.spacing, calls)):
        one, many = (sorted(map(repr, map(tuple, fold(rows, block_rows=n).collect()))) for n in (10**6, 50))
        assert one == many and len(one) == 1200
        assert fold(rows.limit(0)).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # blocks that go on from batch to batch
    try:
        assert sorted(map(repr, map(tuple, snapshotter.gate(levels, block_rows=50).collect()))) == sorted(map(repr, map(tuple, snapshotter.gate(levels).collect())))
        assert sorted(map(repr, map(tuple, snapshotter.spacing(calls, block_rows=50).collect()))) == many
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    shut, want = False, []
    rows = sorted((r.seq, r.level) for r in levels.where("channel = 'a'").collect())
    for _, level in rows:
        shut = level > 5 if shut else level >= 10
        want.append(shut)
    assert [r.shut for r in snapshotter.gate(levels, block_rows=50).where("channel = 'a'").orderBy("seq").collect()] == want


def test_region_file_round_trip_and_damage(spark, tmp_path):
    big = b"\2" + bytes(300 * 4096)
    slots = {0: b"\2" + zlib.compress(b"a" * 5000), 33: b"\3" + bytes(4096), 1023: b"\1bad", 7: big}
    data, outside = codecs.write_region(slots)
    got = {slot: (payload, status) for slot, payload, status in codecs.read_region(data)}
    assert got[0] == (slots[0], "ok") and got[33] == (slots[33], "ok") and got[1023][1].startswith("corrupt") and got[7] == (b"\x82", "external") and outside == {7: big[1:]}
    folder = tmp_path / "world" / "DIM-1" / "region"
    folder.mkdir(parents=True)
    (folder / "r.-1.2.mca").write_bytes(data)
    (folder / "c.-25.64.mcc").write_bytes(big[1:])
    world = f"file://{tmp_path}/world"
    regions = region_files.list_regions(spark, world)
    rows = region_files.read_slots(regions).collect()
    assert {(r.dim, r.rx, r.rz, r.slot, r.x, r.z) for r in rows} == {("minecraft:the_nether", -1, 2, s, -32 + s % 32, 64 + s // 32) for s in slots}
    assert region_files.read_cell(spark, world, "minecraft:the_nether", -32, 64).first().status == "ok"
    whole = {r.slot: r for r in region_files.with_external(region_files.read_slots(regions), spark, world).collect()}
    assert bytes(whole[7].payload) == b"\x82" + big[1:] and codecs.payload_status(bytes(whole[7].payload)).startswith("corrupt")
    # The same cell of another dimension and of the other channel has files of its own.
    for place, byte in (("region", b"o"), ("DIM-1/entities", b"e")):
        (tmp_path / "world" / place).mkdir(parents=True)
        (tmp_path / "world" / place / "r.-1.2.mca").write_bytes(codecs.write_region({7: b"\x83" + byte, 8: b"\x83gone"})[0])
        (tmp_path / "world" / place / "c.-25.64.mcc").write_bytes(byte)
    rows = region_files.with_external(region_files.read_slots(region_files.list_regions(spark, world)), spark, world).where("slot in (7, 8)").collect()
    got = {(r.dim.split("_")[-1], r.channel, r.slot): (r.payload and bytes(r.payload), r.status) for r in rows}
    assert len(rows) == 5 and got["minecraft:overworld", "region", 7] == (b"\x83o", "external") and got["nether", "entities", 7] == (b"\x83e", "external")
    assert got["nether", "entities", 8] == (None, "torn: external file is missing")
    assert [r.dim for r in region_files.dimensions(region_files.list_regions(spark, world)).collect()] == ["minecraft:overworld", "minecraft:the_nether"]
    assert list(codecs.read_region(b"")) == [] and list(codecs.read_region(data[:5000]))[0][2] == "torn: header"


def test_packs_leave_out_a_torn_tail():
    data = codecs.write_pack([(b"h" * 16, b"one"), (b"g" * 16, b"two")])
    assert [x[2] for x in codecs.read_pack(data)] == [b"one", b"two"] and [x[2] for x in codecs.read_pack(data[:-1])] == [b"one"]


def test_wire_fields():
    assert list(codecs.wire_fields(b"\x08\x96\x01\x12\x02hi")) == [(1, 150), (2, b"hi")]
    assert codecs.doubles(bytes(8) + b"\0\0\0\0\0\0\xf0?") == [0.0, 1.0]


def test_manifest_files_round_trip(spark, tmp_path):
    from varve.sources import manifests

    root = {
        "version": 1, "snapshotId": day("2026-01-05"), "createdAtMillis": 5, "chunks": {"minecraft:overworld": [{"pos": -1, "hash": b"\1\2"}], "empty": []},
        "savedData": {"data/x.dat": b"\3"}, "levelDat": b"\4", "baselineComplete": True, "files": {"stats/é.json": {"h": b"\5", "s": True}},
    }
    assert manifests.read_tags(manifests.write_tags(root))["files"]["stats/é.json"] == {"h": b"\5", "s": 1}
    (tmp_path / f"{day('2026-01-05')}.manifest").write_bytes(manifests.write_tags(root))
    (tmp_path / f"{day('2026-01-06')}.manifest").write_bytes(manifests.write_tags({"version": 2}))
    (tmp_path / f"{day('2026-01-04')}.manifest").write_bytes(manifests.write_tags({"version": 1, "snapshotId": day("2026-01-04")}))
    folder = f"file://{tmp_path}"
    assert [r[0] for r in manifests.list_ids(spark, folder).collect()] == [day("2026-01-06"), day("2026-01-05"), day("2026-01-04")]
    h = {r.snapshot_id: r for r in manifests.read_headers(spark, folder).collect()}
    assert h[day("2026-01-05")].baseline_complete and h[day("2026-01-05")].level_dat == "04" and not h[day("2026-01-04")].baseline_complete
    assert not h[day("2026-01-06")].readable and "version 2" in h[day("2026-01-06")].error
    os.remove(tmp_path / f"{day('2026-01-06')}.manifest")
    got = {tuple(r)[1:] for r in manifests.read_entries(spark, folder).collect()}
    assert got == {("chunk", "minecraft:overworld", -1, None, "0102", False), ("savedData", None, None, "data/x.dat", "03", False), ("files", None, None, "stats/é.json", "05", True), ("levelDat", None, None, "level.dat", "04", False)}


def test_profile_reports():
    from varve.sources import manifests

    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    node = field(1, b"a.B") + field(2, b"run") + field(3, bytes(8) + b"\0\0\0\0\0\0\xf0?") + field(4, b"\x01\x96\x01")
    report = field(7, field(5, b"main") + field(6, node))
    names = {"threads": 7, "name": 5, "nodes": 6, "cls": 1, "method": 2, "times": 3, "refs": 4}
    assert list(manifests.parse_profile(report, names)) == [("main", 0, "a.B", "run", 1.0, [1, 150])]


def test_self_time_floors_and_ignores_numbers_of_no_node(spark):
    from varve.operators import profile

    nodes = spark.createDataFrame([("t", 0, "a", "x", 5, [1, 9]), ("t", 1, "b", "y", 7, [])], "thread string, idx int, cls string, method string, total long, refs array<int>")
    links = profile.edges(nodes)
    assert [tuple(r) for r in links.collect()] == [("t", 0, 1)]
    assert {r.idx: r.self for r in profile.self_time(nodes, links).collect()} == {0: 0, 1: 7}


def test_upkeep(spark, tmp_path):
    from varve.operators import upkeep

    df = spark.createDataFrame([("12\tno space", "12"), ("x", "?"), ("", "")], "m string, d string")
    got = df.select(upkeep.parse_marker(F.col("m")).alias("m"), upkeep.parse_degraded(F.col("d")).alias("d")).collect()
    assert got[0].m.reason == "no space" and got[1].m is None and [r.d for r in got] == [12, None, None]
    f = spark.createDataFrame([("a.tmp", 1), ("b.tmp", 2), ("c", 1)], "path string, modified long")
    assert upkeep.orphans(f).count() == 2 and [r.path for r in upkeep.orphans(f, 2).collect()] == ["a.tmp"]
    pointer = f"file://{tmp_path}/current"
    assert upkeep.published(spark, pointer) is None
    for v in ("v1", "v2"):
        upkeep.publish(spark, pointer, v)
        assert upkeep.published(spark, pointer) == v
    assert upkeep.published(spark, pointer, back=1) == "v1" and upkeep.published(spark, pointer, back=2) is None
    more = upkeep.newest(spark.createDataFrame([(str(k),) for k in range(23)], "snapshot_id string"))
    assert more[0].count() == 20 and more[1] == 3


def test_stream_of_changes_to_snapshots(spark, tmp_path):
    schema = "dim string, pos long, seq long, hash string, length long"
    source, path = tmp_path / "in", f"file://{tmp_path}/out"
    for k, rows in enumerate(([("d", 1, 1, "a", 1), ("d", 1, 2, "b", 1), ("d", 2, 3, "a", 1)], [("d", 2, 4, "c", 1)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(schema).parquet(f"file://{source}")
        snapshotter.start(stream, path, f"file://{tmp_path}/check").awaitTermination()
        assert spark.read.parquet(f"{path}/headers").count() == k + 1
    assert {tuple(r) for r in snapshotter.manifest(spark, path).collect()} == {("d", 1, "b"), ("d", 2, "c")}
    assert sorted(r.hash for r in spark.read.parquet(f"{path}/objects").collect()) == ["a", "b", "c"]


def test_heaviest_path_query_follows_deep_trees(spark, monkeypatch):
    from varve.plans import catalog

    nodes = spark.createDataFrame([("t", k, "c", "m", 100 - k) for k in range(30)], "thread string, idx long, cls string, method string, total long")
    links = spark.createDataFrame([("t", k, k + 1) for k in range(9)], "thread string, parent long, child long")
    monkeypatch.setattr(catalog.t, "call_tree", lambda spark, sf: (nodes, links))
    got = {(r.depth, r.idx) for r in catalog.QUERIES["profile_heaviest_path"](spark, None).where("root = 0").collect()}
    assert got == {(k, k) for k in range(10)}
