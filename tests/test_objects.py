import os

import pytest
from pyspark.sql import functions as F

from rehome.plans.estate import recover_data, store_objects
from rehome.sinks.copy import INCOMING, copy_objects, verify_objects
from rehome.sources.objects import leaf_files, list_objects, list_tables, objects_from_paths, tables_from_paths


def put(root, path, text="x"):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)


@pytest.fixture
def store(tmp_path):
    root = tmp_path / "w1" / "s1"
    put(root, "Tables/dbo/trips/part-0.parquet", "aaaa")
    put(root, "Tables/dbo/trips/day=1/part-1.parquet", "bb")
    put(root, "Tables/dbo/trips/day=1/deep/part-2.parquet", "c")
    put(root, "Tables/sales/orders/part-0.parquet", "dd")
    put(root, "Files/readme.txt", "hello")
    put(root, "Files/folder/a.csv", "1")
    (root / "Files" / "nothing").mkdir()
    return root


def stores(spark, *paths):
    return spark.createDataFrame([(str(p),) for p in paths], "base_path STRING")


def test_list_objects(spark, store, rows):
    found = list_objects(stores(spark, store, store.parent / "none"))
    assert rows(found, "name", "type") == [
        ("dbo", "table"), ("folder", "file"), ("nothing", "file"), ("readme.txt", "file"), ("sales", "table"),
    ]
    assert rows(list_objects(stores(spark, store), ["Tables"]), "src_path")[0] == (f"{store}/Tables/dbo",)


def test_list_tables(spark, store, rows):
    assert rows(list_tables(stores(spark, store)), "schema", "name", "type") == [
        ("dbo", "trips", "table"), ("sales", "orders", "table"),
    ]
    assert list_tables(stores(spark, store), ["sales"]).count() == 1
    empty = list_tables(stores(spark, store.parent / "none"))
    assert empty.columns == ["base_path", "schema", "name", "type", "src_path"] and empty.isEmpty()


def test_file_uris(spark, store):
    assert list_tables(stores(spark, f"file://{store}", f"file:{store}")).count() == 4


def test_inventory_paths(spark, rows):
    paths = spark.createDataFrame(
        [
            ("abfss://w@h/s/Tables/dbo/t/part-0",),
            ("abfss://w@h/s/Tables/dbo/t/Files/x",),
            ("abfss://w@h/s/Tables/top",),
            ("abfss://w@h/s/Files/a.csv",),
            ("abfss://w@h/s/Files/Tables/y",),
            ("abfss://w@h/other",),
            (None,),
        ],
        "path STRING",
    )
    assert rows(objects_from_paths(paths), "name", "type", "src_path") == [
        ("Tables", "file", "abfss://w@h/s/Files/Tables"),
        ("a.csv", "file", "abfss://w@h/s/Files/a.csv"),
        ("dbo", "table", "abfss://w@h/s/Tables/dbo"),
        ("top", "table", "abfss://w@h/s/Tables/top"),
    ]
    assert ("dbo", "t", "abfss://w@h/s/Tables/dbo/t") in rows(tables_from_paths(paths), "schema", "name", "src_path")


def test_leaf_files(spark, store, rows):
    roots = spark.createDataFrame([(str(store), "tag")], "path STRING, tag STRING")
    found = leaf_files(roots)
    assert found.count() == 6 and {r["tag"] for r in found.collect()} == {"tag"}
    assert found.agg(F.sum("size")).first()[0] == 15
    one = leaf_files(spark.createDataFrame([(f"{store}/Files/readme.txt",)], "path STRING"))
    assert rows(one, "name", "size") == [("readme.txt", 5)]


def tree(root):
    return {
        os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read()
        for d, _, files in os.walk(root)
        for f in files
    }


def plan(spark, *pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src_path STRING, dst_path STRING")


def test_copy_replaces_the_target(spark, store, tmp_path, rows):
    out = tmp_path / "w2"
    put(out, "trips/old.parquet", "stale")
    audit = copy_objects(
        plan(
            spark,
            (store / "Tables/dbo/trips", out / "trips"),
            (store / "Files/readme.txt", out / "files" / "readme.txt"),
            (store / "Files/nothing", out / "nothing"),
            (store / "Files/absent", out / "absent"),
        )
    )
    got = {os.path.basename(r["dst_path"]): (r["status"], r["files"], r["bytes"]) for r in audit.collect()}
    assert got == {
        "trips": ("copied", 3, 7), "readme.txt": ("copied", 1, 5), "nothing": ("copied", 0, 0), "absent": ("missing", 0, 0),
    }
    assert tree(out / "trips") == tree(store / "Tables/dbo/trips")
    assert (out / "files/readme.txt").read_text() == "hello"
    assert os.path.isdir(out / "nothing") and not os.path.exists(out / "absent")
    assert not [d for d, _, _ in os.walk(out) if INCOMING in d]
    assert audit.filter("elapsed_seconds < 0 OR start_text IS NULL").isEmpty()


def test_reading_the_audit_copies_nothing(spark, store, tmp_path):
    out = tmp_path / "once"
    audit = copy_objects(plan(spark, (store / "Tables/sales/orders", out)))
    first = os.stat(out / "part-0.parquet").st_mtime_ns
    assert audit.count() == audit.filter("status = 'copied'").count() == 1
    assert os.stat(out / "part-0.parquet").st_mtime_ns == first


def test_a_failed_file_leaves_the_old_target(spark, store, tmp_path):
    out = tmp_path / "kept"
    put(out, "old.parquet", "old")
    bad = store / "Tables/dbo/trips/part-9.parquet"
    os.symlink("/proc/self/mem", bad)
    audit = copy_objects(plan(spark, (store / "Tables/dbo/trips", out))).first()
    assert audit["status"] == "failed" and audit["error"]
    assert tree(out) == {"old.parquet": "old"} and not os.path.exists(str(out) + INCOMING)


def test_two_sources_of_one_target(spark, store, tmp_path):
    out = tmp_path / "both"
    audit = copy_objects(plan(spark, (store / "Tables/sales/orders", out), (store / "Tables/dbo/trips", out))).collect()
    got = {os.path.basename(r["src_path"]): r["status"] for r in audit}
    assert got == {"trips": "copied", "orders": "collision"}
    assert tree(out) == tree(store / "Tables/dbo/trips")


def test_a_source_that_cannot_be_listed(spark, store, tmp_path):
    audit = copy_objects(
        plan(spark, ("nowhere://w/s/Tables/t", tmp_path / "t"), (store / "Tables/sales/orders", tmp_path / "o"))
    )
    got = {os.path.basename(r["src_path"]): (r["status"], r["error"] is None) for r in audit.collect()}
    assert got == {"orders": ("copied", True), "t": ("failed", False)}
    assert not (tmp_path / "t").exists()


def test_recover_data(spark, store, tmp_path):
    plain = tmp_path / "w1" / "s2"
    put(plain, "Tables/flat/part-0", "f")
    put(plain, "Files/doc.txt", "d")
    kept = spark.createDataFrame(
        [("s1", str(store), '{"defaultSchema":"dbo"}'), ("s2", str(plain), "{}"), ("s3", str(tmp_path / "w1/s3"), "{}")],
        "item_id STRING, base_path STRING, properties STRING",
    )
    assert store_objects(kept).count() == 7
    names = "primary_id primary_ws_id primary_ws_name primary_name secondary_id secondary_ws_id secondary_ws_name secondary_name primary_type"
    recovery = spark.createDataFrame(
        [("s1", "w1", "W", "S", "t1", "w2", "W_DR", "S", "Lakehouse"), ("s2", "w1", "W", "T", "t2", "w2", "W_DR", "T", "Lakehouse")],
        names.split(),
    )
    more = recovery.unionByName(recovery.limit(1).withColumn("primary_id", F.lit("gone"))).unionByName(
        recovery.limit(1).withColumn("primary_id", F.lit("s3"))).unionByName(recovery.limit(1).withColumn("primary_id", F.lit("s4")))
    kept = kept.unionByName(kept.limit(1).selectExpr("'s4' AS item_id", "'nowhere://h/x' AS base_path", "properties"))
    audit = recover_data(kept, more, scheme=f"{tmp_path}/").collect()
    assert {(r["item_id"], r["status"]) for r in audit} == {(None, "copied"), ("gone", "no_store"), ("s3", "empty"), ("s4", "unlisted")}
    assert len(audit) == 7 + 3
    assert tree(tmp_path / "w2/t1") == tree(store)
    assert tree(tmp_path / "w2/t2") == tree(plain)


def test_a_copied_table_reads_the_same(spark, tmp_path, rows):
    src, dst = tmp_path / "src", tmp_path / "dst"
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    df.write.partitionBy("g").parquet(str(src))
    copy_objects(plan(spark, (src, dst)))
    digest = F.sum(F.xxhash64("id", "g").cast("decimal(38,0)"))
    a, b = (spark.read.parquet(str(p)).agg(F.count("*"), digest).first() for p in (src, dst))
    assert a == b and a[0] == 1000


def test_names_that_a_uri_would_read_otherwise(spark, store, tmp_path):
    for name in ("a#1", "b 2", "c%41", "d?x=1", "é"):
        put(store, f"Files/odd/{name}/part", name)
    put(store, "Files/odd/a/part", "another file")
    for k, (base, out) in enumerate(((f"file://{store}", f"file://{tmp_path}/u#ri"), (str(store), str(tmp_path / "pl%20ain")))):
        audit = copy_objects(plan(spark, (f"{base}/Files/odd/", f"{out}/"))).first()
        assert (audit["status"], audit["files"]) == ("copied", 6)
        assert tree(tmp_path / ("u#ri", "pl%20ain")[k]) == tree(store / "Files/odd")


def test_a_slash_at_the_end_is_the_same_target(spark, store, tmp_path):
    out = tmp_path / "dst" / "t"
    put(out, "part-0.parquet", "stale and longer")
    audit = copy_objects(plan(spark, (f"{store}/Tables/dbo/trips/", f"{out}/"), (store / "Tables/dbo/trips", out))).collect()
    assert [r["status"] for r in audit] == ["copied"]
    assert tree(tmp_path / "dst") == {f"t/{k}": v for k, v in tree(store / "Tables/dbo/trips").items()}


def test_left_overs_of_other_runs_stay_out(spark, store, tmp_path):
    out = tmp_path / "t"
    put(tmp_path, "t" + INCOMING + "/old.parquet", "left over")
    put(tmp_path, "t" + INCOMING + "/part-0.parquet.7.partial", "half")
    assert copy_objects(plan(spark, (store / "Tables/sales/orders", out))).first()["status"] == "copied"
    assert tree(out) == {"part-0.parquet": "dd"}


class Row:
    def __init__(self, **fields):
        self.__dict__ |= fields


def test_copy_by_inventory(spark, store, tmp_path):
    src = store / "Tables/dbo/trips"
    files = spark.createDataFrame([(str(src), f"{src}/{k}", len(v)) for k, v in tree(src).items()], "src_path STRING, path STRING, size LONG")
    audit = copy_objects(plan(spark, (src, tmp_path / "t")), inventory=files, bytes_each=2).first()
    assert (audit["status"], audit["files"], audit["bytes"]) == ("copied", 3, 7) and tree(tmp_path / "t") == tree(src)


def test_a_session_without_a_shared_folder_is_an_error(spark):
    from rehome.lineage import cut

    class Named:
        def get(self, key, default):
            return default

    class Context:
        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext, conf = Context(), Named()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut(Frame)


def test_a_second_run_copies_only_what_changed(spark, store, tmp_path, rows):
    src, out = store / "Tables/dbo/trips", tmp_path / "t"
    first = copy_objects(plan(spark, (src, out)), changes_only=True).first()
    assert (first["status"], first["copied_files"], first["copied_bytes"]) == ("copied", 3, 7)
    again = copy_objects(plan(spark, (src, out)), changes_only=True).first()
    assert (again["status"], again["files"], again["copied_files"], again["digest"]) == ("unchanged", 3, 0, first["digest"])
    names = sorted(tree(src))
    put(out, names[0], "#" * len(tree(src)[names[0]]))  # another content of the same size
    put(out, "x/stale.parquet", "no more there")
    (out / names[1]).unlink()
    kept = os.stat(out / names[2]).st_ino
    mended = copy_objects(plan(spark, (src, out)), changes_only=True).first()
    assert (mended["status"], mended["files"], mended["copied_files"], mended["digest"]) == ("copied", 3, 2, first["digest"])
    assert tree(out) == tree(src) and os.stat(out / names[2]).st_ino == kept
    assert sorted(os.listdir(tmp_path)) == ["t", store.relative_to(tmp_path).parts[0]]


def test_an_object_that_lost_all_its_files(spark, store, tmp_path):
    src, out = store / "Files/nothing", tmp_path / "t"
    put(out, "old", "old")
    assert copy_objects(plan(spark, (src, out)), changes_only=True).first()["status"] == "copied"
    assert tree(out) == {} and out.is_dir()


def test_verify_finds_a_flipped_byte(spark, store, tmp_path, rows):
    src, out = store / "Tables/dbo/trips", tmp_path / "t"
    copy_objects(plan(spark, (src, out))).collect()
    columns = ["files", "same", "differing", "missing", "extra", "status"]
    assert rows(verify_objects(plan(spark, (src, out))), *columns) == [(3, 3, 0, 0, 0, "equal")]
    name = sorted(tree(out))[0]
    put(out, name, "#" * len(tree(out)[name]))
    put(out, "more", "1")
    assert rows(verify_objects(plan(spark, (src, out))), *columns) == [(3, 2, 1, 0, 1, "different")]
    assert rows(verify_objects(plan(spark, (src, tmp_path / "none"))), *columns) == [(3, 0, 0, 3, 0, "different")]


def test_a_target_that_does_not_keep_what_it_is_sent_is_failed(tmp_path, monkeypatch):
    from pyarrow import fs

    from rehome.sinks import copy as module

    local = fs.LocalFileSystem()

    class Store:
        def __getattr__(self, name):
            return getattr(local, name)

        def open_input_stream(self, path):
            import io

            data = open(path, "rb").read()
            return io.BytesIO(b"X" + data[1:] if ".partial" in path else data)

    monkeypatch.setattr(module, "open_path", lambda path: (Store(), path))
    put(tmp_path, "a", "content")
    with pytest.raises(OSError, match="does not hold"):
        module._stream(str(tmp_path / "a"), str(tmp_path / "t__in/a"), str(tmp_path / "t__in.partial"))


def test_short_reads_make_the_same_digest(monkeypatch):
    import io

    from rehome.sinks import copy as module

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 3))

    monkeypatch.setattr(module, "CHUNK", 8)
    assert list(module._chunks(Slow(b"0123456789abcdefXYZ"))) == [b"01234567", b"89abcdef", b"XYZ"]
