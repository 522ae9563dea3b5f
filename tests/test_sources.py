"""Data sources: pruning before listing, packing, odd files, and writes in two phases."""

import os

import pytest
from pyspark.sql import functions as F

from factlake.sources import store, tree, versions


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path, body in {"a/lib.rs": b"fn a() {}", "a/Cargo.toml": b"[package]", "a/target/x.rs": b"no", "a/src/deep/m.rs": "é".encode(), "b/bad.rs": b"\xff\xfe", "b/big.rs": b"x" * 5000, "b/empty.rs": b"", "top.rs": b"t"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(body)
    return top


@pytest.mark.parametrize("folders", (1, 2, 512))
def test_tree(spark, root, folders):
    """The same rows, whether the driver or the tasks list; a file that isn't text is a row with its error."""
    found = tree.tree(spark, str(root), "*.rs", ("target",), 5000, plannedFolders=folders, packedBytes=8)
    rows = {r.path: (r.name, r.length, r.content, r.error) for r in found.collect()}
    assert set(rows) == {"a/lib.rs", "a/src/deep/m.rs", "b/bad.rs", "b/empty.rs", "top.rs"} and rows["a/src/deep/m.rs"] == ("m.rs", 2, "é", None)
    assert rows["b/bad.rs"][2] is None and rows["b/bad.rs"][3].startswith("UnicodeDecodeError") and rows["b/empty.rs"][2:] == ("", None)


def test_pruned_folders_are_not_listed(root, monkeypatch):
    listed = []
    inner = tree.TreeReader._listed
    monkeypatch.setattr(tree.TreeReader, "_listed", lambda self, fs, base, folder: listed.append(folder) or inner(self, fs, base, folder))
    tree.TreeReader({"path": str(root), "pruned": "target,src"}).partitions()
    assert sorted(listed) == ["", "a", "b"]
    listed.clear()
    reader = tree.TreeReader({"path": str(root)})
    assert list(reader.pushFilters([tree.StringStartsWith(("path",), "a/src/"), tree.EqualTo(("name",), "m.rs"), tree.EqualTo(("length",), 2)])) == [tree.EqualTo(("length",), 2)]
    assert [p.files for p in reader.partitions()] == [[("a/src/deep/m.rs", 2)]] and sorted(listed) == ["", "a", "a/src", "a/src/deep"]


def test_packing(root):
    parts = tree.TreeReader({"path": str(root), "packedBytes": "100"}).partitions()
    assert max(sum(n for _, n in p.files) for p in parts if len(p.files) > 1) <= 100 and sum(len(p.files) for p in parts) == 8


def test_an_unreadable_folder_is_a_row(root):
    reader = tree.TreeReader({"path": str(root)})
    path, name, length, content, error = next(reader.read(tree.Folder("gone")))
    assert (path, name, length, content) == ("gone", "gone", None, None) and error


def test_conditions_reach_the_scan(spark, root):
    found = tree.tree(spark, str(root)).where("name = 'Cargo.toml'").select("path")
    assert [r.path for r in found.collect()] == ["a/Cargo.toml"]


def test_store_round_trip(spark, tmp_path):
    s = store.SparkStore(spark, f"{tmp_path}/s")
    rows = [("j/1", "a", "é"), ("j/1", "b", None), ("j2", None, ""), (None, "x", "y"), ("", "e", "z")]
    put = s.put(spark.createDataFrame(rows, "job string, key string, body string").repartition(3))
    assert sorted(map(tuple, put.collect()), key=repr) == sorted([("j/1", "a", 2), ("j/1", "b", None), ("j2", None, 0), (None, "x", 1), ("", "e", 1)], key=repr)
    s.put(spark.createDataFrame([("j2", "more", "m")], "job string, key string, body string"))
    assert sorted(map(tuple, s.read().collect()), key=repr) == sorted([*rows, ("j2", "more", "m")], key=repr)
    assert sorted(r.key or "" for r in s.read().where("job = 'j2'").collect()) == ["", "more"] and s.read().where(F.col("job").isin("j2", "")).count() == 3
    assert s.read().where("job is null").count() == 1
    reader = store.StoreReader({"path": f"{tmp_path}/s"})
    assert not list(reader.pushFilters([store.EqualTo(("job",), "j/1")])) and all("%2F;1" in p for part in reader.partitions() for p, _ in part.files)
    spark.createDataFrame([("n", "k", "b")], "job string, key string, body string").write.format("factlake_store").mode("overwrite").save(f"{tmp_path}/s")
    assert [tuple(r) for r in s.read().collect()] == [("n", "k", "b")]


def test_a_failed_task_leaves_no_rows(spark, tmp_path):
    s = store.SparkStore(spark, f"{tmp_path}/s")
    rows = spark.range(100).repartition(4).select(F.lit("j").alias("job"), F.col("id").cast("string").alias("key"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("b")).alias("body"))
    with pytest.raises(Exception, match="broken"):
        s.put(rows)
    assert s.read().count() == 0 and not any(files for _, _, files in os.walk(f"{tmp_path}/s"))


def test_versions(spark, tmp_path):
    t = versions.Versions(spark, f"{tmp_path}/t", ["k"])
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    got = lambda df: {(r.k, r.v) for r in df.collect()}
    assert t.put(rows((1, "a"), (2, "b"))) == 1 and t.put(rows((2, None), (3, "c"))) == 2
    t.delete(rows((1, "")))
    reader = t.read()  # planned before the compaction, read after it
    assert t.compact() == 4 and got(reader) == got(t.read()) == {(2, None), (3, "c")} and got(t.read(1)) == {(1, "a"), (2, "b")}
    assert len(t.folders(4)) == 1 and len(t.folders(3)) == 3
    with pytest.raises(versions.Conflict):
        t._commit(4, [])
    (tmp_path / "t/data/left").mkdir()
    assert len(t.vacuum()) == 4 and t.versions() == [4] and got(t.read()) == {(2, None), (3, "c")}
    t.put(rows((1, "again")))
    assert got(t.read()) == {(1, "again"), (2, None), (3, "c")}


def test_delete_takes_children(spark, tmp_path):
    p, c = versions.Versions(spark, f"{tmp_path}/p", ["job"]), versions.Versions(spark, f"{tmp_path}/c", ["id"])
    p.put(spark.createDataFrame([("a",), ("b",)], "job string"))
    c.put(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, job string"))
    versions.delete_cascade(spark.createDataFrame([("a",), ("gone",)], "job string"), p, (c, "job"))
    assert {r.job for r in p.read().collect()} == {"b"} and {r.id for r in c.read().collect()} == {2, 4}
