"""Merkle trees, versions of several tables, verified files."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from concord.operators import merkle
from concord.schemas import struct
from concord.sources import verified, versions

SCHEMA = "k string, v string, g int"


# --- Merkle trees
def tree(spark, rows, by=("g",), depth=2):
    return merkle.build(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", ["v"], list(by), depth)


def test_a_changed_row_is_located(spark):
    rows = [(f"k{i}", f"v{i % 7}", i % 2) for i in range(600)]
    a = tree(spark, rows)
    changed = [(k, "other" if k == "k123" else v, g) for k, v, g in rows]
    b = tree(spark, changed)
    assert sorted(map(tuple, merkle.differences(a, b).collect())) == [(1, "k123", "a", 1), (1, "k123", "b", 1)]
    ranges = merkle.differing_ranges(a, b)
    assert [r.count() for r in ranges] == [1, 2, 2]  # one root, and the old and the new row's nodes
    roots = lambda t: {r["g"]: r["sha256"] for r in t.roots().collect()}
    assert roots(a)[0] == roots(b)[0] and roots(a)[1] != roots(b)[1]
    assert roots(tree(spark, rows[::-1])) == roots(a)
    assert merkle.differences(a, tree(spark, rows[::-1])).collect() == []


def test_copies_nulls_and_one_key(spark):
    rows = [("hot", f"v{i}", None) for i in range(300)] + [(None, None, 1), (None, "", 1), ("x", "1", 1), ("x", "1", 1)]
    a = tree(spark, rows, depth=1)
    assert {r["g"]: r["n_rows"] for r in a.roots().collect()} == {None: 300, 1: 4}
    b = tree(spark, [r for r in rows if r != ("hot", "v17", None)] + [("x", "1", 1)], depth=1)
    assert sorted(map(tuple, merkle.differences(a, b).collect()), key=str) == [(1, "x", "b", 1), (None, "hot", "a", 1)]
    c = tree(spark, [(None, "", 1) if r == (None, None, 1) else r for r in rows], depth=1)
    assert sorted(map(tuple, merkle.differences(a, c).collect()), key=str) == [(1, None, "a", 1), (1, None, "b", 1)]
    lacking = tree(spark, [r for r in rows if r[2] is not None], depth=1)
    assert merkle.differences(a, lacking).agg(F.sum("n")).first()[0] == 300
    with pytest.raises(ValueError, match="depths"):
        merkle.differences(a, tree(spark, rows, depth=2))


def test_row_digests_keep_columns_apart(spark):
    df = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), ("1:a", ""), ("", "1:a"), (None, "-"), ("-", None)], "k string, v string")
    assert df.select(merkle.row_digest(["k", "v"]).alias("d")).distinct().count() == 6
    assert merkle.depth_for(0) == merkle.depth_for(16) == 0 and merkle.depth_for(17) == 1 and merkle.depth_for(10**9) == 7
    assert merkle.build(spark.createDataFrame([], "k string, v string"), "k", ["v"]).roots().collect() == []


# --- versions
def members(spark, n):
    return {"a": spark.range(n), "b": spark.range(2 * n), "c": spark.range(3 * n)}


def seen(spark, root):
    return tuple(versions.read(spark, root, x).count() for x in "abc")


def test_readers_see_whole_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(versions.CommitError, match="no complete version"):
        versions.current(spark, root)
    assert versions.commit(spark, root, members(spark, 1)) == 1

    def cut_off(df, path):
        assert seen(spark, root) == (1, 2, 3)
        if path.endswith("/c"):
            raise OSError("cut off")
        df.write.parquet(path)

    with pytest.raises(OSError, match="cut off"):
        versions.commit(spark, root, members(spark, 5), write=cut_off)
    assert seen(spark, root) == (1, 2, 3) and versions.versions(spark, root) == [1]
    assert versions.commit(spark, root, {"b": spark.range(7)}, expected=1) == 2  # the others are carried over
    assert seen(spark, root) == (1, 7, 3)
    assert versions.read(spark, root, "b", version=1, verify=True).count() == 2
    with pytest.raises(versions.CommitError, match="has come"):
        versions.commit(spark, root, {"b": spark.range(8)}, expected=1)
    with pytest.raises(versions.CommitError, match="no x"):
        versions.read(spark, root, "x")


def test_a_record_that_was_cut_off_counts_for_nothing(spark, tmp_path):
    root = tmp_path / "t"
    versions.commit(spark, str(root), members(spark, 1))
    versions.commit(spark, str(root), members(spark, 2))
    record = root / versions.RECORDS / "000000000002.json"
    text = record.read_text()
    for cut in (0, 10, len(text) - 5):
        record.write_text(text[:cut])
        (root / versions.RECORDS / f".{record.name}.crc").unlink(missing_ok=True)
        assert seen(spark, str(root)) == (1, 2, 3)
    assert versions.commit(spark, str(root), members(spark, 4)) == 3  # a number is used once
    assert seen(spark, str(root)) == (4, 8, 12) and versions.versions(spark, str(root)) == [1, 3]


def test_of_two_commits_one_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.commit(spark, root, members(spark, 1))

    def meanwhile(df, path):
        if path.endswith("/a"):
            versions.commit(spark, root, {"a": spark.range(9)})
        df.write.parquet(path)

    with pytest.raises(versions.CommitError, match="meanwhile"):
        versions.commit(spark, root, members(spark, 3), write=meanwhile)
    assert seen(spark, root) == (9, 2, 3)


def test_a_changed_member_is_found(spark, tmp_path):
    root = tmp_path / "t"
    versions.commit(spark, str(root), members(spark, 1))
    folder = next(root.glob("version-*/c"))
    spark.range(99).coalesce(1).write.mode("append").parquet(str(folder))
    with pytest.raises(versions.CommitError, match="not what was committed"):
        versions.read(spark, str(root), "c", verify=True)
    assert versions.read(spark, str(root), "b", verify=True).count() == 2


# --- verified files
FILE_SCHEMA = struct("id string, n int")


def files(tmp_path):
    root = tmp_path / "f"
    (root / "sub").mkdir(parents=True)
    data = {"b.csv": b'id,n\nx,1\n"two\nlines",2\n', "sub/a.csv": b"id,n\ny,\n,4\n", "c.csv.gz": gzip.compress(b"id,n\nz,5\n", mtime=0)}
    for name, content in data.items():
        (root / name).write_bytes(content)
    return root, {name: hashlib.sha256(content).hexdigest() for name, content in data.items()}


def manifest(spark, tmp_path, lines):
    (tmp_path / "m.sha256").write_text("".join(f"{d}  {p}\n" for p, d in lines))
    return verified.listed(spark, str(tmp_path / "m.sha256"))


def test_verified_rows_in_the_manifests_order(spark, tmp_path):
    root, digests = files(tmp_path)
    m = manifest(spark, tmp_path, digests.items())
    got = sorted((r["_src"], r["_pos"], r["id"], r["n"]) for r in verified.read_csv(spark, m, str(root), FILE_SCHEMA).collect())
    assert got == [(0, 0, "x", 1), (0, 1, "two\nlines", 2), (1, 0, "y", None), (1, 1, None, 4), (2, 0, "z", 5)]
    assert verified.verified(spark, m, str(root)).collect() == []


@pytest.mark.parametrize(("change", "reason"), [("altered", "digest differs"), ("missing", "missing"), ("extra", "not listed"), ("header", "columns")])
def test_files_that_differ_fail(spark, tmp_path, change, reason):
    root, digests = files(tmp_path)
    if change == "altered":
        (root / "b.csv").write_bytes(b"id,n\nx,9\n")
    elif change == "missing":
        (root / "b.csv").unlink()
    elif change == "extra":
        (root / "new.csv").write_bytes(b"id,n\nq,1\n")
    else:
        (root / "b.csv").write_bytes(b"n,id\n1,x\n")
        digests["b.csv"] = hashlib.sha256(b"n,id\n1,x\n").hexdigest()
    m = manifest(spark, tmp_path, digests.items())
    with pytest.raises(Exception, match=reason):
        verified.read_csv(spark, m, str(root), FILE_SCHEMA).collect()
    if change != "header":
        assert [r["reason"] for r in verified.verified(spark, m, str(root)).collect()] == [reason]
