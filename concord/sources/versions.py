"""Several tables that change together: versioned directories and one small pointer, written last.

A commit writes every member into a directory of its own and then a numbered record of the whole version: for each member its path, number of files and digest. Readers take the
last complete record, so they see all members of one version or all of another, whatever was cut off in between. Nothing is renamed, so it holds on object
stores too; a record that exists is never overwritten, so of two commits that end at the same time one fails and can be tried again. A record that was cut off lacks its own digest
and counts for nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import file_digests

RECORDS = "_commits"


class CommitError(RuntimeError):
    """Another commit came first, a member is not what its record says, or there is no version."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/{RECORDS}")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _record(spark: SparkSession, root: str, number: int) -> dict | None:
    """A record's members, or None if it is incomplete."""
    fs, at = _fs(spark, f"{root}/{RECORDS}/{number:012d}.json")
    stream = fs.open(at)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()
    body, _, digest = text.rstrip("\n").rpartition("\n")
    if not body or hashlib.sha256(body.encode()).hexdigest() != digest:
        return None
    return json.loads(body)


def digest_of(spark: SparkSession, path: str) -> tuple[str, int]:
    """The digest of a directory's data files (of their own digests, in order of names, which are hashed where they are read) and their number."""
    files = file_digests(spark, path).where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
    one = files.select(F.sha2(F.concat_ws("  ", "digest", "path"), 256).alias("h"))
    # an order-free sum of each file's digest, in four words that can't overflow: any number of files
    word = lambda i: F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    row = one.agg(F.count(F.lit(1)).alias("n"), *(word(i).alias(f"w{i}") for i in range(8))).first()
    return hashlib.sha256(",".join(str(row[f"w{i}"] or 0) for i in range(8)).encode()).hexdigest(), row["n"]


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the complete versions, oldest first."""
    return [n for n in _numbers(spark, root) if _record(spark, root, n) is not None]


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The number and the members of the last complete version."""
    for number in reversed(_numbers(spark, root)):
        if (found := _record(spark, root, number)) is not None:
            return number, found
    raise CommitError(f"{root} has no complete version")


def commit(spark: SparkSession, root: str, members: Mapping[str, DataFrame], expected: int | None = None, write: Callable[[DataFrame, str], None] | None = None) -> int:
    """Write all members as the next version and return its number; a failure leaves readers where they were.

    expected: the version that the members were made from; the commit fails if another has come since. Members of the version before that are not named are carried over, not written again."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    last = numbers[-1] if numbers else 0
    try:
        at, before = current(spark, root)
    except CommitError:
        at, before = 0, {}
    if expected is not None and expected != at:
        raise CommitError(f"version {at} has come since {expected}")
    folder = f"{root}/version-{last + 1:012d}-{uuid.uuid4().hex[:12]}"
    record = dict(before)
    for name, df in members.items():
        path = f"{folder}/{name}"
        (write or (lambda d, p: d.write.parquet(p)))(df, path)
        digest, files = digest_of(spark, path)
        record[name] = {"path": path.removeprefix(root + "/"), "digest": digest, "files": files}
    body = json.dumps(record, sort_keys=True)
    fs, path = _fs(spark, f"{root}/{RECORDS}/{last + 1:012d}.json")
    try:
        out = fs.create(path, False)  # never over another's
    except Exception as e:
        raise CommitError(f"version {last + 1} was committed meanwhile") from e
    try:
        out.write(bytearray((body + "\n" + hashlib.sha256(body.encode()).hexdigest() + "\n").encode()))
    finally:
        out.close()
    return last + 1


def read(spark: SparkSession, root: str, name: str, version: int | None = None, verify: bool = False) -> DataFrame:
    """A member of the last complete version, or of a given one; verify: its files must have the digest of the record."""
    root = root.rstrip("/")
    found = current(spark, root)[1] if version is None else _record(spark, root, version) if version in _numbers(spark, root) else None
    if found is None or name not in found:
        raise CommitError(f"{root}: no {name} in version {version}")
    path = f"{root}/{found[name]['path']}"
    if verify and digest_of(spark, path) != (found[name]["digest"], found[name]["files"]):
        raise CommitError(f"{path} is not what was committed")
    return spark.read.parquet(path)
