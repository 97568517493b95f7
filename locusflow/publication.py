"""Builds that stand beside what is registered until one file, the record, is replaced: what is registered is always whole.

A registration is a folder with ``registration.json`` and the folders of its parts, each below a
``build-...`` of the run that made it. A build writes its parts first and its record last, by a
rename over the old one; only then are the parts of earlier builds swept. A build that dies leaves
the registration as it was, and a folder that the next one sweeps.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, errors
from .sources import catalog

#: Folders whose children have records of their own.
OWN_RECORDS = ("gtf", "index")
BUILDING = "building.json"
_KEYS = {f.name for f in catalog.RECORD.fields} - {"_corrupt_record"}


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.mkdirs(place)


def children(spark: SparkSession, path: str) -> dict[str, int]:
    """Names below a folder, sorted, with the time each was last changed; hidden ones are left out."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return {}
    found = {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(place)}
    return {n: found[n] for n in sorted(found) if not n.startswith((".", "_"))}


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _at(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside ``path`` and renames it there, over what there may be."""
    folder, _, name = path.rpartition("/")
    system, temporary = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(temporary, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(temporary), system.makeQualified(target), how)


def files(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes of all files below a folder by their path in it, hidden ones left out; listed by the driver, good for some 100,000."""
    system, place = _at(spark, path)
    if not system.exists(place):
        return {}
    base, found, each = system.makeQualified(place).toString(), {}, system.listFiles(place, True)
    while each.hasNext():
        status = each.next()
        found[status.getPath().toString()[len(base) + 1 :]] = status.getLen()
    return {f: found[f] for f in sorted(found) if not any(p.startswith((".", "_")) for p in f.split("/"))}


# --- records ---
def read_record(spark: SparkSession, path: str) -> dict | None:
    """A folder's record with its details; one that is absent, no JSON, or has other keys than a record's, is none."""
    at = f"{path}/{catalog.RECORD_NAME}"
    if not exists(spark, at):
        return None
    try:
        found = json.loads(read_text(spark, at))
        if not isinstance(found, dict) or set(found) != _KEYS or not isinstance(found["files"], dict) or not found["kind"] or not found["name"]:
            return None
        return found | {"details": json.loads(found["details"] or "{}")}
    except (ValueError, TypeError):
        return None
    except Py4JJavaError as wrong:
        if "ChecksumException" in str(wrong.java_exception.getClass()):  # the file isn't as it was written
            return None
        raise


def write_record(spark: SparkSession, path: str, kind: str, name: str, source_url: str | None = None, sha256: str | None = None, details: dict | None = None, tools: dict | None = None, parts: Iterable[str] | None = None) -> dict:
    """Writes a record of the files below ``path``, or below its ``parts`` alone; the last step of a build."""
    there = files(spark, path)
    mine = {f: n for f, n in there.items() if f.partition("/")[0] not in OWN_RECORDS and f not in (catalog.RECORD_NAME, BUILDING)}
    claimed = mine if parts is None else {f: n for f, n in mine.items() if f.startswith(tuple(f"{p}/" for p in parts))}
    record = {
        "kind": kind, "name": name, "files": claimed, "source_url": source_url, "sha256": sha256, "tool_versions": {"spark": spark.version} | (tools or {}), "package_version": __version__,
        "completed_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "details": json.dumps(details or {}),
    }
    replace_text(spark, f"{path}/{catalog.RECORD_NAME}", json.dumps(record))
    return record | {"details": details or {}}


def check_registration(spark: SparkSession, path: str, repair: str) -> dict | None:
    """The record of a finished build, None where nothing is; raises on leftovers and on files that disagree."""
    record = read_record(spark, path)
    if record is None:
        left = [c for c in children(spark, path) if c not in OWN_RECORDS]
        if left:
            raise errors.UnfinishedRegistrationError(f"{path} holds {', '.join(left[:5])} but no record; register it again with `{repair}`")
        return None
    there = files(spark, path)
    wrong = sorted(f for f, n in record["files"].items() if there.get(f) != n)
    if wrong:
        raise errors.RegistrationMismatchError(f"{path} disagrees with its record in {', '.join(wrong[:5])}; register it again with `{repair}`")
    return record


def part(record: dict, path: str, name: str) -> str:
    """Where a part of a registration is."""
    return f"{path}/{record['details']['parts'][name]['folder']}"


def _digests(spark: SparkSession, folders: dict[str, str]) -> dict[str, str]:
    """A digest of each folder's files, their names and bytes; the bytes are read where Spark deals them to."""
    here = {n: p for n, p in folders.items() if files(spark, p)}
    if not here:
        return {}
    found: dict[str, list[str]] = {n: [] for n in here}
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(list(here.values())).select("path", F.sha2("content", 256).alias("digest")).collect()
    for row in rows:
        name = next(n for n, p in here.items() if f"/build-{p.rpartition('build-')[2]}/" in row.path)
        found[name].append(f"{row.path.rpartition('/')[2]}:{row.digest}")
    return {n: hashlib.sha256("\n".join(sorted(of)).encode()).hexdigest() for n, of in found.items()}


def intact(spark: SparkSession, path: str, record: dict | None) -> dict[str, dict]:
    """The parts of a registration that are to the byte as its record has them, whatever else is missing."""
    parts = ((record or {}).get("details") or {}).get("parts") or {}
    now = _digests(spark, {n: f"{path}/{p['folder']}" for n, p in parts.items()})
    return {n: p for n, p in parts.items() if p.get("sha256") and now.get(n) == p["sha256"]}


class Build:
    """One run's build of a registration: parts made anew, parts kept, and the record that makes them one."""

    def __init__(self, spark: SparkSession, path: str, kept: dict[str, dict] | None = None) -> None:
        self.spark, self.path, self.kept, self.made = spark, path, dict(kept or {}), {}
        self.folder = f"build-{uuid.uuid4().hex[:12]}"

    def __contains__(self, name: str) -> bool:
        return name in self.kept

    def part(self, name: str) -> str:
        """Where a part is that is kept, or is to be written."""
        if name not in self.kept:
            self.made[name] = {"folder": f"{self.folder}/{name}"}
        return f"{self.path}/{(self.kept.get(name) or self.made[name])['folder']}"

    def publish(self, kind: str, name: str, source_url: str | None = None, sha256: str | None = None, details: dict | None = None) -> dict:
        """Writes the record, then sweeps what no part of it is in."""
        digests = _digests(self.spark, {n: f"{self.path}/{p['folder']}" for n, p in self.made.items()})
        parts = self.kept | {n: p | {"sha256": digests.get(n)} for n, p in self.made.items()}
        extra = {"parts": parts, "kept": sorted(self.kept)}
        record = write_record(self.spark, self.path, kind, name, source_url, sha256, (details or {}) | extra, parts=[p["folder"] for p in parts.values()])
        used = {p["folder"].partition("/")[0] for p in parts.values()}
        for old in children(self.spark, self.path):
            if old not in used and old not in OWN_RECORDS and old != catalog.RECORD_NAME:
                remove(self.spark, f"{self.path}/{old}")
        return record
