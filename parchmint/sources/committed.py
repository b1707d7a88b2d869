"""Folders that tasks write files into and one manifest commits.

Every attempt of a task writes under a name of its own, so attempts that run twice never
meet. The driver then writes one manifest, which names the files of the attempts that Spark
accepted; readers know only files that a manifest names. A write that fails or is
cancelled leaves no manifest, and what its tasks left is removed. Folders are named with
their file system, since a bare path would be each executor's own disk.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage


class Folder:
    """A folder of a file system that the driver and all executors reach."""

    def __init__(self, uri: str):
        if "://" not in uri and not uri.startswith("file:/"):
            raise ValueError(f"{uri!r} names no file system: write file:///..., hdfs://... or s3://...")
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri.removeprefix("file:")
        self.files, self.base = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))

    def path(self, name: str) -> str:
        return posixpath.join(self.base, name)

    def create(self, name: str):
        self.files.create_dir(posixpath.dirname(self.path(name)), recursive=True)
        return self.files.open_output_stream(self.path(name), compression=None)

    def open(self, name: str):
        return self.files.open_input_file(self.path(name))

    def names(self) -> list[str]:
        """Names of the files and folders that stand directly in the folder."""
        found = self.files.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return sorted(f.base_name for f in found)

    def move(self, name: str, to: str) -> None:
        self.files.move(self.path(name), self.path(to))

    def remove(self, name: str) -> None:
        kind = self.files.get_file_info(self.path(name)).type
        if kind == fs.FileType.Directory:
            self.files.delete_dir(self.path(name))
        elif kind == fs.FileType.File:
            self.files.delete_file(self.path(name))


def qualified(spark, path: str) -> str:
    """A path with its file system, the session's default one where it names none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its partition, its file or folder (None: nothing) and facts about it."""

    partition: int
    name: str | None
    facts: dict = field(default_factory=dict)


def new_job() -> str:
    return uuid.uuid4().hex[:12]


def own_name(job: str, suffix: str = "") -> str:
    """A name that no other attempt of any task has."""
    task = TaskContext.get()
    return f"part-{job}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


def commit(folder: Folder, job: str, written: list[Written], replace: bool) -> list[Written]:
    """Make the files of a write visible, in order of partition, and remove what other attempts of it left."""
    kept = sorted((w for w in written if w is not None and w.name), key=lambda w: w.partition)
    before = manifests(folder)
    number = 1 + max((int(name.split("-")[1]) for name in before), default=0)
    with folder.create(f"_manifest-{number:06d}-{job}.json") as out:
        out.write(json.dumps({"replaces": replace, "files": [{"name": w.name, **w.facts} for w in kept]}).encode())
    held = {w.name for w in kept}
    for name in folder.names():
        if name.startswith(f"part-{job}-") and name not in held:
            folder.remove(name)
    if replace:
        for name in before:
            for old in _read(folder, name)["files"]:
                folder.remove(old["name"])
            folder.remove(name)
    return kept


def abort(folder: Folder, job: str) -> None:
    for name in folder.names():
        if name.startswith(f"part-{job}-"):
            folder.remove(name)


def manifests(folder: Folder) -> list[str]:
    return [n for n in folder.names() if n.startswith("_manifest-") and n.endswith(".json")]


def _read(folder: Folder, name: str) -> dict:
    with folder.open(name) as f:
        return json.loads(f.read())


def committed(folder: Folder) -> list[dict]:
    """The files of all manifests since the last one that replaces, oldest write first."""
    found: list[dict] = []
    for name in manifests(folder):
        read = _read(folder, name)
        found = read["files"] if read["replaces"] else found + read["files"]
    return found
