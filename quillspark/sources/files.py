"""Files that Python tasks read and write themselves: where they lie, and how a write is committed.

Paths are URIs that pyarrow opens (file, hdfs, s3, gs) or absolute ones; they must name a place that
the driver and all executors share.
"""

from __future__ import annotations

import fnmatch
import uuid
from dataclasses import dataclass

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def listed(path: str, pattern: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of the one file, by name."""
    where, at = opened(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = where.get_file_info(fs.FileSelector(at, recursive=recursive))
    # What is being written stands in folders that begin with an underscore.
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(at) :].strip("/").split("/"))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern) and not hidden(x.path))


@dataclass
class Commit:
    """A write in two steps: tasks write into a folder of the job's own, and the driver moves what the
    tasks that ended well have written, or deletes the folder. A task that is repeated or fails leaves nothing."""

    path: str
    overwrite: bool = False

    def __post_init__(self) -> None:
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, name: str, parts, task: str) -> str:
        """Writes bytes under the job's folder; gives the place relative to it."""
        if "/" in name or name in ("", ".", ".."):
            raise ValueError(f"{name!r} cannot be a file's name")
        where, at = opened(self.path)
        where.create_dir(f"{at}/{self.job}/{task}", recursive=True)
        with where.open_output_stream(f"{at}/{self.job}/{task}/{name}") as out:
            for part in parts:
                out.write(part)
        return f"{task}/{name}"

    def commit(self, written: list[str]) -> None:
        where, at = opened(self.path)
        names = [w.rpartition("/")[2] for w in written]
        if len(set(names)) < len(names):
            self.abort()
            raise ValueError("two rows are of one file")
        where.create_dir(at, recursive=True)
        if self.overwrite:
            for p, _ in listed(self.path, "*"):
                where.delete_file(p)
        for w, name in zip(written, names):
            where.move(f"{at}/{self.job}/{w}", f"{at}/{name}")
        self.abort()

    def abort(self) -> None:
        where, at = opened(self.path)
        if where.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{at}/{self.job}")
