"""Source trees as a Spark data source: ``spark.read.format("source_tree")``.

A tree's partitions are the directories below its root and the root's own files; tasks walk their directory themselves and
never open an ignored one. A remote repository is one partition: the task clones it, reads it and removes the clone."""

from __future__ import annotations

import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions import text as T

#: Seconds that a clone may take.
CLONE_TIMEOUT_S = 120
_IGNORED = re.compile("|".join(p.replace(r"\z", r"\Z") for p in T.IGNORED_FILES))


class TooLarge(ValueError):
    """Code 1001: a tree over the size limit."""


def wanted(name: str) -> bool:
    """Whether a file's name passes the extension and name rules, as :func:`quarry.functions.text.wanted_file` has them."""
    dot = name.rfind(".")
    return dot >= 0 and name[dot:].lower() in T.EXTENSIONS and not _IGNORED.search(name)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the place in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def entries(system: fs.FileSystem, place: str) -> list[fs.FileInfo]:
    return sorted(system.get_file_info(fs.FileSelector(place)), key=lambda x: x.path)


def walk(system: fs.FileSystem, place: str, prune: bool = True) -> Iterator[fs.FileInfo]:
    """Files below a directory; with ``prune`` ignored directories are not listed."""
    left = [place]
    while left:
        for x in entries(system, left.pop()):
            if x.type == fs.FileType.Directory:
                if not prune or x.base_name not in T.IGNORED_DIRECTORIES:
                    left.append(x.path)
            elif x.type == fs.FileType.File:
                yield x


@dataclass
class Part(InputPartition):
    """A directory to be walked, files, or a repository to be cloned."""

    kind: str
    places: list[str]


class SourceTree(DataSource):
    """``(path, length, content)`` of the files below a root: paths are relative, contents UTF-8 with malformed bytes replaced.

    Options: ``path``, a directory or, with ``git``, a repository's address; ``prune`` (default true): leave out ignored
    directories, other extensions and ignored names; ``content`` (default true): read contents; ``limit_bytes``: a
    cloned tree that is larger is an error."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length long, content string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        on = lambda key, default: options.get(key, default).lower() == "true"
        self.root, self.git, self.prune, self.content = options["path"].rstrip("/") or "/", on("git", "false"), on("prune", "true"), on("content", "true")
        self.limit = int(options.get("limit_bytes") or 0)

    def partitions(self) -> list[Part]:
        if self.git:
            return [Part("clone", [self.root])]
        system, place = opened(self.root)
        top = entries(system, place)  # the root alone is listed here
        own = [x.path for x in top if x.type == fs.FileType.File]
        dirs = [x for x in top if x.type == fs.FileType.Directory and not (self.prune and x.base_name in T.IGNORED_DIRECTORIES)]
        return [Part("files", own), *(Part("walk", [d.path]) for d in dirs)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.kind == "clone":
            yield from self._cloned(part.places[0])
            return
        system, root = opened(self.root)
        found = system.get_file_info(part.places) if part.kind == "files" else walk(system, part.places[0], self.prune)
        yield from self._rows(system, root, found)

    def _rows(self, system: fs.FileSystem, root: str, found) -> Iterator[tuple]:
        for x in found:
            if self.prune and not wanted(x.base_name):
                continue
            text = None
            if self.content:
                with system.open_input_stream(x.path) as stream:
                    text = stream.read().decode("utf-8", "replace")
            yield x.path[len(root.rstrip("/")) + 1 :], x.size, text

    def _cloned(self, url: str) -> Iterator[tuple]:
        place = tempfile.mkdtemp(prefix="clone-")  # this task's own, for as long as it reads
        try:
            subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--", url, place], check=True, capture_output=True, timeout=CLONE_TIMEOUT_S)
            system = fs.LocalFileSystem()
            if self.limit and sum(x.size for x in walk(system, place, prune=False)) > self.limit:
                raise TooLarge(f"1001: more than {self.limit} bytes")
            yield from self._rows(system, place, walk(system, place, self.prune))
        finally:
            shutil.rmtree(place, ignore_errors=True)
