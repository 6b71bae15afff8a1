"""A streaming source that follows growing files through rotation and truncation, a range of bytes a task."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


MANY = 256  # tasks of a batch, before they grow
LARGE = 8 << 20


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", p).load()`` gives (value, path); ``path`` may be a JSON list of paths.

    Options: ``from_start`` reads what is there already; a batch takes ``max_bytes`` a file at most (but at least a line), a task
    ``task_bytes``; a batch of more than MANY tasks has larger ones, of up to LARGE bytes. An offset holds for each path a file's identity, a position after a line end, and the rotated files beside it that are done. Files that were
    rotated since then are found by identity, however many there are, and read in the order of their last change, the first from the position on; then
    the new file from its beginning. So is a file that has become shorter. Half a line waits for its end, but for the last of a rotated file. A rotated
    file that has left its folder, or was compressed, can't be read any more. After a restart Spark doesn't tell a source where it was, so the first batch takes all that is there; its
    tasks are as small as ever. The folder must be one that the executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string, path string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        path = self.options["path"]
        numbers = {k: int(self.options[k]) for k in ("max_bytes", "task_bytes") if k in self.options}
        return TailReader(json.loads(path) if path.startswith("[") else [path], self.options.get("from_start", "false").lower() == "true", **numbers)


class Piece(InputPartition):
    """Bytes of one file: the lines that begin in low (or at its start, if it ``first``) to high, of those that end by ``end``."""

    def __init__(self, path: str, ino: int, low: int, high: int, end: int, first: bool):
        self.path, self.ino, self.low, self.high, self.end, self.first = path, ino, low, high, end, first


def identity(path: str) -> tuple[int, int]:
    """Inode and size, zeros for a file that isn't there."""
    try:
        s = os.stat(path)
    except FileNotFoundError:
        return 0, 0
    return s.st_ino, s.st_size


def rotated(path: str) -> list[tuple[int, int, str]]:
    """(inode, size, path) of the files whose names go on after the path's, by their last change; of equal ones the greater number first."""
    folder, name = os.path.split(os.path.abspath(path))
    found = []
    if os.path.isdir(folder):
        with os.scandir(folder) as entries:
            for e in entries:
                tail = e.name.removeprefix(name)
                if e.name != tail and tail[:1] in (".", "-", "_") and not tail.endswith((".gz", ".bz2", ".xz", ".zst")) and e.is_file():
                    s = e.stat()
                    number = int(tail[1:]) if tail[1:].isdecimal() else 0
                    found.append((s.st_mtime_ns, -number, s.st_ino, s.st_size, e.path))
    return [x[2:] for x in sorted(found)]


def _line_end(path: str, low: int, high: int, step: int = 1 << 16) -> int:
    """The place after the last line feed in low to high, or low if there is none."""
    with open(path, "rb") as file:
        while high > low:
            start = max(low, high - step)
            file.seek(start)
            if (at := file.read(high - start).rfind(b"\n")) >= 0:
                return start + at + 1
            high = start
    return low


def _next_line_end(path: str, low: int, high: int, step: int = 1 << 16) -> int:
    """The place after the first line feed in low to high, or low if there is none."""
    with open(path, "rb") as file:
        file.seek(low)
        at = low
        while at < high and (data := file.read(min(step, high - at))):
            if (k := data.find(b"\n")) >= 0:
                return at + k + 1
            at += len(data)
    return low


class TailReader(DataSourceStreamReader):
    def __init__(self, paths: list[str], from_start: bool = False, max_bytes: int = 64 << 20, task_bytes: int = LARGE):
        self.paths, self.from_start, self.max_bytes, self.task_bytes = paths, from_start, max_bytes, task_bytes
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        files = {}
        for path in self.paths:
            ino, size = identity(path)
            files[path] = {"ino": ino, "pos": 0 if self.from_start else size, "done": [[i, s] for i, s, _ in rotated(path)]}
        self.last = {"files": files, "rotations": 0, "truncates": 0}
        return self.last

    def latestOffset(self) -> dict:
        before = self.last
        files, rotations, truncates = {}, (before or {}).get("rotations", 0), (before or {}).get("truncates", 0)
        for path in self.paths:
            if before and path in before["files"]:
                files[path], passed, cut = self._further(path, before["files"][path])
                rotations, truncates = rotations + passed, truncates + cut
            else:
                ino, size = identity(path)
                files[path] = {"ino": ino, "pos": _line_end(path, 0, size) if ino else 0, "done": [[i, s] for i, s, _ in rotated(path)]}
        self.last = {"files": files, "rotations": rotations, "truncates": truncates}
        return self.last

    def _further(self, path: str, at: dict) -> tuple[dict, int, int]:
        """The next position of a path, with the numbers of files passed and of truncations."""
        left, passed, ino, pos = self.max_bytes, 0, at["ino"], at["pos"]
        others = rotated(path)
        now, size = identity(path)
        there = {i for i, _, _ in others}
        done = [x for x in at["done"] if x[0] in there and x[0] != ino]
        known = {i for i, _ in done}
        if ino == now:  # what stands beside it is older, or a copy
            done = [[i, s] for i, s, _ in others]
        else:
            for i, s, name in [x for x in others if x[0] == ino] + [x for x in others if x[0] != ino and x[0] not in known and x[0] != now]:
                if i != ino:
                    ino, pos = i, 0
                if s - pos > left:
                    return self._cut(path, name, ino, pos, s, left, done), passed, 0
                left -= s - pos
                done.append([i, s])
                passed += 1
                ino, pos = 0, 0
            if not now:  # the new file isn't there yet
                return ({"ino": ino, "pos": pos, "done": done} if passed else at), passed, 0
            passed += bool(ino)  # the old file is gone
            ino, pos = now, 0
        cut = int(size < pos)
        pos = 0 if cut else pos
        if size - pos > left:
            return self._cut(path, path, ino, pos, size, left, done), passed, cut
        return {"ino": ino, "pos": _line_end(path, pos, size), "done": done}, passed, cut

    def _cut(self, path: str, name: str, ino: int, pos: int, size: int, left: int, done: list) -> dict:
        """A position of at most ``left`` bytes further; if no line ends there and nothing else was taken, at the end of one line."""
        end = _line_end(name, pos, pos + left)
        if end == pos and left == self.max_bytes:
            end = _next_line_end(name, pos, size)
            end = size if end == pos and name != path else end  # a rotated file's last line
        return {"ino": ino, "pos": end, "done": done}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.last = self.last or end
        ranges = [(path, *r) for path, to in end["files"].items() for r in self._ranges(start["files"].get(path, {"ino": 0, "pos": 0, "done": []}), to)]
        step = self._step(sum(high - low for _, _, low, high in ranges))
        pieces = []
        for path, ino, low, high in ranges:
            cuts = [*range(low, high, step), high]
            pieces += [Piece(path, ino, a, b, high, a == low) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pieces

    def _step(self, size: int) -> int:
        """Bytes a task: each task costs a start, a file and its commit, however little it reads."""
        return max(self.task_bytes, min(LARGE, -(-size // MANY)))

    def _ranges(self, at: dict, to: dict) -> list[tuple[int, int, int]]:
        if at["ino"] == to["ino"]:
            return [(to["ino"], at["pos"] if at["pos"] <= to["pos"] else 0, to["pos"])]  # else it was truncated
        known = {i for i, _ in at["done"]}
        passed = [(i, s) for i, s in to["done"] if i == at["ino"]] + [(i, s) for i, s in to["done"] if i != at["ino"] and i not in known]
        return [(i, at["pos"] if i == at["ino"] else 0, s) for i, s in passed] + [(to["ino"], 0, to["pos"])]

    def read(self, piece: Piece) -> Iterator[tuple]:
        names = [piece.path, *(p for i, _, p in rotated(piece.path) if i == piece.ino)]
        name = next((n for n in names if identity(n)[0] == piece.ino), None)
        if name is None:
            return
        with open(name, "rb") as file:
            at = piece.low
            if not piece.first:  # a line that begins before is another task's
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < piece.high and (line := file.readline(piece.end - at)):
                at += len(line)
                yield line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"), piece.path
