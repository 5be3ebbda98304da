"""A streaming source of changes under a folder: ``spark.dataSource.register(TreeWatch)``, then ``format("tree_watch")``.

Each look at the folder that finds differences appends them to a log, whose length is the offset. A batch is the log between
two offsets, so it can be planned again after a restart; contents are read by tasks. Options: ``path``, a folder or a URI
that pyarrow's file systems open, ``log``, a folder that outlives the query, ``pattern`` and ``ignore`` for base names and
paths. Rows are (ts, path, op, content) with op ``add``, ``change`` or ``unlink``.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "ts timestamp, path string, op string, content string"
#: Files that one task reads at most.
FILES_A_TASK = 500
IGNORED = r"/(node_modules|dist|build|coverage|\.git)/"


class _Files(InputPartition):
    def __init__(self, rows: list[list]):
        self.rows = rows


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Log:
    """Numbered entries, each a list of [op, path, time in ns, size]; one that exists is whole."""

    def __init__(self, uri: str):
        self.fs, self.folder = _opened(uri)
        self.fs.create_dir(self.folder, recursive=True)

    def length(self) -> int:
        names = [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.folder)) if re.fullmatch(r"\d+\.json", f.base_name)]
        return len(names)

    def entry(self, k: int) -> list[list]:
        with self.fs.open_input_file(f"{self.folder}/{k}.json") as f:
            return json.loads(f.read())

    def append(self, k: int, rows: list[list]) -> None:
        with self.fs.open_output_stream(f"{self.folder}/{k}.part") as f:
            f.write(json.dumps(rows).encode())
        self.fs.move(f"{self.folder}/{k}.part", f"{self.folder}/{k}.json")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        for name in ("path", "log"):
            if not options.get(name):
                raise ValueError(f"tree_watch needs the option {name}")
        self.uri, self.log_uri = options["path"].rstrip("/"), options["log"].rstrip("/")
        self.pattern, self.ignore = options.get("pattern", "*.ts,*.tsx,*.js,*.jsx").split(","), options.get("ignore", IGNORED)
        self.seen: dict[str, tuple[int, int]] | None = None
        self.length = 0

    def _wanted(self, path: str, name: str) -> bool:
        return any(fnmatch(name, p) for p in self.pattern) and not re.search(self.ignore, path)

    def initialOffset(self) -> dict:
        return {"log": 0}

    def latestOffset(self) -> dict:
        """Looks at the folder and logs what differs from the log's end, if anything does."""
        log = _Log(self.log_uri)
        if self.seen is None:
            self.seen, self.length = {}, log.length()
            for k in range(self.length):
                self._apply(log.entry(k))
        files, folder = _opened(self.uri)
        infos = files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        now = {f.path: (f.mtime_ns or 0, f.size or 0) for f in infos if f.is_file and self._wanted(f.path, f.base_name)}
        rows = [["change" if p in self.seen else "add", p, *v] for p, v in sorted(now.items()) if self.seen.get(p) != v]
        rows += [["unlink", p, 0, 0] for p in sorted(self.seen.keys() - now.keys())]
        if rows:
            tick = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1e9)
            rows = [[op, p, mtime, size, tick] for op, p, mtime, size in rows]
            log.append(self.length, rows)
            self._apply(rows)
            self.length += 1
        return {"log": self.length}

    def _apply(self, rows: list[list]) -> None:
        for op, path, mtime, size, _ in rows:
            if op == "unlink":
                self.seen.pop(path, None)
            else:
                self.seen[path] = (mtime, size)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = _Log(self.log_uri)
        rows = [r for k in range(start["log"], end["log"]) for r in log.entry(k)]
        return [_Files(rows[k : k + FILES_A_TASK]) for k in range(0, len(rows), FILES_A_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        """A file that is gone by now is logged as gone later, and has no content here."""
        files, _ = _opened(self.uri)
        for op, path, _, _, tick in partition.rows:
            content = None
            if op != "unlink":
                try:
                    with files.open_input_stream(path) as f:
                        content = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    content = None
            yield dt.datetime.fromtimestamp(tick / 1e9, dt.timezone.utc), path, op, content

    def commit(self, end: dict) -> None:
        pass


class TreeWatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_watch"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
