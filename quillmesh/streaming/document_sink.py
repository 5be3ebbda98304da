"""A writer of one JSON document from rows: ``spark.dataSource.register(JsonDocument)``, then ``format("json_document")``.

Tasks write their rows, JSON texts in the column ``json``, as parts; the commit joins head, parts and tail by copying, a few
megabytes at a time, so no task and no driver holds the rows. Options: ``path``, a file or a URI that pyarrow's file systems
open, ``head`` and ``tail``, the text around the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillmesh.sources.tree_watch import _opened

CHUNK = 4 << 20
#: Version and schema of the report format.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def sarif_around(tool: str) -> tuple[str, str]:
    """Head and tail of a SARIF document around its results; ``tool`` is the JSON object of the tool."""
    return f'{{"version":{json.dumps(SARIF_VERSION)},"$schema":{json.dumps(SARIF_SCHEMA)},"runs":[{{"tool":{tool},"results":[', "]}]}"


def report_around(meta: dict, rows: str = "findings") -> tuple[str, str]:
    """Head and tail of a JSON report with its metadata."""
    return f'{{"meta":{json.dumps(meta)},{json.dumps(rows)}:[', "]}"


@dataclass
class _Part(WriterCommitMessage):
    order: int
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if not options.get("path"):
            raise ValueError("json_document needs the option path")
        self.uri, self.head, self.tail, self.overwrite = options["path"], options.get("head", "["), options.get("tail", "]"), overwrite
        if not overwrite:
            self._refuse()
        self.parts = f"{self.uri}.parts-{uuid.uuid4().hex}"
        files, at = _opened(self.parts)
        files.create_dir(at, recursive=True)

    def _refuse(self) -> None:
        files, at = _opened(self.uri)
        if files.get_file_info(at).is_file:
            raise FileExistsError(f"{self.uri} exists; use mode overwrite")

    def write(self, iterator: Iterator[Row]) -> _Part:
        """Each attempt writes a file of its own; only that of the committed one is joined."""
        files, at = _opened(self.parts)
        name, n = f"{at}/{uuid.uuid4().hex}", 0
        with files.open_output_stream(name) as out:
            for r in iterator:
                if r.json is not None:
                    out.write(("," if n else "").encode() + r.json.encode())
                    n += 1
        return _Part(TaskContext.get().partitionId(), name, n)

    def commit(self, messages: list[_Part | None]) -> None:
        if not self.overwrite:
            self._refuse()
        files, at = _opened(self.uri)
        _, parts = _opened(self.parts)
        done = f"{parts}/document"
        with files.open_output_stream(done) as out:
            out.write(self.head.encode())
            first = True
            for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.order):
                out.write(b"" if first else b",")
                first = False
                with files.open_input_stream(m.name) as part:
                    while chunk := part.read(CHUNK):
                        out.write(chunk)
            out.write(self.tail.encode())
        files.move(done, at)
        files.delete_dir(parts)

    def abort(self, messages: list[_Part | None]) -> None:
        files, at = _opened(self.parts)
        files.delete_dir(at)


class JsonDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)
