"""Spark data source "glyphsieve": rule, codepoint and line files as tables and streams, and results written with a commit."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

SCHEMAS = {"rules": "file string, process_type int, word_id long, word string", "table": "file string, key string, value string", "lines": "file string, start long, text string"}
MANIFEST, STAGED = "_commits", "_staged"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Glyphsieve)


def _folder(options: dict) -> Path:
    """The path option as a folder or file that driver and executors both see by that name; other stores than file systems are an error."""
    if "path" not in options:
        raise ValueError("no path is given")
    parts = urlsplit(options["path"])
    if parts.scheme not in ("", "file"):
        raise ValueError(f"this source reads and writes mounted folders, not {parts.scheme}://")
    return Path(unquote(parts.path) if parts.scheme else options["path"])


class Glyphsieve(DataSource):
    """Read with option kind:

    rules: files of {"<process type>": {"<id>": "<rule>"}}, or a JSON object of this shape in each line; a row a rule. What is no such JSON is an
    error that names the file.
    table: lines "key<TAB>value" of codepoint tables; # starts a comment, a missing value is null (the character is deleted).
    lines: lines of texts with the byte they start at; a file is read by pieces of option piece bytes (16 MB), each by a task of its own.
    results: what was written in this format; the default.

    A path is a file or a folder, whose files are read but for those whose names begin with "_" or ".". As a stream, rules and tables are read once
    a file (by time of change and name), lines as far as files have grown; a last line without an end of line waits for it.

    Written are Parquet files that count once their write is committed: a task that fails leaves none, one that is killed none that
    counts (see sweep), a stream's batch that is run again none twice. mode("overwrite") replaces what was there in the same commit.
    """

    @classmethod
    def name(cls) -> str:
        return "glyphsieve"

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "results")
        if kind not in (*SCHEMAS, "results"):
            raise ValueError(f"no kind {kind!r}")
        return kind

    def schema(self) -> str | StructType:
        if self.kind in SCHEMAS:
            return SCHEMAS[self.kind]
        found = committed(_folder(self.options))
        if not found:
            raise ValueError("nothing is committed here, so a schema must be given")
        return from_arrow_schema(pq.read_schema(found[0]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ResultReader(_folder(self.options), schema) if self.kind == "results" else FileReader(self.kind, _folder(self.options), int(self.options.get("piece", 16 << 20)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        if self.kind == "results":
            raise ValueError("results are not read as a stream")
        return FileStream(self.kind, _folder(self.options), int(self.options.get("piece", 16 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return CommittedWriter(_folder(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return CommittedStreamWriter(_folder(self.options), overwrite)


@dataclass
class Piece(InputPartition):
    """Lines of a file that start in [start, end); end None: all of it."""

    path: str
    start: int = 0
    end: int | None = None


def files(path: Path) -> list[Path]:
    if not path.exists():
        raise FileNotFoundError(f"there is no {path}")
    found = [path] if path.is_file() else [p for p in path.rglob("*") if p.is_file() and not any(x[0] in "_." for x in p.relative_to(path).parts)]
    return sorted(found)


def pieces(kind: str, path: Path, piece: int, start: int = 0, end: int | None = None) -> list[Piece]:
    if kind != "lines":
        return [Piece(str(path))]
    end = path.stat().st_size if end is None else end
    return [Piece(str(path), at, min(at + piece, end)) for at in range(start, end, piece)]


def rows(kind: str, p: Piece) -> Iterator[tuple]:
    name = os.path.basename(p.path)
    if kind == "lines":
        with open(p.path, "rb") as f:
            if p.start:  # a line that began before belongs to the piece before
                f.seek(p.start - 1)
                f.readline()
            while (at := f.tell()) < p.end and (line := f.readline()):
                yield name, at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
        return
    text = Path(p.path).read_text(encoding="utf-8")
    if kind == "table":
        for line in text.split("\n"):
            if line and not line.startswith("#"):
                key, _, value = line.partition("\t")
                yield name, key, value or None
        return
    try:
        try:
            tables = [json.loads(text)] if text.strip() else []
        except json.JSONDecodeError:
            tables = [json.loads(line) for line in text.split("\n") if line.strip()]
        for t in tables:
            for pt, words in t.items():
                for k, word in words.items():
                    yield name, int(pt), int(k), word
    except (AttributeError, ValueError) as e:
        raise ValueError(f"{p.path} holds no rules: {e}") from e


class FileReader(DataSourceReader):
    def __init__(self, kind: str, path: Path, piece: int):
        self.kind, self.path, self.piece = kind, path, piece

    def partitions(self) -> list[Piece]:
        return [x for f in files(self.path) for x in pieces(self.kind, f, self.piece)] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return rows(self.kind, partition) if partition.path else iter(())


class FileStream(DataSourceStreamReader):
    """Offsets: of lines, how many bytes of each file are read, up to its last end of line; else the time of change and the name of the last file."""

    def __init__(self, kind: str, path: Path, piece: int):
        self.kind, self.path, self.piece = kind, path, piece

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _changed(self) -> list[tuple[int, str]]:
        return sorted((f.stat().st_mtime_ns, str(f)) for f in files(self.path))

    def latestOffset(self) -> dict:  # noqa: N802
        if self.kind == "lines":
            return {str(f): n for f in files(self.path) if (n := _whole_lines(f))}
        found = self._changed()
        return {"time": found[-1][0], "file": found[-1][1]} if found else {}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if self.kind == "lines":
            return [x for f, n in sorted(end.items()) for x in pieces(self.kind, Path(f), self.piece, start.get(f, 0), n)]
        a, b = ((x["time"], x["file"]) if x else (0, "") for x in (start, end))
        return [Piece(f) for t, f in self._changed() if a < (t, f) <= b]

    def read(self, partition: Piece) -> Iterator[tuple]:
        return rows(self.kind, partition)

    def commit(self, end: dict) -> None:
        pass


def _whole_lines(path: Path, step: int = 1 << 16) -> int:
    """How many bytes of a file lie before or at its last end of line."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            low = max(0, at - step)
            f.seek(low)
            if (k := f.read(at - low).rfind(b"\n")) >= 0:
                return low + k + 1
            at = low
    return 0


def commits(path: Path) -> list[Path]:
    return sorted((path / MANIFEST).glob("*.json"))


def committed(path: Path) -> list[str]:
    """The data files that count: those of all commits since the last that replaced what was there."""
    found: list[str] = []
    for c in commits(path):
        made = json.loads(c.read_text())
        found = [*([] if made["replaces"] else found), *(str(path / f) for f in made["files"])]
    return found


def sweep(path: str | Path) -> int:
    """Delete files that no commit names, as tasks leave that were killed, and say how many. No write may be under way."""
    root = Path(path)
    named = {f for c in commits(root) for f in json.loads(c.read_text())["files"]}
    lost = [p for p in (root / STAGED).glob("*.parquet") if f"{STAGED}/{p.name}" not in named]
    for p in lost:
        p.unlink()
    return len(lost)


class ResultReader(DataSourceReader):
    def __init__(self, path: Path, schema: StructType):
        self.path, self.columns = path, [f.name for f in schema.fields]

    def partitions(self) -> list[Piece]:
        return [Piece(f) for f in committed(self.path)] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from pq.ParquetFile(partition.path).iter_batches(columns=self.columns)


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    rows: int = 0


class _Writer:
    def __init__(self, path: Path, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        """A file of this task's attempt; it counts for nothing until it is in a commit, and goes if the task fails."""
        name, out, n = f"{STAGED}/{uuid.uuid4().hex}.parquet", None, 0
        (self.path / STAGED).mkdir(parents=True, exist_ok=True)
        try:
            for b in batches:
                if out is None:
                    out = pq.ParquetWriter(self.path / name, b.schema, compression="zstd")
                out.write_batch(b)
                n += b.num_rows
        except BaseException:
            if out:
                out.close()
                (self.path / name).unlink(missing_ok=True)
            raise
        if out:
            out.close()
        return Staged(name if out else None, n)

    def publish(self, messages: list[Staged | None], name: str) -> None:
        """One rename makes all files of a write count, or none."""
        (self.path / MANIFEST).mkdir(parents=True, exist_ok=True)
        kept = [m.file for m in messages if m and m.file]
        draft = self.path / MANIFEST / f".{self.run}"
        draft.write_text(json.dumps({"files": kept, "rows": sum(m.rows for m in messages if m), "replaces": self.overwrite}))
        draft.replace(self.path / MANIFEST / f"{name}.json")

    def withdraw(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m and m.file:
                (self.path / m.file).unlink(missing_ok=True)


class CommittedWriter(_Writer, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.publish(messages, f"{len(commits(self.path)):012d}-write-{self.run}")

    def abort(self, messages: list[Staged | None]) -> None:
        self.withdraw(messages)


class CommittedStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """Batches commit under their number, so one that is run again after a failure finds its commit and withdraws its files. A folder takes the
    batches of one query."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        if any(c.stem.endswith(f"-batch-{batchId}") for c in commits(self.path)):
            self.withdraw(messages)
        else:
            self.publish(messages, f"{len(commits(self.path)):012d}-batch-{batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.withdraw(messages)
