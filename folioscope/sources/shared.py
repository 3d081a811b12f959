"""Files of the folder that driver and executors share, through Arrow's file systems: local, HDFS and object stores by their URI."""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import InputPartition


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name kind, ..."; every column may be null."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{os.path.abspath(uri)}")


def put(files: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file that is there as a whole or not at all; one of the same name is replaced."""
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temp) as out:
        out.write(data)
    files.move(temp, path)


def listed(files: pafs.FileSystem, root: str, suffix: str = "") -> list[pafs.FileInfo]:
    """The files below ``root`` in order of their paths, hidden and unfinished ones apart; none if there is no such folder."""
    own = files.get_file_info(root)
    found = [own] if own.is_file else files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((x for x in found if x.is_file and x.path.endswith(suffix) and not x.path.endswith(".tmp") and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)


@dataclass
class LineRange(InputPartition):
    """The lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


def line_ranges(found: list[pafs.FileInfo], step: int) -> list[LineRange]:
    """Ranges of at most ``step`` bytes that cover files; planned from sizes, without opening a file."""
    return [LineRange(x.path, at, min(at + step, x.size)) for x in found for at in range(0, x.size, step)]


def lines_of(files: pafs.FileSystem, part: LineRange) -> Iterator[bytes]:
    with io.BufferedReader(files.open_input_file(part.path)) as f:
        at = part.start
        if at:  # a line that begins before the range belongs to the range before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < part.end and (line := f.readline()):
            at += len(line)
            yield line


def records_of(files: pafs.FileSystem, part: LineRange) -> Iterator[dict]:
    """JSON objects of lines, one a line; lines of an array of them that ``write_pages_array`` wrote count too, others are skipped."""
    for line in lines_of(files, part):
        try:
            record = json.loads(line.strip().lstrip(b"[").rstrip(b"],"))
        except ValueError:
            continue
        if isinstance(record, dict):
            yield record
