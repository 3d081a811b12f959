"""Media columns: payloads kept as 8-bit image members of archives, read back by byte range.

``write_archives`` stores each payload as a lossless 8-bit greyscale PNG, 64 samples a row, in
ZIP archives of the shared folder. ``MemberSource`` is a Spark data source over a folder of such
archives: it plans byte ranges from the archives' sizes alone, each task finds the members that
begin in its range in the archive's own directory, and every member is read by its offset, again
on its own if a read fails. Payloads go to Spark in Arrow batches of bounded bytes.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from folioscope.llm.common import work_dir

WIDTH = 64
# Fixed values of the PNG and ZIP formats: signatures and record layouts.
PNG_START = b"\x89PNG\r\n\x1a\n"
LOCAL, CENTRAL, END = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"
END64, END64_AT, ZIP64_EXTRA = "<4sQ2H2L4Q", "<4sLQL", "<2HQ"
LIMIT32 = 0xFFFFFFFF


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to the next positive multiple of 64."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def encode_png(payload: bytes, n_bytes: int, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of ``payload``, whose length is a multiple of 64; n_bytes goes to a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    unfiltered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    unfiltered[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">L", len(data)) + kind + data + struct.pack(">L", zlib.crc32(kind + data))

    head = struct.pack(">2L5B", WIDTH, len(rows), 8, 0, 0, 0, 0)
    note = b"Length\0%d" % n_bytes
    return PNG_START + chunk(b"IHDR", head) + chunk(b"tEXt", note) + chunk(b"IDAT", zlib.compress(unfiltered.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes) of a PNG that ``encode_png`` wrote; ValueError where it is damaged."""
    if media[:8] != PNG_START:
        raise ValueError("not a PNG")
    at, data, height, n_bytes = 8, b"", 0, -1
    while at < len(media):
        (size,), kind = struct.unpack_from(">L", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">L", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">2L2B", body)
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not 64 samples of 8 bits a row")
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            n_bytes = int(body[7:])
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("unknown filter")
    return rows[:, 1:].tobytes(), n_bytes


def features(payload: bytes) -> str:
    """Mean, deviation and entropy in bits of the samples, and the most frequent one, as text."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = count / count.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean**2)))
    entropy = float(-(p[p > 0] @ np.log2(p[p > 0])))
    return f"mean={mean:.4f};sd={deviation:.4f};bits={entropy:.4f};mode={int(count.argmax())}"


class ArchiveWriter:
    """A ZIP archive of stored members, written in one pass to ``path`` and put in place when closed."""

    def __init__(self, files: pafs.FileSystem, path: str):
        self.files, self.path, self.temp = files, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.out, self.at, self.central, self.n = files.open_output_stream(self.temp), 0, [], 0

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        self.out.write(struct.pack(LOCAL, b"PK\3\4", 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(raw), 0) + raw)
        self.out.write(data)
        extra = b"" if self.at < LIMIT32 else struct.pack(ZIP64_EXTRA, 1, 8, self.at)
        self.central.append(struct.pack(CENTRAL, b"PK\1\2", 45, 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(raw), len(extra), 0, 0, 0, 0, min(self.at, LIMIT32)) + raw + extra)
        self.at += struct.calcsize(LOCAL) + len(raw) + len(data)
        self.n += 1

    def close(self) -> None:
        central = b"".join(self.central)
        self.out.write(central)
        end64 = self.at + len(central)
        if self.n >= 0xFFFF or end64 >= LIMIT32:
            self.out.write(struct.pack(END64, b"PK\6\6", struct.calcsize(END64) - 12, 45, 45, 0, 0, self.n, self.n, len(central), self.at))
            self.out.write(struct.pack(END64_AT, b"PK\6\7", 0, end64, 1))
        self.out.write(struct.pack(END, b"PK\5\6", 0, 0, min(self.n, 0xFFFF), min(self.n, 0xFFFF), min(len(central), LIMIT32), min(self.at, LIMIT32), 0))
        self.out.close()
        # A task that is run again finds its first run's archive, of the same rows; not every store replaces a file by a move.
        if self.files.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.files.delete_file(self.path)
        self.files.move(self.temp, self.path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_archives(df: DataFrame, key: Column, payload: Column, folder: str, archive_bytes: int = 128 << 20) -> None:
    """Stores each row's payload (binary, null: empty) in archives under ``folder``.

    A task writes archives of about ``archive_bytes``. A task that is run again writes its
    archives anew under the same names, so each payload is there once. Members are named by
    their number in the archive and the key's text ("null" for a null key).
    """
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = filesystem(folder)
        part, k, archive = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                if archive is None:
                    archive = ArchiveWriter(files, f"{root}/part-{part:06d}-{k:04d}.zip")
                    k += 1
                data = data.as_py() or b""
                archive.add(f"{archive.n:08d}/{name.as_py()}.png", encode_png(pad(data), len(data)))
                if archive.at >= archive_bytes:
                    archive.close()
                    archive = None
        if archive is not None:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["archives"])

    df.select(F.coalesce(key.cast("string"), F.lit("null")).alias("name"), payload.alias("data")).mapInArrow(store, "archives long").agg(F.sum("archives")).collect()


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    start: int
    end: int


def members(f, size: int, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, length, crc) of the members whose local header begins in [start, end), by the archive's directory."""
    tail_at = max(0, size - struct.calcsize(END) - struct.calcsize(END64_AT) - struct.calcsize(END64))
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("archive without a directory")
    *_, n, length, offset, _ = struct.unpack_from(END, tail, at)
    if (at64 := tail.rfind(b"PK\6\6", 0, at)) >= 0:
        *_, n, length, offset = struct.unpack_from(END64, tail, at64)
    f.seek(offset)
    directory, at = f.read(length), 0
    for _ in range(n):
        head = struct.unpack_from(CENTRAL, directory, at)
        crc, stored, name_size, extra_size, note_size, where = head[7], head[8], head[10], head[11], head[12], head[16]
        at += struct.calcsize(CENTRAL)
        name = directory[at : at + name_size].decode()
        if where == LIMIT32:
            where = struct.unpack_from("<Q", directory, at + name_size + 4)[0]
        at += name_size + extra_size + note_size
        if start <= where < end:
            yield name, where, stored, crc


def read_member(open_file: Callable, f, where: int, length: int, crc: int, retries: int, pause: float = 0.2):
    """(file, bytes) of the member at ``where``; each member has its own retries, from its own offset, on a new handle.

    ``f`` may be None, as after an error; opening counts as a part of the try. The n-th retry waits n times ``pause`` seconds.
    """
    for n in range(retries + 1):
        try:
            f = open_file() if f is None else f
            f.seek(where)
            head = struct.unpack(LOCAL, f.read(struct.calcsize(LOCAL)))
            f.seek(where + struct.calcsize(LOCAL) + head[9] + head[10])
            data = f.read(length)
            if head[0] != b"PK\3\4" or len(data) != length or zlib.crc32(data) != crc:
                raise OSError(f"member at {where} is damaged")
            return f, data
        except (OSError, struct.error):
            if f is not None:
                with contextlib.suppress(OSError):
                    f.close()
            f = None
            if n == retries:
                raise
            time.sleep(pause * (n + 1))
    raise AssertionError


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        files, root = filesystem(self.folder)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True))
        own = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(".zip"))
        step = self.range_bytes
        return [ByteRange(path, size, at, at + step) for path, size in own for at in range(0, size, step)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = filesystem(self.folder)
        open_file = lambda: files.open_input_file(partition.path)
        f, names, offsets, data, held = open_file(), [], [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(data, pa.binary())], ["member", "offset", "media"])
        for name, where, length, crc in list(members(f, partition.size, partition.start, partition.end)):
            f, media = read_member(open_file, f, where, length, crc, self.retries)
            names.append(name)
            offsets.append(where)
            data.append(media)
            held += length
            if held >= self.batch_bytes:
                yield batch()
                names, offsets, data, held = [], [], [], 0
        if names:
            yield batch()


class MemberSource(DataSource):
    """``spark.read.format("archive_members").load(folder)``: (member, offset, media) of every archive member.

    Options: rangeBytes (a partition's bytes of archive), batchBytes (of payload in an Arrow
    batch), retries (of each member).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "member string, offset long, media binary"

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    spark.dataSource.register(MemberSource)
    return spark.read.format("archive_members").options(**options).load(folder)


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of ``COLUMNS`` for each stored member, from its stored bytes alone."""
    for batch in batches:
        rows = []
        for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            payload, n_bytes = decode_png(media)
            key = name.partition("/")[2].removesuffix(".png")
            rows.append((None if key == "null" else int(key), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in COLUMNS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores the whole text of each row of ``docs`` and returns ``COLUMNS`` of what is read back.

    Null and empty texts are 64 zero bytes. Repeated rows are members of their own; equal texts
    have equal stored bytes. A null doc_id stays null. An empty table gives no rows.
    """
    folder = f"{work_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write_archives(docs, F.col("doc_id").cast("long"), F.col("text").cast("binary"), folder)
    return read_archives(docs.sparkSession, folder).select("member", "media").mapInArrow(describe, COLUMNS)
