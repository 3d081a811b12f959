import hashlib
import math
import zipfile
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from folioscope.llm import media


def test_round_trip(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "ü" * 100_000, 5: "abc", None: "x" * 64}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(1, "abc", 1)], "doc_id long, text string, media int")
    rows = media.media_columns(docs).collect()
    assert len(rows) == 7
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    same = {(r.media_sha256, r.media_bytes, r.feature) for r in rows if r.doc_id in (1, 5)}
    assert len(same) == 1
    assert media.media_columns(docs.limit(0)).count() == 0


def test_archives_are_zip_files(spark, tmp_path):
    docs = spark.range(20).select("id", F.repeat(F.lit("payload "), 50).cast("binary").alias("p")).coalesce(1)
    media.write_archives(docs, F.col("id"), F.col("p"), str(tmp_path), archive_bytes=1000)
    names = sorted(tmp_path.glob("*.zip"))
    assert len(names) > 1
    members = [m for n in names for m in zipfile.ZipFile(n).namelist()]
    assert sorted(int(m.split("/")[1].removesuffix(".png")) for m in members) == list(range(20))
    assert all(zipfile.ZipFile(n).testzip() is None for n in names)
    ranged = media.read_archives(spark, str(tmp_path), rangeBytes=300, batchBytes=100)
    assert ranged.rdd.getNumPartitions() > len(names)
    assert ranged.count() == 20 and ranged.select("member").distinct().count() == 20


def test_members_are_tried_again_by_offset(tmp_path):
    files, root = media.filesystem(str(tmp_path))
    archive = media.ArchiveWriter(files, f"{root}/a.zip")
    archive.add("0/1.png", b"first")
    archive.add("1/2.png", b"second")
    archive.close()
    size = (tmp_path / "a.zip").stat().st_size
    f = files.open_input_file(f"{root}/a.zip")
    found = list(media.members(f, size, 0, size))
    assert [m[0] for m in found] == ["0/1.png", "1/2.png"]

    opened, closed = [], []

    class Broken:
        def seek(self, at):
            raise OSError("lost")

        def close(self):
            closed.append(1)

    def again():
        opened.append(1)
        if len(opened) == 1:
            raise OSError("not now")  # opening is tried again too
        return files.open_input_file(f"{root}/a.zip")

    assert media.read_member(again, Broken(), *found[1][1:], retries=2, pause=0)[1] == b"second" and (len(opened), len(closed)) == (2, 1)
    with pytest.raises(OSError):
        media.read_member(Broken, Broken(), *found[1][1:], retries=2, pause=0)
    assert len(closed) == 4  # every handle that failed
    again_written = media.ArchiveWriter(files, f"{root}/a.zip")
    again_written.add("0/9.png", b"anew")
    again_written.close()
    assert zipfile.ZipFile(tmp_path / "a.zip").namelist() == ["0/9.png"]
    assert isinstance(files, pafs.LocalFileSystem)


@pytest.mark.parametrize("payload", [bytes(64), bytes(range(64)), b"the house " * 32])
def test_features_against_plain_ones(payload):
    n = len(payload)
    mean = sum(payload) / n
    shares = [payload.count(b) / n for b in range(256)]
    deviation = math.sqrt(sum((b - mean) ** 2 for b in payload) / n)
    bits = -sum(p * math.log2(p) for p in shares if p)
    mode = max(range(256), key=lambda b: (shares[b], -b))
    got = dict(x.split("=") for x in media.features(payload).split(";"))
    assert [float(got[k]) for k in ("mean", "sd", "bits")] == pytest.approx([mean, deviation, bits], abs=1e-4) and int(got["mode"]) == mode


def test_damage_is_found():
    png = media.encode_png(media.pad(b"abc"), 3)
    assert media.decode_png(png) == (media.pad(b"abc"), 3)
    with pytest.raises(ValueError):
        media.decode_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
