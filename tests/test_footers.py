import os

import pyarrow.parquet as pq

from folioscope.sources import footers


def test_storage_stats(spark, tmp_path):
    spark.range(1000).selectExpr("id", "repeat('x', int(id % 50)) AS text").repartition(3).write.parquet(str(tmp_path / "a"))
    spark.range(0).selectExpr("id").write.parquet(str(tmp_path / "b"))
    tables = {t: spark.read.parquet(str(tmp_path / t)) for t in "ab"}
    got = {r.name: r for r in footers.storage_stats(tables).collect()}
    for t, own in got.items():
        paths = [str(tmp_path / t / f) for f in os.listdir(tmp_path / t) if f.endswith(".parquet")]
        meta = [pq.read_metadata(p) for p in paths]
        assert (own.files, own.n_rows, own.row_groups) == (len(paths), sum(m.num_rows for m in meta), sum(m.num_row_groups for m in meta))
        assert own.file_bytes == sum(map(os.path.getsize, paths)) and own["size"].endswith("B")
    assert got["a"].n_rows == 1000 and 0 < got["a"].stored_bytes < got["a"].file_bytes and got["a"].raw_bytes >= got["a"].stored_bytes // 2
    plan = footers.footers(tables)._jdf.queryExecution().toString()
    assert "FileScan" not in plan
