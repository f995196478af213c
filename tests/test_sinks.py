"""What is written, read back from files."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threadgauge.sources import sinks

LABELS = "label_set string, comment_id bigint, selection_prob double"


def test_row_groups_are_fixed_and_ascending(spark, tmp_path):
    rows = spark.range(10_500).select((F.col("id") * 7919 % 10_500).alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = f"{tmp_path}/sorted"
    sinks.write_sorted(rows.repartition(5), path, rows_per_file=4000, rows_per_group=1000)
    groups = []
    for name in sorted(glob.glob(f"{path}/*.parquet")):
        meta = pq.ParquetFile(name).metadata
        sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
        assert all(n == 1000 for n in sizes[:-1]) and 0 < sizes[-1] <= 1000 and meta.row_group(0).column(0).compression == "ZSTD"
        groups += [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
    ranges = sorted((g.min, g.max) for g in groups)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and ranges[0][0] == 0 and ranges[-1][1] == 10_499
    in_order = [r["id"] for r in spark.read.parquet(path).orderBy("id").collect()]
    assert in_order == list(range(10_500))


def test_written_label_sets_replace_only_themselves(spark, tmp_path):
    path = f"{tmp_path}/labels"
    sinks.write_label_sets(spark.createDataFrame([("01", 1, 0.5), ("b", 2, 1.0), ("b", 3, 1.0), ("judgment", 4, None)], LABELS), path)
    kept = set(glob.glob(f"{path}/label_set=01/*.parquet"))
    sinks.write_label_sets(spark.createDataFrame([("b", 9, 0.25), ("c", 5, 0.1)], LABELS), path)

    def held():
        read = sinks.read_label_sets(spark, path, LABELS).collect()
        return {(r["label_set"], r["comment_id"], r["selection_prob"]) for r in read}

    want = {("01", 1, 0.5), ("b", 9, 0.25), ("c", 5, 0.1), ("judgment", 4, None)}
    assert held() == want and set(glob.glob(f"{path}/label_set=01/*.parquet")) == kept
    for bad in ((("b", 1, 0.0)), ("b", 1, 1.5), ("b", 1, None)):
        with pytest.raises(ValueError, match="selection probability"):
            sinks.write_label_sets(spark.createDataFrame([("c", 6, 0.2), bad], LABELS), path)
    sinks.write_label_sets(spark.createDataFrame([], LABELS), path)
    assert held() == want
