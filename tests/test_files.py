"""Reading files: hashes in blocks, and tasks dealt by bytes."""

import hashlib
import tracemalloc

from pyspark.sql import functions as F

from lodeseek.sources import files


def test_a_large_file_is_hashed_in_constant_memory(spark, tmp_path):
    big = tmp_path / "big.py"
    with open(big, "wb") as f:
        f.truncate(3 << 30)
    told = hashlib.md5()
    for _ in range(3 << 10):
        told.update(bytes(1 << 20))
    tracemalloc.start()
    assert files.block_hash(str(big)) == told.hexdigest()
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    paths = spark.createDataFrame([("big.py", 3 << 30), ("gone.py", 1)], "path string, size bigint")
    assert {r.path: r.content for r in files.contents(str(tmp_path), paths).collect()} == {"big.py": None, "gone.py": None}


def test_files_are_dealt_by_bytes(spark, tmp_path):
    """1,500 files of very different sizes, after a shuffled join: every task reads, and none reads much more than the others."""
    sizes = {f"d/f{i}.py": 40_000 if i % 100 == 0 else 200 + i for i in range(1500)}
    (tmp_path / "d").mkdir()
    for p, n in sizes.items():
        (tmp_path / p).write_bytes(b"x" * n)
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        df = spark.createDataFrame(list(sizes.items()), "path string, size bigint")
        joined = df.join(df.select("path"), "path")
        got = files.contents(str(tmp_path), joined).withColumn("task", F.spark_partition_id()).select("path", "task", F.length("content").alias("n")).collect()
        assert {r.path: r.n for r in got} == sizes
        share = {}
        for r in got:
            share[r.task] = share.get(r.task, 0) + r.n
        assert len(share) == 20 and max(share.values()) < 1.7 * sum(sizes.values()) / 20
        told = {r.path: r.hash for r in files.hashes(str(tmp_path), joined.select("path")).collect()}
        assert told == {p: hashlib.md5(b"x" * n).hexdigest() for p, n in sizes.items()}
        assert files.hashes(str(tmp_path), df.where("false")).count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
