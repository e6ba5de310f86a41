"""Tasks read bounded bytes, whatever the session or the size of the tables."""

from fieldhouse.plans import fixtures as X

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_tasks_are_bounded_and_partitions_grow_with_the_bytes(spark, sf, monkeypatch):
    was = {k: spark.conf.get(k, None) for k in KEYS}
    try:
        spark.conf.set(KEYS[0], "128MB")
        spark.conf.set(KEYS[1], "1m")
        spark.conf.set(KEYS[2], "3")
        t = X.Tables(spark, sf)
        assert X.in_bytes(spark.conf.get(KEYS[0])) == 16 << 20 and spark.conf.get(KEYS[1]) == "1m"
        monkeypatch.setattr(X, "A_PARTITION", 1000)
        t.base("lineitem")
        few = int(spark.conf.get(KEYS[2]))
        t.base("orders")
        assert int(spark.conf.get(KEYS[2])) == t.bytes // 1000 > few > 3
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sizes():
    assert [X.in_bytes(x) for x in ("64MB", "16m", "67108864b", "5", "2GiB", "1k")] == [64 << 20, 16 << 20, 64 << 20, 5, 2 << 30, 1 << 10]
