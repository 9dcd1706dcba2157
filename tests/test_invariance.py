"""Results do not depend on partitioning: the same query under other shuffle settings."""

from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_queries_stable_across_shuffle_partitions(spark):
    import __spark_entry__ as E
    qs = E.queries()
    names = ["keep_first_correct", "retry_shortest_correct", "merge_last_wins", "progress_counters",
             "sft_batches", "collect_misses"]
    base = {n: _rows(qs[n](spark, SF_SMALL)) for n in names}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in names:
            assert _rows(qs[n](spark, SF_SMALL)) == base[n], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
