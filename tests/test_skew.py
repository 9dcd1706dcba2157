"""Block join: same rows as the plain join, a hot key spread by blocks of positions."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from reasonloop.operators.skew import block_join


@contextmanager
def no_rescue(spark):
    """Adaptive execution and broadcasts off: only the plan itself may spread a hot key."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
             "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _frames(spark):
    fact = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 400).alias("k"),
        F.col("id").alias("v"), (F.col("id") + 1).alias("pos"))
    dim = spark.range(0, 390).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    return fact, dim


def test_join_exact(spark):
    fact, dim = _frames(spark)
    for how in ("inner", "left"):
        for block in (7, 1000, 10**9):
            got = sorted(map(str, block_join(fact, dim, "k", "pos", how, block).collect()))
            assert got == sorted(map(str, fact.join(dim, "k", how).collect()))


def test_null_keys_and_positions(spark):
    fact = spark.createDataFrame([(None, 1), (1, None), (1, 2), (2, 3)], "k int, pos int")
    dim = spark.createDataFrame([(1, "a"), (None, "n")], "k int, w string")
    assert sorted(map(str, block_join(fact, dim, "k", "pos", "left", 2).collect())) == \
        sorted(map(str, fact.join(dim, "k", "left").collect()))


def _largest_share(df, total):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()) / total


def test_hot_key_has_no_task_of_its_own(spark):
    fact, dim = _frames(spark)
    with no_rescue(spark):
        assert _largest_share(fact.join(dim, "k"), 30000) > 0.3
        assert _largest_share(block_join(fact, dim, "k", "pos", block=500), 30000) < 0.2


def test_equal_rows_of_a_hot_key_spread(spark):
    fact = spark.range(0, 6000).select(F.lit(1).alias("k"), F.lit("same").alias("v"), F.col("id").alias("pos"))
    dim = spark.createDataFrame([(1, "w")], "k int, w string")
    with no_rescue(spark):
        assert _largest_share(block_join(fact, dim, "k", "pos", block=100), 6000) < 0.5


def test_stored_generations_and_numbering_spread_a_hot_problem(spark):
    from reasonloop.operators.generate import TableGenerator
    from reasonloop.operators.ordinal import group_row_number
    from reasonloop.operators.skew import BLOCK_CONF
    rows = spark.range(0, 9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("id"), F.col("id").alias("v"))
    with no_rescue(spark):
        numbered = group_row_number(rows, ["id"], ["v"], name="cand_idx")
        # sixteen ranges hashed to sixteen tasks: a few may meet, the whole group may not
        hot = numbered.filter("id = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(hot) >= 2 and max(r["count"] for r in hot) < 0.8 * 3000
        spark.conf.set(BLOCK_CONF, "200")
        try:
            gens = TableGenerator(numbered.withColumn("text", F.lit("t")))
            prompts = rows.select("id").distinct()
            assert _largest_share(gens(prompts), 9000) < 0.25
        finally:
            spark.conf.unset(BLOCK_CONF)


def test_positions_of_one_block_need_no_pairs(spark):
    fact = spark.range(0, 600).select((F.col("id") % 40).alias("k"), (F.col("id") % 7).alias("pos"))
    dim = spark.range(0, 39).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    one, many = (block_join(fact, dim, "k", "pos", "left", b) for b in (7, 3))
    joins = [j._jdf.queryExecution().optimizedPlan().toString().count("Join ") for j in (one, many)]
    assert joins == [1, 2]
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
