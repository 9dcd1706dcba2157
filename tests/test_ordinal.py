"""Dense ordinals and per-group row numbers without single-task windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from reasonloop.operators.ordinal import group_row_number, with_file_ordinal, with_ordinal, with_split_ordinal


def test_with_ordinal_dense_and_sorted(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(9)
    out = with_ordinal(df, ["k"]).collect()
    pairs = sorted((r.ordinal, r.k) for r in out)
    assert [p[0] for p in pairs] == list(range(5000))
    ks = [p[1] for p in pairs]
    assert ks == sorted(ks)


def test_group_row_number_matches_window_with_hot_key(spark):
    # one key holds a third of all rows
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        ((F.col("id") * 31) % 6007).alias("v"))
    ours = group_row_number(df, ["g"], ["v"], name="rn")
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v")))
    a = sorted(map(tuple, ours.select("g", "v", "rn").collect()))
    b = sorted(map(tuple, ref.select("g", "v", "rn").collect()))
    assert a == b


def test_group_row_number_without_hot_groups(spark):
    df = spark.range(0, 3000).select((F.col("id") % 40).alias("g"), ((F.col("id") * 17) % 3001).alias("v"))
    ours = group_row_number(df, ["g"], ["v"], name="rn", base=0)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.select("g", "v", "rn").collect()))


def test_group_row_number_over_null_keys_ties_and_several_ranges(spark):
    rows = [(None if i % 3 == 0 else i % 4, i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = group_row_number(df, ["g"], ["v"], name="rn").collect()
    for g in (None, 0, 1, 2, 3):
        mine = sorted((r.rn, r.v) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1] for m in mine] == sorted(v for k, v in rows if k == g)


def test_with_ordinal_spreads_a_hot_key(spark):
    # a third of the rows share one key value; they must not all land in one range partition
    df = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    out = with_ordinal(df, ["k"], num_partitions=6)
    ords = sorted(r.ordinal for r in out.collect())
    assert ords == list(range(9000))
    ks = [r.k for r in out.orderBy("ordinal").collect()]
    assert ks == sorted(ks)


def test_hot_key_rows_span_several_partitions(spark):
    df = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    out = with_ordinal(df, ["k"], num_partitions=6).withColumn("pid", F.spark_partition_id())
    parts = {r.pid for r in out.filter(F.col("k") == 7).select("pid").distinct().collect()}
    assert len(parts) >= 2


def test_file_ordinals_follow_the_files_without_an_exchange_of_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 1000, 1, 7).selectExpr("id", "id % 3 as g").write.parquet(path)
    src = spark.read.parquet(path)
    got = with_file_ordinal(src)
    want = with_ordinal(src, ["id"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert all("__file" in line or "SinglePartition" in line for line in rows) and "rangepartitioning" not in plan


def test_split_ordinals_of_json_lines(spark, tmp_path):
    path = str(tmp_path / "j")
    spark.range(0, 5000, 1, 3).selectExpr("id", "repeat('x', 40) as pad").write.json(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        src = spark.read.schema("id long, pad string").json(path)
        assert src.rdd.getNumPartitions() > 6
        got = with_split_ordinal(src).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.ordinal == r.id for r in got) and len(got) == 5000


def test_group_row_number_ranges_only_for_large_groups(spark):
    df = spark.range(0, 2000).select((F.col("id") % 40).alias("g"), ((F.col("id") * 17) % 2003).alias("v"))
    small = group_row_number(df, ["g"], ["v"], name="rn")
    assert "ranges-" not in "".join(small.inputFiles())
    spark.conf.set("spark.reasonloop.blockRows", "49")
    try:
        large = group_row_number(df, ["g"], ["v"], name="rn")
    finally:
        spark.conf.unset("spark.reasonloop.blockRows")
    assert "ranges-" in "".join(large.inputFiles())
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
