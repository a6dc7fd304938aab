from embera.llm import shared

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_small_batches_keep_a_named_size(spark):
    was = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, "1m")
        shared.small_batches(spark.range(1))
        assert spark.conf.get(KEY) == "1m"
        spark.conf.unset(KEY)
        shared.small_batches(spark.range(1))
        assert spark.conf.get(KEY) == str(shared.BATCH_BYTES)
    finally:
        spark.conf.set(KEY, was)


def test_long_texts_are_whole(spark):
    texts = spark.range(3).selectExpr("id", "repeat('ab ', 3000000) AS t")
    lengths = shared.small_batches(texts).mapInArrow(lambda bs: (b.select(["id"]) for b in bs), "id long")
    assert lengths.count() == 3
