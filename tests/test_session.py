import os

from loomspan.session import release, scratch, settle


def test_settled_tables_go_on_release(spark):
    df = settle(spark.range(5), "numbers")
    folder = scratch(spark).removeprefix("file:")
    assert df.count() == 5 and any(n.startswith("numbers-") for n in os.listdir(folder))
    assert df.inputFiles()[0].startswith("file:")
    release(spark)
    assert not os.path.exists(folder)


def test_scratch_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert scratch(spark).startswith(shared)
