import os
import types

import pytest

from matchlane.session import fits, materialise, scratch, shared_folder, size_of, spread


def fake(master, folder=None):
    conf = types.SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return types.SimpleNamespace(
        conf=conf, sparkContext=types.SimpleNamespace(master=master, applicationId="app-1")
    )


def test_the_configured_folder_is_used():
    assert shared_folder(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"


def test_a_local_folder_is_made_once_in_local_mode_only():
    assert shared_folder(fake("local[2]")) == shared_folder(fake("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake("spark://host:7077"))


def test_fits_reads_up_to_the_limit(spark):
    assert fits(spark.range(5), 5) and not fits(spark.range(6), 5)


def test_sizes_are_counted_in_bytes(spark):
    assert size_of(spark.range(10)) == 10 * 24
    assert size_of(spark.createDataFrame([("é" * 50, [1, 2])], "t string, a array<int>")) > 100
    assert size_of(spark.range(0)) == 0


def test_working_tables_go_with_their_scratch(spark):
    with scratch(spark):
        inside = materialise(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(inside)
    assert not os.path.exists(inside)


def test_spread_only_widens_narrow_inputs(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    wide = spark.range(0, 10, 1, 9)
    assert spread(wide) is wide
