"""The raster source, and searches that go on after a stop."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.sources import raster
from overlook.sources import terrain as grids
from overlook.streaming import resume


@pytest.fixture()
def folder(spark, tmp_path):
    g = grids.cells(spark, 50, 37).withColumn("z", F.col("r") * 100.0 + F.col("c"))
    raster.write_blocks(g, str(tmp_path / "dem"), 16, 500.0, 900.0, 10.0)
    raster.register(spark)
    return str(tmp_path / "dem")


def load(spark, path, **options):
    return spark.read.format(raster.FORMAT).options(**options).load(path)


def test_blocks_are_partitions_and_filters_leave_them_out(spark, folder):
    every = load(spark, folder)
    assert every.rdd.getNumPartitions() == 4 * 3
    got = every.collect()
    assert len(got) == 50 * 37 and all(x.z == x.r * 100 + x.c for x in got)
    some = every.where("r >= 17 and r < 32 and c = 5")
    assert some.rdd.getNumPartitions() == 1 and sorted(x.r for x in some.collect()) == list(range(17, 32))
    assert every.where("r > 31 and c <= 15").rdd.getNumPartitions() == 2
    assert every.where("r > 49").count() == 0 and every.where("r < 0").collect() == []
    assert every.where("z > 4000 and c > 35").count() == 10  # what can't be told by blocks is told by cells


def change(folder, **meta):
    kept = json.load(open(f"{folder}/meta.json"))
    json.dump({**kept, **meta}, open(f"{folder}/meta.json", "w"))


@pytest.mark.parametrize("meta, fault", [({"bands": 2}, "bands"), ({"unit": "ft"}, "unit"), ({"unit": None}, "unit"), ({"rotation": 0.1}, "rotated"), ({"dy": 10.0}, "north_up, square"), ({"dx": 11.0}, "square"), ({"rows": 3000, "cols": 3000}, "size")])
def test_each_fault_raises(spark, folder, meta, fault):
    change(folder, **meta)
    with pytest.raises(Exception, match=f"contract: {fault}"):
        load(spark, folder).collect()


def test_unknown_cells_and_broken_seals_raise(spark, folder, tmp_path):
    g = grids.cells(spark, 20, 20).withColumn("z", F.when(F.col("r") != 18, F.col("c") * 1.0))
    raster.write_blocks(g, str(tmp_path / "holes"), 16, 0.0, 0.0, 10.0)
    with pytest.raises(Exception, match="holds unknown cells"):
        load(spark, str(tmp_path / "holes")).collect()
    assert load(spark, str(tmp_path / "holes")).where("r < 16").count() == 320  # blocks that aren't read aren't judged
    assert load(spark, str(tmp_path / "holes"), contract="false").where("z is null").count() == 20
    raw = np.fromfile(f"{folder}/0_0.f8")
    raw[3] += 1
    raw.tofile(f"{folder}/0_0.f8")
    with pytest.raises(Exception, match="differs from its seal"):
        load(spark, folder).collect()


def test_a_search_goes_on_after_stops(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(4):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    evaluate = lambda batch: batch.withColumn("double", F.col("value") * 2)
    mark = resume.identity(input=str(tmp_path / "in"), rule=1)
    one = resume.resumed(stream(), evaluate, str(tmp_path / "one"), mark)
    want = sorted(map(tuple, one.drop("batch").collect()), key=str)
    assert len(want) == e.count()
    for n in (1, 2, None):
        many = resume.resumed(stream(), evaluate, str(tmp_path / "many"), mark, n)
    assert sorted(map(tuple, many.drop("batch").collect()), key=str) == want
    before = resume.results(spark, str(tmp_path / "many")).count()
    with pytest.raises(resume.IdentityChanged):
        resume.resumed(stream(), evaluate, str(tmp_path / "many"), resume.identity(input=str(tmp_path / "in"), rule=2))
    assert resume.results(spark, str(tmp_path / "many")).count() == before
    # a stateful stream: the state of the first run goes on in the second
    counted = lambda: stream().withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_type", "user_id"]).select("event_type", "user_id")
    whole = resume.resumed(counted(), lambda b: b, str(tmp_path / "state_one"), mark)
    for n in (2, 1, None):
        parts = resume.resumed(counted(), lambda b: b, str(tmp_path / "state_many"), mark, n)
    assert sorted(map(tuple, parts.drop("batch").collect())) == sorted(map(tuple, whole.drop("batch").collect()))
