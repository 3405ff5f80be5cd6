import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import index as ix


def records(spark, n, crate="a", text="text"):
    return spark.range(n).select(F.format_string("d%05d", "id").alias("parent_id"), F.concat(F.lit(f"{crate} {text} "), "id").alias("content"), (F.col("id") % 3).alias("kind"))


@pytest.fixture
def built(spark, tmp_path):
    index = ix.Index(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for crate in ("a", "b"):
        assert index.build(crate, records(spark, 500, crate, "old"), 500) == 1
    assert index.build("a", records(spark, 400, "a", "new")) == 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return index


def planned(index, *filters):
    reader = ix.IndexReader(index.root, ix.IndexSource({"path": index.root}).schema())
    left = list(reader.pushFilters(list(filters)))
    return reader.partitions(), left


def test_partitions_come_from_pointers_and_manifests(built):
    everything, _ = planned(built)
    assert {(p.crate, p.generation) for p in everything} == {("a", 2), ("b", 1)}
    own, left = planned(built, ix.EqualTo(("crate_id",), "a"), ix.EqualTo(("kind",), 1))
    assert {p.crate for p in own} == {"a"} and len(left) == 1 and len(own) > 1
    one, _ = planned(built, ix.EqualTo(("crate_id",), "a"), ix.In(("parent_id",), ("d00007", "nothing")))
    assert len(one) == 1 and one[0].keys == ("d00007",)
    old, _ = planned(built, ix.EqualTo(("generation",), 1))
    assert {(p.crate, p.generation) for p in old} == {("a", 1), ("b", 1)}
    none, _ = planned(built, ix.EqualTo(("crate_id",), "z"))
    both, _ = planned(built, ix.EqualTo(("crate_id",), "a"), ix.EqualTo(("crate_id",), "b"))
    assert none == [] and both == []


def test_scan(spark, built):
    assert built.scan().count() == 900 and built.scan("z").count() == 0
    found = built.scan("a", keys=["d00007", "d00008"]).where("kind = 1").collect()
    assert [(r.parent_id, r.content, r.generation) for r in found] == [("d00007", "a new 7", 2)]
    assert built.scan("a", 1).where("content like '%old%'").count() == 500
    df = built.scan("b", keys=["d00499"])
    assert "crate_id" not in df._jdf.queryExecution().executedPlan().toString().split("Filter")[-1].split("\n")[0] or df.count() == 1


def test_a_failed_build_leaves_no_trace(spark, built):
    before = sorted(os.listdir(f"{built.root}/crates/crate_id=a"))
    with pytest.raises(RuntimeError):
        built.build("a", records(spark, 10), expected=11)
    with pytest.raises(Exception):
        built.build("a", records(spark, 10).withColumn("content", F.raise_error(F.lit("no"))))
    assert built.active("a") == 2 and built.building("a") is None and sorted(os.listdir(f"{built.root}/crates/crate_id=a")) == before
    number = built.begin("a")
    with pytest.raises(Exception):  # one build at a time
        built.begin("a")
    built.abandon("a", number)
    with pytest.raises(ValueError):
        built.drop("a", 2)
    built.drop("a", 1)
    assert built.scan("a", 1).count() == 0


def test_a_broken_pointer_is_an_error(spark, built):
    with open(f"{built.root}/pointers/crate_id=a", "w") as f:
        f.write("{")
    os.remove(f"{built.root}/pointers/.crate_id=a.crc") if os.path.exists(f"{built.root}/pointers/.crate_id=a.crc") else None
    for read in (lambda: built.active("a"), lambda: built.scan("a").count(), lambda: built.dual_write("a")(records(spark, 1), 0)):
        with pytest.raises(Exception):
            read()
    assert built.build("a", records(spark, 3)) == 3 == built.active("a")  # numbers come from the folders


def test_batches_reach_both_generations(spark, built):
    number = built.begin("a")
    write = built.dual_write("a")
    change = records(spark, 20, "a", "changed").withColumn("deleted", F.col("parent_id") < "d00005")
    write(change, 0)
    write(change, 0)  # run again after a failure
    built.put("a", number, records(spark, 450, "a", "built"))
    write(records(spark, 3, "a", "later"), 1)
    text = lambda g: {r.parent_id: r.content for r in built.records("a", g).collect()}
    old, new = text(2), text(number)
    assert built.active("a") == 2 and len(old) == 398 and len(new) == 448
    assert old["d00001"] == new["d00001"] == "a later 1" and "d00004" not in new and old["d00019"] == new["d00019"] == "a changed 19"
    assert old["d00020"] == "a new 20" and new["d00020"] == "a built 20"
    built.activate("a", number)
    assert built.active("a") == number and built.building("a") is None
    assert built.records("a", keys=["d00449"]).first().content == "a built 449"
    with pytest.raises(LookupError):
        built.dual_write("z")(change, 0)


def test_stream_into_an_index(spark, built, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("in"))
    for k in range(3):
        records(spark, 30, "a", f"batch{k}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(records(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    number = built.begin("a")
    q = stream.writeStream.foreachBatch(built.dual_write("a")).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    built.put("a", number, records(spark, 60))
    built.activate("a", number)
    assert built.records("a").count() == 60 and built.records("a").where("content like '%batch%'").count() == 30
