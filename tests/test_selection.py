from pyspark.sql import functions as F

from inkwell.operators import selection as sel
from inkwell.operators.ranking import rank_globally


def test_first_per_group_small_and_large_k(spark):
    df = spark.range(0, 9000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("folder"), F.col("id").alias("file")
    )
    small = sel.first_per_group(df, "folder", ["file"], 10)
    assert sorted(r["file"] for r in small.where("folder = 'cold'").collect()) == list(range(2, 32, 3))
    large = sel.first_per_group(df, "folder", ["file"], 2000)
    kept = {(r["folder"], r["file"]) for r in large.collect()}
    files = range(9000)
    expected = {("hot", f) for f in [f for f in files if f % 3 < 2][:2000]}
    expected |= {("cold", f) for f in [f for f in files if f % 3 == 2][:2000]}
    assert kept == expected


def test_last_per_name_takes_the_later_folder(spark):
    df = spark.createDataFrame([("a", "f", "old"), ("b", "f", "new"), ("a", "g", "only")], "folder string, file string, text string")
    rows = sel.last_per_name(df, "file", [F.col("folder").desc()]).collect()
    assert sorted(r["text"] for r in rows) == ["new", "only"]


def test_split_is_disjoint_complete_and_repeatable(spark):
    df = spark.range(0, 5000)
    rows = sel.with_split(df, "id").groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in rows}
    assert sum(sizes.values()) == 5000 and 400 < sizes["validation"] < 600
    again = sel.with_split(df.repartition(7), "id").join(sel.with_split(df, "id").withColumnRenamed("split", "s"), "id")
    assert again.where("split <> s").count() == 0
    train, held = (sel.with_split(df, "id").where(f"split = '{s}'") for s in ("train", "validation"))
    audit = sel.overlap_audit(train, held, "id").first()
    assert audit["n_shared"] == 0 and audit["n_train"] + audit["n_validation"] == 5000


def test_random_split_and_append(spark):
    df = spark.range(0, 1000)
    train, held = sel.random_split(df, 0.1, seed=5)
    assert train.count() + held.count() == 1000
    assert sel.append_all(train, held).distinct().count() == 1000


def test_rank_globally_is_a_total_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v"), "id")
    ranked = rank_globally(df, F.col("v").desc(), F.col("id"))
    rows = sorted((r["rank"], r["v"]) for r in ranked.collect())
    assert [r for r, _ in rows] == list(range(1, 5001))
    assert [v for _, v in rows] == sorted((v for _, v in rows), reverse=True)
