from pyspark.sql import functions as F

from inkwell.functions import ids
from inkwell.operators.filters import long_texts, with_id_parts, with_paths

IDS = ["0704.0001", "1501.00001", "hep-th/9901001", "a/b/c", "a/", "/x", "", None]


# Prefix, date and suffix of each id, worked out by hand.
PARTS = [
    ("arxiv", "0704", "0704.0001"), ("arxiv", "1501", "1501.00001"), ("hep-th", "9901", "9901001"), ("a", "b", "b"),
    ("a", "", ""), ("", "x", "x"), ("arxiv", "", ""), (None, None, None),
]


def test_id_parts_as_columns_and_sql(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(IDS)], "i int, id string")
    ids.register_sql_functions(spark)
    columns = with_id_parts(df).orderBy("i").select("prefix", "date", "suffix").collect()
    by_sql = df.orderBy("i").selectExpr("id_prefix(id)", "id_date(id)", "id_suffix(id)").collect()
    assert [tuple(r) for r in columns] == PARTS == [tuple(r) for r in by_sql]


def test_paths(spark):
    df = spark.createDataFrame([("1501.00001",), ("hep-th/9901001",)], "id string")
    rows = [r.asDict() for r in with_paths(with_id_parts(df)).collect()]
    assert rows[0]["object_path"] == "arxiv/arxiv/pdf/1501/1501.00001v1.pdf"
    assert rows[0]["article_path"] == "articles/arxiv/1501/1501.00001v1.txt"
    assert rows[1]["abstract_path"] == "abstracts/hep-th/9901/9901001v1_abstract.txt"


def test_file_ids(column):
    names = ["0704.0003v2.txt", "1501.00001v1.pdf", "a/b/1403.5177v1_abstract.txt", "9901001v12.txt"]
    assert column(names, ids.file_id) == ["0704.0003", "1501.00001", "1403.5177", "9901001"]


def test_long_texts(spark):
    df = spark.createDataFrame([("x" * 500,), ("x" * 501,), (None,)], "abstract string")
    assert [r["abstract_length"] for r in long_texts(df).collect()] == [501]
