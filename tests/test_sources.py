import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from inkwell.operators import pairing
from inkwell.sources import manifest, readers, writers


@pytest.fixture
def tree(tmp_path):
    for folder, name, content in [
        ("0704", "0704.0001v1.txt", b"a\nb\x81\x93c\x94\n"), ("0704", "0704.0002v1.txt", b"z"),
        ("0705", "0705.0001v1.txt", b"x\r\ny"),
    ]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)
    return str(tmp_path)


def test_read_texts(spark, tree):
    rows = {(r["folder"], r["file"]): r["text"] for r in readers.read_texts(spark, tree).collect()}
    assert rows == {
        ("0704", "0704.0001v1.txt"): "a\n b“c”\n", ("0704", "0704.0002v1.txt"): "z",
        ("0705", "0705.0001v1.txt"): "x\n y",
    }


def test_intake_routes_by_extension(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.docx").write_bytes(b"zip")
    (tmp_path / "c.exe").write_bytes(b"?")
    rows = {r["extension"]: (r["text"], r["reason"]) for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {
        ".txt": ("é", None), ".docx": (None, "needs conversion: .docx"),
        ".exe": (None, "unsupported file type: .exe"),
    }
    with pytest.raises(Exception, match="unsupported file type: .exe"):
        readers.read_documents(spark, str(tmp_path), strict=True).collect()


def test_latin1_intake(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xe9")
    assert readers.read_documents(spark, str(tmp_path), "ISO-8859-1").first()["text"] == "é"


def test_path_list_is_told_apart_by_content(spark, tmp_path):
    path = tmp_path / "list.csv"
    article, abstract = "articles/arxiv/1403/1403.5177v1.txt", "abstracts/arxiv/1403/1403.5177v1_abstract.txt"
    path.write_text(f"abstract_path,raw_path\n{article},{abstract}\n{abstract},{article}\n")
    rows = {tuple(r) for r in readers.read_path_list(spark, str(path)).collect()}
    assert rows == {("1403.5177", article, abstract)}
    with pytest.raises(AnalysisException):
        readers.read_path_list(spark, str(tmp_path / "none.csv"))


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    rows = [(0, "p", 'a "quoted"\nline, and more', " lead"), (1, "q", "", "x\\"), (2, "r", '"', "y\n")]
    df = spark.createDataFrame(rows, "n int, id string, body string, abstract string")
    path = writers.save_pairs(df, str(tmp_path / "pairs"))
    back = readers.read_table_csv(spark, path, "n int, id string, body string, abstract string")
    assert sorted(tuple(r) for r in back.na.fill("").collect()) == [r[1:] for r in rows]
    assert "n" in readers.read_table_csv(spark, path, drop_index=False).columns


def test_append_abstracts_writes_only_what_is_absent(spark, tmp_path):
    path = str(tmp_path / "abstracts")
    schema = "id string, abstract string, prefix string, date string"
    first = spark.createDataFrame([("1", "a", "p", "0704")], schema)
    more = spark.createDataFrame([("1", "changed", "p", "0704"), ("2", "b", "q", "0705")], schema)
    writers.append_abstracts(first, path)
    writers.append_abstracts(more, path)
    writers.append_abstracts(more, path)
    rows = spark.read.schema(schema).parquet(path).select("id", "abstract", "date").collect()
    assert sorted(map(tuple, rows)) == [("1", "a", "0704"), ("2", "b", "0705")]


def test_article_and_cleaned_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "t", "p", "0704")], "id string, text string, prefix string, date string")
    writers.write_articles(df, str(tmp_path / "a"))
    assert (tmp_path / "a" / "prefix=p" / "date=0704").is_dir()
    for _ in range(2):
        writers.write_cleaned(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_metadata_scan_and_head(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text("\n".join(f'{{"id": "{i:02}", "abstract": "t{i}", "other": [1]}}' for i in range(20, 0, -1)))
    assert readers.read_metadata(spark, str(path)).columns == ["id", "abstract"]
    assert [r["id"] for r in readers.read_metadata_head(spark, str(path)).collect()] == [f"{i:02}" for i in range(1, 11)]
    with pytest.raises(ValueError, match="missing columns"):
        readers.require_columns(readers.read_metadata(spark, str(path)), "title")


def test_pairs_and_rejects(spark):
    path_list = spark.createDataFrame(
        [("1", "a1", "b1"), ("2", "a2", "b2"), ("3", "a3", "b3")],
        "id string, article_path string, abstract_path string",
    )
    articles = spark.createDataFrame([("a1", "body"), ("a2", "body2")], "path string, text string")
    abstracts = spark.createDataFrame([("b1", "short"), ("b3", "short3")], "path string, text string")
    found = pairing.pair_texts(path_list, articles, abstracts).collect()
    assert [tuple(r) for r in found] == [("1", "body", "short")]
    turned = {tuple(r) for r in pairing.pair_rejects(path_list, articles, abstracts).collect()}
    assert turned == {("2", "abstract missing"), ("3", "article missing")}
    with pytest.raises(ValueError, match="missing"):
        pairing.pair_texts(path_list, articles, abstracts, strict=True)


def test_not_yet_present(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "path string")
    present = spark.createDataFrame([("a",), ("c",)], "path string")
    assert [r["path"] for r in manifest.not_yet_present(wanted, present, "path").collect()] == ["b"]


def test_without_abstract(spark):
    pairs = spark.createDataFrame([("head. tail head.", "head.")], "body string, abstract string")
    assert pairing.without_abstract(pairs).select(F.col("body_only")).first()[0] == " tail "


def test_one_abstract_per_key_in_a_batch(spark, tmp_path):
    from inkwell.sources import writers

    rows = [("1", "b", "p", "d"), ("1", "a", "p", "d"), ("2", "c", "p", "d")]
    df = spark.createDataFrame(rows, "id string, abstract string, prefix string, date string")
    path = str(tmp_path / "abstracts")
    for _ in range(2):
        writers.append_abstracts(df, path)
    stored = spark.read.schema(df.schema).parquet(path).collect()
    assert sorted((r["id"], r["abstract"]) for r in stored) == [("1", "a"), ("2", "c")]


def test_empty_files_and_odd_names_are_read(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    texts = {"one v1.txt": "caf\u00e9\nline", "empty.txt": "", "100%.txt": "x", "none#.txt": "", "\u00fc.txt": ""}
    for name, content in texts.items():
        (folder / name).write_bytes(content.encode("cp1252"))
    found = {(r["folder"], r["file"]): r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert len(found) == 5 and {k[0] for k in found} == {"a b%20c"}
    assert sorted(found.values()) == sorted(["caf\u00e9\n line", "", "x", "", ""])
    routed = readers.read_documents(spark, str(tmp_path), "cp1252").where("text = ''")
    assert routed.count() == 3 and routed.where("reason IS NULL").count() == 3
