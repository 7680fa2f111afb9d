import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from usagelens.schema import INTERACTIONS
from usagelens.sources import adapters, files, shaping


def _write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_log_is_read_by_position(spark, tmp_path):
    path = _write(tmp_path / "log.csv", '1,"A, ""B""",play,2.5,0\n2,C™,purchase,1.0,0\n3,D,play,1d,0\n,E,play,,0\n')
    rows = [tuple(r) for r in files.scan_interactions(spark, path).collect()]
    assert rows == [(1, 'A, "B"', "play", 2.5), (2, "C™", "purchase", 1.0), (3, "D", "play", None), (None, "E", "play", None)]


def test_narrow_or_missing_log_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        files.scan_interactions(spark, _write(tmp_path / "log.csv", "1,A,play,2\n"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_interactions(spark, str(tmp_path / "none.csv"))


def test_catalog_takes_the_first_column_as_title(spark, tmp_path):
    path = _write(tmp_path / "c.csv", "odd name,x,genre\nFoo,1,RPG\n")
    df = files.scan_catalog(spark, path)
    assert df.columns == ["title", "genre"] and tuple(df.first()) == ("Foo", "RPG")


@pytest.mark.parametrize("data", [
    "Title,User Score\nCafé,7\n".encode("utf-8"),
    "Title,User Score\nCafé,7\n".encode("utf-8-sig"),
    "Title,User Score\nCafé,7\n".encode("latin-1"),
])
def test_encodings(spark, tmp_path, data):
    df = files.read_csv_tolerant(spark, _write(tmp_path / "c.csv", data))
    assert df.columns == ["title", "user_score"] and tuple(df.first()) == ("Café", "7")


def test_encoding_without_a_fallback(spark, tmp_path):
    path = _write(tmp_path / "c.csv", "t\nCafé\n".encode("latin-1"))
    with pytest.raises(ValueError):
        files.read_csv_tolerant(spark, path, encodings=("utf-8",))


def test_names(spark):
    assert shaping.normalized_name("  User  Score (#) 5% ") == "user_score_num_5pct"
    assert shaping.sanitized_names(["a b", "a b", "9x", "!!"]) == ["a_b", "a_b_2", "_9x", "col"]
    assert shaping.sanitized_names(["!", "?", "_x_"]) == ["col", "col_2", "x"]


def test_inferred_types(spark):
    df = spark.createDataFrame([("1", "1", "1", "", "1,5"), ("2", "2.5", "x", "", "")],
                               "a string, b string, c string, d string, e string")
    types = {r.column_name: r.column_type for r in shaping.infer_column_types(df).collect()}
    assert types == {"a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "INTEGER", "e": "REAL"}
    typed = shaping.cast_inferred_types(df)
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "string", "bigint", "double"]
    assert tuple(typed.first()) == (1, 1.0, "1", None, 1.5)


def test_thousands_and_points_stay_text(spark):
    df = spark.createDataFrame([("1,234.5",), ("1.",), (".5",), ("+3",)], "a string")
    kinds = [shaping.infer_column_types(df.where(df.a == v)).first().column_type for v in ("1,234.5", "1.", ".5", "+3")]
    assert kinds == ["TEXT", "REAL", "REAL", "INTEGER"]


def test_ragged_rows(texts):
    lines = texts('1,"a, ""b""",x', "2", ",,,", '3,"open"tail', name="value")
    rows = [tuple(r) for r in shaping.pad_ragged_rows(lines).collect()]
    assert rows == [("1", 'a, "b"', "x", ""), ("2", "", "", ""), ("", "", "", ""), ("3", "opentail", "", "")]
    assert [tuple(r) for r in shaping.pad_ragged_rows(lines, width=1).collect()] == [("1",), ("2",), ("",), ("3",)]


def test_positional_table(spark):
    df = shaping.positional_table(spark.createDataFrame([(1, "a")], "x int, y string"))
    assert df.dtypes == [("col1", "string"), ("col2", "string")]


def test_report_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(' a "b", ', 1.5), ("é", None)], "item string, hours double")
    files.write_report_csv(df, str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), header=True, schema="item string, hours double", escape='"')
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_batches_limit_rows_per_file(spark, tmp_path):
    files.write_batches(spark.range(25).coalesce(1), str(tmp_path / "b"), rows_per_file=10)
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 3
    assert sorted(column(spark.read.parquet(str(tmp_path / "b")))) == list(range(25))


def test_preview(spark):
    assert files.preview(spark.range(100), 3).count() == 3


def test_any_log_takes_the_same_shape(spark):
    df = spark.createDataFrame([(1, "A", "play", float("nan")), (2, "B", "play", 2.0)], "UserID int, Game string, Action string, Value double")
    log = adapters.as_interactions(df, "UserID", "Game", "Action", "Value")
    assert log.schema.fieldNames() == INTERACTIONS.fieldNames()
    assert [f.dataType for f in log.schema] == [f.dataType for f in INTERACTIONS]
    assert column(log, "hours") == [None, 2.0]


def test_ragged_files(spark, tmp_path):
    path = _write(tmp_path / "r.csv", 'h1,h2\n1,"x, y",3\n2\n')
    assert [tuple(r) for r in files.read_ragged_csv(spark, path).collect()] == [("1", "x, y", "3"), ("2", "", "")]
    assert files.read_ragged_csv(spark, path, header=False).count() == 3
    assert files.read_ragged_csv(spark, path, width=2).columns == ["col1", "col2"]


def test_csv_to_typed_table(spark, tmp_path):
    path = _write(tmp_path / "t.csv", 'a b,a b,9x\n1,"1,5",x\n,2,\n')
    df = files.read_typed_csv(spark, path)
    assert df.dtypes == [("a_b", "bigint"), ("a_b_2", "double"), ("_9x", "string")]
    files.save_typed_table(df, "typed_sample")
    try:
        assert sorted(map(str, spark.table("typed_sample").collect())) == sorted(map(str, df.collect()))
    finally:
        spark.sql("DROP TABLE typed_sample")


def test_text_ids(spark, tmp_path):
    path = _write(tmp_path / "log.csv", "u1,A,play,2,0\n7,A,play,2,0\n")
    assert sorted(r.user_id for r in files.scan_interactions(spark, path, text_ids=True).collect()) == ["7", "u1"]
    with pytest.raises(Exception, match="no integer"):
        files.scan_interactions(spark, path).collect()


def test_records_with_a_control_sign_stay_whole(spark, tmp_path):
    path = _write(tmp_path / "odd.csv", "h\na\x01b,2\nplain\n")
    assert sorted(r.value for r in files.read_lines(spark, path, header=True).collect()) == ["a\x01b,2", "plain"]


def test_quoted_line_breaks(spark, tmp_path):
    path = _write(tmp_path / "catalog.csv", 'title,genre\n"A\nB",rpg\nC,fps\n')
    assert sorted(tuple(r) for r in files.scan_catalog(spark, path).collect()) == [("A\nB", "rpg"), ("C", "fps")]
    assert files.read_csv_tolerant(spark, path).count() == 2 and files.read_typed_csv(spark, path).count() == 2


def _python_records(path):
    import csv
    with open(path, encoding="utf-8", newline="") as file:
        return [tuple(row) for row in csv.reader(file) if row]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_records_do_not_depend_on_splits(spark, tmp_path, split):
    """Quoted line breaks, stray quotes and blank lines, in files cut at any place."""
    import csv
    import random
    rng = random.Random(split)
    cells = ["plain", "two\nlines", "", 'a "quoted" word', "\n\n", "x" * 90, "comma, here", '5" disk\n"', "end\n"]
    path = str(tmp_path / "many.csv")
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write('name,genre,note\n')
        writer = csv.writer(file, lineterminator="\n")
        for i in range(400):
            writer.writerow([f"t{i}", rng.choice(cells), rng.choice(cells)])
            if i % 50 == 0:
                file.write('s%d,5" disk,x"y\n\n' % i)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = files.read_records(spark, path).orderBy("file", "start", "line")
        assert split > 1000 or records.select("start").distinct().count() > 5
        got = [tuple(r.f) for r in records.select(shaping.fields_of(records["value"]).alias("f")).collect()]
        assert got == _python_records(path)
        found = files.scan_catalog(spark, path, keep=("genre",))
        assert sorted((r.title, r.genre or "") for r in found.collect()) == sorted(row[:2] for row in _python_records(path)[1:])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_batches_have_a_size(spark, tmp_path):
    files.write_batches(spark.range(25_000).coalesce(1), str(tmp_path / "t"))
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy(
        F.input_file_name()).count().collect()) == [5_000, 10_000, 10_000]
