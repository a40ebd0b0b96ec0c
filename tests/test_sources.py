"""Ordinary CSV: columns in another order, doubled quotes, line breaks inside quotes."""

import pytest

from lossweave.sources import files


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())
    return str(folder / name)


def test_columns_are_read_by_name_in_each_file(spark, tmp_path):
    one = write(tmp_path / "a", "one.csv", "x,y,z\n1,2,3\n")
    two = write(tmp_path / "a", "two.csv", "z,unused,y,x\n30,?,,10\n")
    rows = files.read_snapshot(spark, [one, two], ["x", "y", "z"]).collect()
    assert sorted((r.source_file, r.x, r.y, r.z) for r in rows) == [("one.csv", "1", "2", "3"), ("two.csv", "10", "", "30")]


def test_a_folder_with_two_headers_is_refused(spark, tmp_path):
    write(tmp_path / "b", "one.csv", "x,y\n1,2\n")
    write(tmp_path / "b", "two.csv", "y,x\n20,10\n")
    with pytest.raises(Exception, match="does not conform"):
        files.read_snapshot(spark, str(tmp_path / "b"), ["x", "y"]).collect()


def test_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "c", "q.csv", 'x,y\n"say ""hi"", ok",1\n"two\nlines",2\n')
    rows = files.read_snapshot(spark, path, ["x", "y"], multi_line=True).collect()
    assert sorted((r.y, r.x) for r in rows) == [("1", 'say "hi", ok'), ("2", "two\nlines")]
    first = files.read_snapshot(spark, write(tmp_path / "d", "q.csv", 'x,y\n"say ""hi"", ok",1\n'), ["x", "y"]).first()
    assert (first.x, first.y) == ('say "hi", ok', "1")


def test_text_tables_come_back_unchanged(spark, tmp_path):
    df = spark.createDataFrame([(' a "b", c ', "1"), ("", "2"), ("\\", "3")], "x string, y string")
    files.write_text_table(df, str(tmp_path / "e"))
    rows = files.read_snapshot(spark, str(tmp_path / "e"), ["x", "y"]).collect()
    assert sorted((r.y, r.x) for r in rows) == [("1", ' a "b", c '), ("2", ""), ("3", "\\")]
