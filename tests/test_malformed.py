"""Rows that do not fit the declared schema: ended by, set aside, or nulls."""

import pytest

from shelfcast.sources.tables import MALFORMED, SCHEMAS, read_checked, read_table

TRAIN = [
    "id,date,store_nbr,family,sales,onpromotion",
    "1,2017-01-01,1,BEVERAGES,2.5,0",
    "x2,2017-01-01,1,BEVERAGES,2.5,0",  # long
    "3,2017-13-01,1,BEVERAGES,2.5,0",  # date
    "4,2017-01-01,one,BEVERAGES,2.5,0",  # int
    "5,2017-01-01,1,BEVERAGES,much,0",  # double
    "6,2017-01-01,1,BEVERAGES",  # too few
    "7,2017-01-01,1,BEVERAGES,2.5,0,9",  # too many
    "8,,,,,",
    "9,2017-01-02,2,\"A, B\",NaN,3",
]
HOLIDAYS = [
    "date,type,locale,locale_name,description,transferred",
    "2017-01-01,Holiday,National,Ecuador,First,False",
    "2017-01-02,Holiday,National,Ecuador,Second,perhaps",  # boolean
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("malformed")
    (path / "train.csv").write_text("\n".join(TRAIN) + "\n")
    (path / "holidays_events.csv").write_text("\n".join(HOLIDAYS) + "\n")
    (path / "test.csv").write_text("id,date,store_nbr,family,onpromotion\n")
    return str(path)


def test_broken_rows_are_set_aside_with_their_lines(spark, folder):
    good, bad = read_checked(spark, folder, "train")
    assert good.schema.names == SCHEMAS["train"].names
    rows = {r["id"]: r for r in good.collect()}
    assert set(rows) == {1, 8, 9} and rows[9]["sales"] is None and rows[9]["family"] == "A, B" and rows[8]["date"] is None
    assert sorted(r[MALFORMED] for r in bad.collect()) == sorted(TRAIN[2:8])
    assert bad.count() == 6
    good, bad = read_checked(spark, folder, "holidays_events")
    assert (good.count(), bad.count()) == (1, 1)
    good, bad = read_checked(spark, folder, "test")
    assert (good.count(), bad.count()) == (0, 0)


@pytest.mark.parametrize("line", range(2, 8))
def test_each_broken_row_ends_a_plain_read(spark, tmp_path, line):
    (tmp_path / "train.csv").write_text("\n".join([*TRAIN[:2], TRAIN[line]]) + "\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_table(spark, str(tmp_path), "train").collect()


def test_sound_rows_are_read_and_nulls_are_a_choice(spark, folder, tmp_path):
    (tmp_path / "train.csv").write_text("\n".join([TRAIN[0], TRAIN[1], TRAIN[8], TRAIN[9]]) + "\n")
    assert read_table(spark, str(tmp_path), "train").count() == 3
    rows = {r["id"]: r for r in read_table(spark, folder, "train", malformed="null").collect()}
    assert rows[5]["sales"] is None and rows[4]["store_nbr"] is None
    with pytest.raises(ValueError):
        read_table(spark, folder, "train", malformed="ignore")
