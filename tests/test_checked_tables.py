"""SRC3 on damaged files: kept rows, lines set aside, types of the kept rows."""

from cobi.sources.tables import read_tsv_checked
from tests.conftest import rows


def write(spark, path, lines, mode="errorifexists"):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode(mode).text(path)


def test_damaged_lines_are_counted_and_do_not_decide_types(spark, tmp_out):
    write(spark, tmp_out + "/t", ["id\tname\tamount\tday\tflag\tzip", '1\t"a\t1.5\t2024-01-02\ttrue\t007x',
                                  "2\tb c\t\t2024-02-30x\tFALSE\t", "broken\tline", "3\t\\N\t-2e3\t2024-03-01\ttrue\t9",
                                  "x\ty\tz\tz\tz\tz\tone too many", ""])
    t = read_tsv_checked(spark, tmp_out + "/t")
    assert t.types == {"id": "bigint", "name": "string", "amount": "double", "day": "string", "flag": "boolean",
                       "zip": "string"}
    assert (t.n_good, t.n_bad) == (3, 2)
    assert rows(t.good, "id", "name", "amount", "flag") == [(1, '"a', 1.5, True), (2, "b c", None, False),
                                                            (3, "\\N", -2000.0, True)]
    assert sorted(r.line for r in t.bad.collect()) == ["broken\tline", "x\ty\tz\tz\tz\tz\tone too many"]


def test_several_files_without_headers(spark, tmp_out):
    write(spark, tmp_out + "/t", ["1\t2020-01-01", "2\t2020-12-31"])
    write(spark, tmp_out + "/t", ["99999999999999999999\t2021-01-01", "4"], "append")
    t = read_tsv_checked(spark, tmp_out + "/t", ["k", "d e"], header=False)
    assert t.types == {"k": "double", "d e": "date"}        # too long for a long
    assert (t.n_good, t.n_bad, t.good.count(), t.bad.count()) == (3, 1, 3, 1)


def test_empty_table(spark, tmp_out):
    write(spark, tmp_out + "/t", ["a\tb"])
    t = read_tsv_checked(spark, tmp_out + "/t")
    assert (t.n_good, t.n_bad, t.types) == (0, 0, {"a": "string", "b": "string"})
    assert t.good.collect() == [] == t.bad.collect()
