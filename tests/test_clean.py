"""FLT1-FLT5, FN2, FN3, PRJ1 on the dirty_values / dirty_keys fixtures."""

import pytest
from pyspark.sql import functions as F

from cobi.functions.clean import (is_long_key, keep_node, remove_whitespace, resolve_column,
                                  strip_margin, type_is_string)


def test_dirty_values_drop_exactly_the_tokens(spark):
    vals = ["\\N", "N/A", "None", "na", " ", "", " na", None, "AUTOMOBILE", "  |na", "\n"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    kept = sorted(r.v for r in df.filter(keep_node(F.col("v"))).collect())
    # the first five drop, '' and ' na' stay, null drops, a margin-prefixed
    # token drops, a newline drops
    assert kept == ["", " na", "AUTOMOBILE"]


def test_dirty_keys(spark):
    keys = ["7", "007", "+5", "-3", "0", "12.0", " 8 ", "x", "99999999999999999999", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    k = F.col("k")
    a = sorted(r.k for r in df.filter(is_long_key(k) & (k.try_cast("bigint") >= 0)).collect())
    b = sorted(r.k for r in df.filter(is_long_key(k) & (k.try_cast("bigint") >= 1)).collect())
    assert a == sorted(["7", "007", "+5", "0"])
    assert b == sorted(["7", "007", "+5"])


def test_strip_margin_is_not_trim(spark):
    df = spark.createDataFrame([("  |abc",), ("  abc",), ("x\n  |y",), ("|",)], "v string")
    got = [r[0] for r in df.select(strip_margin(F.col("v"))).collect()]
    assert got == ["abc", "  abc", "x\ny", ""]


def test_type_filter_and_whitespace(spark):
    df = spark.createDataFrame([("bigint",), (" String ",), ("varchar(25)",), ("STRING",)], "t string")
    got = [r.t for r in df.filter(type_is_string(F.col("t"))).collect()]
    assert got == [" String ", "STRING"]
    assert df.select(remove_whitespace(F.lit(" a b\tc "))).first()[0] == "abc"


def test_resolve_column(spark):
    df = spark.createDataFrame([(1,)], "C_CustKey long")
    assert resolve_column(df, "c_custkey") == "C_CustKey"
    with pytest.raises(KeyError):
        resolve_column(df, "missing")
