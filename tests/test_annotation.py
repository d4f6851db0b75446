"""Fitted categories, lookups and neighbour blocks by hand."""

import math

import pytest
from pyspark.sql import functions as F

from screenlab.operators import annotation as an


def test_categories_are_those_of_the_training_rows(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, None, "y"), (4, "b", "x"), (5, "new", "nan")]
    df = spark.createDataFrame(rows, "k long, p string, q string")
    fitted = an.fit_categories(df.where("k < 5"), ["p", "q"])
    assert {(r["column"], r.category): r.rows for r in fitted.collect()} == {
        ("p", "a"): 2, ("p", "nan"): 1, ("p", "b"): 1, ("q", "nan"): 1, ("q", "x"): 2, ("q", "y"): 1,
    }
    got = {(r.k, r.feature) for r in an.one_hot_rows(df, ["k"], fitted).collect()}
    assert got == {
        (1, "p_a"), (1, "q_nan"), (2, "p_a"), (2, "q_x"), (3, "p_nan"), (3, "q_y"), (4, "p_b"), (4, "q_x"), (5, "q_nan"),
    }
    assert [(r["column"], r.category) for r in an.unseen(df, ["p", "q"], fitted).collect()] == [("p", "new")]


def test_static_block(spark):
    df = spark.createDataFrame([(1, 3.0, "a", None), (2, None, None, 2.0), (3, -5.0, "z", 0.0)], "k long, n double, c string, e double")
    fitted = an.fit_categories(df.where("k < 3"), ["c"])
    out = an.static_annotation(df, ["k"], ["n"], ["n"], ["c"], {"e": F.col("e")}, fitted)
    got = {(r.k, r.feature): r.value for r in out.collect()}
    assert got == {
        (1, "n"): 3.0, (1, "log_n"): math.log(4), (1, "e"): 0.0, (1, "e_missing"): 1.0, (1, "c_a"): 1.0,
        (2, "n"): -1.0, (2, "log_n"): 0.0, (2, "e"): 2.0, (2, "e_missing"): 0.0, (2, "c_nan"): 1.0,
        (3, "n"): -5.0, (3, "log_n"): 0.0, (3, "e"): 0.0, (3, "e_missing"): 0.0,
    }


def test_the_first_source_that_knows_it_wins(spark):
    a = spark.createDataFrame([("g", "s", None), ("h", "s", 1.0)], "gene string, sample string, value double")
    b = spark.createDataFrame([("g", "s", 5.0), ("h", "s", 9.0), ("i", "s", 7.0)], a.schema)
    got = {r.gene: r.value for r in an.preferred([a, b], ["gene", "sample"], "value").collect()}
    assert got == {"g": 5.0, "h": 1.0, "i": 7.0}


def test_neighbour_levels(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "none"), (4, None), (5, "w")], "k long, symbol string")
    first = spark.createDataFrame([("x", 10, 1), ("x", 11, 0), ("w", 99, 0)], "name string, id long, rank long")
    second = spark.createDataFrame([("x", 12, 0), ("y", 12, 0)], first.schema)
    total = spark.createDataFrame([(11, "s", 3.0), (11, "t", -1.0), (12, "s", 1.0)], "gene long, sample string, value double")
    mrna = spark.createDataFrame([(11, "s", 1.0)], total.schema)
    out = an.neighbour_levels(rows, [first, second], [total], [mrna], ["s", "t"])
    got = {(r.k, r["sample"]): (r.log_total, r.log_mrna, r.log_mean, r.breadth, r.missing) for r in out.collect()}
    l2, l4 = math.log(2), math.log(4)
    assert got == {
        (1, "s"): (l4, l2, math.log(2.5), 1.0, 0.0), (1, "t"): (0.0, 0.0, math.log(2.5), 1.0, 0.0),
        (2, "s"): (l2, 0.0, math.log(1.5), 1.0, 0.0), (2, "t"): (0.0, 0.0, math.log(1.5), 1.0, 0.0),
        **{(k, s): (0.0, 0.0, 0.0, 0.0, 1.0) for k in (3, 4, 5) for s in "st"},
    }


def test_an_unknown_name_in_a_list_is_an_error(spark):
    df = spark.createDataFrame([(1, "a, b,,"), (2, None)], "k long, at string")
    assert {(r.k, r.feature) for r in an.listed_block(df, ["k"], "at", ["a", "b"]).collect()} == {(1, "at_a"), (1, "at_b")}
    with pytest.raises(Exception, match="unknown name b"):
        an.listed_block(df, ["k"], "at", ["a"]).collect()
