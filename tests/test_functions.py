"""Column functions and the two forms of the histogram."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankwell.functions import columns as c
from rankwell.functions import histogram as h


def column(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_messy_strings(spark):
    want = {"--": None, "70.1 in": 70.1, "  -12 ": -12.0, ".5": 0.5, "abc": None, "": None, "1.": 1.0, "+3e5": 3.0}
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "x string").select("x", c.first_number(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == want | {None: None}
    words = {" TRUE": 1.0, "Yes": 1.0, "y": 1.0, "f": 0.0, "No ": 0.0, "0": 0.0, "maybe": None, "": None}
    rows = spark.createDataFrame([(k,) for k in words], "x string").select("x", c.boolish(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == words


def test_names(spark):
    assert column(spark, "a/b/12_x_y.png", "string", c.uid) == "x_y"
    assert column(spark, "plain.jpeg", "string", c.uid) == "plain"
    assert column(spark, "12_x.png", "string", c.label_prefix) == 12
    assert column(spark, "x_12.png", "string", c.label_prefix) == 0
    assert column(spark, "25,50 100,-3,x,0", "string", c.positive_ints) == [25, 50, 100]


def test_formulas(spark):
    assert column(spark, [1.0, 2.0, 3.0], "array<double>", lambda x: c.softmax_at(x, 2)) == pytest.approx(np.exp(3) / np.exp([1, 2, 3]).sum())
    assert column(spark, 25.0, "double", lambda x: c.epsilon(F.lit(3.0), x)) == 3.0
    assert column(spark, -2.0, "double", c.relu) == 0.0
    assert column(spark, [0.0, 3.0], "array<double>", lambda x: c.distance(x, F.array(F.lit(4.0), F.lit(0.0)))) == 5.0


def sql_forms(spark, edges, counts, new, s):
    d = spark.createDataFrame([(edges, counts, new, s)], "e array<double>, c array<double>, n array<double>, s double")
    e, k = F.col("e"), F.col("c")
    return d.select(h.gain(e, k, F.col("s")).alias("gain"), h.gain(e, k, F.col("s"), "excess").alias("excess"), h.rebin(e, k, F.col("n"), 0.9).alias("rebin")).first()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=4, max_size=4), st.floats(0, 2), st.floats(1, 3))
def test_histogram_forms_agree(spark, counts, s, high):
    x = h.Histogram(0, 1, 4, decay=0.9)
    x.counts, x.total = np.array(counts, float), float(sum(counts))
    new = np.linspace(0, high, 5)
    got = sql_forms(spark, x.edges.tolist(), x.counts.tolist(), new.tolist(), s)
    assert got.gain == pytest.approx(x.gain(s), abs=1e-9) and got.excess == pytest.approx(x.gain(s, "excess"), abs=1e-9)
    before = x.counts.sum()
    x.rebin(new)
    assert got.rebin == pytest.approx(x.counts.tolist()) and x.counts.sum() == pytest.approx(before * 0.9)


def test_histogram_updates():
    x = h.Histogram(0, 1, 4)
    for score in (0.25, -1.0, 0.26, 1.0):
        x.add(score, 0.0)
    assert x.counts.tolist() == [2, 1, 0, 1]  # borders belong to the bin below, lower scores to the first
    x.add(1.5, 0.0)
    assert x.edges[-1] == pytest.approx(1.65) and x.edges[1] == 0.25 and x.total == 5 and x.counts.sum() == pytest.approx(5)
    x.add(0.1, 1.0)
    assert x.edges[1] == 1.0 and (x.counts > 0).all()
    y = h.Histogram(0, 1, 4)
    y.counts, y.total = np.array([3.0, 1, 0, 2]), 6.0
    z = h.Histogram(0, 1, 4)
    z.counts, z.total = np.array([1.0, 2, 0, 0]), 3.0
    y.subtract(z)
    assert y.counts.tolist() == [2, 0, 0, 2] and y.total == 3
    gains = [y.gain(s) for s in (0, 0.3, 0.6, 0.9, 1.2)]
    assert gains == sorted(gains, reverse=True) and h.Histogram(0, 1, 4).gain(0) == 0


def test_bins(spark):
    edges = F.array(*[F.lit(i * 0.25) for i in range(5)])
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.25, 0.26, 1.0, 9.0)], "x double").select(h.bin_of(F.col("x"), edges).alias("b")).collect()
    assert [r.b for r in rows] == [0, 0, 0, 1, 3, 3]
    d = spark.createDataFrame([([5.0, 1.0], [2.0, 3.0])], "a array<double>, b array<double>")
    assert d.select(h.subtract(F.col("a"), F.col("b")).alias("y")).first()["y"] == [3.0, 0.0]


def test_png_text_is_stripped(spark):
    import struct
    import zlib

    from rankwell.functions.binary import PNG, strip_png

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head, note, end = chunk(b"IHDR", b"x" * 13), chunk(b"tEXt", b"secret"), chunk(b"IEND", b"")
    rows = [(PNG + head + note + end,), (b"GIF89a",), (PNG + head + note[:-3],), (None,)]
    got = [r.y for r in spark.createDataFrame(rows, "x binary").select(strip_png("x").alias("y")).collect()]
    assert [None if g is None else bytes(g) for g in got] == [PNG + head + end, b"GIF89a", PNG + head + note[:-3], None]
