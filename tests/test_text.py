import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lariat.functions.text import fill_unknown, remap, round_half_even, safe_key, strip, title_case


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def python_key(k):
    try:
        return str(int(float(k)))
    except (ValueError, TypeError):
        return str(k).strip()


def test_safe_key_edges(spark):
    keys = ["123", "123.0", " 7 ", "-3.9", "1e3", "1_000", "1d", "0x1p3", "abc", "", "  ", None, "nan"]
    assert run(spark, keys, safe_key) == ["123", "123", "7", "-3", "1000", "1000", "1d", "0x1p3", "abc", "", "", "None", "nan"]


def test_safe_key_random(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choice("0123456789.eE+-_   dx") for _ in range(rng.randint(0, 6))) for _ in range(1500)]
    for k, got in zip(keys, run(spark, keys, safe_key), strict=True):
        try:
            want = python_key(k)
        except OverflowError:
            continue
        if len(want) < 18:
            assert got == want, repr(k)


def test_title_edges(spark):
    values = ["  ensino superior ", "pós-graduação", "o'neil", "4-NOT SPECIFIED", "doutorado (cursando)", "r2d2", None]
    assert run(spark, values, title_case) == ["Ensino Superior", "Pós-Graduação", "O'Neil", "4-Not Specified", "Doutorado (Cursando)", "R2D2", None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=" abcXYZéÇãõ'-123.  \x1c\x1f\x85ß日ªº", max_size=12), min_size=40, max_size=60))
def test_strip_title_like_python(spark, values):
    assert run(spark, values, strip) == [v.strip() for v in values]
    assert run(spark, values, title_case) == [v.strip().title() for v in values]


def test_small(spark):
    assert run(spark, [None, "a"], fill_unknown) == ["Desconhecido", "a"]
    assert run(spark, ["a", "b", None], lambda c: remap(c, {"a": "z"})) == ["z", "b", None]
    assert run(spark, ["a"], lambda c: remap(c, {})) == ["a"]
    assert run(spark, [0.125, 0.375, 2.5], lambda c: round_half_even(c, 2), "double") == [0.12, 0.38, 2.5]
