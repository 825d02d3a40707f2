"""Names that contain each other, against all pairs of small sets."""

import random

from pyspark.sql import functions as F

from riffle.operators.joins import _grams, containments, without_name_overlap


def named(spark, names):
    return spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "id string, name string")


def test_containments_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    word = lambda lo, hi: "".join(rng.choice("abé") for _ in range(rng.randint(lo, hi)))
    texts, patterns = [word(1, 30) for _ in range(80)], [word(1, 9) for _ in range(60)] + ["zz", "a" * 31]
    got = {(int(r.text_id), int(r.pattern_id)) for r in containments(named(spark, texts), named(spark, patterns)).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if p in t} and got


def test_empty_sides(spark):
    some, none = named(spark, ["a"]), named(spark, ["a"]).limit(0)
    assert containments(some, none).count() == containments(none, some).count() == 0
    items = spark.createDataFrame([(1, "Mill Pond"), (2, None), (3, "")], "k int, n string")
    seen = spark.createDataFrame([("",), (None,)], "v string")
    assert without_name_overlap(items, "n", seen, "v").count() == 3
    assert without_name_overlap(items.limit(0), "n", seen, "v").columns == ["k", "n"]


def test_long_names_cost_rows_in_proportion(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij ") for _ in range(10_000))
    items = spark.createDataFrame([(1, long), (2, long[4000:4100].upper()), (3, "elsewhere"), (4, long[:9999] + "#")], "k int, n string")
    seen = spark.createDataFrame([(long[2000:6000],)], "v string")
    assert [r.k for r in without_name_overlap(items, "n", seen, "v").orderBy("k").collect()] == [3]
    assert _grams(named(spark, [long]), F.array(F.lit(11), F.lit(4))).count() <= 20_000
