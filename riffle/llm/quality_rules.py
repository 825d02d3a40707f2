"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

One pass of built-in functions turns every text into counts. The sketch of a metric is a histogram
with logarithmic-linear cells: an integer keeps its 7 leading bits, so a cell is at most 1/64 of its
value wide, there are fewer than 64 cells for each doubling, and two sketches merge by adding cells.
Spark's partial aggregation builds and merges them, so a source with a third of all rows costs no
more than any other. Groups below ``enough`` documents are judged by the sketch of their language, and
languages below it by the sketch of everything: both are sums of the group sketches.

A metric's thresholds are outer fences, quartile -/+ 3 * max(interquartile range, slack * median + floor).
Documents are then joined with the thresholds of their group and filtered. Everything is integer
arithmetic, so that SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.llm.shared import table, text_hash, written

BLANKS = " \t\n\x0b\f\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
ENOUGH = 100
BITS = 7
#: metric: (count, divided by, scale, upper fence, lower fence, slack per 100 of the median, floor)
METRICS = {
    "word_length": ("word_chars", "n_words", 1000, True, True, 10, 0),
    "symbols": ("n_symbols", "word_chars", 100_000, True, False, 10, 500),
    "dup_lines": ("n_dup_lines", "n_words", 100_000, True, False, 10, 1000),
    "stutter": ("n_stutter", "n_words", 100_000, True, False, 10, 3000),
    "repeats": ("n_repeat_words", "n_words", 100_000, True, False, 10, 10_000),
}
FACTOR = 3


def counts(text: Column | str = "text") -> dict[str, Column]:
    """Columns of a text's words and counts; null has no words."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_SPLIT), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return {
        "words": words,
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WORD_SPLIT, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _windows(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<long>"))


def _sorted_pairs(windows: Column) -> Column:
    """(hash, start) of all windows in order of hash, if any two are equal; else nothing."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs)


def _twice(pairs: Column) -> Column:
    """Starts of the windows whose neighbour in hash order is equal, ascending."""
    equal = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
    kept = F.filter(pairs, lambda x, i: equal(x, i - 1) | equal(x, i + 1))
    return F.sort_array(F.transform(kept, lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words in these windows: each start adds the words up to the next one, 8 at most."""
    steps = F.transform(starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, th, lang, source, the base counts, n_stutter (words equal to the one before) and base_failed, one row per input row."""
    c = counts()
    d = docs.select("doc_id", text_hash().alias("th"), "lang", "source", *[v.alias(k) for k, v in c.items()])
    # one step a projection: inside a lambda an expression is computed anew for every element, a column is not
    stutter = F.size(F.filter("words", lambda w, i: F.coalesce(w == F.get("words", i - 1), F.lit(False))))
    d = d.withColumn("n_stutter", stutter.cast("long")).withColumn("windows", _windows(F.col("words"))).drop("words")
    d = d.withColumn("pairs", _sorted_pairs(F.col("windows"))).drop("windows")
    d = d.withColumn("starts", _twice(F.col("pairs"))).drop("pairs")
    d = d.withColumn("n_repeat_words", _covered(F.col("starts"))).drop("starts")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _value(metric: str) -> Column:
    top, bottom, scale, *_ = METRICS[metric]
    return F.expr(f"({top} * {scale}) div greatest({bottom}, 1)")


def cell(value: Column) -> Column:
    """Least value of the sketch cell that holds a non-negative integer."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    step = F.expr("bigint(1)") * F.pow(F.lit(2), shift).cast("long")
    return value - value % step


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, metric, cell, n: the sketch of every metric of every group, over the documents
    that pass the base rules."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), cell(_value(m)).alias("cell")) for m in METRICS])
    return (counted.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("v"))
            .groupBy("lang", "source", "v.metric", "v.cell").agg(F.count(F.lit(1)).alias("n")))


def merged(sketch: DataFrame, *groups: str) -> DataFrame:
    """The sketch of coarser groups."""
    return sketch.groupBy(*groups, "metric", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *groups: str) -> DataFrame:
    """total, q1, q2, q3 of every group and metric: the least cells that reach a quarter, a half and
    three quarters of the count. A window spans the cells of one sketch, at most some thousands."""
    from pyspark.sql import Window

    one = Window.partitionBy(*groups, "metric")
    d = sketch.withColumn("upto", F.sum("n").over(one.orderBy("cell"))).withColumn("total", F.sum("n").over(one))
    return d.groupBy(*groups, "metric").agg(
        F.max("total").alias("total"),
        *[F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("cell"))).alias(f"q{k}") for k in (1, 2, 3)])


def thresholds(sketch: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """lang, source, and for each metric its lower and upper fence, from the finest sketch with
    ``enough`` documents."""
    own = quartiles(sketch, "lang", "source")
    by_lang = quartiles(merged(sketch, "lang"), "lang")
    by_all = quartiles(merged(sketch))
    o, v, a = own.alias("o"), by_lang.alias("v"), by_all.alias("a")
    d = o.join(v, F.col("o.lang").eqNullSafe(F.col("v.lang")) & (F.col("o.metric") == F.col("v.metric"))).join(a, F.col("o.metric") == F.col("a.metric"))
    pick = lambda k: F.when(F.col("o.total") >= enough, F.col(f"o.{k}")).when(F.col("v.total") >= enough, F.col(f"v.{k}")).otherwise(F.col(f"a.{k}"))
    d = d.select("o.lang", "o.source", "o.metric", *[pick(f"q{k}").alias(f"q{k}") for k in (1, 2, 3)])
    slack = F.create_map(*[F.lit(x) for m, r in METRICS.items() for x in (m, r[5])])[F.col("metric")]
    floor = F.create_map(*[F.lit(x) for m, r in METRICS.items() for x in (m, r[6])])[F.col("metric")]
    reach = FACTOR * F.greatest(F.col("q3") - F.col("q1"), F.expr("bigint(0)") + F.floor(slack * F.col("q2") / 100) + floor)
    d = d.select("lang", "source", "metric", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    at = lambda m, side: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}")
    return d.groupBy("lang", "source").agg(*[at(m, s) for m in METRICS for s in ("low", "high")])


def judged(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """One row per input row: doc_id, th, the counts, base_failed and kept.

    A document is kept if it passes the base rules and all its metrics lie within the fences of its
    language and source. Null texts have no words and fail; null languages and sources are groups of
    their own; an empty table gives no rows; other columns are not read. The counts are written once
    and read for the sketches and for the join.
    """
    counted = written(base_counts(docs))
    limits = thresholds(sketches(counted), enough).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    inside = F.lit(True)
    for m, (_, _, _, upper, lower, *_) in METRICS.items():
        if upper:
            inside &= _value(m) <= F.col(f"{m}_high")
        if lower:
            inside &= _value(m) >= F.col(f"{m}_low")
    return counted.join(limits, same, "left").select(
        "doc_id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_stutter",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(inside).alias("kept"))


def op4_quality_rules(spark, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents")).drop("th")


def _sql() -> str:
    value = {m: f"({r[0]} * {r[2]}) // greatest({r[1]}, 1)" for m, r in METRICS.items()}
    cells = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' metric, v - v % (1::BIGINT << greatest(length(bin(v)) - {BITS}, 0)::INT) AS cell "
        f"FROM (SELECT lang, source, {v} v FROM counted WHERE NOT base_failed)" for m, v in value.items())
    quart = lambda name, groups: f"""{name} AS (SELECT {groups} metric, max(total) total, {", ".join(
        f"min(cell) FILTER (4 * upto >= {k} * total) q{k}" for k in (1, 2, 3))} FROM (
      SELECT *, sum(n) OVER (PARTITION BY {groups} metric ORDER BY cell) upto, sum(n) OVER (PARTITION BY {groups} metric) total
      FROM (SELECT {groups} metric, cell, sum(n) n FROM sketch GROUP BY {groups} metric, cell)) GROUP BY {groups} metric)"""  # noqa: E731
    slack = "CASE metric " + " ".join(f"WHEN '{m}' THEN {r[5]} * q2 // 100 + {r[6]}" for m, r in METRICS.items()) + " END"
    sides = ", ".join(f"max(q1 - reach) FILTER (metric = '{m}') {m}_low, max(q3 + reach) FILTER (metric = '{m}') {m}_high" for m in METRICS)
    rules = " AND ".join(f"{value[m]} <= {m}_high" + (f" AND {value[m]} >= {m}_low" if r[4] else "") for m, r in METRICS.items())
    pick = lambda k: f"CASE WHEN o.total >= {ENOUGH} THEN o.{k} WHEN v.total >= {ENOUGH} THEN v.{k} ELSE a.{k} END {k}"
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') t, row_number() OVER () rn FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM d),
win AS (SELECT rn, unnest(range(len(ws) - 6)) i, ws FROM w WHERE len(ws) >= 8),
hashed AS (SELECT rn, i, array_to_string(ws[i + 1:i + 8], ' ') h FROM win),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, h) c FROM hashed) WHERE c > 1),
cover AS (SELECT rn, sum(least(8, coalesce(nx - i, 8)))::BIGINT k FROM (
  SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) nx FROM twice) GROUP BY rn),
counted AS (SELECT doc_id, lang, source, len(ws)::BIGINT n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
  len(list_filter(ws, lambda x, i: x = ws[i - 1]))::BIGINT n_stutter, coalesce(k, 0) n_repeat_words, len(ws) < {MIN_WORDS} OR 100 * coalesce(k, 0) > 30 * len(ws) base_failed FROM w LEFT JOIN cover USING (rn)),
sketch AS (SELECT lang, source, metric, cell, count(*) n FROM ({cells}) GROUP BY ALL),
{quart("own", "lang, source,")}, {quart("by_lang", "lang,")}, {quart("by_all", "")},
picked AS (SELECT o.lang, o.source, o.metric, {", ".join(pick(f"q{k}") for k in (1, 2, 3))} FROM own o
  JOIN by_lang v ON o.lang IS NOT DISTINCT FROM v.lang AND o.metric = v.metric JOIN by_all a ON o.metric = a.metric),
fences AS (SELECT *, {FACTOR} * greatest(q3 - q1, {slack}) reach FROM picked),
limits AS (SELECT lang, source, {sides} FROM fences GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_stutter,
  CASE WHEN base_failed THEN false ELSE {rules} END kept
FROM counted c LEFT JOIN limits l ON c.lang IS NOT DISTINCT FROM l.lang AND c.source IS NOT DISTINCT FROM l.source"""


SQL = _sql()
