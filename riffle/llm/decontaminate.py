"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens: positions marked 1 are hashed, positions marked 0 are
ignored, so a replaced token at an ignored position does not hide a match. Three masks of weight 6 over
8 to 11 tokens ignore different positions; in a simulation they hit every 20 tokens with 4 replaced, every
14 with 2 and 89 of 100 stretches of 11 with 2. Seed hashes of test items and of training documents are
joined; every hit fixes a diagonal (document position less item position), and along each diagonal the
tokens are compared one by one. An overlap is a stretch of ``span`` tokens (the whole item, if shorter)
in which at least ``least`` percent agree: replaced tokens anywhere in it are tolerated.

Only built-in functions are used. Documents are exploded into hashes alone, and the join with the
items' hashes comes before any shuffle as long as these are few enough to broadcast (counted first). Hits become
one row per (document, item, diagonal) in a partial aggregation. Only documents with hits are read anew
for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.llm.shared import table, text_hash, written

MASKS = ("11101011", "1100110101", "11010010011")
SPAN = 20
LEAST = 80
FEWEST = 5
#: Seeds of the items that are broadcast at most, some 30 bytes each; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
TOKEN = "[^\\p{L}\\p{N}]+"


def tokens(text: str = "text") -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TOKEN), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _masked(toks: str, number: int, care: list[int]):
    return lambda i: F.xxhash64(F.lit(number), *[F.get(F.col(toks), i + k) for k in care])


def _seeds(toks: str, masks=MASKS) -> Column:
    """Structs (h, at) of every mask at every position, as one array."""
    n = F.size(toks)
    parts = []
    for number, mask in enumerate(masks):
        care = [k for k, x in enumerate(mask) if x == "1"]
        hashes = F.transform(F.sequence(F.lit(0), n - len(mask)), _masked(toks, number, care))
        parts.append(F.when(n >= len(mask), hashes).otherwise(F.array().cast("array<long>")))
    return F.array(*parts)


def _exploded(df: DataFrame, *keys: str) -> DataFrame:
    """keys, h, at: a row for every seed."""
    one = df.select(*keys, F.explode(_seeds("toks")).alias("hashes"))
    return one.select(*keys, F.posexplode("hashes").alias("at", "h"))


def overlaps(docs: DataFrame, items: DataFrame, masks=MASKS, span: int = SPAN, least: int = LEAST) -> DataFrame:
    """One row per pair of a document and an item that overlap: doc_id, th, item_id, n_matched (equal
    tokens of the best stretch), stretch (its tokens), start (its first token in the document).

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are not read. Null and
    empty texts overlap with nothing; items too short for the shortest mask are held against documents
    as whole token runs. Rows that repeat give one row. Ties: the first stretch, then the least diagonal.
    """
    test = items.select("item_id", tokens().alias("toks")).filter(F.size("toks") > 0).distinct()
    train = docs.select("doc_id", text_hash().alias("th"), tokens().alias("toks"))
    shortest = min(map(len, masks))
    seeds = written(_exploded(test.filter(F.size("toks") >= shortest), "item_id").select("h", "item_id", F.col("at").alias("item_at")).distinct())
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    hits = (_exploded(train, "doc_id", "th").join(seeds, "h")
            .select("doc_id", "th", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    short = test.filter((F.size("toks") < shortest) & (F.size("toks") >= FEWEST))
    if sizes := [r.n for r in short.select(F.size("toks").alias("n")).distinct().collect()]:  # below the shortest mask: a few
        hits = hits.unionByName(_brief(train, short, sizes))
    hits = written(hits)
    hit_docs = hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    again = train.join(hit_docs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "th"])
    both = (hits.alias("h").join(again.alias("x"), F.col("h.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("h.th") == F.col("x.th")))
            .join(test.alias("y"), F.col("h.item_id").eqNullSafe(F.col("y.item_id"))))
    lo = F.greatest(F.col("diagonal"), F.lit(0))
    hi = F.least(F.size("x.toks"), F.col("diagonal") + F.size("y.toks"))
    cut = both.select(
        "h.doc_id", "h.th", "h.item_id", "diagonal", lo.alias("lo"), F.size("y.toks").alias("n_item"),
        F.slice("x.toks", lo + 1, F.greatest(hi - lo, F.lit(0))).alias("ours"),
        F.slice("y.toks", lo - F.col("diagonal") + 1, F.greatest(hi - lo, F.lit(0))).alias("theirs"))
    same = F.transform(F.arrays_zip("ours", "theirs"), lambda z: (z["ours"] == z["theirs"]).cast("int"))
    cut = cut.select("doc_id", "th", "item_id", "diagonal", "lo", F.least("n_item", F.lit(span)).alias("stretch"), same.alias("same"))
    cut = cut.filter(F.size("same") >= F.col("stretch"))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("stretch")),
                       lambda i: F.struct(F.aggregate(F.slice("same", i + 1, F.col("stretch")), F.lit(0), lambda a, x: a + x).alias("m"), (-i).alias("back")))
    best = cut.withColumn("best", F.array_max(sums)).filter(F.col("best.m") * 100 >= F.col("stretch") * least)
    row = F.struct(F.col("best.m").alias("m"), (-F.col("diagonal")).alias("d"), (F.col("lo") - F.col("best.back")).alias("start"), "stretch")
    return best.groupBy("doc_id", "th", "item_id").agg(F.max(row).alias("r")).select(
        "doc_id", "th", "item_id", F.col("r.m").cast("long").alias("n_matched"), F.col("r.stretch").cast("long").alias("stretch"), F.col("r.start").cast("long").alias("start"))


def _brief(train: DataFrame, short: DataFrame, sizes: list[int]) -> DataFrame:
    """Diagonals of items below the shortest mask, found by the hash of their whole token run."""
    whole = short.select("item_id", F.size("toks").alias("n"), F.xxhash64("toks").alias("h"))
    runs = (train.select("doc_id", "th", "toks", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n")).filter(F.size("toks") >= F.col("n"))
            .select("doc_id", "th", "n", F.posexplode(F.transform(
                F.sequence(F.lit(0), F.size("toks") - F.col("n")), lambda i: F.xxhash64(F.slice("toks", i + 1, F.col("n"))))).alias("at", "h")))
    return runs.join(whole, ["n", "h"]).select("doc_id", "th", "item_id", F.col("at").alias("diagonal")).distinct()


def without_benchmark(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The input's rows and columns without the documents that overlap with an item."""
    found = overlaps(docs, items, **options).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__th"))
    return docs.join(found, same, "left_anti")


def op5_decontaminate(spark, folder: str) -> DataFrame:
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("th")


def _seed_sql(source: str, key: str) -> str:
    parts = []
    for number, mask in enumerate(MASKS):
        care = ", ".join(f"toks[i + {k + 1}]" for k, x in enumerate(mask) if x == "1")
        parts.append(f"SELECT {key}, {number} AS m, i, array_to_string([{care}], ' ') AS k FROM (SELECT {key}, toks, "
                     f"unnest(range(0, len(toks) - {len(mask) - 1})) AS i FROM {source} WHERE len(toks) >= {len(mask)})")
    return " UNION ALL ".join(parts)


_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
#: For items of at least as many tokens as the shortest mask has, which the benchmark's all have.
SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, {_TOKENS} AS toks FROM documents),
t AS (SELECT DISTINCT item_id, {_TOKENS} AS toks FROM benchmark),
h AS (SELECT DISTINCT doc_id, item_id, x.i - y.i AS g FROM ({_seed_sql('d', 'doc_id')}) x JOIN ({_seed_sql('t', 'item_id')}) y ON x.m = y.m AND x.k = y.k),
z AS (SELECT h.*, d.toks AS a, t.toks AS b, greatest(g, 0) AS lo, least(len(d.toks), g + len(t.toks)) AS hi, least(len(t.toks), {SPAN}) AS n
  FROM h JOIN d USING (doc_id) JOIN t USING (item_id)),
s AS (SELECT doc_id, item_id, g, lo, n, list_transform(range(lo, hi), lambda k: CAST(a[k + 1] = b[k - g + 1] AS INT)) AS same FROM z WHERE hi - lo >= n),
v AS (SELECT *, list_transform(range(0, len(same) - n + 1), lambda i: list_sum(same[i + 1:i + n])) AS sums FROM s),
m AS (SELECT doc_id, item_id, g, lo, n, list_max(sums) AS best, lo + list_position(sums, list_max(sums)) - 1 AS start FROM v)
SELECT doc_id, item_id, CAST(best AS BIGINT) AS n_matched, CAST(n AS BIGINT) AS stretch, CAST(start AS BIGINT) AS start
FROM m WHERE best * 100 >= n * {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, g) = 1"""
