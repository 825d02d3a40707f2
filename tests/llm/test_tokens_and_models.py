"""Token files, packing, language and quality models."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm.language_id import fitted as fit_language
from riffle.llm.language_id import ngrams, op9_language_id, predicted
from riffle.llm.packing import best_boundaries, op8_packing, packed, token_counts
from riffle.llm.quality_model import curve, dual_descent, features, op10_quality_classifier, scored, trained_on
from riffle.llm.quality_model import fitted as fit_quality
from riffle.llm.token_files import Encoder, op7_token_files, read_ids, tokenizer_path, unpacked, write_ids
from riffle.llm.token_files import packed as coded

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = ["<|endoftext|> A.<|STARTOFTEXT|>, don't. İstanbul! ΑΣ. x²: é. 'S!? .. a.'s \t b\x1cC", "", ".", "\n \n", "É,É", "é.", "中文,a b", "a...b?!c;;", "'ll 'LL it's IT'S.", "ßª.", "퟿\U0001f600!"]


def test_pieces_give_the_ids_of_whole_texts():
    coder = Encoder(tokenizer_path())
    for other in (coder, Encoder(tokenizer_path())):
        ids, counts = other.encode(ODD)
        want = [other.tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 4001])
def test_codes_come_back(n):
    pick = np.random.default_rng(n)
    ranks = (pick.integers(0, 2**32, n) >> pick.integers(0, 32, n)).astype(np.uint32)
    control, data = coded(ranks)
    assert np.array_equal(unpacked(control, data, n), ranks) and len(control) == -(-n // 4)
    assert len(data) == sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks)


def slow_ids(rows):
    coder = Encoder(tokenizer_path())
    start, out = 0, []
    for i, t in rows:
        ids = np.array([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (7000, "word " * 3000), (50, "later"), (51, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("n", F.lit("z"))
    write_ids(df, f"{tmp_path}/a", block=500)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in read_ids(spark, f"{tmp_path}/a").collect())
    assert got == slow_ids(sorted(rows))
    write_ids(df.limit(0), f"{tmp_path}/b")
    assert read_ids(spark, f"{tmp_path}/b").count() == 0
    twice = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    write_ids(twice, f"{tmp_path}/c")
    rows = read_ids(spark, f"{tmp_path}/c").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1] and sum(r.n_tokens for r in rows) == 7


def test_token_file_query(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in op7_token_files(spark, SMALL).collect()) == slow_ids(rows)


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    pick = random.Random(seed)
    lengths = sorted(pick.sample(range(1, 60), 9))
    counts = [pick.randint(1, 50) for _ in lengths]
    for k in (1, 2, 3, 9, 20):
        ends, padding = best_boundaries(np.array(lengths), np.array(counts), k)
        cost = lambda e: sum(c * (min(x for x in e if x >= n) - n) for n, c in zip(lengths, counts))
        tries = [cost([*e, lengths[-1]]) for m in range(min(k, 9)) for e in itertools.combinations(lengths[:-1], m)]
        assert padding == min(tries) == cost(ends) and len(ends) <= k and ends[-1] == lengths[-1]
    assert best_boundaries(np.array([], int), np.array([], int), 3) == ([], 0)


def test_batches_hold_every_token_once_within_the_budget(spark):
    pick = random.Random(3)
    sizes = [0, None, 1, 64, 65, 640] + [pick.choice([3, 3, 3, 20, 21, 63, 64, 150]) for _ in range(400)]
    rows = [(None if i == 9 else i, 7, n) for i, n in enumerate(sizes)] + [(2, 7, 1)]
    got = packed(spark.createDataFrame(rows, "doc_id long, th long, n_tokens long").withColumn("batch", F.lit(1)), buckets=4, greatest=64, budget=200).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for *_, n in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got) and len({r.bucket for r in got}) <= 4
    for b in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == b]
        per = 200 // b
        assert sorted(r.batch * per + r.slot for r in own) == list(range(len(own))) and all(r.slot < per and r.n_tokens <= b for r in own)
        assert [r.doc_id is not None and r.doc_id for r in sorted(own, key=lambda r: (r.batch, r.slot))] == sorted(r.doc_id is not None and r.doc_id for r in own)
    assert all(r.start == r.piece * 64 for r in got)
    lengths = np.array([r.n_tokens for r in got])
    ends = best_boundaries(*np.unique(lengths, return_counts=True), 4)
    assert sorted({r.bucket for r in got}) == ends[0] and sum(r.bucket - r.n_tokens for r in got) == ends[1]
    with pytest.raises(ValueError):
        packed(spark.createDataFrame(rows, "doc_id long, th long, n_tokens long"), greatest=100, budget=99)
    assert packed(spark.createDataFrame([], "doc_id long, th long, n_tokens long")).count() == 0


def test_packing_query(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    coder = Encoder(tokenizer_path())
    want = {r.doc_id: len(coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in texts}
    got = {}
    for r in op8_packing(spark, SMALL).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == want and token_counts(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0].n_tokens == 1


def test_ngrams_do_not_depend_on_neighbours():
    texts = ["Abc dé", "", "  \0 ", "x", "Abc dé"]
    found, counts = ngrams(texts)
    ends = np.cumsum(counts)
    for t, c, e in zip(texts, counts, ends):
        assert sorted(ngrams([t])[0].tolist()) == sorted(found[e - c:e].tolist()) and c == ngrams([t])[1][0]


def slow_language(train, texts):
    """The same model from a dictionary of counts."""
    langs = sorted({x for _, x in train})
    counts = {x: np.full(1 << 15, 0.5) for x in langs}
    for t, x in train:
        np.add.at(counts[x], ngrams([t])[0], 1)
    out = []
    for t in texts:
        g = ngrams([t])[0]
        prior = np.array([np.log(sum(x == y for _, y in train) / len(train)) for x in langs])
        own = np.array([np.log(counts[x] / counts[x].sum())[g].sum() for x in langs])
        top = int(np.argmax(prior + own))
        logs = prior + own * min(1, 100 / len(g))
        out.append((langs[top], np.exp(logs[top]) / np.exp(logs).sum() if logs.max() > -600 else np.exp(logs[top] - logs.max()) / np.exp(logs - logs.max()).sum()))
    return out


def test_language_model_against_plain_counts(spark):
    train = [("the house is here", "en"), ("das haus ist hier", "de"), ("la casa es aqui", "es"), ("the cat", "en"), ("der hund", "de"), ("été la maison", "fr")]
    texts = ["the", "hund und haus", "casa", "maison é", "zzz", "a" * 5000]
    df = spark.createDataFrame([*train, ("no language", None), (None, "en")], "text string, lang string")
    model = fit_language(df)
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "123 !?"), (None, "the cat")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predicted(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")), model).collect()}
    for i, (lang, score) in enumerate(slow_language([*train, ("", "en")], texts)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4
    assert got[50] == got[51] == got[52] == ("und", 0.0) and got[None][0] == "en"
    for text in ("\u00bd", "\u00b2 \u2460", "_1_"):
        one = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert predicted(one, model).first().lang_pred == "und"
    nothing = fit_language(df.limit(0))
    assert {r.lang_pred for r in predicted(spark.createDataFrame(rows, "doc_id long, text string"), nothing).collect()} == {"und"}


def test_much_text_outweighs_a_common_language(spark):
    """A long text that speaks for a rare language by a little an n-gram gets it, whatever the prior."""
    train = [("ab " * 40, "common")] * 400 + [("ab " * 8000 + "abx " * 8000, "rare")]
    model = fit_language(spark.createDataFrame(train, "text string, lang string"))
    texts = [("ab " * k + "abx ") * (4000 // k) for k in (1, 5, 12, 14, 16, 18, 40)]
    want = slow_language(train, texts)
    rows = predicted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == [lang for lang, _ in want] and all(abs(r.score - s) < 1e-3 for r, (_, s) in zip(rows, want))
    assert any(lang == "rare" and score < 0.5 for lang, score in want)  # the scaled evidence alone would have said common


def test_language_accuracy_on_held_out_rows(spark):
    d = op9_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    r = d.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right"), F.count("*").alias("n"), F.min("score"), F.max("score")).collect()[0]
    assert r.n > 150 and r.right > 0.98 and 0 <= r[2] <= r[3] <= 1


def test_features_are_distinct_and_see_pairs():
    a, b, c, d = features(["one two", "one two", "two one", "one  two!! one"])
    assert np.array_equal(a, b) and len(a) == 3 and len(set(a) & set(c)) == 2 and set(a) < set(d) and (np.diff(d) > 0).all()
    assert len(features(["x x x x"])[0]) == 2 and len(features([""])[0]) == 0


def test_dual_descent_reaches_the_optimum():
    pick = np.random.default_rng(1)
    scale = pick.normal(size=30)
    rows = [np.unique(pick.integers(0, 30, 8)).astype(np.uint32) for _ in range(60)]
    signs = np.where(pick.random(60) < 0.5, 1.0, -1.0)
    dense = np.zeros((60, 31))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r] / np.sqrt(len(r))
        dense[i, 30] = 1
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - signs * (dense @ w)).sum()
    w = dual_descent(rows, scale, signs, passes=2000)
    slow = np.zeros(31)
    for t in range(1, 40_000):
        g = slow - (signs * (1 - signs * (dense @ slow) > 0)) @ dense
        slow -= g / (t + 20)
    assert loss(w) <= 1.001 * loss(slow)
    slope, offset = curve(np.array([-2.0, -1, 0, 1, 2, 3]), np.array([0.0, 0, 1, 0, 1, 1]))
    assert slope > 0 and np.isfinite(offset)


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = op10_quality_classifier(spark, FOLDER).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.93 and all(0 <= r.score <= 1 for r in rows)


def test_quality_with_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, "bad $$$ junk"), (3, None), (4, ""), (None, "good"), (5, "good text"), (5, "good text")], "doc_id long, text string").withColumn("label", F.lit("z"))
    labels = spark.createDataFrame([(i, q, 0) for i, q in [(1, 1), (2, 0), (2, 0), (5, 1), (3, None), (99, 1), (None, 0)]], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0), labels.filter("quality = 1")):
        out = scored(docs, trained_on(docs, marks)).collect()
        assert len(out) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    many = spark.createDataFrame([(i, ("fine words " if i % 2 else "$$ bad ") * 3, i % 2) for i in range(60)], "doc_id long, text string, label int")
    model = fit_quality(many)
    assert {r.doc_id % 2 == r.predicted for r in scored(many, model).collect()} == {True}
    assert scored(docs.limit(0), model).count() == 0
