"""Full-text search over a token table, ranked by BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Token table: (key, token, tf, length). Write it once and search it many times."""
    words = docs.select(key, tokens(text).alias("w"))
    sized = words.withColumn("length", F.size("w"))
    return sized.select(key, "length", F.explode("w").alias("token")).groupBy(
        key, "length", "token").agg(F.count("*").alias("tf"))


def stats(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Number of documents and their mean length, one row."""
    return docs.select(F.size(tokens(text)).alias("length")).agg(
        F.count("*").alias("docs"), F.avg("length").alias("mean_length"))


WORD = r"[\p{L}\p{N}]+"


def words_of(query: str) -> list[str]:
    """Distinct lower-case words of a question, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def _counts(text: Column, terms: list[str]) -> Column:
    """Occurrences of each whole word: counted in place, no token array and no shuffle."""
    edge = r"[\p{L}\p{N}]"
    return F.array(*[
        F.regexp_count(text, F.lit(rf"(?<!{edge})\Q{t}\E(?!{edge})")) for t in terms])


def search(docs: DataFrame, key: str, text: Column, query: str, limit: int | None = 30,
           where: Column | None = None) -> DataFrame:
    """Documents holding every query word, best BM25 score first. A question without a word that is
    not blank is looked for as a substring, whatever its case, with score 0.

    The words of one question are counted inside each document, so the corpus is scanned once and
    only matching rows reach the sort. ``where`` is applied before the limit.
    """
    terms = words_of(query)
    low = F.lower(text)
    if not terms:
        asked = query.strip().lower()
        hits = docs.where(low.contains(asked) if asked else F.lit(False))
        hits = hits if where is None else hits.where(where)
        out = hits.withColumn("score", F.lit(0.0)).orderBy(key)
        return out.limit(limit) if limit else out
    scanned = docs.withColumns({
        "_len": F.regexp_count(low, F.lit(WORD)), "_tf": _counts(low, terms)})
    totals = scanned.agg(
        F.count("*").alias("n"), F.avg("_len").alias("avg"),
        *[F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    value = totals.first()  # one row of counts
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = value[f"df{i}"], F.col("_tf")[i]
        idf = F.log1p(F.lit((value["n"] - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (K1 + 1) / (
            tf + K1 * (1 - B + B * F.col("_len") / F.lit(value["avg"] or 1.0)))
    hits = scanned.where(F.forall("_tf", lambda n: n > 0))
    if where is not None:
        hits = hits.where(where)
    out = hits.withColumn("score", score).drop("_len", "_tf").orderBy(F.desc("score"), key)
    return out.limit(limit) if limit else out


def search_many(token_table: DataFrame, key: str, totals: DataFrame, questions: DataFrame,
                limit: int = 30) -> DataFrame:
    """The same for a table of questions (qid, token) against a stored token table.

    A question starts from the documents that hold its rarest token; its other tokens are looked up
    for those documents only, so a word that is everywhere never pairs all questions with all documents.
    """
    from riffle.operators.ranking import top_per_group

    asked = questions.select("qid", "token").distinct()
    wanted = token_table.join(asked.select("token").distinct(), "token", "left_semi")
    df = wanted.groupBy("token").agg(F.count("*").alias("df"))
    known = asked.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = known.groupBy("qid").agg(F.min(F.struct("df", "token")).alias("r"), F.count("*").alias("need"))
    start = first.where("r.df > 0").select("qid", "need", F.col("r.token").alias("token"))
    found = wanted.select("token", key).join(start, "token").select("qid", "need", key)
    n, avg = totals.select("docs").scalar(), totals.select("mean_length").scalar()
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / avg))
    probes = found.join(known, "qid")
    total = probes.join(wanted, ["token", key]).groupBy("qid", key, "need").agg(
        F.sum(part).alias("score"), F.count("*").alias("n"))
    full = total.where("n = need").select("qid", key, "score")
    # equal documents may differ in the last bits, by the order their parts were added in
    return top_per_group(full, ["qid"], [F.desc(F.round("score", 9)), F.col(key)], limit, "rank")
