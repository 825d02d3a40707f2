"""Text operators over the document, page and conversation tables."""

from pyspark.sql import functions as F

from riffle.catalog.registry import query
from riffle.functions import text as X
from riffle.operators import search as Se
from riffle.operators.aggregates import longest_per_key

WORDS = [("tion", "tion fish"), ("heron", "great bass"), (" the ", "the"), ("ing", "ing"),
         ("and", "bass"), ("que", "que")]
PLACES = ["ation", "ertion", "eux", "und", "ing of", "with the"]

_HITS = ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{n}' END" for w, n in WORDS)


@query("j1_species_tags", f"""
    SELECT tags, count(*) AS n FROM (SELECT array_to_string(CASE WHEN list_contains(l, 'great bass')
        THEN list_filter(l, lambda x: x <> 'bass') ELSE l END, '|') AS tags FROM (
      SELECT list_filter([{_HITS}], lambda x: x IS NOT NULL) AS l FROM documents)) GROUP BY 1""")
def _(t):
    tags = F.array_join(X.tag_species(F.col("text"), WORDS), "|")
    return t.documents.groupBy(tags.alias("tags")).agg(F.count("*").alias("n"))


@query("j2_place_tags", f"""
    SELECT tags, count(*) AS n FROM (SELECT array_to_string(list_filter([{', '.join(
        f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in PLACES)}],
      lambda x: x IS NOT NULL), '|') AS tags FROM conversations) GROUP BY 1""")
def _(t):
    tags = F.array_join(X.tag_places(F.col("text"), PLACES), "|")
    return t.conversations.groupBy(tags.alias("tags")).agg(F.count("*").alias("n"))


@query("j3_jurisdiction_of_post", """
    SELECT place, count(*) AS n FROM (SELECT CASE WHEN contains(sub, 'ontario') OR contains(body, 'ontario')
        THEN 'CA-ON' WHEN contains(sub, 'canada') OR contains(body, 'canada') THEN 'CA' END AS place
      FROM (SELECT CASE WHEN source = 'src1' THEN 'ontariofishing' WHEN source = 'src2' THEN 'fishingcanada'
        ELSE lower(source) END AS sub, lower(text) AS body FROM documents)) GROUP BY 1""")
def _(t):
    sub = F.when(F.col("source") == "src1", "OntarioFishing").when(
        F.col("source") == "src2", "FishingCanada").otherwise(F.col("source"))
    return t.documents.groupBy(X.infer_jurisdiction(sub, F.col("text")).alias("place")).agg(
        F.count("*").alias("n"))


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("j4_full_text_search", f"""
    WITH d AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS t1,
        len(list_filter(w, lambda x: x = 'ing')) AS t2 FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
      s AS (SELECT count(*) AS docs, avg(n) AS avgn, count(*) FILTER (WHERE t1 > 0) AS d1,
        count(*) FILTER (WHERE t2 > 0) AS d2 FROM d)
    SELECT doc_id, round(ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / avgn))
      + ln(1 + (docs - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / avgn)), 6) AS score
    FROM d JOIN s ON true WHERE t1 > 0 AND t2 > 0 ORDER BY score DESC, doc_id LIMIT 30""")
def _(t):
    found = Se.search(t.documents, "doc_id", F.col("text"), "the ing", None)
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(
        F.desc("score"), "doc_id").limit(30)


@query("j4_search_many_questions", f"""
    WITH p AS (SELECT doc_id, len(w) AS n, unnest(w) AS token FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
      tf AS (SELECT doc_id, n, token, count(*) AS tf FROM p GROUP BY 1, 2, 3),
      s AS (SELECT count(*) AS docs, avg(len({_TOK})) AS avgn FROM documents),
      q AS (SELECT DISTINCT item_id AS qid, unnest({_TOK}) AS token FROM benchmark),
      need AS (SELECT qid, count(*) AS need FROM q GROUP BY 1),
      df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
      sc AS (SELECT qid, doc_id, count(*) AS c, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * n / avgn))) AS score
        FROM q JOIN tf USING (token) JOIN df USING (token) JOIN s ON true GROUP BY 1, 2)
    SELECT qid, doc_id, round(score, 6) AS score FROM (SELECT sc.*, row_number() OVER
        (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rn FROM sc JOIN need USING (qid)
        WHERE c = need) WHERE rn <= 10""")
def _(t):
    text = F.col("text")
    table = Se.postings(t.documents, "doc_id", text)
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.explode(
        Se.tokens(text)).alias("token"))
    found = Se.search_many(table, "doc_id", Se.stats(t.documents, "doc_id", text), asked, 10)
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"))


def regulation_texts(t):
    zone = lambda m, s: ((F.col("doc_id") * m + s) % 25).cast("string")
    return t.documents.select("doc_id", F.concat(
        F.lit("Preamble FISHERIES MANAGEMENT ZONE "), zone(1, 0), F.lit(" "), F.col("text"),
        F.lit(" FMZ "), zone(7, 3), F.lit(" end "), F.col("text")).alias("raw"))


@query("j5_header_chunks", """
    WITH c AS (SELECT doc_id * 2 AS k, doc_id % 25 AS zone, trim('FISHERIES MANAGEMENT ZONE ' ||
        CAST(doc_id % 25 AS VARCHAR) || ' ' || text || ' ', ' ') AS txt FROM documents UNION ALL
      SELECT doc_id * 2 + 1, (doc_id * 7 + 3) % 25, trim('FMZ ' || CAST((doc_id * 7 + 3) % 25 AS VARCHAR) ||
        ' end ' || text, ' ') FROM documents)
    SELECT CAST(zone AS INTEGER) AS zone, md5(txt) AS digest, CAST(length(txt) AS BIGINT) AS char_count FROM (
      SELECT *, row_number() OVER (PARTITION BY zone ORDER BY length(txt) DESC, k) AS rn FROM c
      WHERE zone BETWEEN 1 AND 20) WHERE rn = 1""")
def _(t):
    chunks = regulation_texts(t).select(
        "doc_id", F.posexplode(X.zone_chunks("raw")).alias("i", "c"))
    # the tie rule is the order of appearance
    rows = chunks.select(F.struct("doc_id", "i").alias("k"), "c.zone", "c.text")
    best = longest_per_key(rows, "zone", "text", "k")
    return best.select("zone", F.md5("text").alias("digest"), "char_count")


def _in_context(word: str) -> str:
    return f"""
    WITH d AS (SELECT doc_id, text, length(text) AS n, string_split(lower(text), '{word}') AS p FROM documents),
    spots AS (SELECT *, list_transform(generate_series(1, least(len(p) - 1, 5)),
        lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + {len(word)} * (k - 1)) AS spot FROM d WHERE len(p) > 1),
    cuts AS (SELECT *, list_transform(spot, lambda a: [{{'s': greatest(a - 600, 0), 'e': least(a + {len(word)} + 600, n)}}]) AS r FROM spots),
    kept AS (SELECT *, list_reduce(r, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k.s - x[1].s) < 600)) > 0
        THEN acc ELSE list_concat(acc, x) END) AS k FROM cuts),
    found AS (SELECT doc_id, array_to_string(list_transform(k, lambda x: CASE WHEN x.s > 0 THEN '…' ELSE '' END
        || trim(substr(text, CAST(x.s + 1 AS BIGINT), CAST(x.e - x.s AS BIGINT))) || CASE WHEN x.e < n THEN '…' ELSE '' END),
        chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS j FROM kept)
    SELECT doc_id, md5(left(j, 3000)) AS digest, length(j) > 3000 AS truncated FROM found
    UNION ALL SELECT doc_id, md5(left(text, 2000) || chr(10) || chr(10) || '[Note: ''{word}'' not found by exact name in this zone''s text. '
        || 'The species may appear under a different name or may not have special rules listed (general limits apply). Full zone overview shown above.]'),
      n > 2000 FROM d WHERE text IS NULL OR len(p) <= 1"""


@query("j6_keyword_in_context", _in_context("heron"))
def _(t):
    found = X.keyword_context(F.col("text"), F.lit("heron"))
    return t.documents.select("doc_id", found.alias("f")).select(
        "doc_id", F.md5("f.text").alias("digest"), "f.truncated")


@query("j6_frequent_keyword_in_context", _in_context("ing"))
def _(t):
    """A keyword that occurs many times in a text, so that snippets overlap and are left out."""
    found = X.keyword_context(F.col("text"), F.lit("ing"))
    return t.documents.select("doc_id", found.alias("f")).select(
        "doc_id", F.md5("f.text").alias("digest"), "f.truncated")


@query("j7_truncate", """
    SELECT doc_id, md5(substr(text, 1, 2000)) AS digest, length(text) > 2000 AS truncated FROM documents""")
def _(t):
    head, cut_ = X.truncated("text", 2000)
    return t.documents.select("doc_id", F.md5(head).alias("digest"), cut_.alias("truncated"))


@query("j8_post_output", """
    SELECT conv_id, turn, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END
      AS body FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", X.shorten("text").alias("body"))
