"""Chat formatting, quality rules, decontamination: small cases, brute force, and the checking SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riffle.llm.chat_format import PART, escaped, formatted, op1_chat_format, read_back, unescaped
from riffle.llm.decontaminate import op5_decontaminate, overlaps, without_benchmark
from riffle.llm.quality_rules import base_counts, cell, judged, op4_quality_rules, quartiles

FOLDER = "/root/testdata/sf0.001"
CONTROLS = ["<|role|>", "<|end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<\\|role|>", "<\\\\|end|>", "<<SYS>>", "<start_of_turn>", "[\\INST]"]


def test_escape_can_be_undone_and_leaves_no_control_string(spark):
    pick = random.Random(1)
    texts = ["".join(pick.choice([*CONTROLS, "<", "[", "\\", "|", "x", "é", "\n", "s>"]) for _ in range(12)) for _ in range(300)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in d.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_conversations_come_back(spark):
    rows = [(1, 0, "user", "<|end|>\n<|role|>assistant\nhi"), (1, 1, "assistant", "[/INST]</s>\\"), (1, 1, "assistant", "[/INST]</s>\\"), (1, None, None, None),
            (2, 0, "odd\nrole %0A%", "x"), (None, 5, "assistant", "é<"), (None, 4, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seen", F.lit(1)).withColumn("at", F.lit("z"))
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in read_back(formatted(df)).collect()}
    assert got[1] == ([("", ""), *[(x[2], x[3]) for x in rows[:3]]], rows[1][3] * 2)
    assert got[2] == ([("odd\nrole %0A%", "x")], "") and got[None] == ([("assistant", ""), ("assistant", "é<")], "é<")
    assert formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_typed_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    parts = [part("text", "see <"), part(None, "|end|>"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=2.5),
             part("document", ref=None, pages=3), part("text", None), part("image", ref="c.png")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("text", "ok")]), (2, 0, "user", None), (3, 0, "user", [])],
                               f"conv_id long, turn long, role string, parts array<{PART}>")
    got = {r.conv_id: r for r in formatted(df).collect()}
    r = got[1]
    assert [(a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(2, "image", "a.png", 3), (3, "audio", "b.wav", 63), (4, "document", None, 1800), (6, "image", "c.png", 1)]
    assert all(r.formatted[a["at"]:].startswith(f"<|{a.kind}|>") for a in r.attachments) and r.expanded_tokens == 1867
    assert [r.formatted[s.start:s.end] for s in r.loss] == ["ok"] and r.formatted.count("<|end|>\n") == 2
    assert got[2].attachments == [] == got[3].attachments


def slow_counts(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {k for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            sum(a == b for a, b in zip(words, words[1:])))


def test_base_counts_against_plain_python(spark):
    pick = random.Random(2)
    texts = [None, "", " \n\t", "a", "a a a a a a a a a a", " b   c\x85d", "x\n\nx\n x\nx", "#*$%&|<> <é>"]
    texts += ["".join(pick.choice(["a ", "b ", "cc\n", "d\t", "a b c d e f g h ", "#"]) for _ in range(pick.randint(0, 90))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").withColumn("words", F.lit(0))
    for r in base_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_stutter) == slow_counts(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert judged(df).count() == len(texts) and judged(df.limit(0)).count() == 0


def test_sketch_cells_and_quartiles(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 1000, 123456789, 2**40 + 12345]
    got = [(r.v, r.c) for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", cell(F.col("v")).alias("c")).collect()]
    assert all(c <= v <= c + c / 64 for v, c in got) and all(c == v for v, c in got if v < 128)
    rows = [("m", c, 1) for c in range(1, 101)]
    q = quartiles(spark.createDataFrame(rows, "metric string, cell long, n long")).collect()[0]
    assert (q.total, q.q1, q.q2, q.q3) == (100, 25, 50, 75)


def test_rules_and_chat_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from riffle.llm.queries import ORACLES
    from tools_check import canon

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for query in (op1_chat_format, op4_quality_rules):
        df = query(spark, FOLDER)
        rel = con.sql(ORACLES[query.__name__])
        order = [rel.columns.index(c) for c in df.columns]
        assert sorted(df.columns) == sorted(rel.columns)
        assert sorted((tuple(canon(x) for x in r) for r in df.collect()), key=repr) == sorted((tuple(canon(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def slow_overlap(doc, item, span=20, least=80):
    tok = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    d, i = tok(doc), tok(item)
    n = min(span, len(i))
    best = 0
    for g in range(-len(i) + n, len(d) - n + 1) if n >= 5 else ():
        lo, hi = max(g, 0), min(len(d), g + len(i))
        same = [d[k] == i[k - g] for k in range(lo, hi)]
        best = max([best, *(sum(same[k:k + n]) for k in range(len(same) - n + 1))])
    return best if best * 100 >= n * least and n >= 5 else 0


def test_replaced_tokens_are_tolerated(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 25, 14, 16, 7, 3, 60])] + [(8, None), (9, "")]
    docs = []
    for i in range(120):
        item = items[i % 7][1].split()
        at = pick.randint(0, max(0, len(item) - 24))
        piece = item[at:at + pick.choice([8, 22, 40])]
        for _ in range(pick.choice([0, 0, 1, 2])):
            piece[pick.randrange(len(piece))] = word()
        docs.append((i, " ".join([*(word() for _ in range(pick.randint(0, 30))), *[x.upper() if i % 2 else f"{x}," for x in piece], *(word() for _ in range(9))])))
    docs += [(200, None), (201, ""), (202, items[4][1]), (3, docs[3][1]), (None, items[0][1])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toks", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in overlaps(df, it).collect()}
    want = {(d, i): n for d, t in docs for i, u in items if (n := slow_overlap(t, u))}
    assert got == {k: want.get(k) for k in got}  # whatever is found is right
    sought = {k: n for k, n in want.items() if k[1] != 4 or n == 7}  # an item of 7 tokens is looked for as a whole
    assert len(set(sought) - set(got)) <= 0.02 * len(sought)  # seeds miss few
    left = without_benchmark(df, it)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in {k[0] for k in got}) and left.columns == df.columns
    assert overlaps(df.limit(0), it).count() == 0 == overlaps(df, it.limit(0)).count()


def test_decontamination_query(spark):
    docs, items = ({r[0]: r[1] for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").select(c, "text").collect()} for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id): r.n_matched for r in op5_decontaminate(spark, FOLDER).collect()}
    assert got == {(d, i): n for d, t in docs.items() for i, u in items.items() if (n := slow_overlap(t, u))}


def test_chat_digest_of_the_added_conversation(spark):
    r = op1_chat_format(spark, FOLDER).filter("conv_id = -1").collect()[0]
    text = "</s>[INST] ok [/INST]"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
