"""Secrets in texts: fixed patterns, and an assignment-aware lexer that adds what patterns alone miss.

The lexer reads source and configuration syntax into (name, value) pairs: assignments with =, :=, =>, +=, typed or
not, mappings (JSON, YAML, dictionaries, indexed items), XML elements, macros, command line options, calls with a
name and a string, and name/value entries. A value is a chain of literals and references joined by +, ., || or ??,
or standing side by side; a call is looked through only if it hands its argument on (decoding, trimming). Constants are
propagated: a reference stands for the last value given to its name before it, or else for the first one after it,
through any number of steps. A literal that reaches a sensitive name is scored by that name (which words it is made of,
and whether it names a thing about a secret, such as its length or file) times the literal (bits of entropy; none for
placeholders), and is reported from ``THRESHOLD`` on.

Kinds: ``assign``, ``access`` and ``hex`` are the fixed patterns; ``named`` is a literal given to a sensitive name
directly, ``flow`` one that reaches it through other names. A literal inside a pattern's span is not reported again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from riffle.llm.flat import text_slices
from riffle.llm.shared import table

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

KINDS = ("assign", "access", "hex", "named", "flow")
THRESHOLD = 0.5
#: How surely a name of these words holds a secret; words of a name are also tried in neighbouring pairs.
WEIGHTS = {
    **dict.fromkeys(("password", "passwd", "passphrase", "pwd", "secret", "secrets", "apikey", "accesskey", "secretkey", "privatekey",
                     "signingkey", "encryptionkey", "masterkey", "authkey", "authtoken", "credential", "credentials", "passcode"), 1.0),
    **dict.fromkeys(("token", "bearer", "pass", "auth", "authorization", "cred", "creds", "otp", "salt", "dsn", "connectionstring"), 0.75),
}
#: Words that make a name speak about a secret instead of holding it.
ABOUT = frozenset(("count", "length", "len", "size", "limit", "max", "min", "url", "uri", "path", "file", "filename", "dir", "name", "field",
                   "label", "type", "prompt", "hint", "policy", "expiry", "expires", "ttl", "age", "regex", "pattern", "header", "param", "column",
                   "table", "format", "error", "message", "enabled", "required", "strength", "public", "endpoint", "help", "title", "description"))
PLACEHOLDER = re.compile(r"(?i)(?:[x*.#_?-]+|<.*>|\$.*|%.*%|\{.*\}|\[.*\]|none|null|nil|true|false|undefined|change.?(?:me|it)|(?:your|my|the|some)[\W_].*|example.*|"
                         r"test(?:ing)?|dummy.*|placeholder|redacted.*|todo|tbd|secret|password|passwd|token|string|https?://.*)")
GATE = re.compile(r"(?i)pass|pwd|secret|token|key|cred|auth|bearer|otp|salt|dsn|connection.?string")
QUOTED = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"""
SITE = re.compile(rf"""
    (?<![\w$.\-]) (?P<target>{QUOTED} | [A-Za-z_$][\w$.\-]*+ (?:\[\s*(?:"[^"\n]*+"|'[^'\n]*+')\s*\])?)
      [ \t]*+ (?: :[ \t]*[A-Za-z_][\w.\[\]|?&<>*]*+ [ \t]*+ (?==[^=]) )? (?P<op> :=|=>|\+=|=(?![=~>])|:(?![:=/]) )
  | <(?P<tag>[A-Za-z_][\w.:\-]*+)>
  | \#[ \t]*define[ \t]+(?P<macro>\w++)[ \t]+
  | (?<!\S)--?(?P<option>[A-Za-z][\w\-]*+)(?:=|[ \t]+(?=[^\s\-]))
  | \(\s*(?P<arg>{QUOTED})\s*,\s*
""", re.X | re.A)
PART = re.compile(rf"""
    [bBrRuUfF@]{{0,2}} (?P<quoted>\"\"\"(?s:.*?)\"\"\" | '''(?s:.*?)''' | {QUOTED})
  | \$\(?\{{?(?P<ref>[A-Za-z_]\w*+)\}}?\)?
  | (?P<call>[A-Za-z_$][\w$.]*+)\(
  | (?P<bare>[^\s"'`;,(){{}}\[\]<>|&$]++)
""", re.X | re.A)
JOIN = re.compile(r"""[ \t]*+(?:(?:\+|\|\||\?\?|\.(?=[ \t]*+["'$]))[ \t]*+(?:\\?\n[ \t]*+)?|(?=["'])(?<=[ \t])|\\\n[ \t]*+(?=["']))""")
#: Calls that hand their argument on.
THROUGH = frozenset(("b64decode", "decode", "encode", "str", "string", "bytes", "strip", "trim", "unhexlify", "fromhex", "atob", "quote", "unquote", "bytearray", "repr", "getbytes", "new"))
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", re.A)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
INSIDE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\{\{\s*([A-Za-z_]\w*)\s*\}\}|(?<!\$)\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and without overlap within a kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return out


def name_weight(name: str) -> float:
    words = [w.lower() for w in WORD.findall(name)]
    weight = max((WEIGHTS.get(w, 0.0) for w in [*words, *map("".join, zip(words, words[1:]))]), default=0.0)
    return weight * 0.2 if words and not ABOUT.isdisjoint(words) else weight


def literal_strength(value: str, plain: bool) -> float:
    """0 to 1 by bits of entropy; ``plain``: not quoted, so a lower-case word may as well be prose."""
    if len(value) < 6 or PLACEHOLDER.fullmatch(value):
        return 0.0
    n = len(value)
    bits = sum(c * log2(n / c) for c in Counter(value).values())
    word = value.isalpha() and (value.islower() or value.istitle())
    return min(1.0, bits / 40) * (0.5 if word and plain else 0.7 if " " in value else 1.0)


class _Pair:
    """One assignment: the name, its literals (start, end, value, plain) and the names it refers to."""

    __slots__ = ("at", "name", "literals", "refs")

    def __init__(self, at: int, name: str):
        self.at, self.name, self.literals, self.refs = at, name, [], []


def _clean(name: str) -> str:
    name = name.strip("\"'`").strip()
    for own in ("self.", "this.", "$"):
        name = name.removeprefix(own)
    return name


def _value(text: str, at: int, pair: _Pair, op: str) -> int:
    """Read the value at ``at`` into ``pair``; returns where it ends."""
    while at < len(text) and text[at] in " \t":
        at += 1
    if op in ("=", ":=", "=>", "+=") and text[at:at + 1] == "\n" or op == ":" and re.match(r"\n\s*[\"']", text[at:at + 200]):
        while at < len(text) and text[at].isspace():
            at += 1
    while part := PART.match(text, at):
        at = part.end()
        kind = part.lastgroup
        if kind == "quoted":
            start, end = part.span("quoted")
            cut = 3 if part["quoted"][:3] in ('"""', "'''") and end - start >= 6 else 1
            if text.startswith("=", at) or text.startswith(":", at) and op != "arg":
                return start  # the next key, not a value
            inside = [next(filter(None, m.groups())) for m in INSIDE.finditer(part["quoted"])]
            if inside:
                pair.refs += inside
            else:
                pair.literals.append((start + cut, end - cut, text[start + cut:end - cut], False))
        elif kind == "ref":
            pair.refs.append(part["ref"])
        elif kind == "call":
            if part["call"].rpartition(".")[2].lower() not in THROUGH:
                return at
            continue
        else:
            start, end = part.span("bare")
            if op != ":" and op != "tag" and text[end:end + 1] == "=" or re.match(r"[ \t]*[:=]", text[end:end + 8]):
                return start
            while end > start and text[end - 1] in ".,:\\":
                end -= 1
            word = text[start:end]
            if NAME.fullmatch(word):
                pair.refs.append(_clean(word))
            if text[end:end + 1] == "[":
                return end  # an item of something: not a literal
            if end > start:
                pair.literals.append((start, end, word, True))
        if not (join := JOIN.match(text, at)):
            break
        at = join.end()
    return at


def pairs_of(text: str) -> list[_Pair]:
    """All (name, value) pairs of a text, in order."""
    out: list[_Pair] = []
    at, label = 0, None
    while site := SITE.search(text, at):
        kind = site.lastgroup
        name = _clean(site["target"] if kind == "op" else site[kind])
        if kind == "op" and site["target"].endswith("]") and (key := re.search(r"[\"']([^\"'\n]*)[\"']\s*\]$", site["target"])):
            name = key[1]
        pair = _Pair(site.start(), name)
        if kind == "tag":
            end = text.find("<", site.end())
            if end > site.end() and text.startswith(f"</{site['tag']}>", end):
                pair.literals.append((site.end(), end, text[site.end():end], False))
                out.append(pair)
            at = site.end()
            continue
        at = max(site.end(), _value(text, site.end(), pair, site["op"] if kind == "op" else kind))
        low = name.lower()
        if low in ("name", "key") and len(pair.literals) == 1:
            label = pair.literals[0][2]
        elif low == "value" and label:
            pair.name, label = label, None
        else:
            label = None
        if pair.literals or pair.refs:
            out.append(pair)
    return out


def lexed_spans(text: str) -> list[tuple[int, int, str, str, float]]:
    """(start, end, kind, name, score) of the literals that reach a sensitive name."""
    if not GATE.search(text):
        return []
    pairs = pairs_of(text)
    weights = [name_weight(p.name) for p in pairs]
    if not any(weights):
        return []
    given: dict[str, list[int]] = {}
    for i, p in enumerate(pairs):
        given.setdefault(p.name, []).append(i)

    def source(ref: str, i: int) -> int | None:
        """The pair a reference in pair i stands for."""
        where = given.get(ref, [])
        before = bisect_right(where, i - 1)
        if before:
            return where[before - 1]
        return next((j for j in where if j > i), None)

    best: dict[tuple[int, int], tuple[str, str, float]] = {}
    seen: set[int] = set()
    for i in sorted((i for i, w in enumerate(weights) if w), key=lambda i: (-weights[i], i)):
        stack, kind = [i], "named"
        while stack:
            j = stack.pop()
            if j in seen and kind == "flow":
                continue
            seen.add(j)
            p, rest = pairs[j], []
            for ref in p.refs:
                if (k := source(ref, j)) is not None:
                    rest.append(k)
            stack += rest
            own = [x for x in p.literals if not (x[3] and rest and _clean(x[2]) in p.refs)]
            score = weights[i] * literal_strength("".join(x[2] for x in own), any(x[3] for x in own))
            if score >= THRESHOLD:
                for start, end, _, _ in own:
                    if end > start and (kind == "named" or (start, end) not in best):
                        best[start, end] = (kind, pairs[i].name, round(score, 4))
            kind = "flow"
    return [(s, e, k, n, x) for (s, e), (k, n, x) in best.items()]


def spans_of(text: str) -> list[tuple[int, int, str, str | None, float]]:
    """All spans of a text by start, then kind: (start, end, kind, name, score)."""
    base = base_spans(text)
    out = [(s, e, k, None, 1.0) for s, e, k in base]
    if more := lexed_spans(text):
        base.sort()
        starts, reach = [b[0] for b in base], []
        for b in base:
            reach.append(max(b[1], reach[-1]) if reach else b[1])
        for x in more:
            at = bisect_right(starts, x[0])
            if not at or reach[at - 1] < x[1]:
                out.append(x)
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


FIELDS = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]


def _scanned(batches):
    for batch in batches:
        for part, texts in text_slices(batch):
            rows = [[{"kind": k, "start": s, "end": e, "name": n, "score": x} for s, e, k, n, x in spans_of(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.struct(FIELDS)))], names=["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end exclusive in code points, name, score) of every document, by start, then
    kind. A null or empty text has none. Rows are on their own: repeated rows give repeated results, an empty table
    gives none, a null doc_id stays. Only ``doc_id`` and ``text`` are read, so other columns cannot clash. A text is
    read once from left to right and is never cut, whatever its length."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        _scanned, "doc_id long, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>")


def _digests(batches):
    for batch in batches:
        rows = []
        for spans in batch.column("spans").to_pylist():
            kinds = Counter(x["kind"] for x in spans)
            told = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in spans]
            base = ",".join(t for k, t in told if k in KINDS[:3])
            rows.append((*(kinds[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in told)))
        names = [f"n_{k}" for k in KINDS]
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.string()] * 2))],
                                         names=["doc_id", *names, "base_sha256", "spans"])


def op13_secret_scan(spark, folder: str) -> DataFrame:
    """Secrets of all documents as counts, a digest of the pattern spans, and all spans."""
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return secret_spans(table(spark, folder, "documents")).mapInArrow(_digests, f"doc_id long, {counts}, base_sha256 string, spans string")
