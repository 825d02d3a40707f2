"""Text expressions: clean-up, dictionary tags, header chunks, keyword in context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.geo import col

# Words looked for in posts, in order, with the name they stand for.
SPECIES_WORDS = [
    ("smallmouth", "smallmouth bass"),
    ("largemouth", "largemouth bass"),
    ("walleye", "walleye"),
    ("northern pike", "northern pike"),
    (" pike", "northern pike"),
    ("muskie", "muskellunge"),
    ("muskellunge", "muskellunge"),
    ("yellow perch", "yellow perch"),
    ("perch", "yellow perch"),
    ("crappie", "crappie"),
    ("bluegill", "bluegill"),
    (" sunfish", "sunfish"),
    ("brook trout", "brook trout"),
    ("rainbow trout", "rainbow trout"),
    ("brown trout", "brown trout"),
    ("lake trout", "lake trout"),
    ("steelhead", "steelhead"),
    ("atlantic salmon", "atlantic salmon"),
    ("chinook", "chinook salmon"),
    ("coho", "coho salmon"),
    ("channel catfish", "channel catfish"),
    ("catfish", "catfish"),
    ("longnose gar", "longnose gar"),
    (" gar", "longnose gar"),
    ("bowfin", "bowfin"),
    (" carp", "common carp"),
    ("redhorse", "redhorse"),
    ("sculpin", "sculpin"),
    ("madtom", "madtom"),
    (" darter", "darter"),
    (" dace", "dace"),
    ("lamprey", "lamprey"),
    (" shiner", "shiner"),
    (" chub", "chub"),
    ("bass", "bass"),
]
PLACE_WORDS = [
    "credit river", "grand river", "humber river", "don river", "niagara river", "rideau river",
    "trent river", "severn river", "lake simcoe", "lake erie", "lake huron", "lake ontario",
    "lake superior", "georgian bay", "kawartha", "muskoka", "saugeen river", "caledonia",
    "dunnville", "brantford", "guelph", "hamilton", "kingston", "sudbury", "thunder bay", "toronto",
]
ZONE_HEADER = r"(?i)(?:FISHERIES MANAGEMENT ZONE|FMZ|ZONE)\s+(\d{1,2})\b"


def slug(c) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def strip_html(c) -> Column:
    return F.trim(F.regexp_replace(col(c), "<[^>]+>", ""))


def shorten(c, n: int = 600) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit("..."))).otherwise(
        col(c))


def truncated(c, n: int = 2000) -> tuple[Column, Column]:
    """Leading part and whether anything was cut."""
    return F.left(col(c), F.lit(n)), F.length(col(c)) > n


def number(c) -> Column:
    """Double from dirty text; blank and unreadable become null."""
    return F.nullif(F.trim(col(c)), F.lit("")).try_cast("double")


def integer(c) -> Column:
    """Integer read through double, so '3.0' is 3."""
    return number(c).try_cast("int")


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def year_label(c) -> Column:
    """Year or year range in a resource name, otherwise its slug."""
    years = F.regexp_extract(col(c), r"(\d{4}[-_]?\d{0,4})", 1)
    return F.when(years != "", F.replace(years, F.lit("-"), F.lit("_"))).otherwise(slug(c))


def tag_species(text: Column, words=None, generic: str = "bass") -> Column:
    """Distinct names in dictionary order; the generic one goes when a specific one is there."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[
        F.when(low.contains(w), F.lit(name)) for w, name in (words or SPECIES_WORDS)]))
    names = F.array_distinct(hits)
    specific = F.exists(names, lambda n: n.endswith(" " + generic))
    return F.when(specific, F.array_remove(names, generic)).otherwise(names)


def tag_places(text: Column, words=None) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[
        F.when(low.contains(w), F.lit(w)) for w in (words or PLACE_WORDS)]))


def infer_jurisdiction(subreddit: Column, text: Column) -> Column:
    sub, low = F.lower(subreddit), F.lower(text)
    return (
        F.when(sub.contains("ontario") | low.contains("ontario"), "CA-ON")
        .when(sub.contains("canada") | low.contains("canada"), "CA")
    )


def zone_chunks(text, header: str = ZONE_HEADER) -> Column:
    """Array of (zone, text): each header up to the next one, whatever number that carries."""
    ahead = "(?=" + header.replace("(?i)", "").replace(r"(\d{1,2})", r"\d{1,2}") + ")"
    parts = F.split(col(text), "(?i)" + ahead)
    # an inner word of a longer header can split it; such a head is glued back by the lookbehind
    parts = F.split(col(text), r"(?i)(?<!MANAGEMENT )" + ahead)
    chunk = F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, "^" + header, 1).try_cast("int").alias("zone"), F.trim(p).alias("text")))
    return F.filter(chunk, lambda c: c["zone"].between(1, 20))


def keyword_spots(text: Column, word: Column) -> Column:
    """0-based starts of the non-overlapping matches, ignoring case."""
    pieces = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(word), F.lit(r"\E")))
    n = F.size(pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("spots"))

    def walk(acc: Column, piece: Column) -> Column:
        here = acc["at"] + F.length(piece)
        return F.struct((here + F.length(word)).alias("at"),
                        F.concat(acc["spots"], F.array(here)).alias("spots"))

    walked = F.aggregate(F.slice(pieces, F.lit(1), n - 1), start, walk)
    return F.when(n > 1, walked["spots"]).otherwise(F.array().cast("array<int>"))


def keyword_context(text: Column, word: Column, window: int = 600, matches: int = 5,
                    cap: int = 3000, overview: int = 2000) -> Column:
    """(text, truncated): snippets around the first matches, near-duplicates left out.

    Without a match, the head of the text and a note.
    """
    spots = F.slice(keyword_spots(text, word), 1, matches)
    starts = F.transform(spots, lambda p: F.greatest(p - window, F.lit(0)))
    ranges = F.zip_with(starts, spots, lambda s, p: F.struct(
        s.alias("s"), F.least(p + F.length(word) + window, F.length(text)).alias("e")))
    none = F.slice(ranges, 1, 0)

    def keep(acc: Column, r: Column) -> Column:
        close = F.exists(acc, lambda k: F.abs(k["s"] - r["s"]) < window)
        return F.when(close, acc).otherwise(F.concat(acc, F.array(r)))

    kept = F.aggregate(ranges, none, keep)
    snippet = lambda r: F.concat(
        F.when(r["s"] > 0, "…").otherwise(""),
        F.trim(F.substring(text, r["s"] + 1, r["e"] - r["s"])),
        F.when(r["e"] < F.length(text), "…").otherwise(""))
    joined = F.array_join(F.transform(kept, snippet), "\n\n---\n\n")
    note = F.concat(
        F.lit("\n\n[Note: '"), word, F.lit(
            "' not found by exact name in this zone's text. The species may appear under a different "
            "name or may not have special rules listed (general limits apply). Full zone overview "
            "shown above.]"))
    return F.when(F.size(spots) > 0, F.struct(
        F.left(joined, F.lit(cap)).alias("text"), (F.length(joined) > cap).alias("truncated")
    )).otherwise(F.struct(
        F.concat(F.left(text, F.lit(overview)), note).alias("text"),
        (F.length(text) > overview).alias("truncated")))
