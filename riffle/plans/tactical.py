"""Lure and technique recommendations from season, temperature, clarity, pressure and light.

The rules are lookup tables applied as column expressions, so any number of (species, conditions)
rows is answered in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, thresholds and tables of the recommendations.
MICRO_WORDS = [
    "darter", "dace", "madtom", "shiner", "chub", "lamprey",
    "stonecat", "sculpin", "logperch", "bitterling", "minnow",
]
GROUP_PATTERNS = [
    ("brook trout", "trout"),
    ("rainbow trout", "trout"),
    ("brown trout", "trout"),
    ("lake trout", "trout"),
    ("splake", "trout"),
    ("trout", "trout"),
    ("smallmouth", "bass"),
    ("largemouth", "bass"),
    ("rock bass", "bass"),
    ("bass", "bass"),
    ("muskellunge", "pike"),
    ("muskie", "pike"),
    ("northern pike", "pike"),
    ("pike", "pike"),
    ("walleye", "walleye"),
    ("sauger", "walleye"),
    ("pickerel", "walleye"),
    ("channel cat", "catfish"),
    ("catfish", "catfish"),
    ("bullhead", "catfish"),
    ("bluegill", "panfish"),
    ("pumpkinseed", "panfish"),
    ("crappie", "panfish"),
    ("yellow perch", "panfish"),
    ("perch", "panfish"),
    ("sunfish", "panfish"),
    ("carp", "carp"),
    ("redhorse", "carp"),
    ("sucker", "carp"),
    ("gar", "unknown"),
]
# cold limit, lower and upper end of the best range, warm limit
THRESHOLDS = {
    "trout": (2.0, 8.0, 16.0, 20.0),
    "bass": (10.0, 18.0, 26.0, 30.0),
    "pike": (4.0, 15.0, 22.0, 26.0),
    "walleye": (4.0, 15.0, 21.0, 27.0),
    "catfish": (15.0, 22.0, 28.0, 32.0),
    "panfish": (5.0, 18.0, 24.0, 28.0),
    "carp": (8.0, 16.0, 24.0, 30.0),
    "unknown": (10.0, 18.0, 26.0, 30.0),
    "microfishing": (2.0, 8.0, 22.0, 28.0),
}
BASE_SPEED = {
    "lethargic": "slow",
    "sub_optimal": "slow",
    "active": "medium",
    "warm_stress": "slow",
    "over_warm": "slow",
}
# first and second lure per group and season
LURES = {
    "trout": {
        "winter": ("jigging spoon (1/16-1/8 oz)", "live bait on finesse rig"),
        "pre_spawn": ("inline spinner (Mepps #1-2)", "small spoon (1/8-1/4 oz)"),
        "spawn": ("egg bead / egg fly pattern", "small nymph or wet fly"),
        "summer": ("dry fly / emerger", "small streamer (olive/black, 2-3 in)"),
        "fall": ("streamer (olive/black, 2-3 in)", "inline spinner"),
        "early_winter": ("slow-rolled spoon", "live bait under float"),
    },
    "bass": {
        "winter": ("blade bait / jigging spoon", "finesse jig (1/8-1/4 oz)"),
        "pre_spawn": ("jerkbait", "medium-diving crankbait"),
        "spawn": ("drop-shot rig", "finesse worm (5-6 in)"),
        "summer": ("football jig (1/2 oz)", "deep-diving crankbait"),
        "fall": ("spinnerbait (3/8-1/2 oz)", "lipless crankbait"),
        "early_winter": ("blade bait", "jigging spoon"),
    },
    "pike": {
        "winter": ("large jigging spoon (1-2 oz)", "large jig with soft trailer"),
        "pre_spawn": ("large spinnerbait (1 oz)", "jerkbait (5-7 in)"),
        "spawn": ("bucktail jig", "large minnow bait"),
        "summer": ("surface frog (weedbed edges)", "large soft swimbait"),
        "fall": ("large spoon (1-2 oz)", "large jerkbait"),
        "early_winter": ("large jigging spoon", "large jig + soft trailer"),
    },
    "walleye": {
        "winter": ("jigging spoon (1/4-1/2 oz)", "live bait rig (leech or nightcrawler)"),
        "pre_spawn": ("jig (1/4-3/8 oz)", "slow-death rig"),
        "spawn": ("jig + live bait (slow death)", "bottom bouncer + nightcrawler harness"),
        "summer": ("deep-diving crankbait", "bottom bouncer + spinner harness"),
        "fall": ("jig + paddle tail (3-4 in)", "medium-diving crankbait"),
        "early_winter": ("jigging spoon", "blade bait"),
    },
    "catfish": {
        "winter": ("cut bait on bottom (dead stick)", "punch bait + treble hook"),
        "pre_spawn": ("nightcrawler / chicken liver (slip rig)", "cut shad"),
        "spawn": ("punch bait / stink bait (bottom)", "cut bait"),
        "summer": ("cut shad / skipjack (Santee rig)", "circle hook + live bait"),
        "fall": ("cut bait (Santee rig)", "nightcrawler + slip float"),
        "early_winter": ("cut bait on bottom", "punch bait"),
    },
    "panfish": {
        "winter": ("tiny jig (1/64-1/32 oz)", "live bait (waxworm) under float"),
        "pre_spawn": ("small jig (1/32 oz)", "small tube (1.5-2 in)"),
        "spawn": ("small tube / inline spinner (#0)", "live bait under float"),
        "summer": ("small surface popper", "small jig (1/32 oz) under float"),
        "fall": ("small crankbait (1-1.5 in)", "small jig (1/16 oz)"),
        "early_winter": ("tiny jig (1/64 oz)", "live bait (waxworm or maggot)"),
    },
    "carp": {
        "winter": ("boilie on hair rig (dead stick)", "corn on small hook"),
        "pre_spawn": ("boilie (spring blend, 14-18 mm)", "tiger nuts on hair rig"),
        "spawn": ("small bait (corn / bread punch)", "boilie (10-14 mm)"),
        "summer": ("surface bait (floating dog biscuit)", "boilie + PVA stick"),
        "fall": ("boilie (fishmeal blend)", "tiger nuts / cell boilie"),
        "early_winter": ("boilie (winter blend, 10 mm)", "corn"),
    },
    "unknown": {
        "winter": ("jig (1/8-1/4 oz)", "live bait rig"),
        "pre_spawn": ("jerkbait / medium crankbait", "spinnerbait"),
        "spawn": ("finesse worm / drop-shot", "small jig"),
        "summer": ("deep-diving crankbait", "football jig"),
        "fall": ("spinnerbait", "lipless crankbait"),
        "early_winter": ("blade bait", "jig (1/4 oz)"),
    },
}
SIZES = {
    "trout": "size 10-16 hook (flies), 1/16-1/4 oz (hardware)",
    "bass": "3/8-1/2 oz (reaction), 5-7 in (soft plastics)",
    "pike": "1/2-2 oz, 5-9 in lures",
    "walleye": "1/4-1/2 oz, 3-5 in lures",
    "catfish": "2/0-5/0 hook, 1-3 oz sinker",
    "panfish": "1/32-1/16 oz jig, size 6-10 hook",
    "carp": "size 4-8 hook, 2-4 oz lead",
    "unknown": "1/4-3/8 oz, 3-5 in",
    "microfishing": "size 20-26 hook, 2-4 lb fluorocarbon, 1/64 oz split shot",
}
DEFAULT_COLORS = {
    "trout": "natural (olive, white, silver)",
    "bass": "green pumpkin / white",
    "pike": "white / chartreuse (large profile)",
    "walleye": "chartreuse / white",
    "catfish": "scent over color — cut bait or stink bait",
    "panfish": "white / chartreuse",
    "carp": "boilie color — fishmeal or fruit blend",
    "unknown": "chartreuse / white (versatile)",
    "microfishing": "natural (waxworm or maggot color)",
}
CLARITY_FIRST = {
    "clear": "natural/translucent (white, silver, green pumpkin, smoke)",
    "stained": "chartreuse/white",
    "murky": "black/dark brown (maximum contrast)",
}
CLARITY_SECOND = {
    "clear": "subtle (watermelon red flake, natural olive)",
    "stained": "orange/chartreuse or hot pink",
    "murky": "dark blue/purple",
}
DEPTH_BY_TIME = {
    "dawn": "0-3 ft",
    "morning": "2-10 ft",
    "midday": "10-20 ft",
    "afternoon": "8-18 ft",
    "evening": "2-10 ft",
    "dusk": "0-4 ft",
    "night": "0-8 ft",
}
DEPTH_BY_SEASON = {
    "winter": "10-25 ft",
    "pre_spawn": "2-10 ft",
    "spawn": "1-6 ft",
    "summer": "8-20 ft",
    "fall": "3-15 ft",
    "early_winter": "10-25 ft",
}
# first word found in the lure decides
TECHNIQUES = {
    "topwater": "walk or pop on the surface, vary cadence to trigger reaction strikes",
    "popper": "pop and pause, letting ripples dissipate before the next pop",
    "frog": "work over vegetation, pause in holes and pockets",
    "buzzbait": "steady retrieve just fast enough to keep the blade churning the surface",
    "spinnerbait": "slow-roll near bottom or burn through cover, vary depth",
    "lipless crankbait": "rip-and-pause through vegetation edges or open water",
    "jerkbait": "jerk-pause-jerk with an irregular rhythm, longer pauses in cold water",
    "crankbait": "run along bottom or structure breaks, match depth to bill size",
    "drop-shot": "hover in place with subtle shakes; let the bait breathe",
    "finesse jig": "slow crawl along bottom, occasional hop; feel for changes in texture",
    "football jig": "drag and crawl along rocky bottom, pause frequently",
    "blade bait": "vertical jigging with short snaps, let it flutter on the fall",
    "jigging spoon": "vertical jigging in deep water; let it freefall on a slack line",
    "streamer": "swing across current or strip-retrieve with irregular pauses",
    "inline spinner": "cast upstream or across, retrieve with or against current",
    "dry fly": "dead drift on the surface; mend to avoid drag",
    "nymph": "dead drift near bottom with occasional lifts",
    "egg bead": "drift naturally through pools and runs below spawning areas",
    "spoon": "cast and retrieve with varied speed, or flutter vertically",
    "hair rig": "cast to feature, leave stationary; check every 30-60 minutes",
    "boilie": "cast to likely feature, leave stationary; check every 30-60 minutes",
    "cut bait": "bottom rig, stationary or very slow drag",
    "live bait": "slow drift or stationary under float; let the bait do the work",
    "punch bait": "bottom rig, stationary; scent does the work",
    "ultralight rig": "drift natural bait through current seams, eddies, and undercut banks",
    "jig": "hop along bottom with steady retrieve, vary the cadence",
    "tube": "drag and crawl along bottom, occasional twitch",
}
TOPWATER = ("topwater popper / walking bait", "buzzbait or wake bait")
DEFAULT_TECHNIQUE = "present at depth, vary cadence until a pattern emerges"
LURE_TECHNIQUE = {
    lure: next((how for word, how in TECHNIQUES.items() if word in lure.lower()), DEFAULT_TECHNIQUE)
    for lure in {*TOPWATER, *(l for by in LURES.values() for pair in by.values() for l in pair)}
}
MICRO = {
    "lure_type": "ultralight rig",
    "color": "natural (waxworm, maggot, or tiny nightcrawler piece)",
    "technique": "drift natural bait through current seams, eddies, and undercut banks",
    "target_depth_range": "0-2 ft",
}
SPEEDS = ["slow", "medium", "fast"]
TIERS = ["low", "medium", "high"]


def _first_word(text: Column, pairs, otherwise: str) -> Column:
    out = None
    for word, value in pairs:
        hit = text.contains(word)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def _table(values: dict, key: Column, otherwise=None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(otherwise))


def species_group(species: Column) -> Column:
    """Small-fish words first, then the first matching pattern."""
    low = F.lower(species)
    micro = [(w, "microfishing") for w in MICRO_WORDS]
    return _first_word(low, [*micro, *GROUP_PATTERNS], "unknown")


def season(month: Column) -> Column:
    return (
        F.when(month <= 2, "winter").when(month <= 4, "pre_spawn").when(month <= 6, "spawn")
        .when(month <= 8, "summer").when(month <= 10, "fall").otherwise("early_winter")
    )


def activity(temp_c: Column, group: Column) -> Column:
    limit = lambda i: _table({g: t[i] for g, t in THRESHOLDS.items()}, group,
                             THRESHOLDS["unknown"][i])
    return (
        F.when(temp_c < limit(0), "lethargic").when(temp_c < limit(1), "sub_optimal")
        .when(temp_c <= limit(2), "active").when(temp_c <= limit(3), "warm_stress")
        .when(temp_c.isNotNull(), "over_warm")
    )


def _confidence(count: Column, known: Column) -> Column:
    """Index into TIERS."""
    return F.when((count >= 3) & known, 2).when((count >= 2) | known, 1).otherwise(0)


def recommend(rows: DataFrame) -> DataFrame:
    """Recommendations for rows of (species, month, temp_c, clarity, pressure, time_of_day).

    Two per row, one for small species; every input column is kept.
    """
    c = F.col
    given = sum((c(x).isNotNull().cast("int") for x in (
        "temp_c", "clarity", "pressure", "time_of_day")), F.lit(0))
    # read many times below: columns of a projection of their own, computed once a row
    x = rows.withColumns({"season": season(c("month")), "condition_count": given,
                          "group": F.coalesce(species_group(c("species")), F.lit("unknown"))})
    x = x.withColumn("activity", F.when(c("group") != "microfishing", activity(c("temp_c"), c("group"))))
    micro = c("group") == "microfishing"

    step = F.when(c("pressure") == "falling", 1).when(c("pressure") == "rising", -1).otherwise(0)
    base = _table({k: SPEEDS.index(v) for k, v in BASE_SPEED.items()}, c("activity"), 1)
    speed = F.least(F.greatest(base + step, F.lit(0)), F.lit(2))
    speed = F.element_at(F.array(*[F.lit(s) for s in SPEEDS]), speed + 1)

    spot = F.concat_ws("|", "group", "season")
    lures = [_table({f"{g}|{s}": pair[i] for g, by in LURES.items() for s, pair in by.items()}, spot)
             for i in (0, 1)]
    surface = F.coalesce(
        c("time_of_day").isin("dawn", "dusk") & c("activity").isin("active", "warm_stress")
        & c("group").isin("bass", "pike") & c("season").isin("summer", "fall", "pre_spawn"),
        F.lit(False))
    lures = [F.when(surface, TOPWATER[i]).otherwise(lures[i]) for i in (0, 1)]

    plain = _table(DEFAULT_COLORS, c("group"))
    colors = [F.coalesce(_table(t, c("clarity")), plain) for t in (CLARITY_FIRST, CLARITY_SECOND)]
    depth = F.coalesce(_table(DEPTH_BY_TIME, c("time_of_day")), _table(DEPTH_BY_SEASON, c("season")))
    extra = F.array_join(F.array_compact(F.array(
        F.when(c("clarity").isin("stained", "murky"), "add vibration or rattle"),
        F.when(c("clarity") == "murky", "add scent if available"),
        F.when(c("pressure") == "falling", "reaction-bait cadence"),
        F.when(c("activity").isin("lethargic", "sub_optimal"), "slow bottom-contact or deadstick"),
    )), ", ")
    dashed = F.when(extra == "", extra).otherwise(F.concat(F.lit(" — "), extra))
    how = [F.concat(_table(LURE_TECHNIQUE, l, DEFAULT_TECHNIQUE), dashed) for l in lures]
    matched = F.array_compact(F.array(
        F.concat(F.replace(c("season"), F.lit("_"), F.lit("-")), F.lit(" season")),
        F.when(c("activity").isNotNull(), F.concat(
            F.format_string("%.0f°C water (", c("temp_c")),
            F.replace(c("activity"), F.lit("_"), F.lit(" ")), F.lit(")"))),
        F.concat(c("clarity"), F.lit(" water")),
        F.concat(c("pressure"), F.lit(" barometric pressure")), c("time_of_day")))
    cold = c("season").isin("winter", "early_winter")
    micro_matched = F.array_compact(F.array(
        F.lit("microfishing target — ultralight terminal tackle required"),
        F.when(cold, "cold season — fish are present but lethargic; stealth and patience matter"),
        F.when(c("pressure") == "falling",
               "falling pressure — micro-species may be slightly more active"),
        F.when(c("time_of_day").isin("dawn", "dusk"),
               "low-light period — darters and sculpin more active in current seams")))
    conf = _confidence(c("condition_count"), c("group") != "unknown")
    tier = lambda i: F.element_at(F.array(*[F.lit(t) for t in TIERS]), i + 1)

    def rec(i: int) -> Column:
        sure = conf if i == 0 else F.greatest(conf - 1, F.lit(0))
        tail = F.lit("") if i == 0 else F.lit(" (alternative)")
        return F.struct(
            F.lit(i + 1).alias("choice"), lures[i].alias("lure_type"), colors[i].alias("color"),
            _table(SIZES, c("group")).alias("size_range"),
            F.concat(how[i], tail).alias("technique"), speed.alias("retrieve_speed"),
            depth.alias("target_depth_range"), matched.alias("conditions_matched"),
            tier(sure).alias("confidence"))

    tiny = F.struct(
        F.lit(1).alias("choice"), F.lit(MICRO["lure_type"]).alias("lure_type"),
        F.lit(MICRO["color"]).alias("color"), F.lit(SIZES["microfishing"]).alias("size_range"),
        F.lit(MICRO["technique"]).alias("technique"), F.lit("slow").alias("retrieve_speed"),
        F.lit(MICRO["target_depth_range"]).alias("target_depth_range"),
        micro_matched.alias("conditions_matched"),
        tier(_confidence(c("condition_count"), F.lit(True))).alias("confidence"))
    both = F.when(micro, F.array(tiny)).otherwise(F.array(rec(0), rec(1)))
    return x.withColumn("r", F.explode(both)).select(
        *rows.columns, "group", "season", "activity", "condition_count", "r.*")
