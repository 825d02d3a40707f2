"""CSV sources: every column read as text, then cleaned and typed; bad rows kept with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import predicates as P
from riffle.functions.text import blank_to_null, integer, number
from riffle.operators.ranking import first_per_group
from riffle.operators.tables import split_rejects

JURISDICTION = "CA-ON"


def encoding_of(spark: SparkSession, path: str) -> str:
    """Text encoding from the byte order mark of one file."""
    head = (
        spark.read.format("binaryFile").load(path).limit(1)
        .select(F.hex(F.substring("content", 1, 3)).alias("h")).first()
    )
    mark = head["h"] if head else ""
    return "UTF-16" if mark[:4] in ("FFFE", "FEFF") else "UTF-8"


def read_text_columns(spark: SparkSession, path: str, rename=None, encoding: str = "UTF-8"):
    """All columns as trimmed text under cleaned-up names (byte order mark and spaces off)."""
    raw = spark.read.option("header", True).option("encoding", encoding).option(
        "multiLine", encoding != "UTF-8").csv(path)
    tidy = rename or (lambda c: c)
    names = [tidy(c.lstrip("﻿").strip()) for c in raw.columns]
    df = raw.toDF(*names)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in names])


def bilingual(name: str) -> str:
    """Header before the slash."""
    return name.split("/")[0].strip()


def _text(df: DataFrame, *names: str):
    """First of the named columns that exists, blank as null; null when none does."""
    have = [blank_to_null(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def stocking(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stocking records and rejected rows."""
    t = lambda *n: _text(df, *n)
    year, qty = t("Stocking_Year"), t("Number_of_Fish_Stocked")
    lat, lng = t("Latitude"), t("Longitude")
    whole = lambda c: c.try_cast("bigint")
    rows = df.select(
        t("ObjectId").alias("record_id"),
        t("Official_Waterbody_Name", "Unoffcial_Waterbody_Name").alias("waterbody_name"),
        t("Waterbody_Location_Identifier").alias("waterbody_code"),
        t("Geographic_Township").alias("municipality"), t("MNRF_District").alias("county"),
        lat.try_cast("double").alias("lat"), lng.try_cast("double").alias("lng"),
        F.lit(JURISDICTION).alias("jurisdiction"), F.initcap(t("Species")).alias("species"),
        whole(year).cast("int").alias("year"), whole(qty).alias("quantity"),
        t("Developmental_Stage").alias("life_stage"),
        F.make_date(whole(year).cast("int"), F.lit(1), F.lit(1)).alias("stocked_at"),
        P.first_reason({
            "no waterbody name": t("Official_Waterbody_Name", "Unoffcial_Waterbody_Name").isNull(),
            "bad year": whole(year).isNull(),
            "bad number": (lat.isNotNull() & lat.try_cast("double").isNull())
            | (lng.isNotNull() & lng.try_cast("double").isNull())
            | (qty.isNotNull() & whole(qty).isNull()),
            "no species": t("Species").isNull(), "no id": t("ObjectId").isNull(),
        }).alias("_why"))
    good, bad = split_rejects(rows, F.col("_why"))
    return good.drop("_why"), bad.drop("_why")


def stations(df: DataFrame) -> DataFrame:
    """Station dimension; the last row of a repeated id counts."""
    rows = df.withColumn("_at", F.monotonically_increasing_id()).select(
        _text(df, "STATION").alias("station_id"), _text(df, "NAME").alias("station_name"),
        number(_text(df, "LATITUDE")).alias("lat"), number(_text(df, "LONGITUDE")).alias("lng"),
        "_at").where("station_id IS NOT NULL")
    return first_per_group(rows, ["station_id"], [F.desc("_at")]).drop("_at")


def station_code(c):
    """Digit-only ids are padded to eleven places."""
    return F.when(c.rlike(r"^\d+$") & (F.length(c) < 11), F.lpad(c, 11, "0")).otherwise(c)


PARAMETERS = {
    "do_mgl": "Dissolved_Oxygen_mgl", "ph": "Field_PH", "temp_c": "Water_Temperature_C",
    "conductivity_us_cm": "Specific_Conductance_uS_cm_1", "turbidity_fnu": "Turb_FNU",
}


def underscored(name: str) -> str:
    return name.strip().replace(" ", "_")


def field_data(df: DataFrame, station_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Water quality readings of any of the three header variants, and rejected rows."""
    t = lambda *n: _text(df, *n)
    year = t("YEAR", "Year")
    field, work, sample = t("Field_ID"), t("Lab_Workorder_ID"), t("Lab_Sample_ID")
    rid = F.when(field.isNotNull(), F.concat_ws("_", year, field)).when(
        work.isNotNull() & sample.isNotNull(), F.concat_ws("_", year, work, sample))
    day = F.try_to_date(t("Collection_Date"), "M/d/yyyy")
    values = {n: number(t(c)) for n, c in PARAMETERS.items()}
    rows = df.select(
        rid.alias("record_id"), station_code(t("Collection_Site")).alias("station_id"),
        day.alias("sampled_at"), F.lit(JURISDICTION).alias("jurisdiction"),
        *[v.alias(n) for n, v in values.items()],
        P.first_reason({
            "no usable id": rid.isNull(), "bad date": day.isNull(),
            "all parameters null": F.coalesce(*values.values()).isNull(),
        }).alias("_why"))
    named = rows.join(station_table, "station_id", "left")
    good, bad = split_rejects(named, F.col("_why"))
    return good.drop("_why"), bad.drop("_why")


def union_variants(frames: list[DataFrame]) -> DataFrame:
    """Files with different headers as one frame of all their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def study(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visit dimension (a year is required) and the ids of Ontario visits."""
    t = lambda *n: _text(df, *n)
    visit = t("SiteVisitID")
    base = df.where(visit.isNotNull())
    dim = base.select(
        visit.alias("site_visit_id"), F.coalesce(t("Site"), visit).alias("site_code"),
        t("SiteName").alias("site_name"), number(t("Latitude")).alias("lat"),
        number(t("Longitude")).alias("lng"), integer(t("Year")).alias("sampled_year"),
        integer(t("JulianDay")).alias("sampled_julian_day"),
        integer(t("StreamOrder")).alias("stream_order"), t("LocalBasinName").alias("local_basin"),
    ).where("sampled_year IS NOT NULL").dropDuplicates(["site_visit_id"])
    ids = base.where(F.upper(t("Province")) == "ON").select(visit.alias("site_visit_id")).distinct()
    return dim, ids


def benthic_taxa(df: DataFrame, visit_ids: DataFrame) -> DataFrame:
    """Taxon counts of the wanted visits, columns as the benthic summary reads them."""
    t = lambda *n: F.coalesce(_text(df, *n), F.lit(""))
    rows = df.select(
        t("SiteVisitID").alias("site_visit_id"), t("Order").alias("taxon_order"),
        t("Family").alias("family"), number(t("Count")).alias("n"))
    return rows.where("n > 0").join(visit_ids, "site_visit_id", "left_semi")
