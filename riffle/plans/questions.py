"""The named questions: every one a function of stored tables and parameters to a DataFrame.

``Questions`` holds the stored tables by name (a mapping of DataFrames, or anything with
``read(name)``), in the columns of ``riffle.schemas``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.functions import geo
from riffle.functions import predicates as P
from riffle.functions import text as X
from riffle.operators import aggregates as A
from riffle.operators import graph as G
from riffle.operators import search as Se
from riffle.operators import tables as Tb
from riffle.operators.joins import merge_species_sources
from riffle.operators.ranking import first_per_group
from riffle.plans import birds as Bi
from riffle.plans import gauges as Ga
from riffle.plans import habitat as Ha
from riffle.plans import scores as Sc
from riffle.plans import species as Sp
from riffle.plans import stocking as St
from riffle.plans import tactical as Ta
from riffle.plans import water as Wa
from riffle.plans import watershed as Ws
from riffle.plans import weather as We


class Questions:
    def __init__(self, tables, features: DataFrame | None = None, untapped: DataFrame | None = None,
                 access_scores: DataFrame | None = None):
        self._tables = tables
        self.features, self.untapped, self.access_scores = features, untapped, access_scores

    def table(self, name: str) -> DataFrame:
        return self._tables.read(name) if hasattr(self._tables, "read") else self._tables[name]

    # --- observations -----------------------------------------------------------------------

    def recent_observations(self, lat, lng, asof: str, radius_km=50.0, days_back=90,
                            species: str | None = None) -> DataFrame:
        cond = geo.near("lat", "lng", lat, lng, radius_km) & P.since("observed_on", asof, days_back)
        if species:
            cond = cond & P.contains_any_ci(["species", "common_name"], [species])
        return self.table("observations").where(cond).orderBy(
            F.desc("observed_on"), "observation_id")

    def _gbif(self, lat, lng, radius_km, species=None, asof=None, days_back=None) -> DataFrame:
        cond = geo.near("lat", "lng", lat, lng, radius_km)
        if species:
            cond = cond & P.contains_any_ci(["species", "common_name"], [species])
        if days_back:
            cond = cond & P.since("observed_on", asof, days_back, keep_null=True)
        return self.table("gbif_observations").where(cond)

    def gbif_summary(self, lat, lng, radius_km=50.0, asof: str | None = None,
                     days_back: int | None = None, species: str | None = None) -> DataFrame:
        """Per species the counts of both sources and the kinds of records."""
        inat = self.table("observations").where(geo.near("lat", "lng", lat, lng, radius_km))
        if species:
            inat = inat.where(P.contains_any_ci(["species", "common_name"], [species]))
        gbif = self._gbif(lat, lng, radius_km, species, asof, days_back)
        return merge_species_sources(inat, gbif).join(
            A.counts_as_text(gbif, ["species"], "basis_of_record"), "species", "left").orderBy("species")

    def oldest_record(self, lat, lng, species: str, radius_km=50.0) -> DataFrame:
        return self._gbif(lat, lng, radius_km, species).where("observed_on IS NOT NULL").orderBy(
            "observed_on", "gbif_key").limit(1)

    # --- weather and water ------------------------------------------------------------------

    def conditions(self, current: DataFrame, forecast: DataFrame, asof: str, when="now") -> DataFrame:
        return We.conditions(current) if when == "now" else We.forecast_days(forecast, asof, when)

    def pressure_trend(self, hourly: DataFrame) -> DataFrame:
        return first_per_group(We.pressure_trends(hourly), ["place_id"],
                               [F.desc("ts"), F.col("reading_id")])

    def stream_conditions(self, stations: DataFrame, lat, lng, radius_km=50.0, max_stations=3):
        readings = self.table("stream_gauge_readings").select(
            "station_id", F.unix_micros("reading_datetime").alias("reading_id"),
            F.col("reading_datetime").alias("ts"), F.col("water_level_m").alias("level_m"),
            "discharge_cms")
        return Ga.stream_conditions(readings, stations, lat, lng, radius_km, max_stations)

    def nearby_water(self, lat, lng, asof: str, radius_km=25.0, feature_type: str | None = None,
                     not_in_trip_log=False, limit=Wa.MAX_RESULTS) -> DataFrame:
        visited = self.table("trips").where("location_name IS NOT NULL") if not_in_trip_log else None
        found = Wa.nearby_water(self.table("water_features"), lat, lng, radius_km, feature_type, visited, limit=limit)
        vertex = geo.wkt_first_vertex("geom_wkt")
        streams = self.table("stream_segments").select(vertex["lat"].alias("lat"),
                                                       vertex["lng"].alias("lng"))
        return Wa.dispersal_flags(found, streams, self.table("bird_observations"), asof)

    def access_points(self, lat, lng, radius_km=25.0, limit=Wa.MAX_RESULTS) -> DataFrame:
        return Wa.access_points(self.table("access_points"), lat, lng, radius_km, limit)

    # --- records and rules ------------------------------------------------------------------

    def stocking_history(self, asof_year: int, name=None, species=None, lat=None, lng=None,
                         radius_km=50.0, year_from=None, max_waterbodies=10) -> DataFrame:
        found = St.search(self.table("stocking_records"), name, species, lat, lng, radius_km, year_from)
        bodies = St.waterbodies(found, asof_year, max_waterbodies)
        return bodies.withColumn("stocking_note", St.note(asof_year))

    def stocking_events(self, **kw) -> DataFrame:
        return St.latest_events(St.search(self.table("stocking_records"), **kw))

    def species_range(self, species: str, lat=None, lng=None) -> DataFrame:
        return Sp.species_range(self.table("species_ranges"), species, lat, lng)

    def sar_species(self, jurisdiction="CA-ON") -> DataFrame:
        return Sp.at_risk(self.table("species_ranges"), jurisdiction)

    def regulations(self, zone: int | None = None, lat=None, lng=None,
                    species: str | None = None) -> DataFrame:
        """Newest text of a zone, or of the zone a point lies in: context of a species or the head."""
        rows = self.table("regulation_chunks")
        wanted = F.lit(zone) if zone is not None else geo.fmz(F.lit(float(lat)), F.lit(float(lng)))
        newest = first_per_group(rows.where(F.col("zone") == wanted), ["zone", "jurisdiction"],
                                 [F.desc("regulation_year")])
        if species:
            found = X.keyword_context(F.col("raw_text"), F.lit(species))
            text, cut_ = found["text"], found["truncated"]
        else:
            text, cut_ = X.truncated("raw_text", 2000)
        return newest.select("zone", "jurisdiction", "regulation_year", text.alias("text"),
                             cut_.alias("truncated"), "source_url")

    def search_posts(self, query: str, species: str | None = None, jurisdiction: str | None = None,
                     limit: int = 10) -> DataFrame:
        cond = P.optional(
            species=F.exists("extracted_species", lambda s: F.lower(s).contains(species.lower()))
            if species else None,
            jurisdiction=F.col("jurisdiction") == jurisdiction if jurisdiction else None)
        text = F.concat_ws(" ", "title", "body")
        found = Se.search(self.table("reddit_posts"), "post_id", text, query, limit, cond)
        return found.withColumn("body", X.shorten("body"))

    def tactical_recommendation(self, conditions: DataFrame) -> DataFrame:
        return Ta.recommend(conditions)

    def record_recommendation(self, recommended: DataFrame, asof: str,
                              key: str = "moment_id") -> DataFrame:
        """The recommendations log with one row per question added (a question has two at most)."""
        texts = recommended.groupBy(key, "species").agg(F.to_json(F.sort_array(F.collect_list(
            F.struct("choice", "lure_type", "color", "technique", "confidence")))).alias(
                "recommendation_json"))
        batch = texts.select(key, F.to_timestamp(F.lit(asof)).alias("timestamp"), "species",
                             "recommendation_json", F.lit(False).alias("was_used"))
        return Tb.append_with_ids(self.table("recommendations"), batch, "id", [key]).drop(key)

    def behavioral_insights(self, species: str, condition_type: str | None = None) -> DataFrame:
        cond = P.contains_ci("species", species) & F.col("is_current")
        if condition_type:
            cond = cond & (F.col("condition_type") == condition_type)
        return self.table("behavioral_insights").where(cond).orderBy(F.desc("created_at"), "id")

    def record_insight(self, new_rows: DataFrame, replaces: str = "replaces") -> DataFrame:
        """The insight table with refinements added; unverified conclusions are turned away."""
        good, _ = Tb.split_rejects(new_rows, P.first_reason({
            "not verified": F.col("confidence") == "unverified", **P.text_faults("conclusion")}))
        return Tb.refine(self.table("behavioral_insights"), good, "id", replaces)

    def dismiss_segment(self, ogf_id: int, asof: str, reason: str | None = None) -> DataFrame:
        t = self.table("dismissed_segments")
        row = t.sparkSession.range(1).select(
            F.lit(ogf_id).cast("bigint").alias("ogf_id"),
            F.to_timestamp(F.lit(asof)).alias("dismissed_at"),
            F.lit(reason).cast("string").alias("reason"))
        return Tb.upsert(t, row, ["ogf_id"], F.col("dismissed_at"))

    # --- habitat ----------------------------------------------------------------------------

    def water_quality(self, lat, lng, radius_km=50.0, date_from=None, date_to=None):
        """(stations, parameter statistics, assessment) of the readings around a place."""
        rows = self.table("water_quality_readings").where(P.optional(
            place=geo.near("lat", "lng", lat, lng, radius_km),
            first=F.col("sampled_at") >= F.to_date(F.lit(date_from)) if date_from else None,
            last=F.col("sampled_at") <= F.to_date(F.lit(date_to)) if date_to else None))
        return A.station_summary(rows), A.parameter_stats(rows), Ha.water_quality_assessment(rows)

    def benthic_habitat(self, lat, lng, radius_km=50.0):
        """(newest visit per site, assessment) around a place."""
        rows = self.table("benthic_samples").where(geo.near("lat", "lng", lat, lng, radius_km))
        return Ha.latest_site_rows(rows), Ha.benthic_assessment(rows)

    def substrate(self, lat, lng, radius_km=10.0) -> DataFrame:
        units = self.table("geology_units").withColumnsRenamed(
            {"centroid_lat": "lat", "centroid_lng": "lng"})
        return Ha.substrate_at(units, lat, lng, radius_km)

    def stream_temperature(self, lat, lng, radius_km=25.0):
        """(stations by distance, most common regime) around a place."""
        rows = self.table("stream_temperature_summaries")
        km = geo.haversine_km(F.lit(lat), F.lit(lng), "lat", "lng")
        near = rows.where(geo.within_haversine("lat", "lng", lat, lng, radius_km)).withColumn(
            "distance_km", F.round(km, 2)).orderBy("distance_km", "station_id")
        return near, Ha.thermal_area(near)

    def piscivore_activity(self, lat, lng, asof: str, radius_km=50.0, days_back=30):
        """(per species code, overall confidence, note) around a place."""
        birds = self.table("bird_observations").where(
            geo.near("lat", "lng", lat, lng, radius_km) & P.since("observed_on", asof, days_back))
        other = self.table("observations").where(
            geo.near("lat", "lng", lat, lng, radius_km)
            & P.contains_any_ci(["common_name"], Bi.NAME_TO_CODE)).withColumn(
            "species_code", A.lookup(Bi.NAME_TO_CODE, F.lower("common_name")))
        summary = Bi.piscivore_summary(birds, other)
        return summary, Bi.presence(summary), Bi.habitat_note(summary, asof)

    # --- network ----------------------------------------------------------------------------

    def _network(self):
        s = self.table("stream_segments")
        number = lambda c: F.split_part(c, F.lit(","), F.lit(1))
        ends = s.select(F.col("start_node").alias("node")).union(s.select("end_node")).distinct()
        positions = ends.select(
            "node", F.split_part("node", F.lit(","), F.lit(2)).try_cast("double").alias("lat"),
            number(F.col("node")).try_cast("double").alias("lng")).where(
            "lat IS NOT NULL AND lng IS NOT NULL")
        return G.build_edges(s, self.table("barriers")), positions

    def analyze_watershed(self, lat, lng, species: str | None = None, radius_km=20.0):
        """(connected records, sentence per species) around a place."""
        edges, positions = self._network()
        found = Ws.analyze(edges, positions, self.table("observations"),
                           self.table("gbif_observations"), lat, lng, species, radius_km)
        return found, Ws.narrative(found)

    def connected_tributaries(self, watercourse: str, species: str | None = None) -> DataFrame:
        edges, _ = self._network()
        return G.tributary_report(G.tributaries(edges, watercourse, species))

    # --- models and scores ------------------------------------------------------------------

    def _predictions(self) -> DataFrame:
        return self.table("sdm_predictions").withColumnsRenamed({
            "presence_probability": "prob", "centroid_lat": "lat", "centroid_lng": "lng"})

    def species_predictions(self, lat, lng, radius_km=10.0, species=None, min_probability=0.0):
        return Sp.species_predictions(self._predictions(), lat, lng, radius_km, species, min_probability)

    def _segments(self) -> DataFrame:
        return self.features.select(
            "ogf_id", F.col("watercourse_name").alias("name"), F.col("centroid_lat").alias("lat"),
            F.col("centroid_lng").alias("lng"))

    def find_untapped_water(self, lat, lng, radius_km=50.0, species=None, min_stream_order=3,
                            limit=10, exclude_likely_culverted=True) -> DataFrame:
        found = Sc.find_untapped_water(self.untapped, self._predictions(), lat, lng, radius_km, species,
                                       min_stream_order, limit, exclude_likely_culverted)
        return Sc.enrich(found, self._segments(), self.table("access_points"), self._predictions(),
                         species=species)

    def find_exploration_targets(self, lat, lng, radius_km=50.0, species=None, mode="balanced",
                                 min_stream_order=3, limit=5,
                                 previously_shown: list[int] | None = None) -> DataFrame:
        dismissed = self.table("dismissed_segments").select("ogf_id")
        if previously_shown:
            shown = dismissed.sparkSession.createDataFrame([(i,) for i in previously_shown], "ogf_id bigint")
            dismissed = dismissed.unionByName(shown)
        seen = Sc.seen_segments(dismissed, self.table("trips"), self._segments())
        found = Sc.find_exploration_targets(self.untapped, self._predictions(), seen, lat, lng,
                                            radius_km, species, min_stream_order, limit, mode)
        near = Sc.nearby_species(found, [self.table("observations"), self.table("gbif_observations")])
        out = Sc.enrich(found, self._segments(), self.table("access_points"), self._predictions(),
                        species=species)
        habitat = self.features.select("ogf_id", "thermal_regime", "ept_quality")
        have = [c for c in ("thermal_regime", "ept_quality") if c not in out.columns]
        out = out.join(habitat.select("ogf_id", *have), "ogf_id", "left").join(near, "ogf_id", "left")
        names = F.coalesce("nearby_species", F.array().cast("array<string>"))
        return out.withColumns({
            "connectivity_note": Sc.connectivity_note(F.col("named_stream_3km"), names),
            "habitat_summary": Sc.habitat_summary()})
