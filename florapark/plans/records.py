"""Queries on record cleaning and name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from florapark.functions import names as N
from florapark.operators import cleaning as C, spatial as SP, taxonomy as T
from florapark.operators.ranking import spread
from florapark.plans.inputs import Inputs
from florapark.plans.places import CROSS
from florapark.plans.registry import query

# occurrence rows with coordinates; copies share everything but their order of arrival
OCC = """occ AS (SELECT o.species_id, o.location_id, o.uncertainty_m, o.basis_of_record, l.lon, l.lat FROM fx_occurrence o JOIN fx_location l ON o.location_id = l.location_id)"""
OCC_VIEWS = "fx_occurrence fx_location"


def occ(t: Inputs) -> DataFrame:
    return t.fx_occurrence.join(t.fx_location.select("location_id", "lon", "lat"), "location_id")


def placed_records(t: Inputs) -> DataFrame:
    """Occurrence rows with coordinates; those of one species and place lie in one partition."""
    n = t.n_rows("lineitem")
    rows = spread(t.fx_occurrence.select("species_id", "location_id"), n, "location_id").join(t.fx_location.select("location_id", "lon", "lat"), "location_id")
    return spread(rows, n, "species_id", "lon", "lat")


@query("f1_filter_plots", "SELECT location_id, plot_quality, sampled_area_m2 FROM fx_location WHERE plot_quality IN ('1-URGENT', '2-HIGH') AND sampled_area_m2 <= 250", "fx_location")
def _(t):
    p = C.filter_plots(t.fx_location, "plot_quality", "sampled_area_m2", ("1-URGENT", "2-HIGH"), 250)
    return p.select("location_id", "plot_quality", "sampled_area_m2")


@query("f2_project_occurrences", "SELECT c_custkey, c_acctbal, CASE WHEN c_nationkey < 20 THEN CAST(c_nationkey AS DOUBLE) END AS lon, c_acctbal AS lat FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(t):
    raw = t.customer.select(
        "c_custkey", "c_acctbal",
        F.when(F.col("c_nationkey") < 20, F.col("c_nationkey").cast("string")).otherwise("n/a").alias("lon"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal").cast("string")).alias("lat"))
    return C.project_occurrences(raw, "lon", "lat", ["c_custkey", "c_acctbal", "lon", "lat"])


@query("f3_iso2_to_iso3", "SELECT c_custkey, n_name AS country FROM customer LEFT JOIN nation ON CAST(c_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR) AND n_regionkey < 4")
def _(t):
    codes = t.nation.where("n_regionkey < 4").select(F.col("n_nationkey").cast("string").alias("iso2"), F.col("n_name").alias("iso3"))
    return C.with_country3(t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("country")), codes, "country")


# coordinates that can fail: the account balances of customers
XY = "xy AS (SELECT c_custkey, c_acctbal / 50 AS lon, c_nationkey * 5.0E0 - 40 AS lat FROM customer)"


def xy(t: Inputs) -> DataFrame:
    return t.customer.select("c_custkey", (F.col("c_acctbal") / 50).alias("lon"), (F.col("c_nationkey") * 5.0 - 40).alias("lat"))


@query("f4_valid_coordinates", f"WITH {XY} SELECT c_custkey, coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) AS ok_validity FROM xy")
def _(t):
    return xy(t).select("c_custkey", C.valid_coordinates("lon", "lat").alias("ok_validity"))


@query("f5_not_zero", f"WITH {XY} SELECT c_custkey, NOT (lon = 0 OR lat = 0 OR lon * lon + lat * lat <= 25) AS ok_zeros FROM xy")
def _(t):
    return xy(t).select("c_custkey", C.not_zero("lon", "lat", 5.0).alias("ok_zeros"))


@query("f6_not_equal", "SELECT c_custkey, abs(round(c_acctbal / 500)) <> abs(c_nationkey - 8.0E0) AS ok_equal FROM customer")
def _(t):
    p = t.customer.select("c_custkey", F.round(F.col("c_acctbal") / 500).alias("lon"), (F.col("c_nationkey") - 8.0).alias("lat"))
    return p.select("c_custkey", C.not_equal("lon", "lat").alias("ok_equal"))


@query("f7_flag_duplicates", f"WITH {OCC} SELECT species_id, location_id, lon, lat, count(*) AS n, location_id = min(location_id) OVER (PARTITION BY species_id, lon, lat) AS ok_duplicates FROM occ GROUP BY species_id, location_id, lon, lat", OCC_VIEWS)
def _(t):
    rows = placed_records(t).groupBy("species_id", "location_id", "lon", "lat").agg(F.count("*").alias("n"))
    return C.flag_duplicates(rows, ["species_id", "lon", "lat"], "location_id")


_HAV = """2 * 6371008.8E0 * asin(sqrt(least(1.0E0, pow(sin(radians(p.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2))))"""


@query("f8_near_reference", f"""SELECT location_id, NOT EXISTS (SELECT 1 FROM fx_reference_point p WHERE {_HAV} <= p.radius_m) AS ok_reference FROM fx_location l""", "fx_location fx_reference_point")
def _(t):
    return C.flag_near_reference(t.fx_location, t.fx_reference_point).select("location_id", "ok_reference")


def in_edges(view: str, name: str) -> str:
    return f"{name} AS (SELECT lon, lat FROM (SELECT p.lon, p.lat, e.area_code FROM (SELECT DISTINCT lon, lat FROM fx_location) p CROSS JOIN {view} e GROUP BY ALL HAVING count(*) FILTER (WHERE {CROSS}) % 2 = 1) GROUP BY ALL)"


@query("f9_seas_urban", f"""WITH {in_edges('fx_polygon_edge', 'land')}, {in_edges('fx_urban_edge', 'town')}
 SELECT location_id, l.lon IS NOT NULL AS ok_seas, t.lon IS NULL AS ok_urban FROM fx_location f LEFT JOIN land l ON f.lon = l.lon AND f.lat = l.lat LEFT JOIN town t ON f.lon = t.lon AND f.lat = t.lat""", "fx_location fx_polygon_edge fx_urban_edge")
def _(t):
    on_land = SP.flag_inside(t.fx_location, t.fx_polygon_edge, "ok_seas")
    both = SP.flag_inside(on_land, t.fx_urban_edge, "_urban")
    return both.select("location_id", "ok_seas", (~F.col("_urban")).alias("ok_urban"))


FLAGGED = f"""flagged AS (SELECT species_id, location_id, lon BETWEEN 8.0E0 AND 8.5E0 AS ok_validity, lat <> 46.2E0 AS ok_zeros,
 row_number() OVER (PARTITION BY species_id, lon, lat ORDER BY location_id) = 1 AS ok_duplicates FROM (SELECT DISTINCT species_id, location_id, lon, lat FROM occ))"""


def flagged(t: Inputs) -> DataFrame:
    rows = placed_records(t).distinct().withColumns({
        "ok_validity": F.col("lon").between(8.0, 8.5), "ok_zeros": F.col("lat") != 46.2})
    return C.flag_duplicates(rows, ["species_id", "lon", "lat"], "location_id")


FLAGS = ("ok_validity", "ok_zeros", "ok_duplicates")


@query("f10_flag_summary", f"""WITH {OCC}, {FLAGGED} SELECT count(*) AS n_records, count(*) FILTER (WHERE ok_validity AND ok_zeros AND ok_duplicates) AS n_passed,
 count(*) FILTER (WHERE NOT ok_validity) AS failed_validity, count(*) FILTER (WHERE NOT ok_zeros) AS failed_zeros, count(*) FILTER (WHERE NOT ok_duplicates) AS failed_duplicates FROM flagged""", OCC_VIEWS)
def _(t):
    return C.flag_summary(flagged(t), FLAGS)[1]


@query("f10_passing_records", f"WITH {OCC}, {FLAGGED} SELECT species_id, location_id FROM flagged WHERE ok_validity AND ok_zeros AND ok_duplicates", OCC_VIEWS)
def _(t):
    return C.flag_summary(flagged(t), FLAGS)[0].select("species_id", "location_id")


@query("f11_precise_enough", "SELECT species_id, location_id, uncertainty_m FROM fx_occurrence WHERE uncertainty_m IS NULL OR uncertainty_m / 1000 <= 1", "fx_occurrence")
def _(t):
    return t.fx_occurrence.where(C.precise_enough("uncertainty_m")).select("species_id", "location_id", "uncertainty_m")


@query("f12_accepted_basis", "SELECT species_id, location_id, basis_of_record FROM fx_occurrence WHERE basis_of_record IN ('HUMAN_OBSERVATION', 'PRESERVED_SPECIMEN')", "fx_occurrence")
def _(t):
    return t.fx_occurrence.where(C.accepted_basis("basis_of_record")).select("species_id", "location_id", "basis_of_record")


DIST = """dist AS (SELECT plant_name_id, n_nationkey AS area_code_l3, CASE WHEN (plant_name_id + n_nationkey) % 3 = 0 THEN 1 ELSE 0 END AS introduced,
 CASE WHEN (plant_name_id + n_nationkey) % 7 = 0 THEN 1 ELSE 0 END AS extinct, CASE WHEN (plant_name_id + n_nationkey) % 11 = 0 THEN 1 ELSE 0 END AS location_doubtful
 FROM {names} JOIN {nation} ON plant_name_id % 5 = n_regionkey)"""
NATIVE = """native AS (SELECT DISTINCT taxon_name, area_code_l3 AS area_code FROM fx_name n JOIN dist d ON n.plant_name_id = d.plant_name_id
 WHERE taxon_rank = 'Species' AND taxon_status = 'Accepted' AND introduced = 0 AND extinct = 0 AND location_doubtful = 0)"""
_DIST_SQL = DIST.format(names="fx_name", nation="nation")


def distribution(t: Inputs) -> DataFrame:
    return t.spark.sql("WITH " + DIST + " SELECT * FROM dist", names=t.fx_name, nation=t.nation)


@query("f13_accepted_native_areas", f"WITH {_DIST_SQL}, {NATIVE} SELECT * FROM native", "fx_name")
def _(t):
    return C.accepted_native_areas(t.fx_name, distribution(t))


ALL_RANGES = "ranges AS (SELECT DISTINCT taxon_name, area_code_l3 AS area_code FROM fx_name n JOIN dist d ON n.plant_name_id = d.plant_name_id WHERE introduced = 0)"


def homonyms(t: Inputs):
    ranges = t.fx_name.join(distribution(t).where("introduced = 0"), "plant_name_id").select("taxon_name", F.col("area_code_l3").alias("area_code")).distinct()
    return C.split_homonym_areas(ranges, C.accepted_native_areas(t.fx_name, distribution(t)))


@query("f14_homonym_areas_kept", f"WITH {_DIST_SQL}, {NATIVE}, {ALL_RANGES} SELECT * FROM ranges INTERSECT SELECT * FROM native", "fx_name")
def _(t):
    return homonyms(t)[0]


@query("f14_homonym_areas_dropped", f"WITH {_DIST_SQL}, {NATIVE}, {ALL_RANGES} SELECT * FROM ranges EXCEPT SELECT * FROM native", "fx_name")
def _(t):
    return homonyms(t)[1]


@query("f15_quarantine", """WITH a AS (SELECT species_id FROM fx_occurrence WHERE basis_of_record = 'HUMAN_OBSERVATION' GROUP BY 1 HAVING count(*) >= 180), b AS (SELECT DISTINCT o.species_id FROM fx_occurrence o JOIN fx_species s ON o.species_id = s.species_id WHERE home_area >= 2),
 c AS (SELECT species_id FROM fx_occurrence WHERE basis_of_record = 'FOSSIL_SPECIMEN' GROUP BY 1 HAVING count(*) >= 200)
 SELECT species_id, CASE WHEN species_id NOT IN (SELECT * FROM a) THEN 'no records' WHEN species_id NOT IN (SELECT * FROM b) THEN 'no native range' ELSE 'no valid points' END AS reason FROM fx_species
 WHERE species_id NOT IN (SELECT * FROM a) OR species_id NOT IN (SELECT * FROM b) OR species_id NOT IN (SELECT * FROM c)""", "fx_occurrence fx_species")
def _(t):
    o = t.fx_occurrence
    native = o.join(t.fx_species.where("home_area >= 2"), "species_id", "left_semi")
    many = C.min_support(o.where("basis_of_record = 'FOSSIL_SPECIMEN'"), 200)
    return C.quarantine(t.fx_species, [("no records", C.min_support(o.where("basis_of_record = 'HUMAN_OBSERVATION'"), 180)), ("no native range", native), ("no valid points", many)])


@query("f16_skip_existing", "SELECT species_id, species_name FROM fx_species WHERE species_id NOT IN (SELECT species_id FROM fx_occurrence WHERE uncertainty_m > 2450 AND basis_of_record = 'FOSSIL_SPECIMEN')", "fx_species fx_occurrence")
def _(t):
    done = t.fx_occurrence.where("uncertainty_m > 2450 and basis_of_record = 'FOSSIL_SPECIMEN'")
    return C.skip_existing(t.fx_species, done).select("species_id", "species_name")


@query("f17_drop_unmatched", "SELECT location_id, species_id FROM fx_presence WHERE species_id NOT IN (SELECT species_id FROM fx_species WHERE home_area < 5)", "fx_presence fx_species")
def _(t):
    return C.drop_unmatched(t.fx_presence, t.fx_species.where("home_area < 5"), "species_id")


@query("f18_min_support", "SELECT location_id, species_id FROM fx_presence WHERE species_id IN (SELECT species_id FROM fx_presence GROUP BY 1 HAVING count(*) >= 600)", "fx_presence")
def _(t):
    return C.min_support(t.fx_presence, 600)


@query("f19_keep_shared_species", "SELECT species_id, location_id FROM (SELECT nullif(species_id, 7) AS species_id, location_id FROM fx_presence) WHERE species_id IS NULL OR species_id IN (SELECT species_id FROM fx_species WHERE home_area < 12)", "fx_presence fx_species")
def _(t):
    rec = t.fx_presence.select(F.nullif("species_id", F.lit(7)).alias("species_id"), "location_id")
    return C.keep_shared_species(rec, t.fx_species.where("home_area < 12"))


@query("f20_missing_keys", "SELECT species_id, location_id FROM fx_occurrence WHERE uncertainty_m IS NULL", "fx_occurrence")
def _(t):
    return C.split_missing_keys(t.fx_occurrence, "uncertainty_m")[1].select("species_id", "location_id")


@query("f20_remove_listed", "SELECT species_id, location_id FROM fx_occurrence WHERE uncertainty_m IS NOT NULL AND location_id NOT IN (SELECT location_id FROM fx_occurrence WHERE uncertainty_m IS NULL)", "fx_occurrence")
def _(t):
    kept, gone = C.split_missing_keys(t.fx_occurrence, "uncertainty_m")
    return C.remove_listed(kept, gone, "location_id").select("species_id", "location_id")


@query("f21_dedupe_species_location", f"WITH {OCC} SELECT species_id, lon, lat, min(location_id) AS location_id FROM occ GROUP BY 1, 2, 3", OCC_VIEWS)
def _(t):
    return C.dedupe_species_location(occ(t).select("species_id", "lon", "lat", "location_id"), ["species_id", "lon", "lat"], ["location_id"])


@query("f22_clean_name", "SELECT p_partkey, replace(trim('  ' || replace(p_name, ' ', chr(9)) || ' '), chr(9), ' ') AS name FROM part")
def _(t):
    messy = F.concat(F.lit("  "), F.translate("p_name", " ", "\t"), F.lit(" "))
    return t.part.select("p_partkey", N.clean_name(messy).alias("name"))


@query("f23_bbox_filter", "SELECT location_id, lon, lat FROM fx_location WHERE lon BETWEEN 8.1 AND 8.3 AND lat BETWEEN 46.1 AND 46.25", "fx_location")
def _(t):
    return C.bbox_filter(t.fx_location, 8.1, 46.1, 8.3, 46.25).select("location_id", "lon", "lat")


@query("f25_finite_only", "SELECT seed, species_id, value FROM fx_seed_metric WHERE value IS NOT NULL AND value <> 0", "fx_seed_metric")
def _(t):
    odd = t.fx_seed_metric.withColumn("value", F.when(F.col("value") == 0, F.lit(float("inf"))).when(F.col("value").isNull(), F.lit(float("nan"))).otherwise(F.col("value")))
    return C.finite_only(odd).select("seed", "species_id", "value")


@query("f26_mask_labels", "SELECT location_id, species_id, label FROM masked", "fx_location fx_species_area fx_prediction masked")
def _(t):
    return t.in_range_prediction.select("location_id", "species_id", "label")


# ---- names ----

WORDS = r"""words AS (SELECT name_id, scientific_name, string_split_regex(scientific_name, '\s+') AS w FROM fx_scientific_name),
parsed AS (SELECT name_id, scientific_name AS original_name,
  CASE WHEN len(w) <= 2 THEN scientific_name WHEN len(w) >= 4 AND regexp_matches(w[3], '^(subsp|var|f|subvar|forma)\.?$') THEN array_to_string(w[1:4], ' ') ELSE array_to_string(w[1:2], ' ') END AS parsed_name,
  CASE WHEN len(w) <= 2 THEN NULL WHEN len(w) >= 4 AND regexp_matches(w[3], '^(subsp|var|f|subvar|forma)\.?$') THEN CASE WHEN len(w) > 4 THEN array_to_string(w[5:], ' ') END ELSE array_to_string(w[3:], ' ') END AS parsed_author FROM words)"""
TAXA = """taxa AS (SELECT parsed_name, first(parsed_author ORDER BY length(parsed_author) DESC, parsed_author) FILTER (WHERE parsed_author IS NOT NULL) AS parsed_author, count(*) AS n_original FROM parsed GROUP BY 1)"""
EXACT = """exact AS (SELECT parsed_name, plant_name_id, taxon_name AS match_name, taxon_status AS match_status, homotypic, accepted_plant_name_id, 'Exact' AS match_type,
 coalesce(1 - levenshtein(parsed_author, taxon_authors) / CAST(greatest(length(parsed_author), length(taxon_authors)) AS DOUBLE), 1.0) AS match_similarity FROM taxa JOIN fx_name ON parsed_name = taxon_name)"""
FUZZY = """fuzzy AS (SELECT parsed_name, plant_name_id, taxon_name AS match_name, taxon_status AS match_status, homotypic, accepted_plant_name_id, 'Fuzzy (edit distance)' AS match_type,
 1 - 1 / CAST(greatest(length(parsed_name), length(taxon_name)) AS DOUBLE) AS match_similarity FROM taxa JOIN fx_name ON levenshtein(parsed_name, taxon_name) = 1
 WHERE parsed_name NOT IN (SELECT taxon_name FROM fx_name) AND 1 - 1 / CAST(greatest(length(parsed_name), length(taxon_name)) AS DOUBLE) >= 0.95)"""
RESOLVED = """allm AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy),
lev AS (SELECT *, CASE WHEN match_similarity IS NULL THEN 4 WHEN match_status = 'Accepted' THEN 1 WHEN match_status IN ('Synonym', 'Orthographic') AND homotypic THEN 2 ELSE 3 END AS lv FROM allm),
best AS (SELECT *, row_number() OVER (PARTITION BY parsed_name ORDER BY lv, CASE WHEN lv <= 2 THEN -match_similarity ELSE 0 END, plant_name_id) AS k,
  count(*) OVER (PARTITION BY parsed_name) > 1 AND min(lv) OVER (PARTITION BY parsed_name) = 3 AND count(DISTINCT accepted_plant_name_id) OVER (PARTITION BY parsed_name) <> 1 AS lost FROM lev),
resolved AS (SELECT parsed_name, plant_name_id, match_name, match_status, homotypic, CASE WHEN NOT lost THEN accepted_plant_name_id END AS accepted_plant_name_id,
  CASE WHEN lost THEN 'Could not resolve multiple matches' ELSE match_type END AS match_type, match_similarity FROM best WHERE k = 1)"""
ACCEPTED = r"""acc AS (SELECT r.*, c.taxon_name AS accepted_taxon_name, c.taxon_authors AS accepted_taxon_authors, c.taxon_rank AS accepted_taxon_rank, c.parent_plant_name_id AS parent FROM resolved r
  JOIN fx_name c ON r.accepted_plant_name_id = c.plant_name_id WHERE c.taxon_status = 'Accepted' AND c.taxon_rank IN ('Species', 'Subspecies', 'Variety') AND (match_status = 'Accepted' OR r.homotypic)),
rolled AS (SELECT a.*, CASE WHEN accepted_taxon_rank = 'Species' THEN accepted_taxon_name WHEN p.taxon_name IS NOT NULL THEN p.taxon_name
  ELSE regexp_replace(accepted_taxon_name, '\s+(var|subsp|f|subvar|forma)\.?\s+.*', '') END AS species_name FROM acc a LEFT JOIN fx_name p ON a.parent = p.plant_name_id AND p.taxon_rank = 'Species' AND p.taxon_status = 'Accepted'),
mapped AS (SELECT original_name, r.* FROM parsed p JOIN rolled r ON p.parsed_name = r.parsed_name)"""
NAME_VIEWS = "fx_scientific_name fx_name"
CHAIN = f"WITH {WORDS}, {TAXA}, {EXACT}, {FUZZY}, {RESOLVED}, {ACCEPTED}"


def originals(t: Inputs) -> DataFrame:
    return t.fx_scientific_name.select("name_id", F.col("scientific_name").alias("original_name"))


def taxa(t: Inputs) -> DataFrame:
    return T.unique_taxa(T.parse_names(originals(t)))


def chain(t: Inputs) -> dict[str, DataFrame]:
    return T.resolve_names(originals(t), t.fx_name)


@query("t1_parse_scientific_name", f"WITH {WORDS} SELECT name_id, parsed_name, parsed_author FROM parsed", NAME_VIEWS)
def _(t):
    return T.parse_names(originals(t)).select("name_id", "parsed_name", "parsed_author")


@query("t2_unique_taxa", f"WITH {WORDS}, {TAXA} SELECT * FROM taxa", NAME_VIEWS)
def _(t):
    return taxa(t)


@query("t3_match_exact", f"WITH {WORDS}, {TAXA}, {EXACT} SELECT parsed_name, plant_name_id, match_status, round(match_similarity, 6) AS match_similarity FROM exact", NAME_VIEWS)
def _(t):
    return T.match_exact(taxa(t), t.fx_name)[0].select("parsed_name", "plant_name_id", "match_status", F.round("match_similarity", 6).alias("match_similarity"))


@query("t4_match_fuzzy", f"WITH {WORDS}, {TAXA}, {FUZZY} SELECT parsed_name, plant_name_id, match_name, round(match_similarity, 6) AS match_similarity FROM fuzzy", NAME_VIEWS)
def _(t):
    left = T.match_exact(taxa(t), t.fx_name)[1]
    return T.match_fuzzy(left, t.fx_name).select("parsed_name", "plant_name_id", "match_name", F.round("match_similarity", 6).alias("match_similarity"))


@query("t5_resolve_multi", f"{CHAIN} SELECT parsed_name, plant_name_id, match_status, accepted_plant_name_id, match_type FROM resolved", NAME_VIEWS)
def _(t):
    return chain(t)["resolved"].select("parsed_name", "plant_name_id", "match_status", "accepted_plant_name_id", "match_type")


@query("t6_accepted_lookup", f"{CHAIN} SELECT parsed_name, accepted_plant_name_id, accepted_taxon_name, accepted_taxon_authors, accepted_taxon_rank FROM acc", NAME_VIEWS)
def _(t):
    return T.accepted_lookup(chain(t)["resolved"], t.fx_name).select("parsed_name", "accepted_plant_name_id", "accepted_taxon_name", "accepted_taxon_authors", "accepted_taxon_rank")


@query("t7_roll_up_to_species", f"{CHAIN} SELECT parsed_name, accepted_taxon_name, species_name FROM rolled", NAME_VIEWS)
def _(t):
    return chain(t)["accepted"].select("parsed_name", "accepted_taxon_name", "species_name")


@query("t8_map_back", f"{CHAIN} SELECT original_name, species_name, match_type FROM mapped", NAME_VIEWS)
def _(t):
    return chain(t)["mapped"].select("original_name", "species_name", "match_type")


@query("t8_unmatched_names", f"{CHAIN} SELECT original_name FROM parsed WHERE original_name NOT IN (SELECT original_name FROM mapped)", NAME_VIEWS)
def _(t):
    return chain(t)["unmatched"]


@query("t9_resolution_summary", f"""{CHAIN} SELECT (SELECT count(*) FROM parsed) AS n_input, (SELECT count(*) FROM taxa) AS n_taxa, (SELECT count(*) FROM resolved) AS n_matched_taxa,
 (SELECT count(*) FROM resolved WHERE match_type LIKE 'Could%') AS n_ambiguous, (SELECT count(*) FROM mapped) AS n_mapped, (SELECT count(*) FROM parsed WHERE original_name NOT IN (SELECT original_name FROM mapped)) AS n_unmatched,
 (SELECT count(*) FROM mapped WHERE match_status <> 'Accepted' AND homotypic) AS n_homotypic_used, (SELECT count(*) FROM resolved WHERE match_status <> 'Accepted' AND NOT homotypic AND accepted_plant_name_id IS NOT NULL) AS n_heterotypic_dropped""", NAME_VIEWS)
def _(t):
    return T.resolution_summary(chain(t))


@query("t10_apply_resolution", f"""{CHAIN} SELECT m.original_name, m.species_name AS species, l_orderkey AS location_id, count(*) AS n FROM lineitem JOIN fx_scientific_name s ON l_partkey = name_id
 JOIN (SELECT DISTINCT original_name, species_name FROM mapped) m ON m.original_name = s.scientific_name WHERE m.species_name IN (SELECT species_name FROM mapped WHERE match_status = 'Synonym') GROUP BY ALL""", NAME_VIEWS)
def _(t):
    records = t.lineitem.join(t.fx_scientific_name, t.lineitem["l_partkey"] == F.col("name_id")).select(
        F.col("scientific_name").alias("species"), F.col("l_orderkey").alias("location_id"))
    mapped = chain(t)["mapped"]
    plots = mapped.where("match_status = 'Synonym'").select(F.col("species_name").alias("species"))
    return T.apply_resolution(records, mapped, plots).groupBy("original_name", "species", "location_id").agg(F.count("*").alias("n"))


@query("t10_name_groups", f"{CHAIN} SELECT species_name, count(DISTINCT original_name) AS n_names, min(original_name) AS first_name, max(original_name) AS last_name FROM mapped GROUP BY 1", NAME_VIEWS)
def _(t):
    return T.name_groups(chain(t)["mapped"])


PART_SPECIES = "sp AS (SELECT min(p_partkey) AS species_id, p_name AS species_name FROM part GROUP BY 2)"


def part_species(t: Inputs) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("species_name")).agg(F.min("p_partkey").alias("species_id"))


@query("t11_growth_form", f"""WITH {PART_SPECIES}, f AS (SELECT taxon_name, arg_min_null(lifeform_description, plant_name_id) AS lifeform_description FROM fx_name GROUP BY 1)
 SELECT species_id, species_name, lifeform_description, CASE WHEN lifeform_description IS NULL THEN 'unknown' WHEN lifeform_description IN ('shrub or tree', 'bamboo') THEN 'tree'
  WHEN lifeform_description IN ('liana', 'climbing subshrub') THEN 'shrub' ELSE 'herb' END AS growth_form FROM sp LEFT JOIN f ON species_name = taxon_name""", "fx_name")
def _(t):
    return T.growth_forms(part_species(t), t.fx_name)


@query("t12_taxonomy", f"""WITH {PART_SPECIES}, f AS (SELECT taxon_name, first(genus ORDER BY plant_name_id) AS genus, first(family ORDER BY plant_name_id) AS family FROM fx_name GROUP BY 1),
 fam AS (SELECT p_brand AS family, min(p_type) AS "order" FROM part GROUP BY 1)
 SELECT species_id, species_name, coalesce(f.genus, split_part(species_name, ' ', 1)) AS genus, coalesce(f.family, 'unknown') AS family, coalesce("order", 'unknown') AS "order" FROM sp LEFT JOIN f ON species_name = taxon_name LEFT JOIN fam ON fam.family = f.family""", "fx_name")
def _(t):
    families = t.part.groupBy(F.col("p_brand").alias("family")).agg(F.min("p_type").alias("order"))
    return T.taxonomy(part_species(t), t.fx_name, families)


@query("t13_compare_name_sets", "SELECT DISTINCT p_name AS species_name FROM part WHERE p_name NOT IN (SELECT taxon_name FROM fx_name WHERE taxon_status = 'Synonym' AND homotypic)", "fx_name")
def _(t):
    return T.compare_name_sets(part_species(t), t.fx_name.where("taxon_status = 'Synonym' and homotypic").select(F.col("taxon_name").alias("species_name")))[0]
