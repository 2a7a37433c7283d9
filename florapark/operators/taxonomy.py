"""Resolving names against a checklist, and the taxonomy of species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from florapark.functions import names as N

ACCEPTED_RANKS = ("Species", "Subspecies", "Variety")
# fixed value: the text that marks a name with several matches
UNRESOLVED = "Could not resolve multiple matches"


def parse_names(names: DataFrame, name: str = "original_name") -> DataFrame:
    return names.withColumns({"parsed_name": N.parsed_name(name), "parsed_author": N.parsed_author(name)})


def unique_taxa(parsed: DataFrame) -> DataFrame:
    """One row per parsed name with its longest author (ties by text) and the number of originals."""
    author = F.col("parsed_author")
    order = F.when(author.isNotNull(), F.struct(-F.length(author), author))
    return parsed.groupBy("parsed_name").agg(
        F.min_by("parsed_author", order).alias("parsed_author"), F.count("*").alias("n_original"))


def _match_columns(joined: DataFrame, match_type: str, name_similarity: Column) -> DataFrame:
    """Similarity from the authors where both are known, else from the names."""
    return joined.select(
        "parsed_name", "plant_name_id", F.col("taxon_name").alias("match_name"), F.col("taxon_status").alias("match_status"),
        "homotypic", "accepted_plant_name_id", F.lit(match_type).alias("match_type"),
        F.coalesce(N.similarity("parsed_author", "taxon_authors"), name_similarity).alias("match_similarity"),
    )


def match_exact(taxa: DataFrame, checklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches by equal name, taxa without one)."""
    hit = taxa.join(checklist, taxa["parsed_name"] == checklist["taxon_name"])
    left = taxa.join(checklist.select(F.col("taxon_name").alias("parsed_name")).distinct(), "parsed_name", "left_anti")
    return _match_columns(hit, "Exact", F.lit(1.0)), left


def _deletion_keys(name: Column, side: str) -> Column:
    """Keys under which two texts at edit distance 1 meet.

    A changed letter: equal position and equal rest. A missing letter: one text equals
    the other without one of its letters. Because the position is part of the key,
    a key is shared by no more distinct texts than there are letters.
    """
    places = F.sequence(F.lit(1), F.length(name))

    def without(i: Column) -> Column:
        return F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name)))

    changed = F.transform(places, lambda i: F.xxhash64(F.lit("c"), i, without(i)))
    whole_tag, part_tag = ("a", "b") if side == "left" else ("b", "a")
    part = F.transform(places, lambda i: F.xxhash64(F.lit(part_tag), without(i)))
    return F.array_distinct(F.concat(changed, part, F.array(F.xxhash64(F.lit(whole_tag), name))))


def match_fuzzy(unmatched: DataFrame, checklist: DataFrame, min_similarity: float = 0.95) -> DataFrame:
    """Matches at edit distance exactly 1 with name similarity of at least ``min_similarity``."""
    import math

    # 1 - 1/n reaches the limit only for names of some length
    shortest = math.ceil(1 / (1 - min_similarity) - 1e-9)
    a = unmatched.where(F.length("parsed_name") >= shortest - 1).select(
        "parsed_name", "parsed_author", F.explode(_deletion_keys(F.col("parsed_name"), "left")).alias("_key"))
    b = checklist.where(F.length("taxon_name") >= shortest - 1).select(
        *checklist.columns, F.explode(_deletion_keys(F.col("taxon_name"), "right")).alias("_key"))
    sim = N.similarity("parsed_name", "taxon_name")
    pairs = (
        a.join(b, "_key").where((F.levenshtein("parsed_name", "taxon_name", 1) == 1) & (sim >= min_similarity))
        .drop("_key").dropDuplicates(["parsed_name", "plant_name_id"])
    )
    return pairs.select(
        "parsed_name", "plant_name_id", F.col("taxon_name").alias("match_name"), F.col("taxon_status").alias("match_status"),
        "homotypic", "accepted_plant_name_id", F.lit("Fuzzy (edit distance)").alias("match_type"), sim.alias("match_similarity"))


def resolve_multi(matches: DataFrame) -> DataFrame:
    """One match per name: accepted first, then homotypic synonyms, then whatever all point to, else unresolved."""
    status, sim = F.col("match_status"), F.col("match_similarity")
    level = (
        F.when(sim.isNull(), 4)
        .when(status == "Accepted", 1)
        .when(status.isin("Synonym", "Orthographic") & F.col("homotypic"), 2)
        .otherwise(3)
    )
    # within the last two levels the first row counts, not the most similar
    order = F.struct(level.alias("level"), F.when(level <= 2, -sim).otherwise(0.0).alias("s"), F.col("plant_name_id").alias("id"))
    rest = [c for c in matches.columns if c != "parsed_name"]
    valid_id = F.when(sim.isNotNull(), F.col("accepted_plant_name_id"))
    picked = matches.groupBy("parsed_name").agg(
        F.min_by(F.struct(*rest), order).alias("m"), F.min(level).alias("_level"), F.count("*").alias("_n"),
        F.min(valid_id).alias("_lo"), F.max(valid_id).alias("_hi"))
    lost = (F.col("_n") > 1) & (F.col("_level") == 3) & ~F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(False))
    return picked.select("parsed_name", "m.*", lost.alias("_lost")).withColumns({
        "match_type": F.when(F.col("_lost"), UNRESOLVED).otherwise(F.col("match_type")),
        "accepted_plant_name_id": F.when(~F.col("_lost"), F.col("accepted_plant_name_id")),
    }).drop("_lost")


def accepted_lookup(resolved: DataFrame, checklist: DataFrame) -> DataFrame:
    """Accepted name behind each match; only accepted or homotypic matches of the usual ranks."""
    target = checklist.select(
        F.col("plant_name_id").alias("accepted_plant_name_id"), F.col("taxon_name").alias("accepted_taxon_name"),
        F.col("taxon_authors").alias("accepted_taxon_authors"), F.col("taxon_rank").alias("accepted_taxon_rank"),
        F.col("taxon_status").alias("_status"), F.col("parent_plant_name_id").alias("_parent"))
    return (
        resolved.join(target, "accepted_plant_name_id")
        .where((F.col("_status") == "Accepted") & F.col("accepted_taxon_rank").isin(*ACCEPTED_RANKS))
        .where((F.col("match_status") == "Accepted") | F.col("homotypic"))
        .drop("_status")
    )


def roll_up_to_species(accepted: DataFrame, checklist: DataFrame) -> DataFrame:
    """Species name of each accepted name: itself, its parent species, or the name without the rank part."""
    parents = checklist.where((F.col("taxon_rank") == "Species") & (F.col("taxon_status") == "Accepted")).select(
        F.col("plant_name_id").alias("_parent"), F.col("taxon_name").alias("_parent_name"))
    name = F.col("accepted_taxon_name")
    return accepted.join(parents, "_parent", "left").withColumn(
        "species_name",
        F.when(F.col("accepted_taxon_rank") == "Species", name)
        .otherwise(F.coalesce("_parent_name", N.strip_rank(name))),
    ).drop("_parent", "_parent_name")


def map_back(parsed: DataFrame, accepted: DataFrame, name: str = "original_name") -> tuple[DataFrame, DataFrame]:
    """(every original name that has an accepted name, the originals that have none)."""
    mapped = parsed.select(name, "parsed_name").join(accepted, "parsed_name")
    return mapped, parsed.join(mapped.select(name).distinct(), name, "left_anti").select(name)


def resolve_names(names: DataFrame, checklist: DataFrame, name: str = "original_name") -> dict[str, DataFrame]:
    """The whole chain: parse, match exactly, match fuzzily, choose, look up, roll up, map back."""
    parsed = parse_names(names, name)
    taxa = unique_taxa(parsed)
    exact, left = match_exact(taxa, checklist)
    matches = exact.unionByName(match_fuzzy(left, checklist))
    resolved = resolve_multi(matches)
    accepted = roll_up_to_species(accepted_lookup(resolved, checklist), checklist)
    mapped, unmatched = map_back(parsed, accepted, name)
    return {"parsed": parsed, "taxa": taxa, "matches": matches, "resolved": resolved, "accepted": accepted,
            "mapped": mapped, "unmatched": unmatched}


def resolution_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of counts over the steps of ``resolve_names``."""
    def n(df: DataFrame, what: Column | None = None) -> Column:
        return df.agg((F.count("*") if what is None else F.count_if(what)).alias("n")).scalar()

    synonym = F.col("match_status") != "Accepted"
    resolved, mapped = parts["resolved"], parts["mapped"]
    return parts["parsed"].agg(F.count("*").alias("n_input")).select(
        "n_input", n(parts["taxa"]).alias("n_taxa"), n(resolved).alias("n_matched_taxa"),
        n(resolved, F.col("match_type") == UNRESOLVED).alias("n_ambiguous"),
        n(mapped).alias("n_mapped"), n(parts["unmatched"]).alias("n_unmatched"),
        n(mapped, synonym & F.col("homotypic")).alias("n_homotypic_used"),
        n(resolved, synonym & ~F.col("homotypic") & F.col("accepted_plant_name_id").isNotNull()).alias("n_heterotypic_dropped"),
    )


def apply_resolution(occ: DataFrame, mapped: DataFrame, plot_species: DataFrame | None = None) -> DataFrame:
    """Records under their accepted species name, the old name kept; optionally only species of the plots."""
    names = mapped.select("original_name", "species_name").distinct()
    out = occ.withColumnRenamed("species", "original_name").join(names, "original_name").withColumnRenamed("species_name", "species")
    if plot_species is not None:
        out = out.join(plot_species.select("species").distinct(), "species", "left_semi")
    return out


def name_groups(mapped: DataFrame) -> DataFrame:
    """How many original names each accepted species gathers, with the first and last of them."""
    return mapped.groupBy("species_name").agg(
        F.count_distinct("original_name").alias("n_names"), F.min("original_name").alias("first_name"),
        F.max("original_name").alias("last_name"))


def growth_forms(species: DataFrame, checklist: DataFrame) -> DataFrame:
    """Life form text of each species (first accepted row per name) and its coarse growth form."""
    first = checklist.groupBy(F.col("taxon_name").alias("species_name")).agg(
        F.min_by("lifeform_description", "plant_name_id").alias("lifeform_description"))
    return species.join(first, "species_name", "left").withColumn("growth_form", N.growth_form("lifeform_description"))


HIGHER_RANKS = ("kingdom", "phylum", "class", "order")


def taxonomy(species: DataFrame, checklist: DataFrame, families: DataFrame) -> DataFrame:
    """Genus and family from the checklist, higher ranks from the family table, else ``unknown``.

    Without a checklist row the genus is the first word of the name.
    """
    first = checklist.groupBy(F.col("taxon_name").alias("species_name")).agg(
        F.min_by(F.struct("genus", "family"), "plant_name_id").alias("t"))
    ranks = [r for r in HIGHER_RANKS if r in families.columns]
    placed = species.join(first, "species_name", "left").select(
        "species_id", "species_name",
        F.coalesce("t.genus", F.get(F.split("species_name", " "), 0)).alias("genus"),
        F.coalesce("t.family", F.lit("unknown")).alias("family"))
    return placed.join(families.select("family", *ranks), "family", "left").select(
        "species_id", "species_name", "genus", "family", *[F.coalesce(r, F.lit("unknown")).alias(r) for r in ranks])


def compare_name_sets(a: DataFrame, b: DataFrame, name: str = "species_name") -> tuple[DataFrame, DataFrame]:
    """(names of a missing from b, one row of counts)."""
    missing = a.select(name).distinct().join(b.select(name).distinct(), name, "left_anti")
    return missing, missing.agg(F.count("*").alias("n_missing"))
