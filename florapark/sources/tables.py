"""Reading raw inputs and writing keyed tables."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from florapark.operators.ranking import global_index

# fixed values: the raw occurrence columns
OCCURRENCE_SCHEMA = T.StructType([
    T.StructField("scientificName", T.StringType()),
    T.StructField("decimalLongitude", T.DoubleType()),
    T.StructField("decimalLatitude", T.DoubleType()),
    T.StructField("countryCode", T.StringType()),
    T.StructField("individualCount", T.IntegerType()),
    T.StructField("gbifID", T.LongType()),
    T.StructField("family", T.StringType()),
    T.StructField("taxonRank", T.StringType()),
    T.StructField("coordinateUncertaintyInMeters", T.DoubleType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("basisOfRecord", T.StringType()),
    T.StructField("institutionCode", T.StringType()),
    T.StructField("datasetKey", T.StringType()),
])


def read_occurrences(spark: SparkSession, path: str, schema: T.StructType = OCCURRENCE_SCHEMA) -> DataFrame:
    """Tab-separated, unquoted occurrence download; species = scientificName.

    A row with another number of fields than the header is skipped, whatever columns are
    read later; a value that does not fit its type is null. Columns the header lacks are null.
    """
    lines = spark.read.text(path)
    top = lines.first()
    names = [] if top is None else top["value"].split("\t")
    fields = lines.where(F.col("value") != F.lit(top["value"] if top else "")).select(F.split("value", "\t", -1).alias("f")).where(
        F.size("f") == len(names))

    def value(f: T.StructField) -> Column:
        if f.name not in names:
            return F.lit(None).cast(f.dataType)
        raw = F.nullif(F.get("f", F.lit(names.index(f.name))), F.lit(""))
        # whole numbers may be written with a fraction
        number = raw.try_cast("double").try_cast(f.dataType) if isinstance(f.dataType, T.IntegralType) else None
        return raw.try_cast(f.dataType) if number is None else F.coalesce(raw.try_cast(f.dataType), number)

    return fields.select(*[value(f).alias(f.name) for f in schema.fields]).withColumn("species", F.col("scientificName"))


def write_by_species(
    occ: DataFrame, path: str, rows_per_file: int = 1_000_000, key: str = "species", load: str = "base",
) -> None:
    """Parquet folder per load and species (``load=.../key=...``); empty names dropped.

    Each load has a name of its own and replaces what an earlier run under that name
    wrote, so a job that is repeated leaves the same rows; other loads stay. A species is
    written by as many tasks as its number of rows calls for.
    """
    named = occ.drop("load").where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    files = named.groupBy(key).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    rest = [c for c in named.columns if c != key]
    salted = named.join(files, key).withColumn("_part", F.pmod(F.xxhash64(*rest), F.col("_files")))
    # dynamic overwrite would keep the species that a repeated load no longer has, so the load's folder is replaced whole
    salted.repartition(key, "_part").drop("_files", "_part").write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy(key).parquet(f"{path.rstrip('/')}/load={quote(load, safe='')}")


def read_plots(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t") -> DataFrame:
    """Latin-1 text table of vegetation plots; the cleaned copy uses ';' as separator."""
    return spark.read.option("sep", sep).option("header", True).option("encoding", "ISO-8859-1").schema(schema).csv(path)


def join_plots(species: DataFrame, header: DataFrame) -> DataFrame:
    return species.join(header, "PlotObservationID")


def read_checklist(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """'|'-separated checklist file without quoting."""
    return spark.read.option("sep", "|").option("quote", "").option("header", True).schema(schema).csv(path)


def concat_species_files(spark: SparkSession, path: str, error_log: str = "erroneous_species") -> DataFrame:
    """All cleaned per-species tables below a folder as one, all loads together, without the error log."""
    every = spark.read.option("recursiveFileLookup", False).option("mergeSchema", True).parquet(path)
    return every.where(~F.col("_metadata.file_path").contains(error_log)).drop("load")


def union_tables(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def save_targets(presence: DataFrame, path: str) -> None:
    """Presence pairs once each, clustered by species for pruned reads."""
    pairs = presence.select("location_id", "species_id").distinct()
    pairs.repartitionByRange("species_id", "location_id").sortWithinPartitions("species_id", "location_id").write.mode("overwrite").parquet(path)


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("value", F.lit(1))


def target_shape(presence: DataFrame, locations: DataFrame, species: DataFrame) -> DataFrame:
    """Row count, species count and number of stored ones."""
    return presence.select("location_id", "species_id").distinct().agg(
        F.count("*").alias("n_presences")
    ).select(
        locations.agg(F.count("*").alias("n")).scalar().alias("n_rows"),
        species.agg(F.count("*").alias("n")).scalar().alias("n_species"),
        "n_presences",
    )


def species_index(presence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Species-major index of the presence table.

    Entries: one row per pair with its slot in (species, location) order. Lookup: first
    slot and length per species. The list of a species is its run of slots, so no
    species is ever gathered into one value.
    """
    entries = global_index(presence.select("species_id", "location_id").distinct(), ["species_id", "location_id"], "slot")
    lookup = entries.groupBy("species_id").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n"))
    return entries, lookup


def species_dictionary(occ: DataFrame, name: str = "species_name") -> DataFrame:
    """Sorted unique names numbered from 0."""
    return global_index(occ.select(name).where(F.col(name).isNotNull()).distinct(), [name], "species_id")


def species_metrics_table(long: DataFrame, species: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per species with its name and one column per metric."""
    wide = long.groupBy("species_id").pivot("metric", list(metrics)).agg(F.first("value", ignorenulls=True))
    return species.select("species_id", "species_name").join(wide, "species_id", "left")


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Store a table hashed and sorted by its join keys, so that joins and groupings on them need no shuffle of it."""
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
