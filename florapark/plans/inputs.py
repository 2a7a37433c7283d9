"""The standard tables and the views derived from them (see FIXTURES.md).

Roles: supplier = species, order = location, nation = botanical area, region =
native range. View text is valid in Spark SQL and in DuckDB; table names stand in
braces so that Spark can bind DataFrames to them.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from florapark.operators.ranking import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# declared, so that opening a table costs no job
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

VIEWS: dict[str, str] = {
    "fx_species": """
SELECT s_suppkey AS species_id, s_name AS species_name, s_nationkey AS home_area FROM {supplier}""",
    "fx_species_area": """
SELECT s.s_suppkey AS species_id, b.n_nationkey AS area_code
FROM {supplier} s JOIN {nation} a ON s.s_nationkey = a.n_nationkey JOIN {nation} b ON a.n_regionkey = b.n_regionkey""",
    "fx_location": """
SELECT o.o_orderkey AS location_id, c.c_nationkey AS area_code,
       8.0E0 + (o.o_orderkey % 120) * 5.0E-3 AS lon, 46.0E0 + (o.o_orderkey % 97) * 5.0E-3 AS lat,
       CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE o.o_totalprice / 1.0E3 END AS sampled_area_m2,
       o.o_orderpriority AS plot_quality
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "fx_occurrence": """
SELECT l_suppkey AS species_id, l_orderkey AS location_id,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 5.0E1 END AS uncertainty_m,
       CASE l_returnflag WHEN 'A' THEN 'HUMAN_OBSERVATION' WHEN 'N' THEN 'PRESERVED_SPECIMEN' ELSE 'FOSSIL_SPECIMEN' END AS basis_of_record
FROM {lineitem}""",
    "fx_presence": """
SELECT DISTINCT l_orderkey AS location_id, l_suppkey AS species_id FROM {lineitem}""",
    "fx_prediction": """
SELECT l_orderkey AS location_id, l_suppkey AS species_id,
       max(l_discount) * 1.0E1 AS probability, max(l_tax) * 1.25E1 AS probability_ref,
       least(1.0E0, max(l_extendedprice) / 1.1E5) AS probability_fine,
       CASE WHEN min(l_linenumber) = 7 THEN -1 ELSE max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) END AS label
FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "fx_scientific_name": """
SELECT p_partkey AS name_id,
       p_name || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN ' ' || p_brand
                      ELSE ' subsp. ' || lower(p_type) || ' ' || p_brand END AS scientific_name
FROM {part}""",
    "fx_checklist": """
SELECT min(p_partkey) AS plant_name_id,
       CASE WHEN min(p_partkey) % 7 = 0 THEN p_name || 'x' ELSE p_name END AS taxon_name,
       CASE WHEN min(p_partkey) % 5 = 0 THEN 'Synonym' ELSE 'Accepted' END AS taxon_status,
       min(p_brand) AS taxon_authors
FROM {part} GROUP BY p_name""",
    "fx_seed_metric": """
SELECT l_linenumber % 5 AS seed, l_suppkey AS species_id,
       CASE WHEN (l_suppkey + l_linenumber % 5) % 17 = 0 THEN NULL ELSE round(avg(l_discount), 6) END AS value
FROM {lineitem} GROUP BY l_linenumber % 5, l_suppkey""",
    "fx_training_time": """
SELECT user_id AS species_id, event_id % 3 AS part_no, event_id AS row_order,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS train_time_seconds
FROM {events}""",
    "fx_raster": """
SELECT CAST(floor(p_partkey / 5.0E1) AS BIGINT) AS pix_row, p_partkey % 50 AS pix_col,
       CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_retailprice END AS value
FROM {part}""",
    "fx_feature": """
SELECT vec_id AS location_id, label AS species_id, embedding AS predictors FROM {embeddings}""",
    # one row per polygon side; five rectangles, one L shape, a gap at lon 8.40-8.45, lat 46.20-46.30
    "fx_polygon_edge": """
SELECT * FROM (VALUES
 (0, 0, 8.0E0, 46.0E0, 8.2E0, 46.0E0), (0, 0, 8.2E0, 46.0E0, 8.2E0, 46.2E0), (0, 0, 8.2E0, 46.2E0, 8.0E0, 46.2E0), (0, 0, 8.0E0, 46.2E0, 8.0E0, 46.0E0),
 (1, 0, 8.2E0, 46.0E0, 8.4E0, 46.0E0), (1, 0, 8.4E0, 46.0E0, 8.4E0, 46.2E0), (1, 0, 8.4E0, 46.2E0, 8.2E0, 46.2E0), (1, 0, 8.2E0, 46.2E0, 8.2E0, 46.0E0),
 (2, 0, 8.4E0, 46.0E0, 8.61E0, 46.0E0), (2, 0, 8.61E0, 46.0E0, 8.61E0, 46.2E0), (2, 0, 8.61E0, 46.2E0, 8.4E0, 46.2E0), (2, 0, 8.4E0, 46.2E0, 8.4E0, 46.0E0),
 (3, 0, 8.0E0, 46.2E0, 8.3E0, 46.2E0), (3, 0, 8.3E0, 46.2E0, 8.3E0, 46.49E0), (3, 0, 8.3E0, 46.49E0, 8.0E0, 46.49E0), (3, 0, 8.0E0, 46.49E0, 8.0E0, 46.2E0),
 (4, 0, 8.3E0, 46.2E0, 8.4E0, 46.2E0), (4, 0, 8.4E0, 46.2E0, 8.4E0, 46.3E0), (4, 0, 8.4E0, 46.3E0, 8.61E0, 46.3E0),
 (4, 0, 8.61E0, 46.3E0, 8.61E0, 46.49E0), (4, 0, 8.61E0, 46.49E0, 8.3E0, 46.49E0), (4, 0, 8.3E0, 46.49E0, 8.3E0, 46.2E0),
 (5, 0, 8.45E0, 46.2E0, 8.61E0, 46.2E0), (5, 0, 8.61E0, 46.2E0, 8.61E0, 46.3E0), (5, 0, 8.61E0, 46.3E0, 8.45E0, 46.3E0), (5, 0, 8.45E0, 46.3E0, 8.45E0, 46.2E0)
) AS edges(area_code, ring_id, x1, y1, x2, y2)""",
    "fx_reference_point": """
SELECT * FROM (VALUES (1, 'capital', 8.1E0, 46.1E0, 1.0E4), (2, 'institution', 8.35E0, 46.25E0, 1.0E2),
                      (3, 'centroid', 8.5E0, 46.4E0, 1.0E3)) AS points(point_id, kind, lon, lat, radius_m)""",
    "fx_urban_edge": """
SELECT * FROM (VALUES
 (0, 0, 8.1E0, 46.3E0, 8.2E0, 46.3E0), (0, 0, 8.2E0, 46.3E0, 8.15E0, 46.4E0), (0, 0, 8.15E0, 46.4E0, 8.1E0, 46.3E0)
) AS edges(area_code, ring_id, x1, y1, x2, y2)""",
}

# views that group the rows of a large table, which hardly combines any: its rows are first spread by a key of the group
GROUPED = {"fx_presence": ("lineitem", "l_orderkey"), "fx_prediction": ("lineitem", "l_orderkey")}

_NAME = re.compile(r"\{(\w+)\}")


class Inputs:
    """Lazy access to the tables of one scale-factor folder and to the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}
        self._counted: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
                self._made[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                self._made[name] = self.sql(VIEWS[name], **self._spread(*GROUPED.get(name, ())))
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str, **instead: DataFrame) -> DataFrame:
        used = {n: getattr(self, n) for n in sorted(set(_NAME.findall(text)))} | instead
        return self.spark.sql(text, **used)

    def _spread(self, table: str | None = None, key: str = "") -> dict[str, DataFrame]:
        return {table: spread(getattr(self, table), self.n_rows(table), key)} if table else {}

    def n_rows(self, table: str) -> int:
        """Rows of a table, counted once."""
        if table not in self._counted:
            self._counted[table] = getattr(self, table).count()
        return self._counted[table]

    @cached_property
    def in_range_prediction(self) -> DataFrame:
        """Predictions with the range mask applied to the label."""
        from florapark.operators.cleaning import mask_labels

        return mask_labels(self.fx_prediction, self.fx_location, self.fx_species_area)


# the same masked prediction table for the check SQL
MASKED = """masked AS (
SELECT p.location_id, p.species_id, p.probability, p.probability_ref, p.probability_fine,
       CASE WHEN a.species_id IS NOT NULL AND p.label >= 0 THEN p.label END AS label
FROM fx_prediction p JOIN fx_location l ON p.location_id = l.location_id
LEFT JOIN fx_species_area a ON a.species_id = p.species_id AND a.area_code = l.area_code)"""


def with_views(names: list[str], body: str) -> str:
    """Check SQL text: the named views as CTEs in front of ``body``."""
    parts = []
    for name in names:
        if name == "masked":
            parts.append(MASKED)
        else:
            parts.append(f"{name} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[name]).strip()})")
    if not parts:
        return body
    head = "WITH " + ",\n".join(parts)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return head + ",\n" + text[5:]
    return head + "\n" + text

# a checklist with several rows per name, derived from the parts
VIEWS["fx_name"] = """
SELECT plant_name_id, taxon_name, taxon_authors,
       CASE WHEN plant_name_id % 11 = 0 THEN 'Subspecies' WHEN plant_name_id % 13 = 0 THEN 'Variety'
            WHEN plant_name_id % 17 = 0 THEN 'Genus' ELSE 'Species' END AS taxon_rank,
       CASE WHEN plant_name_id % 5 = 0 THEN 'Synonym' WHEN plant_name_id % 19 = 0 THEN 'Orthographic' ELSE 'Accepted' END AS taxon_status,
       plant_name_id % 2 = 0 AS homotypic,
       CASE WHEN plant_name_id % 5 = 0 OR plant_name_id % 19 = 0 THEN plant_name_id - 1 ELSE plant_name_id END AS accepted_plant_name_id,
       CASE WHEN plant_name_id % 3 = 0 THEN plant_name_id + 1 END AS parent_plant_name_id, genus, family,
       CASE plant_name_id % 7 WHEN 0 THEN 'shrub or tree' WHEN 1 THEN 'perennial' WHEN 2 THEN 'climbing subshrub'
            WHEN 3 THEN 'bamboo' WHEN 4 THEN 'liana' WHEN 5 THEN 'annual' END AS lifeform_description
FROM (SELECT min(p_partkey) AS plant_name_id, p_name AS taxon_name, p_brand AS taxon_authors,
             min(p_type) AS genus, p_brand AS family FROM {part} WHERE p_size > 3 GROUP BY p_name, p_brand
      UNION ALL
      SELECT min(p_partkey) + 1000000000, p_name || CASE min(p_partkey) % 4 WHEN 0 THEN ' subsp. ' WHEN 1 THEN ' subsp ' WHEN 2 THEN ' subsp: ' ELSE ' subsp.  ' END || lower(p_type),
             min(p_brand), min(p_type), min(p_brand) FROM {part} GROUP BY p_name, p_type) n"""
