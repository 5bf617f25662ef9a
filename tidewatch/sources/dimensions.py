"""Dimension tables: vertices, bands, rules."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import dense_ids


def read_vertex_table(spark: SparkSession, path: str) -> DataFrame:
    """vertex_index, parcel_id, parcel_label, yeo_network_id, yeo_network_name, hemisphere.

    Rows without a parcel id get one for each label, in label order, past the largest given. Vertices must be 0..n-1.
    """
    raw = spark.read.option("header", True).csv(path)
    col = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    given = F.nullif(col("parcel_id"), F.lit("")).try_cast("long")
    label = F.coalesce(F.nullif(col("parcel_label"), F.lit("")), F.nullif(col("region_name"), F.lit("")))
    rows = raw.select(
        col("vertex_index").cast("long").alias("vertex_index"),
        given.alias("given"),
        F.coalesce(label, F.when(given.isNotNull(), F.concat(F.lit("p_"), given.cast("string"))), F.lit("unknown")).alias("parcel_label"),
        F.coalesce(F.nullif(col("yeo_network_id"), F.lit("")).try_cast("int"), F.lit(0)).alias("yeo_network_id"),
        F.coalesce(col("yeo_network_name"), F.lit("")).alias("yeo_network_name"),
        F.coalesce(F.nullif(col("hemisphere"), F.lit("")), F.lit("unknown")).alias("hemisphere"),
    )
    most = rows.agg(F.coalesce(F.max("given"), F.lit(0)).alias("m"), F.min("vertex_index").alias("low"), F.max("vertex_index").alias("high"), F.count(F.lit(1)).alias("n"), F.countDistinct("vertex_index").alias("d")).first()
    if most["n"] and (most["low"] != 0 or most["high"] != most["n"] - 1 or most["d"] != most["n"]):
        raise ValueError(f"{path}: vertex_index must be 0..{most['n'] - 1}, each once")
    named = dense_ids(rows.where("given IS NULL"), "parcel_label", "parcel_id", start=most["m"] + 1)
    out = rows.where("given IS NOT NULL").withColumn("parcel_id", F.col("given")).unionByName(named)
    return out.select("vertex_index", "parcel_id", "parcel_label", "yeo_network_id", "yeo_network_name", "hemisphere")


def demo_vertices(spark: SparkSession, n_vertices: int, n_parcels: int) -> DataFrame:
    """A made-up table: contiguous blocks of vertices, seven networks in turn, the first half of vertices left."""
    v = F.col("id")
    parcel = F.floor(v * n_parcels / n_vertices) + 1
    network = ((parcel - 1) % 7 + 1).cast("int")
    return spark.range(n_vertices).select(v.alias("vertex_index"), parcel.alias("parcel_id"), F.concat(F.lit("parcel_"), parcel.cast("string")).alias("parcel_label"), network.alias("yeo_network_id"), F.concat(F.lit("net_"), network.cast("string")).alias("yeo_network_name"), F.when(v < n_vertices / 2, "lh").otherwise("rh").alias("hemisphere"))


def validate_vertices(table: DataFrame) -> DataFrame:
    """One row: vertices, parcels, parcels with several labels or networks, sizes."""
    p = table.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("parcel_label").alias("labels"), F.countDistinct("yeo_network_id").alias("networks"))
    return p.agg(F.sum("n").alias("vertices"), F.count(F.lit(1)).alias("parcels"), F.sum(((F.col("labels") > 1) | (F.col("networks") > 1)).cast("int")).alias("violations"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """norm_start, norm_end, label, interpretation, sort_order (the row's place in the file where missing)."""
    # A table of a few rows: in one partition its rows are numbered as they stand in the file.
    raw = spark.read.option("header", True).csv(path).coalesce(1).withColumn("__i", F.monotonically_increasing_id())
    order = F.col("sort_order").try_cast("long") if "sort_order" in raw.columns else F.lit(None).cast("long")
    return raw.select(F.col("norm_start").cast("double").alias("norm_start"), F.col("norm_end").cast("double").alias("norm_end"), "label", "interpretation", F.coalesce(order, F.col("__i")).alias("sort_order"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Threshold rules of a small YAML file: id, network, z_above, min_duration_s, insight_key."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    rules = yaml.safe_load(text) or []
    rules = rules.get("rules", []) if isinstance(rules, dict) else rules
    rows = [(str(r["id"]), str(r["when"]["network"]), float(r["when"]["z_above"]), float(r["when"].get("min_duration_s", 0)), str(r.get("insight_key", r["id"]))) for r in rules]
    return spark.createDataFrame(rows, "id string, network string, z_above double, min_duration_s double, insight_key string")


def site_sections(spark: SparkSession, text: str) -> DataFrame:
    """rule_host, section, section_place, selector of a YAML text of sections by host; empty for an empty text."""
    import yaml

    sites = (yaml.safe_load(text) or {}).get("sites") or {}
    rows = [(str(host), str(s.get("id", "")), i, str(x)) for host, own in sites.items() for i, s in enumerate((own or {}).get("sections") or []) for x in s.get("selectors") or []]
    return spark.createDataFrame(rows, "rule_host string, section string, section_place int, selector string")


def read_site_sections(spark: SparkSession, path: str) -> DataFrame:
    """The same of a small file; a file that is not there has no rules."""
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path).coalesce(1).collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = ""
    return site_sections(spark, text)


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """path and a map of the keys that stand between the first two lines of three dashes; list items are joined by line feeds."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---", 1)
    keys = F.regexp_extract_all(head, F.lit(r"(?m)^([^\s:#-][^:\n]*):"), F.lit(1))
    values = F.regexp_extract_all(head, F.lit(r"(?m)^[^\s:#-][^:\n]*:([^\n]*(?:\n  - [^\n]*)*)"), F.lit(1))
    plain = F.transform(values, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"^\s*\n", ""), r"(?m)^  - ", "")))
    return files.select("path", F.map_from_arrays(F.transform(keys, F.trim), plain).alias("fields"))
