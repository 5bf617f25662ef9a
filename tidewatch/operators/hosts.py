"""Rules by host, and rule columns by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_hosts(df: DataFrame, host: str, rules: DataFrame, rule_host: str = "host") -> DataFrame:
    """df and rule_host: the longest of the rules' hosts that is the row's host or a parent of it; null where none is.

    Different hosts are exploded to their suffixes, as many as they have labels, which meet the rules in an equi-join: no rule is
    tried on a row. Hosts are compared in lower case, without port and final dot; addresses have no parents.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r":[0-9]*$", ""), r"\.$", "")
    hosts = df.select(F.col(host).alias("__host")).where("__host IS NOT NULL").distinct().withColumn("__own", plain(F.col("__host")))
    labels = F.split("__own", r"\.")
    address = F.col("__own").rlike(r"^[0-9.]+$|:")
    suffixes = F.when(address, F.array("__own")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keys = hosts.withColumn("__suffix", F.explode(suffixes))
    known = rules.select(plain(F.col(rule_host)).alias("__suffix"), F.col(rule_host).alias("__rule")).where("__suffix IS NOT NULL")
    known = known.groupBy("__suffix").agg(F.min("__rule").alias("__rule"))
    best = keys.join(known, "__suffix").groupBy("__host").agg(F.max_by("__rule", F.length("__suffix")).alias("rule_host"))
    return df.join(best, F.col(host) == F.col("__host"), "left").drop("__host")


def match_selectors(elements: DataFrame, keys: list[str], dom_id: str, rules: DataFrame, place: str) -> DataFrame:
    """keys, place of an element, section: the first section, in the rules' order, with a selector that the element answers to.

    rules: rule_host, section, section_place, selector. A selector with # is the element's id; another is part of it, or its end
    without dots. elements carry the rule_host of their page. Few rules have the same host; they are tried on its elements only.
    """
    sel, own = F.trim("selector"), F.coalesce(F.col(dom_id), F.lit(""))
    hit = (sel != "") & F.when(F.startswith(sel, F.lit("#")) & (own == sel), True).otherwise(F.contains(own, sel) | F.endswith(own, F.regexp_replace(sel, r"\.", "")))
    met = elements.join(rules.withColumnRenamed("rule_host", "__rh"), F.col("rule_host") == F.col("__rh")).where(hit)
    return met.groupBy(*keys, place).agg(F.min_by("section", F.col("section_place")).alias("section"))


def resolve_columns(wanted: DataFrame, columns: DataFrame, ids: DataFrame) -> DataFrame:
    """name, column, tier: the column that a rule's name means; null, and no tier, where there is none.

    Tier 1 is the name itself; tier 2 a column that begins with it and an underscore, or that with an underscore begins it; tier 3 the
    column called after the name's number. wanted: name. columns: place, column. ids: name, column. Of several in a tier the first by
    place counts. Names are cut at underscores, so that all tiers are equi-joins.
    """
    begins = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "_"))), lambda i: F.array_join(F.slice(F.split(c, "_"), i * 0 + 1, i), "_"))
    names = wanted.select("name").distinct().withColumn("__n", F.trim("name"))
    cols = columns.select("place", "column")
    exact = names.join(cols, F.col("__n") == F.col("column")).select("name", F.lit(1).alias("tier"), "place", "column")
    longer = cols.withColumn("__b", F.explode(begins(F.col("column"))))
    longer = names.join(longer, F.col("__n") == F.col("__b")).where("__b <> column").select("name", F.lit(2).alias("tier"), "place", "column")
    shorter = names.withColumn("__b", F.explode(begins(F.col("__n")))).join(cols, F.col("__b") == F.col("column")).where("__b <> __n").select("name", F.lit(2).alias("tier"), "place", "column")
    numbered = names.join(ids.withColumnsRenamed({"name": "__i", "column": "__c"}), F.col("__n") == F.col("__i")).join(cols, F.col("__c") == F.col("column"))
    found = exact.unionByName(longer).unionByName(shorter).unionByName(numbered.select("name", F.lit(3).alias("tier"), "place", "column"))
    best = found.groupBy("name").agg(F.min(F.struct("tier", "place", "column")).alias("__m"))
    return wanted.join(best, "name", "left").select(*wanted.columns, F.col("__m.column").alias("column"), F.col("__m.tier").alias("tier"))
