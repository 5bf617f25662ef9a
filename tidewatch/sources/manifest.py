"""Session manifests: nested JSON with page snapshots and their elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "struct<dom_id:string,tag:string,role:string,aria_label:string,href:string,text:string,bbox:array<int>,style:map<string,string>,is_image:boolean,visibility_ratio:double,visibility_ms:bigint,z_index:int,is_intersecting_viewport:boolean>"
SNAPSHOT = f"struct<t_idx:int,pts_sec:double,url:string,scrollX:int,scrollY:int,frame_path:string,elements:array<{ELEMENT}>>"
MANIFEST = f"schema_version int, session_id string, initial_url string, video struct<path:string,duration_sec:double>, capture struct<width:int,height:int,fps:double,tr_duration_sec:double>, tr_mapping struct<type:string,tr_duration_sec:double>, walkthrough_script string, interaction_events array<struct<t_idx:int,pts_sec:double>>, dom_snapshots array<{SNAPSHOT}>, _corrupt string"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; malformed files go, missing fields are null."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL AND session_id IS NOT NULL").drop("_corrupt")


def snapshots(manifests: DataFrame) -> DataFrame:
    """session_id, position (from 0), and the snapshot's fields."""
    return manifests.select("session_id", F.posexplode("dom_snapshots").alias("position", "s")).select("session_id", "position", "s.*")


def elements(snaps: DataFrame) -> DataFrame:
    """session_id, t_idx, place, the element's fields, x, y, w and h; elements without a box have null ones."""
    rows = snaps.select("session_id", "t_idx", "scrollX", "scrollY", F.posexplode("elements").alias("place", "e"))
    box = [F.get("e.bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")]
    return rows.select("session_id", "t_idx", "place", "scrollX", "scrollY", "e.*", *box)


def visible_text(els: DataFrame) -> DataFrame:
    """session_id, t_idx, text: what can be seen, or is of a tag that always counts, in page order."""
    always = F.upper(F.coalesce("tag", F.lit(""))).isin("H1", "H2", "H3", "P", "BUTTON", "A")
    seen = els.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("is_intersecting_viewport", F.lit(False)) | always))
    ordered = F.array_sort(F.collect_list(F.struct("place", F.trim("text").alias("text"))))
    return seen.groupBy("session_id", "t_idx").agg(F.concat_ws(" ", F.transform(ordered, lambda s: s["text"])).alias("text"))


def selector(dom_id: object, tag: object, href: object) -> object:
    """A CSS selector: an id or class form as it is, links by target, plain ids with a hash; empty without any."""
    dom, link = F.trim(F.coalesce(dom_id, F.lit(""))), F.trim(F.coalesce(href, F.lit("")))
    escaped = F.replace(F.replace(link, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    bare = dom.isin("a", "button") | ((F.upper(F.coalesce(tag, F.lit(""))) == "A") & (dom == "a"))
    plain = dom.rlike(r"^[A-Za-z]") & (F.contains(dom, F.lit(".")) | dom.rlike(r"^[A-Za-z]+$"))
    return F.when(dom.rlike(r"^[#.\[]"), dom).when(bare & (link != ""), F.concat(F.lit('a[href="'), escaped, F.lit('"]'))).when(bare, "a").when((dom != "") & plain, dom).when(dom != "", F.concat(F.lit("#"), F.ltrim(dom, F.lit("#")))).otherwise("")
