"""Document fingerprints as Merkle trees.

Leaves are pieces of sentences, their parents paragraphs (lines), above them sections of paragraphs, then the root: equal
roots mean equal texts, and where roots differ the differing branches lead to the edit. Pieces and sections end where
their content says so, everywhere alike, so that an insertion changes the branches around it and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import let

#: A piece ends behind a mark, behind a word that ends with one of three letters, or else after 64 characters.
PIECE = r"(?s).{1,64}?(?:[.!?,;:]+\s*|(?<=[nrs])\s+|$)|.{1,64}"
#: A section ends with a paragraph whose hash begins with one of these digits: one in eight.
SECTION_ENDS = "[01]"


def _node(tag: str, parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(tag), parts).cast("binary"), 256)


def tree(text: Column) -> Column:
    """Struct of root, sections (node, first and last paragraph), paragraphs and leaves (hex SHA-256); null is the empty text."""

    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: _node("leaf:", p))
        return let(leaves, lambda h: F.struct(h.alias("leaves"), _node("paragraph:", F.concat_ws("", h)).alias("node")))

    def sections(nodes: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(nodes) - 1), lambda i: (i == F.size(nodes) - 1) | F.get(nodes, i).rlike(f"^{SECTION_ENDS}"))
        first = lambda e, i: F.coalesce(F.get(e, i - 1) + 1, F.lit(0))
        section = lambda start, last: F.struct(_node("section:", F.concat_ws("", F.slice(nodes, start + 1, last - start + 1))).alias("node"), start.alias("first"), last.alias("last"))
        return let(ends, lambda e: F.transform(e, lambda last, i: section(first(e, i), last)))

    def whole(p: Column) -> Column:
        nodes = F.transform(p, lambda x: x["node"])
        return let(nodes, lambda n: let(sections(n), lambda s: F.struct(_node("root:", F.concat_ws("", F.transform(s, lambda x: x["node"]))).alias("root"), s.alias("sections"), n.alias("paragraphs"), F.flatten(F.transform(p, lambda x: x["leaves"])).alias("leaves"))))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), paragraph), whole)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the sets of leaves."""
    shared = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    both = F.size(F.array_distinct(a["leaves"])) + F.size(F.array_distinct(b["leaves"]))
    return F.when(a["root"] == b["root"], F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * shared / both)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Numbers of b's paragraphs that a has nowhere, found by descending into sections that a has nowhere.

    With a and b changed about, those that were deleted or changed. Work grows with the edits times the sections.
    """
    nodes = lambda t: F.transform(t["sections"], lambda s: s["node"])

    def inside(new: Column) -> Column:
        sections = F.filter(b["sections"], lambda s: F.array_contains(new, s["node"]))
        return F.flatten(F.transform(sections, lambda s: F.sequence(s["first"], s["last"])))

    fresh = lambda new: F.filter(let(F.array_except(nodes(b), nodes(a)), inside), lambda i: F.array_contains(new, F.get(b["paragraphs"], i)))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(let(F.array_except(b["paragraphs"], a["paragraphs"]), fresh))


def _position(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above value, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])

    def search(t: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
            below = F.get(t, mid) <= value
            done = a["lo"] >= a["hi"]
            return F.struct(F.when(~done & below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(~done & ~below, mid).otherwise(a["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda a: a["lo"])

    return let(table, search)


def _number(docs: DataFrame) -> Column:
    """doc_id as a long that never falls where doc_id rises; of ids that are no integers the first seven bytes of their text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        number = F.col("doc_id").cast("long")
    else:
        head = F.substring(F.encode(F.col("doc_id").cast("string"), "UTF-8"), 1, 7)
        number = F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("long")
    return F.coalesce(number, F.lit(-(2**63)))


def _order(docs: DataFrame) -> Column:
    """What rows are ordered by, descending: integers as they are, all other ids by their text."""
    integer = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col("doc_id") if integer else F.col("doc_id").cast("string")


#: Rows that repeat a doc_id and its text and are one in this many rows, or more, are counted before they are ordered.
HOT_SHARE = 10_000


def with_next(docs: DataFrame, rows_per_bucket: int = 2000, max_cuts: int = 20_000) -> DataFrame:
    """doc_id, text and next_text: the text of the next row in descending order of doc_id, after the last the first.

    Rows of one doc_id go by the hash of their text, then by the text; a null id comes last; a single row follows itself; ids
    that are no integers go by their text. Rows are dealt to buckets of doc_id between quantiles, at most max_cuts of them, and
    evenly by value between two; a doc_id that fills whole buckets is dealt by text hash, too, and rows that repeat it and
    its text are counted. Buckets are sorted, and only their heads pass between them. Texts are shuffled once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"__id": _number(docs), "__key": _order(docs), "__th": F.xxhash64("text")})
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("low"), F.max("__id").alias("high")).first()
    n = total["n"]
    many = rows.groupBy("__key", "__th").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > max(rows_per_bucket, n // HOT_SHARE))
    hot = [(r["__key"], r["__th"]) for r in many.collect()]
    copies = None
    if hot:
        known = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(F.col("__key").alias("__k"), F.col("__th").alias("__t")).schema))
        on = F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__th") == F.col("__t"))
        once = rows.join(known, on, "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m"))
        chunk = 1000
        spread = once.where("m > 1").select("doc_id", "text", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 2) div {chunk}"))).alias("c")).repartition("c")
        copies = spread.select("doc_id", "text", F.col("text").alias("next_text"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk), F.col("m") - 1 - F.col("c") * chunk))).alias("i")).drop("i")
        rows = rows.join(known, on, "left_anti").unionByName(once.drop("m"))
    wanted = min(max_cuts, n // rows_per_bucket)
    cuts = sorted(int(c) for c in rows.approxQuantile("__id", [i / wanted for i in range(1, wanted)], 0.2 / wanted)) if wanted > 1 else []
    crowded = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    bounds = sorted({*cuts, *(c + 1 for c in crowded if c < 2**63 - 1)})
    finer = -(-n // (rows_per_bucket * max(wanted, 1)))
    at = _position(F.col("__id"), bounds)
    sub = F.lit(0)
    if finer > 1:
        edge = lambda values, i: F.get(F.array(*[F.lit(float(v)) for v in values]), i)
        low, high = edge([total["low"], *bounds], at), edge([*bounds, total["high"] + 1], at)
        share = (F.col("__id").cast("double") - low) / F.greatest(high - low, F.lit(1.0))
        sub = -F.least(F.floor(F.greatest(share, F.lit(0.0)) * finer), F.lit(finer - 1)).cast("int")
    if crowded:
        sub = F.when(F.col("__id").isin(crowded), F.shiftright("__th", 56).cast("int")).otherwise(sub)
    rows = rows.withColumns({"__b": -at, "__s": sub})
    # Heads: of each bucket the first row, by id and hash alone; its text is fetched for the bucket before.
    first = F.max_by(F.struct("__key", "__th"), F.struct(F.col("__key").isNotNull().alias("k"), F.col("__key").alias("id"), (-1 - F.col("__th")).alias("x")))
    heads = rows.groupBy("__b", "__s").agg(first.alias("h"))
    heads = heads.withColumn("ps", F.lag("__s").over(W.partitionBy("__b").orderBy("__s")))
    outer = heads.groupBy("__b").agg(F.max("__s").alias("last")).withColumn("k", F.row_number().over(W.orderBy("__b")))
    count = outer.agg(F.count(F.lit(1)).alias("count"))
    before = outer.select(F.col("__b").alias("pb"), F.col("last").alias("pl"), "k")
    ring = outer.join(F.broadcast(count)).select("__b", F.when(F.col("k") == 1, F.col("count")).otherwise(F.col("k") - 1).alias("k")).join(before, "k").drop("k")
    follows = heads.join(F.broadcast(ring), "__b").select(F.col("h.__key").alias("hid"), F.col("h.__th").alias("hth"), F.when(F.col("ps").isNull(), F.col("pb")).otherwise(F.col("__b")).alias("pb"), F.coalesce("ps", "pl").alias("ps"))
    first = rows.select("__key", "__th", "text").join(follows, F.col("__key").eqNullSafe(F.col("hid")) & (F.col("__th") == F.col("hth"))).groupBy("pb", "ps").agg(F.min("text").alias("__first"))
    inside = W.partitionBy("__b", "__s").orderBy(F.desc("__key"), "__th", "text")
    seen = rows.withColumn("__lead", F.lead("text").over(inside))
    seen = seen.join(first, (F.col("__b") == F.col("pb")) & (F.col("__s") == F.col("ps")), "left")
    out = seen.select("doc_id", "text", F.coalesce("__lead", "__first").alias("next_text"))
    return out if copies is None else out.unionByName(copies)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: the tree's root, that of an edited text, and the likenesses to it and to the next document.

    The edited text has its last floor(n/3) code points replaced by the first as many, or all, of the next document.
    Null and empty texts share one fingerprint; an empty table gives no rows; a very long text is hashed in one row, its time
    linear in its length. Only doc_id and text are read. Jobs for bucket bounds run when this is called.
    """
    text, third = F.col("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(F.col("next_text"), F.lit(1), third))
    rows = with_next(docs).withColumn("edited", edited).select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), let(tree(text), lambda a: let(tree(F.col("edited")), lambda b: let(tree(F.col("next_text")), lambda c: F.struct(
        a["root"].alias("fingerprint"), b["root"].alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), F.size(a["leaves"]).alias("n_leaves"), F.size(F.array_except(b["paragraphs"], a["paragraphs"])).alias("n_edited_paragraphs"))))).alias("x"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "x.*")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
