"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

Canonical form: compatibility composition (NFKC) with full case folding, then every white-space run one blank and none at
the ends. The digest is 128 bits, two XXH64 of different seeds. Documents with equal digests form a bucket; inside a
bucket of several documents the canonical bytes themselves are compared, and should two texts ever share a digest, the
later ones carry an ordinal, so equal fingerprints mean equal canonical texts.

The Unicode steps are static methods of the ICU library that Spark ships and calls through its ``reflect`` function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut

#: Ranges of ids that neighbours are looked up in: QUANTILES of them, cut finer so that each has about ROWS rows.
QUANTILES, ROWS = 128, 2048
#: Tables of at most so many narrow rows (under 100 bytes each) are sent to every executor; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """(h1, h2): XXH64 of the bytes under two seeds."""
    return F.struct(F.xxhash64(canon).alias("h1"), F.xxhash64(F.lit("wide"), canon).alias("h2"))


def hexed(wide: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(wide["h1"]), 16, "0"), F.lpad(F.hex(wide["h2"]), 16, "0")))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with next_text and next_<c> of the next document in descending id order, cyclically.

    Ids are cut into ranges by their approximate quantiles (at most QUANTILES numbers reach the driver) and neighbours
    found inside a range; each range also gets the first row of the range after it, so one shuffle of the texts does.
    Rows with the same id follow each other in order of their texts; null ids come last.
    """
    marks = docs.agg(F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 10 * QUANTILES).alias("q"), F.count("*").alias("n")).first()
    bounds = sorted(set(marks["q"] or [0]))
    finer = -(-marks["n"] // (QUANTILES * ROWS)) or 1
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.size(F.filter(edges, lambda b: b <= F.col("doc_id")))
    low, high = F.element_at(edges, F.greatest(at, F.lit(1))), F.element_at(edges, F.least(at + 1, F.lit(len(bounds))))
    part = F.least(F.floor((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1)) * finer), F.lit(finer - 1))
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at * finer + F.greatest(part, F.lit(0))).cast("long")
    ranged = docs.withColumn("range", place)
    # a few bytes for each range; neighbours are found inside a quantile, and between the at most QUANTILES + 2 quantiles
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head")).withColumn("quantile", F.floor(F.col("range") / finer))
    tops = heads.groupBy("quantile").agg(F.max(F.struct("range", "head")).alias("top"))
    down = Window.orderBy(F.col("quantile").desc())
    after = F.coalesce(F.lead("top").over(down), F.first("top").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select(F.col("quantile").alias("q2"), after["head"].alias("beyond"))
    inner = F.lead(F.struct("head")).over(Window.partitionBy("quantile").orderBy(F.col("range").desc()))
    ends = heads.withColumn("inner", inner).join(F.broadcast(tops), F.col("quantile") == F.col("q2"))
    ends = ends.select(F.col("range").alias("range2"), F.when(F.col("inner").isNull(), F.col("beyond")).otherwise(F.col("inner.head")).alias("next_head"))
    ends = Cut(ends, "ends").df
    rows = ends.count()
    first = docs.join(_maybe_broadcast(ends, rows), docs["doc_id"].eqNullSafe(F.col("next_head")))  # one row a range, but for repeats
    columns = ["doc_id", "text", *carried]
    first = first.groupBy(F.col("range2").alias("range")).agg(F.min_by(F.struct(*columns), F.coalesce("text", F.lit(""))).alias("r")).select("range", "r.*").withColumn("guest", F.lit(True))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))
    both = ranged.select("range", *columns).withColumn("guest", F.lit(False)).unionByName(first.select("range", *columns, "guest"))
    return both.select(*columns, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *carried)]).where(~F.col("guest")).drop("guest")


def collisions(docs: DataFrame) -> DataFrame:
    """(clash_id, clash_text, ordinal): documents whose canonical bytes differ from the first ones in their bucket, by id and text hash. docs: doc_id, text, h1, h2.

    Buckets of one are settled by narrow rows alone; only texts of larger buckets are moved, grouped by their bytes.
    """
    several = Cut(docs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("b1"), F.col("h2").alias("b2")), "buckets").df
    some = several.count()
    members = docs.join(_maybe_broadcast(several, some), (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))).select("doc_id", "h1", "h2", _text_key().alias("clash_text"), canonical(F.col("text")).alias("canon"))
    texts = members.groupBy("h1", "h2", "canon").agg(F.min("doc_id").alias("least"))
    ranked = texts.withColumn("ordinal", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("least", "canon")) - 1).where("ordinal > 0")
    later = Cut(ranked.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("canon").alias("canon2"), "ordinal"), "clashes").df
    rows = later.count()
    hit = members.join(_maybe_broadcast(later, rows), (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")) & (F.col("canon") == F.col("canon2")))
    return hit.select(F.col("doc_id").alias("clash_id"), "clash_text", "ordinal").distinct()


def _text_key() -> Column:
    """What tells rows of one id apart: a hash of the text as it is."""
    return F.xxhash64(F.lit("row"), "text")


def _clashing(clash: DataFrame) -> tuple[DataFrame, Column]:
    """The side of a left join that adds ordinal, and its condition."""
    return _maybe_broadcast(clash, clash.count()), F.col("doc_id").eqNullSafe(F.col("clash_id")) & (F.col("text_key") == F.col("clash_text"))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, class_id (least id with the same canonical text): one row for each input row.

    Null and empty texts are the same text. A null id is a document like others, but names no class unless alone in it.
    """
    own = _prepared(docs).withColumn("wide", digest(canonical(F.col("text")))).select("doc_id", "text", "wide.*")
    clash = Cut(collisions(own), "clash").df
    named = own.select("doc_id", "h1", "h2", _text_key().alias("text_key")).join(*_clashing(clash), "left")
    printed = named.select("doc_id", F.concat(hexed(F.struct("h1", "h2")), F.coalesce(F.concat(F.lit("-"), F.col("ordinal")), F.lit(""))).alias("fingerprint"))
    least = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).withColumnRenamed("fingerprint", "f2")
    return printed.join(least, F.col("fingerprint") == F.col("f2")).drop("f2")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1.0 if equal, else 0.0).
    The next document is the one with the next lower id; after the last comes the first; a lone document is its own next.
    """
    own = _prepared(docs).withColumn("wide", digest(canonical(F.col("text")))).select("doc_id", "text", "wide.*")
    clash = Cut(collisions(own), "clash").df
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    next_text = F.coalesce("next_text", F.lit(""))
    edited = with_next(own, ["h1", "h2"]).select(
        "doc_id", "h1", "h2", "next_h1", "next_h2", n.cast("long").alias("n_chars"), _text_key().alias("text_key"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring(next_text, F.lit(1), half)).alias("edited"),
    )
    found = edited.select("doc_id", "text_key", "n_chars", "h1", "h2", "next_h1", "next_h2", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(canonical(F.col("edited"))).alias("e"))
    found = found.join(*_clashing(clash), "left")
    likeness = lambda h1, h2: F.when((F.col("h1") == h1) & (F.col("h2") == h2), 1.0).otherwise(0.0)
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat(hexed(F.struct("h1", "h2")), F.coalesce(F.concat(F.lit("-"), F.col("ordinal")), F.lit(""))).alias("fingerprint"),
        hexed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("e.h1"), F.col("e.h2")).alias("near_edited"),
        likeness(F.col("next_h1"), F.col("next_h2")).alias("near_next"),
    )
