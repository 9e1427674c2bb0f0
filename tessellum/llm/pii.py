"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Entities are the texts of the base spans (email, ip, card, phone). A context is a document. From the whole corpus come N
(documents), c(e) and c(t) (documents with an entity, with a term) and c(t, e). An entity tells IC(e) = log2(N / c(e)); a term
seen with it tells PMI(t, e) = log2(c(t, e) N / (c(t) c(e))) of that. The share PMI / IC is smoothed by the evidence for it:
times c(t, e) / (c(t, e) + SMOOTH), so no pair is left out for being rare. A term whose share reaches ``GENERALISE`` is
generalised (its letters masked), from ``REMOVE`` on it is removed, wherever it stands in a document that holds the entity.
An entity that all documents hold tells nothing, and no term is judged by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: SMOOTH: a pair that always meets is generalised when it is met in one or two documents, and removed from three on.
GENERALISE, REMOVE, SMOOTH = 0.5, 0.9, 0.25
#: Candidate terms up to this many are sent to every executor; more are joined by shuffle instead.
BROADCAST_TERMS = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that do not overlap in their kind; failing ones are dropped.

    An address is found from its @: its local part is the run before it, back to the address before. So the time is
    linear, and the same matches come out as a search from every start would give.
    """
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def contexts(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) for every term outside the spans of a text that has any, in order."""
    covered, k = sorted((a, b) for _, a, b in spans), 0
    for m in _TERM.finditer(text) if spans else ():
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k == len(covered) or covered[k][0] >= m.end():
            yield m[0].lower(), m.start(), m.end()


def term_key(term: str) -> int:
    """64 bits that stand for a term in the tables: terms are counted and compared, never shown."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        ids, columns = [], ([], [], [], [], [], [], [])
        for doc_id, value in zip(batch.column(0), batch.column(1)):
            text = value.as_py() or ""
            spans = base_spans(text)
            counts = Counter(k for k, _, _ in spans)
            ids.append(doc_id.as_py())
            found = [{"term": term_key(t), "start": a, "end": b} for t, a, b in contexts(text, spans)]
            entities = sorted({f"{k}:{text[a:b].lower()}" for k, a, b in spans})
            row = (*(counts[k] for k in KINDS[:4]), ",".join(f"{k}:{a}:{b}" for k, a, b in spans), found, entities)
            for column, x in zip(columns, row):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), near, pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "near", "entities"])


def _scan_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _scan(iter([batch])):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=[*out.schema.names, "text_key"])


def _term_documents(known: frozenset[int] | None):
    """Documents that hold each term, counted over a batch; of all terms, or of the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for value in batch.column(0):
                counts.update({t.lower() for t in set(_TERM.findall(value.as_py() or ""))})
            keyed = {term_key(t): n for t, n in counts.items()}
            kept = keyed if known is None else {k: n for k, n in keyed.items() if k in known}
            yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.int64()), pa.array(kept.values(), pa.int64())], names=["term", "n"])

    return run


def detect(spark: SparkSession, docs: DataFrame, keep_text_key: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans (all spans as kind:start:end, comma-joined), one row an input row.

    A null text is empty; empty tables give no rows; repeated rows count as documents of their own. Offsets are code points.
    ``keep_text_key`` adds text_key, a hash of each row's text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<term:bigint,start:int,end:int>>, entities array<string>"
    if keep_text_key:
        keyed = texts.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
        found = keyed.mapInArrow(_scan_keyed, schema + ", text_key long")
    else:
        found = texts.mapInArrow(_scan, schema)
    found = Cut(found.withColumn("row", F.monotonically_increasing_id()), "pii").df
    total = found.count()
    near = found.select("row", F.explode("near").alias("c")).select("row", "c.*")
    holds = found.select("row", F.explode("entities").alias("entity"))
    # entities of the same documents have the same shares: they are one, so lists of addresses do not multiply the terms
    same = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"at{k}") for k in (1, 2)]
    entity = holds.groupBy("entity").agg(F.count("*").alias("n_entity"), *same)
    entity = holds.join(entity, "entity").select("row", F.xxhash64("n_entity", "at1", "at2").alias("entity"), "n_entity").distinct()
    entity = Cut(entity, "entity").df
    terms = found.select("row", F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term"))
    joint = Cut(entity.join(terms, "row").groupBy("entity", "n_entity", "term").agg(F.count("*").alias("both")), "joint").df
    wanted = joint.select("term").distinct()
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # checked: beyond it all terms are counted and joined
    known = frozenset(r["term"] for r in wanted.collect()) if few else None
    counted = texts.select("text").mapInArrow(_term_documents(known), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    pmi = F.log2(F.col("both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    share = pmi / F.nullif(F.log2(F.lit(float(total)) / F.col("n_entity")), F.lit(0.0)) * F.col("both") / (F.col("both") + SMOOTH)
    told = joint.join(counted, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)
    told = Cut(told, "told").df
    told = entity.join(told, "entity").groupBy("row", "term").agg(F.max("share").alias("share"))
    marks = near.join(told, ["row", "term"])
    kind = F.when(F.col("share") >= REMOVE, F.lit(1)).otherwise(F.lit(0))
    marks = marks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(kind.alias("kind"), "start", "end"))).alias("m"))  # of one text
    named = F.transform("m", lambda x: F.concat_ws(":", F.when(x["kind"] == 1, F.lit("remove")).otherwise(F.lit("generalise")), x["start"], x["end"]))
    marks = marks.select(F.col("row").alias("row2"), F.array_join(named, ",").alias("more"))
    out = found.drop("near", "entities").join(marks, F.col("row") == F.col("row2"), "left")
    extra = ["text_key"] if keep_text_key else []
    return out.select("doc_id", *extra, "n_email", "n_ip", "n_card", "n_phone", "base", F.concat_ws(",", F.nullif("base", F.lit("")), "more").alias("spans"))


def redact(text: str, spans: str) -> str:
    """The text with base spans as [KIND], generalised terms masked letter by letter and removed ones gone."""
    parsed = sorted(((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)))
    out, at = [], 0
    for start, end, kind in parsed:
        if start < at:
            continue
        out.append(text[at:start])
        out.append({"generalise": "*" * (-end - start), "remove": ""}.get(kind, f"[{kind.upper()}]"))
        at = -end
    return "".join(out) + text[at:]


def sanitise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents, all columns, with ``text`` sanitised; a null text stays null.

    Spans belong to a row by its id (null or not) and its text, so rows that repeat an id with another text, and rows without
    an id, get their own. Rows alike in both are alike. Columns may have any name.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    key = lambda doc_id, text: F.struct(F.coalesce(doc_id.cast("long"), F.lit(0)).alias("i"), doc_id.isNull().alias("n"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("t"))
    spans = detect(spark, docs, keep_text_key=True).where("spans <> ''").select(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("n"), F.col("text_key").alias("t")).alias("at"), "spans")
    spans = spans.groupBy("at").agg(F.max("spans").alias("spans"))  # rows alike have like spans

    @F.pandas_udf("string")
    def apply(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else redact(t, s) for t, s in zip(text, spans)], dtype=object)

    joined = own.withColumn("here", key(F.col("own.doc_id"), F.col("own.text"))).join(spans, F.col("here") == F.col("at"), "left")
    out = joined.select("own", apply(F.col("own.text").cast("string"), F.col("spans")).alias("text"))
    return out.select(*[F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])
