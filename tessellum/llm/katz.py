"""LM scoring by Katz backoff over word bigrams.

P(w | h) = d(r) r / (c(h) + 1) for a pair seen r times after a context of c(h) tokens, else alpha(h) P(w). d are Good-Turing
discounts for r <= K from the corpus's counts of counts; alpha(h) is what the seen pairs leave, over what P leaves them, so
every context sums to one exactly (the one added to c(h) keeps something to leave where all counts are large). P(w) =
(c(w) + 1) / (N + V + 1), where all unknown words together are one more word. A context never seen has alpha 1.

Tables are partitioned by hash, and texts do not travel: tokens are numbered inside chunks of about CHUNK tokens and only
compressed arrays move, in three steps that need a task to hold one chunk or one partition at a time:

1. chunks: each document's tokens as numbers of the chunk's own sorted word list (written once);
2. words: each list's parts go to the partition of their hash, which sums training counts, numbers the words (frequent
   first) and answers every chunk;
3. pairs: a chunk's distinct (context, word) with their documents go to the partition of the context, or, for contexts
   of over HOT training tokens, of the pair, so that no context however common meets in one task. A partition sums counts,
   scores seen pairs, and leaves for each context what alpha needs and for each unseen pair what waits for alpha.

Partitions grow in number with the tokens; only six counts of counts and two totals reach the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, crc_rest

CHUNK, PART, HOT, K = 800_000, 1_500_000, 50_000, 5
#: Bits for the place of a document in its chunk: every document holds a token, so a chunk has at most CHUNK.
ROW_BITS = 20
FOLD, HELD_OUT = 7, 2
END, START = xxhash.xxh64_intdigest(b"\n"), 0  # no word is a line end


_CHUNK_WORDS = ("hashes", "counts", "at")
_CHUNK_BODY = ("ids", "null", "train", "lengths", "flat", "end")
_ANSWER = ("at", "names", "totals")
_PAIRS = ("contexts", "context_counts", "context_pairs", "words", "word_counts", "w", "docs", "doc", "times", "rows", "train", "some", "ids", "null", "base", "known", "lengths")


def _pack(fields: tuple[str, ...], /, **arrays: np.ndarray) -> bytes:
    """The named arrays in order, integers as narrow as they may be and byte by byte, so that high bytes compress away."""
    parts = []
    for name in fields:
        x = np.asarray(arrays[name])
        if x.dtype.kind in "iu" and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(int(x.max())))
        parts.append(_HEAD.pack(x.dtype.kind.encode(), x.itemsize, len(x)) + np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 3)


_HEAD = struct.Struct("<cBI")


def _unpack(names: tuple[str, ...], data: bytes) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, {}
    for name in names:
        kind, width, n = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(f"{kind.decode()}{width}").ravel()
        at += n * width
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=0)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, n, body, words): body packs documents and token numbers, words the hashes of the list with training counts."""
    place, serial = TaskContext.get().partitionId(), 0
    names: dict[bytes, int] = {}
    docs: list[tuple[int | None, bool, np.ndarray]] = []
    held = 0
    digest = xxhash.xxh64_intdigest

    def out() -> pa.RecordBatch:
        nonlocal serial, held
        hashes = np.fromiter((END, *(digest(w) for w in names)), np.uint64, len(names) + 1)
        listed, number = np.unique(hashes, return_inverse=True)
        lengths = np.array([len(t) for _, _, t in docs])
        flat = number[np.concatenate([t for _, _, t in docs])]
        train = np.array([x for _, x, _ in docs])
        order = np.argsort(-np.bincount(flat, minlength=len(listed)), kind="stable")  # frequent words get short numbers
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        flat, listed = place_of[flat], listed[order]
        counts = np.bincount(flat[np.repeat(train, lengths)], minlength=len(listed))
        ids = np.array([0 if i is None else i for i, _, _ in docs], np.int64)
        body = _pack(_CHUNK_BODY, ids=ids, null=np.array([i is None for i, _, _ in docs]), train=train, lengths=lengths, flat=flat, end=place_of[number[:1]])
        words = _pack(_CHUNK_WORDS, hashes=listed, counts=counts, at=np.zeros(0, np.int64))
        row = pa.RecordBatch.from_arrays([pa.array([(place << 24) + serial], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([body], pa.binary()), pa.array([words], pa.binary())], names=["chunk", "n", "body", "words"])
        serial += 1
        names.clear()
        docs.clear()
        held = 0
        return row

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            key = doc_id.as_py()
            known = names.setdefault
            own = np.array([*(known(w, len(names) + 1) for w in tokens(text.as_py())), 0], np.int32)
            docs.append((key, zlib.crc32(b"" if key is None else str(key).encode()) % FOLD != HELD_OUT, own))
            held += len(own)
            if held >= CHUNK:
                yield out()
    if docs:
        yield out()


def _routed(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, words in zip(batch["chunk"], batch["words"]):
                x = _unpack(_CHUNK_WORDS, words)
                to = (x["hashes"] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(parts + 1))
                rows = [(p, chunk, _pack(_CHUNK_WORDS, hashes=x["hashes"][order[a:b]], counts=x["counts"][order[a:b]], at=_steps(order[a:b]))) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["part", "chunk", "words"])

    return run


def _counted(parts: int):
    """One partition of the word table: totals, numbers (1.. by falling count, in steps of ``parts``), answers for each chunk."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = [_unpack(_CHUNK_WORDS, w) for w in rows["words"]]
        listed, number = np.unique(np.concatenate([x["hashes"] for x in own]), return_inverse=True)
        total = np.bincount(number, np.concatenate([x["counts"] for x in own]), len(listed)).astype(np.int64)
        place = np.empty(len(listed), np.int64)
        place[np.argsort(-total, kind="stable")] = np.arange(len(listed))
        part = int(rows["part"].iloc[0])
        names, at, out = (place + 1) * parts + part, 0, []
        for chunk, x in zip(rows["chunk"], own):
            mine = number[at : at + len(x["hashes"])]
            at += len(mine)
            out.append((part, chunk, _pack(_ANSWER, at=x["at"], names=names[mine], totals=total[mine]), 0, 0))
        out[0] = (*out[0][:3], int(total.sum()), int((total > 0).sum()))
        return pd.DataFrame(out, columns=["part", "chunk", "answer", "tokens", "known"])

    return run


def _pairs(parts: int, n: int, v: int):
    """A chunk and its answers -> (part, pairs): what each partition of the pair table gets."""

    def run(body: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = int(body["chunk"].iloc[0])
        x, got = _unpack(_CHUNK_BODY, body["body"].iloc[0]), [_unpack(_ANSWER, a) for a in answers["answer"]]
        n_words = sum(len(a["at"]) for a in got)
        name, count = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        for a in got:
            at = np.cumsum(a["at"].astype(np.int64))
            name[at], count[at] = a["names"], a["totals"]
        del got
        flat, lengths = x["flat"].astype(np.int64), x["lengths"].astype(np.int64)
        end = int(x["end"][0])
        w, cw = name[flat], count[flat]
        h, ch = np.r_[0, w[:-1]], np.r_[0, cw[:-1]]
        first = np.cumsum(lengths) - lengths
        h[first], ch[first] = START, count[end]  # every text starts once, as it ends once
        doc = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(doc, np.log10((cw + 1) / (n + v + 1)), len(lengths))
        known = np.bincount(doc, cw > 0, len(lengths)).astype(np.int64)
        route = np.where(ch > HOT, h * 1_000_003 + w * 7_919, h) % parts
        order = np.lexsort((doc, w, h, route))
        route, h, ch, w, cw, doc = (a[order] for a in (route, h, ch, w, cw, doc))
        new = np.r_[True, (route[1:] != route[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
        each = np.flatnonzero(np.r_[True, new[1:] | (doc[1:] != doc[:-1])])
        times = np.diff(np.r_[each, len(doc)])
        pair = np.flatnonzero(new)
        docs_of_pair = np.diff(np.r_[np.searchsorted(each, pair), len(each)])
        cuts, cuts_each = np.searchsorted(route[pair], np.arange(parts + 1)), np.searchsorted(route[each], np.arange(parts + 1))
        row = (chunk << ROW_BITS) + np.arange(len(lengths))  # what tells documents apart, whatever their ids
        mine = np.arange(len(lengths)) % parts  # each document's own figures go with one partition
        rows = []
        for p in range(parts):
            a, b, c, d = cuts[p], cuts[p + 1], cuts_each[p], cuts_each[p + 1]
            own, some = pair[a:b], np.flatnonzero(mine == p)
            here = np.unique(np.r_[doc[each[c:d]], some])  # only the documents that this row speaks of
            if not len(here):
                continue
            contexts, first_of, per_context = np.unique(h[own], return_index=True, return_counts=True)
            listed, word_at, number = np.unique(w[own], return_index=True, return_inverse=True)
            rows.append((p, _pack(
                _PAIRS, contexts=_steps(contexts), context_counts=ch[own][first_of], context_pairs=per_context, words=_steps(listed), word_counts=cw[own][word_at], w=number, docs=docs_of_pair[a:b],
                doc=np.searchsorted(here, doc[each[c:d]]), times=times[c:d], rows=_steps(row[here]), train=x["train"][here],
                some=np.searchsorted(here, some), ids=x["ids"].astype(np.int64)[some], null=x["null"][some], base=base[some], known=known[some], lengths=lengths[some],
            )))
        return pd.DataFrame(rows, columns=["part", "pairs"])

    return run


_FIGURES = "kind int, key long, doc long, id long, n double, s double, k1 double, k2 double, k3 double, k4 double, k5 double, tokens long, known long, base double"


def _scored(n: int, v: int):
    """One partition of the pair table. kind 0: a document's own and seen part; 1: a context; 2: unseen pairs; 3: counts of counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = [_unpack(_PAIRS, x) for x in rows["pairs"]]
        h, ch = (np.concatenate([np.repeat(f(x), x["context_pairs"].astype(np.int64)) for x in own]) for f in (lambda x: np.cumsum(x["contexts"].astype(np.int64)), lambda x: x["context_counts"].astype(np.int64)))
        w, cw = (np.concatenate([f(x)[x["w"].astype(np.int64)] for x in own]) for f in (lambda x: np.cumsum(x["words"].astype(np.int64)), lambda x: x["word_counts"].astype(np.int64)))
        shift = np.cumsum([0, *(len(x["rows"]) for x in own)])
        of_pair = np.repeat(np.arange(len(h)), np.concatenate([x["docs"] for x in own]).astype(np.int64))
        doc = np.concatenate([x["doc"].astype(np.int64) + s for x, s in zip(own, shift)])
        times = np.concatenate([x["times"] for x in own]).astype(np.int64)
        train = np.concatenate([x["train"] for x in own])
        ids = np.concatenate([np.cumsum(x["rows"].astype(np.int64)) for x in own])
        some = np.concatenate([x["some"].astype(np.int64) + s for x, s in zip(own, shift)])
        told, null = (np.concatenate([x[c] for x in own]) for c in ("ids", "null"))
        figures = {c: np.concatenate([x[source] for x in own]) for c, source in (("tokens", "lengths"), ("known", "known"), ("base", "base"))}
        del own  # its arrays are all copied
        order = np.lexsort((w, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])] if len(h) else np.zeros(0, bool)
        pair = np.empty(len(h), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]
        of_pair = pair[of_pair]
        r = np.bincount(of_pair, times * train[doc], len(first)).astype(np.int64)
        h, ch, cw = h[first], ch[first], cw[first]
        p1 = (cw + 1) / (n + v + 1)
        frames = []

        def add(kind: int, **columns) -> None:
            size = len(next(iter(columns.values())))
            frames.append(pd.DataFrame({"kind": np.full(size, kind, np.int32)} | columns))

        # seen pairs, by document
        seen = r[of_pair] > 0
        value = np.zeros(len(first))
        value[r > 0] = np.log10(r[r > 0] / (ch[r > 0] + 1))
        classes = {f"k{k}": np.bincount(doc[seen & (r[of_pair] == k)], times[seen & (r[of_pair] == k)], len(ids)) for k in range(1, K + 1)}
        total = np.bincount(doc[seen], (times * value[of_pair])[seen], len(ids))
        name = np.full(len(ids), np.nan, object)
        name[some] = np.where(null, None, told.astype(np.int64).astype(object))
        extra = {}
        for c, values in figures.items():
            extra[c] = np.zeros(len(ids), np.float64 if c == "base" else np.int64)
            extra[c][some] = values
        some_of = (np.bincount(doc, minlength=len(ids)) > 0) | (extra["tokens"] > 0)
        keep = np.flatnonzero(some_of)
        add(0, doc=ids[keep], id=pd.array([None if x is None or x is np.nan or x != x else x for x in name[keep]], dtype="Int64"), s=total[keep], **{k: x[keep] for k, x in classes.items()}, **{k: x[keep] for k, x in extra.items()})
        # contexts
        trained = np.flatnonzero(r > 0)
        if len(trained):
            context, at = np.unique(h[trained], return_inverse=True)
            held = {f"k{k}": np.bincount(at, r[trained] == k, len(context)) for k in range(1, K + 1)}
            large = np.bincount(at, np.where(r[trained] > K, r[trained], 0), len(context))
            counts = np.zeros(len(context))
            counts[at] = ch[trained]
            add(1, key=context, n=counts, s=np.bincount(at, p1[trained], len(context)), base=large, **held)
            of = np.bincount(np.minimum(r[trained], K + 2), minlength=K + 3)
            add(3, key=np.arange(1, K + 2), n=of[1 : K + 2].astype(float))
        # unseen pairs: (context, document)
        miss = np.flatnonzero(~seen)
        if len(miss):
            where = np.stack([h[of_pair[miss]], doc[miss]])
            both, at = np.unique(where, axis=1, return_inverse=True)
            at = at.ravel()
            add(2, key=both[0], doc=ids[both[1]], n=np.bincount(at, times[miss], both.shape[1]), s=np.bincount(at, times[miss] * np.log10(p1[of_pair[miss]]), both.shape[1]))
        out = pd.concat(frames)
        names = [c.split()[0] for c in _FIGURES.split(", ")]
        return out.reindex(columns=names).astype({"key": "Int64", "doc": "Int64", "id": "Int64", "tokens": "Int64", "known": "Int64"})

    return run


def discounts(counts: dict[int, int]) -> list[float]:
    """d(1) .. d(K): Good-Turing with Katz's cutoff; where a count is missing or the estimate leaves (0, 1), (r - 0.5) / r."""
    common = (K + 1) * counts.get(K + 1, 0) / counts[1] if counts.get(1) else 0.0
    out = []
    for r in range(1, K + 1):
        here, above = counts.get(r, 0), counts.get(r + 1, 0)
        d = ((r + 1) * above / (r * here) - common) / (1 - common) if here and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row, over whole texts.

    Learns from the documents that are not held out. A null text is empty: its end is its only token. Rows that repeat an
    id, and rows with a null id (held out as the empty string is), are documents of their own. An empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = Cut(own.mapInArrow(_chunks, "chunk long, n long, body binary, words binary"), "lm-chunks")
    parts = max(12, -(-(chunks.df.agg(F.sum("n")).first()[0] or 0) // PART))
    routed = chunks.df.select("chunk", "words").mapInPandas(_routed(parts), "part int, chunk long, words binary")
    answers = Cut(routed.repartition(parts, "part").groupBy("part").applyInPandas(_counted(parts), "part int, chunk long, answer binary, tokens long, known long"), "lm-words")
    totals = answers.df.agg(F.sum("tokens"), F.sum("known")).first()
    n, v = totals[0] or 0, totals[1] or 0
    routed = chunks.df.select("chunk", "body").groupBy("chunk").cogroup(answers.df.select("part", "chunk", "answer").groupBy("chunk")).applyInPandas(_pairs(parts, n, v), "part int, pairs binary")
    figures = Cut(routed.repartition(parts, "part").groupBy("part").applyInPandas(_scored(n, v), _FIGURES), "lm-pairs").df
    chunks.drop()
    answers.drop()
    found = {r["key"]: int(r["n"]) for r in figures.where("kind = 3").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # K + 1 rows
    d = discounts(found)
    context = figures.where("kind = 1").groupBy("key").agg(F.max("n").alias("c"), F.sum("s").alias("p"), F.sum("base").alias("large"), *[F.sum(f"k{k}").alias(f"k{k}") for k in range(1, K + 1)])
    seen = F.col("large")
    for k in range(1, K + 1):
        seen = seen + F.lit(d[k - 1] * k) * F.col(f"k{k}")
    alpha = context.select(F.col("key").alias("key2"), F.log10((1 - seen / (F.col("c") + 1)) / (1 - F.col("p"))).alias("alpha"))
    waits = figures.where("kind = 2").join(alpha, F.col("key") == F.col("key2"), "left")
    unseen = waits.select("doc", (F.col("s") + F.col("n") * F.coalesce("alpha", F.lit(0.0))).alias("s"))
    first = F.col("s")
    for k in range(1, K + 1):
        first = first + F.lit(float(np.log10(d[k - 1]))) * F.col(f"k{k}")
    nothing = [F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base")]
    both = figures.where("kind = 0").select("doc", first.alias("s"), "id", "tokens", "known", "base").unionByName(unseen.select("*", *nothing))
    summed = both.groupBy("doc").agg(F.max("id").alias("doc_id"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("s").alias("score"))
    return summed.select("doc_id", (crc_rest(F.col("doc_id"), FOLD) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
