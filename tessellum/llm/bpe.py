"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token, and that token can be found without running any merges: an automaton
over the vocabulary reports, at each position, every token that ends there; such a token t follows the prefix before it if
and only if the pair (last token of that prefix, t) is compatible, that is, if merging their joined symbols in rank order
never crosses the border. So one pass stores the last token of every prefix, and the back-pointers give the exact ids.

Texts are prepared as the vocabulary file says (special tokens cut out of the raw text, NFC, lower case, split into
letter runs, single digits and symbol runs, bytes as symbols, end-of-word mark on the last symbol).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's memory, with their ids; all are forgotten when so many are held.
REMEMBERED = 400_000
ROWS_OUT, BYTES_OUT = 256, 4 << 20
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\x85\p{L}\p{N}]+")
_END = 0x10000  # a symbol that carries the end-of-word mark is its character moved by this
_NEVER = 1 << 30


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def checked(spec: dict) -> None:
    """ValueError unless the file prepares texts as this module does: NFC, lower case, this split, bytes as symbols, word-end marks."""
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
    pattern = split[0].get("pattern", {}).get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
    model = spec["model"]
    good = steps in (["NFC", "Replace", "Lowercase"], ["NFC", "Lowercase"]) and pattern == _SPLIT.pattern.replace("\\x85", "") and split[-1].get("type") == "ByteLevel" and not split[-1].get("add_prefix_space")
    if not good or model.get("type") != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        raise ValueError("the vocabulary file prepares texts in another way than this encoder")


class Encoder:
    """Exact ids of whole texts for one vocabulary file of the word-end kind (its JSON text)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        checked(spec)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        special = [x for x in spec["added_tokens"] if not x["normalized"]]
        self.special = {x["content"]: x["id"] for x in special}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if special else None
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = ids[left], ids[right]
            self.rank[pair] = rank
            self.born.setdefault(ids[left + right], (rank, *pair))
        self.symbol = [ord(c) for c in _byte_symbols()]
        self.found = ahocorasick.Automaton()
        for token, i in ids.items():
            body, end = (token[: -len(mark)], _END) if token.endswith(mark) and len(token) > len(mark) else (token, 0)
            text = body[:-1] + chr(ord(body[-1]) + end)
            self.found.add_word(text, (i, len(text)))
        self.found.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.wholes: dict[int, bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether these two, side by side, stay as they are.

        Walks back through the merges that made both, the latest first. While two pieces x|y stand at the border, a
        merge of them is done before either is used up if its rank is lower; at equal ranks the leftmost goes first.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        x, y, x_ends, y_ends = left, right, _NEVER, _NEVER
        while True:
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:
                good = False
                break
            x_born, y_born = self.born.get(x), self.born.get(y)
            if x_born is None and y_born is None:
                good = True
                break
            if y_born is None or (x_born is not None and x_born[0] > y_born[0]):
                x_ends, x = x_born[0], x_born[2]
            else:
                y_ends, y = y_born[0], y_born[1]
        if len(self.pairs) >= 4 * REMEMBERED:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def whole(self, token: int) -> bool:
        """Whether the merges build this token out of its own symbols: its halves do, and meet uncrossed."""
        if token not in self.wholes:
            born = self.born.get(token)
            if born is None:
                return True
            _, left, right = born
            rank = self.rank.pop((left, right))
            self.pairs.pop((left, right), None)
            self.wholes[token] = self.compatible(left, right)
            self.pairs.pop((left, right), None)
            self.rank[left, right] = rank
            self.wholes[token] = self.wholes[token] and self.whole(left) and self.whole(right)
        return self.wholes[token]

    def word(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian, four bytes each) and decoded form of one piece of the split."""
        symbol = self.symbol
        codes = [symbol[b] for b in text.encode("utf-8", "surrogatepass")]
        codes[-1] += _END
        n = len(codes)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.found.iter("".join(map(chr, codes))):
            at = end + 1
            if last[at] >= 0:
                continue
            before = at - length
            if (last[before] >= 0 and self.compatible(last[before], token)) if before else self.whole(token):
                last[at], back[at] = token, before
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        made = b"".join(i.to_bytes(4, "little") for i in ids), " ".join(self.tokens[i] for i in ids)
        if len(text) < 64:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[text] = made
        return made

    def pieces(self, text: str) -> Iterator[tuple[bytes, str]]:
        at = 0
        for hit in self.cut.finditer(text) if self.cut and "<" in text else ():
            yield from self.plain(text[at : hit.start()])
            yield self.special[hit[0]].to_bytes(4, "little"), hit[0]
            at = hit.end()
        yield from self.plain(text[at:] if at else text)

    def plain(self, text: str) -> Iterator[tuple[bytes, str]]:
        text = unicodedata.normalize("NFC", text)
        # lower case is taken character by character: a final sigma is no special case
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        known, word = self.words.get, self.word
        for piece in _SPLIT.findall(text):
            yield known(piece) or word(piece)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """All ids, and the text that they decode to; a null text counts as empty."""
        made = list(self.pieces(text or ""))
        return b"".join(m[0] for m in made), " ".join(m[1] for m in made)


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file, read on the driver (a few MB, whatever the corpus); default: the public word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded: one row for each input row, whole texts.

    Null and empty texts have no ids and decode to ''. Repeated rows are encoded again; ids and other columns are
    never read. Each task streams its rows: memory holds one input batch and the words remembered.
    """
    shipped = spark.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        names = ["doc_id", "ids", "decoded"]
        kinds = (pa.int64(), pa.binary(), pa.string())
        rows: list[list] = [[], [], []]
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids, decoded = encoder.encode(text.as_py())
                for column, value in zip(rows, (doc_id.as_py(), ids, decoded)):
                    column.append(value)
                held += len(ids) + len(decoded)
                if len(rows[0]) >= ROWS_OUT or held >= BYTES_OUT:
                    yield out()
                    rows, held = [[], [], []], 0
        if rows[0]:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``text``, what its ``ids`` (binary as ``encode`` gives them) stand for: tokens joined by blanks.

    Null and empty ids give ''. Ids that the vocabulary lacks are passed over, as the library does; a byte count that is no
    multiple of four raises ValueError.
    """
    shipped = spark.sparkContext.broadcast(vocabulary_text(path))
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        shown = encoder.tokens
        for batch in batches:
            texts = []
            for value in batch.column(at):
                ids = value.as_py() or b""
                if len(ids) % 4:
                    raise ValueError("ids are four bytes each")
                own = (shown.get(int.from_bytes(ids[k : k + 4], "little")) for k in range(0, len(ids), 4))
                texts.append(" ".join(t for t in own if t is not None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what ``encode`` returns."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
