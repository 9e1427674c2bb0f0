"""Fuzzy line dedup in DataFrame functions only: MinHash, banding, exact Jaccard, distributed union-find.

A line is compared lower-cased, its white space folded; its set is its character shingles of SHINGLE UTF-16 units (a shorter
line is one shingle). Lines without a word are layout and always stay. Equal lines are one node (64-bit hash of the folded
line). Nodes get HASHES = BANDS x ROWS minima; nodes that agree on a band are candidates: two lines at the threshold meet
with probability 1 - (1 - 0.8^3)^8 = 0.997.

Lines of more than LONG shingles take their minima over a fixed share of all possible shingles (one hash in SHARE, the
same for every line) and their own first one; the Jaccard similarity within a random share of the universe is an unbiased
estimate of the whole one. Lines whose number of shingles lies within the threshold of LONG are signed both ways, so no pair
falls between; so are long lines of few different shingles. What a candidate pair is accepted by is always the whole sets.

Inside a bucket every member is first verified against one hub (the most frequent line). Lines of buckets that then still
hold several components meet in it if it is small, or if a line of it is expected to agree with few others; how many agree is measured on neighbours in a random order. Large buckets in which few
pairs agree are split: a pair that agrees in AGREE minima, three of them its band's, agrees in two of three of some other
band, so its lines meet in one of the bucket's parts by two more minima. In large buckets or parts of many that agree, lines
are joined by prefixes of their shingles, which finds what is left without its pairs. The choice changes the work only. Before
texts are compared, a pair's minima are: pairs at the threshold agree in 19 of 24, and in fewer than AGREE once in some
thousands. Edges of the second step are contracted: its union-find sees links between components only. Its lines are in many
pairs each, so before their sets are, parities of their shingles are compared, which can only show that two sets differ too much.
"""

from __future__ import annotations

import random

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE, BANDS, ROWS, THRESHOLD = 8, 8, 3, 0.8
HASHES = BANDS * ROWS
LONG, SHARE, THIN = 128, 4, 8
#: Least number of equal minima of a pair that is verified; lines that an open bucket may have to be paired in it.
AGREE, FEW = 12, 64
#: Buckets in which this share of pairs agrees are dense: splitting them would leave their lines together.
DENSE = 0.125
#: Numbers of 64 parities each that a set is told apart by.
WORDS = 16
#: Tables of at most so many rows of one number are sent to every executor; larger ones are shuffled.
BROADCAST_ROWS = 200_000
_random = random.Random(1)
#: Minima are taken under xor with constants spread over the range: nearest hashes to HASHES fixed points.
_POINTS = [((j << 32) // HASHES + _random.randrange((1 << 32) // HASHES)) - (1 << 31) for j in range(HASHES)]
_MINIMA = [f"s{j}" for j in range(HASHES)]
#: Their last 16 bits, four to a number: what pairs are compared by.
_PACKED = [f"p{j}" for j in range(HASHES // 4)]
_BLANKS = ("  ", "\t", "\x0b", "\x0c", "\r")


class Cut(common.Cut):
    """Hashes, minima and texts seldom repeat, so no dictionaries of them are tried."""

    options = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _once(**made: Column) -> Column:
    """The columns as a struct that is evaluated once: filters on what it holds are not pushed below it."""
    return F.explode(F.array(F.struct(*[c.alias(name) for name, c in made.items()])))


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells the rows of a table apart besides their id: rows alike in id and text share it."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), doc_id.isNull(), text.isNull())


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, folded, node) of every line that holds a word."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = own.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("pos", "line"))
    blanks = F.lit(False)
    for b in _BLANKS:  # the pattern is applied to the lines that need it
        blanks = blanks | F.contains("line", F.lit(b))
    folded = F.trim(F.when(blanks, F.regexp_replace("line", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("line")))
    whole = split.select("doc_id", "row", "pos", _once(folded=folded).alias("x")).where("x.folded <> ''")
    return whole.select("doc_id", "row", "pos", "x.folded", F.xxhash64("x.folded").alias("node"))


def _code(folded: Column) -> Column:
    return F.encode(folded, "UTF-16BE")


def _last(code: Column) -> Column:
    """Where the last shingle of a text in UTF-16 starts."""
    return F.greatest((F.octet_length(code) / 2).cast("int") - SHINGLE, F.lit(0))


def _shingle(code: Column, at: Column) -> Column:
    return F.substring(code, 2 * at + 1, F.lit(2 * SHINGLE))


def _minima(wide: DataFrame) -> DataFrame:
    """(node, whole, code) -> (node, whole, n, s0.., thin): occurrences, minima, whether few shingles gave them. Partial minima form before the shuffle."""
    spread = wide.select("node", "whole", "code", F.explode(F.sequence(F.lit(0), _last(F.col("code")))).alias("at"))
    hashed = spread.select("node", "whole", (F.col("at") == 0).alias("first"), F.hash(_shingle(F.col("code"), F.col("at"))).alias("h"))
    heard = hashed.where(F.col("whole") | F.col("first") | (F.col("h").bitwiseAND(SHARE - 1) == 0))
    least = [F.min(F.col("h").bitwiseXOR(F.lit(p))).alias(s) for s, p in zip(_MINIMA, _POINTS)]
    reached = F.array_distinct(F.array(*[F.col(s).bitwiseXOR(F.lit(p)) for s, p in zip(_MINIMA, _POINTS)]))
    return heard.groupBy("node", "whole").agg(F.sum(F.col("first").cast("int")).alias("n"), *least).withColumn("thin", F.when(F.col("whole"), False).otherwise(F.size(reached) <= THIN))


def signatures(found: DataFrame) -> Cut:
    """(node, whole, n, s0.., thin), as a cut, of every distinct line; whole: whether the minima are over all shingles."""
    wide = found.select("node", _code(F.col("folded")).alias("code"))
    count = _last(F.col("code")) + 1
    ways = F.when(count > LONG, F.array(F.lit(False))).when(count >= THRESHOLD * LONG, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    signed = Cut(_minima(wide.select("node", "code", F.explode(ways).alias("whole"))), "line-signatures")
    thin = signed.df.where("thin").select(F.col("node").alias("node2"))
    if thin.isEmpty():
        return signed
    again = found.where(F.length("folded") > LONG).select("node", "folded").join(_small(thin), F.col("node") == F.col("node2"), "left_semi")
    _minima(again.select("node", F.lit(True).alias("whole"), _code(F.col("folded")).alias("code"))).write.mode("append").parquet(signed.path)
    signed.df = signed.spark.read.schema(signed.df.schema).parquet(signed.path)
    return signed


def _bands() -> Column:
    """A key for each band of a node; its last bit is ``whole``, the three before are the band."""
    keys = [F.xxhash64(F.lit(b), "whole", *_MINIMA[b * ROWS : (b + 1) * ROWS]).bitwiseAND(~15).bitwiseOR(F.col("whole").cast("long")).bitwiseOR(F.lit(2 * b)) for b in range(BANDS)]
    return F.array(*keys)


def _pack() -> list[Column]:
    def number(four: list[str]) -> Column:
        parts = [F.shiftleft(F.col(s).cast("long").bitwiseAND(0xFFFF), 16 * i) for i, s in enumerate(four)]
        return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])

    return [number(_MINIMA[4 * k : 4 * k + 4]).alias(p) for k, p in enumerate(_PACKED)]


def _agree(x: list[str], y: list[str]) -> Column:
    """In how many minima, by their last 16 bits, two lines agree."""
    lanes = [(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.shiftleft(F.lit(0xFFFF).cast("long"), 16 * i)) == 0).cast("int") for a, b in zip(x, y) for i in range(4)]
    return sum(lanes[1:], lanes[0])


def _renamed(packed: DataFrame, to: str, *others: Column) -> DataFrame:
    return packed.select(*others, *[F.col(p).alias(f"{p}{to}") for p in _PACKED])


def _names(to: str) -> list[str]:
    return [f"{p}{to}" for p in _PACKED]


def _shingles(folded: Column) -> Column:
    each = F.transform(F.array(_code(folded)), lambda code: F.transform(F.sequence(F.lit(1), 2 * _last(code) + 1, F.lit(2)), lambda at: F.xxhash64(F.substring(code, at, F.lit(2 * SHINGLE)))))
    return F.array_distinct(F.get(each, 0))


def _agreeing(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in AGREE minima at least, taken the same way."""
    left = _renamed(near, "a", F.col("node").alias("a2"), F.col("whole").alias("wa"))
    right = _renamed(near, "b", F.col("node").alias("b2"), F.col("whole").alias("wb"))
    both = pairs.join(left, F.col("a") == F.col("a2")).join(right, (F.col("b") == F.col("b2")) & (F.col("wa") == F.col("wb")) & (_agree(_names("a"), _names("b")) >= AGREE))
    return both.select("a", "b").distinct()


def possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that can have a Jaccard similarity of THRESHOLD by the sizes of their sets and WORDS numbers of parities. texts: node, folded.

    A bit tells whether an odd number of a set's shingles fall on it. Two sets differ in as many shingles as bits at least, and at the
    threshold in no more than (1 - THRESHOLD) / (1 + THRESHOLD) of both sizes: every such pair stays. Each set is taken once.
    """
    each = texts.select("node", F.explode(_shingles(F.col("folded"))).alias("t"))
    placed = each.select("node", F.col("t").bitwiseAND(WORDS - 1).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(t, 32) & 63 as int))").alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    sketches = Cut(placed.groupBy("node").agg(F.count("*").alias("size"), *words), "line-sketches").df
    left, right = (sketches.select(F.col("node").alias(f"{x}2"), F.col("size").alias(f"size{x}"), *[F.col(f"w{w}").alias(f"w{w}{x}") for w in range(WORDS)]) for x in "ab")
    differ = [F.bit_count(F.col(f"w{w}a").bitwiseXOR(F.col(f"w{w}b"))) for w in range(WORDS)]
    near = sum(differ[1:], differ[0]) <= F.lit((1 - THRESHOLD) / (1 + THRESHOLD)) * (F.col("sizea") + F.col("sizeb")) + 1e-6
    sized = F.least("sizea", "sizeb") >= THRESHOLD * F.greatest("sizea", "sizeb")
    return pairs.join(left, F.col("a") == F.col("a2")).join(right, (F.col("b") == F.col("b2")) & sized & near).select("a", "b")


def verified(pairs: DataFrame, found: DataFrame, often: bool = False) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of THRESHOLD or more. found: node, folded; often: whether lines are in many pairs each."""
    pairs = Cut(pairs.select("a", "b"), "line-pairs").df
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node2")).distinct()
    texts = found.select("node", "folded").join(_small(ends), F.col("node") == F.col("node2"), "left_semi").dropDuplicates(["node"])
    texts = Cut(texts, "line-texts")
    if often:
        pairs = Cut(possible(pairs, texts.df), "line-possible").df
    left, right = texts.df.select(F.col("node").alias("a2"), F.col("folded").alias("fa")), texts.df.select(F.col("node").alias("b2"), F.col("folded").alias("fb"))
    both = pairs.join(left, F.col("a") == F.col("a2")).join(right, F.col("b") == F.col("b2"))
    sets = both.select("a", "b", _once(x=_shingles(F.col("fa")), y=_shingles(F.col("fb"))).alias("z")).select("a", "b", "z.x", "z.y")
    sized = sets.where(F.least(F.size("x"), F.size("y")) >= THRESHOLD * F.greatest(F.size("x"), F.size("y")))
    shared = sized.select("a", "b", _once(shared=F.size(F.array_intersect("x", "y")), sum=F.size("x") + F.size("y")).alias("z"))
    out = Cut(shared.where(F.col("z.shared") >= THRESHOLD * (F.col("z.sum") - F.col("z.shared"))).select("a", "b"), "line-edges").df
    texts.drop()
    return out


def _pairs(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


class Labels:
    """(node, component) of all nodes that have a link so far; ``link`` contracts new edges to components before it joins them."""

    def __init__(self) -> None:
        self.df: DataFrame | None = None

    def of(self, df: DataFrame, node: str, name: str) -> DataFrame:
        if self.df is None:
            return df.withColumn(name, F.col(node))
        own = self.df.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
        return df.join(own, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__component", node)).drop("__node", "__component")

    def link(self, edges: DataFrame) -> None:
        over = self.of(self.of(edges, "a", "ca"), "b", "cb").where("ca <> cb").select("ca", "cb").distinct()
        parts = connected_components(over, "ca", "cb").select(F.col("node").alias("old"), F.col("component").alias("new"))
        if self.df is None:
            self.df = Cut(parts.select(F.col("old").alias("node"), F.col("new").alias("component")), "line-labels").df
            return
        moved = self.df.join(parts, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        fresh = parts.join(self.df.select("node"), F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
        self.df = Cut(moved.unionByName(fresh), "line-labels").df


def components(found: DataFrame, signatures: Cut) -> DataFrame:
    """(node, component) of lines that have a fuzzy partner. Drops the signatures."""
    signed = signatures.df
    keyed = signed.select("node", F.least("n", F.lit(16383)).cast("short").alias("n"), F.explode(_bands()).alias("key")).repartition("key")
    order = F.shiftleft(F.col("n").cast("long"), 48).bitwiseOR(F.shiftrightunsigned("node", 16))  # the most frequent line is the hub
    alike = Window.partitionBy("key")  # one shuffle; a key's rows are sorted and spilled, never held
    several = keyed.select("key", "node", F.count("*").over(alike).alias("c"), F.max_by("node", order).over(alike).alias("hub")).where("c > 1")
    now = Cut(several.select("key", "node", "hub"), "line-buckets")
    packed = signed.select("node", "whole", *_pack())
    near = Cut(packed.join(now.df.select(F.col("node").alias("node2")).distinct(), F.col("node") == F.col("node2"), "left_semi"), "line-candidates")
    signatures.drop()
    labels = Labels()
    labels.link(verified(_agreeing(now.df.where("node <> hub").select(*_pairs("node", "hub")).distinct(), near.df), found))
    placed = labels.of(now.df.where("node <> hub").select("key", "node"), "node", "own")  # the hub has met all others
    open_ = placed.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("often")).where("low <> high").select(F.col("key").alias("key2"), "often")
    within = placed.join(open_, F.col("key") == F.col("key2")).select("key", "node", "own", "often")
    rest = Cut(_signed(within, near.df, "key"), "line-rest")
    now.drop()
    if not rest.df.isEmpty():
        labels.link(verified(_apart(rest.df, near.df, found), found, often=True))
    rest.drop()
    near.drop()
    return labels.df


def _signed(rows: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """The rows with p0.. of their node, taken the way that the key's last bit says."""
    signs = _renamed(near, "", F.col("node").alias("node2"), F.col("whole").cast("long").alias("whole2"))
    return rows.join(signs, (F.col("node") == F.col("node2")) & (F.col(key).bitwiseAND(1) == F.col("whole2"))).drop("node2", "whole2")


def _parts(crowded: DataFrame) -> DataFrame:
    """Of (key, node, own, p0..): a row (part, node, own) for each two of three minima of each band but the key's own, where a part has several components."""

    def minimum(j: int) -> Column:
        return F.shiftrightunsigned(_PACKED[j // 4], 16 * (j % 4)).bitwiseAND(0xFFFF)

    whole = F.col("key").bitwiseAND(1)
    twos = [F.struct(F.lit(b).alias("band"), F.xxhash64("key", F.lit(i), F.lit(j), minimum(i), minimum(j)).bitwiseAND(~1).bitwiseOR(whole).alias("part")) for b in range(BANDS) for i, j in combinations(range(b * ROWS, (b + 1) * ROWS), 2)]
    own_band = F.shiftright(F.col("key").bitwiseAND(14), 1)
    spread = crowded.select("key", "node", "own", F.explode(F.array(*twos)).alias("x")).where(F.col("x.band") != own_band).select("x.part", "node", "own")
    one = Window.partitionBy("part")
    counted = spread.select("*", F.min("own").over(one).alias("low"), F.max("own").over(one).alias("high"), F.count("*").over(one).alias("often"))
    return counted.where("low <> high").drop("low", "high")


def _crowding(rows: DataFrame, key: str) -> DataFrame:
    """(key, node, own, often, p0..) with share: of how many neighbours in a random order of a key's rows the components differ and AGREE minima agree."""
    order, one = Window.partitionBy(key).orderBy("node", "own"), Window.partitionBy(key)  # node is a hash
    before = rows.select("*", F.lag("own").over(order).alias("ob"), *[F.lag(p).over(order).alias(f"{p}b") for p in _PACKED])
    met = (F.col("own") != F.col("ob")) & (_agree(_PACKED, _names("b")) >= AGREE)
    return before.select(key, "node", "own", "often", *_PACKED, F.avg(F.coalesce(met, F.lit(False)).cast("int")).over(one).alias("share"))


def _crowd(parts: DataFrame) -> DataFrame:
    """(node, own, minor, met) of the lines of (part, node, own, met).

    met: whether all parts of the line are compared line by line; minor: whether it is outside the largest component of some other part.
    """
    sizes = parts.where("not met").groupBy("part", "own").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("part").agg(F.max(F.struct("size", "own")).alias("most")).select(F.col("part").alias("part2"), F.col("most.own").alias("major"))
    return parts.join(largest, F.col("part") == F.col("part2"), "left").groupBy("node", "own").agg(F.coalesce(F.max(F.col("own") != F.col("major")), F.lit(False)).alias("minor"), F.min("met").alias("met"))


def _pairwise(rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of different components among rows of one key that agree in AGREE minima."""
    other = _renamed(rows, "b", F.col(key).alias("key2"), F.col("node").alias("b"), F.col("own").alias("ob"))
    met = rows.join(other, (F.col(key) == F.col("key2")) & (F.col("own") != F.col("ob")) & (F.col("node") < F.col("b")) & (_agree(_PACKED, _names("b")) >= AGREE))
    return met.select(F.col("node").alias("a"), "b")


def _prefix(single: DataFrame) -> DataFrame:
    """Of (node, own, minor, size, most, t), the tokens t of a set, the ``most`` that fewest sets hold, with their place, that number (often > 1), and those before (prev)."""
    shared = single.select("*", F.count("*").over(Window.partitionBy("t")).alias("often")).where("often > 1")
    # one line's tokens; those that no other line has come first and are only counted
    listed = shared.groupBy("node", "own", "minor", "size", "most").agg(F.sort_array(F.collect_list(F.struct("often", "t"))).alias("ts"))
    kept = F.slice("ts", F.lit(1), F.greatest(F.col("most") - F.col("size") + F.size("ts"), F.lit(0)).cast("int"))
    spread = listed.select("node", "own", "minor", "size", (F.col("size") - F.size("ts")).alias("alone"), F.transform(kept, lambda x: x["t"]).alias("all"), F.posexplode(kept).alias("at", "x"))
    return spread.select("x.t", "node", "own", "minor", "size", (F.col("alone") + F.col("at") + 1).alias("place"), "x.often", F.slice("all", F.lit(1), F.col("at")).alias("prev"))


def _meeting(prefix: DataFrame, needed: Column) -> DataFrame:
    """Pairs (a, b) of a minor line and one of another component that share a token, at the first one they share, if they can share ``needed`` (of size and size2).

    All sets are in one order, so those that share no token before this one share at most this and what follows it in either.
    """
    other = prefix.select(F.col("t").alias("t2"), F.col("node").alias("b"), F.col("own").alias("ob"), F.col("minor").alias("minor2"), F.col("size").alias("size2"), F.col("place").alias("place2"), F.col("prev").alias("prev2"))
    most = 1 + F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
    met = prefix.where("minor").join(other, (F.col("t") == F.col("t2")) & (F.col("own") != F.col("ob")) & (~F.col("minor2") | (F.col("node") < F.col("b"))) & (most >= needed) & ~F.arrays_overlap("prev", "prev2"))
    return met.select(*_pairs("node", "b")).distinct()


def _apart(rest: DataFrame, near: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within the open buckets (key, node, own, often, p0..) that can reach THRESHOLD.

    In a bucket of up to FEW lines each meets the others, and in a larger dense one too if a line is expected to agree with
    no more than FEW of them. Other dense buckets are crowds; those that are not dense are split into parts, and parts are
    crowds unless the same holds for them. Lines of crowds meet by the rarest of all their shingles instead: with each set
    sorted from its rarest shingle, two sets at the threshold share one among their first n - ceil(0.8 n) + 1, and enough may
    follow. Two lines of a crowd that are not of one component are not both of its largest, so one of them is minor.
    """
    dense, loose = F.col("share") >= DENSE, (F.col("often") * F.col("share") <= FEW) & (F.col("often") <= FEW / DENSE)
    kinds = Cut(_crowding(rest.where(F.col("often") > FEW), "key"), "line-kinds").df
    pairs = _pairwise(rest.where(F.col("often") <= FEW).unionByName(kinds.where(dense & loose).drop("share")), "key")
    split = Cut(_parts(kinds.where(~dense)), "line-split")
    parts = Cut(_crowding(_signed(split.df, near, "part"), "part"), "line-parts").df
    split.drop()
    large = F.col("often") > FEW
    pairs = pairs.unionByName(_pairwise(parts.where(~large | loose), "part")).distinct()
    whole = kinds.where(dense & ~loose).select(F.col("key").alias("part"), "node", "own", F.lit(False).alias("met"))
    crowd = Cut(_crowd(whole.unionByName(parts.where(large).select("part", "node", "own", loose.alias("met")))), "line-crowd").df
    crowd = crowd.where("not met").drop("met")
    if crowd.isEmpty():
        return pairs
    members = _small(crowd.select(F.col("node").alias("n3")))
    texts = found.select(F.col("node").alias("n2"), "folded").join(members, F.col("n2") == F.col("n3"), "left_semi").dropDuplicates(["n2"])
    sets = crowd.join(texts, F.col("node") == F.col("n2")).select("node", "own", "minor", _shingles(F.col("folded")).alias("x"))
    single = Cut(sets.select("node", "own", "minor", F.size("x").alias("size"), (F.size("x") - F.ceil(THRESHOLD * F.size("x")) + 1).alias("most"), F.explode("x").alias("t")), "line-rare")
    prefix = Cut(_prefix(single.df), "line-prefix").df
    single.drop()
    shared = F.ceil(F.lit(THRESHOLD / (1 + THRESHOLD)) * (F.col("size") + F.col("size2")) - 1e-6)
    crowded = near.join(members, F.col("node") == F.col("n3"), "left_semi")
    return pairs.unionByName(_agreeing(_meeting(prefix, shared), crowded)).distinct()


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, gone): for each document that loses lines, their positions.

    One line of each component stays: the first one (lowest position) in the document of least id (null last), then least row key.
    """
    kept_lines = Cut(lines(docs), "lines", "zstd")
    found = kept_lines.df
    signed = signatures(found)
    repeated = Cut(signed.df.where("n > 1").select("node").distinct(), "line-repeated").df
    parts = components(found, signed)
    own = parts.select(F.col("node").alias("n2"), "component")
    named = own.unionByName(repeated.join(own, F.col("node") == F.col("n2"), "left_anti").select(F.col("node").alias("n2"), F.col("node").alias("component")))
    hits = found.select("doc_id", "row", "pos", "node").join(named, F.col("node") == F.col("n2")).select("doc_id", "row", "pos", "component")
    hits = Cut(hits, "line-hits").df
    kept_lines.drop()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")
    stays = hits.groupBy("component").agg(F.min(place).alias("at")).select(F.col("component").alias("c2"), "at")
    same = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("row") == F.col("at.row")) & (F.col("pos") == F.col("at.pos"))
    gone = hits.join(stays, F.col("component") == F.col("c2")).where(~same)
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))  # at most the lines of one document


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, all columns and rows, with ``text`` without the lines that others stand for; n_chars, if there, follows.

    No document goes: one whose lines all occur earlier keeps an empty text. Null texts stay null. Rows that repeat an id
    with another text are documents of their own; rows alike in id and text are one document and lose the same lines.
    Rows with a null id come last, so their lines stay where no other row has them. Empty tables are returned as they are;
    other columns may have any name.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    id_, text_ = F.col("own.doc_id").cast("long"), F.col("own.text")
    gone = Cut(removed(docs.select("doc_id", "text")), "line-gone").df
    gone = gone.select(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), "row").alias("at"), "gone")
    joined = own.withColumn("here", F.struct(F.coalesce(id_, F.lit(0)).alias("i"), row_key(id_, text_).alias("row"))).join(gone, F.col("here") == F.col("at"), "left")
    split = F.when(F.col("gone").isNotNull(), F.split(text_.cast("string"), "\n", -1))  # once a document, not once a line
    parted = joined.select("own", "gone", _once(lines=split).alias("x")).select("own", "gone", F.col("x.lines").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), text_).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = parted.select("own", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("own").getField(c).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, text_sha256 of what ``dedup_lines`` leaves of each document."""
    after = dedup_lines(docs.select("doc_id", F.col("text"), F.size(F.split(F.col("text").cast("string"), "\n", -1)).alias("n_lines")))
    kept = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return after.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(kept, F.lit(0)).cast("long").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
