"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Statistics of every whole text give a transformed vector (log length, log word length, log symbol rate, shares of repeated
lines and words). Per language and source a minimum-covariance-determinant estimate is found by concentration steps from two
starts (medians with quartile deviations, and plain means with covariances): take the three quarters of the rows that lie
nearest, estimate mean and covariance from them, measure again, until determinants stay as they are, STEPS times at most; of
the two results the one of smaller determinant is taken. The covariance is then scaled, up or down, so that the three quarters that lie nearest
are as near as those of a normal distribution, and a row is rejected if its squared Mahalanobis distance is beyond the
99.9 % point of chi-square.

Groups of fewer than LEAST rows have too few for five dimensions: their scatter is that of all rows of their language (of all
rows, if those are too few as well), and their centre its centre drawn towards the group's own medians by n / (n + LEAST).

Vectors are whole thousandths and their moments decimals, so sums do not depend on the order of tasks and reruns agree.
Groups meet as moments and histograms only (combined before the shuffle); no group's rows are gathered, however many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, words

P, UNIT = 5, 1000.0
HALF, STEPS, STILL = 0.75, 6, 1e-6
#: Quantile HALF of chi-square with 1 to P degrees of freedom, and its quantile 0.999 with P, beyond which rows are rejected.
CHI_HALF, CUTOFF = (1.3233, 2.7726, 4.1083, 5.3853, 6.6257), 20.515
#: Least standard deviation of each coordinate (beside those before it), so that a statistic that never varies in a group
#: rejects no small change. A minimum: larger deviations stay as they are.
FLOOR = (0.5, 0.1, 1.0, 0.1, 0.05)
#: Smaller groups are shrunk to their language; tables of fewer rows than POOL are not judged.
LEAST, POOL = 100, 20
MIN_WORDS, MAX_REPEATED = 50, 50
FEW = 64
BROADCAST_ROWS = 100_000


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; null texts have no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        words(text).alias("w"),
    )
    own = own.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    windows = F.when(F.size("w") < 3, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    own = own.withColumn("h", windows).withColumn("n_words", F.size("w").cast("long")).drop("w")
    own = own.withColumn("s", F.sort_array("h"))
    own = own.withColumn("twice", F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (x == F.get("s", i - 1))))).drop("s")
    # a few repeated windows are looked up one by one; many are brought together by sorting with their places
    own = own.withColumn("pairs", F.when(F.size("twice") > FEW, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    many = F.sort_array(F.transform(F.filter("pairs", lambda x, i: (x["h"] == F.get("pairs", i - 1)["h"]) | (x["h"] == F.get("pairs", i + 1)["h"])), lambda x: x["i"]))
    few = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains("twice", F.get("h", i)))
    own = own.withColumn("spots", F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") > FEW, many).otherwise(few)).drop("pairs", "h", "twice")
    covered = F.aggregate("spots", F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum"), i.alias("last")))["sum"]
    own = own.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return own.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _vector() -> list[Column]:
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    values = (F.log(n), F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars), F.col("n_dup_lines") / n * 10, F.col("n_repeat_words") / n)
    return [F.round(v * UNIT).cast("long").alias(f"x{k}") for k, v in enumerate(values)]


def _measured(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by forward substitution in the Cholesky factor l<i><j> about the mean m<i>."""
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = F.col("z0") * F.col("z0")
    for i in range(1, P):
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return rows.withColumn("d2", total).drop(*[f"z{i}" for i in range(P)])


def _moments(rows: DataFrame) -> DataFrame:
    """Per group g: mean m<i> and covariance c<i><j>, exact up to the last division."""
    exact = lambda c: F.sum(c.cast("decimal(28,0)"))
    sums = rows.groupBy("g").agg(F.count("*").alias("n"), *[exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)], *[exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])
    out = sums.select("g", "n", *[(F.col(f"s{i}").cast("double") / F.col("n")).alias(f"m{i}") for i in range(P)], *[F.col(f"q{i}{j}").cast("double").alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)])
    return out.select("g", *[f"m{i}" for i in range(P)], *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])


def _factor(moments: DataFrame, scale: Column) -> DataFrame:
    """Adds the Cholesky factor l<i><j> of the covariance times ``scale``, no l<i><i> below FLOOR, and how many are above it (free)."""
    out, free = moments, F.lit(0)
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") * scale
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            least = (FLOOR[i] * UNIT) ** 2
            if i == j:
                free = free + (value > least).cast("int")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(least))) if i == j else value / F.col(f"l{j}{j}"))
    return out.withColumn("free", free)


def _nearest(measured: DataFrame) -> DataFrame:
    """Per group g: the distance d2 that three quarters of the rows stay within, to a sixteenth of a power of two."""
    bins = measured.groupBy("g", F.floor(F.log2(1 + F.col("d2")) * 16).alias("bin")).count()
    up = Window.partitionBy("g").orderBy("bin")
    summed = bins.withColumn("below", F.sum("count").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("count").over(Window.partitionBy("g")))
    return summed.where(F.col("below") >= HALF * F.col("all")).groupBy("g").agg(F.min("bin").alias("bin")).select("g", (F.pow(F.lit(2.0), (F.col("bin") + 1) / 16) - 1).alias("within"))


def _start(rows: DataFrame) -> DataFrame:
    """Per group g: medians as means and median deviations as a diagonal factor, from histograms of whole hundredths."""
    each = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / 10) for i in range(P)])).alias("i", "bin"))
    bins = each.groupBy("g", "i", "bin").count()
    up = Window.partitionBy("g", "i").orderBy("bin")
    part = bins.withColumn("share", F.sum("count").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(Window.partitionBy("g", "i")))
    at = lambda q, i: F.min(F.when((F.col("i") == i) & (F.col("share") >= q), F.col("bin") * 10.0 + 5))
    spread = lambda i: F.greatest((at(0.75, i) - at(0.25, i)) / 1.349, F.lit(FLOOR[i] * UNIT))
    out = part.groupBy("g").agg(*[at(0.5, i).alias(f"m{i}") for i in range(P)], *[spread(i).alias(f"l{i}{i}") for i in range(P)])
    return out.select("g", *[f"m{i}" for i in range(P)], *[(F.col(f"l{i}{j}") if i == j else F.lit(0.0).alias(f"l{i}{j}")) for i in range(P) for j in range(i + 1)])


def _with(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """One row a group beside the rows; sent to every executor while there are few groups (counted)."""
    return rows.join(F.broadcast(groups) if few else groups, "g")


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def _spread(plan: DataFrame) -> DataFrame:
    """Adds logdet, the logarithm of the determinant of the factor."""
    total = F.log("l00")
    for i in range(1, P):
        total = total + F.log(f"l{i}{i}")
    return plan.withColumn("logdet", total)


def _concentrated(rows: DataFrame, few: bool) -> DataFrame:
    """(g, m.., l.., free, within): the estimate of each group g of the rows, the better one of two starts, before scaling."""
    both = Cut(rows.select(F.explode(F.array(F.lit("#0"), F.lit("#1"))).alias("start"), "g", *[f"x{i}" for i in range(P)]).select(F.concat("g", "start").alias("g"), *[f"x{i}" for i in range(P)]), "mcd-rows")
    plain = _factor(_moments(rows), F.lit(1.0)).select(F.concat("g", F.lit("#1")).alias("g"), *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])
    plan = Cut(_start(rows).withColumn("g", F.concat("g", F.lit("#0"))).unionByName(plain), "mcd").df
    plan, before = _spread(plan), None
    for _ in range(STEPS):
        measured = _measured(_with(both.df, plan, few))
        near = Cut(_nearest(measured), "mcd").df
        moments = _moments(_with(measured, near, few).where("d2 <= within").select("g", *[f"x{i}" for i in range(P)]))
        plan = Cut(_spread(_factor(moments, F.lit(1.0))), "mcd").df
        now = plan.select("g", "logdet")
        if before is not None and now.join(before.withColumnRenamed("logdet", "was"), "g").where(F.abs(F.col("logdet") - F.col("was")) > STILL).isEmpty():
            break
        before = now
    near = _nearest(_measured(_with(both.df, plan, few)))
    fitted = plan.join(near, "g").withColumn("start", F.substring("g", -1, 1)).withColumn("g", F.expr("substring(g, 1, length(g) - 2)"))
    best = F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))  # two rows a group
    out = Cut(fitted.withColumn("nth", best).where("nth = 1").drop("nth", "start", "logdet"), "mcd").df
    both.drop()
    return out


def verdicts(docs: DataFrame) -> DataFrame:
    """The statistics of each row of ``docs`` with distance and kept, one row for each input row.

    kept is false if base_failed, else whether the row lies within its group's cutoff. Rows that fail the base rules have
    no say in the estimates. Null languages and sources are groups of their own. A table of fewer than POOL rows that pass the
    base rules judges none of them. Empty tables give no rows.
    """
    rows = Cut(statistics(docs), "statistics").df
    usable = rows.where(~F.col("base_failed")).withColumn("gl", _key("lang")).withColumn("gs", F.concat_ws("/", _key("lang"), _key("source")))
    sizes = usable.groupBy("gl", "gs").agg(F.count("*").alias("n"))
    langs = sizes.groupBy("gl").agg(F.sum("n").alias("in_lang"))
    group = F.when(F.col("n") >= LEAST, F.col("gs")).when(F.col("in_lang") >= LEAST, F.concat(F.lit("lang/"), "gl")).otherwise("all")
    names = Cut(sizes.join(langs, "gl").select("gs", "gl", "n", (F.col("n") < LEAST).alias("small"), group.alias("g")), "groups").df
    few = names.count() <= BROADCAST_ROWS
    names = F.broadcast(names) if few else names
    vectors = Cut(usable.select("doc_id", "gs", "gl", *_vector()), "vectors").df
    x = [f"x{i}" for i in range(P)]
    pools = names.where("small").select("gl", "g").distinct()
    own = vectors.join(names.where("not small").select("gs", "g"), "gs").select("g", *x)
    whole = vectors.join(pools.where("g <> 'all'"), "gl").select("g", *x)
    anyone = vectors.crossJoin(F.broadcast(pools.where("g = 'all'").select("g").limit(1))).select("g", *x)  # one row or none
    fitted = _concentrated(own.unionByName(whole).unionByName(anyone), few)
    # coordinates held at FLOOR add next to nothing to distances: the quantile is that of the free ones
    scale = F.when(F.col("free") > 0, F.col("within") / F.element_at(F.array(*map(F.lit, CHI_HALF)), F.greatest("free", F.lit(1)))).otherwise(1.0)
    scaled = fitted.withColumn("scale", scale).drop("free", "within", *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])
    final = _factor(scaled, F.col("scale"))
    middle = _start(vectors.join(names.where("small").select("gs"), "gs").select(F.col("gs").alias("g"), *x)).select(F.col("g").alias("gs"), *[F.col(f"m{i}").alias(f"own{i}") for i in range(P)])
    share = F.col("n") / (F.col("n") + LEAST)
    centre = [F.when(F.col("small"), F.col(f"m{i}") * (1 - share) + F.col(f"own{i}") * share).otherwise(F.col(f"m{i}")).alias(f"m{i}") for i in range(P)]
    factor = [f"l{i}{j}" for i in range(P) for j in range(i + 1)]
    plan = Cut(names.join(final, "g").join(middle, "gs", "left").select("gs", *centre, *factor), "mcd").df
    named = rows.withColumn("gs", F.concat_ws("/", _key("lang"), _key("source"))).select("*", *_vector())
    judged = _measured(named.join(F.broadcast(plan) if few else plan, "gs", "left"))
    enough = usable.limit(POOL).count() >= POOL
    distance = F.when(~F.col("base_failed") & F.lit(enough), F.col("d2"))
    judged = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
