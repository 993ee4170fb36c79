"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The mix that differs least from the corpus, in relative entropy and with no document above ``MOST`` copies, under
one token constraint for each source, has document rates min(MOST, exp(lambda_source * size / mean size)). The
multipliers solve a convex dual that falls apart by source; safeguarded Newton steps find them on counts of
(source, size), all sources at once. Rates are rounded into copies by a hashed order within each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stage

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix holds, as a fraction.
SHARE = (3, 2)
MOST = 2
#: Words: all but U+0020 and U+0009 to U+000D, which is what \S leaves out.
WORD = r"\S++"
#: Newton stops when no source's expected words are further from its target than this share of it.
TOLERANCE, STEPS = 1e-6, 80
#: Sources up to which their table is broadcast (about 100 bytes each); beyond it is joined by shuffle.
FEW_SOURCES = 20_000
#: The order of documents that get a copy more is cut into 2**18 bins, found in three steps of 64.
LEVELS, STEP_BITS = 3, 6


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0) and u (a hash of id and text, uniform in 0 to 1)."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), uniform().alias("u"))


def uniform() -> Column:
    return F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("text").cast("string")), F.lit(1 << 53)).cast("double") / float(1 << 53)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """Of each source: src (its rank by code points, null last), source_size, cap and target words.

    Shares are dealt by weight; a source whose share is above its cap gets the cap and the rest is dealt again.
    Taking sources by cap per weight, one is capped exactly if its share of what is left is. (Windows
    without a partition: they see one row for each source.)
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") - 1) % len(WEIGHTS) + 1).cast("long")).withColumn("cap", MOST * F.col("source_size"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    up, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    num, den = SHARE
    s = s.withColumn("all", F.sum("source_size").over(every))
    s = s.withColumn("left", num * F.col("all") - den * F.coalesce(F.sum("cap").over(up), F.lit(0))).withColumn("weights", F.sum("weight").over(rest))
    s = s.withColumn("capped", F.col("cap") * den * F.col("weights") <= F.col("weight") * F.col("left"))
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_ = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    share = (F.col("weight") * (num * F.col("all") - den * spent)).cast("double") / (den * open_).cast("double")
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("source", "src", "source_size", "cap", "target")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= FEW_SOURCES else table


def rate(lam: str = "lam", size: str = "size") -> Column:
    """Copies expected of a document: the capped exponential tilt; all of a source at its cap; none without a target."""
    tilt = F.exp(F.least(F.col(lam) * F.col(size) / F.col("mean"), F.log(F.lit(float(MOST)))))
    return F.when(F.col("target") >= F.col("cap"), float(MOST)).when(F.col("target") <= 0, 0.0).otherwise(F.least(tilt, F.lit(float(MOST))))


def solve(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with mean (words of a document that has any) and lam, by Newton steps on the dual.

    ``sized`` holds src and size. A step that leaves the bracket known so far is replaced by its middle; if a source is
    not at its target after ``STEPS`` steps, the job stops with an error."""
    counts = stage(sized.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n")), "sizes")
    span = counts.groupBy("src").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = sources.join(span, "src", "left").withColumn("hi", F.log(F.lit(float(MOST))) * F.col("mean") / F.col("least"))
    state = stage(state.withColumn("lo", -60 * F.col("hi")).withColumn("lam", F.when(F.col("target") > 0, 0.0)).drop("least"), "newton")
    for _ in range(STEPS):
        r = rate()
        slope = F.when(r < MOST, r * F.col("size") / F.col("mean")).otherwise(0.0)
        at = counts.join(_small(state.select("src", "lam", "mean", "target", "cap")), "src")
        at = at.groupBy("src").agg(F.sum(F.col("n") * F.col("size") * r).alias("words"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        now = state.join(at, "src", "left").withColumn("f", F.col("words") - F.col("target"))
        open_ = (F.col("target") > 0) & (F.col("target") < F.col("cap")) & (F.abs("f") > TOLERANCE * F.col("target"))
        now = now.withColumn("open", F.coalesce(open_, F.lit(False)))
        now = now.withColumn("lo", F.when(F.col("open") & (F.col("f") < 0), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("open") & (F.col("f") > 0), F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - F.try_divide("f", "slope")
        inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")), F.lit(False))
        nxt = F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = stage(now.withColumn("lam", F.when(F.col("open"), nxt).otherwise(F.col("lam"))).drop("words", "slope", "f"), "newton")
        if state.where("open").isEmpty():
            return state.drop("open", "lo", "hi")
        state = state.drop("open")
    raise RuntimeError(f"no rates found in {STEPS} steps")


def _copies(rows: DataFrame) -> DataFrame:
    """Adds base (whole copies every document gets) and v (its place, in 0 to 1, in the order of those that get one more;
    null: never), from size, u and its source's parameters."""
    rows = rows.withColumn("rate", rate())
    part = F.col("rate") - F.floor("rate")
    return rows.withColumn("base", F.floor("rate")).withColumn("v", F.when((part > 0) & (F.col("size") > 0), F.col("u") / (F.col("u") + part)))


def rounded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every row takes, and each source's parameters (v_cut: documents up to it take one copy more).

    Extra copies go to documents in the order of v until the target is met. The place where that happens is
    found by sums over ever finer bins; only the rows of the last bin, one in 2**18, are looked at one by one."""
    sized = stage(sizes(docs), "sized")
    sources = stage(targets(sized), "targets")
    rows = sized.alias("d").join(_small(sources.select("source", "src")).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.size", "d.u", "s.src")
    rows = stage(rows, "ranked")
    solved = solve(rows, sources)
    rows = _copies(rows.join(_small(solved), "src")).withColumn("bin", F.floor(F.least(F.col("v"), F.lit(1 - 1e-9)) * (1 << LEVELS * STEP_BITS)))
    total = rows.groupBy("src").agg(F.sum(F.col("base") * F.col("size")).alias("whole"))
    goal = solved.join(total, "src", "left").withColumn("extra_goal", F.greatest(F.lit(0), F.round("target").cast("long") - F.coalesce("whole", F.lit(0))))
    goal = stage(goal.withColumn("edge", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")), "goals")
    run = Window.partitionBy("src").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * STEP_BITS
        at = rows.select("src", "bin", "size").join(_small(goal.select("src", "edge", "before", "extra_goal")), "src").where(F.shiftright("bin", shift + STEP_BITS) == F.col("edge"))
        sums = at.groupBy("src", F.shiftright("bin", shift).alias("next")).agg(F.sum("size").alias("extra"), F.first("before").alias("b"), F.first("extra_goal").alias("g"))
        sums = sums.withColumn("b", F.col("b") + F.coalesce(F.sum("extra").over(run), F.lit(0))).where("b < g")  # 64 rows a source
        best = sums.groupBy("src").agg(F.max(F.struct("next", "b")).alias("x")).select("src", F.col("x.next").alias("next"), F.col("x.b").alias("b"))
        goal = goal.drop("before").join(best, "src", "left").withColumn("edge", F.col("next")).withColumn("before", F.col("b")).drop("next", "b")
        goal = stage(goal, "goals")
    rows = rows.join(_small(goal.select("src", "edge", "before", "extra_goal")), "src")
    last = rows.where("bin = edge").groupBy("src", "v", "doc_id", "size", "base", "source_size", "target", "edge", "before", "extra_goal").agg(F.count("*").alias("n"))
    inner = Window.partitionBy("src").orderBy("v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("extra_goal") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0))
    last = last.withColumn("room", room).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))  # repeated rows one after the other
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("i") * F.col("size"))))
    rest = rows.where("bin is null or edge is null or bin != edge").withColumn("extra", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0))
    cut = last.where("2 * extra >= size").groupBy("src").agg(F.max("v").alias("v_cut"))
    below = F.when(F.col("edge").isNotNull(), F.col("edge") / (1 << LEVELS * STEP_BITS)).otherwise(-1.0)
    params = goal.join(cut, "src", "left").withColumn("v_cut", F.coalesce("v_cut", below))
    both = rest.unionByName(last, allowMissingColumns=True)
    taken = both.select("doc_id", "size", "source_size", "target", (F.col("base") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
    return taken, params


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row of ``docs`` (doc_id, text, source).

    A source's taken words are its target but for the solver's tolerance: whole copies of all its documents, but
    for one that is taken in part. A null or empty text has size 0 and is not taken; a null source is a source of its
    own, the last; repeated rows are rows like others; sources without words have target 0; an empty table gives no
    rows. Ties in the order go to the smaller doc_id, then to the shorter text. Other columns are ignored.
    """
    return rounded(docs)[0]


def draw(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, as often as the mix holds them (0 to 2 times). The one document that the mix
    takes in part is taken whole if that is the larger part, else not at all. Null and empty texts are not taken; rows that
    repeat one of the last id and text that gets a copy more get one each; an empty table gives no rows."""
    _, params = rounded(docs)
    p = params.select(F.struct("source", "source_size", "cap", "target", "mean", "lam", "v_cut").alias("__p"))
    # the words are counted below the join, once
    sized = docs.select(F.struct(*docs.columns).alias("__row"), F.col("source").cast("string").alias("__s"), word_count("text").alias("size"), uniform().alias("u"))
    got = sized.join(_small(p), F.col("__s").eqNullSafe(F.col("__p.source"))).select("__row", "size", "u", "__p.*")
    got = _copies(got)
    extra = F.coalesce((F.col("v") <= F.col("v_cut")).cast("int"), F.lit(0))
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("base"), F.lit(0)).cast("int") + extra).otherwise(0)
    return got.select("__row", F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).select("__row.*")
