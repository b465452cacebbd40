"""Mixing sources to target token weights by entropy balancing (DataFrame operators only).

Every document d of a source has ``size`` words and is taken at a rate r_d in [0, 2].  Among all
rates that meet the source's token constraint ``sum(r_d * size_d) = target`` we choose the one of
least bounded (Fermi-Dirac) entropy relative to the base rate 1; its dual has one multiplier per
source and the primal solution is an exponential tilt of the odds,

    r_d / (2 - r_d) = exp(lambda_s * x_d),      x_d = size_d / mean size of the source,

so the bound of two copies never has to be clipped.  The dual is convex and separable; each Newton
iteration is one distributed aggregation over a (source, size) histogram, the only thing a rate
depends on.  Up to ``HELD_SOURCES`` sources (counted first) the multipliers travel with the query as an
array; beyond, they are a table of their own.  Sums are of decimals, so their order does not matter.  Rates are then rounded into whole copies without randomness: along the sizes of a
source, fractional copies accumulate and every crossing of a half grants one extra copy, so the
error of a source stays within about one document however many rows it has.

Skew: the histogram is pre-aggregated; extra copies of a (source, size) cell are dealt to hash
buckets of about sqrt(rows) rows, so one source or one size holding most rows still spreads.

Cases: null text counts as size 0; a null source is a source of its own (sorted last); sizes of 0
take nothing; repeated rows are rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.session import materialize, settled

#: Sources whose multipliers the driver holds (24 bytes each).
HELD_SOURCES = 5_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    total_share: float = 1.5
    max_copies: float = 2.0
    tolerance: float = 1e-9
    max_iterations: int = 60


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_digest(source: Column, text: Column) -> Column:
    """64-bit hash of a row's source and text; null differs from every value."""
    return F.xxhash64(source.isNull(), source, text.isNull(), text)


def source_targets(sources: DataFrame, p: MixParams) -> DataFrame:
    """``source, source_size`` -> plus ``target``: shares by cycling weights, filled up to the cap.

    The fixed point of "cap what is above, share the excess by weight" is a water level L with
    target = min(cap, L * weight).  Sorting by cap / weight makes L a prefix-sum expression:
    with the k tightest sources capped, L_k = (total - caps before) / (weights from k on).
    """
    # One row per source: both windows run over the list of sources, never over documents.
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(w) for w in p.weights])
    ranked = sources.withColumn(
        "weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(p.weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * F.lit(p.max_copies))
    everything = Window.partitionBy(F.lit(1))
    tight = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.encode("source", "UTF-8"))
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(p.total_share)
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    # The first source whose cap exceeds its level fixes the common level of all that follow.
    # (Levels rise up to it and fall after it, hence the maximum.)
    water = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    return levels.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(water, F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def solve_dual(histogram: DataFrame, targets: DataFrame, p: MixParams) -> DataFrame:
    """Safeguarded Newton on the dual of every source at once; one aggregation per iteration.

    ``histogram``: source, size, n (size > 0).  Returns targets plus ``lambda`` (null where the
    target equals the cap: every rate is then the maximum).
    """
    stats = histogram.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size")
    )
    t = targets.alias("t").join(stats.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left").select(
        "t.source", "source_size", "target", F.coalesce("mean_size", F.lit(1.0)).alias("mean_size")
    )
    stats = materialize(
        t.withColumn("done", (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * F.lit(p.max_copies)))
    )
    state = _solve_held(histogram, stats, p) if stats.count() <= HELD_SOURCES else _solve_joined(histogram, stats, p)
    return state.select(
        "source", "source_size", "target", "mean_size",
        F.when(F.col("target") < F.col("source_size") * F.lit(p.max_copies), F.col("lam")).alias("lambda"),
    )


def _moments(share: Column, x: Column) -> list[Column]:
    """What a step needs of a source, as decimals: sums in another order come to the same double."""
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    words = F.col("n") * F.col("size")
    return [exact(words * share).alias("taken_share"), exact(words * x * share * (1 - share)).alias("slope")]


#: The tilt is kept out of reach of overflow; at |lambda| = 700 even the mean size is saturated.
FAR = 700.0


def _solve_held(histogram: DataFrame, stats: DataFrame, p: MixParams) -> DataFrame:
    """Newton with the multipliers as an array of the driver, one aggregation a step."""
    # One row per source, at most HELD_SOURCES of them.
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    numbered = materialize(stats.withColumn("number", F.row_number().over(by_name)))
    rows = numbered.select("target", "done").orderBy("number").collect()
    cells = materialize(
        histogram.alias("h").join(F.broadcast(numbered).alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")))
        .select("t.number", "h.n", "h.size", (F.col("h.size") / F.col("t.mean_size")).alias("x"))
    )
    lam, lo, hi = [0.0] * len(rows), [-FAR] * len(rows), [FAR] * len(rows)
    left = {i for i, r in enumerate(rows) if not r["done"]}
    for _ in range(p.max_iterations):
        if not left:
            break
        tilt = F.element_at(F.lit(lam), F.col("number"))
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(-tilt * F.col("x")))
        for m in cells.groupBy("number").agg(*_moments(share, F.col("x"))).collect():
            i = m["number"] - 1
            if i not in left:
                continue
            gap = m["taken_share"] * p.max_copies - rows[i]["target"]
            if abs(gap) <= p.tolerance * max(rows[i]["target"], 1.0):
                left.discard(i)
                continue
            lo[i], hi[i] = (lam[i], hi[i]) if gap < 0 else (lo[i], lam[i])
            newton = lam[i] - gap / max(m["slope"] * p.max_copies, 1e-300)
            lam[i] = newton if lo[i] < newton < hi[i] else (lo[i] + hi[i]) / 2
    return numbered.withColumn("lam", F.element_at(F.lit(lam), F.col("number")) if rows else F.lit(0.0))


def _solve_joined(histogram: DataFrame, stats: DataFrame, p: MixParams) -> DataFrame:
    """Newton with the multipliers as a table, one aggregation and two joins a step."""
    state = materialize(stats.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-FAR)).withColumn("hi", F.lit(FAR)))
    for _ in range(p.max_iterations):
        open_sources = state.where(~F.col("done"))
        x = F.col("size") / F.col("mean_size")
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("lam") * x))
        moments = (
            histogram.alias("h")
            .join(open_sources.alias("o"), F.col("h.source").eqNullSafe(F.col("o.source")))
            .select(F.col("o.source").alias("source"), F.col("h.n").alias("n"), F.col("h.size").alias("size"), x.alias("x"), share.alias("q"))
            .groupBy("source").agg(*_moments(F.col("q"), F.col("x")))
        )
        gap = F.col("taken_share") * F.lit(p.max_copies) - F.col("target")
        step = (
            state.alias("a").join(moments.alias("m"), F.col("a.source").eqNullSafe(F.col("m.source")), "left")
            .select("a.*", "taken_share", "slope")
            .withColumn("gap", gap)
            .withColumn("lo", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("newton", F.col("lam") - F.col("gap") / F.greatest(F.col("slope") * F.lit(p.max_copies), F.lit(1e-300)))
            .withColumn(
                "next",
                F.when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton"))
                .otherwise((F.col("lo") + F.col("hi")) / 2),
            )
            .withColumn("close", F.abs("gap") <= F.lit(p.tolerance) * F.greatest(F.col("target"), F.lit(1.0)))
            .select(
                "source", "source_size", "target", "mean_size",
                F.when(F.col("done") | F.col("close"), F.col("lam")).otherwise(F.col("next")).alias("lam"),
                "lo", "hi",
                (F.col("done") | F.coalesce(F.col("close"), F.lit(True))).alias("done"),
            )
        )
        state = settled(step)
        if state.where(~F.col("done")).isEmpty():
            break
    return state


def cell_copies(histogram: DataFrame, solution: DataFrame, p: MixParams) -> DataFrame:
    """Per (source, size): the rate, the copies every document gets, and how many get one more."""
    rate = F.when(F.col("lambda").isNull(), F.lit(p.max_copies)).otherwise(
        F.lit(p.max_copies) / (F.lit(1.0) + F.exp(-F.col("lambda") * F.col("size") / F.col("mean_size")))
    )
    cells = (
        histogram.alias("h").join(solution.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        .select("h.source", "h.size", "h.n", "s.source_size", "s.target", rate.alias("rate"))
        .withColumn("base", F.floor("rate").cast("long"))
        # Decimals, so that sums in another order cannot move a crossing.
        .withColumn("extra", F.round((F.col("rate") - F.col("base")) * F.col("n"), 6).cast("decimal(28,6)"))
    )
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    upto, half = F.sum("extra").over(along), F.lit("0.5").cast("decimal(2,1)")
    return cells.withColumn("upto", upto).withColumn(
        "granted",
        (F.floor(F.col("upto") + half) - F.floor(F.col("upto") - F.col("extra") + half)).cast("long"),
    ).withColumn("granted", F.least(F.greatest(F.col("granted"), F.lit(0)), F.col("n"))).drop("upto", "extra")


def mix(documents: DataFrame, p: MixParams = MixParams(), text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, source, size, source_size, target, rate, copies, taken, digest (of source and text)."""
    sized = materialize(
        documents.select(
            F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            row_digest(F.col(source), F.col(text)).alias("digest"),
        )
    )
    total = sized.count()
    buckets = max(1, int(total**0.5))
    histogram = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solution = solve_dual(histogram.where("size > 0"), source_targets(sources, p), p)
    cells = cell_copies(histogram, solution, p)

    bucket = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int")  # rows of one key, or of none, spread as well
    dealt = sized.withColumn("bucket", bucket)
    counts = dealt.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    same_cell = F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.size") == F.col("b.size"))
    within = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    quota = (
        counts.alias("b").join(cells.alias("c"), same_cell)
        .select("b.source", "b.size", "b.bucket", "b.m", "c.n", "c.source_size", "c.target", "c.rate", "c.base", "c.granted")
        .withColumn("seen", F.sum("m").over(within))
        # Buckets before this one take floor(granted * seen / n): exact integers, at most m each.
        .withColumn(
            "extra",
            (F.floor(F.col("granted").cast("decimal(38,0)") * F.col("seen") / F.col("n"))
             - F.floor(F.col("granted").cast("decimal(38,0)") * (F.col("seen") - F.col("m")) / F.col("n"))).cast("long"),
        )
    )
    rank = Window.partitionBy("source", "size", "bucket").orderBy("doc_id", "digest")
    return (
        dealt.withColumn("place", F.row_number().over(rank)).alias("d")
        .join(
            quota.alias("q"),
            F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.bucket") == F.col("q.bucket")),
        )
        .select("d.doc_id", "d.source", "d.size", "q.source_size", "q.target", "q.rate",
                (F.col("q.base") + (F.col("d.place") <= F.col("q.extra")).cast("long")).alias("copies"), "d.digest")
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def copies_by_key(mixed: DataFrame) -> DataFrame:
    """Per key and digest that has copies: those every row gets, and how many rows get one more.

    Rows of one key and digest have one source and size, hence copies that differ by one at most.
    """
    alike = mixed.groupBy(F.col("doc_id").alias("_key"), F.col("digest").alias("_row")).agg(
        F.min("copies").alias("_least"), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias("_more")
    )
    return alike.where("_least > 0 OR _more > 0")


def expand(documents: DataFrame, copies: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row repeated as often as ``copies_by_key`` says, whatever other rows share its key.

    Rows travel as one struct, so other columns may have any names.
    """
    marked = documents.select(F.struct("*").alias("row"), F.col(key).alias("key"), row_digest(F.col(source), F.col(text)).alias("digest"))
    joined = marked.join(copies, marked["key"].eqNullSafe(copies["_key"]) & (marked["digest"] == copies["_row"]))
    even = joined.where("_more = 0").select("row", F.col("_least").alias("copies"))
    # Only rows alike in key, source and text are told apart by a rank: without such rows nothing is sorted.
    rank = F.row_number().over(Window.partitionBy("_key", "_row").orderBy(F.to_json("row")))
    uneven = joined.where("_more > 0").select("row", (F.col("_least") + (rank <= F.col("_more")).cast("long")).alias("copies"))
    taken = even if copies.where("_more > 0").isEmpty() else even.unionByName(uneven.where("copies > 0"))
    # A copy more is a row more: lists of copies are not built around the texts.
    return taken.select(F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy"), "row").select("row.*")
