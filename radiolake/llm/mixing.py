"""Mixing knowledge chunks of several specifications to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.llm.common import WORD, free_name
from radiolake.session import cut_lineage

BINS, COARSE = 1 << 14, 1 << 7
CLASSES = 65  # of sizes, by their number of binary digits


def _draw(df: DataFrame, chunk_id: str, seed: str) -> Column:
    """The chunk's uniform random number in [0, 1): 52 bits of a digest of seed and id, so reruns agree."""
    bits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(df[chunk_id].cast("string"), F.lit("")))), 1, 13)
    return F.conv(bits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _words(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.regexp_count(df[text].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """spec, source_size, target: one row per spec of the catalogue, shared out by filling up.

    With specs ordered by how soon their limit is reached, the level at which all
    others are filled follows from running sums; it is the level where no spec
    without a limit stands above its own.
    """
    place = F.row_number().over(Window.orderBy(F.col("spec").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    by_limit = Window.orderBy("limit_at", F.col("spec").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("limit_at", F.col("limit") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
        )
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("limit_at"), F.struct("limit_at", "spec", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("limit"), F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return levels.select("spec", "source_size", target.alias("target"))


def _plan(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per spec: source_size, target, whole copies, and the last chunk (bin, odds, id, size) of the sample."""
    totals = sized.groupBy("spec").agg(F.sum("size").alias("source_size"))
    spec = _targets(totals, weights, share, most).withColumn(
        "whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    )
    spec = spec.withColumn("open", F.col("target") - F.col("whole") * F.col("source_size"))
    spec = cut_lineage(spec, "mix-targets")
    spec = cut_lineage(spec.join(_inclusion(sized, spec), F.col("spec").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-inclusion")
    drawn = spec.where(F.col("open") > 0).select(F.col("spec").alias("_s"), "rates")
    sized = sized.join(drawn, F.col("spec").eqNullSafe(F.col("_s"))).select(
        "id", "spec", "size", _odds(F.col("u"), F.get("rates", _class(F.col("size")))).alias("odds")
    )
    sized = cut_lineage(sized.withColumn("bin", _bin(F.col("odds"))), "mix-odds")
    # the coarse bin in which the sample ends, the fine bin inside it, then the chunks of that bin alone in Pareto order
    goals = spec.where(F.col("open") > 0).select(F.col("spec").alias("s"), "open", F.lit(0).cast("long").alias("before"))
    coarse = _end(sized.withColumn("at", _bin(F.col("odds"), COARSE)), goals)
    inner = sized.join(coarse, F.col("spec").eqNullSafe(F.col("s")) & (_bin(F.col("odds"), COARSE) == F.col("last_bin"))).select(*sized.columns)
    ends = _end(inner.withColumn("at", F.col("bin")), coarse.drop("last_bin"))
    order = Window.partitionBy("s").orderBy("odds", "id", "size")  # peers share a running sum
    inside = (
        sized.join(ends, F.col("spec").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("last_bin")))
        .withColumn("got", F.col("before") + F.sum("size").over(order))
    )
    miss = F.abs(F.col("got") - F.col("open"))
    last = inside.groupBy("s").agg(
        F.min_by(F.struct("odds", "id", "size"), F.struct(miss.alias("m"), "got", "odds")).alias("last"),
        F.min(miss).alias("miss"), F.first(F.col("open") - F.col("before")).alias("miss_without"),
    )
    last = last.select(
        F.col("s").alias("s2"), F.when(F.col("miss") < F.col("miss_without"), F.col("last")).alias("last")
    )
    plan = (
        spec.join(ends.select("s", "last_bin"), F.col("spec").eqNullSafe(F.col("s")), "left")
        .join(last, F.col("spec").eqNullSafe(F.col("s2")), "left")
        .select(F.col("spec").alias("_spec"), "source_size", "target", "whole", "rates", "last_bin", "last")
    )
    return cut_lineage(plan, "mix-plan")


def _end(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per spec the bin ``at`` in which the running size reaches what is open: s, last_bin, before (the size before that bin), open."""
    bins = rows.groupBy("spec", "at").agg(F.sum("size").alias("bin_size"))
    upto = F.col("before") + F.sum("bin_size").over(Window.partitionBy("spec").orderBy("at"))
    reached = bins.join(goals, F.col("spec").eqNullSafe(F.col("s"))).withColumn("upto", upto).where(F.col("upto") >= F.col("open"))
    first = reached.groupBy("s", "open").agg(F.min(F.struct("at", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("e"))
    return cut_lineage(first.select("s", F.col("e.at").alias("last_bin"), F.col("e.before").alias("before"), "open"), "mix-ends")


def _class(size: Column) -> Column:
    """Number of binary digits of a size."""
    return F.char_length(F.bin(size))


def _inclusion(sized: DataFrame, spec: DataFrame) -> DataFrame:
    """_s, rates: per spec the inclusion probability of a chunk by the class of its size, for the words that are open.

    Probabilities rise with the square root of the class's size, up to 1: with the largest classes certain, what they leave
    open is shared by the others, so that the expected words are those that are open. Which classes are certain
    follows from running sums over the classes of a spec, 65 at most.
    """
    mass = F.sqrt(F.pow(F.lit(2.0), F.col("class").cast("double")))
    words = sized.groupBy("spec", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    met = words.join(spec.where(F.col("open") > 0).select(F.col("spec").alias("_s"), "open"), F.col("spec").eqNullSafe(F.col("_s"))).withColumn("mass", mass)
    down = Window.partitionBy("_s").orderBy(F.col("class").desc())
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("mass") * F.col("words")).over(Window.partitionBy("_s").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    level = met.withColumn("level", F.try_divide(F.col("open") - larger, rest)).groupBy("_s").agg(
        F.max_by("level", F.when(F.col("level") * F.col("mass") <= 1, F.col("class"))).alias("level")
    )
    rates = F.transform(F.sequence(F.lit(0), F.lit(CLASSES)), lambda k: F.least(F.lit(1.0), F.col("level") * F.sqrt(F.pow(F.lit(2.0), k.cast("double")))))
    return level.select("_s", rates.alias("rates"))


def _odds(u: Column, rate: Column) -> Column:
    """Pareto order statistic: random odds over inclusion odds; certain chunks come first."""
    return (u / (1 - u)) * ((1 - rate) / rate)


def _bin(odds: Column, bins: int = BINS) -> Column:
    return F.floor(odds / (1 + odds) * bins).cast("int")


def mix_chunks(
    chunks: DataFrame, chunk_id: str = "chunk_id", spec: str = "spec", text: str = "text",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """How often each knowledge chunk goes into a mix in which specifications have target weights.

    The size of a chunk is its number of words. Specs by code point, null last,
    take ``weights`` in turn and share ``share`` times all sizes; a target stops at
    ``most`` times the size of its spec and the excess is reshared. Every chunk is
    taken as many whole times as the target allows for all; the rest of the target
    is a Pareto order sample: chunks ranked by random odds over inclusion odds
    enter until the words taken are nearest to the target. Inclusion probabilities rise with
    the square root of a chunk's size class (a power of two), up to 1: chunks of certain
    classes come first, and expected words are what the target leaves open.

    Returns the input's columns and size, source_size, target, taken (words) and
    copies; these five replace input columns of the same name. A null text has
    size 0. Rows alike in id and size enter together. Chunks without an id are
    taken together as well. No rows in, no rows out.

    The rank needs no sort of a spec: sums per coarse, then per fine bin of the rank
    find the bin in which the sample ends, and only that bin is ordered. What remains is
    one row per spec, which Spark broadcasts if it is small enough and joins
    otherwise.
    """
    sized = chunks.select(
        chunks[chunk_id].alias("id"), chunks[spec].alias("spec"), _words(chunks, text).alias("size"),
        _draw(chunks, chunk_id, seed).alias("u"),
    )
    plan = _plan(cut_lineage(sized, "mix-sizes"), weights, share, most)
    return _taken(chunks, plan, chunk_id, spec, text, seed)


def _taken(chunks: DataFrame, plan: DataFrame, chunk_id: str, spec: str, text: str, seed: str) -> DataFrame:
    new = ("size", "source_size", "target", "taken", "copies")
    n, u = free_name(chunks, "_size"), free_name(chunks, "_u")
    rows = chunks.withColumns({n: _words(chunks, text), u: _draw(chunks, chunk_id, seed)})
    plan = plan.select(F.struct(*plan.columns).alias(p := free_name(chunks, "_plan")))
    rows = rows.join(plan, rows[spec].eqNullSafe(F.col(f"{p}._spec")))
    odds = _odds(F.col(u), F.get(F.col(f"{p}.rates"), _class(F.col(n))))
    here = F.struct(odds.alias("odds"), rows[chunk_id].alias("id"), F.col(n).alias("size"))
    drawn = (_bin(odds) < F.col(f"{p}.last_bin")) | ((_bin(odds) == F.col(f"{p}.last_bin")) & (here <= F.col(f"{p}.last")))
    copies = F.col(f"{p}.whole").cast("long") + F.when(drawn, 1).otherwise(0)
    return rows.select(
        *[rows[c] for c in chunks.columns if c not in new], F.col(n).alias("size"), F.col(f"{p}.source_size").alias("source_size"),
        F.col(f"{p}.target").alias("target"), (F.col(n) * copies).alias("taken"), copies.alias("copies"),
    )
