"""Ordered computations that never put a whole series into one task.

``Window.partitionBy(cell)`` sends all rows of a cell to one task; with one cell
holding a third of the data that task never ends.  Everything here splits a
series into *slices* of a bounded number of rows.  Rows are shuffled by (keys, slice); a slice is
reduced to one summary row (count, total, last row ...); the summaries of a key,
one per slice, are combined by a window; and the result is joined back on
(keys, slice).  Counts, sums, extremes, last values and neighbours all compose
this way, so the answers are exact.

Frames of k rows use the exact row number from the same scheme: rows are grouped
in blocks of equal length and the last k rows of a block are copied to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.session import cut_lineage

SLICE = "_slice"
KEY = "_key"  # the key columns as one struct: equal where both sides are null, so rows without a key stay
BLOCK = 65_536  # rows


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))


def _order(order: Sequence[str]) -> Column:
    return F.struct(*order)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _after(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)


def _all(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt and sorted by ranges of (keys, order), with ``_at``: the range in the upper bits, the place in it below. Written."""
    at = [F.col(KEY).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    rows = _keyed(df, keys).repartitionByRange(*at).sortWithinPartitions(*at)
    return _keyed(cut_lineage(rows.drop(KEY).withColumn("_at", F.monotonically_increasing_id()), "dealt"), keys)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK) -> DataFrame:
    """Add the slice number: rising along every series, and at most ``rows`` rows (a power of two) of a key in a slice.

    Spark's ranges follow the number of rows, so neither a hot key nor a burst makes a large slice, and neither do rows without
    a key or a time (nulls come first, in the order of what follows).
    The table is written to the shared folder, so every later use agrees on the slices.
    """
    if rows & (rows - 1):
        raise ValueError("rows of a slice must be a power of two")
    return _dealt(df, keys, order).select(*df.columns, F.shiftright("_at", rows.bit_length() - 1).alias(SLICE))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], rn: str = "rn", total: str = "n") -> DataFrame:
    """Exact 1-based row number and row count per key, with the slices of ``sliced``.

    The place in a range is known when the rows are dealt; what is left is a prefix sum over ranges, one row
    per (key, range), so no window sees the rows.
    """
    rows = _dealt(df, keys, order).withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy(KEY, "_range").agg(F.expr("count(1) AS _size"), F.expr("min(_at) AS _first"))
    base = sizes.selectExpr(
        KEY, "_range", f"coalesce(sum(_size) OVER (PARTITION BY {KEY} ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - _first + 1 AS _base",
        f"sum(_size) OVER (PARTITION BY {KEY}) AS `{total}`",
    )
    return rows.join(base, [KEY, "_range"]).select(*df.columns, F.shiftright("_at", BLOCK.bit_length() - 1).alias(SLICE), total, F.expr(f"_base + _at AS `{rn}`"))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], rn: str = "rn", total: str = "n") -> DataFrame:
    """Exact 1-based row number and row count per key over a sliced frame."""
    columns, df, keys = df.columns, _keyed(df, keys), [KEY]
    at = [KEY, SLICE]
    sizes = df.groupBy(*at).agg(F.count(F.lit(1)).alias("_size"))
    base = sizes.select(
        *at,
        F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0)).alias("_base"),
        F.sum("_size").over(_all(keys)).alias(total),
    )
    return (
        df.join(base, at)
        .withColumn(rn, F.col("_base") + F.row_number().over(_inside(keys, order)))
        .select(*columns, total, rn)
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    prev: Mapping[str, str] | None = None,
    nxt: Mapping[str, str] | None = None,
    number: bool = False,
) -> DataFrame:
    """Value of a column in the row before / after, across slice edges.

    ``prev`` and ``nxt`` map new column -> source column; ``number`` adds the
    row number ``rn`` and count ``n`` of the series in the same pass.
    """
    prev, nxt = dict(prev or {}), dict(nxt or {})
    columns, df, keys = df.columns, _keyed(df, keys), [KEY]
    at = [KEY, SLICE]
    aggs, cols = [], list(at)
    if number:
        aggs.append(F.count(F.lit(1)).alias("_size"))
        cols += [F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0)).alias("_base"), F.sum("_size").over(_all(keys)).alias("n")]
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    if prev:
        # when only the leading order column is wanted its maximum is enough, which stays in hash aggregation
        plain = set(prev.values()) == {order[0]}
        edge = lambda c: F.struct(*[c(F.col(s)).alias(n) for n, s in prev.items()])
        last = edge(F.max) if plain else F.max_by(edge(lambda c: c), _order(order))
        aggs.append(last.alias("_last"))
        cols.append(F.lag("_last").over(by_slice).alias("_carry_prev"))
    if nxt:
        aggs.append(F.min_by(F.struct(*[F.col(s).alias(n) for n, s in nxt.items()]), _order(order)).alias("_first"))
        cols.append(F.lead("_first").over(by_slice).alias("_carry_next"))
    edges = df.groupBy(*at).agg(*aggs).select(*cols)
    w = _inside(keys, order)
    out = df.join(edges, at)
    if prev:
        row = F.struct(*[F.col(s).alias(n) for n, s in prev.items()])
        out = out.withColumn("_p", F.coalesce(F.lag(row).over(w), F.col("_carry_prev")))
    if nxt:
        row = F.struct(*[F.col(s).alias(n) for n, s in nxt.items()])
        out = out.withColumn("_q", F.coalesce(F.lead(row).over(w), F.col("_carry_next")))
    out = out.select(
        *columns,
        *[F.col(f"_p.{n}").alias(n) for n in prev],
        *[F.col(f"_q.{n}").alias(n) for n in nxt],
        *([(F.col("_base") + F.row_number().over(w)).alias("rn"), "n"] if number else []),
    )
    return out


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    spec: Mapping[str, tuple[str, Column]],
    peers: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Running ``sum`` / ``min`` / ``max`` / ``last`` (last non-null) from the series start to each row.

    ``peers=True`` includes rows that tie on the order column; ``reverse=True``
    runs from the series end backwards.
    """
    columns, df, keys = df.columns, _keyed(df, keys), [KEY]
    at = [KEY, SLICE]
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    cols = {name: f"_x_{name}" for name in spec}
    work = df.select("*", *[c.alias(cols[name]) for name, (_, c) in spec.items()])
    aggs = []
    for name, (how, _) in spec.items():
        x = F.col(cols[name])
        if how == "last":
            pick = F.min_by if reverse else F.max_by
            aggs.append(pick(x, F.when(x.isNotNull(), _order(order))).alias(f"_s_{name}"))
        else:
            aggs.append(fold[how](x).alias(f"_s_{name}"))
    outside = (_after if reverse else _before)(keys)
    carried = []
    for name, (how, _) in spec.items():
        s = F.col(f"_s_{name}")
        if how == "last":
            pick = F.first(s, ignorenulls=True) if reverse else F.last(s, ignorenulls=True)
            carried.append(pick.over(outside).alias(f"_c_{name}"))
        else:
            carried.append(fold[how](s).over(outside).alias(f"_c_{name}"))
    carry = work.groupBy(*at).agg(*aggs).select(*at, *carried)
    w = _inside(keys, [F.col(o).desc() for o in order] if reverse else order)
    w = w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for name, (how, _) in spec.items():
        x, c = F.col(cols[name]), F.col(f"_c_{name}")
        if how == "last":
            out.append(F.coalesce(F.last(x, ignorenulls=True).over(w), c).alias(name))
        elif how == "sum":
            out.append((F.coalesce(F.sum(x).over(w), F.lit(0.0)) + F.coalesce(c, F.lit(0.0))).alias(name))
        elif how == "min":
            out.append(F.least(F.min(x).over(w), c).alias(name))
        else:
            out.append(F.greatest(F.max(x).over(w), c).alias(name))
    return work.join(carry, at).select(*columns, *out)


def series_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(KEY, slice) rows carrying count, mean and population deviation of the whole series; KEY is the struct of the keys.

    Slice moments are merged by the parallel-variance rule; joining on
    (KEY, slice) keeps a hot key spread over its slices and rows without a key in the table.
    """
    at = [KEY, SLICE]
    per = _keyed(df, keys).groupBy(*at).agg(
        F.count(value).alias("_k"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")
    )
    w = _all([KEY])
    mu = F.sum(F.col("_k") * F.col("_m")).over(w) / F.nullif(F.sum("_k").over(w), F.lit(0))
    per = per.select(*at, "_k", "_m", "_v", F.sum("_k").over(w).alias("_n"), mu.alias("_mu"))
    dev = F.col("_k") * (F.col("_v") + F.pow(F.col("_m") - F.col("_mu"), F.lit(2.0)))
    return per.select(*at, "_n", "_mu", F.sqrt(F.sum(dev).over(w) / F.nullif(F.col("_n"), F.lit(0))).alias("_sigma"))


def with_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of a sliced frame with ``_mu`` and ``_sigma`` of their series."""
    return _keyed(df, keys).join(series_moments(df, keys, value), [KEY, SLICE]).select(*df.columns, "_mu", "_sigma")


def blocked(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int = 0,
    rn: str = "rn",
    block: int = BLOCK,
) -> tuple[DataFrame, Window, Column]:
    """Split a numbered series into equal blocks with ``before`` / ``after`` halo rows.

    Returns the frame, the window to use (ordered by row number inside a block)
    and the condition that keeps only a block's own rows.
    """
    if max(before, after) > block:
        raise ValueError("frame longer than a block")
    own = F.floor((F.col(rn) - 1) / F.lit(block))
    pos = F.pmod(F.col(rn) - 1, F.lit(block))
    homes = F.filter(
        F.array(
            own,
            F.when(pos >= block - before, own + 1) if before else F.lit(None).cast("bigint"),
            F.when((pos < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
        ),
        lambda b: b.isNotNull(),
    )
    out = df.withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*keys, "_block").orderBy(rn)
    return out, w, F.col("_block") == own


# ---------------------------------------------------------------- percentiles by radix selection

DIGIT, NEXT = 22, 21  # bits of the leading digit, and of the two that follow
_FLIP = str((1 << 63) - 1)
_TO_BITS = "cast(reflect('java.lang.Double', 'doubleToLongBits', cast({0} as double) + 0.0D) as bigint)"


def order_bits(value: str) -> Column:
    """A double column as a long of the same order (the two zeros are one); NaN is above all numbers."""
    bits = _TO_BITS.format(value)
    return F.expr(f"if({bits} < 0, {bits} ^ {_FLIP}, {bits})")


def of_order_bits(bits: str) -> Column:
    """The double that ``order_bits`` was made of."""
    return F.expr(f"cast(reflect('java.lang.Double', 'longBitsToDouble', if({bits} < 0, {bits} ^ {_FLIP}, {bits})) as double)")


def _narrowed(counts: DataFrame, group: str) -> DataFrame:
    """The digits that hold a wanted rank, each with its targets (which one, rank within the digit).

    The window orders digits, at most 2**DIGIT a group, never values.
    """
    w = f"(PARTITION BY {group} ORDER BY _next ROWS UNBOUNDED PRECEDING)"
    placed = counts.selectExpr("*", f"sum(_c) OVER {w} AS _to")
    inside = "transform(filter(_targets, t -> t.rank >= _to - _c AND t.rank < _to), t -> struct(t.i AS i, t.rank - (_to - _c) AS rank))"
    return placed.selectExpr(KEY, "_next AS _prefix", "n", f"{inside} AS _targets").where("size(_targets) > 0")


def percentiles_of_digits(counts: DataFrame, values_in: Callable[[DataFrame], DataFrame], keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Percentiles from first-digit counts; see ``exact_percentiles``.

    ``counts`` is (KEY, _next, _c), how many values of a key have that leading digit. ``values_in`` is given (KEY,
    _prefix), the wanted digits, and returns (KEY, _prefix, _bits, _c), the values there with their counts.
    """
    sized = counts.selectExpr("*", f"sum(_c) OVER (PARTITION BY {KEY}) AS n")
    ends = [f"{end}({float(p)!r}D * (n - 1))" for p in probs for end in ("floor", "ceil")]
    targets = ", ".join(f"struct({i} AS i, cast({e} AS bigint) AS rank)" for i, e in enumerate(ends))
    wanted = _narrowed(sized.selectExpr("*", f"array({targets}) AS _targets"), KEY)
    values = values_in(wanted.select(KEY, "_prefix")).groupBy(KEY, "_prefix", "_bits").agg(F.expr("sum(_c) AS _c"))
    for shift in (NEXT, 0):
        met = values.selectExpr("*", f"shiftright(_bits, {shift + NEXT}) AS _up").join(wanted.withColumnRenamed("_prefix", "_up"), [KEY, "_up"])
        digits = met.selectExpr(KEY, "_up", f"shiftright(_bits, {shift}) AS _next", "_c", "n", "_targets").groupBy(KEY, "_up", "_next")
        wanted = _narrowed(digits.agg(F.expr("sum(_c) AS _c"), F.expr("first(n) AS n"), F.expr("first(_targets) AS _targets")), f"{KEY}, _up")
    found = wanted.select(KEY, "n", of_order_bits("_prefix").alias("_v"), F.expr("explode(_targets) AS t"))
    picked = found.groupBy(KEY, "n").agg(*[F.expr(f"max(if(t.i = {i}, _v, null)) AS _e{i}") for i in range(len(ends))])
    between = [f"_e{2 * i} + (_e{2 * i + 1} - _e{2 * i}) * ({float(p)!r}D * (n - 1) - {ends[2 * i]}) AS p{i}" for i, p in enumerate(probs)]
    return picked.selectExpr(*[f"{KEY}.`{k}` AS `{k}`" for k in keys], "n", *between)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated percentiles, any number of them in one go, without ordering or gathering a group.

    Radix selection: a double is seen as a long of the same order. Its leading 22 bits are counted
    per key, which finds the digit that holds each wanted rank; a second pass keeps the values with such a digit,
    equal ones counted together; two more digits of those values leave one value for each rank.
    Counts are combined on the map side, so nothing grows with a hot key. Output: keys, ``n`` and one column ``p0, p1 ...`` per prob;
    nulls do not count, and a key without values has no row.
    """
    rows = _keyed(df, keys).where(f"`{value}` IS NOT NULL").select(KEY, order_bits(f"`{value}`").alias("_bits"))
    rows = rows.selectExpr(KEY, f"shiftright(_bits, {64 - DIGIT}) AS _next", "_bits")
    counts = rows.groupBy(KEY, "_next").agg(F.expr("count(1) AS _c"))

    def values_in(wanted: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("_next", "_prefix").join(wanted, [KEY, "_prefix"]).selectExpr(KEY, "_prefix", "_bits", "1L AS _c")

    return percentiles_of_digits(counts, values_in, keys, probs)
