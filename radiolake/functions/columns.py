"""Small column expressions shared by the operators (all stay inside codegen)."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("Critical", "High", "Medium", "Low")


def rnd(col: Column | str, digits: int) -> Column:
    """Round half to even after scaling, the convention of array libraries."""
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10**digits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)


def no_nan(col: Column | str) -> Column:
    """NaN becomes null: Spark orders NaN above every number, so it must not survive ingest."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den.cast("double"), F.lit(0.0))


def severity_rank(col: Column | str = "severity") -> Column:
    """Critical 4, High 3, Medium 2, Low 1, anything else 0."""
    c = F.col(col) if isinstance(col, str) else col
    return (
        F.when(c == "Critical", 4).when(c == "High", 3).when(c == "Medium", 2).when(c == "Low", 1).otherwise(0)
    )


def severity_name(rank: Column) -> Column:
    return F.when(rank == 4, "Critical").when(rank == 3, "High").when(rank == 2, "Medium").when(rank == 1, "Low")


def limit_severity(value: Column, warning: Column, critical: Column, worse_high: Column) -> Column:
    """Critical / High / null for a value against its limits; null limits never fire."""
    crit = F.when(worse_high, value >= critical).otherwise(value <= critical)
    warn = F.when(worse_high, value >= warning).otherwise(value <= warning)
    return F.when(warning.isNull() | critical.isNull(), None).when(crit, "Critical").when(warn, "High")


def contains_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def row_of(df: DataFrame) -> Column:
    """The single row of a global aggregate as a struct column (scalar subquery, no join)."""
    return df.select(F.struct("*").alias("row")).scalar()


def hours(ts: Column | str) -> Column:
    """Hours since 2020 as double; slopes do not depend on the origin and a near one keeps digits."""
    return (seconds(ts) - 1_577_836_800.0) / 3600.0


def seconds(ts: Column | str) -> Column:
    """Epoch seconds as double with microsecond resolution."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c) / F.lit(1e6)


def text_or(col: Column | str, fallback: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(fallback))


@lru_cache(maxsize=16)
def fixed_table(spark: SparkSession, rows: tuple[tuple, ...], schema: str) -> DataFrame:
    """A catalogue of fixed values as a DataFrame: literals in the plan, no job and no Python rows."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"cast({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS fixed({', '.join(n for n, _ in fields)})")
