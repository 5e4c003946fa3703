"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


#: Bytes, by the plan's statistics, of a table that may be broadcast.
SMALL_BYTES = 10 << 20


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """The table, marked for broadcast if its plan's statistics say that it is small; no job runs. Else Spark
    chooses, at run time too."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def keyed(df: DataFrame, *names: str) -> list[str]:
    """The names, after that of the video where the table has several videos."""
    return [*(["video"] if "video" in df.columns else []), *names]


def has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN compares as the largest number in Spark; as null it is skipped instead."""
    own = [n for n, t in df.dtypes if t in ("double", "float") and (not names or n in names)]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in own})


def trunc_int(c: Column) -> Column:
    return c.cast("int")


def half_even(c: Column) -> Column:
    """Rounds half to even, to an integer."""
    return F.rint(c).cast("int")


def bucket(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin of v among n equal ones; the last is closed, a range of no width is widened by a half
    on either side."""
    flat = lo == hi
    a, b = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    return F.least(F.floor((v - a) / (b - a) * n).cast("int"), F.lit(n - 1))


def linspace_index(i: Column, n: Column, k: Column) -> Column:
    """i-th of k positions spread over 0 to n-1, truncated."""
    return F.when(k > 1, (i * (n - 1) / (k - 1)).cast("int")).otherwise(0)


def unwrapped_step(d: Column, half: float) -> Column:
    """What to add to a step so that it is no longer than half a turn."""
    m = F.pmod(d + half, F.lit(2 * half)) - half
    m = F.when((m == -half) & (d > 0), F.lit(half)).otherwise(m)
    return F.when(F.abs(d) < half, 0.0).otherwise(m - d)


def hex_rgb(c: Column) -> Column:
    """Struct r, g, b of '#rrggbb'."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def text_colour(c: Column) -> Column:
    """Black on light colours, white on dark ones, by luma."""
    rgb = hex_rgb(c)
    luma = 0.299 * rgb["r"] + 0.587 * rgb["g"] + 0.114 * rgb["b"]
    return F.when(luma > 140, "#000000").otherwise("#ffffff")


def human_size(n: Column) -> Column:
    """Bytes in units of 1024."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / float(1024**k))).otherwise(out)
    return out


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.rint(seconds).cast("long")
    h, m, r = (s / 3600).cast("long"), (s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def palette_index(df: DataFrame, name: str, colours: int) -> DataFrame:
    """A colour's number for each distinct name, in order of names; there are few."""
    names = df.select(name).distinct()
    rank = F.size(F.filter("_all", lambda x: x < F.col(name)))
    every = names.agg(F.collect_set(name).alias("_all"))
    return names.crossJoin(F.broadcast(every)).select(name, (rank % colours).alias("colour"))
