"""Column helpers shared by the operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.plans.sizing import small_side

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \t-\r]+"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def modest_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Let Spark hand Arrow batches of at most about ``size`` bytes to Python, so long texts do not add up."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > size:
        spark.conf.set(BATCH_BYTES, str(size))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` loops over it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def body(text: str | Column) -> Column:
    """The text, empty for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit(""))


def ascii_lower(value: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast built-in."""
    slow = F.translate(value, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(value) == F.octet_length(value), F.lower(value)).otherwise(slow)


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space, in order."""
    return let(
        F.btrim(text, F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)),
    )


def hash128(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: unlike one, they stay free of chance collisions at 10**12 values."""
    return F.xxhash64(value), F.xxhash64(F.lit("second"), value)


def boxed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that no working column can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unboxed(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The boxed columns again; ``added`` ones replace or follow them."""
    # Added columns are settled first, where no boxed column can be taken for a working one.
    df = df.select("row", F.struct(*[v.alias(k) for k, v in added.items()]).alias("added"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in columns if c not in added]
    return df.select(*kept, *[F.col(f"added.{k}").alias(k) for k in added])


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join; ``table`` is broadcast only after its rows were counted."""
    table = table.select(*[F.col(k).alias(f"{k}__") for k in keys], *[c for c in table.columns if c not in keys])
    table = small_side(table, max_rows=50_000)
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(table, on, how).drop(*[f"{k}__" for k in keys])
