"""Valid-time and belief-time predicates. Windows are half-open, an absent end is unbounded."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def instant(at: str | datetime) -> Column:
    """A fixed instant without zone, read as UTC."""
    return F.lit(str(at)).cast("timestamp_ntz")


def valid_at(at: str | datetime, begin: str = "valid_from", end: str = "valid_until") -> Column:
    """Whether [begin, end) holds the instant; a window of no length holds none."""
    return (F.col(begin).isNull() | (F.col(begin) <= instant(at))) & (F.col(end).isNull() | (F.col(end) > instant(at)))


def believed(at: str | datetime | None = None, ingested: str = "ingested_at", invalidated: str = "invalidated_at") -> Column:
    """Whether a fact is believed now (never invalidated), or was at an instant."""
    if at is None:
        return F.col(invalidated).isNull()
    return (F.col(ingested) <= instant(at)) & (F.col(invalidated).isNull() | (F.col(invalidated) > instant(at)))


def only(**wanted: object) -> Column:
    """Equality on the given columns; None leaves a column free."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def lifecycle(at: str | datetime) -> Column:
    """invalidated before not-yet-valid before ended before current."""
    return (
        F.when(F.col("invalidated_at").isNotNull(), "invalidated")
        .when(F.col("valid_from") > instant(at), "not_yet_valid")
        .when(F.col("valid_until") <= instant(at), "ended")
        .otherwise("current")
    )


def label(subject: str = "subject", predicate: str = "predicate", object_: str = "object", text: str = "fact_label") -> Column:
    """The fact's own label, else 'subject predicate object' with underscores as blanks."""
    return F.coalesce(F.nullif(F.trim(F.col(text)), F.lit("")), F.concat_ws(" ", F.col(subject), F.translate(F.col(predicate), "_", " "), F.col(object_)))


def overlaps(facts: DataFrame, keys: list[str], fact_id: str) -> DataFrame:
    """Pairs of believed, uncontradicted facts of one key whose windows overlap; should be empty.

    Facts are ordered by begin within their key and each is compared with the
    furthest end before it, so a key of any size needs one sorted window pass and
    no self-join. An overlapped fact is reported once, with the fact whose window
    reaches furthest.
    """
    from pyspark.sql import Window

    first, last = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    live = facts.where(F.col("invalidated_at").isNull() & F.col("contradiction_group").isNull()).select(
        *keys, fact_id, F.coalesce(F.col("valid_from").cast("timestamp_ntz"), first).alias("b"), F.coalesce(F.col("valid_until").cast("timestamp_ntz"), last).alias("e")
    )
    before = Window.partitionBy(*keys).orderBy("b", "e", fact_id).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct("e", fact_id)).over(before)
    return live.where("b < e").withColumn("reach", reach).where("reach.e > b").select(*keys, fact_id, F.col(f"reach.{fact_id}").alias("other_id"))
