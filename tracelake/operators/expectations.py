"""Quality gates that stop a pipeline before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A gate failed."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise Violation(message)


def violations(gates: dict[str, DataFrame]) -> DataFrame:
    """gate, violations: the rows that each gate's DataFrame finds (none: the gate holds)."""
    out = None
    for name, bad in gates.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def enforce(gates: dict[str, DataFrame]) -> None:
    """Run all gates in one job; raise with the names of those that fail."""
    failed = [(r.gate, r.violations) for r in violations(gates).where("violations > 0").collect()]  # one row per gate
    require(not failed, f"gates failed: {failed}")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def missing(df: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a parent row."""
    return df.join(parent.select(*on).distinct(), on, "left_anti")


def already_there(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    return df.join(table.select(*on).distinct(), on, "left_semi")


def count_mismatch(parent: DataFrame, children: DataFrame, on: list[str], declared: str) -> DataFrame:
    """Parents whose declared count isn't the number of their distinct children."""
    n = children.distinct().groupBy(*on).agg(F.count("*").alias("_n"))
    return parent.join(n, on, "left").where(~F.coalesce("_n", F.lit(0)).eqNullSafe(F.col(declared)))


def sum_mismatch(parent: DataFrame, children: DataFrame, on: list[str], declared: str, amount: str) -> DataFrame:
    n = children.groupBy(*on).agg(F.sum(amount).alias("_n"))
    return parent.join(n, on, "left").where(~F.coalesce("_n", F.lit(0)).eqNullSafe(F.col(declared)))


def several_values(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Groups that hold more than one value (as more than one split in a shard)."""
    return df.groupBy(*by).agg(F.countDistinct(column).alias("n")).where("n > 1")


def failing(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition doesn't hold (null counts as failing)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def digest_changed(copied: DataFrame, source: DataFrame, on: list[str], digest: str = "sha256") -> DataFrame:
    """Rows of a copy (files, shards) whose digest isn't that of the source, or that the source doesn't have."""
    return copied.join(source.select(*on, F.col(digest).alias("_own"), F.lit(True).alias("_there")), on, "left").where(F.col("_there").isNull() | ~F.col(digest).eqNullSafe(F.col("_own"))).drop("_own", "_there")


def frames_changed(decoded: DataFrame, rows: DataFrame, episode: list[str], frame: str, digest: str = "frame_sha256") -> DataFrame:
    """Episodes whose decoded frames aren't as many as were written, or whose first or last frame has another digest: key, decoded, written, ends_differ."""
    at = lambda t, n: t.groupBy(*episode).agg(F.count("*").alias(n), F.struct(F.min_by(digest, frame), F.max_by(digest, frame)).alias(f"_{n}"))
    both = at(rows, "written").join(at(decoded, "decoded"), episode, "full")
    out = both.select(*episode, F.coalesce("decoded", F.lit(0)).alias("decoded"), F.coalesce("written", F.lit(0)).alias("written"), (~F.col("_written").eqNullSafe(F.col("_decoded"))).alias("ends_differ"))
    return out.where("decoded <> written OR ends_differ")


def offsets_broken(table: DataFrame, offsets: str, frames: Column, values: Column) -> DataFrame:
    """Rows whose offsets (an array) aren't one more than the frames, don't begin at 0, fall, or don't end at the number of values."""
    o = F.col(offsets)
    rising = F.forall(F.zip_with(F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(0))), F.slice(o, 2, F.greatest(F.size(o) - 1, F.lit(0))), lambda a, b: a <= b), lambda x: x)
    return failing(table, (F.size(o) == frames + 1) & (F.try_element_at(o, F.lit(1)) == 0) & rising & (F.try_element_at(o, F.lit(-1)) == values))


def not_won(tasks: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Candidates whose outcome is given and is not a win."""
    return tasks.where((F.coalesce(F.col(outcome), F.lit("")) != "") & (F.col(outcome) != "win"))


def labels_agree(mismatches: DataFrame) -> None:
    """Stop an export whose labels disagree with what stands in the frames (``segments.label_mismatches``)."""
    r = mismatches.collect()[0]  # one row
    require(r.mismatches == 0, f"labels disagree on {r.mismatches} of {r.checked} points")
