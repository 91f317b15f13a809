"""Explicit resolution of references, with a status and a reason for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MALFORMED, CONFLICT, RESOLVED, UNRESOLVED = "MALFORMED", "CONFLICT", "RESOLVED", "UNRESOLVED_VALID_LINK"


def unique_index(df: DataFrame, key: str, target: str) -> DataFrame:
    """``key, target``; a key with different targets fails the job, exact repeats do not."""
    each = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("__hi"))
    return each.select(key, F.when(F.col(target) == F.col("__hi"), F.col(target)).otherwise(F.raise_error(F.lit(f"endpoint conflict: a {key} has several targets"))).alias(target))


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that aren't null; one that occurs twice fails the job."""
    each = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return each.select(F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.lit(f"a {key} occurs more than once"))).alias(key))


def resolve(links: DataFrame, token: str, current: DataFrame, cumulative: DataFrame, conflicts: DataFrame, malformed: Column | None = None, name: str = "endpoint") -> DataFrame:
    """Adds ``<name>_status`` and ``<name>_authority`` to every row of ``links``.

    The other tables have the column ``token``; they are joined in as one table of tokens and marks. Malformed goes before conflict, that before
    the current dataset, that before earlier snapshots.
    """
    marks = {"__c": conflicts, "__n": current, "__s": cumulative}
    each = [known.select(token, *[F.lit(m == mark).alias(m) for m in marks]) for mark, known in marks.items()]
    known = each[0].union(each[1]).union(each[2]).groupBy(token).agg(*[F.bool_or(m).alias(m) for m in marks])
    # rows without a token join with nothing; by a hash of the row they don't all go to one task
    plain = [c for c, t in links.dtypes if "map<" not in t and "variant" not in t]
    spread = F.coalesce(F.col(token).cast("string"), F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string")))
    out = links.withColumn("__t", spread).join(known.where(F.col(token).isNotNull()).withColumn("__t", F.col(token).cast("string")).drop(token), "__t", "left").drop("__t")
    bad = malformed if malformed is not None else F.lit(False)
    bad = bad | F.col(token).isNull()
    status = F.when(bad, MALFORMED).when(F.col("__c"), CONFLICT).when(F.col("__n") | F.col("__s"), RESOLVED).otherwise(UNRESOLVED)
    authority = F.when(bad | F.col("__c"), "none").when(F.col("__n"), "current").when(F.col("__s"), "snapshot").otherwise("none")
    return out.withColumn(f"{name}_status", status).withColumn(f"{name}_authority", F.coalesce(authority, F.lit("none"))).drop("__c", "__n", "__s")


def require_sound(resolved: DataFrame, name: str) -> DataFrame:
    """The same rows; a malformed or conflicting endpoint fails the job, unresolved ones are only left out."""
    status = F.col(f"{name}_status")
    return resolved.withColumn(f"{name}_status", F.when(status.isin(MALFORMED, CONFLICT), F.raise_error(F.concat(F.lit(f"{name} has a reference that is "), status))).otherwise(status))


def promoted(resolved: DataFrame, names: list[str]) -> DataFrame:
    """Links of which every endpoint is resolved."""
    out = resolved
    for n in names:
        out = out.where(F.col(f"{n}_status") == RESOLVED)
    return out


def unresolved_reasons(resolved: DataFrame, names: list[str]) -> DataFrame:
    """A row for each endpoint that is not resolved: the link's columns and ``reason``."""
    reasons = F.array(*[F.when(F.col(f"{n}_status") != RESOLVED, F.concat(F.lit(f"{n}_"), F.lower(f"{n}_status"))) for n in names])
    return resolved.withColumn("reason", F.explode(F.filter(reasons, lambda r: r.isNotNull())))


def optional_link(left: DataFrame, key: str, targets: DataFrame, independent: Column) -> DataFrame:
    """Left join with ``link_status``: independent rows keep a null target, others are linked or unresolved."""
    known = targets.select(F.col(key)).distinct().withColumn("__known", F.lit(True))
    return left.join(known, key, "left").withColumn("link_status", F.when(independent, "independent").when(F.col("__known"), "linked").otherwise("unresolved")).drop("__known")


def primary_reason(reasons: DataFrame, reason: str = "reason") -> DataFrame:
    """The most frequent reason with its count; the first in lexical order of equally frequent ones."""
    return reasons.groupBy(reason).agg(F.count("*").cast("long").alias("reason_count")).orderBy(F.desc("reason_count"), reason).limit(1)
