"""Which provider, account and region a resource has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a profile map that may be broadcast; a larger one is joined by its key.
BROADCAST_PROFILES = 100_000


def _profiles(profiles: DataFrame) -> DataFrame:
    return F.broadcast(profiles) if profiles.limit(BROADCAST_PROFILES + 1).count() <= BROADCAST_PROFILES else profiles


def resolve(resources: DataFrame, providers: DataFrame, profiles: DataFrame) -> DataFrame:
    """resources (local_name, alias, ...) with the provider's region and its profile's account.

    The provider is the first with the same local name and the same alias, null or not; a profile that is not in the
    map leaves the account null.
    """
    first = providers.groupBy("local_name", "alias").agg(F.min(F.struct("ord", "profile", "region")).alias("_p"))
    p = first.select(F.col("local_name").alias("_l"), F.col("alias").alias("_a"), F.col("_p.profile").alias("profile"), F.col("_p.region").alias("region"))
    out = resources.join(p, (F.col("local_name") == F.col("_l")) & F.col("alias").eqNullSafe(F.col("_a")), "left").drop("_l", "_a")
    return out.join(_profiles(profiles), "profile", "left")


def account_names(profiles: DataFrame) -> DataFrame:
    """(account_id, account_name): of the profiles of an account the first in order names it."""
    return profiles.groupBy("account_id").agg(F.min_by("account_name", "profile").alias("account_name"))


def missing_profiles(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """The distinct profiles that the map lacks."""
    return wanted.filter("profile is not null").select("profile").distinct().join(profiles.select("profile"), "profile", "left_anti")
