"""Train / valid / test membership by contract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.operators.running import running_totals
from seatwise.operators.skew import broadcast_if_small, skew_join

# Memberships up to this many contracts are broadcast.
MAX_BROADCAST_CONTRACTS = 200_000


def group_hash(contract_id: Column, seed: str) -> Column:
    """Seeded order of the contracts, the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), contract_id))


def group_split_exact(rows: DataFrame, sizes: Mapping[str, int], seed: str) -> DataFrame:
    """``(contract_id, split)``: a sample of distinct contracts without replacement, of exact sizes.

    Contracts are ranked by their hash. The rank is exact for any number of contracts: hash prefixes are
    even buckets, so no task sorts more than a small part.
    """
    contracts = rows.select("contract_id").distinct()
    hashed = contracts.withColumn("_hash", group_hash(F.col("contract_id"), seed)).withColumns(
        {"_bucket": F.substring("_hash", 1, 3), "_one": F.lit(1).cast("bigint")}
    )
    ranked = running_totals(hashed, F.struct("_hash", "contract_id"), {"_rank": "_one"}, ascending=True)
    split, upper = F.lit(None).cast("string"), sum(sizes.values())
    for name, size in reversed(sizes.items()):
        split = F.when(F.col("_rank") <= upper, F.lit(name)).otherwise(split)
        upper -= size
    return ranked.select("contract_id", split.alias("split")).filter(F.col("split").isNotNull())


def split_of(contract_id: Column, shares: Mapping[str, float], seed: str) -> Column:
    """Split of a contract from its hash alone: no sort, no join; NULL past the given shares."""
    # The first 8 hex digits as a number in [0, 1).
    point = F.conv(F.substring(group_hash(contract_id, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    split, upper = F.lit(None).cast("string"), sum(shares.values())
    for name, share in reversed(shares.items()):
        split = F.when(point < upper, F.lit(name)).otherwise(split)
        upper -= share
    return split


def group_split_fraction(rows: DataFrame, shares: Mapping[str, float], seed: str) -> DataFrame:
    """``(contract_id, split)`` of all contracts by hash threshold."""
    split = split_of(F.col("contract_id"), shares, seed).alias("split")
    return rows.select("contract_id").distinct().select("contract_id", split)


def semi_join_split(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows of the listed contracts. Lists that have been counted to be short are broadcast; otherwise hot contracts
    are split."""
    ids = membership.select("contract_id").distinct()
    small = broadcast_if_small(ids, MAX_BROADCAST_CONTRACTS)
    if small is not ids:
        return rows.join(small, "contract_id", "left_semi")
    spread = [c for c in rows.columns if c != "contract_id"]
    return skew_join(rows, ids, ["contract_id"], spread, "left_semi")


def apply_split(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows of the listed contracts with their ``split``."""
    small = broadcast_if_small(membership, MAX_BROADCAST_CONTRACTS)
    if small is not membership:
        return rows.join(small, "contract_id")
    spread = [c for c in rows.columns if c != "contract_id"]
    return skew_join(rows, membership, ["contract_id"], spread)
