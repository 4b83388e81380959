"""Shard numbers and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of non-negative bigints, exact beyond 2^53."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def hash_shard(key: Column | str, num_shards: int) -> Column:
    """Shard from the first 32 bits of the key's MD5: a row keeps its shard as data is added."""
    first = F.conv(F.substring(F.md5(_col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(first, F.lit(num_shards)).cast("int")


def block_shard(position: Column | str, num_rows: Column | int, num_shards: int) -> Column:
    """Shard of a row position when rows are cut into equal contiguous blocks.

    The first `num_rows % num_shards` blocks hold one row more.
    """
    position = _col(position).cast("bigint")
    num_rows = F.lit(num_rows).cast("bigint") if isinstance(num_rows, int) else num_rows
    small = _div(num_rows, F.lit(num_shards))
    longer = num_rows % num_shards
    cut = longer * (small + 1)
    in_long = _div(position, small + 1)
    in_short = longer + _div(position - cut, F.greatest(small, F.lit(1)))
    return F.when(position < cut, in_long).otherwise(in_short).cast("int")


def shard_name(shard: Column | str) -> Column:
    """`shard000012`; longer numbers keep all their digits."""
    return F.format_string("shard%06d", _col(shard).cast("bigint"))


def endpoint_for(shard: Column | str, endpoints: list[str]) -> Column:
    """The base URL a shard's requests go to."""
    urls = F.array(*[F.lit(url) for url in endpoints])
    return F.element_at(urls, (_col(shard) % len(endpoints) + 1).cast("int"))


def shard_of_job(name: Column | str) -> Column:
    """Shard number at the end of a `<job>-NNNNNN` name; null if there is none."""
    return F.element_at(F.split(_col(name), "-"), -1).try_cast("int")


def base_job_name(name: Column | str) -> Column:
    """The name without its `-NNNNNN` ending; null for other names."""
    base = F.regexp_extract(_col(name), r"^(.*)-\d{6,}$", 1)
    return F.when(_col(name).rlike(r"^.*-\d{6,}$"), base)


def check_shard(shard: int | None, num_shards: int | None) -> None:
    """Shard bounds; `num_shards` is needed with `shard`."""
    if shard is None:
        return
    if not num_shards:
        raise ValueError("num_shards is needed when a shard is given")
    if not 0 <= shard < num_shards:
        raise ValueError(f"shard ({shard}) must be between 0 and {num_shards - 1}")


def check_shards(shards: list[int], num_shards: int) -> list[int]:
    """A sorted shard subset, or an error naming those out of range."""
    outside = sorted(s for s in shards if not 0 <= s < num_shards)
    if outside:
        raise ValueError(f"invalid shard numbers {outside}, valid range is 0-{num_shards - 1}")
    return sorted(set(shards))
