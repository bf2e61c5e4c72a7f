"""Bloom filter of domains as a table of set bits: sized from the number of domains, double hashing from SHA-256."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALSE_POSITIVES = 0.01


def parameters(n: int, rate: float = FALSE_POSITIVES) -> tuple[int, int]:
    """(bits, hashes)."""
    if n <= 0:
        return 8, 1
    m = max(8, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return m, max(1, round(m / n * math.log(2)))


def positions(domain: Column, m: int, k: int) -> Column:
    """Bit positions: (h1 + i * h2) mod m over the first two signed 64-bit halves of the digest."""
    digest = F.sha2(F.lower(domain), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("decimal(38,0)")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(half(1) + i.cast("decimal(10,0)") * half(17), F.lit(m).cast("decimal(38,0)")).cast("long"))


def build(domains: DataFrame, m: int, k: int) -> DataFrame:
    """bit: the distinct set bits of ``domains`` (domain)."""
    return domains.select(F.explode(positions(F.col("domain"), m, k)).alias("bit")).distinct()


def probe(asked: DataFrame, bits: DataFrame, m: int, k: int) -> DataFrame:
    """domain, maybe: whether all k bits are set."""
    each = asked.select("domain").distinct().select("domain", F.explode(F.array_distinct(positions(F.col("domain"), m, k))).alias("bit"))
    hit = each.join(bits.withColumn("set", F.lit(1)), "bit", "left")
    return hit.groupBy("domain").agg((F.count("*") == F.count("set")).alias("maybe"))


def known_to(reputation: dict, domain: Column) -> Column:
    """Whether ``domain`` is on the allow list of a reputation (m, k, bits, allow), or all its bits are set in the filter."""
    data = F.lit(bytearray(reputation["bits"]))

    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, (p % 8).cast("int")) == 1

    maybe = F.forall(positions(domain, reputation["m"], reputation["k"]), is_set)
    listed = F.lower(domain).isin(reputation["allow"]) if reputation["allow"] else F.lit(False)
    return listed | maybe
