"""Operator 6: URL rules by a Bloom filter cascade. DataFrame functions only.

A rule is a host and a path prefix. The keys of a url are its host and each parent domain, joined with each
prefix of its path that is as long as some rule's path; a rule fits exactly when it is one of these keys.
Whether a key is listed is answered by a cascade of Bloom filters, built over the distinct keys of the whole
corpus: level 0 holds the listed keys, each odd level the unlisted keys that the level before lets through
by mistake, each even level the listed keys that the level before lets through. The first level without the
key decides; the last level lets nothing through by mistake, so the answer is exact for every key of the
corpus without a join. Level 0 is sized by how many keys the corpus has for each listed one, so that about as many
unlisted keys pass it as are listed: the whole cascade grows with the list (which the caller holds) and with
the logarithm of the corpus. The filters are literals of the plan.

Of several rules that fit, the one with the longest host and path together wins; of equally long ones, that of
the longer host.

Defined results: a null url and one without ``://`` have an empty host and path and fit no rule; urls that
fit no rule get ``default`` (their keys are not listed); repeated rows each give a row; other columns
are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import staged, table

#: The rules of the registered query: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Bytes of a bitmap that are put together as one row.
CHUNK = 4_096
SEPARATOR = "\n"  # stands in no host


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def parent_domains(host: Column) -> Column:
    """The host and all its parents, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def url_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys of a url: hosts longest first, then paths longest first."""
    lengths = sorted(set(path_lengths), reverse=True)
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.flatten(F.transform(parent_domains(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit(SEPARATOR), p))))


class Bloom:
    def __init__(self, bits: int, hashes: int, level: int, bitmap: bytes = b""):
        self.bits, self.hashes, self.level, self.bitmap = bits, hashes, level, bitmap

    def places(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(self.level * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)])

    def fill(self, keys: DataFrame) -> Bloom:
        """Set the keys' bits: words of 64 bits, then chunks of the bitmap, are put together where they lie."""
        at = keys.select(F.explode(self.places(F.col("key"))).alias("p"))
        words = at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
        per = CHUNK // 8
        entry = F.struct((F.col("word") % per).cast("int"), "bits")
        chunks = words.groupBy(F.floor(F.col("word") / per).alias("chunk")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # at most ``per`` words each
        hexed = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))), 16, "0"))
        made = bytearray(-(-self.bits // (8 * CHUNK)) * CHUNK)
        for r in chunks.select("chunk", F.unhex(F.array_join(hexed, "")).alias("raw")).collect():  # the bitmap itself
            made[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r["raw"]
        return Bloom(self.bits, self.hashes, self.level, bytes(made[: -(-self.bits // 64) * 8]))

    def holds(self, key: Column) -> Column:
        data = F.lit(bytearray(self.bitmap))

        def bit(i):
            p = F.pmod(F.xxhash64(key, F.lit(self.level * 64 + i)), F.lit(self.bits))
            at = F.floor(p / 64) * 8 + 8 - F.floor(p % 64 / 8)  # words have their highest byte first
            byte = F.conv(F.hex(F.substring(data, at.cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte.cast("long"), (p % 8).cast("int")) == 1

        return reduce(lambda a, b: a & b, [bit(i) for i in range(self.hashes)])


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def listed(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)  # in the last level: it lets no wrong key through
        for level in reversed(self.levels):
            out = F.when(level.holds(key), out).otherwise(F.lit(level.level % 2 == 1))
        return out

    @property
    def bytes(self) -> int:
        return sum(len(x.bitmap) for x in self.levels)


def shape(n: int, others: int, first: bool) -> tuple[int, int]:
    """(bits, hashes) of a level of ``n`` keys that ``others`` must not pass: later levels let half of them through
    by mistake, the first about as many as it has keys."""
    rate = min(0.5, max(n, 1) / max(others, 1) * math.sqrt(0.5)) if first else 0.5
    hashes = max(1, round(math.log2(1 / rate)))
    return max(64, math.ceil(n * hashes / math.log(2))), hashes


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The cascade that tells ``listed`` keys from all others of ``universe`` (both: key, distinct)."""
    inside, outside = listed, universe.join(F.broadcast(listed), "key", "left_anti")  # the list came from the driver
    others = outside.count()
    levels: list[Bloom] = []
    while True:
        n = inside.count()
        if levels and not n:
            return Cascade(levels)
        bits, hashes = shape(n, others, not levels)
        levels.append(Bloom(bits, hashes, len(levels)).fill(inside))
        inside, outside, others = staged(outside.where(levels[-1].holds(F.col("key"))), "cascade"), inside, n


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    if not rules:
        rules = [("allow", "\r", "")]  # fits nothing
    if len({r[1:] for r in rules}) < len(rules):
        raise ValueError("two rules with the same host and path")
    lengths = [len(p) for _, _, p in rules]
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    base = base.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    universe = staged(base.select(F.explode("keys").alias("key")).distinct(), "universe")
    rows = spark.createDataFrame([(h + SEPARATOR + p, v) for v, h, p in rules], "key string, kind string")
    cascades = {kind: build(universe, rows.where(F.col("kind") == kind).select("key")) for kind in ("block", "allow")}
    is_listed = {kind: (lambda k, c=c: c.listed(k)) for kind, c in cascades.items()}
    tagged = F.transform("keys", lambda k: F.struct(F.length(k).alias("long"), F.instr(k, SEPARATOR).alias("host"), k.alias("key"), F.when(is_listed["block"](k), "block").when(is_listed["allow"](k), "allow").alias("kind")))
    hit = F.array_max(F.filter(tagged, lambda x: x["kind"].isNotNull()))
    return _result(base.withColumn("hit", hit), default)


def _result(df: DataFrame, default: str) -> DataFrame:
    rule = F.translate(F.col("hit.key"), SEPARATOR, "")
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(F.col("hit.kind"), F.lit(default)).alias("verdict"))


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def op6_sql() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ranked = sorted(RULES, key=lambda r: (-(len(r[1]) + len(r[2])), -len(r[1])))
    case = lambda get: "CASE " + " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{get(v, h, p)}'" for v, h, p in ranked)
    return f"""
    WITH parts AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), split AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
    )
    SELECT page_id, host, path, {case(lambda v, h, p: h + p)} ELSE NULL END AS rule,
           {case(lambda v, h, p: v)} ELSE 'allow' END AS verdict
    FROM split"""
