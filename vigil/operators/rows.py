"""Gates, samples, pairings and vocabularies of labelled dataset rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.selection import MOST, bottom, hashed
from vigil.plans.staging import ensure_checkpoint_dir, small

# Common nouns that may not stand alone as an alias, and sources whose texts need no check of names
COMMON_NOUNS = ["bank", "pay", "card", "post", "service", "account", "office", "department", "app", "mobile", "online", "secure", "support", "helpline", "customer"]
NAME_SAFE_SOURCES = ["uci_sms_spam_collection"]
DAY_MS = 86_400_000


def labelled(rows: DataFrame, split: str | None = None) -> DataFrame:
    """Rows with a label, of one split if given."""
    out = rows.where("label IS NOT NULL")
    return out if split is None else out.where(F.col("split") == split)


def in_split(rows: DataFrame) -> DataFrame:
    return rows.where("split IS NOT NULL")


def split_counts(rows: DataFrame) -> DataFrame:
    """split, n, positives over rows that have a split."""
    return in_split(rows).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"))


def unsafe_sources(rows: DataFrame, verified: bool = False) -> DataFrame:
    """source, n of rows whose names nobody has checked; none if ``verified``."""
    out = rows.where(~F.coalesce(F.col("source").isin(NAME_SAFE_SOURCES), F.lit(False))) if not verified else rows.limit(0)
    return out.groupBy("source").agg(F.count("*").alias("n"))


def dotted_ascii(domains: DataFrame) -> DataFrame:
    """Domains with a dot and without characters beyond ASCII."""
    return domains.where(F.contains("domain", F.lit(".")) & F.col("domain").rlike(r"^[\x00-\x7F]*$"))


def bare_nouns(aliases: DataFrame) -> DataFrame:
    """brand_id, alias of aliases that are nothing but a common noun."""
    return aliases.select("brand_id", F.explode("aliases").alias("alias")).where(F.lower("alias").isin(COMMON_NOUNS))


def repeated(table: DataFrame, key: str) -> DataFrame:
    """key, n of keys that occur more than once."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def stratified(rows: DataFrame, by: str, sizes: dict, seed: int = 0, most: int = MOST) -> DataFrame:
    """id, ``by``, place: so many rows of each value of ``by`` as ``sizes`` says (fewer where there are fewer), drawn by a
    hash of the id and dealt into one order by another."""
    kept = bottom(rows.select("id", by), f"{seed}:", sizes, by, most)
    return placed(kept.withColumn("_o", hashed(f"order {seed}:")), "_o", "id").drop("_o").withColumn("place", F.col("place").cast("int"))


def first_rows(rows: DataFrame, split: str, n: int) -> DataFrame:
    """The first ``n`` rows of a split by id."""
    return rows.where(F.col("split") == split).orderBy("id").limit(n)


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with place (from 0) in ``order``: places inside a range partition and the sizes of those before it."""
    ensure_checkpoint_dir(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = dealt.withColumn("_i", inside).join(F.broadcast(before), "_p")  # a row for each partition
    return out.withColumn("place", F.col("_i") + F.col("_at")).drop("_i", "_at", "_p")


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of ``left`` beside the row of ``right`` in the same place; raises if they are not equally many."""
    if left.count() != right.count():
        raise ValueError("tables of different lengths cannot be paired by place")
    return placed(left, order).join(placed(right, order).drop(order), "place")


def mean_loss(losses: DataFrame) -> DataFrame:
    """mean_loss: the mean over batches of each batch's own mean (batch, loss)."""
    return losses.groupBy("batch").agg(F.avg("loss").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_loss"))


def layer_loss(losses: DataFrame) -> DataFrame:
    """batch, loss: the mean over hidden layers of the mean squared difference of each (batch, layer, a, b: arrays of one length)."""
    each = losses.select("batch", "layer", F.explode(F.arrays_zip("a", "b")).alias("z"))
    d = F.col("z.a").cast("double") - F.col("z.b").cast("double")
    return each.groupBy("batch", "layer").agg(F.avg(d * d).alias("m")).groupBy("batch").agg(F.round(F.avg("m"), 6).alias("loss"))


def require_name_safe(rows: DataFrame, verified: bool = False) -> DataFrame:
    """``rows``, if names in them need no check or are ``verified``; raises with the sources that do otherwise."""
    found = unsafe_sources(rows, verified).limit(5).collect()
    if found:
        raise ValueError("names are unchecked in rows of " + ", ".join(sorted(str(r["source"]) for r in found)))
    return rows


def together(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, repeated ones included; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def age_days(first_seen_ms: Column, now_ms: Column) -> Column:
    """Whole days between two times in milliseconds; null if either is."""
    return F.floor((now_ms - first_seen_ms) / DAY_MS)


def flat_line(text: Column) -> Column:
    """A text as one line: line ends become blanks."""
    return F.regexp_replace(text, r"\r\n|\r|\n", " ")


def pretokens(text: Column) -> Column:
    """Words (letters, marks, digits, connectors) and runs of what is neither word nor white space, in order, case kept."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def kept_tokens(counts: DataFrame, specials: list[str], target: int, least: int = 5) -> DataFrame:
    """token, new_id: the specials and the most frequent other tokens up to ``target``, numbered by token.

    ``counts`` (token, freq). Specials count towards the target, and never twice; the target may be less than them.
    """
    own = counts.sparkSession.createDataFrame([(t,) for t in sorted(set(specials))], "token string")
    budget = max(0, target - len(set(specials)))
    frequent = counts.where(~F.col("token").isin(specials) & (F.col("freq") >= least)).orderBy(F.desc("freq"), "token").limit(budget).select("token")
    return own.union(frequent).select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("new_id"))  # ``target`` rows at most


def remapped(vectors: DataFrame, kept: DataFrame) -> DataFrame:
    """new_id, embedding: the rows of an embedding table (token, embedding) that stay, under their new ids."""
    return vectors.join(small(kept), "token").select("new_id", "embedding")


def encoded(docs: DataFrame, kept: DataFrame, unknown: str) -> DataFrame:
    """id, pos, token_id: words and runs of punctuation, as they are written, under a pruned vocabulary; tokens outside it are ``unknown``'s."""
    tokens = docs.select("id", F.posexplode(pretokens(F.col("text"))).alias("pos", "token"))
    own = kept.where(F.col("token") == unknown).select(F.col("new_id").alias("_unk"))
    return tokens.join(small(kept), "token", "left").crossJoin(F.broadcast(own)).select("id", "pos", F.coalesce("new_id", "_unk").alias("token_id"))  # one row


def adaptive_pool(values: Column, n: int) -> Column:
    """``n`` means over stretches of an array that cover it evenly (floor and ceiling of equal shares)."""
    size = F.size(values)

    def at(i: int) -> Column:
        start = F.floor(size * i / n).cast("int")
        end = F.ceil(size * (i + 1) / n).cast("int")
        part = F.slice(values, start + 1, end - start)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / (end - start)

    return F.array(*[at(i) for i in range(n)])
