"""Labelled text datasets: ingest, character-shingle MinHash clusters, leakage-safe splits, samples, vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import scrub
from vigil.operators.minhash import signed
from vigil.operators.rows import placed, pretokens
from vigil.plans.staging import ensure_checkpoint_dir
from vigil.sources.messages import dealt

HASHES, K, THRESHOLD = 64, 5, 0.8
BANDS = 16
#: Names of the packed last bits of a signature; rows of a band that meet at a time.
MARKS, BLOCK = [f"m{i}" for i in range(HASHES // 8)], 512
#: Turns that are laid out by one row of a plan.
RUN = 1 << 20
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


def ingest(texts: DataFrame, source: str, lang: str, prefix: str = "sms", collected_at: str | None = None) -> DataFrame:
    """id, text, lang, source, collected_at of ``texts`` (ord, text): scrubbed, numbered from 0 within the source in order."""
    n = placed(texts, "ord")
    return n.select("ord", F.format_string(f"{prefix}_{source}_%06d", "place").alias("id"), scrub(F.col("text")).alias("text"), F.lit(lang).alias("lang"), F.lit(source).alias("source"), F.lit(collected_at).cast("string").alias("collected_at"))


def shingles(docs: DataFrame, k: int = K) -> DataFrame:
    """id, shingle: the distinct character shingles of the lower-cased text; shorter texts are one shingle."""
    low = F.lower("text")
    some = F.when(F.length(low) == 0, F.array().cast("array<string>")).when(F.length(low) < k, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.length(low) - (k - 1)), lambda i: F.substring(low, i, F.lit(k))))
    return docs.select("id", F.explode(F.array_distinct(some)).alias("shingle"))


def signatures(docs: DataFrame) -> DataFrame:
    """id, sig array<long>: least salted md5 (first 60 bits) over the shingles for each salt; zeros for none. Shingles are never rows."""
    low = dealt(docs.select("id", F.lower("text").alias("low")), "id")
    return low.mapInArrow(signed(K, HASHES), f"id {low.schema['id'].dataType.simpleString()}, sig array<bigint>")


def near_pairs(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, agreement of pairs whose signatures agree in more than ``threshold`` of the values.

    Rows of one signature (equal texts, texts without shingles) are a class: its smallest id is paired with each other
    member, and stands for all of them in pairs with other classes, so a class of n rows gives n - 1 pairs.

    Rows meet in ``rare_bands``, which loses no pair; a band that many rows share is dealt out as pairs of blocks.
    Where they meet, pairs are first judged by the last bits of each value, which loses none either; what is left is judged by the whole values.
    """
    spark = sigs.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    classes = sigs.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("n")).checkpoint()
    copies = sigs.join(classes.where("n > 1"), "sig").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("agreement"))
    kept = rare_bands(classes, threshold).checkpoint()
    tile = ["band", "key", "i", "j"]
    left = kept.withColumn("j", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).withColumnRenamed("block", "i").drop("blocks")
    right = kept.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))).withColumnRenamed("block", "j").select(F.col("rep").alias("rep2"), *tile, *[F.col(m).alias(f"{m}_") for m in MARKS])
    # few bytes, but much work for each: partitions are not to be put together
    met = left.repartition(parts, *tile).join(right.repartition(parts, *tile), tile).where("i < j OR rep < rep2")
    likely = met.where((HASHES - unequal()) / HASHES > threshold).select(F.least("rep", "rep2").alias("rep"), F.greatest("rep", "rep2").alias("rep2")).distinct()
    share = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / HASHES
    other = classes.select(F.col("rep").alias("rep2"), F.col("sig").alias("sig2"))
    pairs = likely.join(classes.select("rep", "sig"), "rep").join(other, "rep2").select(F.col("rep").alias("a"), F.col("rep2").alias("b"), share("sig", "sig2").alias("agreement"))
    return pairs.where(F.col("agreement") > threshold).union(copies)


def rare_bands(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rep, band, key, blocks, block, and the marks, of ``classes`` (rep, sig): the bands in which rows need to meet, and the block of a row there.

    More than 0.8 of 64 values leave at most 12 that differ, so of 16 bands of 4 at least 4 agree whole. The rarest of
    those is not among the three most frequent bands of either row, so these are left out, and so is what no other row has.
    """
    rows = HASHES // BANDS
    keys = F.array(*[F.xxhash64(F.slice("sig", b * rows + 1, rows)) for b in range(BANDS)])
    keyed = classes.select("rep", F.posexplode(keys).alias("band", "key"))
    shared = keyed.join(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"])
    spare = max(0, BANDS - int(HASHES * (1 - threshold)) - 1)  # bands that agree beyond one, at least
    rare = F.slice(F.sort_array(F.collect_list(F.struct("n", "band", "key")), False), spare + 1, BANDS)
    marked = shared.groupBy("rep").agg(rare.alias("rare")).where("size(rare) > 0").join(classes.select("rep", *marks()), "rep")
    blocks = F.ceil(F.col("r.n") / BLOCK)
    return marked.withColumn("r", F.explode("rare")).select("rep", "r.band", "r.key", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).alias("block"), *MARKS)


def marks() -> list[Column]:
    """The last six bits of the values of sig, eight in a long: in lanes of seven bits, the seventh left free."""
    lane = lambda i: F.shiftleft(F.get("sig", F.lit(i)).bitwiseAND(F.lit(63)), i % 8 * 7)
    return [reduce(Column.bitwiseOR, [lane(i) for i in range(at, at + 8)]).alias(m) for m, at in zip(MARKS, range(0, HASHES, 8), strict=True)]


def unequal() -> Column:
    """How many lanes differ between the marks of both sides: 63 more carries what is not 0 into the free bit."""
    each = sum(1 << 7 * i for i in range(8))
    differ = lambda m: F.bit_count((F.col(m).bitwiseXOR(F.col(f"{m}_")) + F.lit(63 * each)).bitwiseAND(F.lit(64 * each)))
    return reduce(lambda x, y: x + y, map(differ, MARKS))


def clusters(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, cluster (smallest id reachable over pairs).

    A round takes the least label of the neighbours, then that label's own label, so chains shrink by more than a
    hop each. Rounds end only when no label is above a neighbour's: then each component has one label, its smallest id.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    label = both.select(F.col("a").alias("id")).distinct().withColumn("cluster", F.col("id"))
    moved = True
    while moved:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("cluster").alias("m"))
        hop = label.join(near, F.col("id") == F.col("a")).select("id", F.least("cluster", "m").alias("c"), (F.col("m") < F.col("cluster")).alias("moved")).checkpoint()
        moved = hop.where("moved").limit(1).count() > 0
        up = hop.select(F.col("id").alias("c"), F.col("c").alias("cluster"))
        label = hop.select("id", "c").join(up, "c").select("id", "cluster").checkpoint() if moved else hop.select("id", F.col("c").alias("cluster"))
    return ids.select("id").join(label, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def turns(sizes: list[tuple[int, int]], ratios: dict[str, float] = RATIOS) -> list[tuple[int, int, int, int]]:
    """(size, place of the split, rows that it has before, turns that it gets) for (size, clusters of that size), largest first.

    A cluster goes to the split furthest below its share, by fraction, the first of equals. For clusters of one size, the turns of a split
    have fractions that fall by equal steps, so the turns of all splits are the merge of such series, and their numbers
    follow from where the series are cut. Only the last few turns of a size are taken one by one.
    """
    total = sum(n * k for n, k in sizes)
    targets, have, out = [r * total for r in ratios.values()], [0] * len(ratios), []
    for n, k in sizes:
        open_, level = list(range(len(targets))), 0.0
        while True:  # the fraction that the splits which still lack rows are left with
            level = (sum(targets[i] - have[i] for i in open_) - n * k) / sum(targets[i] for i in open_)
            lacking = [i for i in open_ if targets[i] - have[i] > level * targets[i]]
            if len(lacking) == len(open_) or not lacking:
                break
            open_ = lacking
        got = [max(0, int((targets[i] - have[i] - level * targets[i]) // n) - len(targets) - 2) if i in open_ else 0 for i in range(len(targets))]
        for _ in range(k - sum(got)):
            short = [(t - (h + n * g)) / t for t, h, g in zip(targets, have, got, strict=True)]
            got[short.index(max(short))] += 1
        out += [(n, i, h, g) for i, (h, g) in enumerate(zip(have, got, strict=True)) if g]
        have = [h + n * g for h, g in zip(have, got, strict=True)]
    return out


def split(clustered: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """id, cluster, split: whole clusters, largest first, each to the split furthest below its share (by fraction).

    Only the distinct sizes of clusters with their numbers come to the driver. The turns of all sizes are laid out as rows,
    put in order and numbered, and so are the clusters; equal numbers belong together.
    """
    spark = clustered.sparkSession
    ensure_checkpoint_dir(spark)
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n")).checkpoint()
    hist = [(r["n"], r["k"]) for r in sizes.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()]
    total, names = sum(n * k for n, k in hist), list(ratios)
    goals = F.array(*[F.lit(ratios[s] * total) for s in names])
    runs = [(n, i, h, at, min(at + RUN, g)) for n, i, h, g in turns(hist, ratios) for at in range(0, g, RUN)]
    plan = spark.createDataFrame(runs, "n long, i int, h long, start long, stop long").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = plan.select("n", "i", "h", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("m"))
    goal = F.get(goals, F.col("i"))
    key = (goal - (F.col("h") + F.col("m") * F.col("n"))) / goal
    ordered = placed(each.select((-F.col("n")).alias("less"), (-key).alias("key"), "i", "m"), "less", "key", "i", "m").select("place", F.get(F.array(*map(F.lit, names)), F.col("i")).alias("split"))
    put = placed(sizes.select("cluster", (-F.col("n")).alias("less")), "less", "cluster").select("cluster", "place").join(ordered, "place").select("cluster", "split")
    return clustered.join(put, "cluster").select("id", "cluster", "split")


def leaks(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """a, b: near pairs whose rows lie in different splits; none after ``split``."""
    l, r = splits.select(F.col("id").alias("a"), F.col("split").alias("sa")), splits.select(F.col("id").alias("b"), F.col("split").alias("sb"))
    return pairs.join(l, "a").join(r, "b").where("sa <> sb").select("a", "b")


def require_no_leaks(pairs: DataFrame, splits: DataFrame) -> None:
    """Raise if a near pair lies in two splits, naming one such pair."""
    found = leaks(pairs, splits).first()
    if found:
        raise ValueError(f"rows {found['a']} and {found['b']} are near copies in different splits")


def token_counts(docs: DataFrame, lower: bool = True) -> DataFrame:
    """token, freq over words and runs of punctuation; without ``lower`` over the tokens that a pruned vocabulary is asked for."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), 0) if lower else pretokens(F.col("text"))
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def vocabulary(counts: DataFrame, size: int, least: int = 5) -> DataFrame:
    """new_id, token, freq: the most frequent tokens, ids by token order."""
    kept = counts.where(F.col("freq") >= least).orderBy(F.desc("freq"), "token").limit(size)
    return kept.select((F.row_number().over(Window.orderBy("token")) - 1).alias("new_id"), "token", "freq")


def mean_pool(vectors: DataFrame) -> DataFrame:
    """label, pos, mean: the mean of every coordinate; where there is a column mask, of the coordinates whose mask is not 0
    (the number of those is at least 1e-9, so a position without any has mean 0)."""
    if "mask" not in vectors.columns:
        each = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
        return each.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))
    each = vectors.select("label", F.posexplode(F.arrays_zip("embedding", "mask")).alias("pos", "z"))
    x, m = F.col("z.embedding").cast("double"), F.col("z.mask").cast("double")
    return each.groupBy("label", "pos").agg(F.round(F.sum(x * m) / F.greatest(F.sum(m), F.lit(1e-9)), 5).alias("mean"))
