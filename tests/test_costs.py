"""Plans do each piece of work once, and results stay those of plain programs."""

import hashlib
import re
from functools import reduce

from pyspark.sql import functions as F

from vigil import catalogue
from vigil.operators import scoring as Sc

SF = "/root/testdata/sf0.001"


def plan(spark, name, sf=SF):
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    return catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_not_evaluated_again_by_a_filter(spark):
    assert plan(spark, "evidence_with_model").count("md5(") == 1
    assert plan(spark, "evidence_ranked").count("MISMATCH") == plan(spark, "fusion_verdict").count("MISMATCH") + 1


def test_logits_sum_what_is_under_the_mask(spark):
    assert "array_repeat" not in plan(spark, "classifier_signal")
    texts = ["", "one", "a b  c a", " ".join(f"w{i}" for i in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "normalized string")
    for r in df.select("normalized", Sc.linear_logits(F.slice(Sc.token_ids(F.col("normalized")), 1, Sc.WIDTH)).alias("z")).collect():
        ids = [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % Sc.IDS + 1 for w in r.normalized.split(" ") if w][: Sc.WIDTH]
        total, want = lambda f: reduce(lambda a, i: a + f(i), ids, 0.0), [0.0]
        assert list(r.z.binary) == want + [total(lambda i: (i % 41 - 20) / 40.0)]
        assert list(r.z.category) == [total(lambda i: (i % (k + 7) - (k + 6) / 2.0) / (k + 7)) for k in range(len(r.z.category))]


def test_sums_of_postings_are_a_row_for_each_block(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from vigil.llm import cross_align as C

    pack = lambda ids, docs, m: b"".join(np.array(x, "<u2").tobytes() for x in (ids, docs, m))
    rows = [(7, 0, 0, None, None, None, 3, 5), (7, 0, 0, None, None, None, 4, 2), (7, 0, 1, 1, 9, pack([3, 4], [0, 8], [2, 1]), None, None), (7, 0, 1, 2, 9, pack([4], [5], [3]), None, None)]
    names = ["b", "salt", "kind", "block", "n", "payload", "one_a", "one_c"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    once = list(C._count(1 << 20)([batch]))
    assert sum(x.num_rows for x in once) == 2  # three documents of two blocks
    monkeypatch.setattr(C, "MERGED", 2)
    three = pa.Table.from_batches(once * 3).sort_by("block").combine_chunks().to_batches()
    got = [r for x in C._whole(three) for r in x.to_pylist()]
    assert [(r["block"], r["pos"], r["best"], r["total"]) for r in got] == [(1, 0, 6, 30), (1, 8, 0, 6), (2, 5, 0, 18)]


def test_sure_models_are_calibrated(spark, tmp_path):
    import numpy as np

    from vigil.operators import labels as Lb
    from vigil.operators import training as Tr

    w = np.zeros((101, Tr.OUT))
    w[0, 1] = 100.0  # the probability is 1 in doubles
    Tr.write_model(spark, str(tmp_path), w, 1.0, [])
    rows = spark.createDataFrame([("a b", 1), ("c", 1), ("d", 0)], "normalized string, label int")
    got = Tr.binary_logits(rows, str(tmp_path))
    assert sorted((r.y, r.z1 - r.z0) for r in got.collect()) == [(0, 100.0), (1, 100.0), (1, 100.0)]
    assert Lb.COLDEST <= Lb.fit_temperature(got) <= Lb.HOTTEST
    assert {r.p for r in Tr.scored_by(str(tmp_path))(rows).selectExpr("model.weight AS p").collect()} == {1.0}


def test_weights_go_to_tasks_and_not_to_rows(spark, tmp_path, monkeypatch):
    import numpy as np

    from vigil.operators import training as Tr

    w = np.random.default_rng(4).normal(size=(51, Tr.OUT))
    Tr.write_model(spark, str(tmp_path), w, 1.0, [])
    monkeypatch.setattr(Tr, "SCORED", 2)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c a", "", None, "d", "e " * 200, None, "", "f g"])], "k int, normalized string").coalesce(1)
    on = Tr._with_logits(rows, str(tmp_path))[0].withColumn("ids", Sc.token_ids(F.col("normalized"), 50, Sc.WIDTH))
    assert "Join" not in on._jdf.queryExecution().optimizedPlan().toString()
    for r in on.collect():
        want = None if r.normalized is None else [sum(w[i, k] for i in r.ids) / max(1, len(r.ids)) ** 0.5 + w[0, k] for k in range(Tr.OUT)]
        assert r._z is None if want is None else np.allclose(r._z, want, rtol=1e-12)


def test_texts_are_searched_for_links_once(spark):
    assert "posexplode(" not in plan(spark, "fusion_verdict")


def test_messages_are_analysed_once_for_what_follows(spark):
    for name in ("fusion_verdict", "category_argmax", "presentation"):
        assert plan(spark, name).count("Zen Bank: your statement") == 1, name


def test_categories_sum_hints_in_the_row(spark):
    from vigil.plans import verdict as V
    from vigil.sources.rules import BUILT_IN

    one = F.array(*[F.struct(F.lit(i).alias("ord")) for i in (3, 4)])  # 0.5 for LOTTERY_PRIZE, then 0.2 and 0.3
    none, model = F.array().cast("array<struct<ord: int>>"), "struct<category: string, hint: double>"
    df = spark.createDataFrame([(1, "SCAM"), (2, "SAFE"), (3, "SCAM"), (4, "SUSPICIOUS")], "msg_id long, verdict string")
    df = df.withColumn("sender", F.when(F.col("msg_id") == 4, "DLT_HEADER_MISMATCH")).withColumn("url_evidence", F.array(F.struct(F.lit("URL_SHORTENER").alias("type"))))
    df = df.withColumn("fired", F.when(F.col("msg_id") == 3, none).otherwise(F.when(F.col("msg_id") == 4, none).otherwise(one)))
    got = {r.msg_id: (r.category, r.category_confidence) for r in V.categories(df, BUILT_IN).collect()}
    assert got == {1: ("LOTTERY_PRIZE", "HIGH"), 2: ("NOT_SCAM", "HIGH"), 3: ("OTHER_SCAM", "LOW"), 4: ("KYC_PHISHING", "LOW")}
    tied = df.withColumn("model", F.when(F.col("msg_id") == 4, F.struct(F.lit("FAKE_JOB").alias("category"), F.lit(0.5).alias("hint"))).otherwise(F.lit(None).cast(model)))
    assert {r.msg_id: r.category for r in V.categories(tied, BUILT_IN).collect()}[4] == "KYC_PHISHING"  # first met


def test_language_does_not_compare_each_word_with_each(spark):
    from vigil.functions.text import language
    from vigil.sources import rules

    assert "kripya," not in plan(spark, "language_detect")
    texts = [f"{a}{c}{b}" for a in ("aap", "aapk", "xaap", "aap2", "aapka", "zzz") for b in ("hai", "haii", "AAP", "hain", "aap") for c in (" ", "-", "", "_", "\u00e9", " ok ")]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", language(F.col("t")).alias("lang")).collect():
        hits = sum(w in rules.ROMANISED_HINDI for w in re.split("[^a-z0-9]+", r.t))
        assert r.lang == ("HI_LATN" if hits >= 2 else "EN"), r.t


def test_rules_look_for_words_that_a_match_needs(spark):
    from vigil.operators.analyzers import needed

    assert needed(r"(share|send).{0,20}(otp|code|pin)") == ["share", "send"]
    assert needed("(within|in) [0-9]+ (hours?|minutes?)|expires today") == ["hour", "minute", "expires today"]
    for unclear in ("(a|b)?c", "x(ab)+", "foo|", "(foo(bar)|z) q", "[a|b]c", "(?i)abc", "a{2}b", r"\bab", "(ab|c?)", ""):
        assert needed(unclear) is None, unclear
    assert plan(spark, "pattern_hits").count("Contains(") or "contains(" in plan(spark, "pattern_hits").lower()


def test_places_of_a_few_matches(spark):
    import random

    from vigil.functions.text import spans

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@ .\u00e9\U0001f600") for _ in range(rng.randrange(14))) for _ in range(400)] + ["a@b.a b.a", "", None]
    pattern = r"(?<![\w@.])([ab]+\.[ab]+|\u00e9)"
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t"), pattern).alias("s")).collect():
        want = None if r.t is None else [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.t, re.ASCII)]
        assert (None if r.s is None else [tuple(x) for x in r.s]) == want, r.t


def test_token_pack_makes_ids_once_and_asks_no_language(spark):
    seen = plan(spark, "token_pack")
    assert seen.count("md5(") == 1 and "HI_LATN" not in seen
