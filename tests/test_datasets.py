import json

import pytest

from vigil.operators import checks as C
from vigil.operators import datasets as D
from vigil.operators import metrics as M
from vigil.plans.staging import ensure_checkpoint_dir
from vigil.sources import messages as S


def test_near_duplicates_cluster_and_stay_in_one_split(spark):
    ensure_checkpoint_dir(spark)
    base = "the quick brown fox jumps over the lazy dog near the quiet river bank at dawn "
    texts = [(1, base * 2), (2, base * 2 + "x"), (3, "nothing alike at all, some other words entirely"), (4, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    pairs = D.near_pairs(D.signatures(df).checkpoint())
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    cl = D.clusters(df, pairs)
    assert {r.id: r.cluster for r in cl.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert D.leaks(pairs, D.split(cl)).count() == 0


def test_split_shares(spark):
    df = spark.createDataFrame([(i, i) for i in range(100)], "id long, cluster long")
    got = {r["split"]: r["count"] for r in D.split(df).groupBy("split").count().collect()}
    assert 60 <= got["train"] <= 80 and 5 <= got["val"] <= 25 and 5 <= got["test"] <= 25


def test_split_places_clusters_one_by_one(spark):
    rows = [(i, i) for i in range(11_000)] + [(20_000 + i, 20_000 + i // 3) for i in range(3_000)]
    got = {r.cluster: r.split for r in D.split(spark.createDataFrame(rows, "id long, cluster long")).collect()}
    target, have = {s: r * len(rows) for s, r in D.RATIOS.items()}, dict.fromkeys(D.RATIOS, 0)
    for n, c in [(3, 20_000 + i) for i in range(1_000)] + [(1, i) for i in range(11_000)]:
        best = max(have, key=lambda s: (target[s] - have[s]) / target[s])
        have[best] += n
        assert got.pop(c) == best
    assert not got
    assert D.split(spark.createDataFrame([], "id long, cluster long")).count() == 0


def test_leak_is_found(spark):
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    splits = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    assert D.leaks(pairs, splits).count() == 1
    with pytest.raises(ValueError, match="1 and 2"):
        D.require_no_leaks(pairs, splits)


def test_many_rows_of_one_signature_stay_few_pairs(spark):
    ensure_checkpoint_dir(spark)
    df = spark.createDataFrame([(i, "") for i in range(400)] + [(500 + i, "the same text again") for i in range(400)], "id long, text string")
    pairs = D.near_pairs(D.signatures(df).checkpoint())
    assert pairs.count() == 798 and {r.cluster for r in D.clusters(df, pairs).collect()} == {0, 500}


def test_long_chain_is_one_cluster(spark):
    ensure_checkpoint_dir(spark)
    ids = spark.createDataFrame([(i,) for i in range(75)], "id long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(61, 74), (73, 74)], "a long, b long")
    cl = D.clusters(ids, chain)
    assert {r.id: r.cluster for r in cl.collect()} == {i: 0 if i <= 60 else 61 if i in (73, 74) else i for i in range(75)}
    assert D.leaks(chain, D.split(cl)).count() == 0


def test_metrics_without_denominator(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    r = M.binary(df).first()
    assert (r.precision_1, r.recall_1, r.f1_1, r.f1_0) == (0.0, 0.0, 0.0, 1.0)


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    r = M.nearest_rank(df, "v").first()
    assert (r.p50, r.p95) == (11.0, 20.0)


def test_parity_of_no_rows(spark):
    assert M.parity(spark.createDataFrame([], "a double, b double")).first().passed


@pytest.mark.parametrize("lang,label,category,bad", [("EN", 1, "KYC_PHISHING", 0), ("EN", 0, "NOT_SCAM", 0), ("EN", 0, "KYC_PHISHING", 1), ("XX", None, None, 1), ("EN", 1, None, 1), ("EN", None, None, 0)])
def test_row_constraints(spark, lang, label, category, bad):
    df = spark.createDataFrame([("a", lang, label, category)], "id string, lang string, label int, category string")
    assert C.row_violations(df).count() == bad


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1," hi "\n2,\n3,"two\nlines"\n')
    assert [r.text for r in S.from_csv(spark, str(tmp_path / "a.csv"), "text").collect()] == ["hi", "two\nlines"]
    assert S.from_csv(spark, str(tmp_path / "a.csv"), "none").count() == 0
    (tmp_path / "b.txt").write_text("one\n\n two \n")
    assert [r.text for r in S.from_lines(spark, str(tmp_path / "b.txt")).collect()] == ["one", "two"]
    (tmp_path / "c.tsv").write_text("ham\tok\tthen\n")
    assert [tuple(r) for r in S.from_tsv(spark, str(tmp_path / "c.tsv")).collect()] == [("ham", "ok\tthen")]
    (tmp_path / "d.jsonl").write_text(json.dumps({"id": "1", "text": "é", "lang": "EN", "source": "s", "collected_at": "2024-01-01", "is_hard_negative": False}) + "\n")
    rows = S.read_rows(spark, str(tmp_path / "d.jsonl"))
    S.write_rows(rows, str(tmp_path / "out"))
    assert S.read_rows(spark, str(tmp_path / "out")).first().text == "é"


def test_every_coordinate_is_pooled(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(64)]), (1, [float(3 * i) for i in range(64)]), (2, [5.0]), (2, None)], "label int, embedding array<float>")
    got = {(r.label, r.pos): r["mean"] for r in D.mean_pool(df).collect()}
    assert got == {(1, i): 2.0 * i for i in range(64)} | {(2, 0): 5.0}
