import corpus_pipeline as P
from tests.llm.cases import documents, prose
from tests.llm.test_pairs import shingle_sets
from vigil.llm import near_dup as N


def test_stages_keep_columns_and_rows(spark, tmp_path):
    for t, schema, rows in (("labels", "doc_id long, toxic int", [(5, 0)]), ("benchmark", "item_id long, text string", [(1, prose(40, 20))])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = [(i, prose(i, 40)) for i in range(30)] + [(50, prose(3, 40)), (51, prose(9, 10) + " " + prose(40, 20)), (52, None), (53, "123 456")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
    assert sorted(r.doc_id for r in docs.collect()) == list(range(30))
    assert P.run(spark, str(tmp_path)).count() == 30


def test_near_copies_from_eighty_hundredths_go(spark):
    rows = []
    for i in range(20):
        words = [f"w{i}x{j}" for j in range(80)]
        changed = words[:30] + [f"new{i}x{j}" for j in range(4 + i % 2)] + words[34 + i % 2 :]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    sets = shingle_sets(rows)
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert all(0.80 <= x < 0.85 for x in near[::2]) and all(x < 0.80 for x in near[1::2])
    want = [i for i, _ in rows if i % 4 != 1]
    assert sorted(r.doc_id for r in P.near_duplicates(spark, documents(spark, rows), "").collect()) == want


def test_bands_meet_pairs_at_the_threshold():
    assert N.banding(N.HUNDREDTHS) == (24, 6)
    for h in (60, 80, 85, 95, 100):
        bands, rows = N.banding(h)
        assert (1 - (h / 100) ** rows) ** bands <= N.UNMET
