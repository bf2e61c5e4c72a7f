"""What a task may hold: tiles under ties, slices by bytes, long texts beyond every real limit, empty tables for the stages."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import documents, prose
from vigil.llm import common, differencing, edit_match, hidden_markov, lang_mixture, near_dup, toxic_crf
from vigil.llm import cosine_tiles as E


def test_tiles_under_ties(spark):
    rows = [("a", k, 1, bytearray(8), 0.25) for k in range(4_000)] + [("a", 10_000 + k, 1, bytearray(8), k / 500) for k in range(500)] + [("b", 20_000, 1, bytearray(8), 0.25)]
    turned = spark.createDataFrame(rows, "label string, cid long, weight long, v binary, lead double")
    got = E._tiled(turned, 100).groupBy("label", "tile").count().toPandas()
    assert got["count"].sum() == 4_501 and got["count"].max() <= 160


def test_links_of_one_hot_vectors(spark):
    rows = [(k, [1.0 if j == k % 40 else 0.0 for j in range(40)], "x") for k in range(200)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), tile=10).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, 4, k % 40) for k in range(200)]


def test_slices_by_bytes():
    texts = ["a" * 10, None, "", "b" * 100, "é" * 3, *["c"] * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for most in (1, 8, 50, 1000):
        parts = [p.column("text").to_pylist() for p in common.by_bytes(batch, most=most)]
        assert sum(parts, []) == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= most for p in parts)
    assert list(common.by_bytes(batch.slice(0, 0))) == []


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("ab"), rng.randrange(9)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, n long")
    got = {r.id: r.before for r in common.running(df, ["id"], {"before": "n"}).collect()}
    assert got == {k: sum(n for j, _, n in rows if j < k) for k, _, _ in rows}
    got = {r.id: r.before for r in common.running(df, ["id"], {"before": "n"}, by="g").collect()}
    assert got == {k: sum(n for j, h, n in rows if j < k and h == g) for k, g, _ in rows}


def test_small_sides_are_counted(spark):
    df = spark.range(50)
    assert "broadcast" in common.small(df, 50)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.small(df, 49)._jdf.queryExecution().logical().toString().lower()


def test_forward_equals_one_by_one():
    rng = np.random.default_rng(4)
    model = hidden_markov.Model.start(np.ones(hidden_markov.CLASSES, dtype=np.int64))
    rows = [rng.integers(0, hidden_markov.CLASSES, n).astype("<u2").tobytes() for n in (1, 7, 300, 7, 2_000)]
    together = hidden_markov.forward(model, rows)
    assert np.allclose(together, [hidden_markov.forward(model, [r])[0] for r in rows])


LONG = " ".join(prose(k, 5_000) for k in range(35))  # over a million characters


@pytest.mark.parametrize("name", ["op3", "op7", "op8", "op10"])
def test_texts_longer_than_every_limit(spark, name):
    rows = [(1, LONG), (2, prose(1, 60)), (3, LONG + " end"), (4, prose(2, 60)), (5, None)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1 if k == 2 else 0) for k in (1, 2, 4)], "doc_id long, toxic int")
    got = {"op3": lambda: lang_mixture.identify(docs), "op7": lambda: near_dup.near_duplicates(docs), "op8": lambda: hidden_markov.score_texts(docs, rounds=1), "op10": lambda: toxic_crf.tag(docs, labels)}[name]().collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5]
    if name == "op7":
        assert {r.doc_id: r.component_id for r in got} == {1: 1, 3: 1, 2: 2, 4: 4, 5: 5}
    if name == "op8":
        assert {r.doc_id: r.n_tokens for r in got} == {k: len((t or "").split()) + 1 for k, t in rows}


def test_stages_of_empty_tables(spark):
    docs, none = documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for kept in (toxic_crf.keep_clean(docs, none), lang_mixture.keep_certain(docs, 0.5), near_dup.keep_one(docs), edit_match.keep_unleaked(docs, bench)):
        assert kept.columns == docs.columns and kept.count() == 0
    some = documents(spark, [(1, prose(1, 30)), (2, None)])
    assert toxic_crf.keep_clean(some, none).count() == 2 and edit_match.keep_unleaked(some, bench).count() == 2


def plain_difference(sizes, shards):
    """Karmarkar-Karp on all groups at once, straight from its definition: the spread that is left."""
    parts = [sorted([s] + [0] * (shards - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1], reverse=True)
        a, b, *parts = parts
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0][0] - parts[0][-1]


def test_difference_equals_the_plain_method():
    rng = random.Random(5)
    for shards in (2, 3, 7):
        sizes = [rng.randrange(8, 2_000_000) for _ in range(60)]
        parts = np.zeros((60, shards), dtype=np.int64)
        parts[:, 0] = sizes
        sums, where = differencing.difference(parts)
        assert sums.max() - sums.min() == plain_difference(sizes, shards)
        assert np.bincount(where[:, 0], weights=sizes, minlength=shards).tolist() == sums.tolist()


def test_another_operators_memory_goes():
    own = common.remembered({})
    common.begin("one")
    own["x"] = 1
    common.begin("one")
    assert own == {"x": 1}
    common.begin("two")
    assert own == {}
    common._remembered.remove(own)


def test_other_tokenizer_files_are_refused(spark):
    from vigil.llm import bpe_tree, chunk_store, cross_align

    docs = documents(spark, [(1, "a")])
    with pytest.raises(ValueError, match="not known"):
        bpe_tree.encode_documents(docs, cross_align.byte_path())
    with pytest.raises(ValueError, match="not known"):
        chunk_store.write_store(docs, bpe_tree.default_path(), 0, "unused")
    with pytest.raises(ValueError, match="not known"):
        cross_align.aligned(docs, bpe_tree.default_path(), cross_align.piece_path())
