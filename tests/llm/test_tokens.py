import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import AWKWARD, documents, prose
from vigil.llm import bpe_tree as B
from vigil.llm import chunk_store as K
from vigil.llm import textcodec as C
from vigil.llm.common import fresh_path

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
PIECES = ["<|endoftext|>", "<|startoftext|>", "a", "b", " ", "é", "e\u0301", "'s", "ing", "the", "1", "22", "!", "..", "\n", "Σ", "中", "🙂", "\x1c", "\u3000", "İ", "<|", "aaaa"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.integers(3, 40))
def test_tree_and_units_equal_the_library(parts, leaf):
    text = "".join(parts)
    tok = Tokenizer.from_file(WORD)
    want = tok.encode(text, add_special_tokens=False).ids
    got = B.root_ids(WORD, [B.leaf(WORD, c) for c in B.cut(text, leaf, B.specials(WORD))])
    assert np.frombuffer(got, "<u4").tolist() == want
    (ids, decoded), = B.encode_texts(WORD, [text])
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == tok.decode(want, skip_special_tokens=False)
    assert np.frombuffer(C.byte_level_ids(BYTE, [text])[0], "<u4").tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_memory_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "MEMO_UNITS", 7)
    text = prose(1, 300)
    assert np.frombuffer(C.byte_level_ids(BYTE, [text])[0], "<u4").tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("'strevlmd \n\u00e91.A"), max_size=25), max_size=6), st.integers(1, 30))
def test_plain_texts_side_by_side_equal_the_library(texts, slice_chars):
    tok = C.tokenizer(BYTE)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "SLICE", slice_chars)
        got = [np.frombuffer(x, "<u4").tolist() for x in C.byte_level_ids(BYTE, texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("leaf", [B.LEAF_CHARS, 500])
def test_documents_of_all_kinds(spark, leaf):
    tok = Tokenizer.from_file(WORD)
    rows = [*AWKWARD, (20, prose(2, 400)), (21, "ab" * 3_000), (22, prose(2, 400)), (23, "<|endoftext|>".join(prose(k, 300) for k in range(3)) + "<|" * 900)]
    got = sorted(tuple(r) for r in B.encode_documents(documents(spark, rows), WORD, leaf).collect())
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_store_round_trip(spark):
    tok = Tokenizer.from_file(BYTE)
    copies = prose(5, 3_000)
    rows = [*AWKWARD, (30, copies), (31, copies), (32, copies + " end")]
    at = K.write_store(documents(spark, rows), BYTE, 0, fresh_path(spark, "t"))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(tuple(r) for r in K.read_digests(spark, at).collect()) == [w[:4] for w in want]
    assert sorted((r.doc_id, r.ids) for r in K.read_ids(spark, at).collect()) == [(w[0], w[4]) for w in want]
    _, chunks = K.open_store(spark, at)
    assert chunks.count() == chunks.select("key").distinct().count()
    # one copy of a repeated document is stored
    assert chunks.selectExpr("sum(length(payload) / width)").first()[0] < start - len(want[-2][4]) * 0.9
    assert sum(r.documents for r in K.manifest(spark, at).collect()) == len(rows)


def test_store_notices_a_lost_recipe(spark):
    at = K.write_store(documents(spark, [(i, prose(i, 50)) for i in range(9)]), BYTE, 0, fresh_path(spark, "t"))
    recipes, _ = K.open_store(spark, at)
    kept = spark.createDataFrame(recipes.where("doc_id <> 4").collect(), recipes.schema)
    kept.write.mode("overwrite").parquet(f"{at}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        K.read_digests(spark, at)


def test_many_streams_side_by_side_are_cut_as_alone():
    rng = random.Random(3)
    streams = [np.array([rng.randrange(90_000) for _ in range(n)], "<u4") for n in (1, 7, 64, 65, 900, 3, 20_000, 500)]
    places, start = K.candidates(np.concatenate(streams)), 0
    for x in streams:
        mine = places[(places > start) & (places <= start + len(x))].tolist()
        assert [e - start for e in K.ends_of(mine, start, start + len(x))] == K.cuts(x)
        start += len(x)


def test_store_notices_a_changed_chunk(spark):
    at = K.write_store(documents(spark, [(1, prose(1, 50))]), BYTE, 0, fresh_path(spark, "t"))
    _, chunks = K.open_store(spark, at)
    bad = chunks.selectExpr("key", "width", "concat(payload, payload) AS payload").collect()
    spark.createDataFrame(bad, K.CHUNK).write.mode("overwrite").parquet(f"{at}/chunks")
    with pytest.raises(Exception, match="does not hold"):
        K.read_digests(spark, at).collect()


def test_empty_tables(spark):
    none = documents(spark, [])
    assert B.encode_documents(none, WORD).count() == 0
    at = K.write_store(none, BYTE, 0, fresh_path(spark, "t"))
    assert K.read_digests(spark, at).count() == 0


def test_cuts_move_with_the_content():
    rng = random.Random(1)
    ids = np.array([rng.randrange(50_000) for _ in range(20_000)], "<u4")
    whole = {ids[s:e].tobytes() for s, e in zip([0, *K.cuts(ids)[:-1]], K.cuts(ids), strict=True)}
    late = np.concatenate((np.array([1, 2, 3], "<u4"), ids))
    again = {late[s:e].tobytes() for s, e in zip([0, *K.cuts(late)[:-1]], K.cuts(late), strict=True)}
    assert len(whole & again) > 0.8 * len(whole)
    assert all(e - s <= K.MOST for s, e in zip([0, *K.cuts(ids)[:-1]], K.cuts(ids), strict=True))
