"""Signatures in batches equal plain ones, whatever is remembered and however long a text is."""

import hashlib
import random
from collections import Counter

from tests.test_document_chain import documents, signature
from vigil.operators import datasets as D
from vigil.operators import minhash as M


def test_small_memory_and_small_steps_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "ab", "abcd", "ab", "abcde", "".join(rng.choice("abc \U0001f600é") for _ in range(700)), "x" * 50, "".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(9000)).lower()]
    monkeypatch.setattr(M, "PLACES", 64)
    monkeypatch.setattr(M, "GATHERED", 16)
    want = [signature(t) if t else [0] * 64 for t in texts[:-1]]
    small = M.Memory(64, 100)
    assert M.signatures(texts[:-1], 5, small).tolist() == want and len(small.row) <= 100
    monkeypatch.setattr(M, "PLACES", 1 << 18)
    assert M.signatures(texts, 5, M.Memory(64)).tolist() == [*want, signature(texts[-1])]


def test_shingles_are_never_rows(spark):
    df = D.signatures(documents(spark, [(1, "some text"), (2, None)]).selectExpr("doc_id AS id", "text"))
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: list(r.sig) for r in df.collect()} == {1: signature("some text"), 2: [0] * 64}


def test_many_are_hashed_at_a_time():
    raw = [s.encode() for s in ("", "abcde", "a\u00e9\u4e00\U0001f600b", "x" * 52, "x" * 53, "x" * 70)] + [f"{i:05}".encode() for i in range(1_200)]
    want = [[int(hashlib.md5(salt + r).hexdigest()[:15], 16) for salt in (b"7:", b"63:")] for r in raw]
    assert M.hashed(raw, [b"7:", b"63:"]).tolist() == want


def test_a_full_memory_keeps_what_comes_often():
    memory, often = M.Memory(4, 100), [f"often{i}" for i in range(20)]
    for i in range(30):
        at = memory.rows([*often, *[f"once{i}-{k}" for k in range(20)]])
        assert len(memory.row) <= 100 and (memory.values[at[:20]] == M.hashed([s.encode() for s in often], memory.salts)).all()
        assert not i or set(often) <= set(memory.row)
    asked, hashed = [], M.hashed
    M.hashed = lambda raw, salts: asked.extend(raw) or hashed(raw, salts)
    try:
        for i in range(30):
            memory.rows([*often, *[f"later{i}-{k}" for k in range(20)]])
    finally:
        M.hashed = hashed
    assert len(asked) == 600


def test_common_bands_are_dealt_out_and_lose_no_pair(spark, monkeypatch):
    """Rows that share three bands alone never meet; what shares more meets in blocks."""
    rng = random.Random(5)
    some = lambda n: [rng.randrange(1 << 60) for _ in range(n)]
    common, rows = some(12), []
    for _ in range(300):
        rows.append(common + some(52))
    base = some(64)
    for i in range(90):  # near each other, or just not
        sig = list(base)
        for k in rng.sample(range(64), rng.choice([3, 6, 7, 12])):
            sig[k] = rng.randrange(1 << 60)
        rows.append(sig)
    for i in range(40):  # 12 or 13 values differ from a row
        sig = list(rows[i])
        for k in rng.sample(range(64), 12 + i % 2):
            sig[k] += 64  # the same last bits
        rows.append(sig)
    sigs = spark.createDataFrame(list(enumerate(rows)), "id long, sig array<long>")
    monkeypatch.setattr(D, "BLOCK", 16)
    kept = D.rare_bands(sigs.withColumnRenamed("id", "rep")).collect()
    alone = {r.rep for r in kept if 40 <= r.rep < 300}
    assert not alone and max(Counter((r.band, r.key, r.block) for r in kept).values()) < 40
    want = {(a, b): v for a in range(len(rows)) for b in range(a + 1, len(rows)) if (v := sum(x == y for x, y in zip(rows[a], rows[b])) / 64) > 0.8}
    got = D.near_pairs(sigs).collect()
    assert len(got) == len(want) > 100 and {(r.a, r.b): r.agreement for r in got} == want
