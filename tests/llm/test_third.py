"""Operators 11 to 13 against plain implementations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import AWKWARD, documents, prose
from vigil.llm import cross_align as C
from vigil.llm import inner_blocks as B
from vigil.llm import resample as R

LONG = " ".join(prose(k, 400) for k in range(40)) + "w" * 3_000 + " Ünïcödé " * 500
TEXTS = [*AWKWARD, (20, prose(1, 300)), (21, "  two blanks ahead and behind  "), (22, "tab\tand\r\nline  end \n"), (23, "▁ mark"), (24, LONG), (25, "ﬁ ｄ 漢字 🙂🙂 é"), (26, " "), (None, "no id here at all"), (27, "<s> </s> <0x41> <unk> <|endoftext|>")]


def brute_alignment(rows):
    a, b = C.ByteSide(C.byte_path()), C.PieceSide(C.piece_path())
    per, count = [], Counter()
    for i, t in rows:
        t = t or ""
        ids_a = a.tok.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.sp.encode(t, num_threads=1) if t else []
        raw = b" " + t.encode()
        if any(b"".join(s.bytes[x] for x in ids) != raw for s, ids in ((a, ids_a), (b, ids_b))):
            ids_a = ids_b = []
        spans = []
        for s, ids in ((a, ids_a), (b, ids_b)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(s.bytes[x])))
                at = out[-1][1]
            spans.append(out)
        found, k = [], 0
        for x, (s, e) in enumerate(spans[0]):
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                found.append((ids_a[x], ids_b[j]))
                j += 1
        both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, mine = [], []
        for s, ids in zip(spans, (ids_a, ids_b)):
            mine.append(defaultdict(list))
            for (_, e), x in zip(s, ids):
                mine[-1][min(y for y in both if y >= e)].append(x)
        for e in sorted(both):
            groups.append(",".join(map(str, mine[0][e])) + "|" + ",".join(map(str, mine[1][e])))
        count.update(found)
        per.append((i, ids_a, ids_b, groups, found))
    highest = defaultdict(int)
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return sorted(str((i, len(x), len(y), len(g), len(f), sum(count[p] == highest[p[1]] for p in f), sum(count[p] for p in f), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")) for i, x, y, g, f in per)


SHORT_TEXTS = [(i, t[:4_000] if t else t) for i, t in TEXTS]


@pytest.mark.parametrize("limits", [{}, {"block": 600, "window": 50, "held": 64, "share": 40}])
def test_alignment_equals_brute_force(spark, limits):
    got = C.aligned(documents(spark, SHORT_TEXTS), C.byte_path(), C.piece_path(), **limits)
    rows = sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in got.collect())
    assert rows == brute_alignment(SHORT_TEXTS)


def test_units_equal_the_library():
    b = C.PieceSide(C.piece_path())
    assert b.words
    texts = [t for _, t in TEXTS if t]
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode(texts)] == [b.sp.encode(t, num_threads=1) for t in texts]
    a = C.ByteSide(C.byte_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in a.encode(texts)] == [e.ids for e in a.tok.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_a_posting_holds_more_than_16_bits():
    n = 200_001
    rows = list(C._postings(7, 3, np.r_[np.full(n, 2), 0], np.full(n + 1, 5), np.full(n + 1, 9)))
    payload = [p for r in rows for p in r.column("payload").to_pylist() if p]
    ids, doc, m = np.frombuffer(payload[0], "<u2").reshape(3, -1)
    assert set(ids.tolist()) == {5} and m[doc == 2].sum() == n and m[doc == 0].sum() == 1
    assert [c for r in rows for c in r.column("c").to_pylist() if c] == [[n + 1]]


def test_alignment_of_an_empty_table(spark):
    assert C.aligned(documents(spark, []), C.byte_path(), C.piece_path()).count() == 0


# resampling


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(f.encode()) % 10_000 for f in [*w, *[f"{x} {y}" for x, y in zip(w, w[1:])]]]


def brute_draw(rows, target):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(plain_features(x)[1])
    for x in target:
        t.update(plain_features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        w, f = plain_features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


def test_draw_equals_brute_force(spark):
    rows = [*TEXTS, *[(100 + k, prose(k, 15 + k)) for k in range(40)], (None, prose(3, 60))]
    target = [prose(5, 50), prose(9, 30), None, "", "Ünïcödé marks"]
    bench = spark.createDataFrame([(x, "extra") for x in target], "text string, doc_id string")
    got = R.resampled(documents(spark, rows), bench).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in got) == brute_draw(rows, target)
    docs = documents(spark, [r for r in rows if r[0] not in (9, None)])
    drawn = R.draw(docs, bench)
    assert drawn.columns == docs.columns
    assert drawn.count() == sum(r.rank is not None for r in R.resampled(docs, bench).collect())


def test_draw_of_empty_tables(spark):
    bench = spark.createDataFrame([], "text string")
    assert R.resampled(documents(spark, []), bench).count() == 0
    got = R.resampled(documents(spark, TEXTS), bench).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in got) == brute_draw(TEXTS, [])


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_features_of_chunks(chunk):
    texts = ["", None, "a", "b", "Äb c1 D", "x" * 500 + " y", "", "…", "é" * 60, *[prose(k, 40) for k in range(5)], ""]
    raw, begins = R._buffer(pa.array(texts, pa.string()).slice(0))
    got = defaultdict(Counter)
    for _, of, buckets in R.features(raw, begins, chunk):
        for d, b in zip(of.tolist(), buckets.tolist()):
            got[d][b] += 1
    assert got == {k: Counter(plain_features(t)[1]) for k, t in enumerate(texts) if plain_features(t)[1]}
    raw, begins = R._buffer(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert sum(len(b) for _, _, b in R.features(raw, begins, chunk)) == sum(len(plain_features(t)[1]) for t in texts)


# neighbours


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=dim) * spread).tolist()) for k in range(n)]


def brute_neighbours(rows, k=20, every=20):
    good = [(i, [x + 0.0 for x in v], n) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v, n in good:
        if i % every:
            continue
        near = []
        for j, w, m in good:
            if m != n and len(w) == len(v):
                s = 0.0
                for x, y in zip(v, w):
                    s += x * y
                near.append((-s, j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [(B.LEAST, B.MOST), (8, 16)])
def test_neighbours_equal_brute_force(spark, block):
    rows = vectors(1, 150, 8)
    rows += [(1000 + k, rows[3][1]) for k in range(70)]  # copies, queries among them
    rows += [(2000 + k, [float((k >> b) & 1) - 0.5 * (k % 3) for b in range(8)]) for k in range(60)]  # ties of different vectors
    rows += [(20, rows[20][1]), (40, rows[7][1]), (3000, None), (3020, []), (3040, [0.0] * 8), (3060, [float("nan")] * 8), (3080, [None] + [1.0] * 7), (3100, [float("inf")] * 8), (None, [1.0] * 8), (3120, [-0.0, 1.0] * 4), (3121, [0.0, 1.0] * 4)]
    rows += [(4000 + k, [1.0 + k, 2.0, -3.0]) for k in range(25)] + [(5000, [7.0])]
    rows += [(6000, [1e150] * 8), (6020, [1e-300] * 8), (6001, [-1e150, 1e140] * 4)]
    random.Random(1).shuffle(rows)
    assert result(B.neighbours(table(spark, rows), block=block)) == brute_neighbours(rows)


def test_few_or_no_neighbours(spark):
    assert B.neighbours(table(spark, [])).count() == 0
    rows = vectors(2, 5, 4)
    assert result(B.neighbours(table(spark, rows))) == brute_neighbours(rows)
    assert result(B.neighbours(table(spark, rows[:1]))) == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1e-6, 1.0, 1e6):
        x, y = rng.normal(size=(60, 24)) * scale, rng.standard_cauchy(size=(80, 24))
        q, c = B.Codes(x), B.Codes(y)
        low, high = B.bounds(q, slice(0, 60), c, slice(0, 80))
        true = (x @ y.T) / q.top[:, None]
        assert (low <= true).all() and (true <= high).all()
        assert np.median(high - low) < 0.2 * np.abs(true).max()
