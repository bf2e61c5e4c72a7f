import random
import re

import numpy as np

from tests.llm.cases import AWKWARD, documents, prose
from vigil.llm import cosine_tiles as E
from vigil.llm import edit_match as M
from vigil.llm import near_dup as N
from vigil.llm.components import components


def shingle_sets(rows):
    out = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute(rows):
    """(doc_id, n_shingles, component_id) of distinct ids; rows with one id must hold one text."""
    sets = shingle_sets(rows)
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(i), find(rows[b][0])
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


def variants(seed, n):
    rng, base = random.Random(seed), prose(seed, 80).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = [*variants(1, 14), *variants(2, 8), "few words", "Few  words", prose(9, 30)]
    rows = [*AWKWARD, *[(100 + i, t) for i, t in enumerate(texts)]]
    for block in (N.BLOCK, 4):
        got = N.near_duplicates(documents(spark, rows), block=block).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_group_stays(spark):
    rows = [*AWKWARD, *[(100 + i, t) for i, t in enumerate(variants(3, 9))]]
    docs = documents(spark, rows)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted({c for _, _, c in brute(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert N.near_duplicates(documents(spark, [])).count() == 0


def test_posterior_bound_keeps_true_links():
    # the chance that a pair at the threshold agrees in fewer values than the bound is about MISS
    rng = np.random.default_rng(1)
    for n in (24, 72, 144):
        agree = rng.binomial(n, 0.85, 200_000)
        assert (agree < N.least_agreement(n)).mean() < 1e-4


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    up = list(range(200))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b and True} | {x: find(x) for x in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows, n = [], 0
    for k in range(90):
        v = base[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])
        rows.append((n, v.astype("f4").tolist(), k % 2, "extra"))
        n += 1
    rows += [(200, None, 1, ""), (201, [0.0] * 16, 1, ""), (202, [float("nan")] * 16, 1, ""), (203, [None] * 16, 1, ""), (204, rows[0][1], None, ""), (205, rows[0][1], 0, ""), (206, rows[0][1], 0, ""), (207, [1.0, 2.0], 0, ""), (208, [2.0, 4.0], 0, ""), (209, [], 0, ""), (210, [float("inf")] * 16, 0, ""), (211, [1e-30] * 16, 0, ""), (212, [1e30] * 16, 0, "")]
    up, deg = {r[0]: r[0] for r in rows}, dict.fromkeys((r[0] for r in rows), 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def fit(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, dtype="f4").astype(float), lab) for i, v, lab, _ in rows if fit(v) and lab is not None]
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                deg[i] += 1
                deg[j] += 1
                s, t = find(i), find(j)
                up[max(s, t)] = min(s, t)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    for tile in (E.TILE, 8):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, tile=tile).collect())
        assert got == [(i, deg[i], find(i), find(i) == i) for i in sorted(deg)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_vectors_that_share_an_id_link_by_themselves(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_tiles_that_lie_apart_do_not_meet(spark):
    rows = [("a", k, k / 4, k / 4 + 0.1) for k in range(6)]
    tiled = spark.createDataFrame([(lab, t, x) for lab, t, lo, hi in rows for x in (lo, hi)], "label string, tile int, lead double")
    met = {r.tile: set(r.others) for r in E._meetings(tiled, 0.93).collect()}
    for _, t, lo, hi in rows:
        assert met[t] == {u for _, u, low, high in rows if max(lo - high, low - hi, 0) ** 2 <= 2 - 2 * 0.93 + 1e-9}
    assert max(map(len, met.values())) < 6


def test_edit_matches_within_budget(spark):
    rng = random.Random(5)
    items = [(i, prose(50 + i, 25)) for i in range(12)] + [(90, None), (91, ""), (92, "short")]
    rows = list(AWKWARD)
    for i, t in items[:12]:
        s, k = list(M.normal(t).decode()), M.budget(len(M.normal(t)))
        for _ in range(k):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["q"], [s[p], "q"]])
        rows.append((300 + i, prose(i, 30) + ". " + "".join(s).upper() + ", " + prose(i + 1, 30)))
    rows.append((400, prose(77, 500)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (M.BLOCK_BYTES, 500):
        got = {(r.doc_id, r.item_id) for r in M.leaks(documents(spark, rows), bench, block_bytes=size).collect()}
        assert got == {(300 + i, i) for i in range(12)}
        kept = M.keep_unleaked(documents(spark, rows), bench, block_bytes=size)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if not 300 <= i < 312)


def test_items_without_id_match(spark):
    bench = spark.createDataFrame([(None, prose(60, 25)), (None, None), (None, ""), (7, prose(61, 25))], "item_id long, text string")
    rows = [(1, prose(1, 30) + " " + prose(60, 25)), (2, prose(61, 25)), (3, prose(2, 60)), (4, None)]
    for size in (M.BLOCK_BYTES, 100):
        got = sorted(((r.doc_id, r.item_id) for r in M.leaks(documents(spark, rows), bench, block_bytes=size).collect()), key=str)
        assert got == [(1, None), (2, 7)]
        assert sorted(r.doc_id for r in M.keep_unleaked(documents(spark, rows), bench, block_bytes=size).collect()) == [3, 4]


def test_search_equals_brute_force(spark):
    rng = random.Random(12)
    items = [(k, prose(900 + k, 9 + k)) for k in range(6)] + [(6, "short item of text"), (7, "x" * 300)]
    docs = []
    for i in range(40):
        text = list(prose(i, 20) + " " + items[i % 8][1] + " " + prose(500 + i, 20))
        at = len(prose(i, 20)) + 1
        for _ in range(rng.randrange(9)):
            text[at + rng.randrange(len(items[i % 8][1]))] = rng.choice("abcxyz ")
        docs.append((i, "".join(text)))

    def distance(item, text):
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in text:
            prev, row = row, [0]
            for j, x in enumerate(item, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != c)))
            best = min(best, row[-1])
        return best

    want = set()
    for d, t in docs:
        for k, item in items:
            n = M.normal(item)
            e = distance(n, M.normal(t))
            if e <= M.budget(len(n)):
                want.add((d, k, e))
    df = spark.createDataFrame(items, "item_id long, text string")
    for size in (M.BLOCK_BYTES, 200):
        got = {(r.doc_id, r.item_id, r.edits) for r in M.leaks(documents(spark, docs), df, block_bytes=size).collect()}
        assert got == want and len(want) > 15


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(200):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        got = M.best_end(a, M.masks(a), t, len(a))
        assert (got[0] if got else len(a)) == min(row[1:], default=len(a))
