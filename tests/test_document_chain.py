"""The near-duplicate chain over documents equals brute force over whole texts."""

import hashlib
import random

from vigil import catalogue

QUERIES = ("doc_minhash_signature", "doc_near_dup_pairs", "doc_clusters", "doc_split_assign", "doc_leakage_pairs")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "kappa", "sigma", "omega"]) + str(rng.randrange(50)) for _ in range(n))


def texts():
    rng, out = random.Random(8), []
    for i in range(6):
        base = prose(i, 60)
        out += [base, base, base + " end", base.replace("1", "one", 1).upper(), prose(100 + i, 60)]
        cut = list(base)
        for _ in range(rng.randint(1, 6)):
            cut[rng.randrange(len(cut))] = "#"
        out.append("".join(cut))
    return [(1000 + i, t) for i, t in enumerate(out)] + [(1, None), (2, ""), (3, "abc"), (4, "ABC")]


def signature(text):
    low = text.lower()
    some = {low[i : i + 5] for i in range(len(low) - 4)} if len(low) >= 5 else {low} if low else set()
    return [min(int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:15], 16) for s in some) if some else 0 for i in range(64)]


def test_chain_over_documents(spark, tmp_path):
    rows = texts()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    sigs, pairs, clusters, split, leaks = (catalogue.QUERIES[n](spark, str(tmp_path)).collect() for n in QUERIES)
    want = {i: signature(t) for i, t in rows if t is not None}
    assert {r.id: list(r.sig) for r in sigs} == want
    agree = {(a, b): sum(x == y for x, y in zip(want[a], want[b])) / 64 for a in want for b in want if a < b}
    near = {p: round(v, 6) for p, v in agree.items() if v > 0.8}
    rep = {i: min(j for j in want if want[j] == want[i]) for i in want}
    given = {(a, b): v for (a, b), v in near.items() if rep[a] == a and (rep[b] == b or rep[b] == a)}
    assert len(near) > len(given) > 20 and {(r.a, r.b): r.agreement for r in pairs} == given
    up = {i: i for i in want}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    assert {r.id: r.cluster for r in clusters} == {i: find(i) for i in want}
    home = {r.id: r.split for r in split}
    assert home.keys() == want.keys() and all(home[i] == home[find(i)] for i in want) and set(home.values()) == {"train", "val", "test"}
    assert leaks == []
