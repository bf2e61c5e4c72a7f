import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import AWKWARD, documents, prose
from vigil.llm import hidden_markov as H
from vigil.llm import lang_mixture as L
from vigil.llm import toxic_crf as X
from vigil.llm.differencing import assign, difference, write_shards
from vigil.llm.url_cascade import CHUNK, RULES, build, judge

FR = "le chat de la maison est une belle petite fleur dans le jardin avec mon ami "
EN = "the cat of this house with some other friends that were there and then "


def test_languages(spark):
    rows, langs = list(AWKWARD), {}
    for i in range(60):
        rows.append((100 + i, (FR if i % 2 else EN) * (1 + i % 3)))
        langs[100 + i] = "fr" if i % 2 else "en"
    langs |= {i: None for i, _ in AWKWARD}
    rows.append((500, FR * 4 + EN * 2))
    langs[500] = None
    got = {r.doc_id: r for r in L.identify(documents(spark, rows, langs)).collect()}
    assert all(got[i].lang_pred == k for i, k in langs.items() if k)
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert got[500].lang_pred == "fr" and set(got[500].langs) == {"fr", "en"}
    assert L.identify(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in L.identify(documents(spark, [(1, "text")], {1: None})).collect()} == {"und"}


def test_pieces_of_a_long_text_give_its_segments():
    rng = np.random.default_rng(1)
    model = rng.normal(size=(L.BUCKETS, 3)).astype(np.float32)
    for n in (1, 63, 64, 65, 1_000, 4_096):
        raw = bytes(rng.integers(97, 123, n, dtype=np.uint8))
        h = L.buckets(raw)
        want = np.stack([model[h[s : s + L.SEGMENT]].sum(axis=0) for s in range(0, n, L.SEGMENT)])
        assert np.allclose(L.segments(raw, model, 256), want, atol=1e-3)
        assert np.array_equal(L.counted(raw, 256), np.bincount(h, minlength=L.BUCKETS))


def test_prediction_equals_a_plain_mixture(spark):
    rng = np.random.default_rng(2)
    model = np.log(rng.dirichlet(np.ones(L.BUCKETS), 3).T).astype(np.float32)
    for text in (FR * 2 + EN, EN, FR * 30):
        raw = text.encode()
        h = L.buckets(raw)
        ll = [[float(sum(model[b, k] for b in h[s : s + L.SEGMENT])) for k in range(3)] for s in range(0, len(raw), L.SEGMENT)]

        def value(some, pi):
            return sum(math.log(sum(p * math.exp(row[k] - max(row)) for p, k in zip(pi, some))) + max(row) for row in ll)

        def em(some):
            pi = [1 / len(some)] * len(some)
            for _ in range(L.ROUNDS):
                resp = [[p * math.exp(row[k] - max(row)) for p, k in zip(pi, some)] for row in ll]
                resp = [[x / sum(r) for x in r] for r in resp]
                pi = [max(sum(r[j] for r in resp) / len(resp), 1e-9) for j in range(len(some))]
                pi = [p / sum(pi) for p in pi]
            return value(some, pi), pi

        some = [max(range(3), key=lambda k: sum(r[k] for r in ll))]
        best, pi = em(some)
        while len(some) < 3:
            (gain, got), k = max(((em([*some, k]), k) for k in range(3) if k not in some), key=lambda t: t[0][0])
            if gain - best <= L.PENALTY:
                break
            some, best, pi = [*some, k], gain, got
        (lang, score, langs), = L.predict(["a", "b", "c"], model, [raw])
        assert langs == ["abc"[k] for k in some] and lang == "abc"[some[pi.index(max(pi))]]
        if len(some) > 1:
            assert abs(score - max(pi)) < 1e-3


def test_mixture_finds_proportions():
    ll = np.log(np.array([[0.9, 0.1]] * 30 + [[0.1, 0.9]] * 10))
    _, pi = L.mixture(ll, [0, 1])
    assert 0.7 < pi[0] < 0.95


def test_all_languages_of_a_text_are_found():
    ll = np.full((70, 9), -60.0)
    for k in range(7):
        ll[10 * k : 10 * k + 10, k] = -20.0
    some, pi, _ = L.infer(ll)
    assert sorted(some) == list(range(7)) and np.allclose(pi, 1 / 7, atol=0.01)


def test_toxicity(spark):
    bad = ["grobli", "mukzer", "fantop"]
    rows, labels = list(AWKWARD), []
    for i in range(240):
        words = prose(i, 20).split()
        if i % 4 == 0:
            words[5], words[9] = bad[i // 4 % 3], bad[(i // 4 + 1) % 3] + "x"
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, int(i % 4 == 0), None))
    labels += [(1000, None, "x"), (None, 1, "x"), (77777, 1, "x")]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in X.tag(docs, lab).collect()}
    truth = {1000 + i: int(i % 4 == 0) for i in range(240)}
    assert sum(got[i].predicted == y for i, y in truth.items()) >= 236
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    text = dict(rows)[1000]
    assert {text[s.start : s.end] for s in got[1000].spans} >= {"grobli"}
    kept = X.keep_clean(docs, lab)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if got[i].predicted == 0)
    assert {r.predicted for r in X.tag(docs, lab.where("toxic = 0")).collect()} == {0}
    assert X.tag(documents(spark, []), lab).count() == 0


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    t = rng.normal(size=(2, 2))
    ems = [rng.normal(size=n) for n in (5, 1, 0, 3)]
    for e, got in zip(ems, X.marginals(ems, t), strict=True):
        for k in range(len(e)):
            p = [0.0, 0.0]
            for tags in itertools.product((0, 1), repeat=len(e)):
                p[tags[k]] += math.exp(sum(e[i] * y for i, y in enumerate(tags)) + sum(t[a, b] for a, b in zip(tags, tags[1:])))
            assert abs(got[k] - math.log(p[1] / p[0])) < 1e-9


def test_language_model(spark):
    rows = [*AWKWARD, *[(600 + i, prose(i % 7, 40 + i)) for i in range(40)]]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter()
    words = lambda t: (t or "").encode().lower().split() + [None]
    for i, t in rows:
        if i in train:
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    for r in H.score_texts(documents(spark, rows), rounds=2).collect():
        w = words(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, r.doc_id not in train)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert r.score < 0
    assert H.score_texts(documents(spark, [])).count() == 0
    alone = next(i for i in range(1, 999) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = H.score_texts(documents(spark, [(alone, "a b")])).first()
    assert (r.train_tokens, r.base_score, r.score) == (0, 0.0, 0.0)


def test_most_frequent_words_are_exact_in_ties(spark):
    rows = [(bytearray(f"w{i:03}".encode()), 5 if i < 300 else 9) for i in range(310)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    want = sorted(((bytes(w), c) for w, c in rows), key=lambda x: (-x[1], x[0]))[:40]
    assert H.frequent(counts, 40) == want and H.frequent(counts, 40, asked=20) == want
    assert H.frequent(counts.limit(0)) == []


def test_whole_score_equals_a_plain_model(spark):
    rows = [(i, prose(i, 12 + i % 5)) for i in range(40)] + [(50, None), (51, "unseen words here")]
    got = {r.doc_id: r for r in H.score_texts(documents(spark, rows), rounds=2).collect()}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for _, t in train for w in (t or "").lower().encode().split())
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: H.TOP]]
    cls = lambda w: top.index(w) if w in top else H.TOP + zlib.crc32(w) % H.HASHED
    tokens, distinct = np.zeros(H.CLASSES, int), np.zeros(H.CLASSES, int)
    for w, c in count.items():
        tokens[cls(w)] += c
        distinct[cls(w)] += 1
    tokens[H.END] = len(train)
    raw = lambda t: np.array([*map(cls, (t or "").lower().encode().split()), H.END], "<u2").tobytes()
    model, _ = H.baum_welch(spark.createDataFrame([(bytearray(raw(t)),) for _, t in train], "classes binary"), tokens, 2)
    for i, t in rows:
        x, a, score = np.frombuffer(raw(t), "<u2"), model.first, 0.0
        for s, k in enumerate(x):  # not scaled: these texts are short
            a = (a if s == 0 else a @ model.move) * model.emit[:, k]
        score = math.log10(a.sum())
        for w in (t or "").lower().encode().split():
            k = cls(w)
            score += 0.0 if k < H.TOP else math.log10((count[w] + 1) / (tokens[k] + distinct[k] + 1))
        assert abs(got[i].score - score) < 1e-6


def test_forward_is_exact_and_training_gains(spark):
    rng = np.random.default_rng(4)
    m = H.Model.start(np.ones(H.CLASSES))
    seq = rng.integers(0, H.CLASSES, 4)
    total = 0.0
    for path in itertools.product(range(H.STATES), repeat=4):
        p = m.first[path[0]] * m.emit[path[0], seq[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[b, o]
        total += p
    got = H.forward(m, [seq.astype("<u2").tobytes(), seq[:1].astype("<u2").tobytes()])
    assert abs(got[0] - math.log10(total)) < 1e-9
    docs = [np.array([5, 9] * 40 + [H.END], "<u2").tobytes(), np.array([700, 701, 702] * 30 + [H.END], "<u2").tobytes()] * 4
    df = spark.createDataFrame([(bytearray(d),) for d in docs], "classes binary")
    _, lls = H.baum_welch(df, np.ones(H.CLASSES), 5)
    assert all(b > a for a, b in zip(lls, lls[1:]))


def test_shards(spark):
    rows = [*AWKWARD, *[(700 + i, prose(i % 60, 5 + i % 37)) for i in range(300)]]
    for got in (assign(documents(spark, rows), 6).collect(),):
        text = dict(rows)
        groups: dict = {}
        for r in got:
            t = text[r.doc_id]
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None)
            groups.setdefault(t, set()).add(r.shard)
        assert len(got) == len(rows) and all(len(s) == 1 for s in groups.values())
        for s in range(6):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    assert assign(documents(spark, [])).count() == 0


def test_differencing_is_even_and_a_partition():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1_000, 500)
    parts = np.zeros((500, 8), dtype=np.int64)
    parts[:, 0] = sizes
    sums, where = difference(parts)
    assert np.bincount(where[:, 0], weights=sizes, minlength=8).astype(int).tolist() == sums.tolist()
    assert sums.max() - sums.min() <= 5


def test_many_rounds_of_buckets(spark):
    from vigil.llm.differencing import assign_groups

    sizes = np.random.default_rng(6).integers(10, 500, 400)
    groups = spark.createDataFrame([(bytearray(i.to_bytes(4, "big")), int(s)) for i, s in enumerate(sizes)], "key binary, size long")
    got = {int.from_bytes(r.key, "big"): r.shard for r in assign_groups(groups, 5, bucket=20, fan=3).collect()}
    sums = np.bincount([got[i] for i in range(400)], weights=sizes, minlength=5)
    assert len(got) == 400 and sums.max() - sums.min() < 0.01 * sums.mean()


URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/7x?q"), (5, "http://com/en/"), (6, "https://example.net/de/8/1#f"), (7, "https://example.net/de/9"), (8, "http://xorg/es/"), (9, "ftp://a.org/es/x"), (9, "ftp://a.org/es/x"), (10, "a://b://c/en/"), (11, "http://example.com"), (12, "http://notexample.com/en/7"), (13, "http:///en/")]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in judge(df, RULES).collect())
    assert got == sorted((i, *[x or "" for x in plain(u)]) for i, u in URLS)
    long = [("block", "com", "/en/very/long"), ("allow", "example.com", "/en/")]
    one = spark.createDataFrame([(1, "http://example.com/en/very/long/x")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in judge(one, long).collect()] == [("com/en/very/long", "block")]
    assert judge(df.limit(0), RULES).count() == 0


@pytest.mark.parametrize(("n", "like", "chunks"), [(4_000, "%7", 1), (60_000, "%", 3), (100_000, "%77", 1)])
def test_cascade_is_exact_on_its_universe(spark, n, like, chunks):
    universe = spark.range(n).selectExpr("concat('k', id) AS key")
    inside = f"(key LIKE '{like}' AND key NOT LIKE '%3')"
    c = build(universe, universe.where(inside))
    assert len(c.levels[0].bitmap) > (chunks - 1) * CHUNK
    wrong = universe.select("key", c.listed(universe["key"]).alias("is")).where(f"is <> {inside}")
    assert wrong.count() == 0


def test_shard_files_hold_every_row(spark, tmp_path):
    rows = [*AWKWARD, (None, "no id"), (9, "another text of nine"), (None, "no id")]
    write_shards(documents(spark, rows), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(rows, key=key)
    assert back.groupBy("text").agg({"shard": "min"}).join(back.groupBy("text").agg({"shard": "max"}), "text").where("`min(shard)` <> `max(shard)`").count() == 0


def test_planes():
    for top in (10, 1 << 17, 1 << 25):
        x = np.array([0, 1, top - 1, 5], dtype=np.uint32)
        assert H.from_planes(H.planes(x), 4).tolist() == x.tolist()
    assert len(H.from_planes(H.planes(np.zeros(0, np.uint32)), 0)) == 0
