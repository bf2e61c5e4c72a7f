"""Plug-ins, SQL functions, training, schemas, archives, aligned files and streams."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import sql
from vigil.operators import labels as Lb
from vigil.operators import plugins as P
from vigil.operators import rows as R
from vigil.operators import training as Tr
from vigil.plans import verdict as V
from vigil.sources import aligned, archive, pack, rules, schema
from vigil.sources import messages as S
from vigil.streaming import verdicts as St

MESSAGE = "msg_id long, cust_id long, nation_id int, segment string, sender_hint string, text string"
ROWS = [(1, 1, 1, "A", None, "NorthPay http://northpay-1.xyz/login"), (2, 1, 1, "A", "AB-NRTHPY", "NorthPay: account ready"), (3, 1, 1, "A", "9876543210", "Zen Bank: hello"), (4, 1, 1, "A", None, "won a prize, pay the processing fee"), (5, 1, 1, "A", None, ""), (6, 1, 1, "A", None, None)]


def test_plugins_give_the_plans_verdict(spark):
    df = spark.createDataFrame(ROWS, MESSAGE)
    plain = {r.msg_id: (r.verdict, r.confidence, r.score) for r in V.verdicts(df, 1.5).collect()}
    got = P.fused(P.orchestrated(df, {**P.built_in(), P.CLASSIFIER: P.model_plugin(1.5)})).collect()
    assert {r.msg_id: (r.verdict, r.confidence, r.score) for r in got} == plain
    assert all(list(r.scored) == ["CLASSIFIER", "PATTERN", "SENDER", "URL"] and not r.unavailable for r in got if r.msg_id != 6)
    assert [(u.id, u.reason) for r in got if r.msg_id == 6 for u in r.unavailable] == [("CLASSIFIER", "no weight")]  # a null text has no score


def test_a_failing_plugin_spoils_nothing(spark):
    df = spark.createDataFrame(ROWS, MESSAGE)
    plain = {r.msg_id: (r.verdict, r.confidence, r.score) for r in V.verdicts(df).collect()}

    def broken(text, hint):
        if text is None:
            raise ValueError()
        return {"weight": 1 / len(text) if "prize" not in text else "no number"}

    def missing(df, name):
        raise OSError("model is missing\nsecond line")

    for plugin in (P.guarded(broken), missing, lambda df, name: df.withColumn(name, F.col("no_such_column"))):
        got = {r.msg_id: r for r in P.fused(P.orchestrated(df, {**P.built_in(), P.CLASSIFIER: plugin})).collect()}
        failed = {k for k, r in got.items() if [u.id for u in r.unavailable] == [P.CLASSIFIER]}
        assert all(list(r.analyzers) == ["CLASSIFIER", "PATTERN", "SENDER", "URL"] for r in got.values())
        assert all((r.verdict, r.confidence, r.score) == plain[k] and P.CLASSIFIER not in r.scored for k, r in got.items() if k in failed)
        if plugin is missing:
            assert failed == set(plain) and got[1].unavailable[0].reason == "model is missing"
    got = {r.msg_id: r for r in P.fused(P.orchestrated(df, {**P.built_in(), P.CLASSIFIER: P.guarded(broken)})).collect()}
    reasons = {k: r.unavailable[0].reason for k, r in got.items() if r.unavailable}
    assert set(reasons) == {4, 5, 6} and reasons[6] == "ValueError" and "zero" in reasons[5]
    forced = P.fused(P.orchestrated(df.where("msg_id = 5"), {"OWN": P.guarded(lambda t, h: {"weight": 0, "forced": True, "evidence": [("OTP_SOLICITATION", 2)]})})).first()
    assert (forced.verdict, forced.confidence) == ("SCAM", "HIGH")


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "see http://u@a.northpay-1.co.in/x?y and www.b.net, Zen  Bank’s Ｆｕｌｌ"), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("said")
    r = spark.sql("SELECT registrable_domain('x.www.ck') a, registrable_domain('a.b.co.in') b, registrable_domain('10.0.0.1') c, registrable_domain('co.in') d, is_ip_literal('[::1]') e, squash_label('a-1_b') f, fold_label('rn00') g, norm_text(NULL) h FROM said WHERE id = 1").first()
    assert tuple(r) == ("www.ck", "b.co.in", None, None, True, "ab", "moo", None)
    assert [tuple(r) for r in spark.sql("SELECT id, u.ord, u.host, u.path FROM said, LATERAL extract_urls(t) u ORDER BY ord").collect()] == [(1, 0, "a.northpay-1.co.in", "/x?y"), (1, 1, "www.b.net", None)]
    got = spark.sql("SELECT id, b.brand_id, b.matched FROM said LEFT JOIN LATERAL extract_brands(t) b ON true").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, "zenbank", "Zen  Bank"), (1, "northpay", "northpay"), (2, None, None), (3, None, None)]))


def plain_training(rows, rounds, ids):
    """The same steps on one machine, dense."""
    w = np.zeros((ids + 1, Tr.OUT))
    m, v, best, history = np.zeros_like(w), np.zeros_like(w), (-1.0, w), []
    x = np.zeros((len(rows), ids + 1))
    for r, (some, *_) in enumerate(rows):
        for i in some:
            x[r, i] += 1 / math.sqrt(len(some))
    x[:, 0] = 1
    y, cat, val = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    for k in range(1, rounds + 2):
        z = x @ w
        p, q = Tr._softmax(z[:, :2]), Tr._softmax(z[:, 2:])
        table = np.zeros((2, 2))
        np.add.at(table, (y[val], z[val, :2].argmax(axis=1)), 1)
        weight, n = np.where(y == 1, Tr.POSITIVE_WEIGHT, 1.0), (~val).sum()
        d = np.concatenate([(p - np.eye(2)[y]) * weight[:, None], q - np.eye(Tr.CATEGORIES)[cat]], axis=1)[~val]
        g = x[~val].T @ d / n
        if k > 1:
            history.append(Tr.macro_f1(table))
            if history[-1] > best[0]:
                best = (history[-1], w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w * (1 - Tr.DECAY) - Tr.STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return best[1], history


def test_training_equals_one_machine(spark, tmp_path):
    texts = ["prize won claim now", "claim your prize", "meeting at noon", "see you at noon", "won a prize today", "lunch today", "verify your account kyc", "kyc account blocked", "nice weather", "dinner at eight"]
    rows = [(f"{t} {k}", int(k % 10 in (0, 1, 4, 6, 7)), "LOTTERY_PRIZE" if k % 10 in (0, 1, 4) else "KYC_PHISHING" if k % 10 in (6, 7) else "NOT_SCAM", k >= 40) for k, t in enumerate(texts * 6)]
    rows += [(None, 1, "OTHER_SCAM", False), ("", 0, "NOT_SCAM", False), ("no label", None, "NOT_SCAM", False)]
    df = spark.createDataFrame(rows, "text string, label int, category string, is_val boolean").repartition(3)
    w, history = Tr.train(df, rounds=6, ids=64)
    data = [(r.ids, r.y, r.category, r.is_val) for r in Tr.packed(df, 64).collect()]
    want, scores = plain_training(data, 6, 64)
    assert len(data) == 60 and np.allclose(w, want, atol=1e-9) and np.allclose([h["val_macro_f1"] for h in history], scores)
    assert history[-1]["train_loss"] < history[0]["train_loss"] and max(scores) > 0.9
    folder = str(tmp_path / "model")
    Tr.write_model(spark, folder, w, 1.25, history)
    scored = Tr.scored_by(folder)(df.where("text <> ''").withColumn("normalized", F.lower("text")), None).select("label", "model.weight", "model.category").collect()
    assert np.mean([(r.weight >= 0.5) == bool(r.label) for r in scored if r.label is not None]) > 0.9
    with pytest.raises(Exception):  # noqa: B017  whatever a missing file raises
        Tr.read_model(spark, str(tmp_path / "none"))
    got = P.fused(P.orchestrated(spark.createDataFrame(ROWS, MESSAGE), {**P.built_in(), P.CLASSIFIER: P.model_plugin(None, Tr.scored_by(str(tmp_path / "none")))})).collect()
    assert all(len(r.unavailable) == 1 for r in got)


def test_temperature_is_the_optimum(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=4_000) * 3
    y = (rng.random(4_000) < 1 / (1 + np.exp(-z / 2.5))).astype(int)
    df = spark.createDataFrame([(int(a), 0.0, float(b)) for a, b in zip(y, z)] + [(None, 0.0, 1.0), (1, None, 2.0)], "y int, z0 double, z1 double")
    m = np.where(y == 1, z, -z)
    loss = lambda t: np.log1p(np.exp(-m / t)).mean()
    low, high = 0.05, 20.0
    for _ in range(200):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    assert abs(Lb.fit_temperature(df) - low) < 1e-4
    assert Lb.fit_temperature(df.limit(0)) == 1.0
    sure = spark.createDataFrame([(1, 0.0, 5.0), (0, 0.0, -5.0)], "y int, z0 double, z1 double")
    assert Lb.fit_temperature(sure) == Lb.COLDEST


def test_every_error_of_a_pack_is_listed(spark, tmp_path):
    docs = {k: json.loads(pack.minified(v)) for k, v in pack.documents(rules.BUILT_IN).items()}
    assert all(not schema.errors(v, schema.schemas({})[k]) or k == "patterns" for k, v in docs.items())
    docs["brands"]["brands"][2] |= {"id": "Bad Id", "aliases": [], "more": 1, "_remark": 2}
    docs["brands"]["brands"] += [{"id": 5}] * 9
    docs["patterns"]["patterns"][0] |= {"weight": 2, "severity": "LOUD", "lang": ["XX"], "category_hints": {"NONE": -1}}
    docs["folds"] |= {"distance": {"short_label_max_length": 0, "short_label_distance": True, "long_label_distance": 1.5}, "single_char_folds": {"ab": "xy"}}
    docs["shorteners"]["schema_version"] = True
    for k, v in docs.items():
        (tmp_path / pack.FILES[k]).write_text(json.dumps(v))
    got = {}
    for r in sorted(schema.violations(spark, str(tmp_path), pack.FILES, {"brands": 100}).collect(), key=lambda r: (r.file, r.ord)):
        got.setdefault(r.file, []).append((r.path, r.message))
    brands = got["banks.json"]
    assert brands[0] == ("/brands", "has fewer than 100 items") and ("/brands/2/id", "does not match ^[a-z][a-z0-9_]*$") in brands and ("/brands/2/more", "is unknown") in brands and ("/brands/2/aliases", "has fewer than 1 items") in brands
    order = [int(p.split("/")[2]) for p, _ in brands[1:]]
    assert order == sorted(order) and order[-1] == len(docs["brands"]["brands"]) - 1  # 10 comes after 9
    assert {p for p, _ in got["patterns.json"]} >= {"/patterns/0/weight", "/patterns/0/severity", "/patterns/0/lang/0", "/patterns/0/category_hints/NONE"}
    assert ("/distance/short_label_max_length", "is out of range") in got["typosquat.json"] and ("/distance/long_label_distance", "is no whole number") in got["typosquat.json"]
    assert ("/schema_version", "is not 1") in got["shorteners.json"]
    (tmp_path / pack.FILES["brands"]).write_text("{")
    assert [(r.path, r.message) for r in schema.violations(spark, str(tmp_path), {"brands": pack.FILES["brands"]}).collect()] == [("", "is no JSON")]


def test_suffix_list_sanity(spark, tmp_path):
    (tmp_path / "short.dat").write_text("// x\ncom\nco.in\n")
    assert sorted(r.message for r in schema.suffix_violations(spark, str(tmp_path / "short.dat")).collect()) == ["only 2 rules", "rule gov.in is missing", "section marker is missing"]
    (tmp_path / "whole.dat").write_text("// ===BEGIN ICANN DOMAINS===\nco.in\ngov.in\n" + "\n".join(f"t{k}" for k in range(1_000)))
    assert schema.suffix_violations(spark, str(tmp_path / "whole.dat")).count() == 0


def test_archives_say_what_they_are(spark, tmp_path):
    good = spark.createDataFrame([(2, "b.org"), (1, "a.com")], "rank long, domain string")
    archive.write_archive(spark, good, str(tmp_path / "good.zip"))
    rows, label = archive.ranked(spark, str(tmp_path / "good.zip"))
    assert label == archive.RANKED and sorted(map(tuple, rows.collect())) == [(1, "a.com"), (2, "b.org")]
    with zipfile.ZipFile(tmp_path / "odd.zip", "w") as z:
        z.writestr("x.csv", "1,A.com \n\nno comma\n3,nodot\n4,é.com\nx,c.d\n")
    rows, label = archive.ranked(spark, str(tmp_path / "odd.zip"))
    assert label == archive.RANKED and sorted(map(str, map(tuple, rows.collect()))) == ["(1, 'a.com')", "(None, 'c.d')"]
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("x.txt", "1,a.com")
    for name in ("bad.zip", "empty.zip", "none.zip"):
        rows, label = archive.ranked(spark, str(tmp_path / name))
        assert label == archive.UNAVAILABLE and rows.count() == 0
    assert archive.ranked(spark, str(tmp_path / "good.zip"), skip=True)[1] == archive.SKIPPED


def test_aligned_files(spark, tmp_path):
    rows = [(k, f"line {k}\nmore" if k % 3 else None, k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    aligned.write_aligned(df, str(tmp_path / "out"), "id")
    got = aligned.read_aligned(spark, str(tmp_path / "out")).orderBy("part", "line").collect()
    assert [(r.text, r.label) for r in got] == [((t or "").replace("\n", " "), str(y)) for _, t, y in rows]
    part = next((tmp_path / "out" / "labels").glob("part-*"))
    part.write_text(part.read_text() + "1\n")
    for crc in (tmp_path / "out" / "labels").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="differ"):
        aligned.read_aligned(spark, str(tmp_path / "out"))


def test_white_space(spark, tmp_path):
    texts = ["a", " ", "\t\n", "  ", "\x1c", "", None, " b "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in S.entered(df).collect()] == ["a", " b "]
    assert [r.text for r in S.shared(df).collect()] == ["a"] + [None] * 6 + [" b "]
    (tmp_path / "l.txt").write_text("one \n\t\n  two\t\n\x85three\x85\n")
    assert [r.text for r in S.from_lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two", "three"]
    (tmp_path / "c.csv").write_text('text\n"\t"\n" x "\n')
    assert [r.text for r in S.from_csv(spark, str(tmp_path / "c.csv"), "text").collect()] == ["x"]


def test_pruned_vocabulary(spark):
    docs = spark.createDataFrame([(1, "done. Stop, now déjà_vu ... x²")], "id long, text string")
    kept = spark.createDataFrame([("<unk>", 0), ("done", 1), (".", 2), ("stop", 3), ("Stop", 4), ("déjà_vu", 5), ("...", 6)], "token string, new_id int")
    got = [r.token_id for r in R.encoded(docs, kept, "<unk>").orderBy("pos").collect()]
    assert got[:7] == [1, 2, 4, 0, 0, 5, 6]


def test_gates(spark):
    rows = spark.createDataFrame([("uci_sms_spam_collection",), ("web",), (None,)], "source string")
    with pytest.raises(ValueError, match="None, web"):
        R.require_name_safe(rows)
    assert R.require_name_safe(rows, verified=True).count() == 3 and R.require_name_safe(rows.limit(1)).count() == 1


def _stream(spark, folder, rows):
    spark.createDataFrame([(i, h, t, s) for i, h, t, s in rows], "msg_id long, sender_hint string, text string, s long").withColumn("received_at", F.timestamp_seconds("s")).drop("s").repartition(3).write.mode("append").json(folder)
    return spark.readStream.schema("msg_id long, sender_hint string, text string, received_at timestamp").option("maxFilesPerTrigger", 2).json(folder)


def test_verdicts_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(r[0], r[4], r[5], 100 + r[0]) for r in ROWS]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    St.verdicts_stream(_stream(spark, str(tmp_path / "in"), rows), out, state).awaitTermination()
    plain = {r.msg_id: (r.verdict, r.score) for r in V.verdicts(spark.createDataFrame(ROWS, MESSAGE)).collect()}
    assert {r.msg_id: (r.verdict, r.score) for r in St.read_verdicts(spark, out).collect()} == plain
    more = [(7, None, "see bit.ly/a", 500)]
    St.verdicts_stream(_stream(spark, str(tmp_path / "in"), more), out, state).awaitTermination()  # goes on where it stopped
    got = [r.msg_id for r in St.read_verdicts(spark, out).collect()]
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]


def test_windows_and_alerts_of_a_stream(spark, tmp_path):
    rows = [(k, "9876543210", "Zen Bank: hello", 60 * k) for k in range(4)] + [(10, "9876543210", "Zen Bank: hello", 20_000), (11, "AB-ZENBNK", "Zen Bank: hello", 30)]
    one = _stream(spark, str(tmp_path / "in"), rows)
    St.alerts(one, str(tmp_path / "alerts"), str(tmp_path / "s1"), most=3).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "alerts")).collect()
    assert {r.sender_hint for r in got} == {"9876543210"} and max(r.n for r in got) <= 4
    St.start(St.counts_by_window(one), str(tmp_path / "windows"), str(tmp_path / "s2")).awaitTermination()
    n = {r.w.start.timestamp(): r.n for r in spark.read.parquet(str(tmp_path / "windows")).collect()}
    assert n == {0.0: 5}  # the last window is still open
