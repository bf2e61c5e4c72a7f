import json

import pytest

from vigil.operators import bloom
from vigil.operators import labels as L
from vigil.plans import verdict as V
from vigil.sources import pack as P


def write(folder, name, value):
    (folder / name).write_text(json.dumps(value))


def full(folder):
    write(folder, "banks.json", {"schema_version": 1, "_note": "x", "brands": [{"id": "a", "display_name": "A", "aliases": ["aaa"], "domains": ["a.com"], "dlt_headers": ["AAA"]}]})
    write(folder, "shorteners.json", {"schema_version": 1, "shorteners": ["s.ly"]})
    write(folder, "patterns.json", {"schema_version": 1, "patterns": [{"id": "p", "lang": ["EN"], "pattern": "x", "evidence": "OTP_SOLICITATION", "severity": "WARN", "weight": 0.1, "category_hints": {"KYC_PHISHING": 0.2}}]})
    write(folder, "typosquat.json", {"schema_version": 1, "single_char_folds": {"0": "o", "𝐚": "a"}, "sequence_folds": {"vv": "w"}, "suspicious_tlds": ["xyz"]})
    (folder / "public_suffix_list.dat").write_text("// note\ncom\n\n*.ck\n!www.ck\n")


def test_full_pack(spark, tmp_path):
    full(tmp_path)
    got = P.load(spark, str(tmp_path))
    assert not got.fallback and got.reputation is None and got.version == "unknown"
    assert got.brands[0][0] == "a" and got.brand_operated == {}
    assert got.single_folds == {"0": "o"} and got.sequence_folds == [("vv", "w")]
    assert got.patterns == [("p", ["EN"], "x", None, "OTP_SOLICITATION", 1, 0.1, {"KYC_PHISHING": 0.2})]
    assert sorted(tuple(r) for r in got.suffix_rows(spark).collect()) == [("exception", "www.ck"), ("plain", "com"), ("wildcard", "ck")]


@pytest.mark.parametrize("broken", [{"schema_version": 2, "patterns": []}, {"schema_version": 1, "patterns": [{"id": "p", "lang": ["EN"], "pattern": "(", "evidence": "OTP_SOLICITATION", "severity": "WARN", "weight": 0.1}]}, {"schema_version": 1, "patterns": [{"id": "p", "lang": ["EN"], "pattern": "x", "evidence": "OTP_SOLICITATION", "severity": "LOUD", "weight": 0.1}]}, None])
def test_a_bad_core_table_brings_the_built_in_pack(spark, tmp_path, broken):
    full(tmp_path)
    write(tmp_path, "patterns.json", broken) if broken else (tmp_path / "patterns.json").unlink()
    got = P.load(spark, str(tmp_path))
    assert got.fallback and got.brands == P.BUILT_IN.brands[:5] and len(got.shorteners) == 4 and len(got.suspicious_tlds) == 5 and not got.patterns and not got.single_folds and not got.sequence_folds and got.suffixes == ["com", "*.ck", "!www.ck"]


def test_a_written_pack_is_the_same_pack(spark, tmp_path):
    names = spark.createDataFrame([("a.com",), ("b.com",)], "domain string")
    P.write(spark, P.Pack(version="7"), str(tmp_path), "now", P.reputation_bytes(names, names))
    got = P.load(spark, str(tmp_path))
    assert (got.brands, got.patterns, got.single_folds, got.sequence_folds, got.suffixes, got.version) == (P.BUILT_IN.brands, P.BUILT_IN.patterns, P.BUILT_IN.single_folds, P.BUILT_IN.sequence_folds, P.BUILT_IN.suffixes, "7")
    assert got.reputation["allow"] == ["a.com", "b.com"]


def test_a_loaded_pack_drives_the_verdict(spark, tmp_path):
    full(tmp_path)
    pack = P.load(spark, str(tmp_path))
    rows = [(1, "9876543210", "aaa says hello"), (2, "9876543210", "NorthPay says hello"), (3, None, "x at s.ly.com and a.com")]
    df = spark.createDataFrame(rows, "msg_id long, sender_hint string, text string")
    got = {r.msg_id: r for r in V.verdicts(df, pack=pack).collect()}
    assert (got[1].verdict, got[2].verdict) == ("SCAM", "SAFE") and [f.id for f in got[3].fired] == ["p"]


def test_pack_checks(spark):
    assert P.violations(spark, P.BUILT_IN, 0).count() == 0
    assert [tuple(r) for r in P.violations(spark, P.BUILT_IN).collect()] == [("suffixes", "13", "too few rules")]
    bad = P.Pack(brands=[*P.BUILT_IN.brands, ("sola", "S", ["Pay", "orbit"], [], [])], shorteners=["a.b", "a.b"], brand_operated={"x.y": "none"}, short_distance=3, single_folds={"ab": "c"}, patterns=[*P.BUILT_IN.patterns, ("prize", ["EN"], "(", None, "OTP_SOLICITATION", 1, 0.1, {})])
    got = sorted((r.part, r.rule) for r in P.violations(spark, bad, 1_000).collect())
    assert got == [("brands", "alias of two brands"), ("brands", "bare common noun"), ("brands", "repeated id"), ("folds", "key of more than one character"), ("folds", "short labels allow more edits than long ones"), ("patterns", "does not compile"), ("patterns", "repeated id"), ("shorteners", "repeated domain"), ("shorteners", "unknown brand"), ("suffixes", "too few rules")]
    assert all(not P.shape_errors(k, d) for k, d in P.documents(P.BUILT_IN).items())
    assert P.shape_errors("brands", {"brands": [{"id": 1, "aliases": "x", "display_name": "d", "domains": []}]}) == [("/brands/0/aliases", "is no array"), ("/brands/0/dlt_headers", "is missing"), ("/brands/0/id", "has a wrong type"), ("/schema_version", "is missing")]
    assert P.bare_suffixes("// a\ncom\n\n in \n") == "com\nin\n"


def test_calibration_file(spark, tmp_path):
    P.write_calibration(spark, str(tmp_path / "c.json"), {"temperature": 1.5, "a": 1})
    assert P.read_calibration(spark, str(tmp_path / "c.json")) == 1.5
    (tmp_path / "d.json").write_text("{")
    with pytest.raises(Exception):
        P.read_calibration(spark, str(tmp_path / "d.json"))


def test_reputation_round_trip(spark):
    names = [f"site{i}.com" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    raw = P.reputation_bytes(df, spark.createDataFrame([("B.com",), ("a.com",), ("b.com",)], "domain string"))
    got = P.parse_reputation(raw)
    assert got["allow"] == ["a.com", "b.com"] and (got["m"], got["k"]) == bloom.parameters(50)
    asked = spark.createDataFrame([(n,) for n in [*names, "B.com", *[f"other{i}.net" for i in range(50)]]], "domain string")
    hit = {r.domain: r.known for r in P.established(asked, got).collect()}
    assert all(hit[n] for n in [*names, "B.com"]) and sum(hit.values()) < 60
    assert P.parse_reputation(b"x" + raw[1:]) is None and P.parse_reputation(raw[:30]) is None and P.parse_reputation(b"") is None and P.parse_reputation(raw[:-1]) is None
    assert bloom.parameters(0) == (8, 1)


def test_comments_go(spark):
    assert P.minified({"_c": 1, "a": [{"_d": 2, "é": 3}]}) == '{"a":[{"é":3}]}'


def test_temperature_softens_overconfidence(spark):
    rows = [(1 if i % 4 else 0, 0.0, 5.0) for i in range(40)]
    assert L.fit_temperature(spark.createDataFrame(rows, "y int, z0 double, z1 double"), 14) > 2


def test_audit_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "id string, label int")
    answers = spark.createDataFrame([("a", 1), ("b", 1)], "id string, answer int")
    r = L.agreement(rows, answers).first()
    assert (r.sampled, r.agreed, round(r.rate, 4)) == (3, 1, 0.3333)
    assert L.agreement(rows.limit(0), answers).first().rate == 1.0
    assert L.config_hash({"a": 1, "b": 2}) == L.config_hash({"b": 2, "a": 1}) and len(L.config_hash({})) == 12
    for k in range(2):
        L.append_run(spark, str(tmp_path / "log"), {"k": k}, {"f1": 0.5})
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_stream(spark, tmp_path):
    from vigil.streaming import verdicts as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"msg_id": 1, "text": "NorthPay: you won a prize", "sender_hint": "9876543210", "received_at": "2024-01-01T00:00:00Z"}\n')
    q = S.start(S.analyzed_stream(S.read_messages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.sender, r.lang) == ("UNREGISTERED_NUMERIC_SENDER", "EN")


def test_verdicts_with_the_fallback(spark):
    from vigil.plans import verdict as V
    from vigil.sources import rules

    pack = P.Pack(**rules.FALLBACK, suffixes=["com", "xyz"])
    rows = [(1, None, "NorthPay http://northpay-1.xyz/login"), (2, None, "won a prize"), (3, None, "NorthPay http://n0rthpay.com/")]
    df = spark.createDataFrame(rows, "msg_id long, sender_hint string, text string")
    got = {r.msg_id: (r.verdict, [e.type for e in r.evidence]) for r in V.ordered_evidence(V.verdicts(df, pack=pack)).collect()}
    assert got[1][0] == "SCAM" and got[2] == ("SAFE", []) and got[3][1][0] == "TYPOSQUAT_OF_KNOWN_BRAND"
    assert V.hints(V.verdicts(df, pack=pack), pack).count() == 2
