import random

import pytest
from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.operators import analyzers as A
from vigil.operators import urls as U
from vigil.plans import verdict as V
from vigil.sources import rules


def one(spark, values, *cols):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "text string").select(*cols).collect()]


def test_normalize_composes_and_folds(spark):
    got = one(spark, ["Ｆｕｌｌ  Width", "ze​ro", "  A\tB ", "", None], T.normalize(F.col("text")))
    assert [g[0] for g in got] == ["full width", "zero", "a b", "", None]


@pytest.mark.parametrize("text,lang", [("hello there", "EN"), ("aap kaise hain", "HI_LATN"), ("aap there", "EN"), ("नमस्ते दोस्त", "HI"), ("तुमचे खाते आहे", "MR"), ("বাংলা", "BN"), ("தமிழ்", "TA"), ("తెలుగు", "TE"), ("12345", "UNKNOWN"), ("", "UNKNOWN")])
def test_language(spark, text, lang):
    assert one(spark, [text], T.language(F.col("text"))) == [(lang,)]


def test_scrub(spark):
    texts = ["call 9876543210 or +91 9876543210", "Rs. 2,500.50 due", "ref 123456789012", "Dear Ravi Kumar, hi", "Dear Customer, hi", "code 1234"]
    assert [g[0] for g in one(spark, texts, T.scrub(F.col("text")))] == ["call <PHONE> or <PHONE>", "<AMT> due", "ref <ACCT>", "Dear <NAME>, hi", "Dear Customer, hi", "code 1234"]


def osa(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_budget_equals_dynamic_programming(spark):
    rng = random.Random(4)
    pairs = [("ca", "abc"), ("", ""), ("a", ""), ("ab", "ba"), ("abcd", "badc"), ("sbi", "sib"), ("", "ab")]
    for _ in range(600):
        a = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(b) + 1)
            k = rng.randrange(4)
            if k == 0:
                b.insert(i, rng.choice("abc"))
            elif k == 1 and i < len(b):
                b.pop(i)
            elif k == 2 and i < len(b):
                b[i] = rng.choice("abc")
            elif i + 1 < len(b):
                b[i], b[i + 1] = b[i + 1], b[i]
        pairs.append(("".join(a), "".join(b)))
    rows = [(a, b, k) for a, b in pairs for k in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "a string, b string, k int")
    for r in df.select("*", U.within(F.col("a"), F.col("b"), F.col("k")).alias("fit")).collect():
        assert r.fit == (osa(r.a, r.b) <= r.k), r


def test_links_keep_their_place_and_script(spark):
    text = "Ｆ see http://a.com/x, then http://a.com/x and xn--80ak6aa92e.com"
    df = spark.createDataFrame([(1, text)], "msg_id long, text string")
    got = U.extract(df).orderBy("ord").collect()
    assert [text[r.start : r.end] for r in got] == [r.raw for r in got] and [r.punycode for r in got] == [False, False, True]


def test_homographs_are_seen(spark):
    hosts = ["pаypal.com", "www.zеnbank.in", "nоrthpay.com", "zenbank.in"]
    got = {r.host: r for r in U.host_facts(spark.createDataFrame([(h,) for h in hosts], "host string"), rules.suffixes(spark)).collect()}
    assert [got[h].mixed for h in hosts] == [True, True, True, False]
    assert got["www.zеnbank.in"].original == "zеnbank.in" and got["www.zеnbank.in"].registrable.startswith("xn--")
    assert [got[h].squat for h in hosts] == [None, "zenbank", "northpay", None]


def test_claims_have_every_place(spark):
    text = "Sola or sola, Zen  Bank. solar"
    got = one(spark, [text], A.claims(F.col("text")))[0][0]
    assert [(c.brand_id, text[c.start : c.end]) for c in got] == [("sola", "Sola"), ("sola", "sola"), ("zenbank", "Zen  Bank")]


def test_full_width_wording_fires(spark):
    df = spark.createDataFrame([(1, "Ｓｈａｒｅ your OTP code"), (2, "share your otp code"), (3, None)], "msg_id long, text string")
    assert sorted((r.msg_id, r.id) for r in A.hits(df).collect()) == [(1, "share_code"), (2, "share_code")]


def test_keywords(spark):
    texts = ["earn $500 now", "earn £9 a day", "update your details", "your pc has a virus", "hello"]
    assert [g[0] for g in one(spark, texts, T.keyword_category(F.col("text")))] == ["FAKE_JOB", "FAKE_JOB", "KYC_PHISHING", "TECH_SUPPORT", "OTHER_SCAM"]


def test_urls(spark):
    df = spark.createDataFrame([(1, "go http://user@a.example.com:80/x?q and www.b.net, c.org/p but not v1.2.3 or me@d.com or file.unknown")], "msg_id long, text string")
    got = [(r.raw, r.host, r.path) for r in U.extract(df).orderBy("ord").collect()]
    assert got == [("http://user@a.example.com:80/x?q", "a.example.com", ":80/x?q"), ("www.b.net", "www.b.net", None), ("c.org/p", "c.org", "/p")]


def test_registrable(spark):
    hosts = ["a.b.example.com", "example.co.in", "co.in", "x.y.ck", "www.ck", "10.0.0.1", "a.unlisted", "999.1.1.1"]
    got = {r.host: r.registrable for r in U.registrable(spark.createDataFrame([(h,) for h in hosts], "host string"), rules.suffixes(spark)).collect()}
    assert got == {"a.b.example.com": "example.com", "example.co.in": "example.co.in", "co.in": None, "x.y.ck": "x.y.ck", "www.ck": "www.ck", "10.0.0.1": None, "a.unlisted": "a.unlisted", "999.1.1.1": "1.1"}


def test_fold_and_mixed_script(spark):
    got = one(spark, ["g00gle", "rnodern", "pаypal"], U.fold(F.col("text")), U.mixed_script(F.col("text")))
    assert got == [("google", False), ("modem", False), ("paypal", True)]


@pytest.mark.parametrize(
    "text,hint,verdict",
    [
        ("NorthPay: account ready", "AB-NRTHPY", "SAFE"),
        ("NorthPay: account ready", "AB-QKMART", "SCAM"),
        ("NorthPay: account ready", "9876543210", "SCAM"),
        ("NorthPay http://northpay-1.xyz/login", None, "SCAM"),
        ("see http://10.0.0.7/x", None, "SUSPICIOUS"),
        ("see bit.ly/a", None, "SAFE"),
        ("north pay https://northpay.click/r", None, "SAFE"),
        ("", None, "SAFE"),
        ("x" * 10_000, None, "SAFE"),
    ],
)
def test_verdicts(spark, text, hint, verdict):
    df = spark.createDataFrame([(1, 1, 1, "A", hint, text)], "msg_id long, cust_id long, nation_id int, segment string, sender_hint string, text string")
    assert V.verdicts(df).first().verdict == verdict
