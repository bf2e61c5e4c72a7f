"""Links of plain and of HTML texts, and the evidence that they give."""

import dataclasses
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_messages import osa
from vigil.functions.text import spans
from vigil.operators import anchors as H
from vigil.operators import urls as U
from vigil.plans import verdict as V
from vigil.sources import pack as P
from vigil.sources import rules


def test_many_links_in_one_text(spark):
    text = " ".join(f"see http://a{i}.com/x{i}, Ünd" for i in range(4_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "none"), (4, "")], "msg_id long, text string")
    began = time.time()
    got = U.extract(df).orderBy("ord").collect()
    assert time.time() - began < 60
    assert len(got) == 4_000 and all(text[r.start : r.end] == r.raw for r in got)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_spans_of_steps(spark, n):
    text = "".join(f"{'x' * (k % 5)}[{k}]" for k in range(n)) + "tail"
    got = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), r"\[\d+\]").alias("s")).first().s
    assert [text[s.start : s.end] for s in got] == [f"[{k}]" for k in range(n)] == [s.found for s in got]


HTML = """<!-- <a href="http://old.com">o</a> --><p>Hi <a href="https://www.a.com/x?a=1&amp;b=2">a<b>.</b>com</a> <A class='q' HREF='//b.net'>  B &#x6c;&#32;&#128512;&amp;#39; &foo; </A>
<a title="x > y href=z" href=http://c.org>one <a href="/rel">two</a><script>x='<a href="j">'</script><a href="mailto:x@y">m</a><a name=q>none</a><a href="http://user@[::1]:8/p">ip</a><a data-href="http://no.com">no</a><a href="http://d.com">open"""


def test_anchors(spark):
    rows = [(1, HTML, "https://own.com/p"), (2, HTML, None), (3, None, None), (4, "", None), (5, "<a " * 3_000, None), (6, "<a href='x' " * 3_000 + "'", None), (7, "&#0;<a href='http://x.com'>&#1114112;&#xD800;&bogus;</a>", None)]
    got = H.links(spark.createDataFrame(rows, "msg_id long, html string, url string")).orderBy("msg_id", "ord").collect()
    seen = lambda k: [(r.host, r.path, r.display_text) for r in got if r.msg_id == k]
    all_of = [("www.a.com", "/x?a=1&b=2", "a.com"), ("b.net", None, "B l 😀&#39; &foo;"), ("c.org", None, "one"), ("own.com", "/rel", "two"), ("[::1]", ":8/p", "ip"), ("d.com", None, "open")]
    assert seen(1) == all_of and seen(2) == [x for x in all_of if x[0] != "own.com"]
    assert not any(seen(k) for k in (3, 4, 5, 6)) and seen(7) == [("x.com", None, "��&bogus;")]


@pytest.mark.parametrize("budgets", [(1, 2), (3, 4)])
def test_look_alikes_equal_brute_force(spark, budgets):
    rng = random.Random(7)
    names = ["northpay", "zenbank", "sola", "or"]
    brands = [(n, n.title(), [n], [f"{n}.com"], []) for n in names]
    pack = rules.Pack(brands=brands, short_distance=budgets[0], long_distance=budgets[1])
    labels = ["northpay", "north-pay", "xsolax", "ro", "", "zen1bank", "orthnpay"]
    for _ in range(250):
        x = list(rng.choice(names))
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randrange(2)] = rng.choice(["", "a", "z", "-"])
        if len(x) > 2 and rng.random() < 0.4:
            i = rng.randrange(len(x) - 1)
            x[i], x[i + 1] = x[i + 1], x[i]
        labels.append("".join(x))
    bare = lambda s: "".join(c for c in s if c not in "-._" and not c.isdigit())
    want = {}
    for x in set(labels) - {""} - set(names):
        fit = [n for n in names if osa(x, n) <= budgets[len(n) > pack.short_label] or (n in x and len(n) >= rules.LEAST_CONTAINED) or bare(x) == bare(n)]
        if fit:
            want[x] = fit[0]
    got = U.typosquat(spark.createDataFrame([(x,) for x in labels], "label string"), pack)
    assert {r.label: r.brand_id for r in got.collect()} == want
    plan = U.typosquat(spark.createDataFrame([("x",)], "label string"), pack)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ages_and_reputation(spark):
    domains = spark.createDataFrame([("old.com",), ("known.com",)], "domain string")
    own = spark.createDataFrame([("allowed.com",)], "domain string")
    reputation = P.parse_reputation(P.reputation_bytes(domains, own, 1e-6))
    pack = dataclasses.replace(rules.BUILT_IN, reputation=reputation)
    ages = spark.createDataFrame([("young.com", 3), ("grown.com", 30), ("grown.com", 90)], "domain string, age_days int")
    text = "http://old.com http://allowed.com http://young.com http://grown.com http://stranger.com http://10.0.0.1/"
    links = U.extract(spark.createDataFrame([(1, text)], "msg_id long, text string"))
    got = {(r.slots.domain, r.severity, r.slots.age_days) for r in U.evidence(links, U.host_facts(links, pack.suffix_rows(spark), pack, ages), pack).collect() if r.type == "DOMAIN_VERY_NEW"}
    assert got == {("young.com", 2, "3"), ("stranger.com", 0, None)}
    none = U.evidence(links, U.host_facts(links, rules.suffixes(spark)))
    assert [r.type for r in none.collect()] == ["IP_ADDRESS_HOST"]


def test_what_html_shows_counts(spark):
    rows = [(1, 1, 1, "A", None, "north pay news", '<a href="https://x.com/p">northpay.com</a>'), (2, 1, 1, "A", None, "north pay news", '<a href="https://northpay.com/p">www.NorthPay.com</a>'), (3, 1, 1, "A", None, "news", None)]
    df = spark.createDataFrame(rows, "msg_id long, cust_id long, nation_id int, segment string, sender_hint string, text string, html string")
    v = V.ordered_evidence(V.verdicts(df))
    got = {r.msg_id: (r.verdict, [e.type for e in r.evidence]) for r in v.collect()}
    assert got[1] == ("SCAM", ["LINK_TEXT_MISMATCH", "BRAND_CLAIM_WITHOUT_DLT_HEADER"]) and got[2][0] == "SAFE" and got[3] == ("SAFE", [])
    assert {r.msg_id: r.top1 for r in V.explained(v).collect()}[1] == "The link shows northpay.com and opens x.com."


def test_texts_name_what_was_found(spark):
    rows = [(1, 1, 1, "A", "AB-SHARED", "Sola or Zen Bank: pay", None)]
    df = spark.createDataFrame(rows, "msg_id long, cust_id long, nation_id int, segment string, sender_hint string, text string, html string")
    r = V.explained(V.ordered_evidence(V.verdicts(df))).first()
    assert r.top1 == "The message speaks for Sola, its header belongs to Lumen Post, Orbit Wallet."
    aged = spark.createDataFrame([(("DOMAIN_VERY_NEW", ("a.b", None)),), (("DOMAIN_VERY_NEW", ("a.b", "4")),)], "e struct<type: string, slots: struct<domain: string, age_days: string>>")
    e = aged.select(F.struct("e.type", V.slots({"domain": F.col("e.slots.domain"), "age_days": F.col("e.slots.age_days")}).alias("slots")).alias("e"))
    assert [x[0] for x in e.select(V.evidence_text(F.col("e"))).collect()] == ["Nothing is known of the age of a.b.", "The domain a.b is only 4 days old."]
