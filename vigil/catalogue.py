"""All registered queries of the library, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace
from uuid import uuid4

from pyspark.sql import functions as F

from vigil.functions import text as T
from vigil.operators import anchors as H
from vigil.operators import analyzers as A
from vigil.operators import rows as R
from vigil.operators import scoring as Sc
from vigil.operators import urls as U
from vigil.plans import oracle as O
from vigil.plans import verdict as V
from vigil.plans.staging import ensure_checkpoint_dir
from vigil.sources import rules
from vigil.sources.messages import HTML_SQL, SPOKEN_SQL, domain_ages, html_messages, messages, ranked_domains, spoken_messages

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark, name):
    """A new folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/vigil-{name}-{uuid4().hex}"


def _known(spark, sf_dir):
    """The built-in pack with a reputation filter of the ranked domains."""
    from vigil.sources import pack

    own = spark.createDataFrame([(d,) for b in rules.BRANDS for d in b[3]], "domain string")
    return replace(rules.BUILT_IN, reputation=pack.parse_reputation(pack.reputation_bytes(ranked_domains(spark, sf_dir), own)))


def _verdicts(spark, sf_dir, temperature=None):
    return V.verdicts(messages(spark, sf_dir), temperature, _known(spark, sf_dir), domain_ages(spark, sf_dir))


def _r(c, n=6):
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), n)


@query(O.q(O.CHAIN, select="SELECT n_name, segment, verdict, count(*) AS n_messages, round(avg(score::DOUBLE), 5) AS avg_score FROM v JOIN nation ON nation_id = n_nationkey GROUP BY ALL"))
def verdict_by_segment(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    v = _verdicts(spark, sf_dir).join(nation, F.col("nation_id") == F.col("n_nationkey"))
    return v.groupBy("n_name", "segment", "verdict").agg(F.count("*").alias("n_messages"), F.round(F.avg(F.col("score").cast("double")), 5).alias("avg_score"))


@query(O.q(O.CHAIN, select="SELECT msg_id, verdict, confidence, round(score::DOUBLE, 5) AS score, round(uw::DOUBLE, 5) AS url_weight, round(sw::DOUBLE, 5) AS sender_weight, round(pw::DOUBLE, 5) AS pattern_weight, forced FROM v"))
def fusion_verdict(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("msg_id", "verdict", "confidence", *[_r(c, 5).alias(c) for c in ("score", "url_weight", "sender_weight", "pattern_weight")], "forced")


@query(O.q(O.CHAIN, O.EVIDENCE, select="SELECT msg_id, rank::INT AS rank, type, severity::INT AS severity FROM ranked"))
def evidence_ranked(spark, sf_dir):
    return V.evidence_rows(_verdicts(spark, sf_dir)).select("msg_id", "rank", "e.type", (-F.col("e.s")).alias("severity"))


@query(O.q(O.CHAIN, O.EVIDENCE, "t AS (SELECT * FROM " + rules.values_sql([(k, w, rules.AGED.get(k)) for k, w in rules.TEMPLATES.items()], "v", "type, words, aged") + ")", "said AS (SELECT msg_id, rank, " + O.worded("CASE WHEN age_days IS NOT NULL THEN coalesce(aged, words) ELSE words END") + " AS words FROM ranked JOIN t USING (type))", select="SELECT v.msg_id, v.verdict, max(words) FILTER (rank = 1) AS top1, max(words) FILTER (rank = 2) AS top2, max(words) FILTER (rank = 3) AS top3, greatest(count(rank) - 3, 0)::INT AS remaining, CASE WHEN v.verdict = 'SAFE' THEN 0 ELSE 5 END AS n_actions FROM v LEFT JOIN said USING (msg_id) GROUP BY v.msg_id, v.verdict"))
def explanations(spark, sf_dir):
    return V.explained(V.ordered_evidence(_verdicts(spark, sf_dir)))


@query(O.q(O.CHAIN, O.HINTS, "top_hint AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY total DESC, first) AS r FROM sums)", select="""SELECT v.msg_id, v.verdict, CASE WHEN v.verdict = 'SAFE' THEN 'NOT_SCAM' ELSE coalesce(category, 'OTHER_SCAM') END AS category,
  CASE WHEN v.verdict = 'SAFE' OR total >= 0.7 THEN 'HIGH' WHEN total >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS category_confidence FROM v LEFT JOIN top_hint ON v.msg_id = top_hint.msg_id AND r = 1"""))
def category_argmax(spark, sf_dir):
    return V.categories(_verdicts(spark, sf_dir))


@query(O.q(O.CHAIN, O.HINTS, select="SELECT msg_id, category, round(total, 5) AS total FROM sums"))
def category_hints(spark, sf_dir):
    return V.hints(_verdicts(spark, sf_dir)).groupBy("msg_id", "category").agg(F.round(F.sum(F.col("hint").cast("double")), 5).alias("total"))


@query(O.q(O.MESSAGES, select="SELECT msg_id, normalized, lang FROM msgs"))
def normalize_text(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", A.texts(F.col("text")).alias("t")).select("msg_id", "t.*")


@query(f"SELECT doc_id, {O.language_sql('n')} AS lang FROM (SELECT doc_id, {O.normalize_sql('text')} AS n FROM documents)")
def language_detect(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", A.texts(F.col("text"))["lang"].alias("lang"))


@query(O.q(O.MESSAGES, O.URLS, select='SELECT msg_id, ord::INT AS ord, raw, scheme, host, path, start::INT AS start, (start + length(raw))::INT AS "end", punycode FROM urls'))
def url_extract(spark, sf_dir):
    return U.extract(messages(spark, sf_dir))


_PAGE_HOSTS = "page_hosts AS (SELECT regexp_extract(url, '^[^:]*://([^/?#:]*)', 1) AS host FROM pages WHERE url IS NOT NULL)"


@query(O.q(_PAGE_HOSTS, O.registrable("page_hosts"), select="SELECT host, registrable FROM reg"))
def registrable_domain(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").where("url is not null").select(F.regexp_extract("url", "^[^:]*://([^/?#:]*)", 1).alias("host")).distinct()
    return U.registrable(hosts, rules.suffixes(spark)).select("host", "registrable")


@query(f"SELECT page_id, host, {O.IS_IP} AS ip FROM (SELECT page_id, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host FROM pages)")
def ip_hosts(spark, sf_dir):
    host = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", host.alias("host")).withColumn("ip", U.is_ip(F.col("host")))


@query(O.q(O.anchors("SELECT page_id AS msg_id, html, url FROM pages"), "urls AS (SELECT msg_id, host FROM anchor_links WHERE host <> '')", O.registrable("urls"), select="SELECT msg_id AS page_id, ord, a.host, shown, registrable, CASE WHEN registrable IS NULL THEN NULL ELSE NOT contains(lower(shown), lower(registrable)) END AS mismatch FROM anchor_links a JOIN reg ON reg.host = a.host"))
def link_text_mismatch(spark, sf_dir):
    links = H.links(read(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), "html", "url"))
    on = links.join(U.registrable(links.select("host").distinct(), rules.suffixes(spark)), "host")
    return on.select(F.col("msg_id").alias("page_id"), "ord", "host", F.col("display_text").alias("shown"), "registrable", (~F.contains(F.lower("display_text"), F.lower("registrable"))).alias("mismatch"))


_HTML = f"html_messages AS ({HTML_SQL.format(orders='orders')})"


@query(O.q(_HTML, O.anchors("SELECT msg_id, html, NULL AS url FROM html_messages"), "urls AS (SELECT * FROM anchor_links)", O.FACTS, O.url_evidence("urls", "shown"), select="SELECT msg_id, ord, pos::INT AS pos, type, severity::INT AS severity, displayed, actual, domain FROM url_ev"))
def html_evidence(spark, sf_dir):
    """Evidence of links in HTML messages, which may show one domain and lead to another."""
    links, p = H.links(html_messages(spark, sf_dir).withColumn("url", F.lit(None).cast("string"))), _known(spark, sf_dir)
    e = U.evidence(links, U.host_facts(links, rules.suffixes(spark), p, domain_ages(spark, sf_dir)), p)
    return e.select("msg_id", "ord", "pos", "type", "severity", "slots.displayed", "slots.actual", "slots.domain")


@query(O.q(O.MESSAGES, _HTML, O.URLS, O.anchors("SELECT msg_id, html, NULL AS url FROM html_messages"), "text_urls AS (SELECT msg_id, ord, host, scheme, path, NULL::VARCHAR AS shown, raw, start FROM urls), all_links AS (SELECT * FROM text_urls UNION ALL SELECT msg_id, ord + 16777216, host, scheme, path, shown, raw, NULL FROM anchor_links)", O.FACTS.replace("FROM urls", "FROM all_links"), O.url_evidence("all_links", "shown"), O.CLAIMS, O.SENDER, O.FIRED, O.VERDICT, select="SELECT msg_id, verdict, confidence, round(score::DOUBLE, 5) AS score FROM v"))
def html_verdict(spark, sf_dir):
    """Verdicts of messages that come with HTML beside their text."""
    both = messages(spark, sf_dir).join(html_messages(spark, sf_dir), "msg_id")
    return V.verdicts(both, None, _known(spark, sf_dir), domain_ages(spark, sf_dir)).select("msg_id", "verdict", "confidence", _r("score", 5).alias("score"))


@query(O.q(O.MESSAGES, O.URLS, O.FACTS, select="SELECT label, brand_id, known, domain FROM squat"))
def typosquat_first_hit(spark, sf_dir):
    links = U.extract(messages(spark, sf_dir))
    reg = U.registrable(links.select("host").distinct(), rules.suffixes(spark))
    label = F.substring_index("original", ".", 1)
    both = reg.select(label.alias("label")).union(reg.select(U.fold(label).alias("label"))).where("label is not null").distinct()
    return U.typosquat(both)


@query(O.q(O.MESSAGES, O.URLS, O.FACTS, select="SELECT host, registrable AS original, folded, squat, squat_domain, mixed, shortener, bad_tld, age_days::VARCHAR AS age_days, coalesce(unknown_age, false) AS unknown_age FROM facts"))
def host_facts(spark, sf_dir):
    f = U.host_facts(U.extract(messages(spark, sf_dir)), rules.suffixes(spark), _known(spark, sf_dir), domain_ages(spark, sf_dir))
    return f.select("host", "original", U.fold(F.col("label")).alias("folded"), "squat", "squat_domain", "mixed", "shortener", "bad_tld", F.col("age_days").cast("string").alias("age_days"), F.coalesce("unknown_age", F.lit(False)).alias("unknown_age"))


@query(O.q(O.MESSAGES, O.URLS, O.FACTS, O.URL_EVIDENCE, select='SELECT msg_id, ord::INT AS ord, pos::INT AS pos, type, severity::INT AS severity, start, stop AS "end", actual, brand, real_domain, path, domain, age_days FROM url_ev'))
def url_evidence(spark, sf_dir):
    links, p = U.extract(messages(spark, sf_dir)), _known(spark, sf_dir)
    e = U.evidence(links, U.host_facts(links, rules.suffixes(spark), p, domain_ages(spark, sf_dir)), p)
    return e.select("msg_id", "ord", "pos", "type", "severity", "start", "end", *[f"slots.{c}" for c in ("actual", "brand", "real_domain", "path", "domain", "age_days")])


@query(O.q(O.MESSAGES, O.CLAIMS, select="SELECT msg_id, brand_id, name, alias FROM claims"))
def brand_claims(spark, sf_dir):
    c = messages(spark, sf_dir).select("msg_id", F.explode(A.claims(F.col("text"))).alias("c"))
    return c.select("msg_id", "c.brand_id", "c.name", "c.alias")


@query(O.q(O.MESSAGES, O.CLAIMS, O.SENDER, select="SELECT msg_id, sender FROM sender WHERE sender IS NOT NULL"))
def sender_evidence(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("msg_id", A.sender_evidence(F.col("sender_hint"), A.claimed_brands(F.col("text"))).alias("sender")).where("sender is not null")


@query(O.q(O.MESSAGES, O.FIRED, select="SELECT msg_id, rule_id, type, severity::INT AS severity FROM fired"))
def pattern_hits(spark, sf_dir):
    return A.hits(messages(spark, sf_dir)).select("msg_id", F.col("id").alias("rule_id"), "type", "severity")


@query(O.q(f"spoken AS ({SPOKEN_SQL.format(orders='orders')})", f"told AS (SELECT *, {O.language_sql('normalized')} AS lang FROM (SELECT *, {O.normalize_sql('text')} AS normalized FROM spoken))", O.fired("told"), select="SELECT told.msg_id, lang, rule_id, type FROM told LEFT JOIN fired USING (msg_id)"))
def pattern_languages(spark, sf_dir):
    """Rules in seven languages, from a pack that was written and read again."""
    m = spoken_messages(spark, sf_dir)
    facts = T.bound(A.texts(F.col("text")), lambda t: F.struct(t["lang"].alias("lang"), A.fired(t["normalized"], t["lang"], _pack(spark, sf_dir)).alias("fired")))
    return m.select("msg_id", facts.alias("f")).select("msg_id", "f.lang", F.explode_outer("f.fired").alias("r")).select("msg_id", "lang", F.col("r.id").alias("rule_id"), "r.type")


@query(O.q(O.MESSAGES, O.FIRED, select="SELECT msg_id, round(least(sum(weight)::FLOAT, 0.5::FLOAT)::DOUBLE, 5) AS weight FROM fired GROUP BY msg_id"))
def pattern_weight(spark, sf_dir):
    m = A.analyzed(messages(spark, sf_dir)).select("msg_id", F.explode_outer("fired").alias("f"), "pattern_weight").where("f is not null")
    return m.groupBy("msg_id").agg(_r(F.first("pattern_weight"), 5).alias("weight"))


@query(O.q(O.MESSAGES, select=f"SELECT msg_id, {O.scrub_sql('text')} AS scrubbed FROM messages UNION ALL SELECT -1 - doc_id, {O.scrub_sql('text')} FROM documents"))
def pii_scrub(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select((F.lit(-1) - F.col("doc_id")).alias("msg_id"), "text")
    both = messages(spark, sf_dir).select("msg_id", "text").union(docs)
    return both.select("msg_id", T.scrub(F.col("text")).alias("scrubbed"))


@query(O.q(O.MESSAGES, select=f"SELECT msg_id, {O.keyword_category_sql('text')} AS category FROM messages"))
def keyword_category(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", T.keyword_category(F.col("text")).alias("category"))


# dataset, metric and constraint queries


from vigil.operators import bloom as B  # noqa: E402
from vigil.operators import checks as C  # noqa: E402
from vigil.operators import datasets as D  # noqa: E402
from vigil.operators import metrics as M  # noqa: E402


def _texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")


@query(f"SELECT doc_id AS ord, 'sms_web_' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 6, '0') AS id, {O.scrub_sql('text')} AS text, 'EN' AS lang, 'web' AS source, '2024-05-01' AS collected_at FROM documents")
def ingest_rows(spark, sf_dir):
    return D.ingest(_texts(spark, sf_dir), "web", "EN", collected_at="2024-05-01")


def _conversation_rows(spark, sf_dir):
    """The turns, an edited copy of each seventh and an exact copy of each eleventh id."""
    base = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").where("text is not null")
    edited = base.where("id % 7 = 0").select((-1 - F.col("id")).alias("id"), F.concat("text", F.lit(" ok then")).alias("text"))
    return base.union(edited).union(base.where("id % 11 = 0").select((-1_000_000_000 - F.col("id")).alias("id"), "text"))


_SIGS = """c0 AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE text IS NOT NULL),
c AS (SELECT * FROM c0 UNION ALL SELECT -1 - id, text || ' ok then' FROM c0 WHERE id % 7 = 0 UNION ALL SELECT -1000000000 - id, text FROM c0 WHERE id % 11 = 0),
sh AS (SELECT DISTINCT id, unnest(CASE WHEN length(text) = 0 THEN [] WHEN length(text) < 5 THEN [lower(text)] ELSE list_transform(range(1, length(text) - 3), lambda i: substr(lower(text), i::BIGINT, 5)) END) AS s FROM c),
d AS (SELECT s, list_transform(range(64), lambda i: ('0x' || substr(md5(i::VARCHAR || ':' || s), 1, 15))::BIGINT) AS h FROM (SELECT DISTINCT s FROM sh)),
hs AS (SELECT id, generate_subscripts(h, 1) AS i, unnest(h) AS h FROM sh JOIN d USING (s)),
m AS (SELECT id, i, min(h) AS h FROM hs GROUP BY id, i),
sg AS (SELECT c.id, CASE WHEN count(m.h) = 0 THEN list_transform(range(64), lambda x: 0::BIGINT) ELSE list(m.h ORDER BY i) END AS sig FROM c LEFT JOIN m USING (id) GROUP BY c.id)"""
_PAIRS = """cls AS (SELECT min(id) AS rep, sig FROM sg GROUP BY sig),
pr AS (SELECT a.rep AS a, b.rep AS b, (len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) / 64.0)::DOUBLE AS agreement FROM cls a JOIN cls b ON a.rep < b.rep),
near AS (SELECT * FROM pr WHERE agreement > 0.8 UNION ALL SELECT rep, id, 1.0 FROM sg JOIN cls USING (sig) WHERE id <> rep)"""


@query(O.q(_SIGS, select="SELECT id, array_to_string(sig, ',') AS sig FROM sg"))
def minhash_signature(spark, sf_dir):
    return D.signatures(_conversation_rows(spark, sf_dir)).select("id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


def _near(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    rows = _conversation_rows(spark, sf_dir)
    sigs = D.signatures(rows).checkpoint()
    return rows, D.near_pairs(sigs)


@query(O.q(_SIGS, _PAIRS, select="SELECT a, b, round(agreement, 6) AS agreement FROM near"))
def near_dup_pairs(spark, sf_dir):
    return _near(spark, sf_dir)[1].select("a", "b", F.round("agreement", 6).alias("agreement"))


_CLUSTERS = """reach AS (SELECT id, id AS r FROM sg UNION SELECT reach.id, CASE WHEN near.a = r THEN near.b ELSE near.a END FROM reach JOIN near ON near.a = r OR near.b = r),
cl AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"""


@query("WITH RECURSIVE " + ", ".join([_SIGS, _PAIRS, _CLUSTERS]) + " SELECT id, cluster FROM cl")
def clusters(spark, sf_dir):
    rows, pairs = _near(spark, sf_dir)
    return D.clusters(rows, pairs)


_SPLIT = """sizes AS (SELECT cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cluster) AS i FROM cl GROUP BY cluster),
goal AS (SELECT 0.70::DOUBLE * sum(n) AS g0, 0.15::DOUBLE * sum(n) AS g1, 0.15::DOUBLE * sum(n) AS g2 FROM sizes),
step AS (SELECT 0::BIGINT AS i, 0::BIGINT AS h0, 0::BIGINT AS h1, 0::BIGINT AS h2, -1 AS pick UNION ALL
  SELECT i, h0 + CASE pick WHEN 0 THEN n ELSE 0 END, h1 + CASE pick WHEN 1 THEN n ELSE 0 END, h2 + CASE pick WHEN 2 THEN n ELSE 0 END, pick FROM (
    SELECT s.i, s.n, h0, h1, h2, CASE WHEN (g0 - h0) / g0 >= (g1 - h1) / g1 AND (g0 - h0) / g0 >= (g2 - h2) / g2 THEN 0 WHEN (g1 - h1) / g1 >= (g2 - h2) / g2 THEN 1 ELSE 2 END AS pick
    FROM step JOIN sizes s ON s.i = step.i + 1, goal))"""


@query("WITH RECURSIVE " + ", ".join([_SIGS, _PAIRS, _CLUSTERS, _SPLIT]) + " SELECT id, cluster, ['train', 'val', 'test'][pick + 1] AS split FROM cl JOIN sizes USING (cluster) JOIN step USING (i)")
def split_assign(spark, sf_dir):
    rows, pairs = _near(spark, sf_dir)
    return D.split(D.clusters(rows, pairs))


@query(O.q(_SIGS, _PAIRS, select="SELECT a, b FROM near WHERE abs(a) % 3 <> abs(b) % 3"))
def leakage_pairs(spark, sf_dir):
    """Leaks of a split that knows nothing of near copies."""
    rows, pairs = _near(spark, sf_dir)
    return D.leaks(pairs, rows.select("id", (F.abs("id") % 3).cast("string").alias("split")))


@query(O.q(_SIGS, select="SELECT count(*) AS n, 0 AS leaks FROM sg"))
def split_leaks(spark, sf_dir):
    """Leaks of our own split: none, whatever the rows."""
    rows, pairs = _near(spark, sf_dir)
    pairs = pairs.checkpoint()
    splits = D.split(D.clusters(rows, pairs))
    leaks = D.leaks(pairs, splits).agg(F.count("*").cast("int").alias("leaks"))
    return splits.agg(F.count("*").alias("n")).crossJoin(leaks)  # two counts


# The same chain over the whole texts of `documents`, where near copies occur. The self-join that SQL needs does not
# bear that table, so tests hold these against brute force.


def _document_rows(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")


def _document_near(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    rows = _document_rows(spark, sf_dir)
    return rows, D.near_pairs(D.signatures(rows).checkpoint()).checkpoint()


@query()
def doc_minhash_signature(spark, sf_dir):
    return D.signatures(_document_rows(spark, sf_dir))


@query()
def doc_near_dup_pairs(spark, sf_dir):
    return _document_near(spark, sf_dir)[1].select("a", "b", F.round("agreement", 6).alias("agreement"))


@query()
def doc_clusters(spark, sf_dir):
    return D.clusters(*_document_near(spark, sf_dir))


@query()
def doc_split_assign(spark, sf_dir):
    return D.split(D.clusters(*_document_near(spark, sf_dir)))


@query()
def doc_leakage_pairs(spark, sf_dir):
    rows, pairs = _document_near(spark, sf_dir)
    return D.leaks(pairs, D.split(D.clusters(rows, pairs)))


def _labelled(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), "quality")
    return d.join(lab, "doc_id").withColumn("pred", ((F.col("doc_id") % 7 == 0) | (F.col("y") == 1) & (F.col("n_chars") % 3 != 0)).cast("int"))


_LAB = "lab AS (SELECT doc_id, lang, n_chars, toxic AS y, quality, (doc_id % 7 = 0 OR (toxic = 1 AND n_chars % 3 <> 0))::INT AS pred FROM documents JOIN labels USING (doc_id))"


def _metric_sql(by: str = "") -> str:
    g = f"{by}, " if by else ""
    div = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"
    f1, f0 = div("2 * tp", "2 * tp + fp + fn"), div("2 * tn", "2 * tn + fn + fp")
    return O.q(_LAB, f"k AS (SELECT {g}count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM lab {'GROUP BY ' + by if by else ''})", select=f"SELECT {g}round({div('tn', 'tn + fn')}, 6) AS precision_0, round({div('tn', 'tn + fp')}, 6) AS recall_0, round({f0}, 6) AS f1_0, round({div('tp', 'tp + fp')}, 6) AS precision_1, round({div('tp', 'tp + fn')}, 6) AS recall_1, round({f1}, 6) AS f1_1, round(({f0} + {f1}) / 2, 6) AS macro_f1 FROM k")


@query(_metric_sql())
def binary_metrics(spark, sf_dir):
    return M.binary(_labelled(spark, sf_dir))


@query(_metric_sql("lang"))
def per_lang_f1(spark, sf_dir):
    return M.binary(_labelled(spark, sf_dir), "lang")


@query(O.q(_metric_sql("lang").removeprefix("WITH ").replace(" SELECT lang, round(", ", got AS (SELECT lang, round(", 1) + ")", "asked AS (SELECT unnest(['en', 'fr', 'de', 'hi', 'ta']) AS lang)", select="SELECT lang, macro_f1 FROM asked LEFT JOIN got USING (lang)"))
def per_language_targets(spark, sf_dir):
    """Every asked language has a row; one that does not occur has no figure."""
    return M.per_language(_labelled(spark, sf_dir), ["en", "fr", "de", "hi", "ta", "UNKNOWN"])


_CATS = "cats AS (SELECT doc_id, (doc_id * 7) % 11 AS y, (doc_id * 7 + CASE WHEN doc_id % 5 = 0 THEN n_chars % 3 ELSE 0 END) % 11 AS p FROM documents)"


@query(O.q(_CATS, "names AS (SELECT * FROM " + rules.values_sql(list(enumerate(rules.CATEGORIES)), "v", "i, label") + ")", select="SELECT a.label AS actual, b.label AS predicted, count(doc_id) AS n FROM names a CROSS JOIN names b LEFT JOIN cats ON y = a.i AND p = b.i GROUP BY ALL"))
def confusion_matrix(spark, sf_dir):
    """All 13 x 13 cells; two categories never occur."""
    names, i = F.array(*map(F.lit, rules.CATEGORIES)), F.col("doc_id")
    d = read(spark, sf_dir, "documents")
    off = F.when(i % 5 == 0, F.col("n_chars") % 3).otherwise(0)
    rows = d.select(F.get(names, ((i * 7) % 11).cast("int")).alias("y"), F.get(names, ((i * 7 + off) % 11).cast("int")).alias("pred"))
    return M.confusion(rows, spark.createDataFrame([(c,) for c in rules.CATEGORIES], "label string"))


@query(O.q(_LAB, select="SELECT round(count(*) FILTER (y = 1 AND pred = 1)::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 6) AS recall, round(count(*) FILTER (y = 0 AND quality = 0 AND pred = 1)::DOUBLE / nullif(count(*) FILTER (y = 0 AND quality = 0), 0), 6) AS fpr, round(count(*) FILTER (y = 1 AND pred = 1)::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 6) >= 0.93 AS recall_met, round(count(*) FILTER (y = 0 AND quality = 0 AND pred = 1)::DOUBLE / nullif(count(*) FILTER (y = 0 AND quality = 0), 0), 6) <= 0.03 AS fpr_met FROM lab"))
def fpr_hard_negative(spark, sf_dir):
    """Genuine rows of low quality are the hard ones."""
    return M.targets(_labelled(spark, sf_dir).withColumn("is_hard_negative", F.col("quality") == 0))


_GRID = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


@query(f"WITH z AS (SELECT (event_id % 2)::INT AS y, 0.0::DOUBLE AS z0, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END * (CASE WHEN event_id % 2 = 1 THEN 1 ELSE -1 END) * value / 50 AS z1 FROM events WHERE value IS NOT NULL), t AS (SELECT unnest({_GRID}::DOUBLE[]) AS temperature) SELECT temperature, round(avg(ln(exp(z0 / temperature - greatest(z0, z1) / temperature) + exp(z1 / temperature - greatest(z0, z1) / temperature)) + greatest(z0, z1) / temperature - CASE WHEN y = 1 THEN z1 ELSE z0 END / temperature), 6) AS nll FROM z, t GROUP BY temperature")
def calibration_grid(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null")
    sign = F.when(F.col("event_id") % 5 == 0, -1).otherwise(1) * F.when(F.col("event_id") % 2 == 1, 1).otherwise(-1)
    return M.nll(e.select((F.col("event_id") % 2).cast("int").alias("y"), F.lit(0.0).alias("z0"), (sign * F.col("value") / 50).alias("z1")), _GRID)


@query("SELECT round(coalesce(max(abs(value - round(value, 2))), 0), 6) AS max_delta, coalesce(max(abs(value - round(value, 2))), 0) < 0.02 AS passed FROM events")
def parity_delta(spark, sf_dir):
    return M.parity(read(spark, sf_dir, "events").select(F.col("value").alias("a"), F.round("value", 2).alias("b")))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, n, v[(n // 2) + 1] AS p50, v[least((n * 95) // 100, n - 1) + 1] AS p95 FROM s")
def latency_nearest_rank(spark, sf_dir):
    return M.nearest_rank(read(spark, sf_dir, "events").select("event_type", "value"), "value", "event_type")


@query("WITH s AS (SELECT user_id, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, n, v[least((n * 95) // 100, n - 1) + 1] AS p95, v[least((n * 95) // 100, n - 1) + 1] < 50 AS passed FROM s")
def latency_budget(spark, sf_dir):
    return M.within_budget(read(spark, sf_dir, "events").select("user_id", "value"), "value", "user_id")


_TOKENS = r"tok AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) AS token FROM documents), cnt AS (SELECT token, count(*) AS freq FROM tok GROUP BY token)"


@query(O.q(_TOKENS, select="SELECT token, freq FROM cnt"))
def token_freq(spark, sf_dir):
    return D.token_counts(read(spark, sf_dir, "documents"))


@query(O.q(_TOKENS, select="SELECT row_number() OVER (ORDER BY token) - 1 AS new_id, token, freq FROM (SELECT * FROM cnt WHERE freq >= 5 ORDER BY freq DESC, token LIMIT 1000)"))
def vocab_topk(spark, sf_dir):
    return D.vocabulary(D.token_counts(read(spark, sf_dir, "documents")), 1000)


@query("SELECT label, pos, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY label, pos")
def mean_pool(spark, sf_dir):
    return D.mean_pool(read(spark, sf_dir, "embeddings"))


@query("WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings), m AS (SELECT *, CASE WHEN pos % 9 = 8 OR (vec_id + pos) % 3 = 0 THEN 0 ELSE 1 END AS m FROM e) SELECT label, pos, round(sum(x * m) / greatest(sum(m), 1e-9), 5) AS mean FROM m GROUP BY label, pos")
def masked_mean_pool(spark, sf_dir):
    """Means under a mask; each ninth coordinate is masked everywhere."""
    e = read(spark, sf_dir, "embeddings")
    return D.mean_pool(e.withColumn("mask", F.transform("embedding", lambda _, i: F.when((i % 9 == 8) | ((F.col("vec_id") + i) % 3 == 0), 0).otherwise(1))))


@query("WITH e AS (SELECT vec_id // 32 AS batch, label AS layer, unnest(embedding)::DOUBLE AS a, unnest(list_reverse(embedding))::DOUBLE AS b FROM embeddings) SELECT batch, round(avg(m), 6) AS loss FROM (SELECT batch, layer, avg((a - b) * (a - b)) AS m FROM e GROUP BY ALL) GROUP BY batch")
def hidden_layer_loss(spark, sf_dir):
    """The distance of two sets of hidden states, averaged over layers, for each batch."""
    e = read(spark, sf_dir, "embeddings")
    return R.layer_loss(e.select(F.floor(F.col("vec_id") / 32).alias("batch"), F.col("label").alias("layer"), F.col("embedding").alias("a"), F.reverse("embedding").alias("b")))


_HOSTS = "SELECT DISTINCT lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1)) AS domain FROM pages WHERE url IS NOT NULL"
_M, _K = 2048, 7
_HALF = lambda at: f"(('0x' || substr(sha256(domain), {at}, 16))::UBIGINT::HUGEINT - CASE WHEN ('0x' || substr(sha256(domain), {at}, 1))::INT >= 8 THEN 18446744073709551616::HUGEINT ELSE 0 END)"


@query(f"WITH h AS ({_HOSTS}), p AS (SELECT domain, unnest(list_distinct(list_transform(range({_K}), lambda i: ((({_HALF(1)} + i * {_HALF(17)}) % {_M}) + {_M}) % {_M}))) AS bit FROM h), b AS (SELECT DISTINCT bit FROM p WHERE contains(domain, 'th')) SELECT domain, count(*) = count(b.bit) AS maybe FROM p LEFT JOIN b USING (bit) GROUP BY domain")
def bloom_membership(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").where("url is not null").select(F.lower(F.regexp_extract("url", "^[^:]*://([^/?#:]*)", 1)).alias("domain")).distinct()
    return B.probe(hosts, B.build(hosts.where(F.contains("domain", F.lit("th"))), _M, _K), _M, _K)


@query("SELECT alias, count(DISTINCT s_suppkey) AS owners FROM (SELECT s_suppkey, lower(unnest([s_name, n_name, 'The ' || n_name])) AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY alias HAVING count(DISTINCT s_suppkey) > 1")
def duplicate_aliases(spark, sf_dir):
    """Suppliers as brands: each has its own name, and that of its nation in two forms."""
    both = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return C.duplicate_aliases(both.select(F.col("s_suppkey").alias("brand_id"), F.array("s_name", "n_name", F.concat(F.lit("THE "), "n_name")).alias("aliases")))


@query("SELECT 'p' || p_partkey || '.click' AS domain, 's' || (p_partkey % 2500) AS brand_id FROM part WHERE p_partkey % 2500 NOT IN (SELECT s_suppkey FROM supplier)")
def fk_violations(spark, sf_dir):
    """Domains that parts stand for, operated by suppliers, some of which do not exist."""
    operated = read(spark, sf_dir, "part").selectExpr("'p' || p_partkey || '.click' AS domain", "'s' || (p_partkey % 2500) AS brand_id")
    return C.unknown_brands(operated, read(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey AS brand_id"))


@query("""WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'XX' ELSE upper(lang) END AS lang, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE toxic END AS label, CASE WHEN doc_id % 3 = 0 THEN 'NOT_SCAM' WHEN doc_id % 13 = 0 THEN NULL ELSE 'OTHER_SCAM' END AS category FROM documents JOIN labels USING (doc_id))
SELECT id, 'lang' AS message FROM r WHERE lang NOT IN ('EN', 'HI', 'HI_LATN', 'BN', 'TA', 'TE', 'MR', 'UNKNOWN') OR lang IS NULL UNION ALL SELECT id, 'label' FROM r WHERE label NOT IN (0, 1)
UNION ALL SELECT id, 'category missing' FROM r WHERE label IS NOT NULL AND category IS NULL
UNION ALL SELECT id, 'label and category' FROM r WHERE (label = 0 AND category <> 'NOT_SCAM') OR (label = 1 AND category = 'NOT_SCAM')""")
def row_constraints(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    i = F.col("doc_id")
    return C.row_violations(d.select(i.alias("id"), F.when(i % 5 == 0, "XX").otherwise(F.upper("lang")).alias("lang"), F.when(i % 11 == 0, 2).otherwise(F.col("toxic")).alias("label"), F.when(i % 3 == 0, "NOT_SCAM").when(i % 13 == 0, None).otherwise("OTHER_SCAM").alias("category")))


@query("SELECT count(*) AS sampled, count(*) FILTER (doc_id % 4 <> 0 AND quality = toxic) AS agreed, coalesce(round(count(*) FILTER (doc_id % 4 <> 0 AND quality = toxic)::DOUBLE / nullif(count(*), 0), 6), 1.0) AS rate FROM labels")
def audit_agreement(spark, sf_dir):
    """A second look at all labels, in which each fourth row was skipped."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), F.col("quality").alias("answer"))
    got = Lb.agreement(rows.select("id", "label"), rows.where("id % 4 <> 0").select("id", "answer"))
    return got.select("sampled", "agreed", F.round("rate", 6).alias("rate"))


@query("SELECT doc_id AS id FROM labels ORDER BY md5('0:' || doc_id::VARCHAR), doc_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.05, 0))::BIGINT FROM labels)")
def audit_sample(spark, sf_dir):
    return M.audit_sample(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), 0.05)


_DOC_IDS = f"d AS (SELECT doc_id, list_transform(list_filter(string_split({O.normalize_sql('text')}, ' '), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % 1000 + 1) AS ids FROM documents WHERE text IS NOT NULL)"


@query(O.q(_DOC_IDS, select="SELECT doc_id, 128 AS width, least(len(ids), 128) AS used, coalesce(list_sum(list_slice(ids, 1, 128)), 0)::BIGINT AS id_sum, coalesce(ids[128], 0)::BIGINT AS last_id, len(ids) > 128 AS truncated FROM d"))
def token_pack(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a file may be one row group, which one task would read and pack
    d = texts.repartition(parts, "doc_id").select("doc_id", Sc.pack(Sc.token_ids(T.normalize(F.col("text")), most=Sc.WIDTH + 1)).alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    return d.select("doc_id", F.size("p.attention_mask").cast("long").alias("width"), total(F.col("p.attention_mask")).alias("used"), total(F.col("p.input_ids")).alias("id_sum"), F.get("p.input_ids", F.lit(127)).alias("last_id"), "p.truncated")


from vigil.operators import labels as Lb  # noqa: E402

_AGES = "a AS (SELECT DISTINCT domain, CASE WHEN length(domain) % 3 = 0 THEN NULL ELSE length(domain) * 2 END AS age_days FROM h)"


@query(f"WITH h AS ({_HOSTS}), {_AGES}, k AS (SELECT domain FROM h WHERE contains(domain, 'th')) SELECT h.domain, 'DOMAIN_VERY_NEW' AS type, CASE WHEN age_days < 30 THEN 2 ELSE 0 END::INT AS severity FROM h JOIN a USING (domain) WHERE h.domain NOT IN (SELECT domain FROM k) AND (age_days IS NULL OR age_days < 30)")
def domain_age(spark, sf_dir):
    h = read(spark, sf_dir, "pages").where("url is not null").select(F.lower(F.regexp_extract("url", "^[^:]*://([^/?#:]*)", 1)).alias("domain")).distinct()
    ages = h.select("domain", F.when(F.length("domain") % 3 != 0, F.length("domain") * 2).alias("age_days"))
    return Lb.domain_age_evidence(h, ages, h.where(F.contains("domain", F.lit("th"))))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN toxic WHEN doc_id % 3 = 0 THEN 1 ELSE -1 END AS label, CASE WHEN doc_id % 2 = 0 THEN 'OLD' WHEN doc_id % 3 = 0 THEN 'OTHER_SCAM' END AS category, CASE WHEN doc_id % 2 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'b' END AS labeled_by FROM labels")
def label_session(spark, sf_dir):
    i = F.col("doc_id")
    old = lambda v: F.when(i % 2 == 0, v)
    rows = read(spark, sf_dir, "labels").select(i.alias("id"), old(F.col("toxic")).alias("label"), old(F.lit("OLD")).alias("category"), old(F.lit("a")).alias("labeled_by"), old(F.lit("t")).alias("labeled_at"))
    answers = read(spark, sf_dir, "labels").where("doc_id % 3 = 0").select(i.alias("id"), F.lit(1).alias("answer"), F.lit("OTHER_SCAM").alias("new_category"), F.lit("now").alias("at"))
    return Lb.apply_answers(rows, answers, "b").select("id", F.coalesce("label", F.lit(-1)).alias("label"), "category", "labeled_by")


# model signal, presentation, dataset rows


@query(O.q(O.CHAIN, O.MODEL, select="SELECT msg_id, round(p, 5) AS p, mt AS type, mc AS category, round(share, 5) AS share FROM model"))
def classifier_signal(spark, sf_dir):
    m = messages(spark, sf_dir).select("msg_id", T.normalize(F.col("text")).alias("normalized"))
    return Sc.scored(m, 1.5).select("msg_id", F.round("model.weight", 5).alias("p"), "model.type", "model.category", F.round("model.hint", 5).alias("share"))


@query(O.q(O.CHAIN, O.MODEL, select="SELECT msg_id, verdict, confidence, round(score::DOUBLE, 4) AS score FROM mverdict"))
def fusion_with_model(spark, sf_dir):
    return _verdicts(spark, sf_dir, 1.5).select("msg_id", "verdict", "confidence", _r("score", 4).alias("score"))


@query(O.q(O.CHAIN, O.MODEL, """ev AS (SELECT msg_id, severity, uw AS weight, 1 AS sig, ord AS a, pos AS b, type FROM url_ev JOIN v USING (msg_id)
  UNION ALL SELECT msg_id, ss, sw, 2, 0, 0, sender FROM v WHERE sender IS NOT NULL UNION ALL SELECT msg_id, severity, pw, 3, ord, 0, type FROM fired JOIN v USING (msg_id)
  UNION ALL SELECT msg_id, CASE mt WHEN 'MODEL_HIGH_SCAM_SCORE' THEN 1 ELSE 0 END, p::FLOAT, 4, 0, 0, mt FROM model WHERE mt IS NOT NULL)""", select="SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY severity DESC, weight DESC, sig, a, b))::INT AS rank, type FROM ev"))
def evidence_with_model(spark, sf_dir):
    return V.evidence_rows(_verdicts(spark, sf_dir, 1.5)).select("msg_id", "rank", "e.type")


_WORDS = "heads AS (SELECT * FROM " + rules.values_sql([(v, rules.HEADLINES[v], rules.COLOURS[v]) for v in rules.HEADLINES], "t", "verdict, headline, colour") + "), leads AS (SELECT * FROM " + rules.values_sql(list(rules.LEAD_INS.items()), "t", "category, lead") + "), sure AS (SELECT * FROM " + rules.values_sql(list(rules.CONFIDENCE_TEXTS.items()), "t", "confidence, confidence_text") + ")"


@query(O.q(O.CHAIN, O.HINTS, "top_hint AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY total DESC, first) AS r FROM sums)", _WORDS, select="""SELECT v.msg_id, headline, colour, confidence_text, CASE WHEN v.verdict = 'SAFE' THEN NULL ELSE lead END AS first_action, CASE WHEN v.verdict = 'SAFE' THEN 0 ELSE 5 END AS n_actions
  FROM v JOIN heads USING (verdict) JOIN sure USING (confidence) LEFT JOIN top_hint ON v.msg_id = top_hint.msg_id AND r = 1 LEFT JOIN leads ON leads.category = coalesce(top_hint.category, 'OTHER_SCAM')"""))
def presentation(spark, sf_dir):
    p = V.presented(_verdicts(spark, sf_dir))
    return p.select("msg_id", "headline", "colour", "confidence_text", F.get("actions", F.lit(0)).alias("first_action"), F.size("actions").alias("n_actions"))


@query(O.q(O.CHAIN, select="SELECT msg_id, verdict, 'PATTERN,SENDER,URL' AS analyzers, '1' AS pack_version, NULL::VARCHAR AS model_version, msg_id % 50 AS latency_ms FROM v"))
def analysis_results(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("received_at_ms", F.col("msg_id") * 1000).withColumn("done_at_ms", F.col("msg_id") * 1000 + F.col("msg_id") % 50)
    return V.results(V.verdicts(m, None, _known(spark, sf_dir), domain_ages(spark, sf_dir)), "1").withColumn("analyzers", F.array_join("analyzers", ","))


@query("SELECT upper(r_name) AS header, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def header_brand_names(spark, sf_dir):
    """Nations as brands, regions as the headers that they share."""
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.header_owners(both.select(F.col("n_name").alias("name"), F.array(F.upper("r_name")).alias("headers")))


_ROWS = "r AS (SELECT d.doc_id AS id, d.source, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE toxic END AS label, CASE d.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' WHEN 2 THEN NULL ELSE 'train' END AS split FROM documents d JOIN labels USING (doc_id))"


def _rows(spark, sf_dir):
    i = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return d.select(i.alias("id"), "source", F.when(i % 4 != 0, F.col("toxic")).alias("label"), F.when(i % 5 == 0, "test").when(i % 5 == 1, "val").when(i % 5 > 2, "train").alias("split"))


@query(O.q(_ROWS, select="SELECT id, label FROM r WHERE label IS NOT NULL AND split = 'test'"))
def labelled_rows(spark, sf_dir):
    return R.labelled(_rows(spark, sf_dir), "test").select("id", "label")


@query(O.q(_ROWS, select="SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS positives FROM r WHERE split IS NOT NULL GROUP BY split"))
def split_counts(spark, sf_dir):
    return R.split_counts(_rows(spark, sf_dir))


@query(O.q(_ROWS, """k AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || id::VARCHAR), id) AS n FROM r WHERE label IS NOT NULL)""", select="SELECT id, label, (row_number() OVER (ORDER BY md5('order 0:' || id::VARCHAR), id) - 1)::INT AS place FROM k WHERE n <= CASE label WHEN 1 THEN 7 ELSE 11 END"))
def stratified_sample(spark, sf_dir):
    return R.stratified(_rows(spark, sf_dir), "label", {1: 7, 0: 11})


@query(O.q(_ROWS, select="SELECT id FROM r WHERE split = 'test' ORDER BY id LIMIT 200"))
def parity_rows(spark, sf_dir):
    return R.first_rows(_rows(spark, sf_dir), "test", 200).select("id")


@query(O.q(_ROWS, "a AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM r), b AS (SELECT id % 3 AS prediction, row_number() OVER (ORDER BY id) - 1 AS place FROM r)", select="SELECT place, id, prediction FROM a JOIN b USING (place)"))
def zipped_predictions(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    rows = _rows(spark, sf_dir).select("id")
    return R.zipped(rows, rows.select("id", (F.col("id") % 3).alias("prediction")), "id").select("place", "id", "prediction")


@query(O.q(_ROWS, select="SELECT source, count(*) AS n FROM r WHERE source IS NULL OR source <> 'uci_sms_spam_collection' GROUP BY source"))
def unsafe_sources(spark, sf_dir):
    return R.unsafe_sources(_rows(spark, sf_dir))


@query(f"SELECT domain FROM ({_HOSTS}) WHERE contains(domain, '.') AND NOT regexp_matches(domain, '[^\\x00-\\x7F]')")
def dotted_ascii_domains(spark, sf_dir):
    h = read(spark, sf_dir, "pages").where("url is not null").select(F.lower(F.regexp_extract("url", "^[^:]*://([^/?#:]*)", 1)).alias("domain")).distinct()
    return R.dotted_ascii(h)


@query("SELECT p_partkey AS brand_id, CASE p_partkey % 4 WHEN 0 THEN 'Pay' ELSE 'SECURE' END AS alias FROM part WHERE p_partkey % 4 < 2")
def bare_noun_aliases(spark, sf_dir):
    """Parts as brands; half of them are called by a common noun as well."""
    alias = F.when(F.col("p_partkey") % 4 == 0, "Pay").when(F.col("p_partkey") % 4 == 1, "SECURE").otherwise(F.col("p_name"))
    return R.bare_nouns(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("brand_id"), F.array(alias, "p_brand").alias("aliases")))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return R.repeated(read(spark, sf_dir, "documents"), "lang")


@query("SELECT round(avg(m), 6) AS mean_loss FROM (SELECT avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY event_id // 32)")
def mean_batch_loss(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null")
    return R.mean_loss(e.select(F.floor(F.col("event_id") / 32).alias("batch"), F.col("value").alias("loss")))


@query("SELECT event_id, ((event_id * 86400000 + 5) - event_id * 43200000) // 86400000 AS days FROM events")
def whole_days(spark, sf_dir):
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", R.age_days(i * 43_200_000, i * 86_400_000 + 5).alias("days"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g')) AS line FROM documents")
def flat_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(R.flat_line(F.col("text"))).alias("line"))


_KEPT = "kept AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS new_id FROM (SELECT unnest(['<pad>', '<unk>']) AS token UNION ALL SELECT token FROM (SELECT token FROM cnt WHERE freq >= 5 AND token NOT IN ('<pad>', '<unk>') ORDER BY freq DESC, token LIMIT 298)))"


def _kept(spark, sf_dir):
    return R.kept_tokens(D.token_counts(read(spark, sf_dir, "documents")), ["<unk>", "<pad>", "<unk>"], 300)


@query(O.q(_TOKENS, _KEPT, select="SELECT token, new_id FROM kept"))
def kept_tokens(spark, sf_dir):
    return _kept(spark, sf_dir)


_CASED = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s\x{85}\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+')) AS token FROM documents), cnt AS MATERIALIZED (SELECT token, count(*) AS freq FROM tok GROUP BY token)"
_CASED_KEPT = _KEPT.replace("kept AS (", "kept AS MATERIALIZED (")


def _cased(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    counts = D.token_counts(read(spark, sf_dir, "documents"), lower=False).checkpoint()
    return counts, R.kept_tokens(counts, ["<unk>", "<pad>", "<unk>"], 300).checkpoint()


@query(O.q(_CASED, _CASED_KEPT, "numbered AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS old_id FROM cnt)", select="SELECT new_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last, len(embedding) AS width FROM kept JOIN numbered USING (token) JOIN embeddings ON vec_id = old_id"))
def remapped_embedding(spark, sf_dir):
    """Rows of the embedding table (a token's row is that of its place among all tokens) under the ids of the kept ones."""
    counts, kept = _cased(spark, sf_dir)
    vectors = read(spark, sf_dir, "embeddings").join(R.placed(counts.select("token"), "token"), F.col("vec_id") == F.col("place")).select("token", "embedding")
    e = F.col("embedding")
    return R.remapped(vectors, kept).select("new_id", _r(F.get(e, F.lit(0))).alias("first"), _r(F.element_at(e, -1)).alias("last"), F.size(e).cast("long").alias("width"))


@query(O.q(_CASED, _CASED_KEPT, "unknown AS MATERIALIZED (SELECT new_id AS unk FROM kept WHERE token = '<unk>')", select="SELECT doc_id, count(*) AS n, sum(coalesce(new_id, unk))::BIGINT AS id_sum, count(*) FILTER (new_id IS NULL) AS unknown FROM tok LEFT JOIN kept USING (token), unknown GROUP BY doc_id"))
def pruned_tokens(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    kept = _cased(spark, sf_dir)[1]
    unk = F.broadcast(kept.where("token = '<unk>'").select(F.col("new_id").alias("unk")))
    e = R.encoded(docs, kept, "<unk>").crossJoin(unk)  # one row
    return e.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("token_id").alias("id_sum"), F.count_if(F.col("token_id") == F.col("unk")).alias("unknown"))


_POOL = ", ".join(f"round(list_avg(list_slice(embedding::DOUBLE[], (floor(len(embedding) * {i} / 5) + 1)::BIGINT, ceil(len(embedding) * {i + 1} / 5)::BIGINT)), 5) AS p{i}" for i in range(5))


@query(f"SELECT vec_id, {_POOL} FROM embeddings WHERE len(embedding) >= 5")
def adaptive_pooling(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").where(F.size("embedding") >= 5).select("vec_id", R.adaptive_pool(F.col("embedding"), 5).alias("p"))
    return e.select("vec_id", *[F.round(F.get("p", F.lit(i)), 5).alias(f"p{i}") for i in range(5)])


#: Some turns are nothing but white space of one kind or another.
_TYPED = "SELECT conv_id * 1000 + turn AS msg_id, CASE conv_id % 7 WHEN 0 THEN chr(9) || chr(10) WHEN 1 THEN chr(160) || ' ' WHEN 2 THEN ' ' || chr(13) || chr(10) || text WHEN 3 THEN '' ELSE text END AS text FROM {conversations}"


@query(f"SELECT msg_id, text, NULL::VARCHAR AS sender_hint FROM ({_TYPED.format(conversations='conversations')}) WHERE regexp_matches(text, '[^\\s\\x{{A0}}]')")
def entered_messages(spark, sf_dir):
    from vigil.sources.messages import entered

    return entered(spark.sql(_TYPED, conversations=read(spark, sf_dir, "conversations")))


@query(f"SELECT msg_id, CASE WHEN regexp_matches(text, '[^\\s\\x{{A0}}]') THEN text END AS text FROM ({_TYPED.format(conversations='conversations')})")
def shared_messages(spark, sf_dir):
    from vigil.sources.messages import shared

    return shared(spark.sql(_TYPED, conversations=read(spark, sf_dir, "conversations")))


_ZED = "z AS (SELECT CASE WHEN event_id % 2 = 1 THEN z1 ELSE -z1 END AS m FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END * (CASE WHEN event_id % 2 = 1 THEN 1 ELSE -1 END) * value / 50 AS z1 FROM events WHERE value IS NOT NULL))"


@query("WITH RECURSIVE " + _ZED + ", s AS (SELECT 0 AS i, ln(0.05) AS low, ln(20.0) AS high UNION ALL SELECT i + 1, CASE WHEN (SELECT sum(m / (1 + exp(exp((low + high) / 2) * m))) FROM z) > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN (SELECT sum(m / (1 + exp(exp((low + high) / 2) * m))) FROM z) > 0 THEN high ELSE (low + high) / 2 END FROM s WHERE i < 40) SELECT round(exp(-(low + high) / 2), 3) AS temperature FROM s WHERE i = 40")
def fitted_temperature(spark, sf_dir):
    """The temperature of the calibration grid's logits."""
    e = read(spark, sf_dir, "events").where("value is not null")
    sign = F.when(F.col("event_id") % 5 == 0, -1).otherwise(1) * F.when(F.col("event_id") % 2 == 1, 1).otherwise(-1)
    rows = e.select((F.col("event_id") % 2).cast("int").alias("y"), F.lit(0.0).alias("z0"), (sign * F.col("value") / 50).alias("z1"))
    return spark.createDataFrame([(round(Lb.fit_temperature(rows), 3),)], "temperature double")


def _trained(spark, sf_dir):
    """Documents with labels and a fold: 0 and 1 train, 3 validation, 2 held out; and the folder of a model trained on them."""
    from vigil.operators import training as Tr

    folder = _folder(spark, "model")
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    rows = d.withColumn("fold", fold).withColumn("category", F.when(F.col("label") == 0, "NOT_SCAM").otherwise(T.keyword_category(F.col("text")))).withColumn("is_val", F.col("fold") == 3)
    weights, history = Tr.train(rows.where("fold <> 2"))
    Tr.write_model(spark, folder, weights, 1.0, history)
    validation = Tr.binary_logits(rows.where("fold = 3").withColumn("normalized", T.normalize(F.col("text"))), folder)
    Tr.write_model(spark, folder, weights, Lb.fit_temperature(validation), history)
    return rows, folder


@query()
def trained_signal(spark, sf_dir):
    """The model signal of every labelled document from weights that were trained, calibrated, written and read again."""
    from vigil.operators import training as Tr

    rows, folder = _trained(spark, sf_dir)
    on = Tr.scored_by(folder)(rows.withColumn("normalized", T.normalize(F.col("text"))))
    return on.select("doc_id", "fold", "label", F.round("model.weight", 5).alias("p"), "model.type", "model.category")


@query()
def trained_metrics(spark, sf_dir):
    """Class metrics of the trained scorer on each fold; fold 2 was neither trained on nor chosen by."""
    from vigil.operators import training as Tr

    rows, folder = _trained(spark, sf_dir)
    on = Tr.scored_by(folder)(rows.withColumn("normalized", T.normalize(F.col("text"))))
    return M.binary(on.select("fold", F.col("label").alias("y"), (F.col("model.weight") >= 0.5).cast("int").alias("pred")), "fold")


@query()
def trained_verdict(spark, sf_dir):
    """Verdicts of the messages with the trained scorer as the classifier's plug-in."""
    from vigil.operators import plugins as P
    from vigil.operators import training as Tr

    plugins = {**P.built_in(_known(spark, sf_dir), domain_ages(spark, sf_dir)), P.CLASSIFIER: P.model_plugin(None, Tr.scored_by(_trained(spark, sf_dir)[1]))}
    got = P.fused(P.orchestrated(messages(spark, sf_dir), plugins))
    return got.select("msg_id", "verdict", "confidence", _r("score", 4).alias("score"), F.array_join("scored", ",").alias("scored"))


# plug-ins and the SQL surface


@query(O.q(O.CHAIN, O.MODEL, select="""SELECT v.msg_id, CASE WHEN contains(text, 'OTP') THEN v.verdict ELSE m.verdict END AS verdict, CASE WHEN contains(text, 'OTP') THEN v.confidence ELSE m.confidence END AS confidence,
  'CLASSIFIER,EXTRA,PATTERN,SENDER,URL' AS analyzers, CASE WHEN contains(text, 'OTP') THEN 'PATTERN,SENDER,URL' ELSE 'CLASSIFIER,PATTERN,SENDER,URL' END AS scored, CASE WHEN contains(text, 'OTP') THEN 'EXTRA: no such file;CLASSIFIER: cannot read OTP' ELSE 'EXTRA: no such file' END AS unavailable
  FROM v JOIN mverdict m USING (msg_id) JOIN messages USING (msg_id)"""))
def plugin_verdicts(spark, sf_dir):
    """Four analyzers and one that does not load; the classifier fails on some rows."""
    from vigil.operators import plugins as P

    def missing(df, name):
        raise FileNotFoundError("no such file")

    def classifier(df, name):
        refused = F.contains("text", F.lit("OTP"))
        on = P.model_plugin(1.5)(df, "_found")
        return on.withColumn(name, F.when(refused, P.unavailable(F.lit("cannot read OTP"))).otherwise(F.col("_found").cast(P.SIGNAL))).drop("_found")

    plugins = {"EXTRA": missing, P.CLASSIFIER: classifier, **P.built_in(_known(spark, sf_dir), domain_ages(spark, sf_dir))}
    got = P.fused(P.orchestrated(messages(spark, sf_dir), plugins))
    return got.select("msg_id", "verdict", "confidence", F.array_join("analyzers", ",").alias("analyzers"), F.array_join("scored", ",").alias("scored"), F.array_join(F.transform("unavailable", lambda u: F.concat_ws(": ", u["id"], u["reason"])), ";").alias("unavailable"))


@query(O.q(O.MESSAGES, "c AS (SELECT msg_id, count(*) AS n FROM msgs WHERE contains(normalized, 'z') GROUP BY msg_id)", select="SELECT msg_id, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE round((length(text) / 1000.0::FLOAT)::DOUBLE, 4) END AS weight, CASE WHEN length(text) % 5 = 0 THEN 'a fifth of all' END AS reason FROM msgs"))
def guarded_plugin(spark, sf_dir):
    """A plug-in in Python that raises on some rows: they have a reason, the others a weight."""
    from vigil.operators import plugins as P

    def analyze(text, hint):
        if len(text) % 5 == 0:
            raise ValueError("a fifth of all")
        return {"weight": len(text) / 1000}

    df = P.guarded(analyze)(messages(spark, sf_dir), "s")
    return df.select("msg_id", F.round(F.col("s.weight").cast("double"), 4).alias("weight"), "s.reason")


@query(O.q(O.MESSAGES, O.URLS, O.registrable("urls"), O.CLAIMS, select=f"""SELECT u.msg_id, u.ord, u.host, m.lang_text, registrable, {O.IS_IP.replace('host', 'u.host')} AS ip, {O._fold("split_part(registrable, '.', 1)")} AS folded, {O._SQUASH("split_part(registrable, '.', 1)")} AS bare, brand_id
  FROM urls u JOIN (SELECT host AS h, CASE registrable {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in O._WIRE)} ELSE registrable END AS registrable FROM reg) r ON h = u.host JOIN (SELECT msg_id, normalized AS lang_text FROM msgs) m USING (msg_id) LEFT JOIN claims USING (msg_id)"""))
def sql_surface(spark, sf_dir):
    """The same functions from SQL text alone, table functions in lateral joins included."""
    from vigil.functions import sql

    sql.register(spark)
    return spark.sql(
        """SELECT m.msg_id, u.ord, u.host, norm_text(m.text) AS lang_text, registrable_domain(u.host) AS registrable, is_ip_literal(u.host) AS ip,
             fold_label(split_part(registrable_domain(u.host), '.', 1)) AS folded, squash_label(split_part(registrable_domain(u.host), '.', 1)) AS bare, b.brand_id
           FROM {m} m, LATERAL extract_urls(m.text) u LEFT JOIN LATERAL extract_brands(m.text) b ON true""",
        m=messages(spark, sf_dir),
    )


# a pack that was written and loaded again


def _pack(spark, sf_dir, **parts):
    from vigil.sources import pack

    folder = _folder(spark, "pack")
    own = spark.createDataFrame([(d,) for b in rules.BRANDS for d in b[3]], "domain string")
    pack.write(spark, pack.Pack(version="2", **parts), folder, "2024-01-01", pack.reputation_bytes(ranked_domains(spark, sf_dir), own))
    return pack.load(spark, folder)


@query(O.q(O.CHAIN, select="SELECT msg_id, verdict, confidence FROM v"))
def verdict_with_pack(spark, sf_dir):
    return V.verdicts(messages(spark, sf_dir), pack=_pack(spark, sf_dir), ages=domain_ages(spark, sf_dir)).select("msg_id", "verdict", "confidence")


_ASKED = f"asked AS ({_HOSTS} UNION SELECT 'northpay-' || (p_partkey % 9000 + 1000) || '.xyz' FROM part UNION SELECT 'northpay.com' FROM part)"


@query(O.q(O.REPUTATION, _ASKED, O.bloom("ranked_domains", "asked"), select=f"SELECT domain, maybe OR domain IN ({', '.join(repr(d) for b in rules.BRANDS for d in b[3])}) AS known FROM maybe"))
def established_domains(spark, sf_dir):
    from vigil.sources import pack

    h = read(spark, sf_dir, "pages").where("url is not null").select(F.lower(F.regexp_extract("url", "^[^:]*://([^/?#:]*)", 1)).alias("domain")).distinct()
    own = read(spark, sf_dir, "part").selectExpr("explode(array('northpay-' || (p_partkey % 9000 + 1000) || '.xyz', 'northpay.com')) AS domain").distinct()
    return pack.established(h.union(own), _pack(spark, sf_dir).reputation)


def _nations(spark, sf_dir):
    """Nations, a bounded table, as the brands of a pack: their region's name is an alias that several share."""
    both = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()
    return [(r.n_name.lower(), r.n_name, [r.n_name, r.r_name, "card"][: 2 + (r.n_nationkey % 10 == 0)], [f"n{r.n_nationkey}.com"], [f"N{r.n_nationkey}"]) for r in rows]


@query("WITH n AS (SELECT count(*) AS n, count(*) FILTER (n_nationkey % 10 = 0) AS more FROM nation) SELECT 'aliases' AS part, (2 * n + more)::INT AS n FROM n UNION ALL SELECT 'brands', n FROM n UNION ALL SELECT 'domains', n FROM n UNION ALL SELECT * FROM (VALUES ('folds', 14), ('patterns', 14), ('shorteners', 4), ('suffixes', 13)) v(part, n)")
def pack_counts(spark, sf_dir):
    """What a pack holds that was written with the nations as brands and read again."""
    from vigil.sources import pack

    return spark.createDataFrame(sorted(pack.counts(_pack(spark, sf_dir, brands=_nations(spark, sf_dir))).items()), "part string, n int")


@query("""WITH n AS (SELECT n_nationkey, n_name, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'brands' AS part, r_name AS subject, 'alias of two brands' AS rule FROM n WHERE k > 1 UNION ALL SELECT 'brands', 'card', 'bare common noun' FROM n WHERE n_nationkey % 10 = 0
UNION ALL SELECT 'brands', 'card', 'alias of two brands' FROM n WHERE n_nationkey % 10 = 0 AND n_nationkey > 0 UNION ALL SELECT * FROM (VALUES ('shorteners', 'x.y', 'unknown brand'), ('suffixes', '13', 'too few rules')) v""")
def pack_violations(spark, sf_dir):
    from vigil.sources import pack

    return pack.violations(spark, pack.Pack(brands=_nations(spark, sf_dir), brand_operated={"x.y": "none"}))


_FIELDS = """b AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_nationkey AS k, lower(n_name) AS id, substr(n_name, 1, (n_nationkey % 5)::INT) AS alias, lower(n_name) || '.com' AS domain, n_name AS header FROM nation)"""


@query(O.q(_FIELDS, select=r"""SELECT 'banks.json' AS file, path, message FROM (
  SELECT '/brands/' || i || '/id' AS path, 'does not match ^[a-z][a-z0-9_]*$' AS message FROM b WHERE NOT regexp_matches(id, '^[a-z][a-z0-9_]*$')
  UNION ALL SELECT '/brands/' || i || '/aliases/0', 'is shorter than 3' FROM b WHERE length(alias) < 3
  UNION ALL SELECT '/brands/' || i || '/domains/0', 'does not match ^[a-z0-9.-]+\.[a-z]{2,}$' FROM b WHERE NOT regexp_matches(domain, '^[a-z0-9.-]+\.[a-z]{2,}$')
  UNION ALL SELECT '/brands/' || i || '/dlt_headers/0', 'does not match ^[A-Z0-9]{3,9}$' FROM b WHERE NOT regexp_matches(header, '^[A-Z0-9]{3,9}$')
  UNION ALL SELECT '/brands/' || i || '/display_name', 'is missing' FROM b WHERE k % 7 = 3 UNION ALL SELECT '/brands/' || i || '/colour', 'is unknown' FROM b WHERE k % 7 = 4
  UNION ALL SELECT '/brands', 'has fewer than 120 items')"""))
def pack_schema(spark, sf_dir):
    """Everything that is wrong with a table of brands made of the nations."""
    import json

    from vigil.sources import pack, schema

    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a bounded table

    def brand(r):
        b = {"id": r.n_name.lower(), "display_name": r.n_name, "aliases": [r.n_name[: r.n_nationkey % 5]], "domains": [f"{r.n_name.lower()}.com"], "dlt_headers": [r.n_name], "_remark": 1}
        if r.n_nationkey % 7 == 3:
            del b["display_name"]
        return b | ({"colour": "red"} if r.n_nationkey % 7 == 4 else {})

    folder = _folder(spark, "schema")
    pack.put(spark, f"{folder}/{pack.FILES['brands']}", json.dumps({"schema_version": 1, "brands": [brand(r) for r in rows]}).encode())
    return schema.violations(spark, folder, {"brands": pack.FILES["brands"]}).select("file", "path", "message")


# files that are written and read again


@query(f"SELECT row_number() OVER (ORDER BY domain) AS rank, domain FROM ({_HOSTS}) WHERE contains(domain, '.') AND NOT regexp_matches(domain, '[^\\x00-\\x7F]')")
def ranked_archive(spark, sf_dir):
    """The hosts of the pages, ranked by name, through an archive."""
    from vigil.sources import archive

    h = read(spark, sf_dir, "pages").where("url is not null").select(F.lower(F.regexp_extract("url", "^[^:]*://([^/?#:]*)", 1)).alias("domain")).distinct()
    path = _folder(spark, "archive") + "/top.zip"
    archive.write_archive(spark, R.placed(R.dotted_ascii(h), "domain").select((F.col("place") + 1).alias("rank"), "domain"), path)
    return archive.ranked(spark, path)[0]


@query(O.q(O.CHAIN, O.MODEL, select="SELECT (row_number() OVER (ORDER BY msg_id) - 1)::INT AS ord, text, round(p, 5) AS p_scam, 0.02::DOUBLE AS max_delta FROM model JOIN messages USING (msg_id) ORDER BY msg_id LIMIT 200"))
def parity_fixture(spark, sf_dir):
    """The first 200 messages with their scores, through a fixture file."""
    from vigil.sources import aligned

    first = messages(spark, sf_dir).orderBy("msg_id").limit(200).select(F.col("msg_id").alias("id"), "text", T.normalize(F.col("text")).alias("normalized"))
    path = _folder(spark, "fixture") + "/parity.json"
    aligned.write_fixture(spark, Sc.scored(first, 1.5).select("id", "text", F.col("model.weight").alias("p_scam")), path, "stand-in")
    return aligned.read_fixture(spark, path).withColumn("p_scam", F.round("p_scam", 5))


@query("SELECT md5(coalesce(regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g'), '')) AS line, toxic::VARCHAR AS label FROM documents JOIN labels USING (doc_id)")
def aligned_files(spark, sf_dir):
    """Texts and labels through files that correspond line by line."""
    from vigil.sources import aligned

    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    folder = _folder(spark, "aligned")
    aligned.write_aligned(d, folder, "doc_id")
    return aligned.read_aligned(spark, folder).select(F.md5("text").alias("line"), "label")


_EXTRA = "SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark"


@query(f"WITH tok AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+')) AS token FROM ({_EXTRA})) SELECT token, count(*) AS freq FROM tok GROUP BY token HAVING count(*) >= 5")
def vocab_with_extra(spark, sf_dir):
    """Frequent tokens of the corpus together with extra sample texts."""
    extra = read(spark, sf_dir, "benchmark").select("text")
    return D.token_counts(R.together(read(spark, sf_dir, "documents").select("text"), extra)).where("freq >= 5")


@query(O.q(O.CHAIN, select="SELECT msg_id, verdict, confidence FROM v"))
def stream_verdicts(spark, sf_dir):
    """The messages as a stream of files, each written with its verdict once."""
    from vigil.streaming import verdicts as St

    folder = _folder(spark, "stream")
    m = messages(spark, sf_dir).select("msg_id", "sender_hint", "text", (F.timestamp_seconds(F.col("msg_id") % 1000)).alias("received_at"))
    m.repartition(8, "msg_id").write.json(f"{folder}/in")
    stream = spark.readStream.schema("msg_id long, sender_hint string, text string, received_at timestamp").option("maxFilesPerTrigger", 4).json(f"{folder}/in")
    St.verdicts_stream(stream, f"{folder}/out", f"{folder}/state", _known(spark, sf_dir), domain_ages(spark, sf_dir)).awaitTermination()
    return St.read_verdicts(spark, f"{folder}/out").select("msg_id", "verdict", "confidence")
