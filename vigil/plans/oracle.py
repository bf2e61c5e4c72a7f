"""DuckDB statements for the message queries, as a chain of common table expressions written independently of the plans."""

from __future__ import annotations

from vigil.sources import rules
from vigil.sources.messages import AGES_SQL, RANKED_SQL, messages_sql

_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))


def normalize_sql(t: str) -> str:
    """Full-width characters (the only ones of the data that compose), zero-width characters, blanks of other kinds."""
    q = "'"
    out = f"translate({t}, '{_WIDE.replace(q, q * 2)}', '{_NARROW.replace(q, q * 2)}')"
    out = f"translate(regexp_replace({out}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g'), '\u00a0\u2007\u202f', '   ')"
    return f"lower(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


def language_sql(t: str) -> str:
    """Over an expression that is already normalised."""
    seen = f"regexp_replace({t}, '\\s', '', 'g')"
    share = lambda a, b: f"length(regexp_replace({seen}, '[^\\x{{{a}}}-\\x{{{b}}}]', '', 'g')) / length({seen}) >= 0.2"
    words = ", ".join(f"'{w}'" for w in rules.ROMANISED_HINDI)
    marathi = ", ".join(f"'{w}'" for w in rules.MARATHI)
    return f"""CASE WHEN coalesce(length({seen}), 0) = 0 THEN 'UNKNOWN'
      WHEN {share('0900', '097F')} THEN CASE WHEN list_has_any(regexp_split_to_array({t}, '[^\\p{{L}}\\p{{M}}]+'), [{marathi}]) THEN 'MR' ELSE 'HI' END
      WHEN {share('0980', '09FF')} THEN 'BN' WHEN {share('0B80', '0BFF')} THEN 'TA' WHEN {share('0C00', '0C7F')} THEN 'TE'
      WHEN regexp_matches({seen}, '[A-Za-z]') THEN CASE WHEN len(list_filter(regexp_split_to_array({t}, '[^a-z0-9]+'), lambda w: w IN ({words}))) >= 2 THEN 'HI_LATN' ELSE 'EN' END
      ELSE 'UNKNOWN' END"""


def scrub_sql(t: str) -> str:
    # without look-around a match takes its neighbours along, so numbers one character apart need a second pass
    out = t
    for _ in range(2):
        out = f"regexp_replace({out}, '(^|[^0-9])(?:\\+?91[-\\s]?)?[6-9][0-9]{{9}}($|[^0-9])', '\\1<PHONE>\\2', 'g')"
    out = f"regexp_replace({out}, '(?i)(?:₹|rs\\.?|inr)\\s?[0-9,]+(?:\\.[0-9]+)?', '<AMT>', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(^|[^0-9])[0-9]{{9,18}}($|[^0-9])', '\\1<ACCT>\\2', 'g')"
    return f"""regexp_replace(regexp_replace(regexp_replace({out}, '\\b((?i:dear|hi|hello|hey|mr|mrs|ms|shri|smt|dr)\\.?)\\s+([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)', '\\1 <NAME>\x01\\2\x02', 'g'),
      ' <NAME>\x01((?i:customer|sir|madam|user|member|team|friend|valued|guest|all)(?:\\s+[A-Z][a-z]+)?)\x02', ' \\1', 'g'), '\x01[^\x02]*\x02', '', 'g')"""


# The keyword table as the oracle states it, first match wins
def keyword_category_sql(t: str) -> str:
    has = lambda *words: "(" + " OR ".join(f"regexp_matches(lower({t}), '\\b{w}\\b')" for w in words) + ")"
    return f"""CASE WHEN {has('won', 'winner', 'prize', 'award', 'claim', 'congratulations')} THEN 'LOTTERY_PRIZE'
      WHEN {has('loan', 'cash advance', 'overdraft')} THEN 'LOAN_APP'
      WHEN {has('verify', 'account suspended', 'update your account', 'update your details', 'kyc')} THEN 'KYC_PHISHING'
      WHEN {has('vacancy', 'part.?time job', 'earn \\$', 'earn £', 'earn per week')} THEN 'FAKE_JOB'
      WHEN {has('invest', 'shares', 'stock tip', 'double your money')} THEN 'INVESTMENT_TRADING'
      WHEN {has('parcel', 'delivery', 'courier', 'customs')} THEN 'COURIER_CUSTOMS'
      WHEN {has('virus', 'your pc', 'your computer', 'tech support')} THEN 'TECH_SUPPORT' ELSE 'OTHER_SCAM' END"""


# The grammar of links and labels as the oracle states it
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
PATH = r"(?:/[^\s<>\"'\x{A0}]*)?"
_RE = rf"https?://[^\s<>\"''\x{{A0}}]+|www\.{LABEL}(?:\.{LABEL})+{PATH.replace(chr(39), chr(39) * 2)}|{LABEL}(?:\.{LABEL})+{PATH.replace(chr(39), chr(39) * 2)}"
_PLAIN = ", ".join(f"'{s}'" for s in rules.SUFFIXES if "." not in s)


def _in(some) -> str:
    return "(" + ", ".join(f"'{x}'" for x in some) + ")"


MESSAGES = f"messages AS ({messages_sql()}), norm AS (SELECT *, {normalize_sql('text')} AS normalized FROM messages), msgs AS (SELECT *, {language_sql('normalized')} AS lang FROM norm)"

URLS = rf"""hits AS (SELECT msg_id, text, unnest(regexp_extract_all(text, '(?i)(?:^|[^\w@.])({_RE})', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '(?i)(?:^|[^\w@.])({_RE})', 1), 1) - 1 AS ord FROM messages),
parts AS (SELECT *, contains(raw, '://') AS has, regexp_replace(CASE WHEN contains(raw, '://') THEN substr(raw, strpos(raw, '://') + 3) ELSE raw END, '^[^/?#@]*@', '') AS rest FROM hits),
urls AS (SELECT msg_id, ord, raw, CASE WHEN has THEN split_part(raw, '://', 1) END AS scheme, regexp_extract(rest, '^([^/?#:]*)', 1) AS host, nullif(regexp_extract(rest, '^[^/?#:]*(.*)$', 1), '') AS path, strpos(text, raw) - 1 AS start, regexp_matches(lower(rest), '^([^/?#:]*\.)?xn--') AS punycode FROM parts
  WHERE regexp_extract(rest, '^([^/?#:]*)', 1) <> '' AND (has OR starts_with(lower(raw), 'www.') OR lower(split_part(regexp_extract(rest, '^([^/?#:]*)', 1), '.', -1)) IN ({_PLAIN})))"""

_KIND = [("exception", r[1:]) if r[0] == "!" else ("wildcard", r[2:]) if r[:2] == "*." else ("plain", r) for r in rules.SUFFIXES]
_QUAD = r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
IS_IP = rf"(regexp_matches(host, '{_QUAD}') OR (regexp_matches(host, '^\[?[0-9A-Fa-f:.]+\]?$') AND contains(host, ':')))"


def registrable(hosts: str) -> str:
    return f"""hosts AS (SELECT DISTINCT host, string_split(rtrim(lower(host), '.'), '.') AS labels, {IS_IP} AS ip FROM {hosts}),
tails AS (SELECT host, len(labels) AS n, k, array_to_string(list_slice(labels, (len(labels) - k + 1)::BIGINT, len(labels)), '.') AS suffix FROM hosts, LATERAL (SELECT unnest(range(1, len(labels) + 1)) AS k)),
psl AS (SELECT * FROM {rules.values_sql(_KIND, 'v', 'kind, suffix')}),
best AS (SELECT host, max(CASE kind WHEN 'exception' THEN k - 1 + 1000 WHEN 'wildcard' THEN k + 1 ELSE k END) AS t FROM tails JOIN psl USING (suffix) GROUP BY host),
reg AS (SELECT h.host, ip, CASE WHEN NOT ip AND len(labels) > n THEN array_to_string(list_slice(labels, (len(labels) - n)::BIGINT, len(labels)), '.') END AS registrable
  FROM (SELECT hosts.host, labels, ip, CASE WHEN coalesce(t, 1) >= 1000 THEN t - 1000 ELSE coalesce(t, 1) END AS n FROM hosts LEFT JOIN best ON hosts.host = best.host) h)"""


def _fold(x: str) -> str:
    out = f"translate({x}, '{''.join(rules.SINGLE_FOLDS)}', '{''.join(rules.SINGLE_FOLDS.values())}')"
    for a, b in rules.SEQUENCE_FOLDS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


_SQUASH = lambda x: f"regexp_replace({x}, '[-._\\p{{Nd}}]', '', 'g')"
KNOWN = f"known AS (SELECT * FROM {rules.values_sql(rules.brand_domains(), 'v', 'ord, brand_id, domain, known')})"


def squats(labels: str) -> str:
    budget = f"CASE WHEN length(known) <= {rules.SHORT_LABEL} THEN {rules.SHORT_DISTANCE} ELSE {rules.LONG_DISTANCE} END"
    return f"""{KNOWN}, squat AS (SELECT label, arg_min(brand_id, ord) AS brand_id, arg_min(known, ord) AS known, arg_min(domain, ord) AS domain FROM (SELECT DISTINCT label FROM {labels} WHERE label <> '' AND label NOT IN (SELECT known FROM known)) l, known
  WHERE damerau_levenshtein(label, known) <= {budget} OR (length(known) >= {rules.LEAST_CONTAINED} AND contains(label, known)) OR {_SQUASH('label')} = {_SQUASH('known')} GROUP BY label)"""


_FALSE_POSITIVES = 0.01
_HALF = lambda at: f"(('0x' || substr(sha256(domain), {at}, 16))::UBIGINT::HUGEINT - CASE WHEN ('0x' || substr(sha256(domain), {at}, 1))::INT >= 8 THEN 18446744073709551616::HUGEINT ELSE 0 END)"


def bloom(domains: str, asked: str) -> str:
    """filter_bits and maybe (domain, maybe) of a filter sized for ``domains`` (domain), asked for ``asked`` (domain)."""
    place = f"unnest(list_distinct(list_transform(range(k), lambda i: ((({_HALF(1)} + i * {_HALF(17)}) % m) + m) % m))) AS bit"
    return f"""sized AS (SELECT n, greatest(8, ceil(-n * ln({_FALSE_POSITIVES}) / (ln(2) * ln(2))))::BIGINT AS m FROM (SELECT count(DISTINCT lower(domain)) AS n FROM {domains})),
filter AS (SELECT m, CASE WHEN n = 0 THEN 1 ELSE greatest(1, round_even(m / n * ln(2), 0)) END::BIGINT AS k FROM sized),
filter_bits AS (SELECT DISTINCT bit FROM (SELECT {place} FROM (SELECT DISTINCT lower(domain) AS domain FROM {domains}), filter)),
maybe AS (SELECT domain, count(*) = count(b.bit) AS maybe FROM (SELECT domain, {place} FROM (SELECT DISTINCT domain FROM {asked}), filter) p LEFT JOIN filter_bits b USING (bit) GROUP BY domain)"""


#: The one host of the data beyond ASCII, and its form on the wire.
_WIRE = [("n\u043erthpay.com", "n\u043erthpay.com".encode("idna").decode())]
_ALLOW = [d for b in rules.BRANDS for d in b[3]]
REPUTATION = f"""ranked_domains AS MATERIALIZED ({RANKED_SQL.format(part='part')}), domain_ages AS MATERIALIZED ({AGES_SQL.format(part='part')})"""
FACTS = f"""{REPUTATION}, {registrable('urls')},
wire AS (SELECT host, CASE registrable {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _WIRE)} ELSE registrable END AS domain FROM reg WHERE registrable IS NOT NULL),
{bloom('ranked_domains', 'wire')},
ages AS (SELECT host, domain, age_days, age_days IS NULL AND NOT maybe AND domain NOT IN {_in(_ALLOW)} AS unknown_age FROM wire JOIN maybe USING (domain) LEFT JOIN domain_ages USING (domain)),
named AS (SELECT host, ip, registrable, split_part(registrable, '.', 1) AS label, {_fold("split_part(registrable, '.', 1)")} AS folded, split_part(registrable, '.', -1) AS tld FROM reg),
labels AS (SELECT label FROM named WHERE label IS NOT NULL UNION SELECT folded FROM named WHERE folded IS NOT NULL),
{squats('labels')},
facts AS (SELECT n.*, g.domain, g.age_days, g.unknown_age, coalesce(a.brand_id, CASE WHEN folded <> n.label THEN coalesce((SELECT arg_min(brand_id, ord) FROM known WHERE known = folded), b.brand_id) END) AS squat,
  coalesce(a.domain, CASE WHEN folded <> n.label THEN coalesce((SELECT arg_min(domain, ord) FROM known WHERE known = folded), b.domain) END) AS squat_domain,
  regexp_matches(n.label, '\\p{{Latin}}') AND regexp_matches(n.label, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}]') AS mixed,
  registrable IN {_in(rules.SHORTENERS)} AND registrable NOT IN {_in(rules.BRAND_OPERATED)} AS shortener, tld IN {_in(rules.SUSPICIOUS_TLDS)} AS bad_tld
  FROM named n LEFT JOIN squat a ON n.label = a.label LEFT JOIN squat b ON n.folded = b.label LEFT JOIN (SELECT host AS age_host, domain, age_days, unknown_age FROM ages) g ON age_host = n.host)"""

_NAMED = "NOT ip AND registrable IS NOT NULL"
_BRAND = "CASE squat " + " ".join(f"WHEN '{b[0]}' THEN '{b[1]}'" for b in rules.BRANDS) + " END"
SLOTS = ["host", "tld", "actual", "brand", "real_domain", "displayed", "path", "domain", "age_days", "claimed_brand", "header_brands"]
_CHECKS = [
    ("ip", "IP_ADDRESS_HOST", "2", {"host": "host"}),
    (f"{_NAMED} AND squat IS NOT NULL", "TYPOSQUAT_OF_KNOWN_BRAND", "2", {"actual": "registrable", "brand": _BRAND, "real_domain": "squat_domain"}),
    (f"{_NAMED} AND mixed", "HOMOGRAPH_CHARACTERS", "2", {"host": "host"}),
    (f"{_NAMED} AND shortener", "URL_SHORTENER", "1", {"host": "host"}),
    (f"{_NAMED} AND bad_tld", "SUSPICIOUS_TLD", "1", {"tld": "tld"}),
    (f"{_NAMED} AND NOT contains(lower(display_text), lower(domain))", "LINK_TEXT_MISMATCH", "2", {"displayed": "display_text", "actual": "domain"}),
    (f"{_NAMED} AND lower(scheme) = 'http' AND regexp_matches(path, '(?i){rules.CREDENTIAL_WORDS}')", "NON_HTTPS_CREDENTIAL_PAGE", "1", {"path": "path"}),
    (f"{_NAMED} AND (age_days < 30 OR unknown_age)", "DOMAIN_VERY_NEW", "CASE WHEN age_days < 30 THEN 2 ELSE 0 END", {"domain": "domain", "age_days": "age_days"}),
]


def _slots(given: dict) -> str:
    return ", ".join(f"({given[k]})::VARCHAR AS {k}" if k in given else f"NULL::VARCHAR AS {k}" for k in SLOTS)


def url_evidence(urls: str = "urls", shown: str = "NULL::VARCHAR") -> str:
    """url_ev over links ``urls``; ``shown``: what HTML shows for a link."""
    each = f"links AS (SELECT msg_id, ord, scheme, path, start, stop, display_text, facts.* FROM (SELECT msg_id, ord, host AS link_host, scheme, path, start::INT AS start, (start + length(raw))::INT AS stop, {shown} AS display_text FROM {urls}) JOIN facts ON host = link_host)"
    return f"{each}, url_ev AS (" + " UNION ALL ".join(f"SELECT msg_id, ord, {i} AS pos, '{t}' AS type, {s} AS severity, start, stop, {_slots(given)} FROM links WHERE {c}" for i, (c, t, s, given) in enumerate(_CHECKS)) + ")"


URL_EVIDENCE = url_evidence()


def anchors(pages: str) -> str:
    """anchor_links (msg_id, ord, raw, scheme, host, path, shown, start) over ``pages`` (msg_id, html, url)."""
    inside = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
    href = r"""(?is)^<a\s(?:[^>"'']|"[^"]*"|''[^'']*'')*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)"""
    quotes = "'\"'''"

    def read(text: str) -> str:  # the entities of the data, "&" last
        for k, v in (("&#32;", " "), ("&#x6c;", "l"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
            text = f"replace({text}, '{k}', '{v}')"
        return text

    bare = f"regexp_replace(a, '(?s)<{inside}>', '', 'g')"
    return rf"""pages_in AS ({pages}),
bared AS (SELECT msg_id, url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g') AS h FROM pages_in),
anchor_rows AS (SELECT msg_id, url, regexp_extract_all(h, '(?is)<a\s{inside}>.*?</a\s*>') AS l FROM bared),
anchor_each AS (SELECT msg_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS n FROM anchor_rows),
anchor_named AS (SELECT *, {read(f"trim(regexp_extract(a, '{href}', 1), {quotes})")} AS raw, trim(regexp_replace({read(bare)}, '\s+', ' ', 'g')) AS shown FROM anchor_each),
anchor_kept AS (SELECT *, (row_number() OVER (PARTITION BY msg_id ORDER BY n) - 1)::INT AS ord FROM anchor_named WHERE raw <> ''),
anchor_links AS (SELECT msg_id, ord, raw, shown, NULL::INT AS start, CASE WHEN contains(raw, '://') THEN split_part(raw, '://', 1) ELSE split_part(url, '://', 1) END AS scheme,
  regexp_extract(CASE WHEN contains(raw, '://') THEN raw ELSE url END, '://([^/?#:]*)', 1) AS host,
  CASE WHEN contains(raw, '://') THEN nullif(regexp_extract(raw, '(?s)://[^/?#:]*(.*)$', 1), '') ELSE raw END AS path FROM anchor_kept WHERE NOT starts_with(raw, 'mailto:') AND (contains(raw, '://') OR url IS NOT NULL))"""


def _alias(a: str) -> str:
    return rf"(?i)(^|[^\p{{L}}\p{{N}}])({r'\s+'.join(a.split())})($|[^\p{{L}}\p{{N}}])"


_ALIASES = [(i, j, b[0], b[1], a, _alias(a)) for i, b in enumerate(rules.BRANDS) for j, a in enumerate(b[2])]
CLAIMS = "claims AS (" + " UNION ALL ".join(f"SELECT msg_id, {i} AS brand_ord, {j} AS alias_ord, '{b}' AS brand_id, '{n}' AS name, '{a}' AS alias, unnest(regexp_extract_all(text, '{p}', 2)) AS matched FROM messages" for i, j, b, n, a, p in _ALIASES) + ")"
_HEADERS = [(h, b[0]) for b in rules.BRANDS for h in b[4]]
SENDER = f"""claimed AS (SELECT msg_id, list(DISTINCT brand_id) AS ids FROM claims GROUP BY msg_id),
owners AS (SELECT header, list(brand_id) AS owners FROM {rules.values_sql(_HEADERS, 'v', 'header, brand_id')} GROUP BY header),
sender AS (SELECT msg_id, CASE WHEN sender_hint IS NULL THEN 'BRAND_CLAIM_WITHOUT_DLT_HEADER' WHEN regexp_matches(sender_hint, '^[0-9]{{10}}$') THEN 'UNREGISTERED_NUMERIC_SENDER'
  WHEN regexp_matches(sender_hint, '^[A-Z]{{2}}-[A-Z0-9]{{3,9}}$') AND owners IS NOT NULL AND NOT list_has_any(owners, ids) THEN 'DLT_HEADER_MISMATCH' END AS sender
  FROM claimed JOIN messages USING (msg_id) LEFT JOIN owners ON header = regexp_extract(sender_hint, '-(.*)$', 1))"""
def fired(msgs: str = "msgs") -> str:
    return "fired AS (" + " UNION ALL ".join(
    f"SELECT msg_id, {i} AS ord, '{n}' AS rule_id, '{k}' AS type, {s} AS severity, {w}::DOUBLE AS weight FROM {msgs} WHERE lang IN {_in(langs)} AND regexp_matches(normalized, '{p.replace(chr(39), chr(39) * 2)}')"
    + (f" AND NOT regexp_matches(normalized, '{sup.replace(chr(39), chr(39) * 2)}')" if sup else "")
    for i, (n, langs, p, sup, k, s, w, _) in enumerate(rules.PATTERNS)
) + ")"


FIRED = fired()
_SEV = lambda x: f"(CASE {x} WHEN 2 THEN 0.9 WHEN 1 THEN 0.4 WHEN 0 THEN 0.1 ELSE 0 END)::FLOAT"
VERDICT = f"""u AS (SELECT msg_id, max(severity) AS us FROM url_ev GROUP BY msg_id),
p AS (SELECT msg_id, least(sum(weight)::FLOAT, 0.5::FLOAT) AS pw FROM fired GROUP BY msg_id),
w AS (SELECT m.msg_id, cust_id, nation_id, segment, sender, us, CASE sender WHEN 'BRAND_CLAIM_WITHOUT_DLT_HEADER' THEN 0 WHEN 'UNREGISTERED_NUMERIC_SENDER' THEN 2 WHEN 'DLT_HEADER_MISMATCH' THEN 2 END AS ss, coalesce(pw, 0::FLOAT) AS pw, c.ids IS NOT NULL AS any_claim
  FROM messages m LEFT JOIN u USING (msg_id) LEFT JOIN p USING (msg_id) LEFT JOIN claimed c USING (msg_id) LEFT JOIN sender s USING (msg_id)),
x AS (SELECT *, {_SEV('us')} AS uw, {_SEV('ss')} AS sw, coalesce(us = 2 AND any_claim, false) OR coalesce(ss = 2, false) AS forced FROM w),
y AS (SELECT *, ((0.25::FLOAT * uw + 0.12::FLOAT * sw + 0.08::FLOAT * pw) / (0.25::FLOAT + 0.12::FLOAT + 0.08::FLOAT))::FLOAT AS score FROM x),
v AS (SELECT *, CASE WHEN forced THEN 'SCAM' WHEN score >= 0.35::FLOAT THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
  CASE WHEN forced THEN 'HIGH' WHEN score >= 0.5::FLOAT THEN 'MEDIUM' WHEN score >= 0.35::FLOAT THEN 'LOW' WHEN score <= 0.15::FLOAT THEN 'HIGH' ELSE 'LOW' END AS confidence FROM y)"""
CHAIN = ", ".join([MESSAGES, URLS, FACTS, URL_EVIDENCE, CLAIMS, SENDER, FIRED, VERDICT])
_NONE = ", ".join(f"NULL::VARCHAR AS {k}" for k in SLOTS)
_OWNERS = "CASE regexp_extract(sender_hint, '-(.*)$', 1) " + " ".join(f"WHEN '{h}' THEN '{', '.join(sorted({b[1] for b in rules.BRANDS if h in b[4]}))}'" for h in dict.fromkeys(h for b in rules.BRANDS for h in b[4])) + " END"
_MISMATCH = ", ".join({"claimed_brand": "CASE WHEN sender = 'DLT_HEADER_MISMATCH' THEN first_name END AS claimed_brand", "header_brands": f"CASE WHEN sender = 'DLT_HEADER_MISMATCH' THEN {_OWNERS} END AS header_brands"}.get(k, f"NULL::VARCHAR AS {k}") for k in SLOTS)
FIRST_CLAIM = """first_claim AS (SELECT msg_id, arg_min(name, [place, brand_ord, alias_ord]) AS first_name FROM (SELECT claims.*, strpos(text, matched) AS place FROM claims JOIN messages USING (msg_id)) GROUP BY msg_id)"""
EVIDENCE = f"""{FIRST_CLAIM}, ev AS (SELECT msg_id, severity, uw AS weight, 1 AS sig, ord AS a, pos AS b, type, {', '.join(SLOTS)} FROM url_ev JOIN v USING (msg_id)
  UNION ALL SELECT v.msg_id, ss, sw, 2, 0, 0, sender, {_MISMATCH} FROM v JOIN messages USING (msg_id) LEFT JOIN first_claim USING (msg_id) WHERE sender IS NOT NULL
  UNION ALL SELECT msg_id, severity, pw, 3, ord, 0, type, {_NONE} FROM fired JOIN v USING (msg_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY severity DESC, weight DESC, sig, a, b) AS rank FROM ev)"""


def worded(words: str) -> str:
    for k in SLOTS:
        words = f"replace({words}, '{{{k}}}', coalesce({k}, ''))"
    return words


_HINTS = [(i, c, h) for i, r in enumerate(rules.PATTERNS) for c, h in r[7].items()]
HINTS = f"""hint_rules AS (SELECT * FROM {rules.values_sql([(k + 2, i, c, h) for k, (i, c, h) in enumerate(_HINTS)], 'v', 'first, ord, category, hint')}),
hints AS (SELECT DISTINCT msg_id, 0 AS first, 'KYC_PHISHING' AS category, 0.3 AS hint FROM url_ev WHERE type IN ('TYPOSQUAT_OF_KNOWN_BRAND', 'HOMOGRAPH_CHARACTERS', 'NON_HTTPS_CREDENTIAL_PAGE', 'IP_ADDRESS_HOST')
  UNION ALL SELECT msg_id, 1, 'KYC_PHISHING', 0.3 FROM sender WHERE sender IN ('UNREGISTERED_NUMERIC_SENDER', 'DLT_HEADER_MISMATCH')
  UNION ALL SELECT msg_id, first, category, hint FROM fired JOIN hint_rules USING (ord)),
sums AS (SELECT msg_id, category, round(sum(hint::FLOAT::DOUBLE), 6) AS total, min(first) AS first FROM hints GROUP BY ALL)"""


def q(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def _logit(of: str) -> str:
    return f"coalesce(list_sum(list_transform(list_slice(ids, 1, 128), lambda i: {of})), 0)::DOUBLE"


_CATS = [_logit(f"(i % {k + 7} - {(k + 6) / 2.0}) / {k + 7}.0::DOUBLE") for k in range(13)]
_NAMES = "['KYC_PHISHING', 'FAKE_JOB', 'LOTTERY_PRIZE', 'DIGITAL_ARREST', 'COURIER_CUSTOMS', 'LOAN_APP', 'UPI_COLLECT', 'INVESTMENT_TRADING', 'TECH_SUPPORT', 'SEXTORTION', 'ELECTRICITY_DISCONNECTION', 'OTHER_SCAM', 'NOT_SCAM']"
MODEL = f"""ids AS (SELECT msg_id, list_transform(list_filter(string_split(normalized, ' '), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % 1000 + 1) AS ids FROM msgs),
logits AS (SELECT msg_id, {_logit('(i % 41 - 20) / 40.0::DOUBLE')} AS z, [{', '.join(_CATS)}] AS c FROM ids),
shares AS (SELECT msg_id, 1 / (1 + exp(-z / 1.5)) AS p, list_transform(c, lambda x: exp(x - list_max(c))) AS e FROM logits),
model AS (SELECT msg_id, p, list_max(e) / list_sum(e) AS share, CASE WHEN list_max(e) / list_sum(e) >= 0.45 THEN {_NAMES}[list_position(e, list_max(e))] ELSE 'OTHER_SCAM' END AS mc,
  CASE WHEN p >= 0.75 THEN 'MODEL_HIGH_SCAM_SCORE' WHEN p <= 0.25 THEN 'MODEL_LOW_SCAM_SCORE' END AS mt FROM shares),
mv AS (SELECT x.msg_id, mt, mc, share, p, (0.55::FLOAT * p::FLOAT + 0.25::FLOAT * uw + 0.12::FLOAT * sw + 0.08::FLOAT * pw)::FLOAT AS score, forced FROM x JOIN model USING (msg_id)),
mverdict AS (SELECT *, CASE WHEN forced OR score >= 0.7::FLOAT THEN 'SCAM' WHEN score >= 0.35::FLOAT THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
  CASE WHEN forced OR score >= 0.85::FLOAT THEN 'HIGH' WHEN score >= 0.7::FLOAT THEN 'MEDIUM' WHEN score >= 0.5::FLOAT THEN 'MEDIUM' WHEN score >= 0.35::FLOAT THEN 'LOW' WHEN score <= 0.15::FLOAT THEN 'HIGH' ELSE 'LOW' END AS confidence FROM mv)"""
