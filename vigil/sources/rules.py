"""The rule pack: small reference tables of our own, plain values that the operators compile into expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# (id, display name, aliases, domains, sender headers), in the order that decides first hits
BRANDS = [
    ("northpay", "NorthPay", ["northpay", "north pay"], ["northpay.com", "northpay.in"], ["NRTHPY"]),
    ("zenbank", "Zen Bank", ["zen bank", "zenbank"], ["zenbank.in"], ["ZENBNK", "ZENALT"]),
    ("quikmart", "QuikMart", ["quikmart"], ["quikmart.com"], ["QKMART"]),
    ("orbit", "Orbit Wallet", ["orbit wallet", "orbit"], ["orbit.co"], ["ORBITW", "SHARED"]),
    ("lumen", "Lumen Post", ["lumen post"], ["lumenpost.net"], ["LUMENP", "SHARED"]),
    ("vistatel", "VistaTel", ["vistatel"], ["vistatel.org"], ["VISTEL"]),
    ("carrow", "Carrow Courier", ["carrow courier", "carrow"], ["carrow.com"], ["CARROW"]),
    ("sola", "Sola", ["sola"], ["sola.in"], ["SOLAFN"]),
]
# public suffix rules: plain, wildcard, exception
SUFFIXES = ["com", "net", "org", "in", "co", "co.in", "xyz", "top", "click", "ly", "gd", "*.ck", "!www.ck"]
SHORTENERS = ["bit.ly", "is.gd", "tiny.click", "northpay.click"]
BRAND_OPERATED = {"northpay.click": "northpay"}
SUSPICIOUS_TLDS = ["xyz", "top", "click"]
SINGLE_FOLDS = {"0": "o", "1": "l", "3": "e", "5": "s", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x"}
# Multi-character look-alikes, applied in this order after the single ones
SEQUENCE_FOLDS = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("nn", "m")]
# Distance budgets by length of the known label, and the shortest label for containment
SHORT_LABEL, SHORT_DISTANCE, LONG_DISTANCE, LEAST_CONTAINED = 6, 1, 2, 3
# (id, languages, pattern, suppressor, evidence, severity, weight, {category: hint})
PATTERNS = [
    ("share_code", ["EN", "HI_LATN"], r"(share|send|tell|batao).{0,20}(otp|code|pin)", r"(do not|never|don't) share", "OTP_SOLICITATION", 2, 0.3, {"KYC_PHISHING": 0.4}),
    ("expires", ["EN"], r"(within|in) [0-9]+ (hours?|minutes?)|expires today", None, "URGENCY_DEADLINE", 1, 0.15, {"KYC_PHISHING": 0.1}),
    ("blocked", ["EN"], r"(account|card|service) (will be|is|has been) (blocked|suspended|closed)", None, "THREAT_OF_LOSS", 2, 0.25, {"KYC_PHISHING": 0.3}),
    ("prize", ["EN"], r"(won|winner|prize|lottery)", r"won't|won over", "UNREALISTIC_REWARD", 2, 0.3, {"LOTTERY_PRIZE": 0.5}),
    ("fee_first", ["EN"], r"(processing|registration|customs) fee", None, "ADVANCE_FEE_REQUEST", 2, 0.25, {"LOTTERY_PRIZE": 0.2, "COURIER_CUSTOMS": 0.3}),
    ("collect", ["EN", "HI_LATN"], r"(approve|accept).{0,15}(collect|request)", None, "UPI_COLLECT_FRAMING", 2, 0.25, {"UPI_COLLECT": 0.5}),
    ("jeeta", ["HI_LATN"], r"inaam (jeeta|mila)", None, "UNREALISTIC_REWARD", 2, 0.3, {"LOTTERY_PRIZE": 0.4}),
    ("premium", ["EN"], r"call 0?9[0-9]{2}[ -]?[0-9]{6}", None, "PREMIUM_RATE_NUMBER", 1, 0.2, {"OTHER_SCAM": 0.2}),
    ("inaam_hi", ["HI", "MR"], "(इनाम|बक्षीस|लॉटरी)", "विज्ञापन", "UNREALISTIC_REWARD", 2, 0.3, {"LOTTERY_PRIZE": 0.4}),
    ("code_hi", ["HI"], "(ओटीपी|पिन).{0,15}(बताएं|भेजें)", "न बताएं", "OTP_SOLICITATION", 2, 0.3, {"KYC_PHISHING": 0.4}),
    ("khate_mr", ["MR"], "खाते.{0,15}बंद", None, "THREAT_OF_LOSS", 2, 0.25, {"KYC_PHISHING": 0.3}),
    ("puroskar_bn", ["BN"], "পুরস্কার", None, "UNREALISTIC_REWARD", 2, 0.3, {"LOTTERY_PRIZE": 0.4}),
    ("parisu_ta", ["TA"], "பரிசு", None, "UNREALISTIC_REWARD", 2, 0.3, {"LOTTERY_PRIZE": 0.4}),
    ("bahumati_te", ["TE"], "బహుమతి", None, "UNREALISTIC_REWARD", 2, 0.3, {"LOTTERY_PRIZE": 0.4}),
]
# Categories and severities in order; severity weights; fusion weights without a model
CATEGORIES = ["KYC_PHISHING", "FAKE_JOB", "LOTTERY_PRIZE", "DIGITAL_ARREST", "COURIER_CUSTOMS", "LOAN_APP", "UPI_COLLECT", "INVESTMENT_TRADING", "TECH_SUPPORT", "SEXTORTION", "ELECTRICITY_DISCONNECTION", "OTHER_SCAM", "NOT_SCAM"]
SEVERITY_WEIGHTS = [0.1, 0.4, 0.9]
MODEL_SHARE, URL_SHARE, SENDER_SHARE, PATTERN_SHARE = 0.55, 0.25, 0.12, 0.08
PATTERN_CAP = 0.5
SCAM_FROM, SCAM_HIGH_FROM, SUSPICIOUS_FROM, MEDIUM_FROM, SAFE_HIGH_TO = 0.70, 0.85, 0.35, 0.50, 0.15
KYC_HINT = 0.3
NEW_DAYS = 30  # a domain younger than so many days is new
CREDENTIAL_WORDS = "(login|verify|kyc|update|otp|pay)"
TEMPLATES = {
    "TYPOSQUAT_OF_KNOWN_BRAND": "The link leads to {actual}, which imitates {brand} ({real_domain}).",
    "HOMOGRAPH_CHARACTERS": "The address {host} mixes look-alike letters.",
    "IP_ADDRESS_HOST": "The link leads to the bare network address {host}.",
    "URL_SHORTENER": "The link hides its destination behind {host}.",
    "SUSPICIOUS_TLD": "The link's ending .{tld} is common in fraud.",
    "NON_HTTPS_CREDENTIAL_PAGE": "The link asks for credentials without encryption.",
    "LINK_TEXT_MISMATCH": "The link shows {displayed} and opens {actual}.",
    "DOMAIN_VERY_NEW": "Nothing is known of the age of {domain}.",
    "BRAND_CLAIM_WITHOUT_DLT_HEADER": "The sender of this brand's message is unknown.",
    "UNREGISTERED_NUMERIC_SENDER": "A brand's message came from a private number.",
    "DLT_HEADER_MISMATCH": "The message speaks for {claimed_brand}, its header belongs to {header_brands}.",
    "OTP_SOLICITATION": "The message asks for a one-time code.",
    "URGENCY_DEADLINE": "The message sets a tight deadline.",
    "THREAT_OF_LOSS": "The message threatens a loss.",
    "UNREALISTIC_REWARD": "The message promises an unlikely reward.",
    "ADVANCE_FEE_REQUEST": "The message asks for a fee in advance.",
    "UPI_COLLECT_FRAMING": "The message dresses a payment up as a receipt.",
    "PREMIUM_RATE_NUMBER": "The message gives a costly number.",
    "CRYPTO_WALLET_ADDRESS": "The message asks for payment to a coin wallet.",
    "MODEL_HIGH_SCAM_SCORE": "The wording is much like that of known scams.",
    "MODEL_LOW_SCAM_SCORE": "The wording is much like that of genuine messages.",
}
#: Where the age is known.
AGED = {"DOMAIN_VERY_NEW": "The domain {domain} is only {age_days} days old."}
LEAD_INS = {
    "KYC_PHISHING": "No bank closes an account over a link; ask it yourself.",
    "FAKE_JOB": "Pay nothing for an offer of work.",
    "LOTTERY_PRIZE": "A prize that costs a fee is none.",
    "DIGITAL_ARREST": "No office arrests anyone by telephone.",
    "COURIER_CUSTOMS": "Look the parcel up on the carrier's own site.",
    "LOAN_APP": "Borrow only from lenders that are registered.",
    "UPI_COLLECT": "Receiving money never needs a PIN.",
    "INVESTMENT_TRADING": "Sure gains do not exist; check the adviser's registration.",
    "TECH_SUPPORT": "Let no caller into your computer.",
    "SEXTORTION": "Do not pay; keep the messages as proof.",
    "ELECTRICITY_DISCONNECTION": "Ask the supplier by the number on the bill.",
    "OTHER_SCAM": "Do not answer until you have checked the sender.",
}
ACTIONS = ["Do not open the link.", "Share no code or PIN.", "Call the sender back by a number you know.", "Report the message."]
HEADLINES = {"SAFE": "Nothing suspicious found", "SUSPICIOUS": "Be careful", "SCAM": "This looks like a scam"}
COLOURS = {"SAFE": "green", "SUSPICIOUS": "amber", "SCAM": "red"}
CONFIDENCE_TEXTS = {"HIGH": "very sure", "MEDIUM": "fairly sure", "LOW": "not sure"}
# Words that mark romanised Hindi (two or more hits), and Marathi among Devanagari texts
ROMANISED_HINDI = """
aap aapka aapki aapke aapko aapse aapne tum tumhara tumhari tumhare tumko tumse mera meri mere mujhe mujhko mai
hum humara humari humare hamara hamari hamare humko hamein yeh ye woh wo iska iski iske uska uski uske
kaun kya kyun kyu kaise kahan kab kitna kitne kitni jo jis jab tab jahan wahan yahan
agar magar lekin kintu phir fir bhi toh nahi nahin haan ji aur athva
hai hain tha thi hoga hogi honge kar karo karein kare karna karta karti karte hua hui hue jayega jayegi jaenge jaega
aaya aayi aaye aana jana gaya gayi gaye dena diya di diye dijiye lena liya li liye lijiye
batao bataye bataiye bata batayein bhejo bhejiye bhej bhejein bheja dekho dekhiye dekh dekhein suno suniye sunna
milega milegi milenge mila mili chahiye mangta chalega rukho ruko kariye
turant turnat abhi jaldi shighra aaj kal parso hamesha kabhi subah shaam raat din hafta mahina saal jald
kisi koi sabhi sab dono kuch thoda bahut zyada jyada kam sirf keval
paisa paise rupaye rupiya rupya khata khaata jama nikaal udhar karza karz shulk inaam inam puraskar jeet jeeta jeete vijeta
kripya meherbani dhanyavad shukriya namaste namaskar maafi zaroor jarur ghar kaam naam pata
""".split()
MARATHI = """
आहे आहेत नाही मी तू तुम्ही आम्ही त्याने तिने करा करतो करते झाले झाला झाली सांगा सांगितले अजून तुमचा तुमची तुमचे
माझा माझी माझे आपले असून होणार व्हा केले केला केली यावे जावे पाहिजे मिळेल
""".split()


@dataclass(frozen=True)
class Pack:
    """Everything that analyzers look up; bounded tables, held as plain values and compiled into expressions."""

    brands: list = field(default_factory=lambda: BRANDS)
    suffixes: list = field(default_factory=lambda: SUFFIXES)
    shorteners: list = field(default_factory=lambda: SHORTENERS)
    brand_operated: dict = field(default_factory=lambda: BRAND_OPERATED)
    suspicious_tlds: list = field(default_factory=lambda: SUSPICIOUS_TLDS)
    single_folds: dict = field(default_factory=lambda: SINGLE_FOLDS)
    sequence_folds: list = field(default_factory=lambda: SEQUENCE_FOLDS)
    patterns: list = field(default_factory=lambda: PATTERNS)
    short_label: int = SHORT_LABEL
    short_distance: int = SHORT_DISTANCE
    long_distance: int = LONG_DISTANCE
    version: str = "built-in"
    fallback: bool = False
    reputation: dict | None = None

    def brand_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *b) for i, b in enumerate(self.brands)], "brand_ord int, brand_id string, name string, aliases array<string>, domains array<string>, headers array<string>")

    def suffix_rows(self, spark: SparkSession) -> DataFrame:
        kind = lambda r: ("exception", r[1:]) if r[0] == "!" else ("wildcard", r[2:]) if r[:2] == "*." else ("plain", r)
        return spark.createDataFrame([kind(r.lower()) for r in self.suffixes], "kind string, suffix string")

    def brand_domains(self) -> list[tuple[int, str, str, str]]:
        """(order, brand id, domain, first label) over brands and their domains."""
        flat = [(b[0], d) for b in self.brands for d in b[3]]
        return [(i, b, d, d.split(".")[0]) for i, (b, d) in enumerate(flat)]


BUILT_IN = Pack()
#: What stands in for a pack that does not read: a few brands, shorteners and top levels, no folds and no patterns.
FALLBACK = {"brands": BRANDS[:5], "shorteners": SHORTENERS[:4], "brand_operated": {}, "suspicious_tlds": [*SUSPICIOUS_TLDS, "buzz", "icu"], "single_folds": {}, "sequence_folds": [], "patterns": [], "fallback": True}


def brands(spark: SparkSession) -> DataFrame:
    return BUILT_IN.brand_rows(spark)


def suffixes(spark: SparkSession) -> DataFrame:
    return BUILT_IN.suffix_rows(spark)


def brand_domains() -> list[tuple[int, str, str, str]]:
    return BUILT_IN.brand_domains()


def values_sql(rows: list[tuple], alias: str, columns: str) -> str:
    """The rows as a SQL VALUES table."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) {alias}({columns})"
