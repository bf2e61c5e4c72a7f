"""Text functions as column expressions; the one that Spark lacks (compatibility composition) is an Arrow UDF
that sees only texts with characters beyond ASCII."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigil.sources import rules


@F.arrow_udf(StringType())
def _compose(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return texts
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def _fold_space(text: Column) -> Column:
    bare = F.regexp_replace(text, "[​‌‍⁠﻿]", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, "[   ]", " "), r"\s+", " ")
    return F.lower(F.trim(spaced))


def _fold_ascii(text: Column) -> Column:
    """What ``_fold_space`` gives for ASCII; most texts hold single blanks only and are not rebuilt."""
    wide = text.rlike(r"[\t-\r]|  ")
    return F.lower(F.trim(F.when(wide, F.regexp_replace(text, r"\s+", " ")).otherwise(text)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Matches whose places are added up together.
STEP = 256
#: Matches that are looked up one by one.
FEW = 4


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the matches of ``pattern``, from 0, end exclusive: the lengths of what lies between them say where.

    A few matches, each of which can stand in one place only after the one before, are looked up there. For others the text is
    cut once more. Lengths are added up in steps of ``STEP`` matches from the sums of the steps before, so the work is in
    proportion to the matches.
    """
    none = F.array().cast("array<struct<start: int, end: int, found: string>>")

    def looked_up(found: Column) -> Column:  # null if a match could stand in two places
        def step(s: Column, x: Column) -> Column:
            def put(at: Column) -> Column:
                once = F.call_function("locate", x, text, at + 1) == 0
                one = F.struct((at - 1).alias("start"), (at - 1 + F.length(x)).alias("end"), x.alias("found"))
                return F.when(once, F.struct((at + F.length(x)).alias("at"), F.concat(s["out"], F.array(one)).alias("out")))

            return bound(F.call_function("locate", x, text, s["at"]), put)

        return F.aggregate(found, F.struct(F.lit(1).alias("at"), none.alias("out")), step, lambda s: s["out"])

    few = lambda found: F.when(F.size(found) == 0, none).when(F.size(found) <= FEW, looked_up(found))
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.coalesce(few(found), _added_up(text, pattern, found)))


def _added_up(text: Column, pattern: str, found: Column) -> Column:
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["found"]))
    cut = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("found")))

    def in_steps(pairs: Column) -> Column:  # the last gap has no match
        first = F.sequence(F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(1)), F.lit(STEP))
        return F.transform(first, lambda i: F.slice(pairs, i, F.least(F.lit(STEP), F.size(pairs) - i)))

    def placed(part: Column, at: Column) -> Column:
        one = lambda n, x: F.struct((n + x["gap"]).alias("start"), (n + x["gap"] + F.length(x["found"])).alias("end"), x["found"].alias("found"))
        none = F.array().cast("array<struct<start: int, end: int, found: string>>")
        step = lambda s, x: F.struct((s["n"] + x["gap"] + F.length(x["found"])).alias("n"), F.concat(s["out"], F.array(one(s["n"], x))).alias("out"))
        return F.aggregate(part, F.struct(at.alias("n"), none.alias("out")), step, lambda s: s["out"])

    def all_steps(s: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(s["sums"], 1, i), F.lit(0), lambda n, x: n + x)
        return F.flatten(F.transform(s["steps"], lambda part, i: placed(part, before(i))))

    return bound(bound(cut, in_steps), lambda steps: bound(F.struct(steps.alias("steps"), F.transform(steps, total).alias("sums")), all_steps))


def normalize(text: Column) -> Column:
    """Compatibility-composed, without zero-width characters, spaces folded and trimmed, lower-cased."""
    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, _fold_ascii(text)).otherwise(_fold_space(F.coalesce(_compose(F.when(~ascii_only, text)), text)))


def _any_of(words: list[str]) -> str:
    """A pattern of any of ``words`` that reads each letter once: a tree of their beginnings."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def node(at: dict) -> str:
        parts = [re.escape(c) + node(rest) for c, rest in sorted(at.items()) if c]
        return ("(?:" + "|".join(parts) + ")" + ("?" if "" in at else "")) if parts else ""

    return node(tree)


ROMANISED = rf"(?<![a-z0-9])(?:{_any_of(rules.ROMANISED_HINDI)})(?![a-z0-9])"


def language(normalized: Column) -> Column:
    """Script shares of at least a fifth in fixed order, then Latin with or without romanised Hindi."""
    other = normalized.rlike("[\\u0900-\\u09FF\\u0B80-\\u0BFF\\u0C00-\\u0C7F]")  # most texts hold none of these, and are not counted
    share = lambda a, b: (F.regexp_count(normalized, F.lit(f"[\\u{a}-\\u{b}]")) / F.regexp_count(normalized, F.lit(r"\S")) >= 0.2)
    marathi = F.arrays_overlap(F.split(normalized, r"[^\p{L}\p{M}]+"), F.array(*map(F.lit, rules.MARATHI)))
    scripts = F.when(share("0900", "097F"), F.when(marathi, "MR").otherwise("HI")).when(share("0980", "09FF"), "BN").when(share("0B80", "0BFF"), "TA").when(share("0C00", "0C7F"), "TE")
    latin = F.when(normalized.rlike("[A-Za-z]"), F.when(F.regexp_count(normalized, F.lit(ROMANISED)) >= 2, "HI_LATN").otherwise("EN")).otherwise("UNKNOWN")
    return F.when(~F.coalesce(normalized.rlike(r"\S"), F.lit(False)), "UNKNOWN").otherwise(F.coalesce(F.when(other, scripts), latin))


def scrub(text: Column) -> Column:
    """Phones, amounts, accounts and names after a salutation, in this order."""
    # The four patterns; digits are those of any script
    out = F.regexp_replace(text, r"(?U)(?<!\d)(?:\+?91[-\s]?)?[6-9]\d{9}(?!\d)", "<PHONE>")
    out = F.regexp_replace(out, r"(?iU)(?:₹|rs\.?|inr)\s?[\d,]+(?:\.\d+)?", "<AMT>")
    out = F.regexp_replace(out, r"(?U)(?<!\d)\d{9,18}(?!\d)", "<ACCT>")
    generic = "customer|sir|madam|user|member|team|friend|valued|guest|all"  # fixed values: addressees that are no names
    return F.regexp_replace(out, rf"\b((?i:dear|hi|hello|hey|mr|mrs|ms|shri|smt|dr)\.?)\s+(?!(?i:{generic})\b)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", "$1 <NAME>")


# Fixed values: (pattern, category), first match wins
KEYWORDS = [
    (r"\b(won|winner|prize|award|claim|congratulations)\b", "LOTTERY_PRIZE"),
    (r"\b(loan|cash advance|overdraft)\b", "LOAN_APP"),
    (r"\b(verify|account suspended|update your (account|details)|kyc)\b", "KYC_PHISHING"),
    (r"\b(vacancy|part.?time job|earn (\$|£|per week))\b", "FAKE_JOB"),
    (r"\b(invest|shares|stock tip|double your money)\b", "INVESTMENT_TRADING"),
    (r"\b(parcel|delivery|courier|customs)\b", "COURIER_CUSTOMS"),
    (r"\b(virus|your (pc|computer)|tech support)\b", "TECH_SUPPORT"),
]


def keyword_category(text: Column) -> Column:
    out = F.lit("OTHER_SCAM")
    for pattern, name in reversed(KEYWORDS):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out
