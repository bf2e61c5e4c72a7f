"""Brand, sender and pattern analyzers: rules compiled to one array expression, so a message is read once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import bound, language, normalize, spans
from vigil.sources import rules
from vigil.sources.rules import BUILT_IN, Pack


def _alias_pattern(alias: str) -> str:
    words = r"\s+".join(alias.split())
    return rf"(?i)(?<![\p{{L}}\p{{N}}]){words}(?![\p{{L}}\p{{N}}])"


def _holds(lowered: Column, alias: str) -> Column:
    """Whether the words of an alias are in a lower-cased text, which its pattern needs and which is quick to see."""
    words = alias.lower().split()
    plain = all(w.isascii() and w.isalnum() for w in words)  # others may be more than they look as a pattern
    return reduce(lambda a, b: a & b, [F.contains(lowered, F.lit(w)) for w in words]) if words and plain else F.lit(True)


def claims(text: Column, pack: Pack = BUILT_IN) -> Column:
    """array<struct<start, brand_ord, alias_ord, brand_id, name, alias, end>>: every place of every alias, by place.

    ``start`` and ``end`` (exclusive) count from 0 in the text as it came.
    """

    def named(i, j, brand, name, alias):
        return lambda at: F.struct(at["start"].alias("start"), F.lit(i).alias("brand_ord"), F.lit(j).alias("alias_ord"), F.lit(brand).alias("brand_id"), F.lit(name).alias("name"), F.lit(alias).alias("alias"), at["end"].alias("end"))

    def found(lowered):
        out = []
        for i, (brand, name, aliases, _, _) in enumerate(pack.brands):
            for j, alias in enumerate(aliases):
                pattern = _alias_pattern(alias)
                out.append(F.when(_holds(lowered, alias), F.transform(spans(text, pattern), named(i, j, brand, name, alias))))
        return F.array_sort(F.flatten(F.array_compact(F.array(*out))))

    return bound(F.lower(text), found)


def claimed_brands(text: Column, pack: Pack = BUILT_IN) -> Column:
    """Ids of the brands that a text claims, in the pack's order; where they stand is not asked."""

    def hit(lowered):
        claims_any = lambda aliases: reduce(lambda a, b: a | b, [_holds(lowered, x) & text.rlike(_alias_pattern(x)) for x in aliases])
        return F.array_compact(F.array(*[F.when(claims_any(aliases), F.lit(brand)) for brand, _, aliases, _, _ in pack.brands if aliases]))

    return bound(F.lower(text), hit).cast("array<string>")


def header_brands(header: Column, pack: Pack = BUILT_IN) -> Column:
    owners: dict[str, list[str]] = {}
    for b in pack.brands:
        for h in b[4]:
            owners.setdefault(h, []).append(b[0])
    out = F.lit(None).cast("array<string>")
    for h, ids in owners.items():
        out = F.when(header == h, F.array(*map(F.lit, ids))).otherwise(out)
    return out


def header_names(header: Column, pack: Pack = BUILT_IN) -> Column:
    """Display names of the brands that own a header, sorted and joined; null if nobody does."""
    owners: dict[str, set[str]] = {}
    for b in pack.brands:
        for h in b[4]:
            owners.setdefault(h, set()).add(b[1])
    return F.coalesce(*[F.when(header == h, F.lit(", ".join(sorted(names)))) for h, names in owners.items()], F.lit(None).cast("string"))


def header_owners(brands: DataFrame) -> DataFrame:
    """header, names: the sorted distinct display names of the brands (name, headers; a bounded table) that own each header, joined."""
    each = brands.select("name", F.explode("headers").alias("header"))
    return each.groupBy("header").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))


def header_body(hint: Column) -> Column:
    """What stands behind the operator's part of a sender header."""
    return F.regexp_extract(hint, "-(.*)$", 1)


def sender_evidence(hint: Column, claimed: Column, pack: Pack = BUILT_IN) -> Column:
    """Type of the sender's evidence, or null. ``claimed``: ids of claimed brands."""
    valid = hint.rlike("^[A-Z]{2}-[A-Z0-9]{3,9}$")
    owners = header_brands(header_body(hint), pack)
    return (
        F.when(F.size(claimed) == 0, F.lit(None))
        .when(hint.isNull(), "BRAND_CLAIM_WITHOUT_DLT_HEADER")
        .when(hint.rlike("^[0-9]{10}$"), "UNREGISTERED_NUMERIC_SENDER")
        .when(valid & owners.isNotNull() & ~F.arrays_overlap(owners, claimed), "DLT_HEADER_MISMATCH")
    )


#: A letter of a pattern that stands for itself.
_PLAIN = r"[^()\[\]{}|?*+.^$\\\0]"


def needed(pattern: str) -> list[str] | None:
    """Texts one of which is in every match of ``pattern``; null where that is not easily seen: of what is not a plain letter, only
    groups of words, classes and ``.`` are read."""
    if re.search(r"\\|\(\?|\[[^\]]*[\[&(|)]|\)[?*+{]", pattern):
        return None
    rest = re.sub(r"(?:\[[^\]]*\]|\.)(?:[?*+]|\{[^}]*\})*", "\0", pattern)
    if "{" in rest:
        return None
    groups: list[str] = []
    flat = re.sub(r"\(([^()]*)\)", lambda m: groups.append(m[1]) or f"({len(groups) - 1})", rest)
    out = []
    for branch in flat.split("|"):
        named = re.findall(r"\((\d+)\)", branch)
        branch = re.sub(r"\(\d+\)", "\0", branch)
        if "(" in branch or ")" in branch:  # groups in groups
            return None
        found = [[w[:-1] if q else w] for w, q in re.findall(rf"({_PLAIN}+)([?*+]?)", branch)]
        for g in named:
            words = groups[int(g)].split("|")
            if all(re.fullmatch(rf"{_PLAIN}+\??", w) for w in words):
                found.append([w[:-2] if w[-1] == "?" else w for w in words])
        found = [words for words in found if all(words)]
        if not found:
            return None
        out += max(found, key=lambda words: min(map(len, words)))
    return out


def _may_match(text: Column, pattern: str) -> Column:
    words = needed(pattern)
    return F.lit(True) if words is None else reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def fired(normalized: Column, lang: Column, pack: Pack = BUILT_IN) -> Column:
    """array<struct<ord, id, type, severity, weight>> of the pattern rules that fire."""
    out = []
    for i, (name, langs, pattern, suppress, kind, severity, weight, _) in enumerate(pack.patterns):
        hit = lang.isin(langs) & _may_match(normalized, pattern) & normalized.rlike(pattern)
        if suppress:
            hit = hit & ~normalized.rlike(suppress)
        out.append(F.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight"))))
    return F.array_compact(F.array(*out)).cast("array<struct<ord: int, id: string, type: string, severity: int, weight: double>>")


def pattern_weight(hits: Column) -> Column:
    return F.least(F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["weight"]).cast("float"), F.lit(rules.PATTERN_CAP).cast("float"))


def texts(text: Column) -> Column:
    """struct<normalized, lang>."""
    return bound(normalize(text), lambda t: F.struct(t.alias("normalized"), language(t).alias("lang")))


def analyzed(messages: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """``messages`` with normalized, lang, claims, claimed, sender, fired, pattern_weight.

    Text, language and rules are one expression that names each once, so no plan repeats them for each rule. To keep
    rows by what fired, explode it as an outer join would and drop nulls: a filter on ``fired`` itself is pushed
    below this and evaluates every rule again.
    """
    facts = bound(texts(F.col("text")), lambda t: F.struct(t["normalized"].alias("normalized"), t["lang"].alias("lang"), fired(t["normalized"], t["lang"], pack).alias("fired")))
    return (
        messages.withColumn("_facts", facts)
        .select("*", "_facts.normalized", "_facts.lang", "_facts.fired")
        .drop("_facts")
        .withColumn("claims", claims(F.col("text"), pack))
        .withColumn("claimed", F.coalesce(claimed_brands(F.col("text"), pack), F.array().cast("array<string>")))
        .withColumn("sender", sender_evidence(F.col("sender_hint"), F.col("claimed"), pack))
        .withColumn("pattern_weight", pattern_weight(F.col("fired")))
    )


def hits(messages: DataFrame, pack: Pack = BUILT_IN) -> DataFrame:
    """msg_id, ord, id, type, severity, weight: a row for each pattern rule that fires."""
    each = messages.select("msg_id", F.explode_outer(bound(texts(F.col("text")), lambda t: fired(t["normalized"], t["lang"], pack))).alias("f"))
    return each.where("f is not null").select("msg_id", "f.*")
