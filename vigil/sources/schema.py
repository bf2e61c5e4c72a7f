"""Constraints of a pack's JSON documents, and everything in a document that breaks them as a table.

A constraint is a plain value: ``Text``, ``Number``, ``Const``, ``Items``, ``Fields`` and ``Entries``. Documents are bounded files; each
is read as one row, and its violations are found where it is read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources import rules


@dataclass(frozen=True)
class Text:
    pattern: str | None = None
    least: int = 0
    most: int | None = None
    one_of: tuple = ()


@dataclass(frozen=True)
class Number:
    least: float
    most: float | None = None
    whole: bool = False


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Items:
    of: object
    least: int = 0


@dataclass(frozen=True)
class Entries:
    """An object with any keys that fit ``key``."""

    of: object
    key: Text = field(default_factory=Text)
    least: int = 0


@dataclass(frozen=True)
class Fields:
    """An object with known keys only; those that start with an underscore are remarks."""

    required: dict
    optional: dict = field(default_factory=dict)


# The patterns, lists and bounds of the format
ID = Text(r"^[a-z][a-z0-9_]*$")
DOMAIN = Text(r"^[a-z0-9.-]+\.[a-z]{2,}$")
HEADER = Text(r"^[A-Z0-9]{3,9}$")
LANGUAGES = ("EN", "HI", "HI_LATN", "BN", "TA", "TE", "MR", "UNKNOWN")
LEAST = {"brands": 120, "shorteners": 40, "patterns": 60}
SHARE = Number(0, 1)


def schemas(least: dict[str, int] = LEAST) -> dict[str, Fields]:
    """The constraints of each document; ``least``: how many entries a release must have."""
    n = lambda k: least.get(k, 0)
    brand = Fields({"id": ID, "display_name": Text(least=1), "aliases": Items(Text(least=3), 1), "domains": Items(DOMAIN), "dlt_headers": Items(HEADER)})
    rule = Fields(
        {"id": ID, "lang": Items(Text(one_of=LANGUAGES), 1), "pattern": Text(least=1), "evidence": Text(one_of=tuple(rules.TEMPLATES)), "severity": Text(one_of=("INFO", "WARN", "CRITICAL")), "weight": SHARE, "category_hints": Entries(SHARE, Text(one_of=tuple(rules.CATEGORIES)))},
        {"suppress_if": Text(least=1)},
    )
    distance = Fields({"short_label_max_length": Number(1, whole=True), "short_label_distance": Number(0, whole=True), "long_label_distance": Number(0, whole=True)})
    version = {"schema_version": Const(1)}
    return {
        "brands": Fields(version | {"brands": Items(brand, n("brands"))}),
        "shorteners": Fields(version | {"shorteners": Items(DOMAIN, n("shorteners"))}, {"brand_operated": Entries(ID)}),
        "folds": Fields(version | {"single_char_folds": Entries(Text(r"^[a-z0-9]$", 1, 1), Text(least=1, most=1), 1), "sequence_folds": Entries(Text(least=1)), "distance": distance, "suspicious_tlds": Items(Text(r"^[a-z]{2,24}$"), 1)}),
        "patterns": Fields(version | {"patterns": Items(rule, n("patterns"))}),
    }


def _text(value: str, rule: Text):
    if len(value) < rule.least:
        yield f"is shorter than {rule.least}"
    if rule.most is not None and len(value) > rule.most:
        yield f"is longer than {rule.most}"
    if rule.one_of and value not in rule.one_of:
        yield "is not in the list"
    if rule.pattern and not re.search(rule.pattern, value):
        yield f"does not match {rule.pattern}"


def errors(value, rule, path: str = "") -> list[tuple[str, str]]:
    """(path, message) of everything in ``value`` that breaks ``rule``, in the order of paths: numbers by value, names by letter."""
    return sorted(_errors(value, rule, path), key=lambda e: ([(0, int(p), "") if p.isdigit() else (1, 0, p) for p in e[0].split("/")], e[1]))


def _errors(value, rule, path):
    if isinstance(rule, Const):
        if value != rule.value or isinstance(value, bool):
            yield path, f"is not {json.dumps(rule.value)}"
    elif isinstance(rule, Text):
        if not isinstance(value, str):
            yield path, "is no string"
        else:
            yield from ((path, m) for m in _text(value, rule))
    elif isinstance(rule, Number):
        if isinstance(value, bool) or not isinstance(value, int if rule.whole else (int, float)):
            yield path, "is no whole number" if rule.whole else "is no number"
        elif value < rule.least or rule.most is not None and value > rule.most:
            yield path, "is out of range"
    elif isinstance(rule, Items):
        if not isinstance(value, list):
            yield path, "is no array"
            return
        if len(value) < rule.least:
            yield path, f"has fewer than {rule.least} items"
        for i, x in enumerate(value):
            yield from _errors(x, rule.of, f"{path}/{i}")
    elif not isinstance(value, dict):
        yield path, "is no object"
    elif isinstance(rule, Entries):
        if len(value) < rule.least:
            yield path, f"has fewer than {rule.least} entries"
        for k, x in value.items():
            yield from ((f"{path}/{k}", f"name {m}") for m in _text(k, rule.key))
            yield from _errors(x, rule.of, f"{path}/{k}")
    else:
        known = rule.required | rule.optional
        for k in rule.required.keys() - value.keys():
            yield f"{path}/{k}", "is missing"
        for k, x in value.items():
            if k in known:
                yield from _errors(x, known[k], f"{path}/{k}")
            elif not k.startswith("_"):
                yield f"{path}/{k}", "is unknown"


def violations(spark: SparkSession, folder: str, files: dict[str, str], least: dict[str, int] = LEAST) -> DataFrame:
    """file, ord, path, message: all that is wrong with the documents of a pack's folder, in the order of paths. ``files``: kind -> name."""
    rule = schemas(least)
    kinds = {name: kind for kind, name in files.items() if kind in rule}

    @F.udf("array<struct<ord: int, path: string, message: string>>")
    def check(name, text):
        try:
            found = errors(json.loads(text), rule[kinds[name]])
        except ValueError:
            found = [("", "is no JSON")]
        return [(i, p, m) for i, (p, m) in enumerate(found)]

    read = spark.read.text([f"{folder}/{name}" for name in kinds], wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return read.select("file", F.explode(check("file", "value")).alias("e")).select("file", "e.*")


# What a snapshot of the suffix list must hold
MARKER, LEAST_SUFFIXES, REQUIRED_SUFFIXES = "===BEGIN ICANN DOMAINS===", 1_000, ("co.in", "gov.in")


def suffix_violations(spark: SparkSession, path: str) -> DataFrame:
    """message: what makes a suffix list no genuine snapshot."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    is_rule = (F.col("v") != "") & ~F.col("v").startswith("//")
    seen = lines.agg(F.count_if(F.contains("v", F.lit(MARKER))).alias("marks"), F.count_if(is_rule).alias("n"), *[F.count_if(F.col("v") == s).alias(f"r{i}") for i, s in enumerate(REQUIRED_SUFFIXES)])
    found = [F.when(F.col("marks") == 0, "section marker is missing"), F.when(F.col("n") < LEAST_SUFFIXES, F.format_string("only %d rules", "n"))]
    found += [F.when(F.col(f"r{i}") == 0, f"rule {s} is missing") for i, s in enumerate(REQUIRED_SUFFIXES)]
    return seen.select(F.explode(F.array_compact(F.array(*found))).alias("message"))
