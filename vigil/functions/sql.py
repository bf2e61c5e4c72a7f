"""The text and link functions for SQL: scalar functions, and table functions for lateral joins.

``register`` adds temporary functions to a session:

* ``norm_text(text)``, ``is_ip_literal(host)``, ``registrable_domain(host)``, ``squash_label(label)``, ``fold_label(label)``,
  ``osa_distance(a, b)``, ``lang_of(text)`` (over a normalised text)
* ``extract_urls(text)``: table of ord, raw, scheme, host, path, ``extract_brands(text)``: table of ord, brand_id, name, start, stop

Bodies are SQL over built-in functions, so calls are inlined into the plan; only the compatibility composition is a
Python function, as in the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


from vigil.functions import text as T
from vigil.operators import analyzers as A
from vigil.operators import urls as U

from vigil.sources.rules import BUILT_IN, Pack


def _text(value: str) -> str:
    """A string as a raw SQL literal."""
    quote = '"' if "'" in value else "'"
    if quote in value:
        return "concat(" + ", ".join(x for part in value.split("'") for x in (_text(part), '"\'"'))[: -len(', "\'"')] + ")"
    return f"r{quote}{value}{quote}"


def _array(values) -> str:
    return f"array({', '.join(_text(v) for v in values)})" if values else "CAST(array() AS array<string>)"


def _define(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def _registrable(pack: Pack) -> str:
    kinds: dict[str, list[str]] = {"exception": [], "wildcard": [], "plain": []}
    for r in pack.suffixes:
        r = r.lower()
        kinds["exception" if r[0] == "!" else "wildcard" if r[:2] == "*." else "plain"].append(r[1:] if r[0] == "!" else r[2:] if r[:2] == "*." else r)
    hit = lambda kind: f"array_max(filter(sequence(1, size(l)), k -> array_contains({_array(kinds[kind])}, array_join(slice(l, size(l) - k + 1, k), '.'))))"
    labels = "split(rtrim('.', lower(coalesce(try_reflect('java.net.IDN', 'toASCII', host, 1), host))), '[.]')"
    n = f"coalesce({hit('exception')} - 1, greatest(coalesce({hit('wildcard')} + 1, 1), coalesce({hit('plain')}, 1)))"
    return f"get(transform(array({labels}), l -> get(transform(array({n}), n -> CASE WHEN NOT is_ip_literal(host) AND size(l) > n THEN array_join(slice(l, size(l) - n, n + 1), '.') END), 0)), 0)"


def register(spark: SparkSession, pack: Pack = BUILT_IN) -> None:
    """Add the functions to the session; the pack's tables are part of their bodies."""
    spark.udf.register("compose_text", T._compose)
    white = "​‌‍⁠﻿"
    bare = f"regexp_replace(CASE WHEN t RLIKE r'^[\\x00-\\x7F]*$' THEN t ELSE compose_text(t) END, '[{white}]', '')"
    _define(spark, "norm_text", "t STRING", "STRING", f"lower(trim(regexp_replace(regexp_replace({bare}, '[   ]', ' '), r'\\s+', ' ')))")
    _define(spark, "is_ip_literal", "host STRING", "BOOLEAN", f"host RLIKE {_text(U.QUAD)} OR (host RLIKE {_text(r'^\[?[0-9A-Fa-f:.]+\]?$')} AND contains(host, ':'))")
    _define(spark, "registrable_domain", "host STRING", "STRING", _registrable(pack))
    _define(spark, "squash_label", "label STRING", "STRING", f"regexp_replace(label, {_text(r'[-._\p{Nd}]')}, '')")
    folded = f"translate(label, {_text(''.join(pack.single_folds))}, {_text(''.join(pack.single_folds.values()))})"
    for a, b in pack.sequence_folds:
        folded = f"replace({folded}, {_text(a)}, {_text(b)})"
    _define(spark, "fold_label", "label STRING", "STRING", folded)
    pattern = rf"(?iu)(?<![\w@.])({U.CANDIDATE})"
    plain = _array([s for s in pack.suffixes if "." not in s])
    _define(
        spark,
        "extract_urls",
        "t STRING",
        "TABLE(ord INT, raw STRING, scheme STRING, host STRING, path STRING)",
        f"""SELECT ord, raw, scheme, host, path FROM (
          SELECT ord, raw, CASE WHEN contains(raw, '://') THEN substring_index(raw, '://', 1) END AS scheme, regexp_extract(rest, r'^([^/?#:]*)', 1) AS host, nullif(regexp_extract(rest, r'(?s)^[^/?#:]*(.*)$', 1), '') AS path
          FROM (SELECT ord, raw, regexp_replace(CASE WHEN contains(raw, '://') THEN substr(raw, instr(raw, '://') + 3) ELSE raw END, r'^[^/?#@]*@', '') AS rest
            FROM (SELECT posexplode(regexp_extract_all(t, {_text(pattern)}, 1)) AS (ord, raw))))
        WHERE host <> '' AND (scheme IS NOT NULL OR startswith(lower(raw), 'www.') OR array_contains({plain}, lower(substring_index(host, '.', -1))))""",
    )
    aliases = [(i, b[0], b[1], A._alias_pattern(a)) for i, b in enumerate(pack.brands) for a in b[2]]
    found = ", ".join(f"transform(regexp_extract_all(t, {_text(p)}, 0), m -> named_struct('brand_ord', {i}, 'brand_id', {_text(b)}, 'name', {_text(n)}, 'matched', m))" for i, b, n, p in aliases)
    _define(spark, "extract_brands", "t STRING", "TABLE(brand_id STRING, name STRING, matched STRING)", f"SELECT b.brand_id, b.name, b.matched FROM (SELECT explode(flatten(array({found}))) AS b)")


def functions() -> list[str]:
    return ["norm_text", "is_ip_literal", "registrable_domain", "squash_label", "fold_label", "extract_urls", "extract_brands"]



