"""Links of HTML: anchors with the text that they show, read by scanning tags, and the hosts that they lead to.

All of it is expressions over one text: comments, scripts and styles go first, then each anchor reaches to its end tag or
to the next anchor's start, whichever comes first, and its text is what is left without the tags inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import bound

#: The inside of a tag: anything, with ">" only inside quotes. Possessive, so no text makes it go back.
INSIDE = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b" + INSIDE + r">.*?(?:</\1\s*>|$)"
ANCHOR = r"(?is)<a(?=[\s/])(" + INSIDE + r")>(.*?)(?=<a[\s/>]|</a\s*>|$)"
TAG = r"(?s)</?[A-Za-z!]" + INSIDE + ">"
ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});"
# The named entities that are read; others stay as they are
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "euro": "€"}


def _character(entity: Column) -> Column:
    hexadecimal = entity.rlike("^&#[xX]")
    number = F.when(hexadecimal, F.conv(F.substr(entity, F.lit(4), F.length(entity) - 4), 16, 10)).otherwise(F.substr(entity, F.lit(3), F.length(entity) - 3)).try_cast("int")
    fit = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    coded = F.decode(F.unhex(F.lpad(F.hex(F.when(fit, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    named = F.coalesce(*[F.when(entity == f"&{k};", F.lit(v)) for k, v in NAMED.items()], entity)
    return F.when(entity.startswith("&#"), coded).otherwise(named)


def unescape(text: Column) -> Column:
    """``text`` with its entities read once."""
    between, entities = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    put = F.zip_with(between, entities, lambda t, e: F.concat(t, F.when(e.isNull(), "").otherwise(_character(e))))
    return F.when(text.contains("&"), F.array_join(put, "")).otherwise(text)


def _href(attributes: Column) -> Column:
    """The first href of an anchor's attributes, or null."""
    named = F.filter(F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(r"(?is)^href\s*="))
    value = F.regexp_extract(F.get(named, F.lit(0)), r"(?is)^href\s*=\s*(.*)$", 1)
    bare = F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.trim(unescape(bare))


def anchors(html: Column) -> Column:
    """array<struct<href, shown>> of the anchors of ``html`` that have an href, in order; white space of what they show is folded."""
    whole = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(ANCHOR), F.lit(0))

    def read(a: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(a, ANCHOR, 2), TAG, "")
        shown = F.trim(F.regexp_replace(unescape(inner), "[\\s ]+", " "))
        return F.struct(_href(F.regexp_extract(a, ANCHOR, 1)).alias("href"), shown.alias("shown"))

    return F.filter(F.transform(whole, read), lambda x: x["href"].isNotNull() & (x["href"] != ""))


def links(pages: DataFrame) -> DataFrame:
    """msg_id, ord, raw, scheme, host, path, start, end, punycode, display_text of each anchor of ``pages`` (msg_id, html, url).

    A href without a host is one of the page itself, whose ``url`` may be null: then it is left out, and so are hrefs of
    other schemes than http and https. The columns are those of links in plain texts; start and end are null.
    """
    each = pages.select("msg_id", "url", F.posexplode(anchors(F.col("html"))).alias("ord", "a"))
    raw, own = F.col("a.href"), F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    scheme = F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    away = raw.startswith("//") | raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    named = F.when(scheme != "", scheme).otherwise(F.nullif(own, F.lit("")))
    rest = F.regexp_replace(F.when(away, F.regexp_replace(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")).otherwise(F.regexp_replace("url", r"^[^:]*://", "")), "^[^/?#@]*@", "")
    host = F.regexp_extract(rest, r"^(\[[^\]]*\]|[^/?#:]*)", 1)
    path = F.when(away, F.nullif(F.regexp_extract(rest, r"(?s)^(?:\[[^\]]*\]|[^/?#:]*)(.*)$", 1), F.lit(""))).otherwise(raw)
    out = each.select("msg_id", "ord", raw.alias("raw"), named.alias("scheme"), host.alias("host"), path.alias("path"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("a.shown").alias("display_text"))
    out = out.where((F.col("host") != "") & (F.lower("scheme").isin("http", "https") | F.col("scheme").isNull() & F.col("raw").startswith("//")))
    return out.withColumn("punycode", bound(F.split(F.lower("host"), r"\."), lambda labels: F.exists(labels, lambda x: x.startswith("xn--"))))
