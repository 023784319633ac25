"""Wiki text: unescaping, titles and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities in the order in which they are replaced, and the patterns of titles and links.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]
TITLE = r"<title>(.+?)</title>"
LINK = r"\[\[(.+?)([|#]|\]\])"


def xml_unescape(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def capitalize_first(text: Column) -> Column:
    """Upper case for a first character a-z; any other stays."""
    head = F.substring(text, 1, 1)
    return F.when(head.rlike("^[a-z]$"), F.concat(F.upper(head), F.substr(text, F.lit(2)))).otherwise(text)


def titles(lines: DataFrame) -> DataFrame:
    """(line, page) of the lines with a title; its first one counts."""
    text = xml_unescape(F.col("value"))
    return lines.select(text.alias("line")).filter(F.col("line").rlike(TITLE)).select("line", F.regexp_extract("line", TITLE, 1).alias("page"))


def links(lines: DataFrame) -> DataFrame:
    """(src, dst): one row for each link that comes, with a first letter in upper case; empty ones are dropped."""
    found = titles(lines).select(F.col("page").alias("src"), F.explode(F.regexp_extract_all("line", F.lit(LINK), F.lit(1))).alias("raw"))
    return found.select("src", capitalize_first(F.col("raw")).alias("dst")).filter(F.length("dst") > 0)
