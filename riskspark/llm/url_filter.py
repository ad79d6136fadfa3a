"""URL filter: host and path rules first, then a weighted vocabulary of strict and soft terms.

One Aho-Corasick automaton finds all terms of both kinds in a URL in one pass; a hit counts only
between boundaries (no ASCII letter or digit on either side). One strict hit rejects, and so do
``soft_limit`` distinct soft terms.

Defined results: a NULL URL counts as empty; an empty URL, or one without ``://``, has an empty
host and path, fits no rule and is judged by the terms. Every input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import ascii_lower, whole

STRICT = ("porn", "xxx", "casino", "viagra", "cialis", "warez", "escort", "cheap-pills", "casino-win", "spam-farm")
SOFT = (
    "adult", "bet", "bonus", "cheap", "click", "crack", "dating", "deal", "discount", "farm", "free", "gamble", "hack",
    "jackpot", "loan", "lottery", "pharmacy", "pills", "poker", "promo", "replica", "slots", "spam", "torrent", "win",
)


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains when the path starts with the rule's path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (of equals the first in the list), else NULL."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # later, longer rules take precedence
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for is_strict, terms in ((False, soft), (True, strict)):  # a term in both lists is strict
        for term in terms:
            found.add_word(term.lower(), (term.lower(), is_strict))
    if len(found):
        found.make_automaton()
    return found


def _letter(char: str) -> bool:
    return char.isascii() and char.isalnum()


def count_hits(found: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """(all strict hits, distinct soft terms) of a lower-case URL."""
    strict, soft = 0, set()
    if len(found):
        for end, (term, is_strict) in found.iter(url):
            start = end - len(term) + 1
            if (start and _letter(url[start - 1])) or (end + 1 < len(url) and _letter(url[end + 1])):
                continue
            if is_strict:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = 2,
    url: str = "url",
) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict, strict_hits, soft_hits (replaced if present)."""

    @F.pandas_udf("struct<strict_hits: int, soft_hits: int>")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(strict, soft)
        for batch in urls:
            yield pd.DataFrame([count_hits(found, u) for u in batch], columns=["strict_hits", "soft_hits"])

    link = whole(url)
    rule, verdict = rule_of(F.col("_uf_host"), F.col("_uf_path"), rules)
    rejected = (F.col("_uf_hits.strict_hits") > 0) | (F.col("_uf_hits.soft_hits") >= soft_limit)
    own = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in own]
    return (
        pages.withColumns({"_uf_host": host_of(link), "_uf_path": path_of(link), "_uf_hits": hits(ascii_lower(link))})
        .select(
            *kept,
            F.col("_uf_host").alias("host"),
            F.col("_uf_path").alias("path"),
            rule.alias("rule"),
            F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
            F.col("_uf_hits.strict_hits").alias("strict_hits"),
            F.col("_uf_hits.soft_hits").alias("soft_hits"),
        )
    )
