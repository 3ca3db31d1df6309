"""URL filter: allow and block rules for hosts and paths, then a weighted vocabulary found by Aho-Corasick.

Each term has a weight. A url without a fitting rule is blocked where the weights of the distinct terms that occur in
it, with no ASCII letter or digit on either side, reach the limit: so by one strict term, whose weight is the limit, or
by several soft ones. The vocabulary is a parameter, and can be read from a table (vocabulary()).

Edge cases: a null url has an empty host and path, meets no rule and no term, and is allowed; so has one without
`://`, whose terms count. Urls of any length are read whole. Of rules with one text the first stands. An empty table
gives an empty result. Extra columns are kept; those with the name of a result column are replaced. Repeated rows are
judged alike, each on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Terms by weight; the limit is 1.
STRICT = (
    "adult casino casinos escort escorts hentai malware nsfw phishing porn porno poker pornography ransomware sexcam spyware "
    "trojan viagra cialis warez xxx keygen blackjack roulette sportsbook hookup camgirls"
).split()
SOFT = (
    "ads affiliate bet bets betting bonus bonuses cheap clickbait click coupon coupons crack credit crypto dating deal deals "
    "discount diet earn farm free freebies gamble gambling giveaway jackpot loan loans lottery mature miracle money nude "
    "offer offers pharmacy pills prize prizes promo replica rx sale seo sex sexy slots spam supplement survey sweepstakes "
    "torrent track traffic unlimited weightloss win winner"
).split()
VOCABULARY: tuple[tuple[str, float], ...] = (*((t, 1.0) for t in STRICT), *((t, 0.5) for t in SOFT))
LIMIT = 1.0
#: Terms that vocabulary() takes from a table: the automaton of as many is held by every task.
MOST_TERMS = 200_000
RESULT = ("host", "path", "rule", "weight", "terms", "verdict")


def vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> tuple[tuple[str, float], ...]:
    """The terms (term, weight) of a table, lower-cased; of repeated ones the greatest weight. Null and empty terms and
    null weights don't count. A table of more than `most` terms is an error, as it would be held by every task."""
    low = terms.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("double").alias("weight")).where("term != '' AND weight IS NOT NULL")
    rows = low.groupBy("term").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(sorted((r.term, r.weight) for r in rows))


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the url's path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The rule's text and action, null where none fits; of rules with the same text the first stands."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), -rules.index(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


@lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, float], ...]):
    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


def _weigh(text: str | None, terms: tuple[tuple[str, float], ...]) -> tuple[float, list[str]]:
    """The weight of the distinct terms in a text, and those terms."""
    machine = _automaton(terms)
    if not text or not len(machine):
        return 0.0, []
    hits: dict[str, float] = {}
    inside = lambda c: c.isascii() and c.isalnum()
    for end, (term, weight) in machine.iter(text):
        start = end - len(term) + 1
        if not (start and inside(text[start - 1]) or end + 1 < len(text) and inside(text[end + 1])):
            hits[term] = weight
    return sum(hits.values()), sorted(hits)


def term_weights(url: Column, terms: tuple[tuple[str, float], ...]) -> Column:
    @F.pandas_udf("weight double, terms array<string>")
    def weights(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_weigh(u, terms) for u in urls], columns=["weight", "terms"])

    return weights(ascii_lower(url))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, terms: tuple[tuple[str, float], ...] = VOCABULARY, limit: float = LIMIT) -> DataFrame:
    """pages with host, path, rule, weight, terms and verdict: the longest fitting rule's action, else block where the
    weight of the distinct terms found is at least the limit, else allow."""
    host, path = host_path(F.col("url"))
    hits = "__lf_hits"
    out = pages.drop(*RESULT).withColumns({"host": host, "path": path})
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn(hits, term_weights(F.col("url"), terms))
    by_weight = F.when(F.col(f"{hits}.weight") >= limit, "block").otherwise("allow")
    return out.withColumns({"rule": rule, "weight": F.col(f"{hits}.weight"), "terms": F.col(f"{hits}.terms"), "verdict": F.coalesce(action, by_weight)}).drop(hits)


def sql(rules: tuple[Rule, ...] = RULES, terms: tuple[tuple[str, float], ...] = VOCABULARY, limit: float = LIMIT) -> str:
    """The query in DuckDB's SQL: each weight's terms in one pattern where one of them is enough, else one by one."""
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    by_length = sorted(rules, key=lambda r: -len(r.text))
    edge = lambda x: f"(^|[^a-z0-9])({x})([^a-z0-9]|$)"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in by_length)
    strict = "|".join(re.escape(t) for t, w in terms if w >= limit)
    soft = " + ".join(f"{w}::DOUBLE * regexp_matches(low, '{edge(re.escape(t))}')::INT" for t, w in terms if w < limit)
    return f"""
WITH cut AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, {case(lambda r: r.text)} ELSE NULL END AS rule,
  {case(lambda r: r.action)} WHEN regexp_matches(low, '{edge(strict)}') OR {soft} >= {limit}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
