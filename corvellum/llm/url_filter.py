"""URL filters: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import table

# Rules of the contract, as (verdict, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# One of these terms is enough to reject an address.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "viagra", "cialis", "warez", "malware", "phishing", "spam")

# Several different ones of these reject an address.
SOFT = ("adult", "bet", "bonus", "casino", "cheap", "crack", "dating", "farm", "free", "gambling", "hookup", "keygen", "loan", "nude", "payday", "pharmacy", "pills", "poker", "sexy", "slots", "torrent", "webcam", "win")

STRICT_WEIGHT, SOFT_WEIGHT, REJECT_AT = 2, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host of an address: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of an address: what follows the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class _Judge:
    """Rules by host and an automaton over both vocabularies; made once in each Python worker."""

    def __init__(self, rules: Sequence[tuple[str, str]], strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.rules: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            self.rules.setdefault(host, []).append((slash + rest, rule, verdict))
        for of_host in self.rules.values():
            of_host.sort(key=lambda r: -len(r[0]))
        self.automaton = ahocorasick.Automaton()
        for terms, kind in ((soft, 0), (strict, 1)):
            for term in terms:
                self.automaton.add_word(term, (term, kind))
        self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule: hosts are tried from the whole one to its last label."""
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while True:
            for begin, rule, verdict in self.rules.get(host[at:], ()):
                if path.startswith(begin) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1
            if not at:
                return best

    def terms(self, url: str) -> tuple[int, int]:
        """Numbers of different strict and soft terms that stand alone, not inside a longer run of letters or digits."""
        found: set[tuple[str, int]] = set()
        for end, (term, kind) in self.automaton.iter(url):
            before, after = end - len(term), end + 1
            if (before < 0 or not _inner(url[before])) and (after == len(url) or not _inner(url[after])):
                found.add((term, kind))
        strict = sum(kind for _, kind in found)
        return strict, len(found) - strict


def _inner(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


#: Terms that a vocabulary may have, as the automaton travels to every task.
MOST_TERMS = 1_000_000


def vocabulary(terms: DataFrame) -> tuple[list[str], list[str]]:
    """Strict and soft terms of a table (term, strict boolean), A-Z lower-cased, for `judge_urls`; null and empty terms are left
    out, a term that is both is strict, and a table of over `MOST_TERMS` different ones is refused."""
    low = terms.select(F.translate("term", UPPER, LOWER).alias("term"), F.coalesce("strict", F.lit(False)).alias("strict")).where("term <> ''")
    rows = low.groupBy("term").agg(F.max("strict").alias("strict")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary of over {MOST_TERMS} terms can't travel to the tasks")
    return sorted(r.term for r in rows if r.strict), sorted(r.term for r in rows if not r.strict)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    reject_at: int = REJECT_AT,
    url_col: str = "url",
) -> DataFrame:
    """All rows and columns of ``pages`` plus a struct ``url_judgement`` (host, path, rule, strict_terms, soft_terms,
    weight, verdict). No shuffle: one pass over the address column.

    Null or empty addresses, and those without ``://``, have an empty host and path and fit no rule; the vocabulary
    still applies to their text. Very long addresses are judged whole, in one pass of the automaton; rules that tie in
    length can't both fit, as they would be the same rule. Repeated rows are judged alike, an empty table gives no rows, other
    columns pass through untouched, but for one called ``url_judgement``, which gives way.
    """
    judge: list[_Judge] = []

    @F.pandas_udf("rule string, rule_verdict string, strict_terms long, soft_terms long")
    def judged(host: pd.Series, path: pd.Series, url: pd.Series) -> pd.DataFrame:
        if not judge:
            judge.append(_Judge(rules, strict, soft))
        rows = [(*judge[0].rule(h, p), *judge[0].terms(u)) for h, p, u in zip(host, path, url, strict=True)]
        return pd.DataFrame(rows, columns=["rule", "rule_verdict", "strict_terms", "soft_terms"])

    url = pages[url_col]
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    judged_as = judged(host_of(url), path_of(url), low)
    given = [c for c in pages.columns if c != "url_judgement"]
    out = pages.select(*[pages[f"`{c}`"] for c in given], judged_as.alias("__judged__"), host_of(url).alias("__host__"), path_of(url).alias("__path__"))
    j = F.col("__judged__")
    weight = j["strict_terms"] * STRICT_WEIGHT + j["soft_terms"] * SOFT_WEIGHT
    verdict = F.coalesce(j["rule_verdict"], F.when(weight >= reject_at, "block").otherwise("allow"))
    made = F.struct(
        F.col("__host__").alias("host"), F.col("__path__").alias("path"), j["rule"].alias("rule"),
        j["strict_terms"].alias("strict_terms"), j["soft_terms"].alias("soft_terms"), weight.alias("weight"), verdict.alias("verdict"),
    )
    return out.select(*[F.col(f"`{c}`") for c in given], made.alias("url_judgement"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address, judged."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "url_judgement.*")


def _sql() -> str:
    def terms(names: Sequence[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in names)

    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        whens.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}')", rule, verdict))
    rule = "CASE " + " ".join(f"WHEN {w} THEN '{r}'" for w, r, _ in whens) + " END"
    verdict = "CASE " + " ".join(f"WHEN {w} THEN '{v}'" for w, _, v in whens) + f" WHEN weight >= {REJECT_AT} THEN 'block' ELSE 'allow' END"
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
b AS (SELECT *, {terms(STRICT)} AS strict_terms, {terms(SOFT)} AS soft_terms FROM a),
c AS (SELECT *, strict_terms * {STRICT_WEIGHT} + soft_terms * {SOFT_WEIGHT} AS weight FROM b)
SELECT page_id, host, path, {rule} AS rule, strict_terms, soft_terms, weight, {verdict} AS verdict FROM c
"""


QUERIES = {"op1_url_filters": op1_url_filters}
SQL = {"op1_url_filters": _sql()}
