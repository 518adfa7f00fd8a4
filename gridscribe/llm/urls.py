"""URL filters: host and path rules, and pattern rules that are fetched by their rarest literal token."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import appending, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(UPPER, LOWER)

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path; the longest wins.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: (pattern over the A-Z lower-cased url, literal tokens that any match holds): a fit blocks the url. Of tokens parted by | a match holds one.
PATTERN_RULES = (
    (r"://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    (r"[/.-]cheap[-_/](meds|pharmacy)\b", ("cheap",)),
    (r"\bonline[-_.]?casino\b", ("casino|onlinecasino",)),
    (r"\bcasino[-_/]bonus\b", ("casino", "bonus")),
    (r"\bfree[-_]download[-_]crack\b", ("free", "download", "crack")),
    (r"/torrent/[0-9a-z-]+", ("torrent",)),
    (r"\breplica[-_]watches\b", ("replica", "watches")),
    (r"\bpayday[-_]loans?\b", ("payday",)),
    (r"/login/verify[-_]account\b", ("login", "verify", "account")),
    (r"\bwin[-_](a[-_])?prize\b", ("win", "prize")),
    (r"://([^/?#]*[.-])?xxx[.-]", ("xxx",)),
    (r"[?&]aff(iliate)?_id=[0-9]+.*[?&]redirect=", ("id", "redirect")),
)


def _host_rules(first: str, second: str = "") -> list[tuple[str, tuple[str, ...]]]:
    """Rules for hosts that hold a word of `first`, or one of `first` and one of `second` in either order, as whole tokens joined by one hyphen: a rule for each word or pair of words."""
    at = lambda body: rf"://([^/?#]*[.@-])?{body}([.:/?#-]|$)"
    if not second:
        return [(at(a), (a,)) for a in first.split("|")]
    return [(at(f"({a}-{b}|{b}-{a})"), (a, b)) for a in first.split("|") for b in second.split("|")]


#: Words of hosts for gambling, betting, advertising and tracking, spam, and adult pages. A word that plain hosts have too blocks beside another telling one only.
GENERAL_WORDS = (
    ("casino|casinos", "win|wins|bonus|bonuses|game|games|slot|slots|online|royal|vegas|jackpot|spin|spins|live|club|best|top|free|mobile|poker"),
    ("poker|slots|jackpot|roulette|blackjack", "win|wins|bonus|online|vegas|spin|spins|live|free|room|rooms|best|top|mobile"),
    ("bet|bets|betting", "free|best|live|online|sport|sports|tips|odds|bonus|win|site|sites|football"),
    ("ad|ads|adverts|banner|banners", "track|tracker|trackers|tracking|server|servers|click|clicks|network|pixel|serve|count|counter"),
    ("click|pixel|visitor|user", "track|tracker|trackers|tracking"),
    ("adserver|adservers|adtrack|adtracker|adtracking|doubleclick|clicktrack|clicktracker", ""),
    ("spam|link|seo", "farm|farms"),
    ("spam", "links|mail|mailer|blast|offers|deals|seo"),
    ("spamfarm|linkfarm", ""),
    ("adult", "x|xx|video|videos|cam|cams|chat|dating|tube|sex|porn|movies|pics"),
    ("porn|porno|pornos|xxx|sexcam|sexcams", ""),
    ("sex|nude|nudes", "cam|cams|chat|video|videos|tube|pics|live|free|dating"),
)
#: The same as some hundred pattern rules, each of which is indexed by its own rarest token.
GENERAL_RULES = tuple(r for words in GENERAL_WORDS for r in _host_rules(*words))

#: The pattern rules that the query runs.
RULES = PATTERN_RULES + GENERAL_RULES

#: Rules of a table that are read at most: they go to every worker.
MOST_RULES = 1_000_000


def read_rules(rules: DataFrame, most: int = MOST_RULES) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Pattern rules of a table (pattern string, literals array<string>): a pattern over the lower-cased url, and tokens that any match holds (of tokens parted by | it holds one).

    Rows without a pattern or literals are left out, as nothing would fetch them. A pattern that does not compile is an error, and so are more than `most` rules.
    """
    got = rules.where("pattern is not null and size(literals) > 0").select("pattern", "literals").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rules")
    return tuple((r["pattern"], tuple(r["literals"])) for r in got)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for a null or a url without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens(url: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", url)


def literal_counts(urls: DataFrame, url_col: str, literals: list[str]) -> dict[str, int]:
    """In how many urls of the whole table each literal of the rules is; as many rows come back as the rules have literals."""
    literals = sorted({t for ls in literals for t in ls.split("|")})
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(url_col, UPPER, LOWER), F.lit("[0-9a-z]+"), 0))).alias("t"))
    return {r.t: r.n for r in found.where(F.col("t").isin(literals)).groupBy("t").agg(F.count("*").alias("n")).collect()}


def token_index(rules, counts: dict[str, int]) -> dict[str, list[int]]:
    """Places of the rules by their rarest literal token (tokens of which a match holds one count together, and each fetches the rule); of equally
    rare ones the longest, then the first by code point."""
    index: dict[str, list[int]] = {}
    for k, (_, literals) in enumerate(rules):
        keys = min(literals, key=lambda ts: (sum(counts.get(t, 0) for t in ts.split("|")), -len(ts), ts))
        for key in keys.split("|"):
            index.setdefault(key, []).append(k)
    return index


def judge_urls(pages: DataFrame, url_col: str = "url", host_rules=HOST_RULES, pattern_rules=RULES) -> DataFrame:
    """pages with _host, _path, _rule (the host rule that fits, else null), _verdict (allow or block) and _n_fetched (how many pattern rules the url's tokens fetched; null under a host rule).

    The host rule decides where one fits. Elsewhere the url is cut into tokens, each token fetches the pattern rules that are
    indexed under it, and only those run: a fit blocks. Null urls and urls without ``://``: empty host and path; a null is allowed.
    Ties, repeated rows, very long urls and empty tables need nothing special; further columns stay, columns named like the results are replaced.
    The rules are a parameter that every worker gets; they do not grow with the data. A pattern is compiled when a url first fetches it.
    """
    pages = pages.drop("_host", "_path", "_rule", "_verdict", "_n_fetched")
    index = token_index(pattern_rules, literal_counts(pages, url_col, sorted({t for _, ls in pattern_rules for t in ls})))
    by_length = sorted(host_rules, key=lambda r: -len(r[0] + r[1]))
    patterns = [p for p, _ in pattern_rules]

    def run(batches):
        compiled: dict[int, re.Pattern] = {}

        def fits(k: int, low: str) -> bool:
            if k not in compiled:
                compiled[k] = re.compile(patterns[k], re.ASCII)
            return compiled[k].search(low) is not None

        def verdict(url: str | None) -> tuple[str, str, str | None, str, int | None]:
            host, path = split_url(url)
            for rule_host, rule_path, what in by_length:
                if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
                    return host, path, rule_host + rule_path, what, None
            low = (url or "").translate(_LOWER)
            fetched = dict.fromkeys(k for t in dict.fromkeys(tokens(low)) for k in index.get(t, ()))
            return host, path, None, "block" if any(fits(k, low) for k in fetched) else "allow", len(fetched)

        kinds = [pa.string()] * 4 + [pa.int64()]
        for batch in batches:
            got = list(zip(*map(verdict, batch.column(url_col).to_pylist()))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(x), t) for x, t in zip(got, kinds)]], [*batch.schema.names, "_host", "_path", "_rule", "_verdict", "_n_fetched"])

    return appending(pages, run, "_host string, _path string, _rule string, _verdict string, _n_fetched bigint")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def _sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1])))
    # words of a family as one pattern each: the same hosts as a rule for every pair of words
    at = lambda body: rf"://([^/?#]*[.@-])?{body}([.:/?#-]|$)"
    families = [at(f"(({a})-({b})|({b})-({a}))" if b else f"({a})") for a, b in GENERAL_WORDS]
    blocked = " OR ".join(f"regexp_matches(low, '{p}')" for p in [*(p for p, _ in PATTERN_RULES), *families])
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in HOST_RULES)
    lower = f"'{UPPER}', '{LOWER}'"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), {lower}) AS low,
    CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fitted AS (SELECT *, CASE {fits} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM fitted"""


SQL = _sql()
