"""Operator 7: URLs judged by host rules and by a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased URL in one pass; a
hit counts only between characters that are no ASCII letters or digits. One strict term or
``min_soft`` distinct soft terms reject the URL. A rule ``host/path`` fits its host and all its
subdomains when the URL's path starts with the rule's path; the longest fitting rule (then the one
with the longer host) overrides the vocabulary.

Rules and vocabulary are parameters of bounded size; each task holds them, and rows are judged
where they are read, without a shuffle.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a null URL
has no hits and is allowed; equal rows are all judged; other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
STRICT = ("adult-x", "casino", "casinos", "cheap-pills", "escorts", "free-bets", "payday-loan", "porn", "viagra", "warez", "xxx")
SOFT = ("adult", "ads", "bet", "bets", "betting", "bonus", "cheap", "clicks", "crack", "dating", "farm", "free", "gamble", "hacked",
        "jackpot", "loan", "nude", "pills", "poker", "sex", "slots", "spam", "track", "tracker", "win", "winner")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_ALNUM = frozenset(string.ascii_lowercase + string.digits)
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path, both empty without ``://``."""
    m = _PARTS.search(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class Judge:
    def __init__(self, rules: Mapping[str, str], strict: Sequence[str], soft: Sequence[str], min_soft: int) -> None:
        import ahocorasick

        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules.items():
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        self.words = ahocorasick.Automaton()
        for hard, terms in ((False, soft), (True, strict)):
            for t in terms:
                self.words.add_word(t.translate(LOWER), (len(t), hard, t))
        self.words.make_automaton()
        self.min_soft = min_soft

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        found, name = [], host
        while True:
            found += [(len(r), len(name), r, v) for start, r, v in self.by_host.get(name, ()) if path.startswith(start)]
            if "." not in name:
                return max(found)[2:] if found else None
            name = name.partition(".")[2]

    def rejects(self, url: str | None) -> bool:
        text, seen = (url or "").translate(LOWER), set()
        for end, (n, hard, term) in self.words.iter(text):
            lo, hi = end - n, end + 1
            if (lo < 0 or text[lo] not in _ALNUM) and (hi == len(text) or text[hi] not in _ALNUM):
                seen.add(term)
                if hard or len(seen) >= self.min_soft:
                    return True
        return False


def judge_urls(pages: DataFrame, rules: Mapping[str, str] = RULES, strict: Sequence[str] = STRICT,
               soft: Sequence[str] = SOFT, min_soft: int = 2) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(rules, strict, soft, min_soft)
        for b in batches:
            urls = b.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            fits = [j.rule(*p) for p in parts]
            verdicts = [f[1] if f else "block" if j.rejects(u) else "allow" for f, u in zip(fits, urls, strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
                pa.array([f and f[0] for f in fits], pa.string()), pa.array(verdicts, pa.string()),
            ], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).mapInArrow(
        judge, "page_id long, host string, path string, rule string, verdict string")


def sql(rules: Mapping[str, str] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = 2) -> str:
    def hit(terms: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9])({terms})($|[^a-z0-9])')"

    best = sorted(rules, key=lambda r: (-len(r), -r.index("/")))
    fits = {r: f"('.' || host) LIKE '%.{r.partition('/')[0]}' AND starts_with(path, '/{r.partition('/')[2]}')" for r in best}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r in best) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{rules[r]}'" for r in best)
    count = " + ".join(f"{hit(t)}::INT" for t in soft)
    lower = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), {lower}) AS u,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), {lower}) AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule FROM parts)
SELECT page_id, host, path, rule,
       {verdict} WHEN {hit("|".join(strict))} OR {count} >= {min_soft} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
