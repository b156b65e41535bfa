"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is a pattern with a verdict and a rank. ``||`` at its begin stands for the begin
of a host or of one of its parent domains, ``^`` for a separator or the end, ``*`` for
anything. A literal token is a run of letters and digits that the pattern bounds on
both sides. Tokens of a URL fetch the rules filed under them, and only those are
matched as regular expressions. Rules without a literal token are always tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm.tables import slices


class Rule(NamedTuple):
    pattern: str
    verdict: str
    #: The name that a result carries; None for rules that give a verdict only.
    name: str | None = None
    #: The rule with the highest rank wins; among equals the longest pattern, then an allow rule.
    rank: int = 0


#: Rules by host and path of the contract (fixed values).
LISTED = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Words in a host or a path that mark advertising, gambling, adult and scam sites; a word
#: stands between separators.
BLOCKED_WORDS = (
    "casino bets betting poker roulette jackpot slots lottery adult porn xxx sex nude escort camgirls "
    "spam malware phishing warez torrent crack keygen viagra cialis replica payday loans "
    "ads adserver adserv doubleclick popup popunder banner banners tracker clickbait"
).split()
PATTERNS = [
    *(Rule(f"^{w}^", "block") for w in BLOCKED_WORDS),
    Rule("/affiliate/*/click^", "block"),
    Rule("/redirect?*url=http", "block"),
    Rule("||login.*/verify^", "block"),
    Rule("^banner^*^museum^", "allow", rank=1),
    Rule("^crack^*^climbing^", "allow", rank=1),
]

_SEPARATOR = r"(?:[^a-z0-9_%]|\Z)"
_TOKEN = re.compile(r"[a-z0-9]+")


def listed(rules: list[tuple[str, str]] = LISTED) -> list[Rule]:
    """Host-and-path rules as patterns; they outrank all other rules."""
    return [Rule(f"||{text}", verdict, text, 10) for text, verdict in rules]


def expression(pattern: str) -> str:
    """The regular expression of a pattern over `` host path``; ``||`` rules keep the path's case."""
    anchored = pattern.startswith("||")
    out = []
    for k, c in enumerate(pattern[2:] if anchored else pattern):
        if c == "^":
            out.append(r"[^a-z0-9_%]" if k == 0 and not anchored else _SEPARATOR)
        else:
            out.append(".*" if c == "*" else re.escape(c))
    return (r"\A(?:[^/]*\.)?" if anchored else "") + "".join(out)


def tokens(pattern: str) -> list[str]:
    """Literal tokens with a bound on both sides inside the pattern."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    found = []
    for m in _TOKEN.finditer(body.lower()):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return found


def split_url(url):
    """(host, path) columns: after the first ``://`` up to ``/ ? #``; then up to ``? #``."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    usable = F.instr(url, "://") > 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(usable, host).otherwise(F.lit("")), F.when(usable, path).otherwise(F.lit(""))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many of ``urls`` (host, path) hold each literal token of the rules; few rows."""
    wanted = sorted({t for r in rules for t in tokens(r.pattern)})
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("([a-z0-9]+)"), 1))
    found = urls.select(F.explode(words).alias("token")).filter(F.col("token").isin(wanted)).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules, self.always, self.by_token = [], [], {}
        order = sorted(rules, key=lambda r: (-r.rank, -len(r.pattern), r.verdict != "allow", r.pattern))
        for k, rule in enumerate(order):
            self.rules.append((re.compile(expression(rule.pattern), re.S), rule))
            own = tokens(rule.pattern)
            if own:
                self.by_token.setdefault(min(own, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def find(self, host: str, path: str) -> Rule | None:
        text, low = host + path, f" {host}{path.lower()}"
        near = {k for t in set(_TOKEN.findall(low)) for k in self.by_token.get(t, ())}
        for k in sorted(near.union(self.always)):
            match, rule = self.rules[k]
            if match.search(text if rule.pattern.startswith("||") else low):
                return rule
        return None


def judge(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of each row of ``pages`` (page_id, url).

    A url that is null or lacks ``://`` has an empty host and path and gets the default
    verdict. ``rule`` is the name of a listed rule, null for other patterns. Repeated
    rows are judged one by one.
    """
    rules = [*listed(), *PATTERNS] if rules is None else rules
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    index = Index(rules, token_counts(rows, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [index.find(h, p) for h, p in zip(part["host"].to_pylist(), part["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part["page_id"], part["host"], part["path"],
                    pa.array([r.name if r else None for r in found], pa.string()),
                    pa.array([r.verdict if r else default for r in found], pa.string()),
                    pa.array([r.pattern if r else None for r in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict", "pattern"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
