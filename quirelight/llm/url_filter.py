"""URL filter: pattern rules indexed by their rarest literal token.

Rules are of two kinds. A host rule `host/path` fits its host and all subdomains where the url's path starts
with the rule's path; the longest that fits decides. A pattern rule is looked for in host + path, in lower case. It has literal text, `^` for a separator (or
an end) and `*` for anything; `||` at its beginning is the beginning of the host or of one of its labels, `|` is the beginning or the end of all; `@@` before it makes it an
exception. Every literal that stands as a whole token
in any url that the rule fits is a key of the rule; the rule is indexed under the key that the corpus' urls have
least often, counted over all urls. A url's tokens fetch their candidate rules, and only those run their
regular expressions. Rules without a key are tried on every url.

A url that fits no host rule gets the verdict of the pattern rules: allow if an exception fits, else block if another one fits, else allow.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; equal rows
get equal rows; an empty table gives an empty result; with no rules all urls are allowed; only the id and the
url are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    is_host: bool = False

    def parts(self) -> tuple[str, str, str]:
        """(beginning, text, end): how the pattern is anchored, and what is between."""
        body, begin, end = self.text.removeprefix("@@"), "", ""
        for mark in ("||", "|"):
            if body.startswith(mark):
                begin, body = mark, body.removeprefix(mark)
                break
        if body.endswith("|"):
            end, body = "|", body[:-1]
        return begin, body, end

    def regex(self) -> str:
        if self.is_host:
            return rf"^(?:[^/]*\.)?{re.escape(self.text)}"
        begin, body, end = self.parts()
        part = {"^": "(?:[^a-z0-9]|^|$)", "*": ".*"}
        return {"||": r"^(?:[^/]*\.)?", "|": "^", "": ""}[begin] + "".join(part.get(c, re.escape(c)) for c in body) + {"|": "$", "": ""}[end]

    def keys(self) -> list[str]:
        """Literals that are whole tokens of each url that fits."""
        begin, body, end = (".", self.text, "") if self.is_host else self.parts()
        text = ("." if begin else "*") + body + ("." if end else "*")
        return [m.group() for m in _TOKEN.finditer(text) if text[m.start() - 1] != "*" and text[m.end()] != "*"]


# The host rules that the query states.
HOST_RULES = [
    Rule("net/", "block", True),
    Rule("example.net/en/", "allow", True),
    Rule("example.com/de/", "block", True),
    Rule("org/fr/", "allow", True),
]
# Words that hosts and paths of unwanted pages have as whole tokens; pairs of words, the second after any separator; beginnings of host labels that serve
# adverts and tracking; ends of paths that are no pages; and names that have such words but are wanted.
UNWANTED = (
    "adult porn xxx escort escorts camgirl camgirls hentai casino poker betting bookmaker jackpot roulette viagra cialis levitra tramadol warez keygen crackz "
    "spam popunder clickbait ringtones payday replica"
).split()
FIRST = "free cheap buy online best discount instant".split()
SECOND = "bets pills casino slots spins essays followers likes backlinks watches handbags loans cams dating torrents meds ringtone traffic".split()
PAIRS = ["spam-farm", "link-farm", "crack-serial", "serial-key", "make-money-fast", "work-from-home-jobs", "weight-loss-miracle", "hot-singles"]
AD_LABELS = "ads ad adserver adservice adtrack banner banners doubleclick pixel popads syndication telemetry tracker tracking".split()
NO_PAGES = ["wp-login.php", "xmlrpc.php", "wp-cron.php", "favicon.ico", "robots.txt"]
WANTED = ["anti^spam", "spam^filter", "casino^royale", "poker^face", "sex^education", "adult^education", "adult^learning", "adult^literacy"]
PATTERN_RULES = [
    *(Rule(f"^{w}^", "block") for w in UNWANTED),
    *(Rule(f"^{a}^{b}^", "block") for a in FIRST for b in SECOND),
    *(Rule(f"^{p.replace('-', '^')}^", "block") for p in PAIRS),
    *(Rule(f"||{w}.*/", "block") for w in AD_LABELS),
    *(Rule(f"/{p}|", "block") for p in NO_PAGES),
    *(Rule(f"^{a}*^redirect^*^{b}^", "block") for a in ("affiliate", "partner", "campaign") for b in ("click", "offer", "landing")),
    *(Rule(f"@@^{w}^", "allow") for w in WANTED),
]


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_TO_LOWER), m[2]


def token_counts(urls: DataFrame, url: str, tokens: set[str]) -> dict[str, int]:
    """How many urls' host and path have each of the rules' tokens; one row per token comes back."""
    if not tokens:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.col(url), _UPPER, _LOWER), F.lit("([a-z0-9]+)"), 1))
    found: Column = F.array_intersect(words, F.array(*[F.lit(t) for t in sorted(tokens)]))
    return {r.token: r["count"] for r in urls.select(F.explode(found).alias("token")).groupBy("token").count().collect()}


def rarest_token_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(token -> numbers of the rules, numbers of the rules without a key)."""
    index: dict[str, list[int]] = defaultdict(list)
    always = []
    for i, rule in enumerate(rules):
        keys = rule.keys()
        if keys:
            index[min(keys, key=lambda k: (counts.get(k, 0), k))].append(i)
        else:
            always.append(i)
    return dict(index), always


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """Per row: id, host, path, the deciding host rule (else null), the verdict, the pattern rule that decides (or would), and the number of rules tried."""
    rules = [*HOST_RULES, *PATTERN_RULES] if rules is None else rules
    counts = token_counts(pages, url, {k for r in rules for k in r.keys()})
    index, always = rarest_token_index(rules, counts)

    def make() -> Callable[[str], tuple]:
        compiled = [re.compile(r.regex(), re.DOTALL) for r in rules]

        def fn(text: str) -> tuple:
            host, path = host_and_path(text)
            if not host and not path:
                return host, path, None, "allow", None, 0
            # host rules compare the path as it is; keys and patterns are lower-case
            exact, lowered = host + path, host + path.translate(_TO_LOWER)
            tried = sorted({i for t in _TOKEN.findall(lowered) for i in index.get(t, ())}.union(always))
            fits = [rules[i] for i in tried if compiled[i].search(exact if rules[i].is_host else lowered)]
            hosts = sorted((r for r in fits if r.is_host), key=lambda r: (-len(r.text), r.text))
            patterns = sorted((r for r in fits if not r.is_host), key=lambda r: not r.text.startswith("@@"))  # exceptions come first
            verdict = hosts[0].verdict if hosts else patterns[0].verdict if patterns else "allow"
            return host, path, hosts[0].text if hosts else None, verdict, patterns[0].text if patterns else None, len(tried)

        return fn

    fields = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "pattern")] + [T.StructField("n_tried", T.LongType())]
    return per_text(pages, [page_id], url, fields, make)
