"""Secret scan: fixed patterns, and zstandard novelty of strings in sensitive context.

Three patterns give the base spans (assign, access, hex). Besides them, every mixed run of letters, digits and +/_=- in sensitive context is a
candidate. Its novelty is what it adds to the compressed size of the
text around it, with a compressor primed by a dictionary of common identifiers: words, names and
strings like those around add little, random strings add nearly their whole length and are reported as
"novel". Other copies of the candidate itself are taken out of the surroundings; each distinct string of a text is measured
once, at its first place, and reported at every place in sensitive context. Runs are found once, from left to right, so that candidates never overlap and
the work is linear in the text.

Parameters of the method, all in code points but the last: a candidate has `shortest` or more; a sensitive word that begins before its end, and ends at most
`reach` before its start, puts it into context (so a candidate further behind the word is not in its context); `around` on either side are its surroundings; from
`novelty` marginal bytes per character on it is reported. Candidates that touch a base span are not reported twice.

Spans count code points, end exclusive, over the whole text. Defined cases: a null or empty text has
no spans; equal rows get equal rows; an empty table gives an empty result; only the id and the text
are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of 18 or more from its first AKIA on
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(r"passw|passphrase|secret|token|api[ _-]?key|credential|private[ _-]?key|access[ _-]?key|bearer|auth", re.IGNORECASE | re.ASCII)
_RUN = r"[A-Za-z0-9+/_=-]"
SHORTEST, REACH, AROUND, NOVELTY = 16, 48, 256, 0.55

# Identifiers and words that code and configuration files are full of.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key credential authorization bearer "
    "username client_id client_secret session_id request_id user_id account_id endpoint hostname localhost "
    "example placeholder changeme your_token_here your_api_key_here undefined default environment variable "
    "config configuration settings production development testing import export function return class const "
    "string integer boolean https http www com org net index version application service response request header "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(spans)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


class Novelty:
    """Marginal compressed bytes under a compressor primed with identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS, shortest: int = SHORTEST, reach: int = REACH, around: int = AROUND, novelty: float = NOVELTY):
        primer = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_dict_id=False)
        self.candidate = re.compile(f"{_RUN}{{{shortest},}}")
        self.reach, self.around, self.novelty = reach, around, novelty

    def marginal_bytes(self, before: str, candidate: str, after: str) -> int:
        size = lambda s: len(self.compressor.compress(s.encode("utf-8", "surrogatepass")))
        return size(before + after + candidate) - size(before + after)

    def is_random(self, text: str, s: int, e: int) -> bool:
        c, far = text[s:e], self.around + e - s
        before = text[max(0, s - far) : s].replace(c, "")[-self.around :]
        after = text[e : e + far].replace(c, "")[: self.around]
        return self.marginal_bytes(before, c, after) >= self.novelty * len(c)

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """base: in order of their starts."""
        words = [m.span() for m in _CONTEXT.finditer(text)]
        found, judged = [], {}
        w = b = 0
        word_end = base_end = -1 << 62  # of the words and base spans that begin before the candidate's end
        for m in self.candidate.finditer(text) if words else ():
            s, e = m.span()
            while w < len(words) and words[w][0] < e:
                word_end, w = max(word_end, words[w][1]), w + 1
            while b < len(base) and base[b][0] < e:
                base_end, b = max(base_end, base[b][1]), b + 1
            c = m.group()
            if word_end + self.reach < s or base_end > s or not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)):
                continue
            if c not in judged:
                judged[c] = self.is_random(text, s, e)
            if judged[c]:
                found.append((s, e, "novel"))
        return found


def all_spans(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    return base, in_order(base + novelty.spans(text, base))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: the id, base and all spans (arrays of start, end, kind), and the secrets' strings. options: the parameters of Novelty."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))

    def make() -> Callable[[str], tuple]:
        novelty = Novelty(**options)

        def fn(t: str) -> tuple:
            base, spans = all_spans(t, novelty)
            named = lambda xs: [{"start": s, "end": e, "kind": k} for s, e, k in xs]
            return named(base), named(spans), [t[s:e] for s, e, _ in spans]

        return fn

    fields = [T.StructField("base", span), T.StructField("spans", span), T.StructField("found", T.ArrayType(T.StringType()))]
    return per_text(docs, [doc_id], text, fields, make)


def span_digests(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as one string."""
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(doc_id, *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """text with each maximal run of overlapping spans replaced by mark."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted_column(text: str = "text", **options) -> Column:
    """The text without its secrets; null stays null."""

    @F.pandas_udf(T.StringType())
    def redacted(texts: pd.Series) -> pd.Series:
        novelty = Novelty(**options)
        return texts.map(lambda t: t if t is None else redact(t, all_spans(t, novelty)[1]), na_action="ignore")

    return redacted(F.col(text))
