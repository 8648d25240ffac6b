"""Text columns: folding, cutting, cleaning and formatting, all in built-in functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: White space as browsers understand it, and as a class of literal characters: Java's \\s and RE2's lack some of them.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
Rule = tuple[str, str]


def trim_all(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def flat(col: Column) -> Column:
    """col trimmed, with each run of white space as one blank."""
    return trim_all(bound(col, lambda c: F.when(is_ascii(c), F.regexp_replace(c, r"\s+", " ")).otherwise(F.regexp_replace(c, f"{SPACE}+", " "))))


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What letters of the basic plane, in lower case, are when they are taken apart (NFD) and lose the marks U+0300 to U+036F: those that become one letter, and those that become several."""
    one, several = {}, {}
    for point in (*range(0xD800), *range(0xE000, 0x10000)):
        low = chr(point).lower()
        plain = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", chr(point))).lower()
        if len(low) == 1 and plain not in ("", low) and not "\uac00" <= low <= "\ud7a3":
            (one if len(plain) == 1 else several)[low] = plain
    return one, several


_ONE, _SEVERAL = _folds()


def _hangul(c: Column) -> Column:
    """A Hangul syllable as its two or three parts, by the rule of its code point."""
    n = F.ascii(c) - 0xAC00
    part = lambda point: F.decode(F.unhex(F.hex(point)), "UTF-16BE")
    last = F.when(n % 28 > 0, part(F.lit(0x11A7) + n % 28)).otherwise("")
    return F.concat(part(F.floor(n / 588) + 0x1100), part(F.floor(n % 588 / 28) + 0x1161), last)


def fold(col: Column) -> Column:
    """Lower case without combining marks, for all letters of the basic plane: as NFD without U+0300 to U+036F has it.

    Most letters are replaced by a table made from Unicode's own data. Those that become several are looked up letter by letter, in texts that have any.
    """
    several = F.map_from_arrays(F.array(*map(F.lit, _SEVERAL)), F.array(*map(F.lit, _SEVERAL.values())))
    each = lambda c: F.when(c.between("\uac00", "\ud7a3"), _hangul(c)).otherwise(F.coalesce(F.try_element_at(several, c), c))
    apart = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), each), "")
    rare = "[\uac00-\ud7a3" + "".join(_SEVERAL) + "]"
    plain = F.translate(F.regexp_replace(F.lower(col), "[̀-ͯ]", ""), "".join(_ONE), "".join(_ONE.values()))
    return bound(plain, lambda t: F.when(is_ascii(t) | ~t.rlike(rare), t).otherwise(apart(t)))


def truncate_words(col: Column, n: int) -> Column:
    """At most n characters, cut at the last blank within n + 1, else at n; an ellipsis where something is cut."""
    head = F.substring(col, 1, n + 1)
    at_blank = F.regexp_extract(head, "(?s)^(.+) [^ ]*$", 1)
    cut = F.when(at_blank != "", at_blank).otherwise(F.substring(col, 1, n))
    return F.when(F.length(col) <= n, col).otherwise(F.concat(cut, F.lit("…")))


def snippet(col: Column, needle: str, width: int = 140) -> Column:
    """About `width` characters around the first hit of the needle, in any case; without a hit, of the beginning."""
    spare = max(0, width - len(needle))

    def cut(flat: Column) -> Column:
        at = F.locate(needle.lower(), F.lower(flat)) - 1
        latest = F.greatest(F.length(flat) - width, F.lit(0))
        start = F.when(at < 0, 0).otherwise(F.greatest(F.lit(0), F.least(at - int(spare * 0.35), latest)))
        return F.struct(start.alias("start"), F.substring(flat, start + 1, F.lit(width)).alias("window"), (start + width < F.length(flat)).alias("more"))

    def shown(c: Column) -> Column:
        left = F.when(c["start"] > 0, F.regexp_replace(c["window"], "^[^ ]* ", "")).otherwise(c["window"])
        right = F.when(c["more"], F.regexp_replace(left, " [^ ]*$", "")).otherwise(left)
        return F.concat(F.when(c["start"] > 0, "…").otherwise(""), right, F.when(c["more"], "…").otherwise(""))

    return bound(bound(flat(col), cut), shown)


def apply_rules(col: Column, rules: list[Rule]) -> Column:
    """Ordered (pattern, replacement) rules, one after another."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), map(_looking_back, rules), col)


def _looking_back(rule: Rule) -> Rule:
    """A rule `(^|[^...])words(...)` that puts the first group back, as one that finds its words first and then looks at what is before them: the same results, and most characters are tried once.

    What the match before has taken is no start, as in the rule itself; the first group stays, empty.
    """
    m = re.fullmatch(r"\(\^\|(\[\^[^]\[\\&^]+\])\)((?:\[[^]\[\\&^]+\]|[A-Za-z ])+)([^\\]*)", rule[0])
    if not m or re.match(r"[*+?{|]", m[3]) or "|" in re.sub(r"\([^()]*\)", "", m[3]) or not re.match(r"\$1(?![0-9])", rule[1]) or "$1" in rule[1][2:]:
        return rule
    return rf"(?={m[2]})(?:^|(?<={m[1]})(?!\G))(){m[2]}{m[3]}", rule[1]


def bound(col: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(col), with col evaluated once however often fn names it."""
    return F.transform(F.array(col), fn)[0]


def where_has(col: Column, needles: tuple[str, ...], rules: list[Rule]) -> Column:
    """The rules, where the text in lower case has any of the needles, one of which every match of theirs has."""
    low = lambda c: F.lower(c) if any(n != n.upper() for n in needles) else c
    has = lambda c: reduce(Column.__or__, [F.contains(low(c), F.lit(n)) for n in needles])
    return bound(col, lambda c: F.when(has(c), apply_rules(c, rules)).otherwise(c))


# Debris that web and OCR texts carry. All rules replace every match.
LINK_MARK: list[Rule] = [("\U0001f517\ufe0f?", "")]
TOP_LINKS: list[Rule] = [
    (rf"(?i)Return{SPACE}+to{SPACE}+top{SPACE}+of{SPACE}+page{SPACE}*", ""),
    (rf"(?i)Back{SPACE}+to{SPACE}+top{SPACE}*", ""),
    (rf"(?i)Top{SPACE}+of{SPACE}+page{SPACE}*", ""),
]
PAGE_MARKS: list[Rule] = [(rf"(?im)(^|{SPACE})Pagina{SPACE}+[0-9]+{SPACE}+van{SPACE}+[0-9]+{SPACE}*", "$1")]
SPLIT_PARENTHESES: list[Rule] = [(rf"\({SPACE}*\n{SPACE}*([^()\n]{{1,60}}?){SPACE}*\n", "($1)\n")]
SCRIPTS: list[Rule] = [
    ("([\u0590-\u05ff\u0370-\u03ff])([A-Za-z])", "$1 $2"),
    ("([A-Za-z])([\u0590-\u05ff\u0370-\u03ff])", "$1 $2"),
]
TRAILING_BLANKS: list[Rule] = [(r"[ \t]+\n", "\n")]
BLANK_LINES: list[Rule] = [(r"\n{3,}", "\n\n")]
DEBRIS = LINK_MARK + TOP_LINKS + PAGE_MARKS + SPLIT_PARENTHESES + SCRIPTS + TRAILING_BLANKS + BLANK_LINES
# Front matter. The first two go once, up to their own end; a legend ends before a line that begins with a capital and a small letter.
LEGEND = rf"Legenda{SPACE}+Blauw[\s\S]*?"
COLOPHONS = (
    r"(?:DE GROOT GOUDRIAAN[\s\S]*?(?:NUR [0-9]+)"
    r"|Ongewijzigde fotografische herdruk[\s\S]*?(?:NUR [0-9]+)"
    r"|Uit het Latijn vertaald[\s\S]*?(?:NUR [0-9]+))\n*"
)
FRONT_LINKS: list[Rule] = [(f"\U0001f517\ufe0f?{SPACE}*", "")]
FRONT_TOPS: list[Rule] = [(rf"(?i)Return{SPACE}+to{SPACE}+top{SPACE}+of{SPACE}+page", "")]
# Marks within a paragraph; the first is the whole paragraph.
PARAGRAPH_MARKS: list[Rule] = [
    (rf"(?i)^Pagina{SPACE}+[0-9]+{SPACE}+van{SPACE}+[0-9]+{SPACE}*$", ""),
    (rf"(?i)(^|{SPACE})Pagina{SPACE}+[0-9]+{SPACE}+van{SPACE}+[0-9]+(?={SPACE}|$)", "$1"),
]
CORRECTIONS: dict[str, Rule] = {
    "hyphens": (r"(\p{L})-\n(\p{L})", "$1$2"),
    "spaces": (r"[ \t]{2,}", " "),
    "punctuation": (r" +([,.;:!?])", "$1"),
    "blank_lines": (r"\n{3,}", "\n\n"),
}


def _spaced_scripts(col: Column) -> Column:
    return bound(col, lambda c: F.when(is_ascii(c), c).otherwise(apply_rules(c, SCRIPTS)))


def clean_text(col: Column) -> Column:
    """Without link marks, top links, page marks, parentheses split over lines, trailing blanks and runs of blank lines; DEBRIS in its order."""
    out = where_has(where_has(where_has(col, ("\U0001f517",), LINK_MARK), ("top",), TOP_LINKS), ("pagina",), PAGE_MARKS)
    out = _spaced_scripts(where_has(out, ("(",), SPLIT_PARENTHESES))
    return trim_all(where_has(where_has(out, (" \n", "\t\n"), TRAILING_BLANKS), ("\n\n\n",), BLANK_LINES))


def strip_front_matter(col: Column) -> Column:
    """Without the first legend, the first colophon, page marks, link marks and top links."""
    out = where_has(col, ("legenda",), [(rf"(?s)\A(.*?)(?m:^){LEGEND}(?=\n[A-Z][a-z])", "$1")])
    out = where_has(out, ("nur ",), [(rf"(?s)\A(.*?)(?m:^)(?i:{COLOPHONS})", "$1")])
    return trim_all(where_has(where_has(where_has(out, ("pagina",), PAGE_MARKS), ("\U0001f517",), FRONT_LINKS), ("top",), FRONT_TOPS))


def clean_paragraph(col: Column) -> Column:
    """Without link marks, top links and page marks; script borders spaced."""
    out = where_has(where_has(where_has(col, ("\U0001f517",), LINK_MARK), ("top",), FRONT_TOPS), ("pagina",), PARAGRAPH_MARKS)
    return trim_all(_spaced_scripts(out))


def map_value(col: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def format_ref(book: Column, chapter: Column, start: Column, end: Column) -> Column:
    """"Book c" for a whole chapter, else "Book c:v" or "Book c:v–w"."""
    base = F.concat(book, F.lit(" "), chapter.cast("string"))
    verses = F.concat(base, F.lit(":"), start.cast("string"), F.when(end > start, F.concat(F.lit("–"), end.cast("string"))).otherwise(""))
    return F.when((start == 1) & (end >= 999), base).otherwise(verses)


def shift_ref(chapter: Column, start: Column, end: Column, forward: bool) -> tuple[Column, Column, Column]:
    """(chapter, start, end) of the window of equal length after, or before.

    Before verse 1 comes the end of the chapter before, written as verse 999; chapter 1 stays as it is.
    """
    n = end - start + 1
    if forward:
        return chapter, end + 1, end + n
    inside, first = start > 1, chapter <= 1
    lo = F.greatest(start - n, F.lit(1))
    back = lambda a, b, c: F.when(inside, a).when(first, b).otherwise(c)
    return back(chapter, chapter, chapter - 1), back(lo, start, F.lit(999)), back(start - 1, end, F.lit(999))


def lifespan(born: Column, died: Column) -> Column:
    year = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(year(born), F.lit("–"), year(died))


def norm_title(col: Column) -> Column:
    """Without a leading number; all capitals (over 5) in title case; index titles marked as references."""
    t = trim_all(F.regexp_replace(col, r"^\s*\d+[.)]?\s+", ""))
    t = F.when((F.length(t) > 5) & (t == F.upper(t)) & (t != F.lower(t)), F.initcap(F.lower(t))).otherwise(t)
    return F.when(t.rlike("(?i)^index of .+"), F.concat(F.regexp_replace(t, "(?i)^index of ", ""), F.lit(" (verwijzingen)"))).otherwise(t)


def is_ugly_title(col: Column, strict: bool = False) -> Column:
    """Empty, a bare number, over 80 characters, or with mark-up; strict: also in capitals or under 4 characters."""
    t = F.coalesce(trim_all(col), F.lit(""))
    ugly = (t == "") | t.rlike(r"^[\d.\s]+$") | (F.length(t) > 80) | t.rlike("[<>{}|]")
    return ugly | (F.length(t) < 4) | ((t == F.upper(t)) & (t != F.lower(t))) if strict else ugly


def fallback_title(text: Column, ordinal: Column) -> Column:
    """"Hoofdstuk n" with a preview of at most 55 characters, cut at a blank after the 30th."""
    flat = trim_all(F.regexp_replace(text, f"{SPACE}+", " "))
    head = F.substring(flat, 1, 55)
    at_blank = F.regexp_extract(head, "^(.{30,}) [^ ]*$", 1)
    preview = F.when(F.length(flat) <= 55, flat).otherwise(F.concat(F.when(at_blank != "", at_blank).otherwise(head), F.lit("…")))
    return F.concat(F.lit("Hoofdstuk "), ordinal.cast("string"), F.when(preview != "", F.concat(F.lit(": "), preview)).otherwise(""))


def preview_rules(df: DataFrame, key: str, text: str, rule: Rule, label: str) -> DataFrame:
    """Rows that the rule changes, with the first 120 characters before and after."""
    after = apply_rules(F.col(text), [rule])
    changed = df.select(key, F.col(text).alias("before"), after.alias("after")).where("after <> before")
    return changed.select(key, F.lit(label).alias("rule"), F.substring("before", 1, 120).alias("before"), F.substring("after", 1, 120).alias("after"))


def apply_and_count(df: DataFrame, text: str, rule: Rule) -> tuple[DataFrame, Observation]:
    """df corrected, and an observation whose `changed` is known once df has been written; one pass."""
    seen = Observation()
    out = df.withColumn("__before", F.col(text)).withColumn(text, apply_rules(F.col(text), [rule]))
    return out.observe(seen, F.count_if(F.col("__before") != F.col(text)).alias("changed")).drop("__before"), seen


def replace_text(col: Column, find: str, repl: str, regex: bool = False) -> Column:
    """Every hit replaced; find is literal unless regex. An ill-formed pattern fails here, not in a task."""
    if not regex:
        return F.replace(col, F.lit(find), F.lit(repl))
    import re

    re.compile(find)
    return F.regexp_replace(col, F.lit(find), F.lit(repl))


def last_match(col: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(col, F.lit(pattern), F.lit(group)), F.lit(-1))


def plan_week(ts: Column) -> Column:
    """Weeks of seven days from 1 January, from 1 to 52."""
    seconds = F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.date_trunc("year", ts).cast("timestamp"))
    return F.greatest(F.lit(1), F.least(F.lit(52), F.ceil(seconds / F.lit(7 * 86400)))).cast("int")


def weekday0(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def format_number_nl(col: Column, decimals: int = 0) -> Column:
    """Points between thousands, a decimal comma."""
    return F.translate(F.format_number(col, decimals), ",.", ".,")


def format_date_nl(col: Column) -> Column:
    return F.date_format(col, "d-M-yyyy")


def parse_amount(col: Column, least: float = 1, most: float = 5000) -> Column:
    """A decimal-comma amount with two places, null unless it is a number within the bounds."""
    amount = F.replace(trim_all(col), F.lit(","), F.lit(".")).try_cast("decimal(10,2)")
    return F.when(amount.between(least, most), amount)


def map_status(col: Column) -> Column:
    return F.when(col.isNull(), "unknown").when(col == "paid", "paid").when(col.isin("open", "pending", "authorized"), "pending").otherwise("failed")


def decode_path(col: Column) -> Column:
    return F.replace(col, F.lit("~and~"), F.lit("&"))


def word_count(col: Column) -> Column:
    t = trim_all(col)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"{SPACE}+")))


def concat_notes(df: DataFrame, key: str, ts: str, text: str, sep: str = "\n---\n") -> DataFrame:
    """Each key's texts in time order, joined by the separator."""
    notes = F.sort_array(F.collect_list(F.struct(ts, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(notes, lambda x: x[text]), sep).alias("notes"))
