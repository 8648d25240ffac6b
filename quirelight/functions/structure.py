"""Structure of texts: references, aliases, entities, paragraphs, verse lines and markers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, bound, clean_text, flat, fold, is_ascii, trim_all

# The forms of a reference, in the order in which they are tried, after white space is collapsed. Groups: book, chapter, first verse, last verse.
# The fifth is compact: its book is an alias without blanks. The last is a whole chapter.
REF_PATTERNS = [
    r"(?iu)^(.+?)\s+(\d+)\s+(?:vers|vs\.?|v\.?)\s*(\d+)(?:\s*(?:tot(?:\s+en\s+met)?|[-–]|t/m)\s*(\d+))?$",
    r"(?iu)^(.+?)\s+(\d+)\s+(\d+)\s+(?:tot(?:\s+en\s+met)?|t/m)\s+(\d+)$",
    r"(?iu)^(.+?)\s+(\d+)\s*[:.,]\s*(\d+)(?:\s*[-–]\s*(\d+))?$",
    r"(?iu)^(.+?)\s+(\d+)\s+(\d+)$",
    r"(?iu)^(\d?\s*[a-zA-ZëüïéàÀ]+)\.?\s*(\d+)\s*[:.,]\s*(\d+)(?:\s*[-–]\s*(\d+))?$",
    r"(?iu)^(.+?)\s+(\d+)$",
]
_COMPACT, _CHAPTER, _NO_LAST = 4, 5, (3, 5)


def load_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Ordered pairs as rows (ord, alias, name)."""
    return spark.createDataFrame([(i, a, n) for i, (a, n) in enumerate(rules)], "ord int, alias string, name string")


def alias_keys(aliases: DataFrame) -> DataFrame:
    """(key, tier, name, own): the best name of each key, and that of the aliases alone. Tier 1 canonical names, 2 aliases without blanks, 3 aliases, 4 prefixes of two characters or more."""
    low = aliases.select("ord", "name", F.lower("alias").alias("a"))
    tiers = (
        low.select(F.lower("name").alias("key"), F.lit(1).alias("tier"), "ord", "name")
        .union(low.select(F.replace("a", F.lit(" "), F.lit("")), F.lit(2), "ord", "name"))
        .union(low.select("a", F.lit(3), "ord", "name"))
        .union(low.where(F.length("a") >= 2).select(F.explode(F.transform(F.sequence(F.lit(2), F.length("a")), lambda n: F.substring("a", F.lit(1), n))), F.lit(4), "ord", "name"))
    )
    found = F.struct("tier", "ord", "name")
    best = tiers.groupBy("key").agg(F.min(found).alias("b"), F.min(F.when(F.col("tier").isin(2, 3), found)).alias("x"))
    return best.select("key", F.col("b.tier").alias("tier"), F.col("b.name").alias("name"), F.col("x.name").alias("own"))


def _named(keys: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """(key, name) of the distinct keys that resolve."""
    wanted = F.lower(trim_all(F.col(key)))
    ids = keys.distinct().select(key, F.explode(F.array_distinct(F.array(wanted, F.regexp_replace(wanted, SPACE + "+", "")))).alias("__key"))
    found = ids.join(alias_keys(aliases).withColumnRenamed("key", "__key"), "__key").where("name is not null")
    return found.groupBy(key).agg(F.min_by("name", F.struct("tier", "name")).alias("name"))


def resolve_alias(df: DataFrame, key: str, aliases: DataFrame, out: str = "name") -> DataFrame:
    """df with the canonical name of its key, or null. One equi-join: prefixes are rows of the alias table."""
    found = _named(df.select(key), key, aliases).select(F.col(key).alias("__k"), F.col("name").alias(out))
    return df.join(found, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")


def reference_candidates(text: str) -> str:
    """SQL: an array of structs (n, exact, key, chapter, start, end), one or two for each form n that the SQL expression `text` has; a form is matched once and taken apart once."""
    forms = []
    for n, pattern in enumerate(REF_PATTERNS):
        parts = "$2 1 999 $1" if n == _CHAPTER else "$2 $3 $3 $1" if n in _NO_LAST else "$2 $3 $4 $1"  # numbers have no blanks; the book, which may, comes last
        keys = "transform(array(lower(btrim(g[3]))), k -> array_distinct(array(k, replace(k, ' ', ''))))[0]"
        row = f"named_struct('n', {n}, 'exact', {n == _COMPACT}, 'key', k, 'chapter', try_cast(g[0] AS INT), 'start', try_cast(g[1] AS INT), 'end', try_cast(coalesce(nullif(g[2], ''), g[1]) AS INT))"
        taken = f"transform(array(split(regexp_replace(t, r'{pattern}', '{parts}'), ' ', 4)), g -> transform({keys}, k -> {row}))[0]"
        forms.append(f"CASE WHEN t RLIKE r'{pattern}' THEN {taken} END")
    return f"transform(array(btrim(regexp_replace({text}, r'{SPACE}+', ' '))), t -> flatten(filter(array({', '.join(forms)}), x -> x IS NOT NULL)))[0]"


def parse_refs(df: DataFrame, text: str, aliases: DataFrame, out: str = "ref") -> DataFrame:
    """df with a struct (book, chapter, start, end) of its free-text reference, or null.

    A pattern whose book does not resolve falls through to the next. Compact references need an alias, not a name or the beginning of one.
    """
    texts = df.select(text).where(F.col(text).rlike("[0-9]")).distinct()  # every form has a number
    found = texts.select(text, F.explode(F.expr(reference_candidates(f"`{text}`"))).alias("c"))
    keys = alias_keys(aliases).select(F.col("key").alias("__key"), "tier", "name", "own")
    named = found.join(keys, F.col("c.key") == F.col("__key")).withColumn("book", F.when(F.col("c.exact"), F.col("own")).otherwise(F.col("name"))).where("book is not null")
    best = named.groupBy(F.col(text).alias("__t")).agg(F.min_by(F.struct("book", "c.chapter", "c.start", "c.end"), F.struct("c.n", "tier", "book")).alias(out))
    return df.join(best, F.col(text).eqNullSafe(F.col("__t")), "left").drop("__t")


def complete(prefixes: DataFrame, prefix: str, names: DataFrame, aliases: DataFrame, n: int = 7) -> DataFrame:
    """(prefix, value, place): names, then aliases' names, that begin with the prefix; none once it looks like a whole reference. names: (name, ord)."""
    typed = prefixes.select(prefix).distinct().where(~F.col(prefix).rlike(r"[0-9]+\s*[:.,]\s*[0-9]+|(?i:\s+[0-9]+\s+(?:vers|v)\s)") & (F.length(F.trim(prefix)) > 0))
    keys = names.select("name", "ord", F.lower("name").alias("k"), F.lit(0).alias("kind")).union(aliases.select("name", "ord", F.lower("alias"), F.lit(1)))
    grams = keys.select("name", "ord", "kind", F.explode(F.transform(F.sequence(F.lit(1), F.length("k")), lambda i: F.substring("k", F.lit(1), i))).alias("__k"))
    asked = typed.select(prefix, F.lower(F.trim(prefix)).alias("__k"))
    found = grams.join(asked.select("__k").distinct(), "__k", "left_semi").groupBy("__k", "name").agg(F.min(F.struct("kind", "ord")).alias("o"))
    # ranks are cut in each task before rows move: at most n a prefix and task
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("__k").orderBy("o", "name"))).where(F.col("nth") <= n)
    return asked.join(best, "__k").select(prefix, (F.col("nth") - 1).alias("place"), F.col("name").alias("value"))


def entity_keys(entities: DataFrame) -> DataFrame:
    """(key, ord, id, name) of entities (id, name, ord): folded full name, last word of three letters or more, last two words; the first entity wins a key."""
    folded = entities.select("id", "name", "ord", F.filter(F.split(fold(F.col("name")), r"\s+"), lambda x: x != "").alias("w"))  # once: its keys name it five times
    last = F.element_at(F.concat(F.array(F.lit("")), F.filter("w", lambda x: F.length(x) >= 3)), -1)
    two = F.when(F.size("w") >= 2, F.concat_ws(" ", F.try_element_at("w", F.lit(-2)), F.try_element_at("w", F.lit(-1))))
    keys = folded.select("id", "name", "ord", F.explode(F.array(F.array_join("w", " "), last, two)).alias("key")).where("key is not null and length(key) >= 3")
    return keys.groupBy("key").agg(F.min(F.struct("ord", "id", "name")).alias("e")).select("key", "e.*")


def extract_entities(queries: DataFrame, query_id: str, text: str, entities: DataFrame) -> DataFrame:
    """(query_id, ids, names, rest): entities mentioned, two-word keys before single words, each word used once; and the words left. query_id must tell rows apart.

    Of a run of pairs that overlap, every other one is taken, from the first; a single word is taken where no taken pair has it. Both are seen from the last pair before, so that time follows the number of hits.
    """
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda x: x != "")
    folded = lambda x: F.when(is_ascii(x), F.lower(x)).otherwise(fold(x))
    f = F.when(is_ascii(F.col(text)), words(F.lower(text))).otherwise(F.transform(words(F.col(text)), folded))
    nexts = F.arrays_zip(F.col("f").alias("one"), F.slice("f", F.lit(2), F.size("f")).alias("next"))
    # outer: no filter is inferred that would lay the words out twice
    each = queries.select(query_id, f.alias("f")).select(query_id, F.posexplode_outer(nexts).alias("pos", "f"))
    two = F.when(F.col("f.next").isNotNull(), F.concat_ws(" ", "f.one", "f.next"))
    grams = each.select(query_id, "pos", F.explode(F.array(F.struct(F.lit(-2).alias("n"), two.alias("key")), F.struct(F.lit(-1).alias("n"), F.col("f.one").alias("key")))).alias("g")).select(query_id, "pos", "g.*")
    hits = grams.where(F.length("key") >= 3).join(entity_keys(entities), "key").select(query_id, "pos", "n", "id", "name")

    at, is_pair = F.col("pos"), F.col("n") == -2
    order = Window.partitionBy(query_id).orderBy("pos", "n")
    last = lambda c, to: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, to))
    before = last(F.when(is_pair, at), -1)
    begun = hits.withColumn("start", F.when(is_pair & (before.isNull() | (before < at - 1)), at))
    seen = begun.withColumn("start", last(F.col("start"), 0)).withColumn("pair", last(F.when(is_pair, at), 0))
    took = (F.col("pair") - F.col("start")) % 2 == 0  # of the last pair; if it isn't taken, the one before it is, and has its first word
    covered = (F.col("pair") == at) | ((F.col("pair") == at - 1) & took)
    taken = seen.where(F.when(is_pair, took).otherwise(~F.coalesce(covered, F.lit(False))))
    first = F.row_number().over(Window.partitionBy(query_id, "id").orderBy("n", "pos", "name")) == 1
    found = F.when(F.col("first") & F.col("id").isNotNull(), F.struct("n", "pos", F.col("id").cast("string").alias("id"), "name"))
    picked = taken.withColumn("first", first).groupBy(F.col(query_id).alias("__q")).agg(
        F.sort_array(F.collect_list(found)).alias("h"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence(at, at - F.col("n") - 1))))).alias("used")
    )

    out = queries.select(query_id, text).join(picked, F.col(query_id) == F.col("__q"), "left")
    used = F.coalesce("used", F.array().cast("array<int>"))
    past = lambda j: F.coalesce(F.get(used, j - 1), F.lit(-1)) + 1
    between = lambda w: lambda j: F.slice(w, past(j) + 1, F.greatest(F.coalesce(F.get(used, j), F.size(w)) - past(j), F.lit(0)))
    rest = bound(words(F.col(text)), lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.size(used)), between(w))))
    some = lambda field: F.coalesce(F.transform("h", lambda x: x[field]), F.array().cast("array<string>"))
    return out.select(query_id, some("id").alias("ids"), some("name").alias("names"), F.array_join(rest, " ").alias("rest"))


def drop_entity(query: Column, name: Column) -> Column:
    """The query without the name's words."""
    gone = F.split(fold(name), r"\s+")
    return F.array_join(F.filter(F.split(query, r"\s+"), lambda w: ~F.array_contains(gone, fold(w))), " ")


def paragraph_array(text: Column) -> Column:
    """Blocks between blank lines; without any, lines; without those, pieces of at most 500 characters if there are 600."""
    some = lambda a: F.filter(F.transform(a, lambda p: trim_all(p)), lambda p: p != "")
    pieces = lambda t: some(F.regexp_extract_all(t, F.lit(r"(?s).{249,499}[.!?](?=\s|$)|.{1,500}"), F.lit(0)))
    short = lambda t: F.when(F.length(t) >= 600, pieces(t)).otherwise(some(F.array(t)))
    several = lambda a, otherwise: bound(a, lambda x: F.when(F.size(x) > 1, x).otherwise(otherwise))
    lines = lambda t: several(some(F.split(t, "\n")), short(t))
    return bound(trim_all(text), lambda t: F.when(F.contains(t, F.lit("\n")), several(some(F.split(t, r"\n[ \t]*\n\s*")), lines(t))).otherwise(short(t)))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(paragraph_array(F.col(text))).alias("pos", "para"))


def merge_dropcaps(paras: Column) -> Column:
    """A paragraph of one to three letters joined to a following one that begins in lower case."""
    lone = lambda x: x.rlike(r"^\p{L}{1,3}$")
    small = lambda x: x.rlike(r"^\p{Ll}")

    def marked(a: Column) -> Column:
        return F.transform(a, lambda x, i: F.struct(x.alias("x"), F.coalesce((i > 0) & lone(F.get(a, i - 1)) & small(x), F.lit(False)).alias("joins"), i.alias("i")))

    def step(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(lone(last), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, m["x"])))).otherwise(F.concat(acc, F.array(m["x"])))

    # only runs of such short paragraphs are folded, whose last one may be long; everything else is copied once
    def merged(ms: Column) -> Column:
        starts = F.filter(ms, lambda m: ~m["joins"])
        stop = lambda k: F.coalesce(F.get(starts, k + 1)["i"], F.size(ms))
        run = lambda m, k: F.aggregate(F.slice(ms, m["i"] + 2, stop(k) - m["i"] - 1), F.array(m["x"]), step)
        return F.flatten(F.transform(starts, lambda m, k: F.when(stop(k) == m["i"] + 1, F.array(m["x"])).otherwise(run(m, k))))

    return bound(bound(paras, marked), merged)


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, number, line) of texts such as "1 Text. 2 Text."; a text with one number only is one line, with the number as its label."""
    parts = F.split(trim_all(F.col(text)), r"(?<=[.!?;:])\s+(?=\d+\s)")
    rows = df.select(key, F.posexplode(parts).alias("pos", "part"))
    number = F.regexp_extract("part", r"^(\d+)\s", 1).try_cast("int")
    return rows.select(key, "pos", number.alias("number"), F.regexp_replace("part", r"^\d+\s+", "").alias("line"))


def extract_range(text: Column, s: Column, e: Column, least: int = 40) -> Column:
    """The lines of a commentary that belong to verses s to e, with what stands before the first heading.

    Headings: "Vs. a", "Vs. a-b" or "n." at a line's start. If less than `least` characters remain, the whole text.
    """
    heading = r"^\s*(?:[Vv]s\.\s*(\d+)(?:\s*[-–]\s*(\d+))?|(\d+)\.)"
    g = lambda line, i: F.nullif(F.regexp_extract(line, heading, i), F.lit("")).try_cast("int")

    # sections: where each heading stands, and its verses; -1 for what stands before the first
    def head(line: Column, at: Column) -> Column:
        lo = F.coalesce(g(line, 1), g(line, 3))
        return F.when(line.rlike(heading), F.struct(at.alias("at"), lo.alias("lo"), F.coalesce(g(line, 2), lo).alias("hi")))

    def cut(lines: Column) -> Column:
        heads = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))), F.filter(F.transform(lines, head), lambda h: h.isNotNull()))
        return bound(heads, lambda h: kept(lines, h))

    def kept(lines: Column, heads: Column) -> Column:
        stop = F.coalesce(F.array_min(F.filter(F.transform(heads, lambda h, i: F.when(h["lo"] > e, i)), lambda i: i.isNotNull())), F.size(heads))
        ends = lambda i: F.coalesce(F.get(heads, i + 1)["at"], F.size(lines))
        section = lambda h, i: F.when((i < stop) & (h["lo"].isNull() | ((h["lo"] >= s) & (h["hi"] <= e))), F.slice(lines, h["at"] + 1, ends(i) - h["at"]))
        return F.array_join(F.flatten(F.filter(F.transform(heads, section), lambda x: x.isNotNull())), "\n")

    out = trim_all(bound(F.split(text, "\n"), cut))
    return bound(F.struct(text.alias("whole"), out.alias("cut")), lambda c: F.when(F.length(c["cut"]) >= least, c["cut"]).otherwise(c["whole"]))


# Title words at the beginning of a text, what ends its quoted block, and the letters and delimiters of markers.
TITLE = r"\A[^\S\n]*(?:[0-9]+\.\s+)?(?i:LEERREDE|PREDIKATIE|PREDICATIE|PREEK|VERKLARING|OVERDENKING)\b[^\n]*"
CAPITAL_LINES = r"(?:\n[^a-z\n]*[A-Z][^a-z\n]*(?=\n|\z)){0,3}"
QUOTE_WORD = "tekst:"
QUESTION = r"^[0-9]+\.\s+(?:Vraag|Antwoord)\b"
MARKERS, DELIMITERS = "abcdefghijklmnopqrstuvwxyz", ",;:."


def split_sections(text: Column) -> Column:
    """struct(title, quote, body) of a cleaned text.

    The title is a first line with a title word at its start, and up to three lines after it whose Latin letters are capitals; the quote are the lines after a line
    "Tekst:", up to a blank line or a numbered question; the body is the rest. Without a title or quote, these are null.
    """
    blank = lambda x: trim_all(x) == ""

    def parts(t: Column) -> Column:
        title = F.regexp_extract(t, TITLE + CAPITAL_LINES, 0)
        rest = F.regexp_replace(F.substring(t, F.length(title) + 1, F.length(t)), rf"\A(?:{SPACE}*\n)?", "")
        return F.struct(F.nullif(trim_all(F.replace(title, F.lit("\n"), F.lit(" "))), F.lit("")).alias("title"), F.regexp_replace(rest, r"\A(?:[^\S\n]*\n)+", "").alias("rest"))

    def quoted(p: Column) -> Column:
        lines = F.split(p["rest"], "\n")
        has = F.lower(F.regexp_replace(F.get(lines, F.lit(0)), SPACE + "+", "")) == QUOTE_WORD
        stops = F.filter(F.transform(lines, lambda x, i: F.when((i > 0) & (blank(x) | trim_all(x).rlike(QUESTION)), i)), lambda i: i.isNotNull())
        stop = F.when(has, F.coalesce(F.array_min(stops), F.size(lines))).otherwise(0)
        return F.struct(p["title"].alias("title"), lines.alias("lines"), stop.alias("stop"))

    def whole(q: Column) -> Column:
        quote = F.when(q["stop"] > 0, F.nullif(trim_all(F.array_join(F.slice(q["lines"], F.lit(2), F.greatest(q["stop"] - 1, F.lit(0))), " ")), F.lit("")))
        body = trim_all(F.array_join(F.slice(q["lines"], q["stop"] + 1, F.greatest(F.size(q["lines"]) - q["stop"], F.lit(0))), "\n"))
        return F.struct(q["title"].alias("title"), quote.alias("quote"), body.alias("body"))

    return bound(bound(bound(clean_text(text), parts), quoted), whole)


def find_markers(text: str) -> list[dict]:
    """Letters a, b, c … in order, each between two delimiters or spaces, which must both exist; after three letters in a row are missing, no more."""
    found, at, missed = [], 0, 0
    for letter in MARKERS:
        m = re.compile(rf"(?<=[{DELIMITERS}]|{SPACE}){letter}(?=[{DELIMITERS}]|{SPACE})").search(text, at)
        if m:
            found.append({"marker": letter, "pos": m.start()})
            at, missed = m.end(), 0
        else:
            missed += 1
            if missed == 3:
                break
    return found


_MARKER = T.ArrayType(T.StructType([T.StructField("marker", T.StringType()), T.StructField("pos", T.IntegerType())]))


@F.pandas_udf(_MARKER)
def marker_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: find_markers(t or ""))


def plan_rows(plan: DataFrame, week: str, readings: str) -> DataFrame:
    """The nested plan (week, readings) as rows with day (from 1) and progress key "week-day"."""
    rows = plan.select(week, F.posexplode(readings).alias("__d", "reading"))
    return rows.select(week, (F.col("__d") + 1).alias("day"), F.concat_ws("-", F.col(week).cast("string"), (F.col("__d") + 1).cast("string")).alias("progress_key"), "reading.*")


def expand_counts(df: DataFrame, key: str, n: str, out: str = "number") -> DataFrame:
    """Rows 1..n for each key; none where n is not positive."""
    return df.where(F.col(n) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(n))).alias(out))


