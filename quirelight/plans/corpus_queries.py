"""All registered queries of the corpus operators, their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import search, text
from ..operators import windows
from ..sources.shared import Scratch
from . import joined, relational, streamed, textual  # noqa: F401
from .registry import QUERIES, SQL, query
from .registry import table as t

__all__ = ["QUERIES", "SQL", "keyword_search"]

_WORDS = r"regexp_split_to_array(lower(clean), '[^\p{L}\p{N}]+')"


@query(rf"""WITH c AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS clean FROM documents),
h AS (SELECT doc_id, source, quality, clean FROM c LEFT JOIN labels USING (doc_id) WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'with')),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY source) AS group_size FROM h),
f AS (SELECT *, trim(regexp_replace(clean, '\s+', ' ', 'g')) AS flat FROM r WHERE rank <= 3),
s AS (SELECT *, greatest(0, least(strpos(lower(flat), 'with') - 48, greatest(length(flat) - 140, 0))) AS start FROM f),
w AS (SELECT *, CASE WHEN start > 0 THEN regexp_replace(substr(flat, start + 1, 140), '^[^ ]* ', '') ELSE substr(flat, 1, 140) END AS l, start + 140 < length(flat) AS more FROM s)
SELECT source, doc_id, quality, rank, group_size, CASE WHEN start > 0 THEN '…' ELSE '' END || CASE WHEN more THEN regexp_replace(l, ' [^ ]*$', '') ELSE l END || CASE WHEN more THEN '…' ELSE '' END AS snippet FROM w""")
def keyword_search(spark, sf):
    """Cleaned documents with both words, the first three of each source, with label, number of hits and a snippet."""
    hit = text.bound(text.clean_text(F.col("text")), lambda c: search.may_match(c, "the with", "plain") & search.condition(search.tokens(c), "the with", "plain"))
    hits = lambda df: df.withColumn("hit", F.explode(F.array(hit))).where("hit")  # noqa: E731  a generated column is computed once
    scratch, docs = Scratch(spark), t(spark, sf, "documents").select("doc_id", "source", "text")
    found = scratch.keep(hits(docs).select("doc_id", "source"))  # the one pass over all texts; sizes and ranks come from ids alone
    first = windows.top_n_per_group(found, ["source"], ["doc_id"], 3)
    wanted = first.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), "group_size").distinct()
    # ids may repeat or be missing: of the rows that bear a wanted one, the hits are ranked again
    again = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")))
    ranked = hits(again).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("rank") <= 3)
    shown = ranked.select("source", "doc_id", "rank", F.col("group_size"), text.clean_text(F.col("text")).alias("clean"))
    labelled = shown.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = scratch.keep(labelled.select("source", "doc_id", "quality", "rank", "group_size", text.snippet(F.col("clean"), "with").alias("snippet")))
    scratch.drop(found)
    return out
