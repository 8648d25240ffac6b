"""Exact duplicates by an exchange of Golomb-coded fingerprints (after Sanders, Schlag and Müller, 2013).

Texts are compared without white space (`[\\x20\\x09-\\x0D]`). One pass writes the normalised texts where they are,
in chunks of at most 65,536 rows of one task, bucketed by chunk, which moves no row. After that:

- Every chunk sorts the distinct fingerprints of its texts, cut to log2(rows) + EXTRA_BITS bits, and sends
  each owner of a range of fingerprints the gaps between its own, Golomb-coded with a power of two as the parameter.
- An owner decodes all messages, and answers each with a bitmap: which of its fingerprints came from another chunk too.
- A chunk adds what occurs twice within itself, and holds the outcome as one bit per row. Only the texts whose bit
  is set are suspects; only they are shuffled, grouped by their bytes, with equal ones of a task put together before.
  A fingerprint that two different texts share therefore costs a shuffle of these two, and nothing else.

What moves for a text without a copy is its code of some four bytes, its place of two bytes, and its bits. An owner's share and a chunk are
bounded; copies of one text are one fingerprint per chunk, one text per task, and one candidate per chunk, so a hot group is small everywhere.
Groups get their names from SHA-256 of the bytes; the job stops if two texts that differ in bytes should bear one name.

Defined cases: null counts as the empty text; blank texts are all equal; of equal texts the row stays that has the most
code points in its original text, then the smallest doc_id (null last), and of rows that are alike in both too, exactly one. keep_id is null
where the row that stays has no doc_id. Rows that share a doc_id are rows of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_folder

EXTRA_BITS = 8  # a text without a copy is taken for a suspect with a probability of 2^-8 at most
OWNER_ROWS = 1 << 22  # fingerprints of one owner, about
_CHUNK_BITS = 16


def encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct numbers from 0 as gaps less one: quotients by 2^k in unary, then remainders of k bits."""
    gaps = np.diff(values, prepend=-1) - 1
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return np.packbits(np.concatenate([unary, rest.astype(np.uint8).ravel()])).tobytes()


def decode(code: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits[: len(bits) - n * k])[:n]
    start = int(ends[-1]) + 1 if n else 0
    rest = bits[start : start + n * k].reshape(n, k).astype(np.int64)
    gaps = ((np.diff(ends, prepend=-1) - 1) << k) + (rest << np.arange(k - 1, -1, -1)).sum(1)
    return np.cumsum(gaps + 1) - 1


def golomb_bits(values: int, among: int) -> int:
    """The parameter's exponent for so many of so many numbers: the mean gap times ln 2, rounded to a power of two."""
    return max(0, round(np.log2(max(1.0, among / max(1, values) * np.log(2)))))


def _send(bits: int, owner_bits: int):
    """Tasks' rows (row, f) to messages (chunk, base, owner, n, k, code; places, again: the rows that the fingerprints stand for)."""

    def message(chunk: int, rows: np.ndarray, f: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(f, kind="stable")
        f, places = f[order], (rows[order] & ((1 << _CHUNK_BITS) - 1)).astype(np.uint16)
        owner = f >> (bits - owner_bits)
        for o in np.unique(owner):
            lo, hi = np.searchsorted(owner, [o, o + 1])
            own = f[lo:hi] - (o << (bits - owner_bits))
            again = np.diff(own, prepend=-1) == 0
            k = golomb_bits(int((~again).sum()), 1 << (bits - owner_bits))
            yield chunk, int(rows[0]), int(o), int((~again).sum()), k, encode(own[~again], k), places[lo:hi].tobytes(), np.packbits(again).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows, f = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                columns = list(zip(*message(int(rows[0]) >> _CHUNK_BITS, rows, f), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SENT.types, strict=True)], schema=_SENT)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            rows = batch.column(0).to_numpy()
            f = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(rows >> _CHUNK_BITS)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if held and held[-1][0][-1] >> _CHUNK_BITS != rows[lo] >> _CHUNK_BITS:
                    yield from flush()
                if hi > lo:
                    held.append((rows[lo:hi], f[lo:hi]))
        yield from flush()

    return run


_SENT = pa.schema([("chunk", pa.int64()), ("base", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary()), ("places", pa.binary()), ("again", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("base", pa.int64()), ("owner", pa.int32()), ("twice", pa.binary())])
_MARKS = pa.schema([("chunk", pa.int64()), ("marks", pa.list_(pa.int64()))])


def answer(messages: pa.Table) -> pa.Table:
    """One owner: which fingerprints of each message stand in another message too."""
    coded = zip(*(messages[c].to_pylist() for c in ("code", "n", "k")), strict=True)
    each = [decode(c, n, k) for c, n, k in coded]
    values, where, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    twice = np.split((counts > 1)[where], np.cumsum([len(x) for x in each])[:-1])
    return pa.table([*(messages[c] for c in ("chunk", "base", "owner")), pa.array([np.packbits(t).tobytes() for t in twice], pa.binary())], schema=_REPLY)


def mark(sent: pa.Table, replies: pa.Table) -> pa.Table:
    """One chunk: a bit for each row that an owner or the chunk itself knows twice, in words of 64."""
    twice_by = {(b, o): t for b, o, t in zip(*(replies[c].to_pylist() for c in ("base", "owner", "twice")), strict=True)}
    bits = np.zeros(1 << _CHUNK_BITS, np.uint8)
    for base, owner, n, places, again in zip(*(sent[c].to_pylist() for c in ("base", "owner", "n", "places", "again")), strict=True):
        at = np.frombuffer(places, np.uint16)
        nth = np.cumsum(1 - np.unpackbits(np.frombuffer(again, np.uint8), count=len(at)).astype(np.int64)) - 1
        twice = np.unpackbits(np.frombuffer(twice_by[base, owner], np.uint8), count=n).astype(bool)
        bits[at] = twice[nth] | (np.bincount(nth, minlength=n) > 1)[nth]
    if not bits.any():
        return _MARKS.empty_table()
    words = np.packbits(bits[: (int(np.flatnonzero(bits)[-1]) // 64 + 1) * 64], bitorder="little").view(np.int64)
    return pa.table([pa.array([sent["chunk"][0].as_py()], pa.int64()), pa.array([words.tolist()], pa.list_(pa.int64()))], schema=_MARKS)


def suspect_marks(held: DataFrame, bits: int, owner_bits: int, scratch: Scratch) -> DataFrame:
    """(chunk, marks) of the chunks with suspects among held (row, f)."""
    sent = scratch.keep(held.select("row", "f").mapInArrow(_send(bits, owner_bits), "chunk bigint, base bigint, owner int, n int, k int, code binary, places binary, again binary"))
    replies = sent.select("chunk", "base", "owner", "n", "k", "code").groupBy("owner").applyInArrow(answer, "chunk bigint, base bigint, owner int, twice binary")
    own = sent.select("chunk", "base", "owner", "n", "places", "again")
    return own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(mark, "chunk bigint, marks array<bigint>")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", extra_bits: int = EXTRA_BITS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.length(plain).alias("n"), F.regexp_replace(plain, r"[\x20\x09-\x0D]+", "").alias("norm"))
    rows = rows.select(F.shiftright("row", _CHUNK_BITS).alias("chunk"), "row", "key", "n", F.xxhash64("norm").alias("f"), F.sha2("norm", 256).alias("name"), "norm")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    local, path = f"exact_dedup_{uuid.uuid4().hex}", shared_folder(spark)
    rows.write.format("parquet").bucketBy(parts, "chunk").option("path", path).option("compression", "zstd").saveAsTable(local)
    held = spark.table(local)
    total = held.count()
    owner_bits = max(parts, -(-total // OWNER_ROWS)).bit_length()
    bits = min(62, max(total.bit_length() + extra_bits, owner_bits + 1))

    marks = scratch.keep(suspect_marks(held, bits, owner_bits, scratch)).hint("shuffle_hash")
    place = F.col("row").bitwiseAND((1 << _CHUNK_BITS) - 1).cast("int")
    bit = F.getbit(F.get("marks", F.shiftright(place, 6)), place.bitwiseAND(63))
    marked = held.join(marks, "chunk", "left").withColumn("suspect", F.coalesce(bit == 1, F.lit(False))).drop("marks")  # a chunk's rows stay in their bucket
    suspects = marked.where("suspect")

    texts = suspects.groupBy("norm").agg(F.count(F.lit(1)).alias("size"))
    named = texts.select(F.sha2("norm", 256).alias("name"), "size").groupBy("name").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    sizes = named.select("name", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("bigint")).alias("size")).where("size > 1")
    best = F.struct((-F.col("n")).alias("n"), F.col("key").isNull().alias("no_key"), "key", "row")
    of_chunk = suspects.groupBy("chunk", "name").agg(F.min(best).alias("best"))
    groups = of_chunk.groupBy("name").agg(F.min("best").alias("best")).join(sizes, "name")
    pairs = scratch.keep(of_chunk.select("chunk", "name").join(groups, "name"))

    small = ("chunk", "row", "key", "name")
    copies = suspects.select(*small).join(pairs, ["chunk", "name"], "left")
    copies = copies.select("key", F.when(F.col("size").isNull(), F.col("key")).otherwise(F.col("best.key")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"), "name")
    single = marked.where(~F.col("suspect")).select("key", F.col("key").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "name")
    out = scratch.keep(single.union(copies))
    spark.sql(f"DROP TABLE {local}")
    scratch.remove(path)
    scratch.drop_all_but(out)
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.col("name").alias("text_sha256"))
