"""Document fingerprints by Order MinHash (Marcais, DeBlasio, Pandey and Kingsford, 2019), in DataFrame functions only.

A text is cut into tokens and each run of ``words`` tokens is a k-mer.  K-mers that come again in the text are numbered, so each
occurrence is an element of its own.  For each of ``sketches`` orders of all elements, the ``tuple_size`` least ones are
selected, put back into the order in which the text has them, and hashed together.  Two texts agree in a sketch if they share the
selected k-mers and have them in the same order; so the share of equal sketches falls with the edit distance, also
where parts of a text are only moved, which a set of k-mers doesn't notice.

An order compares the elements' 64-bit hashes after an exclusive or with the order's own mask.  Hashes carry the element's place in
their low bits, so arrays of plain longs are sorted, which Spark does on primitive arrays.  The masks differ in their highest bits,
so an order's least elements are those of one stretch of the sorted elements, and only short texts need a look at all elements
for each order.

Tokens are runs of characters other than white space, of 16 characters at most; a longer one counts as several, and each Han, Kana or
Hangul character is a token.  Texts with fewer tokens than a k-mer are one k-mer; texts with fewer k-mers than a tuple give a
shorter tuple.

:func:`successors` finds each document's next one by descending id without a window over all rows: boundaries that cut the ids into
buckets of about ``rows`` rows come from a range partitioning of the ids, and a bucket's first row goes to the bucket before it too.

Defined results: a null text is empty, and all empty texts have one fingerprint, which is unlike any other's; a null id comes
last; rows that repeat an id follow each other by the hashes of their texts, repeated rows in any order; the next of the
last row is the first one, which in a table of one row is itself; other columns of the input stay out of it, so clashing names
do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS, TUPLE, SKETCHES = 5, 2, 32
#: Tokens of a text: these characters alone, others in runs of 16 at most.
ALONE = r"぀-ヿ㐀-䶿一-鿿가-힯"
TOKEN = rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}]{{1,16}}"
#: Low bits of an element that hold its place.
PLACE = 30
#: Rows of a bucket in :func:`successors`, and buckets at most; beyond that they grow.
ROWS, BUCKETS = 2048, 1 << 16


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a transform of a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def masks(sketches: int) -> list[int]:
    """The orders' masks, signed 64-bit numbers without the places' bits.  Their highest bits count the orders, so that in
    each order other elements come first: those whose own highest bits are the same, with the sign bit turned."""
    r, top = random.Random(7_301_993), sketches.bit_length() - 1
    found = [((i << (64 - top)) | (r.getrandbits(64 - top - PLACE) << PLACE)) & (1 << 64) - 1 for i in range(sketches)]
    return [x - (x >> 63 << 64) for x in found]


def kmers(text: Column, words: int = WORDS) -> Column:
    """Hashes of the runs of ``words`` tokens, in text order."""

    def of(t: Column) -> Column:
        runs = F.transform(t, lambda x, i: F.xxhash64(x, *(F.get(t, i + k) for k in range(1, words))))
        return F.slice(runs, 1, F.greatest(F.size(t) - (words - 1), F.least(F.size(t), F.lit(1))))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), of)


def numbered(k: Column) -> Column:
    """The hash of each occurrence: a k-mer's own for the first one, with the number of earlier ones for the others."""
    low = (1 << PLACE) - 1

    def renumbered(order: Column) -> Column:
        group = lambda i: F.shiftright(F.get(order, i), PLACE)
        starts = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda i: (i == 0) | (group(i) != group(i - 1)))
        numbers = let(starts, lambda s: F.flatten(F.transform(s, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(s, j + 1), F.size(order)) - a - 1))))
        placed = let(numbers, lambda n: F.sort_array(F.transform(order, lambda x, j: F.shiftleft(x.bitwiseAND(low), 32).bitwiseOR(F.get(n, j).cast("long")))))
        return let(placed, lambda p: F.transform(k, lambda h, i: let(F.get(p, i).bitwiseAND(low), lambda n: F.when(n == 0, h).otherwise(F.xxhash64(h, n)))))

    ordered = F.sort_array(F.transform(k, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE + 1), PLACE).bitwiseOR(i.cast("long"))))
    return F.when(F.size(F.array_distinct(k)) == F.size(k), k).otherwise(let(ordered, renumbered))


def sketch(text: Column, words: int = WORDS, tuple_size: int = TUPLE, sketches: int = SKETCHES) -> Column:
    """The fingerprint as an array of ``sketches`` numbers of 32 bits; ``sketches`` is a power of two."""
    if sketches < 1 or sketches & (sketches - 1):
        raise ValueError("sketches must be a power of two")
    low, top = (1 << PLACE) - 1, sketches.bit_length() - 1
    #: The least element that can come first in each order: marks in the sorted elements.
    marks = F.array(*(F.lit((i << (64 - top)) - (1 << 63)) for i in range(sketches)))

    def hashed(k: Column, elements: Column, mask: Column) -> Column:
        least = F.slice(F.sort_array(F.transform(elements, lambda x: x.bitwiseXOR(mask))), 1, tuple_size)
        places = F.sort_array(F.transform(least, lambda x: x.bitwiseAND(low)))
        return F.shiftrightunsigned(F.xxhash64(F.transform(places, lambda p: F.get(k, p.cast("int")))), 32)

    def chosen(k: Column, base: Column, ordered: Column, at: Column) -> Column:
        # an order's first elements stand between its mark and the next one; where these are too few, all elements are looked at
        def one(mask: Column, i: Column) -> Column:
            begin = F.get(at, i)
            return let(F.coalesce(F.get(at, i + 1), F.size(ordered) + 1) - begin - 1, lambda n: hashed(k, F.when(n >= tuple_size, F.slice(ordered, begin + 1, n)).otherwise(base), mask))

        return F.transform(F.array(*(F.lit(m) for m in masks(sketches))), one)

    base = lambda k: F.transform(numbered(k), lambda h, i: h.bitwiseAND(~low).bitwiseOR(i.cast("long")))
    found = lambda s: F.transform(marks, lambda m: F.array_position(s, m).cast("int"))
    return let(kmers(text, words), lambda k: let(base(k), lambda b: let(F.sort_array(F.concat(b, marks)), lambda s: let(found(s), lambda at: chosen(k, b, s, at)))))


def written(sketch_: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each sketch."""
    return F.array_join(F.transform(sketch_, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches of two fingerprints in array form."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def _rank(id_: str, text: str) -> Column:
    """What rows are ordered by, descending: ids, null last, then hashes of texts."""
    return F.struct(F.col(id_).isNotNull().alias("known"), F.col(id_).alias("id"), F.xxhash64(text).alias("hash"))


def boundaries(documents: DataFrame, id_: str, text: str, rows: int = ROWS) -> list[T.Row]:
    """The first rank of each bucket, descending: ``BUCKETS`` of them at most."""
    n = min(BUCKETS, -(-documents.count() // rows))
    keys = documents.select(_rank(id_, text).alias("rank"))
    if n > 1:
        keys = keys.repartitionByRange(n, F.desc("rank"))
    heads = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.max("rank").alias("head"))
    return sorted((r["head"] for r in heads.collect()), key=lambda h: (h["known"], *([h["id"]] if h["known"] else []), h["hash"]), reverse=True)


def _bucket(rank: Column, heads: Column, n: int) -> Column:
    """How many of the heads after the first are not less than ``rank``: a binary search."""

    def step(at: Column, width: int) -> Column:
        found = lambda a: F.when((a + width < n) & (F.get(heads, a + width) >= rank), a + width).otherwise(a)
        return let(at, lambda a: found(a) if width == 1 else step(found(a), width // 2))

    return step(F.lit(0), 1 << max(0, n.bit_length() - 1))


def successors(documents: DataFrame, values: list[str], id_: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """The documents' columns ``id_``, ``text`` and ``values``, and ``next_<name>`` of the text and the values: those of the next
    document by descending id, of the last one the first's."""
    heads = boundaries(documents.select(id_, text), id_, text, rows)
    n = max(1, len(heads))
    kind = documents.select(_rank(id_, text).alias("rank")).schema["rank"].dataType
    body = json.dumps([{"known": h["known"], "id": h["id"], "hash": h["hash"]} for h in heads], default=str)
    found = F.from_json(F.lit(body), T.ArrayType(kind))
    ranked = documents.select(id_, text, *values, _rank(id_, text).alias("_rank"))
    places = let(_bucket(F.col("_rank"), found, n), lambda b: F.array_compact(F.array(
        F.struct(b.alias("bucket"), F.lit(False).alias("after")),
        F.when(F.get(found, b) == F.col("_rank"), F.struct(F.when(b > 0, b - 1).otherwise(n - 1).alias("bucket"), F.lit(True).alias("after"))),
    )))
    dealt = ranked.select("*", F.explode(places).alias("_place")).select("*", "_place.bucket", "_place.after")
    order = Window.partitionBy("bucket").orderBy("after", F.desc("_rank"))
    carried = dealt.withColumn("_next", F.lead(F.struct(F.lit(True).alias("there"), text, *values)).over(order)).where(~F.col("after"))
    return carried.select(id_, text, *values, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in (text, *values)))


def edited(text: Column, other: Column) -> Column:
    """The text with its last third, rounded down, replaced by as many first characters of the other (or all)."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def digest(documents: DataFrame, words: int = WORDS, tuple_size: int = TUPLE, sketches: int = SKETCHES, rows: int = ROWS) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and how like they are to each other and to the next document's."""
    of = lambda c: sketch(c, words, tuple_size, sketches)
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = source.withColumn("sketch", of(F.col("text")))
    paired = successors(own, ["sketch"], rows=rows).select("doc_id", "text", "sketch", "next_sketch", edited(F.col("text"), F.col("next_text")).alias("edited"))
    return paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "sketch", "next_sketch", of(F.col("edited")).alias("edited_sketch"),
    ).select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
