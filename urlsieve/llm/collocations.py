"""Phrase collocations by SON partitioning (Savasere, Omiecinski and Navathe, 1995).

The documents fall into ``shards`` shards by hash.  A phrase that occurs ``support`` times in a language has, in at least one
shard, ``ceil(support * share)`` occurrences, where ``share`` is the shard's share of the language's words; so each shard is
mined at that lowered local support, and what is frequent in some shard is a candidate.

* Mining a shard is complete and goes by length.  A phrase is looked at if its words are frequent and both phrases of one word
  less, at its front and at its back, are candidates.  Names of the occurrences (64-bit hashes) travel packed in Arrow batches
  to parts by shard, support and hash, where they are sorted and counted.  A name that a task has sent as often as its
  support asks is not sent by it again, so a phrase found everywhere travels a few times for each task.
* The candidates of all shards are united in a bitmap of at most ``FILTER_BITS`` bits, which is the only thing broadcast.
  Where it errs, it lets a phrase pass that no shard found; no candidate is ever lost.
* All phrases that pass are then counted by their text over all documents, and those below the support are dropped.  So
  results are exact, whatever the hashes do.  As the support is an absolute number, more shards than it would lower
  the local supports to one, and mining would be no help: hence few shards, each mined by many tasks.

The scores come from joins of the counted phrases with their parts; arithmetic on counts is decimal.

Defined results: null or empty text has no words; a null language is ``und``; repeated rows count each; other columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from . import textbytes as tb

#: Fixed values of the contract: characters that end a piece, and those that part words in it.
PIECE, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
UNKNOWN = "und"
MAX_WORDS, SUPPORT, COVER, TOP, SHARDS = 3, 10, 50, 2000, 4
#: Bits of a candidate filter at most, and for each candidate below that; bytes of text for a part; names a task remembers.
FILTER_BITS, BITS_EACH, PART_BYTES, KNOWN = 1 << 29, 16, 8 << 20, 1 << 18
#: Pairs of a language and a shard that get their own local support; the smallest beyond that get the support one.
SHARES = 1 << 16

_ENDS, _APART, _LOW = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_ENDS[list(PIECE)] = _APART[list(PIECE + BLANK)] = True
_LOW[65:91] += 32


class Words(NamedTuple):
    """The words of some rows: a buffer in which one space parts the words of a piece, spans in it, the row of each word, and
    whether the next word follows in the same piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    joined: np.ndarray

    def spans(self, size: int) -> np.ndarray:
        """First words of the phrases of ``size`` words."""
        ok = np.ones(max(0, len(self.start) - size + 1), bool)
        for k in range(size - 1):
            ok &= self.joined[k : k + len(ok)]
        return np.flatnonzero(ok)

    def texts(self, first: np.ndarray, size: int) -> pa.Array:
        start, end = self.start[first], self.end[first + size - 1]
        length = end - start
        ends = np.cumsum(length)
        index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)
        kind = np.int64 if len(index) > np.iinfo(np.int32).max else np.int32
        bounds = np.concatenate(([0], ends)).astype(kind)
        made = pa.LargeStringArray if kind is np.int64 else pa.StringArray
        return made.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self.data[index])))


def words(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """Chunks of rows: the first row's number and the words."""
    data, offsets = tb.text_bytes(column)
    for lo, hi in tb.chunks(offsets):
        body, at = _LOW[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        apart = _APART[body]
        start, end = tb.spans(~apart, at)
        if not len(start):
            continue
        row = tb.row_of(start, at)
        piece = np.cumsum(_ENDS[body])[start]
        joined = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)
        keep = ~apart
        after = end[end < len(body)]
        after = after[apart[after]]
        keep[after] = True
        body[after] = 0x20
        moved = np.concatenate(([0], np.cumsum(keep)))
        yield lo, Words(body[keep], moved[start], moved[end], row, joined)


def names(w: Words, salt: np.ndarray, size: int, single: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit name of each phrase of ``size`` words, by its first word (phrases across pieces included, for the caller to leave)."""
    single = tb.RangeHash(w.data)(w.start, w.end) if single is None else single
    return tb.mix((single if size == 1 else tb.ngrams(single, size)) ^ salt[: max(0, len(single) - size + 1)])


def _salts(langs: pa.DictionaryArray) -> np.ndarray:
    """A salt for each language of a dictionary."""
    data, offsets = tb.text_bytes(langs.dictionary)
    return tb.mix(tb.RangeHash(data, 1)(offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64))


def _langs(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    encoded = pc.fill_null(column.cast(pa.string()), UNKNOWN).dictionary_encode()
    return encoded, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(keys: list[tuple[str, pa.Array]]) -> pa.Table:
    return pa.table(dict(keys)).group_by([k for k, _ in keys], use_threads=False).aggregate([([], "count_all")])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, shard, word, n``: a word's count in a chunk (shard -1), or a shard's number of words (word null)."""
    for batch in batches:
        langs, lang = _langs(batch.column(0))
        shard = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, w in words(batch.column(2)):
            of = lang[lo + w.row]
            t = _counted([("l", pa.array(of)), ("w", w.texts(np.arange(len(w.start)), 1))])
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(t["l"].combine_chunks()), pa.array(np.full(len(t), -1, np.int32)), t["w"].combine_chunks().cast(pa.string()), t["count_all"].combine_chunks()],
                names=["lang", "shard", "word", "n"],
            )
            t = _counted([("l", pa.array(of)), ("s", pa.array(shard[lo + w.row]))])
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(t["l"].combine_chunks()), t["s"].combine_chunks().cast(pa.int32()), pa.nulls(len(t), pa.string()), t["count_all"].combine_chunks()], names=["lang", "shard", "word", "n"]
            )


def _bit(filter_: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Is the name's bit set? ``filter_``: a power of two of bytes."""
    at = name & np.uint64(8 * len(filter_) - 1)
    return (filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def candidate_filter(hashes: DataFrame, most: int = FILTER_BITS) -> Broadcast:
    """A bitmap in which the bits of all names in column ``name`` are set; at most ``most`` bits, so its size is bounded."""
    spark, block = hashes.sparkSession, 8 * 4096
    bits = block
    while bits < min(most, BITS_EACH * hashes.count()):
        bits *= 2
    at = F.col("name").bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(F.floor(at / block).cast("int").alias("block"), (at % block).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.toLocalIterator():  # bits / 32768 rows of 4 KB
        out[4096 * row["block"] : 4096 * (row["block"] + 1)] = np.frombuffer(row["b"], np.uint8)
    return spark.sparkContext.broadcast(out)


def _passing(w: Words, salt: np.ndarray, size: int, filters: list[np.ndarray], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """First words and names of the phrases of ``size`` words whose parts pass the filters of their lengths, and with ``last``
    they themselves the filter of theirs."""
    single = tb.RangeHash(w.data)(w.start, w.end)
    first = w.spans(size)
    for k in (1, size - 1) if size > 2 else (1,):
        if len(first):
            ok = _bit(filters[k - 1], names(w, salt, k, single))
            for step in range(size - k + 1):
                first = first[ok[first + step]]
    name = names(w, salt, size, single)[first] if len(first) else np.zeros(0, np.uint64)
    if last:
        ok = _bit(filters[size - 1], name)
        first, name = first[ok], name[ok]
    return first, name


def _mine(source: DataFrame, size: int, filters: list[Broadcast], supports: Broadcast, parts: int) -> DataFrame:
    """``name``: the phrases of ``size`` words that are frequent in some shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, local = [f.value for f in filters], supports.value
        known = np.zeros(0, np.uint64)
        for batch in batches:
            langs, lang = _langs(batch.column(0))
            shard, salts = batch.column(1).to_numpy(zero_copy_only=False), _salts(langs)
            need = np.array([local.get((langs.dictionary[int(a)].as_py(), int(b)), 1) for a, b in zip(lang, shard)], np.uint64)
            for lo, w in words(batch.column(2)):
                row = lo + w.row
                first, name = _passing(w, salts[lang[row]], size, bits, False)
                if not len(first):
                    continue
                # the place is the shard and its support; names of one place are told apart by 64 bits, which errs only in what is looked at again
                place = (shard[row[first]].astype(np.uint64) << np.uint64(32)) + need[row[first]]
                key = tb.mix(name ^ place)
                _, at, count = np.unique(key, return_index=True, return_counts=True)
                key, name, place = key[at], name[at], place[at]
                new = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key if len(known) else np.ones(len(key), bool)
                most = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
                full = count >= most
                if len(known) < KNOWN:
                    known = np.union1d(known, key[full & new][: KNOWN - len(known)])
                name, place, times = name[new], place[new], np.minimum(count, most)[new]
                name, place = np.repeat(name, times), np.repeat(place, times)
                part = ((name >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((part, place))
                name, place, part = name[order].view(np.int64), place[order], part[order]
                edge = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])))
                ends = np.append(edge[1:], len(name))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((place[edge] >> np.uint64(32)).astype(np.int32)), pa.array((place[edge] & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(part[edge].astype(np.int32)),
                     pa.BinaryArray.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((8 * np.append(edge, ends[-1:])).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(name))])],
                    names=["shard", "need", "part", "names"],
                )

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        body = table.column("names").to_numpy()
        got = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in body]))
        edge = np.flatnonzero(np.append(True, got[1:] != got[:-1]))
        times = np.diff(np.append(edge, len(got)))
        return pa.table({"name": pa.array(got[edge[times >= key[1].as_py()]])})

    sent = source.mapInArrow(send, "shard int, need int, part int, names binary")
    return sent.groupBy("shard", "need", "part").applyInArrow(count, "name long").distinct()


def _exact(source: DataFrame, sizes: Sequence[int], filters: list[Broadcast]) -> DataFrame:
    """``lang, phrase, size, n``: all occurrences of the phrases that pass, by their text."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        for batch in batches:
            langs, lang = _langs(batch.column(0))
            salts = _salts(langs)
            for lo, w in words(batch.column(2)):
                of = lang[lo + w.row]
                for size in sizes:
                    first, _ = _passing(w, salts[of], size, bits, True)
                    if len(first):
                        t = _counted([("l", pa.array(of[first])), ("p", w.texts(first, size))])
                        yield pa.RecordBatch.from_arrays(
                            [langs.dictionary.take(t["l"].combine_chunks()), t["p"].combine_chunks().cast(pa.string()), pa.array(np.full(len(t), size, np.int32)), t["count_all"].combine_chunks()],
                            names=["lang", "phrase", "size", "n"],
                        )

    return source.mapInArrow(send, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _local_supports(spark: SparkSession, tally: DataFrame, support: int) -> Broadcast:
    totals = tally.where("word is null").select("lang", "shard", "n", F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    rows = totals.orderBy(F.desc("n"), "lang", "shard").limit(SHARES).collect()
    return spark.sparkContext.broadcast({(r["lang"], r["shard"]): -(-support * r["n"] // r["all"]) for r in rows})


def counts(documents: DataFrame, max_words: int = MAX_WORDS, support: int = SUPPORT, shards: int = SHARDS, part_bytes: int = PART_BYTES, text: str = "text", lang: str = "lang", by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``lang, phrase, size, n``: words and phrases of up to ``max_words`` words that occur ``support`` times, counted exactly,
    and a row of size 0 for each language with its number of words.  ``by``: columns that tell the documents apart (they deal
    them to shards together with the text)."""
    spark = documents.sparkSession
    source = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.pmod(F.xxhash64(*(F.col(c) for c in by), F.col(text)), F.lit(shards)).cast("int").alias("shard"), F.col(text).alias("text"),
    )
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (part_bytes * shards)))
    tally = scratch.keep(source.mapInArrow(_words_of, "lang string, shard int, word string, n long").groupBy("lang", "shard", "word").agg(F.sum("n").alias("n")), "phrase-words")
    frequent = tally.where((F.col("shard") == -1) & (F.col("n") >= support))
    supports = _local_supports(spark, tally, support)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, of = _langs(batch.column(0))
            data, offsets = tb.text_bytes(batch.column(1))
            one = Words(data, offsets[:-1], offsets[1:], np.arange(batch.num_rows), np.zeros(batch.num_rows, bool))
            yield pa.RecordBatch.from_pydict({"name": pa.array(names(one, _salts(langs)[of], 1).view(np.int64))})

    filters = [candidate_filter(scratch.keep(frequent.select("lang", "word").mapInArrow(named, "name long"), "phrase-names-1"))]
    for n in range(2, max_words + 1):
        filters.append(candidate_filter(scratch.keep(_mine(source, n, filters, supports, parts), f"phrase-names-{n}")))
    exact = _exact(source, range(2, max_words + 1), filters).where(F.col("n") >= support)
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    total = tally.where("word is null").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit("").alias("phrase"), F.lit(0).alias("size"), "n")
    return scratch.keep(exact.unionByName(single).unionByName(total), "phrase-counts")


def collocations(counted: DataFrame, cover: int = COVER) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of all phrases in a table of :func:`counts`, without those that a longer phrase
    of at least ``cover`` percent of their count contains."""
    phrases, plain = counted.where("size >= 2"), counted.where("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    parts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cut = parts.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side in ("left", "right"):
        cut = cut.join(plain.select("lang", F.col("part").alias(side), F.col("f").alias(side[0])), ["lang", side])
    number = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({number('a')} * {number('a')})) div ({number('l')} * {number('r')})")
    best = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("s"))
    # every shorter phrase inside a longer one, with the longer one's count
    at = F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)
    inner = parts.where("size > 2").select("lang", "size", "a", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")).select("lang", "a", "w", "m", F.explode(at).alias("i"))
    inner = inner.select("lang", join(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    total = counted.where("size = 0").select("lang", F.col("n").alias("n"))
    return kept.join(total, "lang").select("lang", "phrase", "size", "a", "s.l", "s.r", "n", "s.score")


def best(scored: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """Each language's first ``top`` rows by score, count and phrase, with their ``rank``: first within ``salts`` groups of a
    language, then of what is left, so no task sorts all phrases of a language."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
