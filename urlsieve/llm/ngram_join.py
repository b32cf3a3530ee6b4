"""N-gram Jaccard join with multiple-global-order filtering.

Documents are sets of word shingles.  Two sets of Jaccard similarity t or more share a token of their prefixes (the first
``n - ceil(t n) + 1`` tokens) under *every* global order of tokens.  Candidates meet on prefix tokens of a first order, rare
tokens first, where the places of the first shared token still allow the similarity.  They go on only if their prefixes under a
second and a third order (two independent permutations) meet as well: each set carries a signature of these prefixes, 16
bits a token, so pairs are cut before any text travels.  What passes all filters is verified on the whole sets.

The first order needs frequencies, but any function of the token is a valid order: a fixed-size count sketch over all
documents gives them, so nothing that grows with the vocabulary is broadcast, and its collisions cost time only.

Copies: equal sets are one class from the start.  Within a posting list, the member with the most common tokens is the
hub that others are compared with first.  Later rounds compare only members of different components so far, until every
posting list lies in one component or all its cross pairs are verified, so no link between components is lost while
groups of near copies are never expanded into all their pairs.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Shingles are compared by 64-bit hashes.

Defined results: a null text or one without words has an empty set and is alone in its component; fewer than ``size`` words
are one shingle; repeated rows are in one component; a null id joins like others, a component's id is its least non-null
id; other columns stay, and a column of a result's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textbytes as tb
from .components import components

SIZE, PERCENT = 5, 80
#: Cells of the count sketch: at least 2^16, at most 2^22; counts travel in pieces of 2^14.
CELLS, PIECE = (1 << 16, 1 << 22), 1 << 14
#: Members of one posting list that meet the others in one round.
HUBS = 256
_SECOND, _THIRD = np.uint64(0x8F14E45FCEEA167A), np.uint64(0x45C48CCE2E2D7FBD)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text."""
    data, offsets = tb.text_bytes(column)
    for a, b in tb.chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        upper = (part >= 65) & (part <= 90)
        part = np.where(upper, part | 32, part).astype(np.uint8)
        start, end = tb.spans(~tb.SPACE[part], at)
        word = tb.RangeHash(part)(start, end)
        edge = np.searchsorted(start, at)
        grams = tb.ngrams(word, size)
        for i in range(b - a):
            lo, hi = edge[i], edge[i + 1]
            if hi - lo >= size:
                yield a + i, np.unique(grams[lo : hi - size + 1])
            elif hi > lo:
                yield a + i, tb.ngrams(word[lo:hi], int(hi - lo)) + np.uint64(hi - lo)
            else:
                yield a + i, np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def sketch(documents: DataFrame, cells: int, size: int) -> np.ndarray:
    """For each cell, four times the log2 of the number of documents' tokens that fall in it."""
    shift = np.uint64(65 - cells.bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), size):
                np.add.at(total, (tokens >> shift).astype(np.int64), 1)
        pieces = [total[i : i + PIECE].astype("<i8") for i in range(0, cells, PIECE)]
        full = [(i, x) for i, x in enumerate(pieces) if x.any()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([i for i, _ in full], pa.int32()), "counts": pa.array([x.tobytes() for _, x in full], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PIECE, np.int64)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_py(), "<i8")
        level = np.minimum(255, 4 * np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(cells, np.uint8)
    # at most ``cells`` bytes reach the driver
    for row in documents.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, levels binary").collect():
        out[row["piece"] * PIECE : row["piece"] * PIECE + PIECE] = np.frombuffer(bytes(row["levels"]), np.uint8)
    return out


def _records(texts: DataFrame, levels, cells: int, size: int, percent: int) -> DataFrame:
    """``doc_id, tid, s, n, prio, prefix, second, third``: the set's hash and size, how common its tokens are, its prefix in the first
    order, the signatures of those in the others."""
    shift = np.uint64(65 - cells.bit_length())
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = levels.value
        for batch in batches:
            name, count, prio, prefix, rows, others = [], [], [], [], [], []
            for row, tokens in shingle_sets(batch.column(2), size):
                n = len(tokens)
                level = level_of[(tokens >> shift).astype(np.int64)].astype(np.uint64)
                p = prefix_length(n, percent)
                key = (level << np.uint64(56)) | (tb.mix(tokens) >> np.uint64(8))
                first = np.argpartition(key, p - 1)[:p] if 0 < p < n else np.arange(p)
                first = tokens[first[np.argsort(key[first])]]
                s = xxhash.xxh3_64_intdigest(tokens.tobytes())
                rows.append(row)
                name.append(s)
                count.append(n)
                # how common the tokens are, then the size, then bits of the name that break ties
                prio.append((int(level.mean() * 4) << 53 | n << 25 if n else 0) | s & ((1 << 25) - 1))
                prefix.append(first)
                others.append(signatures(tokens, p))
                if len(rows) >= 2000:
                    yield _batch(batch, rows, name, count, prio, prefix, others)
                    name, count, prio, prefix, rows, others = [], [], [], [], [], []
            yield _batch(batch, rows, name, count, prio, prefix, others)

    def _batch(batch, rows, name, count, prio, prefix, others) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
        flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
        names_ = pa.array(np.array(name, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), names_, pa.array(count, pa.int32()), pa.array(prio, pa.int64()), lists, *(pa.array([x[k] for x in others], pa.binary()) for k in (0, 1))], names=["doc_id", "tid", "s", "n", "prio", "prefix", "second", "third"])

    return texts.select("doc_id", "tid", "text").mapInArrow(run, f"doc_id {kind}, tid long, s long, n int, prio long, prefix array<long>, second binary, third binary")


def signatures(tokens: np.ndarray, p: int) -> list[bytes]:
    """Sixteen bits of each token of the prefixes of length ``p`` under the two permutations, sorted."""
    out = []
    for salt in (_SECOND, _THIRD):
        key = tb.mix(tokens ^ salt)
        if 0 < p < len(key):
            key = np.partition(key, p - 1)[:p]
        out.append(np.unique((key & np.uint64(0xFFFF)).astype("<u2")).tobytes())
    return out


def meet(u: bytes, v: bytes) -> bool:
    """Whether two signatures have a value in common."""
    x, y = np.frombuffer(u, "<u2"), np.frombuffer(v, "<u2")
    return len(x) > 0 and bool((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).any())


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def met_everywhere(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``a, b`` pairs whose prefixes can meet under the second and the third order too."""
    side = lambda c: classes.select(F.col("s").alias(c), F.col("second").alias(f"second_{c}"), F.col("third").alias(f"third_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            seconds, thirds = (zip(get(f"{c}_a").to_pylist(), get(f"{c}_b").to_pylist()) for c in ("second", "third"))
            keep = [meet(*u) and meet(*v) for u, v in zip(seconds, thirds)]
            yield pa.RecordBatch.from_arrays([get("a"), get("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, classes: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``a, b`` pairs whose prefixes meet under all orders and whose sets have the similarity. Texts travel, not sets: they
    are a fifth of the size."""
    side = lambda c: bodies.select(F.col("s").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            for at in range(0, batch.num_rows, 64):
                a, b = (get(c).slice(at, 64) for c in ("a", "b"))
                x, y = ([t for _, t in shingle_sets(get(c).slice(at, 64), size)] for c in ("text_a", "text_b"))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array([similar(u, v, percent) for u, v in zip(x, y)], pa.bool_()))

    left = scratch.keep(met_everywhere(pairs, classes), "met-everywhere")
    return left.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _near(a: str, b: str, at_a: str, at_b: str, percent: int):
    """Whether two sets whose first shared token stands at these places can have the similarity (sizes are in the priorities).

    A pair meets on each prefix token it shares, and the bound holds on the first of them, so no similar pair is lost."""
    n = lambda c: F.shiftright(c, 25).bitwiseAND(F.lit((1 << 28) - 1))
    return (100 + percent) * F.least(n(a) - F.col(at_a), n(b) - F.col(at_b)) >= percent * (n(a) + n(b))


def link_classes(records: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, root`` of the set classes that have links."""
    # one row of each set before anything is joined by it: copies meet in partial aggregates
    one = F.min(F.struct("doc_id", "tid", "prio", "prefix", "second", "third")).alias("r")
    classes = scratch.keep(records.where("n > 0").groupBy("s").agg(one).select("s", "r.*"), "set-classes")
    postings = classes.select("s", "prio", F.posexplode("prefix").alias("at", "token")).repartition("token")
    lists = postings.groupBy("token").agg(F.count("*").alias("members"), F.max_by("s", "prio").alias("hub"), F.max_by("at", "prio").alias("hub_at"), F.max("prio").alias("hub_prio")).where("members > 1")
    lists = scratch.keep(postings.join(lists.hint("shuffle_hash"), "token"), "lists")
    wanted = scratch.keep(classes.select("s", "tid", "doc_id").join(lists.select("s").distinct(), "s", "left_semi"), "wanted")
    same = (texts["tid"] == wanted["tid"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    bodies = scratch.keep(texts.join(wanted, same).select(wanted["s"], texts["text"]), "bodies")
    if bodies.select("s").count() > wanted.count():  # a row of one id and text that is there more than once
        bodies = scratch.keep(bodies.dropDuplicates(["s"]), "bodies")
    scratch.drop(wanted)

    first = lists.where("s <> hub").where(_near("prio", "hub_prio", "at", "hub_at", percent))
    pairs = scratch.keep(first.groupBy("s").agg(F.max_by("hub", "hub_prio").alias("hub")).select(F.greatest("s", "hub").alias("a"), F.least("s", "hub").alias("b")).distinct(), "pairs")
    seen, links = pairs, scratch.keep(verify(pairs, classes, bodies, size, percent), "links")
    members = lists.select("token", "s", "prio", "at")
    roots = scratch.keep(components(links), "roots")
    while True:
        rooted = members.join(roots, members["s"] == roots["node"], "left").select("token", "s", "prio", "at", F.coalesce("root", "s").alias("root"))
        rooted = scratch.keep(rooted, "rooted")
        open_ = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
        # what lies outside a list's largest component, so far, has to meet the rest of the list
        sizes = rooted.groupBy("token", "root").agg(F.count("*").alias("k")).join(open_, "token", "left_semi")
        largest = scratch.keep(sizes.groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.sum("k").alias("members"), F.max("k").alias("k")), "open")
        if largest.isEmpty():
            return roots
        open_members = scratch.keep(rooted.join(largest, "token"), "members")
        minor = open_members.where("root <> largest").withColumn("seat", F.when(F.col("members") - F.col("k") <= HUBS, F.col("s")).otherwise(F.pmod(F.xxhash64("s"), F.lit(HUBS))))
        hubs = scratch.keep(minor.groupBy("token", "seat").agg(F.max_by("s", "prio").alias("hub"), F.max_by("at", "prio").alias("hub_at"), F.max("prio").alias("hub_prio"), F.max_by("root", "prio").alias("hub_root")).drop("seat"), "hubs")
        met = open_members.join(hubs, "token").where("root <> hub_root").where(_near("prio", "hub_prio", "at", "hub_at", percent))
        pairs = scratch.keep(met.select(F.greatest("s", "hub").alias("a"), F.least("s", "hub").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            found = scratch.keep(verify(pairs, classes, bodies, size, percent), "links")
            seen = seen.union(pairs)
            if not found.isEmpty():
                links = links.union(found)
                roots = scratch.keep(components(links), "roots")
        members = scratch.keep(open_members.join(hubs.select("token", F.col("hub").alias("s")), ["token", "s"], "left_anti").select("token", "s", "prio", "at"), "left")


def near_duplicates(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """``documents`` with ``n_shingles`` and ``component_id``."""
    spark = documents.sparkSession
    names = [c for c in documents.columns if c not in ("n_shingles", "component_id")]
    texts = documents.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("tid"))
    found = _rows(spark, texts, size, percent)
    by_text = found.groupBy("doc_id", "tid").agg(F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component_id"))
    by_text = scratch.keep(by_text.withColumnsRenamed({"doc_id": "_d", "tid": "_t"}), "by-text")
    keyed = documents.select(*names).withColumn("_k", F.xxhash64(F.coalesce(text, F.lit(""))))
    return keyed.join(by_text, (F.col("_k") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select(*names, "n_shingles", "component_id")


def one_of_each(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One row of each component: a row of its least id (of the texts under that id, one; of repeated rows, one). Where all
    ids of a component are null, one of its texts. Rows without words are kept as they are, each its own component."""
    texts = documents.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("tid"))
    found = scratch.keep(_rows(documents.sparkSession, texts, size, percent, roots=True), "found")
    chosen = found.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("_d"), F.min_by("tid", "doc_id").alias("_t"), F.min("tid").alias("_u"))
    chosen = scratch.keep(chosen.select("_d", F.coalesce("_t", "_u").alias("_t")), "chosen")
    keyed = documents.withColumn("_k", F.xxhash64(F.coalesce(text, F.lit(""))))
    kept = keyed.join(chosen, (F.col("_k") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").drop("_k")
    if kept.select("doc_id").count() > chosen.count():  # a row of one id and text that is there more than once
        first = keyed.withColumn("_r", F.monotonically_increasing_id()).join(chosen, (F.col("_k") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
        kept = first.dropDuplicates(["doc_id", "_k"]).drop("_k", "_r")
    wordless = documents.where(~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*documents.columns).union(wordless)


def digest(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row, without carrying the texts."""
    texts = documents.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("tid"))
    return _rows(documents.sparkSession, texts, size, percent).drop("tid")


def _rows(spark, texts: DataFrame, size: int, percent: int, roots: bool = False) -> DataFrame:
    cells = min(max(1 << (4 * texts.select("doc_id").count()).bit_length(), CELLS[0]), CELLS[1])
    levels = spark.sparkContext.broadcast(sketch(texts, cells, size))
    records = scratch.keep(_records(texts, levels, cells, size, percent), "records")
    linked = scratch.keep(link_classes(records, texts, size, percent), "class-roots")
    classes = records.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    rooted = scratch.keep(classes.join(linked, classes["s"] == linked["node"], "left").select("s", "least", F.coalesce("root", "s").alias("root")), "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    ids = scratch.keep(rooted.join(least, "root").select("s", "component_id", "root"), "ids")
    more = ["root"] * roots
    some = records.where("n > 0").select("doc_id", "tid", "s", "n").join(ids, "s").select("doc_id", "tid", F.col("n").cast("long").alias("n_shingles"), "component_id", *more)
    none = records.where("n = 0").select("doc_id", "tid", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(None).cast("long").alias("root")] * roots)
    return some.union(none)
