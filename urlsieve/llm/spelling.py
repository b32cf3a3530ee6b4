"""Spelling variants by finite-state composition: a vocabulary's acceptor, a one-edit transducer, and the acceptor again.

Two words are near if one insertion, deletion or replacement of a code point turns one into the other.  The composition of the three
machines accepts just the pairs of near words.  It is cut by initial states, so that no task needs the whole vocabulary:

* A pair whose shorter word has c code points agrees in the first c // 2 of them, or in the last c - c // 2.  So each word goes
  to the initial state that its first half leads to and, read backwards, to the one of its last half, for c its own length
  and that less one.  Initial states are dealt to parts by hash; what one initial state holds is only the words of two lengths with one half.
* A part builds the trie of its words and minimises it: nodes with the same right language become one state.  The states' word
  counts number the words, so a path tells which word it reads.
* The transducer's edit is the first place where the words differ: at a trie node that both have read, one word takes one arc
  and the other another one (a replacement), or another one and then the first's symbol (an insertion, made as late as it can be, so
  that no pair is found twice).  From there both read the same symbols: the product of the acceptor with itself.
* Product states are explored once each, those from which no end can be reached are dropped, and the accepted pairs are enumerated
  along the others.

Each part gives, for each of its words, the number of near words and the most frequent of them; sums of these are all that is shuffled.
Chains of forms end after few steps, as counts at least double in each; roots come from doubling steps of joins.

Defined results: null text has no words, a null document id is the empty string before the colon; repeated rows count each; other
columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textbytes as tb

#: Least length and count of a word; one in this many occurrences is misspelt on purpose (see ``misspelt``).
MIN_LENGTH, MIN_COUNT, EVERY = 5, 3, 97
#: A form has at least so many times its word's count.
RATIO = 2
#: Words of a part, each counted once for each initial state it goes to.
PART_WORDS = 1 << 16
#: Bytes of a word whose checksum is taken for all words at once; longer ones go on one by one.
_WIDE = 64
_SYMBOL = 21

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> 1) ^ np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0))


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The crc32 of each range, going on from the crc32 ``first`` of what stands before it."""
    order = np.argsort(start - end, kind="stable")
    at, length, crc = start[order], (end - start)[order], first[order] ^ np.uint32(0xFFFFFFFF)
    most = int(length[0]) if len(length) else 0
    left = len(length) - np.searchsorted(length[::-1], np.arange(1, min(most, _WIDE) + 1))
    for k, n in enumerate(left.tolist()):
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.sum(length > _WIDE))):
        crc[i] = zlib.crc32(data[at[i] + _WIDE : at[i] + length[i]], int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def misspelt(data: np.ndarray, offsets: np.ndarray, ids: list[str], every: int = EVERY, min_length: int = MIN_LENGTH) -> pa.Array:
    """The lower-cased runs of Latin letters of some rows, those of ``min_length`` code points after a code point is taken out of
    each run whose checksum with its document's id is divisible by ``every``."""
    data = _LOW[data]
    lead = data == 0xC3  # U+00C0 to U+00FF
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    start, end = tb.spans(inside, offsets)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    length = points[end] - points[start]
    some = length >= min_length
    start, end, length = start[some], end[some], length[some]
    first = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[tb.row_of(start, offsets)] if len(start) else np.zeros(0, np.uint32)
    h = checksums(data, start, end, first).astype(np.int64)
    hit = h % every == 0
    out = np.searchsorted(points, points[start[hit]] + h[hit] % length[hit], "right") - 1
    width = np.zeros(len(start), np.int64)
    width[hit] = 1 + lead[out]
    some = ~hit | (length > min_length)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[some]] += 1
    edge[end[some]] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    keep[out] = keep[out + lead[out]] = False
    ends = np.concatenate(([0], np.cumsum((end - start - width)[some])))
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[keep])))


def vocabulary(documents: DataFrame, id_: str = "doc_id", text: str = "text", every: int = EVERY, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the words and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = tb.text_bytes(batch.column(1))
            for lo, hi in tb.chunks(offsets):
                found = misspelt(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids.slice(lo, hi - lo).to_pylist(), every, min_length).value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    source = documents.select(F.coalesce(F.col(id_).cast("string"), F.lit("")), F.col(text))
    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """The trie of sorted words, and the minimal automaton of its right languages.

    Nodes are numbered by depth; ``arc`` lists the nodes' arcs by node and symbol.  ``state`` maps nodes to states, whose arcs are
    those of one of their nodes."""

    def __init__(self, code: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        """``code``: the words' code points one after the other, sorted by ``group`` and word; each group has a root of its own."""
        n, length = len(group), np.diff(offsets)
        same, shared = np.zeros(n, bool), np.zeros(n, np.int64)
        same[1:] = group[1:] == group[:-1]
        at, depth = np.flatnonzero(same), 0
        while len(at):
            at = at[(length[at] > depth) & (length[at - 1] > depth)]
            at = at[code[offsets[at] + depth] == code[offsets[at - 1] + depth]]
            depth += 1
            shared[at] = depth
        shared[~same] = -1
        node, live, made = np.zeros(n, np.int64), np.arange(n), 0
        parent, symbol, first, level, final = [], [], [], [], []
        depth = 0
        while len(live):
            new = shared[live] < depth
            at = live[new]
            parent.append(node[at] if depth else np.full(len(at), -1))
            symbol.append(code[offsets[at] + depth - 1].astype(np.int64) if depth else np.zeros(len(at), np.int64))
            first.append(at)
            level.append(np.full(len(at), depth))
            node[live] = made + np.cumsum(new) - 1
            ended = np.zeros(len(at), bool)
            ended[node[live[length[live] == depth]] - made] = True
            final.append(ended)
            made += len(at)
            depth += 1
            live = live[length[live] >= depth]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.parent, self.symbol, self.first, self.depth, self.final = join(parent), join(symbol), join(first), join(level), join(final).astype(bool)
        self.made = np.array([len(x) for x in first], np.int64)
        self._minimise()

    def _minimise(self) -> None:
        n, ends = len(self.parent), np.cumsum(self.made)
        salt = tb.mix(self.symbol.astype(np.uint64) + np.uint64(1))
        name, count = self.final.astype(np.uint64), self.final.astype(np.int64)
        # children's names are added up, as symbols differ; deepest first
        for lo, hi in zip((ends - self.made)[::-1].tolist(), ends[::-1].tolist()):
            name[lo:hi] = tb.mix(name[lo:hi] + np.uint64(0x9E37))
            if lo:
                np.add.at(name, self.parent[lo:hi], tb.mix(name[lo:hi] ^ salt[lo:hi]))
                np.add.at(count, self.parent[lo:hi], count[lo:hi])
        _, sample, self.state = np.unique(name, return_index=True, return_inverse=True)
        child = np.arange(int(self.made[0]) if n else 0, n)  # every node but the roots, by parent and symbol
        fan = np.bincount(self.parent[child], minlength=n)
        begin = (child[0] if len(child) else 0) + np.concatenate(([0], np.cumsum(fan)[:-1])) if n else np.zeros(0, np.int64)
        self.fan, self.begin = fan, begin
        # equal names must mean equal right languages
        like = sample[self.state]
        index, arc = self.arcs(np.arange(n))
        if not ((self.final == self.final[like]).all() and (fan == fan[like]).all()):
            raise ValueError("two right languages have one name")
        other = begin[like[index]] + arc - begin[index]
        if not ((self.symbol[arc] == self.symbol[other]).all() and (self.state[arc] == self.state[other]).all()):
            raise ValueError("two right languages have one name")
        # arcs of the states, with the number of words that come before each
        self.ends = self.final[sample]
        source, arc = self.arcs(sample)
        self.target = self.state[arc]
        self.key = (source << _SYMBOL) + self.symbol[arc]
        before = np.cumsum(count[arc]) - count[arc]
        head = np.concatenate(([0], np.cumsum(fan[sample])))
        self.before = before - np.repeat(before[head[:-1][fan[sample] > 0]], fan[sample][fan[sample] > 0]) + self.ends[source]
        self.head = head

    def arcs(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each arc of the nodes: which of them it leaves, and the node it leads to."""
        fan = self.fan[node]
        index = np.repeat(np.arange(len(node)), fan)
        return index, np.arange(len(index)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(self.begin[node], fan)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arc of each state with that symbol, and whether there is one."""
        want = (state << _SYMBOL) + symbol
        at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        return at, self.key[at] == want if len(self.key) else np.zeros(len(want), bool)

    def both(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs with the same symbol of two states each: which pair, and the arc of either."""
        fan = self.head[one + 1] - self.head[one]
        index = np.repeat(np.arange(len(one)), fan)
        arc = np.arange(len(index)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(self.head[one], fan)
        other, there = self.step(two[index], self.key[arc] & ((1 << _SYMBOL) - 1))
        return index[there], arc[there], other[there]


def near_pairs(machine: Acceptor, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near words, by their numbers, of which the first difference is at a node of depth ``least`` (by the group
    of the node's first word) or deeper; in a pair of two lengths the shorter is first."""
    m = machine
    node = np.flatnonzero((m.depth >= least[m.first]) & (m.fan > 0))
    index, arc = m.arcs(node)
    # pairs of a node's arcs: each with every later one
    later = m.begin[node[index]] + m.fan[node[index]] - arc - 1
    one = np.repeat(arc, later)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
    p, r, u, v = [m.state[one]], [m.state[two]], [m.first[one]], [m.first[two]]
    for a, b in ((one, two), (two, one)):  # the longer word has b's symbol first, then a's
        at, there = m.step(m.state[b], m.symbol[a])
        a, b, at = a[there], b[there], at[there]
        p.append(m.state[a])
        r.append(m.target[at])
        u.append(m.first[a])
        v.append(m.first[b] + m.before[at])
    ended = m.final[node[index]] & m.final[arc]  # the shorter word ends where the longer has one more symbol
    found = [(m.first[node[index[ended]]], m.first[arc[ended]])]
    p, r, u, v = (np.concatenate(x) for x in (p, r, u, v))
    size = len(m.ends)
    seen = new = np.unique(p * size + r)
    sources, targets = [], []
    while len(new):
        which, a, b = m.both(new // size, new % size)
        reached = m.target[a] * size + m.target[b]
        sources.append(new[which])
        targets.append(reached)
        reached = np.unique(reached)
        new = np.setdiff1d(reached, seen, assume_unique=True)
        seen = np.union1d(seen, new)
    alive = m.ends[seen // size] & m.ends[seen % size] if len(seen) else np.zeros(0, bool)
    if sources:
        source, target = np.searchsorted(seen, np.concatenate(sources)), np.searchsorted(seen, np.concatenate(targets))
        while True:
            woken = np.unique(source[alive[target] & ~alive[source]])
            if not len(woken):
                break
            alive[woken] = True
    while len(p):
        keep = alive[np.searchsorted(seen, p * size + r)]
        p, r, u, v = p[keep], r[keep], u[keep], v[keep]
        done = m.ends[p] & m.ends[r]
        found.append((u[done], v[done]))
        which, a, b = m.both(p, r)
        p, r, u, v = m.target[a], m.target[b], u[which] + m.before[a], v[which] + m.before[b]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _compose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each word of a part that has near words: how many, and the most frequent of them."""
    back = bool(key[0].as_py())
    group, words, n = (table.column(c).to_pylist() for c in ("c", "word", "n"))
    read = [w[::-1] for w in words] if back else words
    order = sorted(range(len(words)), key=lambda i: (group[i], read[i]))
    group, words, n = np.array(group)[order], [words[i] for i in order], np.array(n)[order]
    length = np.array([len(w) for w in words])
    code = np.frombuffer("".join(read[i] for i in order).encode("utf-32-le"), np.uint32)
    front = group // 2
    u, v = near_pairs(Acceptor(code, np.concatenate(([0], np.cumsum(length))), group), group - front if back else front)
    ok = np.minimum(length[u], length[v]) == group[u]
    if back:  # pairs that agree in the first half are found there
        ids: dict[str, int] = {}
        half = np.array([ids.setdefault(w[:k], len(ids)) for w, k in zip(words, front.tolist())])
        ok &= half[u] != half[v]
    u, v = np.concatenate((u[ok], v[ok])), np.concatenate((v[ok], u[ok]))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((rank[v], -n[v], u))
    u, v = u[by], v[by]
    edge = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    best = v[edge]
    return pa.table({
        "word": pa.array([words[i] for i in u[edge].tolist()], pa.string()), "n_near": pa.array(np.diff(np.append(edge, len(u)))),
        "best_n": pa.array(n[best]), "best": pa.array([words[i] for i in best.tolist()], pa.string()),
    })


def near(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``word, n_near, best, best_n`` of the words that have near words, from distinct ``word, n``: how many, and the one of the largest n,
    of several the first in code-point order."""
    size = F.length("word")
    parts = max(1, -(-2 * words.count() // part_words))
    lengths = F.filter(F.array(size, size - 1), lambda c: c > 0)
    dealt = words.select("word", "n", F.explode(lengths).alias("c"), size.alias("size")).select("word", "n", "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"), "size")
    half = F.floor(F.col("c") / 2).cast("int")
    key = F.when(F.col("back") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", F.col("size") - (F.col("c") - half) + 1, F.col("c") - half))
    dealt = dealt.select("back", F.pmod(F.xxhash64("c", key), F.lit(parts)).alias("part"), "c", "word", "n")
    found = dealt.groupBy("back", "part").applyInArrow(_compose, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (a word has one form, and following forms ends): the last form.  Each round doubles the
    steps that a row has taken; rounds end when no row moves."""
    reached = scratch.keep(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = scratch.keep(reached.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        scratch.drop(reached)
        reached = moved
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, part_words: int = PART_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of distinct ``word, n``."""
    words = scratch.keep(words.select("word", "n"), "words")
    found = words.join(near(words, part_words), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    formed = scratch.keep(found.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
