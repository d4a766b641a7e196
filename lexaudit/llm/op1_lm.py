"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted arrays.

Each order is counted in one pass over the training texts.  A task sorts and
sums its own n-grams with numpy and sends one packed block to each range that it
has n-grams of; the ranges are merged in parallel and written to the shared
folder.  The scoring pass memory-maps those arrays, so that all workers of a
machine share one copy in the page cache.

* Word: 64-bit hash of its lowered bytes; its rank in the sorted hashes is its id.
* n-gram: the id of the first n - 1 words, its context, and the id of the last
  word.  N-grams are sorted by context, then word; the rank is the id.  A range
  holds a run of contexts, so it has all that follows each of them (at most as
  many as there are words), and what a context needs is summed where it lies.
* An n-gram of a lower order counts the different words before it, by one more
  shuffle of the longer n-grams' ends; at the start of a text nothing stands
  before it, and its occurrences count.

Ids take as many bits as they need: no order, vocabulary or number of n-grams is
too large for the arrays.

Defined results: a null text is empty and has the end token alone; a null id
counts as the empty text in the split; equal rows count as often as they occur;
without training rows V and N are 0 and each score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Hash of the token that ends each text; no word hashes to it but by the chance that any two words meet.
END = np.uint64(0x5851F42D4C957F2D)
#: Tokens that a task holds before it sorts and sends or scores them.
FLUSH_TOKENS = 1_000_000
ORDER = 3


@dataclass
class Level:
    """The n-grams of one order."""

    contexts: int  # ids of contexts are under this
    width: int  # contexts in a range
    ranges: int
    size: int = 0  # n-grams
    begin: int = 0  # from this id on they begin with the start of a text
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)


@dataclass
class Model:
    """What workers need to open the arrays; the arrays themselves stay in ``folder``."""

    folder: str
    buckets: int  # hash ranges of words
    order: int = ORDER
    vocab: int = 0
    n_tokens: int = 0
    levels: dict[int, Level] = field(default_factory=dict)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_total: int = 1
    word_gamma: float = 1.0
    stage: int = 0  # of training; a file that one stage misses may be there in the next


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts; halves where a count of counts is missing."""
    if min(n1, n2, n3, n4) <= 0:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)


def _counts_of(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


# --- tokens ------------------------------------------------------------------------------------
def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and end tokens in text order, and the index where each text begins."""
    words, before = C.word_hashes(data, offsets)
    n = len(offsets) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = before[1:] + np.arange(n)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, words
    return out, np.append(0, ends + 1)


def _gathered(batches, column: str):
    """Token arrays of FLUSH_TOKENS or more, and the index of each text's first token with that of the end; a text is never parted."""
    held, firsts, n = [], [], 0
    for batch in batches:
        for _, _, data, offsets in C.chunks(batch.column(column)):
            tokens, begins = _tokens(data, offsets)
            held.append(tokens)
            firsts.append(begins[:-1] + n)
            n += len(tokens)
            if n >= FLUSH_TOKENS:
                yield np.concatenate(held), np.append(np.concatenate(firsts), n)
                held, firsts, n = [], [], 0
    if held:
        yield np.concatenate(held), np.append(np.concatenate(firsts), n)


def _blocks(where: np.ndarray, keys: np.ndarray, counts: np.ndarray, what: int = 0):
    """One row for each range that has keys; ``where`` and, in a range, ``keys`` ascend."""
    edges = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(where)) if len(where) else np.zeros(1, np.int64)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return {
        "bucket": pa.array([int(where[a]) for a, _ in cuts], pa.int64()),
        "what": pa.array([what] * len(cuts), pa.int8()),
        "keys": pa.array([C.pack_sorted(keys[a:b]) for a, b in cuts], pa.binary()),
        "counts": pa.array([C.pack_counts(counts[a:b]) for a, b in cuts], pa.binary()),
    }


_BLOCK = "bucket long, what tinyint, keys binary, counts binary"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of the blocks of one range."""
    keys, counts = ([unpack(x.as_py()) for x in table[name]] for name, unpack in (("keys", C.unpack_sorted), ("counts", C.unpack_counts)))
    return C.summed(np.concatenate(keys), np.concatenate(counts))


# --- the mapped model ----------------------------------------------------------------------------
class _Open:
    """The arrays of a model, mapped into this worker; each file is opened once."""

    def __init__(self, m: Model):
        self.m, self.arrays = m, {}
        self.edges = np.arange(1, m.buckets, dtype=np.uint64) << np.uint64(64 - (m.buckets - 1).bit_length()) if m.buckets > 1 else np.empty(0, np.uint64)

    def array(self, name: str) -> np.ndarray:
        if name not in self.arrays:
            try:
                self.arrays[name] = C.map_array(self.m.folder, name)
            except FileNotFoundError:  # a range that nothing fell into
                self.arrays[name] = np.empty(0, np.uint8)
        return self.arrays[name]

    def small(self, name: str) -> C.Small:
        if name not in self.arrays:
            try:
                self.arrays[name] = C.Small.map(self.m.folder, name)
            except FileNotFoundError:
                self.arrays[name] = C.Small(np.empty(0, np.uint8))
        return self.arrays[name]

    def ids(self, unique: np.ndarray) -> np.ndarray:
        """Ids of ascending word hashes; -1 for unknown ones."""
        out, starts = np.full(len(unique), -1, np.int64), self.array("word-starts")
        cuts = [0, *np.searchsorted(unique, self.edges).tolist(), len(unique)]
        for i in range(self.m.buckets):
            a, b = cuts[i], cuts[i + 1]
            if a < b and len(arr := self.array(f"word-{i}.key")):
                at = np.minimum(np.searchsorted(arr, unique[a:b]), len(arr) - 1)
                out[a:b] = np.where(arr[at] == unique[a:b], at + int(starts[i]), -1)
        return out

    def of_words(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of a per-word array."""
        out, starts = np.zeros(len(ids), np.int64), self.array("word-starts").astype(np.int64)
        where = np.searchsorted(starts, ids, "right") - 1
        for i in np.unique(where).tolist():
            mine = where == i
            out[mine] = self.small(f"{name}-{i}")[ids[mine] - starts[i]]
        return out

    def each_range(self, k: int, contexts: np.ndarray):
        """(range, which of the contexts fall into it, their places in it)."""
        width = self.m.levels[k].width
        where = contexts // width
        for j in np.unique(where).tolist():
            mine = np.flatnonzero(where == j) if self.m.levels[k].ranges > 1 else np.arange(len(contexts))
            yield j, mine, contexts[mine] - j * width

    def find(self, k: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of n-grams; -1 and 0 for those that are not there. Contexts and words are ids."""
        ids, counts, starts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64), self.array(f"{k}-starts")
        for j, mine, local in self.each_range(k, contexts):
            begins, last = self.array(f"{k}-from-{j}"), self.array(f"{k}-word-{j}")
            if not len(last):
                continue
            low, end, wanted = begins[local].astype(np.int64), begins[local + 1].astype(np.int64), words[mine]
            at = lambda places: last[places].astype(np.int64)  # noqa: E731, B023
            # ids are ranks of hashes, so a word stands about where its id says: the search begins around there
            size = end - low
            guess = low + (size * (wanted / (self.m.vocab + 1))).astype(np.int64)
            reach = 2 * np.sqrt(size).astype(np.int64) + 2
            left, right = np.maximum(low, guess - reach), np.minimum(end, guess + reach)
            before = np.flatnonzero((left > low) & (left < end))
            before = before[at(left[before] - 1) >= wanted[before]]
            right[before], left[before] = left[before], low[before]
            after = np.flatnonzero((right < end) & (right > low))
            after = after[at(right[after]) < wanted[after]]
            left[after], right[after] = right[after] + 1, end[after]
            low, high = left, np.maximum(left, right)
            live = np.flatnonzero(low < high)
            while len(live):
                a, b = low[live], high[live]
                mid = (a + b) >> 1
                under = at(mid) < wanted[live]
                low[live] = a = np.where(under, mid + 1, a)
                high[live] = b = np.where(under, b, mid)
                live = live[a < b]
            hit = np.flatnonzero(low < end)
            hit = hit[last[low[hit]].astype(np.int64) == wanted[hit]]
            ids[mine[hit]] = low[hit] + int(starts[j])
            if len(own := self.small(f"{k}-count-{j}")):
                counts[mine[hit]] = own[low[hit]]
        return ids, counts

    def following(self, k: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each context the total of what follows it, and the weight that its discounts leave to the shorter context."""
        total, gamma, d = np.zeros(len(contexts), np.int64), np.ones(len(contexts)), self.m.levels[k].discounts
        for j, mine, local in self.each_range(k, contexts):
            if not len(all_of := self.small(f"{k}-total-{j}")):
                continue
            begins, one, two = self.array(f"{k}-from-{j}"), self.small(f"{k}-one-{j}")[local], self.small(f"{k}-two-{j}")[local]
            more = begins[local + 1].astype(np.int64) - begins[local].astype(np.int64) - one - two
            own = all_of[local]
            total[mine] = own
            gamma[mine] = np.where(own > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(own, 1), 1.0)
        return total, gamma


_opened: dict[tuple[str, int], _Open] = {}


def _open(m: Model) -> _Open:
    key = (m.folder, m.stage)
    if key not in _opened:
        _opened.clear()
        _opened[key] = _Open(m)
    return _opened[key]


def _grams(m: Model, opened: _Open, tokens: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its word id, the id of its context of k - 1 words (-1 for none), and its place in its text. Orders under k must be there."""
    unique, at = np.unique(tokens, return_inverse=True)
    ids = opened.ids(unique)[at]
    place = np.arange(len(tokens)) - np.repeat(firsts[:-1], np.diff(firsts))
    context = _before(ids, firsts, m.vocab)
    for level in range(2, k):
        context = _before(_of_all(len(ids), *_found(opened, level, context, ids)[:2]), firsts, -1)
    return ids, context, place


def _of_all(n: int, some: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(n, -1, np.int64)
    out[some] = values
    return out


def _before(values: np.ndarray, firsts: np.ndarray, start: int) -> np.ndarray:
    """The value of the token before; ``start`` for the first token of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[firsts[:-1]] = start
    return out


def _found(opened: _Open, k: int, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens with a context, the ids and counts of their k-grams, and the different contexts with each token's place among them.

    Each different k-gram is looked for once, in the order in which the arrays have them.
    """
    some, step = np.flatnonzero(context >= 0), opened.m.vocab + 1
    own, last = context[some], np.where(ids[some] >= 0, ids[some], opened.m.vocab)  # no word has the id V
    if opened.m.levels[k].contexts * step < 1 << 62:
        keys, back = np.unique(own * step + last, return_inverse=True)
        own, last = keys // step, keys % step
    else:
        order = np.lexsort([last, own])
        own, last, back = own[order], last[order], np.argsort(order)
    gram, count = opened.find(k, own, last)
    new = np.append(True, own[1:] != own[:-1]) if len(own) else np.empty(0, bool)
    return some, gram[back], count[back], own[new], (np.cumsum(new) - 1)[back]


# --- training ------------------------------------------------------------------------------------
def train(docs: DataFrame, text_col: str = "text", buckets: int | None = None, order: int = ORDER) -> Model:
    """Count ``docs`` and write the model to the shared folder.

    buckets: ranges of each order, a power of two; by default it follows the partitions of the input, so that a
    range holds about as many n-grams as half a partition of the input.
    """
    spark = docs.sparkSession
    texts = docs.select(C.text_bytes(text_col).alias("t"))
    b = C.power_of_two(buckets or max(8, 2 * C.scan_parts(texts)))
    m = Model(C.new_folder(spark, "lm"), b, order)
    folder, shift = m.folder, np.uint64(64 - (b - 1).bit_length()) if b > 1 else None

    def words(batches):
        for tokens, _ in _gathered(batches, "t"):
            keys, counts = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_pydict(_blocks((keys >> shift).astype(np.int64) if b > 1 else np.zeros(len(keys), np.int64), keys, counts))

    def merge_words(key, table):
        (keys, counts), i = _merged(table), key[0].as_py()
        C.put_array(folder, f"word-{i}.key", keys)
        C.Small.put(folder, f"word-{i}", counts)
        return pa.table({"bucket": pa.array([i], pa.int64()), "n": [len(keys)], "total": [int(counts.sum())]})

    rows = C.few_rows(texts.mapInArrow(words, _BLOCK).groupBy("bucket").applyInArrow(merge_words, "bucket long, n long, total long"))
    sizes = np.zeros(b, np.int64)
    for r in rows:
        sizes[r.bucket] = r.n
        m.n_tokens += r.total
    if not m.n_tokens:
        return m
    m.vocab = int(sizes.sum())
    C.put_array(folder, "word-starts", np.cumsum(np.append(0, sizes))[:-1])
    for k in range(2, order + 1):
        _count_level(m, texts, k)
        m.stage += 1
    for k in range(order, 1, -1):
        _add_up(m, spark, k)
        m.stage += 1
    if order > 2:
        C.drop(spark, f"{folder}/raw")
    return m


def _count_level(m: Model, texts: DataFrame, k: int) -> None:
    """Count the k-grams and write their arrays: from (where each context begins), word, and how often each occurs."""
    contexts = m.vocab + 1 if k == 2 else m.levels[k - 1].size
    step = m.vocab + 1
    # so many ranges that a place in a range fits into 62 bits
    ranges = min(contexts, max(m.buckets, -(-contexts * step >> 62)))
    width = -(-contexts // ranges)
    ranges, folder = -(-contexts // width), m.folder
    one_key = contexts * step < 1 << 62

    def grams(batches):
        opened = _open(m)
        for tokens, firsts in _gathered(batches, "t"):
            ids, context, place = _grams(m, opened, tokens, firsts, k)
            own = np.flatnonzero(place >= k - 2)
            context, ids = context[own], ids[own]
            if one_key:
                keys, counts = np.unique(context * step + ids, return_counts=True)
                context = keys // step
                where = context // width
                local = keys - where * (width * step)
            else:
                order = np.lexsort([ids, context])
                context, ids = context[order], ids[order]
                new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
                counts = np.diff(np.append(new, len(ids)))
                context, ids = context[new], ids[new]
                where = context // width
                local = (context - where * width) * step + ids
            yield pa.RecordBatch.from_pydict(_blocks(where, local.astype(np.uint64), counts))

    def merge(key, table):
        (keys, counts), j = _merged(table), key[0].as_py()
        own = min(width, contexts - j * width)
        context, last = (keys // np.uint64(step)).astype(np.int64), keys % np.uint64(step)
        C.put_array(folder, f"{k}-from-{j}", np.searchsorted(context, np.arange(own + 1)))
        C.put_array(folder, f"{k}-word-{j}", last)
        C.Small.put(*((folder, f"{k}-count-{j}") if k == m.order else (f"{folder}/raw", f"{k}-{j}")), counts)
        lower = 0 if k > 2 else int(np.count_nonzero(context + j * width < m.vocab))
        if k > 2:
            lower = int(np.count_nonzero(context + j * width < m.levels[k - 1].begin))
        return pa.table({"bucket": pa.array([j], pa.int64()), "n": [len(keys)], "lower": [lower]})

    rows = C.few_rows(texts.mapInArrow(grams, _BLOCK).groupBy("bucket").applyInArrow(merge, "bucket long, n long, lower long"))
    sizes = np.zeros(ranges, np.int64)
    for r in rows:
        sizes[r.bucket] = r.n
    C.put_array(folder, f"{k}-starts", np.cumsum(np.append(0, sizes))[:-1])
    m.levels[k] = Level(contexts, width, ranges, int(sizes.sum()), sum(r.lower for r in rows))


def _add_up(m: Model, spark, k: int) -> None:
    """Finish order k, whose counts are known by now, and count for order k - 1 the different words before each of its n-grams."""
    level, folder = m.levels[k], m.folder
    below = m.levels.get(k - 1)

    def finish(batches):
        opened = _open(m)
        for batch in batches:
            for j in batch.column("j").to_pylist():
                begins, last = (opened.array(f"{k}-{x}-{j}") for x in ("from", "word"))
                if not len(begins):
                    continue
                counts, begins = opened.small(f"{k}-count-{j}").all(), begins.astype(np.int64)
                sums = lambda x: np.diff(np.append(0, np.cumsum(x))[begins])  # noqa: E731, B023
                for name, x in (("total", counts), ("one", counts == 1), ("two", counts == 2)):
                    C.Small.put(folder, f"{k}-{name}-{j}", sums(x))
                stats = [_counts_of(counts)]
                # the n-gram without its first word
                tail = last.astype(np.int64)
                if k > 2:
                    context = np.repeat(_suffix_context(m, opened, k - 1, np.arange(len(begins) - 1) + j * level.width), np.diff(begins))
                    if below.contexts * (m.vocab + 1) < 1 << 62:
                        pairs, n = np.unique(context * (m.vocab + 1) + tail, return_counts=True)  # in the order of ids
                        keys = opened.find(k - 1, pairs // (m.vocab + 1), pairs % (m.vocab + 1))[0]
                    else:
                        keys, n = np.unique(opened.find(k - 1, context, tail)[0], return_counts=True)
                else:
                    keys, n = np.unique(tail, return_counts=True)
                starts = opened.array("word-starts" if k == 2 else f"{k - 1}-starts").astype(np.int64)
                where = np.searchsorted(starts, keys, "right") - 1
                out = _blocks(where, (keys - starts[where]).astype(np.uint64), n)
                out["stats"] = pa.array(stats + [None] * (len(out["bucket"]) - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    def merge(key, table):
        (at, n), i = _merged(table), key[0].as_py()
        if k == 2:
            size, raw = len(C.map_array(folder, f"word-{i}.key")), None
        else:
            raw = C.Small.map(f"{folder}/raw", f"{k - 1}-{i}").all()
            size = len(raw)
        counts = np.zeros(size, np.int64)
        counts[at.astype(np.int64)] = n
        if k > 2:
            start = int(C.map_array(folder, f"{k - 1}-starts")[i])
            alone = max(0, min(size, below.begin - start))
            counts[alone:] = raw[alone:]
        C.Small.put(folder, f"cont-{i}" if k == 2 else f"{k - 1}-count-{i}", counts)
        stats = [s for s in table["stats"].to_pylist() if s is not None]
        return pa.table({"stats": [np.sum([*stats, [0] * 4], axis=0).tolist()], "of": [[*_counts_of(counts), int(counts.sum()), int(np.count_nonzero(counts > 2))]]}, schema=pa.schema([("stats", pa.list_(pa.int64())), ("of", pa.list_(pa.int64()))]))

    ranges = spark.range(0, level.ranges, 1, min(level.ranges, 4096)).withColumnRenamed("id", "j")
    rows = C.few_rows(ranges.mapInArrow(finish, _BLOCK + ", stats array<long>").groupBy("bucket").applyInArrow(merge, "stats array<long>, of array<long>"))
    level.discounts = discounts(*np.sum([r.stats for r in rows], axis=0).tolist())
    if k == 2:
        n1, n2, n3, n4, total, more = np.sum([r.of for r in rows], axis=0).tolist()
        m.word_discounts, m.word_total = discounts(n1, n2, n3, n4), total
        m.word_gamma = (m.word_discounts[0] * n1 + m.word_discounts[1] * n2 + m.word_discounts[2] * more) / total


def _suffix_context(m: Model, opened: _Open, k: int, grams: np.ndarray) -> np.ndarray:
    """The context, one order down, that the last k - 1 words of k-grams are: for a bigram its last word."""
    starts = opened.array(f"{k}-starts").astype(np.int64)
    where = np.searchsorted(starts, grams, "right") - 1
    last = np.empty(len(grams), np.int64)
    context = np.empty(len(grams), np.int64)
    for j in np.unique(where).tolist():
        mine = where == j
        local = grams[mine] - starts[j]
        last[mine] = opened.array(f"{k}-word-{j}")[local]
        context[mine] = np.searchsorted(opened.array(f"{k}-from-{j}"), local, "right") - 1 + j * m.levels[k].width
    if k == 2:
        return last
    return opened.find(k - 1, _suffix_context(m, opened, k - 1, context), last)[0]


# --- scoring -------------------------------------------------------------------------------------
def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def _score_tokens(m: Model, opened: _Open, tokens: np.ndarray, firsts: np.ndarray):
    """For each token: its training count, and log10 of the model's probability."""
    if not m.n_tokens:
        return np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
    unique, at = np.unique(tokens, return_inverse=True)
    word = opened.ids(unique)
    known = np.flatnonzero(word >= 0)
    count, before = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    count[known], before[known] = opened.of_words("word", word[known]), opened.of_words("cont", word[known])
    p = (_discounted(before, m.word_discounts) / m.word_total + m.word_gamma / (m.vocab + 1))[at]
    ids = word[at]
    context = _before(ids, firsts, m.vocab)
    for k in range(2, m.order + 1):
        some, gram, seen, contexts, back = _found(opened, k, context, ids)
        total, gamma = opened.following(k, contexts)
        p[some] = _discounted(seen, m.levels[k].discounts) / np.maximum(total, 1)[back] + gamma[back] * p[some]
        if k < m.order:
            context = _before(_of_all(len(ids), some, gram), firsts, -1)
    return count[at], np.log10(p)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep``, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    chosen = docs.select(id_col, *keep, C.text_bytes(text_col).alias("__text"))
    kept = [id_col, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        opened = _open(model) if model.n_tokens else None
        n_all, v = model.n_tokens, model.vocab
        for batch in batches:
            parts = []
            for tokens, firsts in _gathered([batch], "__text"):
                count, logp = _score_tokens(model, opened, tokens, firsts)
                base = np.log10((count + 1) / (n_all + v + 1))
                parts.append([np.diff(firsts), *(np.add.reduceat(x, firsts[:-1]) for x in ((count > 0).astype(np.int64), base, logp))])
            if not parts:
                continue
            n, n_known, base, logp = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n), pa.array(n_known), pa.array(np.full(len(n), n_all, np.int64)), pa.array(base), pa.array(logp), pa.array(10 ** (-logp / n))],
                names=[*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return chosen.mapInArrow(run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def lm_scores(docs: DataFrame, fold: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Learn from the rows outside the held-out fold and score all rows."""
    split = docs.select(id_col, text_col, (C.id_bucket(id_col, fold) == held).alias("held_out"))
    model = train(split.filter(~F.col("held_out")), text_col, order=order)
    return score(split, model, id_col, text_col, ("held_out",))
