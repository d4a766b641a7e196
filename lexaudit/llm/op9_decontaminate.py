"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Normal form: A-Z lowered, words of digits, letters and non-ASCII characters.
The automaton's letters are words, and its patterns are every run of ``window``
words of every item (an item of fewer words, but not none, is one run).  A state
is a run of words that some pattern begins with, known by a 64-bit hash that the
next word takes on to the next state, so the goto function is a search in the
sorted states of the next depth; a terminal state has the list of its items.

Spark builds the automaton once: each task makes the states of its items, hash
ranges are merged in parallel, and each is written to the shared folder as
sorted arrays.  Workers map those arrays into memory, so that neither the driver
nor a worker holds the benchmark, however large it is.  A text is scanned once:
all its words start at the root together and those that still follow a pattern
go on one word at a time (the failureless form, in which a word that starts anew
takes the place of a failure link).  Hits are word numbers; they are mapped to
character offsets of the original text.

Defined results: null texts and items have no words; items without an id are
left out, for they could not be named; an id that occurs twice is one item;
without items nothing is hit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Byte by byte: A-Z to a-z; digits, letters and the bytes of non-ASCII characters stay; all else parts words.
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_IS_WORD = _NORMAL != 32


@dataclass
class Automaton:
    """What workers need to open the arrays; the arrays themselves stay in ``folder``."""

    folder: str
    ranges: int
    window: int
    depths: list[int]  # depths at which a pattern ends


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of some texts, and the words before each text."""
    starts, ends, before = C.word_spans(data, offsets, _IS_WORD)
    return C.span_hashes(_NORMAL[data], starts, ends), starts, ends, before


def _goto(states: np.ndarray, words: np.ndarray) -> np.ndarray:
    return C.mix64(states * np.uint64(0x9E3779B97F4A7C15) + words)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (ranges - 1).bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)


# --- building ----------------------------------------------------------------------------------------
def _states(batches, window: int, ranges: int):
    """(range, depth, keys, items) of the states of some items; depth 0: terminal states, one entry for each of their items."""
    for batch in batches:
        for a, b, data, offsets in C.chunks(batch.column("text")):
            w, _, _, before = _words(data, offsets)
            item = batch.column("item").slice(a, b - a).to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(before)
            n_starts = np.where(size > 0, np.maximum(1, size - window + 1), 0)
            of = np.repeat(np.arange(b - a), n_starts)
            start = np.arange(len(of)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + before[of]
            length, state = np.minimum(size[of], window), w[start]
            out = []
            for depth in range(1, window + 1):
                out.append((depth, np.unique(state), None))
                ends = length == depth
                if ends.any():
                    pairs = np.unique(np.stack([state[ends], item[of[ends]]], 1), axis=0)
                    out.append((0, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])))
                    out.append((-depth, np.empty(1, np.uint64), None))
                start, of, length, state = (x[~ends] for x in (start, of, length, state))
                if not len(state):
                    break
                state = _goto(state, w[start + depth])
            rows = {"range": [], "depth": [], "keys": [], "items": []}
            for depth, keys, items in out:
                where = _range_of(keys, ranges) if depth >= 0 else np.zeros(1, np.int64)
                for r in np.unique(where):
                    mine = where == r
                    for name, x in zip(rows, (int(r), depth, keys[mine].tobytes() if depth >= 0 else b"", items[mine].tobytes() if items is not None else b""), strict=True):
                        rows[name].append(x)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("range", pa.int32()), ("depth", pa.int32()), ("keys", pa.binary()), ("items", pa.binary())]))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ascending keys, and where each begins (with the end)."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.append(new, len(keys))


def build(benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text", range_bytes: int = 4 << 20) -> Automaton:
    """Write the automaton of all items to the shared folder, in hash ranges for about ``range_bytes`` of text each."""
    rows = benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text")).withColumn("item", F.xxhash64("name"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = C.power_of_two(-(-total // range_bytes))
    folder = C.new_folder(benchmark.sparkSession, "automaton")

    def merge(key, table):
        i, depth = key[0].as_py(), table["depth"].to_numpy()
        read = lambda name, k: np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_py(), np.uint64) for x in table[name].filter(pa.array(depth == k)))])
        for k in range(1, window + 1):
            C.put_file(folder, f"depth-{k}-{i}", np.unique(read("keys", k)).astype("<u8").tobytes())
        keys, items = read("keys", 0), read("items", 0)
        order = np.lexsort([items, keys])
        keys, items = keys[order], items[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])) if len(keys) else np.empty(0, bool)
        keys, items = keys[new], items[new]
        of, at = _runs(keys)
        for name, x in (("key", of), ("from", at), ("item", items)):
            C.put_file(folder, f"end-{name}-{i}", x.astype("<u8").tobytes())
        return pa.table({"depths": [sorted({-int(d) for d in depth if d < 0})]}, schema=pa.schema([("depths", pa.list_(pa.int32()))]))

    def merge_names(key, table):
        i, order = key[0].as_py(), np.argsort(table["item"].to_numpy().view(np.uint64))
        names = [table["name"][int(k)].as_py().encode() for k in order]
        C.put_file(folder, f"name-key-{i}", table["item"].to_numpy().view(np.uint64)[order].astype("<u8").tobytes())
        C.put_file(folder, f"name-from-{i}", np.cumsum([0, *map(len, names)]).astype("<u8").tobytes())
        C.put_file(folder, f"name-text-{i}", b"".join(names))
        return pa.table({"n": pa.array([len(names)], pa.int64())})

    found = C.few_rows(rows.mapInArrow(lambda b: _states(b, window, ranges), "range int, depth int, keys binary, items binary").groupBy("range").applyInArrow(merge, "depths array<int>"))
    top = F.shiftrightunsigned("item", 64 - (ranges - 1).bit_length()).cast("int") if ranges > 1 else F.lit(0)
    C.few_rows(rows.select("item", "name").distinct().groupBy(top.alias("range")).applyInArrow(merge_names, "n long"))
    return Automaton(folder, ranges, window, sorted({d for r in found for d in r.depths}))


# --- scanning ----------------------------------------------------------------------------------------
class _Open:
    """The arrays of an automaton, mapped into this worker."""

    def __init__(self, m: Automaton):
        self.m = m
        self.arrays: dict[str, np.ndarray] = {}

    def array(self, name: str, kind: str = "<u8") -> np.ndarray:
        if name not in self.arrays:
            try:
                self.arrays[name] = C.map_file(self.m.folder, name, kind)
            except FileNotFoundError:  # a range without states
                self.arrays[name] = np.empty(0, kind)
        return self.arrays[name]

    def find(self, prefix: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range and place of each key in the sorted arrays ``prefix``, and which keys are there."""
        where, at, there = _range_of(keys, self.m.ranges), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for r in np.unique(where).tolist() if self.m.ranges > 1 else [0]:
            arr = self.array(f"{prefix}-{r}")
            if len(arr):
                mine = np.flatnonzero(where == r) if self.m.ranges > 1 else slice(None)
                k = keys[mine]
                p = np.minimum(np.searchsorted(arr, k), len(arr) - 1)
                at[mine], there[mine] = p, arr[p] == k
        return where, at, there

    def names(self, items: np.ndarray) -> list[str]:
        where, at, _ = self.find("name-key", items)
        out = []
        for r, k in zip(where.tolist(), at.tolist(), strict=True):
            begins = self.array(f"name-from-{r}")
            out.append(self.array(f"name-text-{r}", "u1")[int(begins[k]) : int(begins[k + 1])].tobytes().decode())
        return sorted(out)


_opened: dict[str, _Open] = {}


def _open(m: Automaton) -> _Open:
    if m.folder not in _opened:
        _opened.clear()
        _opened[m.folder] = _Open(m)
    return _opened[m.folder]


def _hits(m: Automaton, opened: _Open, w: np.ndarray, left: np.ndarray):
    """(first word, number of words, range and place of the terminal state) of every pattern in the texts; left: words of its text from each word on."""
    at, state = np.arange(len(w)), w
    out = []
    for depth in range(1, max(m.depths, default=0) + 1):
        known = opened.find(f"depth-{depth}", state)[2]
        at, state = at[known], state[known]
        if depth in m.depths and len(at):
            where, place, ends = opened.find("end-key", state)
            out.append((at[ends], np.full(int(ends.sum()), depth), where[ends], place[ends]))
        on = left[at] > depth
        at, state = at[on], state[on]
        if not len(at):
            break
        state = _goto(state, w[at + depth])
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(m: Automaton, opened: _Open, data: np.ndarray, offsets: np.ndarray):
    """For each text: words, hit words, names of the items found, and spans of hit words in code points."""
    w, starts, ends, before = _words(data, offsets)
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(before))
    first, size, where, place = _hits(m, opened, w, before[text_of + 1] - np.arange(len(w)))
    items: list[list[str]] = [[] for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    n_hit = np.zeros(n, np.int64)
    if len(first):
        cover = np.bincount(first, minlength=len(w) + 1) - np.bincount(first + size, minlength=len(w) + 1)
        hit = np.cumsum(cover)[: len(w)] > 0
        np.add.at(n_hit, text_of[hit], 1)
        # runs of hit words, never across texts
        a, b = hit.copy(), hit.copy()
        a[1:] &= ~hit[:-1] | (text_of[1:] != text_of[:-1])
        b[:-1] &= ~hit[1:] | (text_of[1:] != text_of[:-1])
        point = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        for i, j in zip(np.flatnonzero(a).tolist(), np.flatnonzero(b).tolist(), strict=True):
            zero = point[offsets[text_of[i]]]
            spans[text_of[i]].append({"start": int(point[starts[i]] - zero), "end": int(point[ends[j]] - zero)})
        # a terminal state has its items once, however often a text meets it
        met = np.unique(np.stack([text_of[first], where, place], 1), axis=0)
        for t in np.unique(met[:, 0]).tolist():
            found = [opened.array(f"end-item-{r}")[int(opened.array(f"end-from-{r}")[k]) : int(opened.array(f"end-from-{r}")[k + 1])] for _, r, k in met[met[:, 0] == t].tolist()]
            items[t] = opened.names(np.unique(np.concatenate(found)))
    return np.diff(before), n_hit, items, spans


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    range_bytes: int = 4 << 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep``, n_words, n_hit, n_items, items, spans (original code-point offsets), contaminated."""
    m = build(benchmark, window, item_col, item_text_col, range_bytes)
    chosen = docs.select(id_col, *[c for c in keep if c != id_col], C.text_bytes(text_col).alias("__text"))
    kept = chosen.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        opened = _open(m)
        for batch in batches:
            parts = [_scan(m, opened, data, offsets) for _, _, data, offsets in C.chunks(batch.column("__text"))]
            if not parts:
                continue
            n_words, n_hit = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            items, spans = ([x for p in parts for x in p[k]] for k in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(n_hit > 0),
                ],
                names=[*kept, "n_words", "n_hit", "n_items", "items", "spans", "contaminated"],
            )

    return chosen.mapInArrow(run, f"{schema}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean")
