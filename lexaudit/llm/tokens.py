"""Whole texts to token ids with a byte-level BPE file of the ``tokenizers`` library.

A text of single spaces and line ends is cut in front of each space and around
each line end: the file's splitting pattern cuts there too, and merges never
cross such a cut.  The parts of a chunk of texts are hashed together; each
distinct part that the worker has not met goes through the BPE once (by
tiktoken, from the vocabulary in the same file: its ids are merge ranks; tests
hold the ids against the ``tokenizers`` library), and the ids of the chunk are
put together from there.  A text with other white space is encoded as it is.
The file's added tokens are found in a text before all else, as the library does
by default: they get their own ids, and what stands between them is encoded.
"""

from __future__ import annotations

import json
import re

import numpy as np

from . import common as C

#: The splitting pattern of the file's byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct parts remembered by a worker.
CACHE = 250_000

def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _other_space(d: np.ndarray) -> np.ndarray:
    """Where a white-space character other than space and line end begins, in UTF-8 bytes."""
    n = np.append(d[1:], np.zeros(1, np.uint8))
    m = np.append(d[2:], np.zeros(2, np.uint8))[: len(d)]
    out = ((d >= 9) & (d <= 13) & (d != 10)) | ((d >= 28) & (d <= 31))
    out |= (d == 0xC2) & ((n == 0x85) | (n == 0xA0))
    out |= (d == 0xE1) & (n == 0x9A) & (m == 0x80)
    out |= (d == 0xE2) & (((n == 0x80) & ((m <= 0x8A) | (m == 0xA8) | (m == 0xA9) | (m == 0xAF))) | ((n == 0x81) & (m == 0x9F)))
    return out | ((d == 0xE3) & (n == 0x80) & (m == 0x80))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the runs [start, start + length), one after another."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.empty(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - total + lengths, lengths)


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if odd := [x["content"] for x in spec.get("added_tokens", []) if x.get("lstrip") or x.get("rstrip") or x.get("single_word")]:
            raise ValueError(f"added tokens that take in what is beside them are not known here: {odd}")
        self.special = {k.encode(): np.array([i], np.uint32) for k, i in special.items() if k}
        # the leftmost one counts, and of those the longest
        self.find_special = re.compile(b"(" + b"|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        own = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bpe = lambda text: own.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.line_end = ranks[b"\n"]
        self._forget()

    def _forget(self):
        self.known: dict[int, int] = {}
        self.flat, self.at, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode_parts(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Remember the ids of new distinct parts; returns the place of each.

        Parts with a leading space are joined, and a token with a leading space begins each; others are joined by line ends.
        """
        head, alone = np.frombuffer(raw, np.uint8)[starts], ends - starts == 1
        white = ((head == 32) & alone) | (head == 10)
        place = np.empty(len(starts), np.int64)
        flats, lengths, n = [self.flat], [self.length], len(self.at)
        for kind, mine in enumerate((np.flatnonzero(white), np.flatnonzero((head == 32) & ~alone), np.flatnonzero((head != 32) & (head != 10)))):
            if not len(mine):
                continue
            place[mine] = np.arange(len(mine)) + n
            n += len(mine)
            parts = [raw[a:b] for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]
            if kind == 0:
                ids = [self.bpe(p.decode()) for p in parts]
                flats.extend(ids)
                lengths.append(np.array([len(x) for x in ids], np.int64))
            elif kind == 1:
                ids = self.bpe(b"".join(parts).decode())
                flats.append(ids)
                lengths.append(np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids))))
            else:
                ids = self.bpe(b"\n".join(parts).decode())
                breaks = ids == self.line_end
                flats.append(ids[~breaks])
                lengths.append(np.diff(np.concatenate([[-1], np.flatnonzero(breaks), [len(ids)]])) - 1)
        self.flat, self.length = np.concatenate(flats), np.concatenate(lengths)
        self.at = np.cumsum(self.length) - self.length
        return place

    def _whole(self, text: bytes) -> np.ndarray:
        """Ids of a text that is encoded as it is, or around the added tokens that it holds."""
        parts = self.find_special.split(text) if self.find_special else [text]
        return np.concatenate([np.empty(0, np.uint32), *(self.special[x] if k % 2 else self.bpe(x.decode()) for k, x in enumerate(parts) if x)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, one after another, and where each text's ids begin and end."""
        n = len(offsets) - 1
        space = (data == 32) | (data == 10)
        text_start = np.zeros(len(data) + 1, bool)
        text_start[offsets] = True
        odd = _other_space(data)
        odd[1:] |= space[1:] & space[:-1] & ~text_start[1:-1]
        plain = np.ones(n, bool)
        plain[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = False
        if self.find_special:
            held = [m.start() for m in self.find_special.finditer(data.tobytes())]
            plain[np.searchsorted(offsets, np.array(held, np.int64), "right") - 1] = False
        head = space.copy()
        head[1:] |= data[:-1] == 10
        head |= text_start[:-1]
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(data))
        of = np.searchsorted(offsets, starts, "right") - 1
        starts, ends, of = starts[plain[of]], ends[plain[of]], of[plain[of]]
        sizes = np.zeros(n, np.int64)
        flat = np.empty(0, np.uint32)
        if len(starts):
            unique, first, at = np.unique(C.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            if len(self.known) + len(unique) > CACHE and len(self.known) > CACHE // 2:
                self._forget()
            place = np.array([self.known.get(h, -1) for h in unique.tolist()], np.int64)
            new = np.flatnonzero(place < 0)
            if len(new):
                place[new] = self._encode_parts(data.tobytes(), starts[first[new]], ends[first[new]])
                self.known.update(zip(unique[new].tolist(), place[new].tolist(), strict=True))
            place = place[at]
            flat = self.flat[_ragged(self.at[place], self.length[place])]
            np.add.at(sizes, of, self.length[place])
        cuts = np.append(0, np.cumsum(sizes))
        if plain.all():
            return flat, cuts
        parts = [flat[cuts[i] : cuts[i + 1]] if plain[i] else self._whole(bytes(data[offsets[i] : offsets[i + 1]])) for i in range(n)]
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
