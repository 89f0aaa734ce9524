"""Token ids from a public tokenizer file, with a memo of pieces.

A text is cut where the tokenizer itself never joins, each distinct piece is encoded once a worker, and ids
are gathered with numpy. Ids equal those of encoding the whole text:

- ``space`` (byte-level BPE whose pre-tokenizer puts one leading space to the next word): a single space
  between two characters that are no white space always begins a new pre-token, a line feed between such is one,
  and letters before an ASCII sign end one. numpy cuts the bytes of many texts there at once and looks up all
  pieces, by the bytes themselves;
- ``word`` (white space is dropped): pre-tokens never cross a space or a line feed;
- ``text``: no cutting, for any other tokenizer.
"""

from __future__ import annotations

import os

import numpy as np

#: Distinct pieces that a worker remembers at most, if not told otherwise; beyond, it forgets those that came up once.
MEMO_PIECES = 700_000
#: Bytes of text to encode at a time: new pieces are learned once for each.
ENCODE_BYTES = 2 << 20
#: A character that is a pre-token of its own; pieces that hold it are encoded one by one.
_MARK = "\0"
#: Pieces that one numpy pass looks up.
_PASS = 1 << 18
#: Bytes of a piece that is looked up by numpy; longer ones are kept in a dict.
_SHORT = 16
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SPACE, _LINE_FEED = 0x20, 0x0A
#: By byte: no ASCII white space, nor one of the separators that some take for it.
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
#: By byte: ASCII letters, ASCII signs.
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _solid(x: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are of no white space."""
    out = _SOLID[x]
    lead = np.flatnonzero((x == 0xC2) | ((x >= 0xE1) & (x <= 0xE3)))
    a, b, c = x[lead], *(x[np.minimum(lead + i, len(x) - 1)] for i in (1, 2))
    two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    three = lead[(a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)]
    for at in (two, two + 1, three, three + 1, three + 2):
        out[at] = False
    return out


def _begins(x: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Which bytes surely begin a pre-token, but for the first of a text."""
    out = np.zeros(len(x), bool)
    between = np.zeros(len(x), bool)
    between[1:-1] = solid[:-2] & solid[2:]
    line = between & (x == _LINE_FEED)
    out |= between & (x == _SPACE) | line
    out[1:] |= line[:-1]
    letter = _LETTER[x]
    letter[1:] |= (x[:-1] == 0xC3) & (x[1:] != 0x97) & (x[1:] != 0xB7)  # Latin-1 letters end here
    out[1:] |= letter[:-1] & _SIGN[x[1:]]
    return out


class _Numbers:
    """Numbers of short byte strings, given as two words and a length: an open hash table."""

    def __init__(self, room: int):
        self.bits, self.count = (2 * room).bit_length(), 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high, self.length = np.zeros(room, np.uint64), np.zeros(room, np.uint64), np.zeros(room, np.uint8)

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each string; new ones get the next numbers."""
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + length.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        slot, todo, out = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(low)), np.empty(len(low), np.int64)
        while len(todo):
            at = self.slots[slot]
            free = np.flatnonzero(at < 0)
            if len(free):  # of several strings that want a slot the last one written gets it
                self.slots[slot[free]] = free
                won = free[self.slots[slot[free]] == free]
                new = self.count + np.arange(len(won))
                self.slots[slot[won]] = new
                self.low[new], self.high[new], self.length[new] = low[todo[won]], high[todo[won]], length[todo[won]]
                self.count += len(won)
                at[free] = self.slots[slot[free]]
            same = (self.low[at] == low[todo]) & (self.high[at] == high[todo]) & (self.length[at] == length[todo])
            out[todo[same]] = at[same]
            todo, slot = todo[~same], (slot[~same] + 1) & ((1 << self.bits) - 1)
        return out


class _Memo(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, piece) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class Encoder:
    def __init__(self, path: str, unit: str, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.unit, self.most = unit, most or MEMO_PIECES

        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # byte-level tokens have a character a byte
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.memo, self.flat = _Memo(), np.empty(0, np.uint32)
        self.begin, self.size, self.used = (np.empty(0, np.int64) for _ in range(3))
        if unit == "space":
            self.numbers, self.long = _Numbers(self.most + _PASS), {}

    def _kept(self) -> np.ndarray:
        """Numbers of the pieces that came up again, of the most frequent ones if they are many."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: self.most // 2]])
        return keep

    def _forget(self) -> None:
        keep = self._kept()
        names, memo = list(self.memo), _Memo()
        for i in keep.tolist():
            memo[names[i]] = len(memo)
        size = self.size[keep]
        self.flat = _gathered(self.flat, self.begin[keep], size)
        self.memo, self.begin, self.size, self.used = memo, np.cumsum(size) - size, size, self.used[keep]

    def _cut(self, text: str) -> list:
        if self.unit == "word":
            return text.replace("\n", " ").split(" ")
        return [(text,)]

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces encoded as one text, and how many each has."""
        ids = np.array(self._each([f" {_MARK} ".join(pieces)])[0], np.uint32)
        at = np.flatnonzero(ids == self.mark)
        return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def _learn(self) -> None:
        """Encode the new pieces: those that can stand in one text together, the rest one by one."""
        new, whole = self.memo.new, []
        if self.unit == "word" and self.mark is not None:
            whole = [i for i, p in enumerate(new) if _MARK not in p]
        size, begin = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        flat = [np.empty(0, np.uint32)]
        if whole:
            ids, n = self._together([new[i] for i in whole])
            size[whole], begin[whole] = n, np.cumsum(n) - n
            flat.append(ids)
        rest = np.setdiff1d(np.arange(len(new)), whole).tolist()
        at = len(flat[-1])
        for i, ids in zip(rest, self._each([p[0] if isinstance(p, tuple) else p for p in (new[i] for i in rest)])):
            size[i], begin[i], at = len(ids), at, at + len(ids)
            flat.append(np.array(ids, np.uint32))
        self.begin = np.concatenate([self.begin, begin + len(self.flat)])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, *flat])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.memo.new = []

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text ends."""
        if self.unit == "space":
            return self._encode_bytes(texts)
        if len(self.memo) > self.most:
            self._forget()
        pieces, ends = [], []
        for t in texts:
            pieces += self._cut(t or "")
            ends.append(len(pieces))
        at = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        if self.memo.new:
            self._learn()
        self.used += np.bincount(at, minlength=len(self.used))
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return _gathered(self.flat, self.begin[at], size), total[np.array(ends, np.int64)]

    def _encode_bytes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        data = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(d) for d in data], dtype=np.int64)
        data = b"".join(data)
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        n, padded = len(data), np.frombuffer(data + bytes(_SHORT), np.uint8)
        x, words = padded[:n], np.ndarray(n + 8, "<u8", padded, strides=(1,))
        solid = _solid(x)
        cut = _begins(x, solid)
        cut[0] = cut[ends[ends < n]] = True
        begin = np.flatnonzero(cut)
        length = np.diff(begin, append=n)
        out, sizes = [], []
        for i in range(0, len(begin), _PASS):
            if len(self.size) > self.most:
                self._forget_bytes()
            at = self._look_up(data, words, solid, begin[i : i + _PASS], length[i : i + _PASS])
            self.used += np.bincount(at, minlength=len(self.used))
            sizes.append(self.size[at])
            out.append(_gathered(self.flat, self.begin[at], sizes[-1]))
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(out), total[np.searchsorted(begin, ends)]

    def _look_up(self, data: bytes, words: np.ndarray, solid: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each piece of ``data``; new ones are learned."""
        known, at, short = self.numbers.count, np.empty(len(begin), np.int64), np.flatnonzero(length <= _SHORT)
        b, n = begin[short], length[short]
        at[short] = self.numbers.find(words[b] & _FIRST_BYTES[np.minimum(n, 8)], words[b + np.minimum(n, 8)] & _FIRST_BYTES[np.maximum(n - 8, 0)], n.astype(np.uint8))
        long = np.flatnonzero(length > _SHORT)
        for i, b, n in zip(long.tolist(), begin[long].tolist(), length[long].tolist()):
            piece = data[b : b + n]
            if (number := self.long.get(piece)) is None:
                number = self.long[piece] = self.numbers.count
                self.numbers.count += 1
            at[i] = number
        if self.numbers.count > known:
            new = np.flatnonzero(at >= known)
            where = np.empty(self.numbers.count - known, np.int64)
            where[at[new] - known] = new
            self._learn_bytes(data, solid, begin[where], length[where])
        return at

    def _learn_bytes(self, data: bytes, solid: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Encode new pieces: those that begin with one space or none and end with no white space as one text, the
        former as they are, the latter after a line feed; the rest one by one."""
        count, at, flat = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), [self.flat]
        end = begin + length
        bare = solid[begin]
        spaced = (np.frombuffer(data, np.uint8)[begin] == _SPACE) & (length > 1) & solid[np.minimum(begin + 1, end - 1)]
        whole = np.flatnonzero((bare | spaced) & solid[end - 1])
        if len(whole):
            extra = bare[whole]
            text = b"".join([b"\n" + data[b:e] if x else data[b:e] for b, e, x in zip(begin[whole].tolist(), end[whole].tolist(), extra.tolist())])
            ids = np.array(self._each([text.decode()])[0], np.uint32)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(length[whole] + extra)) + 1
            count[whole] = np.diff(ends, prepend=0) - extra
            at[whole] = len(self.flat) + ends - count[whole]
            flat.append(ids)
        rest = np.setdiff1d(np.arange(len(begin)), whole)
        if len(rest):
            found = self._each([data[b:e].decode() for b, e in zip(begin[rest].tolist(), end[rest].tolist())])
            count[rest] = [len(ids) for ids in found]
            at[rest] = sum(map(len, flat)) + np.cumsum(count[rest]) - count[rest]
            flat.append(np.array([i for ids in found for i in ids], np.uint32))
        self.flat = np.concatenate(flat)
        self.begin, self.size = np.concatenate([self.begin, at]), np.concatenate([self.size, count])
        self.used = np.concatenate([self.used, np.zeros(len(begin), np.int64)])

    def _forget_bytes(self) -> None:
        keep, old = self._kept(), self.numbers
        is_long = np.zeros(old.count, bool)
        is_long[list(self.long.values())] = True
        short, long = keep[~is_long[keep]], keep[is_long[keep]]
        self.numbers, place = _Numbers(len(old.low)), np.full(old.count, -1)
        place[short] = self.numbers.find(old.low[short], old.high[short], old.length[short])
        place[long] = len(short) + np.arange(len(long))
        self.numbers.count = len(keep)
        self.long = {p: int(place[i]) for p, i in self.long.items() if place[i] >= 0}
        order = keep[np.argsort(place[keep])]
        self.used, size = self.used[order], self.size[order]
        self.flat = _gathered(self.flat, self.begin[order], size)
        self.begin, self.size = np.cumsum(size) - size, size

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, ends = self.encode_flat(texts)
        return np.split(ids, ends[:-1]) if len(texts) else []


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges (begin, size) of ``flat``, one after the other."""
    first = np.cumsum(size) - size
    return flat[np.repeat(begin - first, size) + np.arange(int(size.sum()))]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, unit: str, most: int | None = None) -> Encoder:
    """This worker's encoder for a file."""
    if (path, unit) not in _ENCODERS:
        _ENCODERS[path, unit] = Encoder(path, unit, most)
    return _ENCODERS[path, unit]
