"""Token ids of whole texts by the tokenizers library, memoised by pre-token.

Both vocabularies used here cut a text into pre-tokens (runs of letters, digits, signs; a leading space or not) before
they merge anything, so the ids of a text are the ids of its pre-tokens, joined. Texts of ASCII and Latin-1 letters,
digits, signs, single spaces and single line feeds are cut here, whole blocks at a time, and each distinct pre-token
goes to the library's model once a worker; any other text is handed whole to the library. The memo holds pre-tokens as
words of eight bytes, found by a 64-bit hash in a table of open addresses. Hashes only find an entry: all bytes are
compared on every hit, and a block in which two pre-tokens share a hash goes whole to the library. The memo is emptied
beyond `most` bytes.
"""

from __future__ import annotations

import os
from itertools import chain
from operator import attrgetter

import numpy as np

# Bytes of texts that are cut here: no other alphabets, apostrophes, "<" of special tokens or runs of white space. C3 begins À to ÿ.
PLAIN = bytes([10, *range(32, 39), *range(40, 60), *range(61, 127), *range(0x80, 0xC0), 0xC3])
RUNS, SIGNS = (b"  ", b"\n ", b" \n", b"\n\n"), ("×".encode(), "÷".encode())
SPACE, FEED, LETTER, DIGIT, SIGN = range(5)
CLASS = np.full(256, SIGN, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58], CLASS[32], CLASS[10] = DIGIT, SPACE, FEED
BLOCK = 1 << 19
#: Odd factors of a pre-token's words, one after another, and of their sum.
FACTOR = np.random.default_rng(20240229).integers(1, 1 << 63, BLOCK // 8 + 1, dtype=np.uint64) | np.uint64(1)
LAST = np.uint64(0x9E3779B97F4A7C15)
MASK = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def plain(raw: bytes) -> bool:
    return not (raw.translate(None, PLAIN) or any(x in raw for x in RUNS) or not raw.isascii() and any(x in raw for x in SIGNS))


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


class _Growing:
    """An array with room at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 10, dtype), 0

    def extend(self, new: np.ndarray) -> None:
        if self.n + len(new) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(len(new) + self.n // 4, self.data.dtype)])
        self.data[self.n : self.n + len(new)] = new
        self.n += len(new)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a visible character: itself, or from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class Encoder:
    """ids(texts) -> one uint32 array a text. words: the vocabulary that lower-cases and drops white space."""

    held: dict = {}

    def __init__(self, path: str, words: bool, most: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.words, self.most = Tokenizer.from_file(path), words, most
        self.model, self.letters = self.tok.model, _byte_letters()
        self._clear()

    def _clear(self) -> None:
        """Entry 0 stands for none. at, size: its ids in flat; word_at, words_of: its words of eight bytes in raw."""
        self.flat, self.raw = _Growing(np.uint32), _Growing(np.uint64)
        self.keys, self.at, self.size, self.word_at, self.words_of = _Growing(np.uint64), *(_Growing(np.int32) for _ in range(4))
        for x in (self.keys, self.at, self.size, self.word_at, self.words_of):
            x.n = 1
        self.table = np.zeros(1 << 12, np.int32)

    def _held(self) -> int:
        return self.table.nbytes + sum(x.data.nbytes for x in (self.flat, self.raw, self.keys, self.at, self.size, self.word_at, self.words_of))

    @classmethod
    def of(cls, path: str, words: bool) -> "Encoder":
        """One a worker process, so the memo lasts over tasks. Lower-cased words differ less, and packing leaves less memory."""
        if (path, words) not in cls.held:
            cls.held[path, words] = cls(path, words, (32 if words else 96) << 20)
        return cls.held[path, words]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or 0."""
        slot, held, last = self._slots(keys), self.keys.data, len(self.table) - 1
        out = self.table[slot]
        other = np.nonzero((out != 0) & (held[out] != keys))[0]
        while len(other):
            slot[other] = (slot[other] + 1) & last
            got = out[other] = self.table[slot[other]]
            other = other[(got != 0) & (held[got] != keys[other])]
        return out

    def _enter(self, entries: np.ndarray) -> None:
        slot, last = self._slots(self.keys.data[entries]), len(self.table) - 1
        while len(entries):
            free = self.table[slot] == 0
            self.table[slot[free]] = entries[free]
            lost = self.table[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & last

    def _learn(self, keys: np.ndarray, pieces: list[bytes], words_of: np.ndarray, raw: np.ndarray) -> None:
        """keys: all different, and none of them known; raw: the pieces' words of eight bytes."""
        shown = b"\0".join(pieces).decode("latin-1").translate(self.letters).split(chr(self.letters[0]))
        ids = list(map(self.model.tokenize, shown))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        for x, n, of in ((self.at, size, self.flat), (self.word_at, words_of, self.raw)):
            x.extend(of.n + np.cumsum(n) - n)
        self.flat.extend(np.fromiter(map(attrgetter("id"), chain.from_iterable(ids)), np.uint32, int(size.sum())))
        self.raw.extend(raw)
        self.size.extend(size)
        self.words_of.extend(words_of)
        known = self.keys.n
        self.keys.extend(keys)
        if 2 * self.keys.n > len(self.table):
            self.table, known = np.zeros(1 << (3 * self.keys.n).bit_length(), np.int32), 1
        self._enter(np.arange(known, self.keys.n, dtype=np.int32))

    def _hash(self, words: np.ndarray, within: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each pre-token's words, of which the first ones stand at `first`."""
        key = np.add.reduceat(words * FACTOR[within], first)
        return (key ^ key >> np.uint64(32)) * LAST

    def _block(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """texts: plain, at most BLOCK bytes together. None where two pre-tokens share a hash."""
        padded = np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)
        n = len(padded) - 8
        data = padded[:n]
        bounds = np.cumsum([len(t) for t in texts])
        kind = CLASS[data]
        if self.words:  # lower case of Latin-1 letters in UTF-8: C3 80..9E
            upper = np.zeros(n, bool)
            upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            padded = np.concatenate([data + np.uint8(32) * (upper | ((data >= 65) & (data <= 90))), np.zeros(8, np.uint8)])
        first = np.ones(n, bool)
        if self.words:
            first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        else:
            first[1:] = ((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)) | (kind[1:] == SPACE)
        first[bounds[:-1][bounds[:-1] < n]] = True
        start = np.nonzero(first)[0]
        end = np.append(start[1:], n)
        if self.words:
            keep = kind[start] >= LETTER
            start, end = start[keep], end[keep]
        if not len(start):
            return [np.empty(0, np.uint32)] * len(texts)
        width = end - start
        words_of = (width + 7) >> 3
        within, last = _within(words_of), np.cumsum(words_of) - 1
        words = np.ndarray(n + 1, np.dtype("<u8"), padded, strides=(1,))[np.repeat(start, words_of) + 8 * within]
        words[last] &= MASK[(width - 1) & 7]  # no plain text has a zero byte, so equal words are equal bytes
        key = self._hash(words, within, last - words_of + 1)
        if self._held() > self.most:
            self._clear()
        entry = self._find(key)
        new = np.nonzero(entry == 0)[0]
        if len(new):
            different, example = np.unique(key[new], return_index=True)
            example = new[example]
            raw, size = padded.tobytes(), words_of[example]
            self._learn(different, [raw[a:b] for a, b in zip(start[example].tolist(), end[example].tolist())], size, words[np.repeat(last[example] - size + 1, size) + _within(size)])
            entry[new] = self._find(key[new])
        if not (self.words_of.data[entry] == words_of).all() or not (self.raw.data[np.repeat(self.word_at.data[entry], words_of) + within] == words).all():
            return None
        at, size = self.at.data[entry], self.size.data[entry]
        out_end = np.cumsum(size)
        ids = self.flat.data[np.repeat(at - (out_end - size), size) + np.arange(out_end[-1] if len(out_end) else 0)]
        cuts = np.concatenate([[0], out_end])[np.searchsorted(start, bounds)]
        return np.split(ids, cuts[:-1])

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [np.empty(0, np.uint32)] * len(texts)
        block, held = [], 0
        for k, t in enumerate(texts):
            if not t:
                continue
            whole = t.encode()
            if not plain(whole):
                out[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            parts = [whole]
            while len(parts[-1]) > BLOCK:  # before a space, where a pre-token starts
                last = parts.pop()
                cut = last.rfind(b" ", 0, BLOCK)
                if cut <= 0:
                    parts = []
                    break
                parts += [last[:cut], last[cut:]]
            if not parts:
                out[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            for p in parts:
                if held + len(p) > BLOCK:
                    self._flush(block, out)
                    block, held = [], 0
                block.append((k, p))
                held += len(p)
        self._flush(block, out)
        return out

    def _flush(self, block: list, out: list) -> None:
        if block:
            found = self._block([p for _, p in block])
            if found is None:  # texts were cut before a space, where the library cuts too
                found = [np.array(self.tok.encode(p.decode(), add_special_tokens=False).ids, np.uint32) for _, p in block]
            for (k, _), ids in zip(block, found):
                out[k] = np.concatenate([out[k], ids]) if len(out[k]) else ids
