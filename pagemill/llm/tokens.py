"""Token ids by a given vocabulary file, with a bounded cache of words.

White space separates words for the tokenizer too, so the ids of a text are the ids of its words in order. Words
repeat: each is encoded once per worker and kept in flat arrays, where the words of many texts are looked up by numpy.
New words are encoded in batches, joined by a word that has one known id. Words are known by 128 bits of hashes. Texts
with parts of special tokens take the plain path.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

DTYPE = "<u4"
#: Some 50 bytes each.
CACHE_WORDS = 1_000_000
#: Bytes of text whose words are looked up at once.
SEGMENT = 400_000
_GAP = re.compile(rb"[ \t-\r]").search
#: ASCII letters before a run of ASCII punctuation: the tokenizer cuts there in any case. Apostrophes are left
#: whole, as contractions depend on what follows.
_TAIL = re.compile(rb"([a-z\x80-\xff]*[a-z])([!-&(-/:-@\[-`{-~]+)").fullmatch
#: Characters that stand for the bytes that are no printable Latin-1 character themselves, in byte order.
_STAND_INS = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_workers: dict[str, "WordCache"] = {}


def _latin(word: bytes) -> str | None:
    """Byte-level form of a lower-cased word of Latin letters, composed by nature; None for other words."""
    if word[-1] < 64:
        return None
    text = word.decode().lower()
    return text.encode().decode("latin-1").translate(_STAND_INS) if text.isalpha() and max(text) < "\u0250" else None


class WordTable:
    """Ids by word: an open-addressing table over two 64-bit hashes, all in flat arrays, looked up in bulk."""

    def __init__(self) -> None:
        self.n, self.drops, self.slots = 0, 0, np.full(1 << 16, -1, np.int32)
        self.hashes = np.empty((1 << 15, 2), np.uint64)
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.ids, self.used = np.empty(1 << 17, DTYPE), 0

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for unknown ones."""
        out = np.full(len(first), -1, np.int64)
        todo, mask, step = np.arange(len(first)), np.uint64(len(self.slots) - 1), np.uint64(0)
        while len(todo):
            at = self.slots[((first[todo] + step) & mask).astype(np.int64)]
            todo, at = todo[at >= 0], at[at >= 0]
            known = self.hashes[at]
            hit = (known[:, 0] == first[todo]) & (known[:, 1] == second[todo])
            out[todo[hit]] = at[hit]
            todo, step = todo[~hit], step + np.uint64(1)
        return out

    def _place(self, index: np.ndarray) -> None:
        mask, step = np.uint64(len(self.slots) - 1), np.uint64(0)
        while len(index):
            at = ((self.hashes[index, 0] + step) & mask).astype(np.int64)
            free = self.slots[at] < 0
            self.slots[at[free]] = index[free]  # of several words for one slot the last stays
            index, step = index[self.slots[at] != index], step + np.uint64(1)

    def add(self, first: np.ndarray, second: np.ndarray, ids: list[bytes]) -> None:
        """New distinct words with their ids."""
        data, sizes = np.frombuffer(b"".join(ids), DTYPE), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        if self.n > CACHE_WORDS:  # frequent words are met, and so kept, first: the older half stays
            self.n, self.drops = self.n // 2, self.drops + 1
            self.used = int(self.start[self.n])
            self.slots.fill(-1)
            self._place(np.arange(self.n))
        n, used = self.n + len(ids), self.used + len(data)
        while n > len(self.size):
            for name in ("hashes", "start", "size"):
                own = getattr(self, name)
                setattr(self, name, np.concatenate([own, np.zeros_like(own)]))
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        own = slice(self.n, n)
        self.hashes[own, 0], self.hashes[own, 1] = first, second
        self.size[own], self.start[own] = sizes, self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : used] = data
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (2 * n).bit_length(), -1, np.int32)
            self._place(np.arange(n))
        else:
            self._place(np.arange(self.n, n))
        self.n, self.used = n, used

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in order, ids up to the end of each word)."""
        sizes = self.size[index].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[index] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


_DRAWN = np.random.default_rng(11)
_BYTE = _DRAWN.integers(0, 1 << 64, (2, 256), np.uint64)
_BASE = _DRAWN.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two polynomial hashes of each word; words lie in ``data`` without the white space between them."""
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(firsts, sizes)
    out = []
    for table, base in zip(_BYTE, _BASE):
        powers = np.cumprod(np.full(int(sizes.max()), base))
        value = np.add.reduceat(table[data] * powers[place], firsts) + sizes.astype(np.uint64)
        value = (value ^ value >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(value ^ value >> np.uint64(29))
    return out[0], out[1]


class WordCache:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table, self.marks = WordTable(), {}
        mark = self._plain("0")
        self.mark = int(np.frombuffer(mark, DTYPE)[0]) if len(mark) == 4 else None
        # Words of plain lower-case letters can go to the model itself if nothing before it changes them.
        self.by_model = sys.byteorder == "little" and array("I").itemsize == 4 and all(
            array("I", [t.id for t in self.tokenizer.model.tokenize(w)]).tobytes() == self._plain(w) for w in ("a", "the", "tokenizers", "zqxjkvb", "s", "ll")
        ) and all(
            array("I", [t.id for t in self.tokenizer.model.tokenize(_latin(w.encode()))]).tobytes() == self._plain(w) for w in ("ñ", "Übergrößen", "ciónñandañ", "łóđź", "ǆ")
        )
        # The word path needs a tokenizer that lower-cases and drops white space, and one id for the mark.
        self.by_word = self.mark is not None and all(
            self._plain("Ab, c.\n\t Aé9") == b"".join(map(self._plain, words)) for words in (["Ab,", "c.", "Aé9"], ["ab", ",", "c", ".", "aé9"])
        )

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, DTYPE).tobytes()

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; none holds the mark."""
        out, parts = [], [words[at : at + 500] for at in range(0, len(words), 500)]
        joined = self.tokenizer.encode_batch_fast([" 0 ".join([w.decode() for w in part]) for part in parts], add_special_tokens=False)
        for encoding in joined:
            ids = np.array(encoding.ids, DTYPE)
            cuts, data = np.flatnonzero(ids == self.mark), ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(data)])]
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of new words."""
        tokenize, out, plain, tails = self.tokenizer.model.tokenize, [b""] * len(words), [], []
        for i, word in enumerate(words):
            if self.by_model and (known := word.decode() if word.isalpha() else _latin(word)):
                out[i] = array("I", [t.id for t in tokenize(known)]).tobytes()
            elif m := _TAIL(word):
                tails.append((i, m[1], m[2]))
            elif b"0" in word:
                out[i] = self._plain(word.decode())
            else:
                plain.append(i)
        for i, ids in zip(plain, self._joined([words[i] for i in plain]), strict=True):
            out[i] = ids
        if tails:
            if len(self.marks) > 50_000:
                self.marks.clear()
            new = sorted({end for _, _, end in tails} - self.marks.keys())
            self.marks.update(zip(new, self._joined(new), strict=True))
            ids, ends, _ = self._words(b" ".join([letters for _, letters, _ in tails]))
            data, ends = ids.tobytes(), (4 * ends).tolist()
            for (i, _, end), a, b in zip(tails, [0, *ends], ends):
                out[i] = data[a:b] + self.marks[end]
        return out

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids up to the end of each word, where the words start) of lower-cased text."""
        letters = np.frombuffer(data, np.uint8)
        blank = _SPACE[letters]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        if not len(starts):
            return np.empty(0, DTYPE), np.empty(0, np.int64), starts
        first, second = _word_hashes(letters[~blank], starts, stops - starts)
        index, drops = self.table.find(first, second), self.table.drops
        lost = np.flatnonzero(index < 0)
        if len(lost):
            _, own = np.unique(first[lost], return_index=True)
            own = lost[np.sort(own)]
            got = self._learn([data[a:b] for a, b in zip(starts[own].tolist(), stops[own].tolist())])
            # Parts of these words may have been learned, and old words dropped, on the way.
            new = self.table.find(first[own], second[own]) < 0
            self.table.add(first[own[new]], second[own[new]], [ids for ids, n in zip(got, new.tolist()) if n])
            again = lost if self.table.drops == drops else slice(None)
            index[again] = self.table.find(first[again], second[again])
            if (index < 0).any():  # dropped words, or two words of one first hash
                ids = [self._plain(data[a:b].decode()) for a, b in zip(starts.tolist(), stops.tolist())]
                return np.frombuffer(b"".join(ids), DTYPE), np.cumsum(list(map(len, ids))) // 4, starts
        return *self.table.gather(index), starts

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def flush() -> None:
            if held:
                ids, ends, starts = self._words(b"\n".join([part for _, part in held]))
                data, at = ids.tobytes(), 0
                words = np.searchsorted(starts, np.cumsum([len(part) + 1 for _, part in held]))
                for (i, _), end in zip(held, np.append(0, 4 * ends)[words].tolist()):
                    out[i].append(data[at:end])
                    at = end
                held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or "<|" in text:
                out[i].append(self._plain(text))
                continue
            data, at = text.encode("utf-8").lower(), 0
            while at < len(data):  # long texts are cut at white space
                cut = _GAP(data, at + SEGMENT) if len(data) - at > SEGMENT else None
                part = data[at : cut.start()] if cut else data[at:]
                at = cut.end() if cut else len(data)
                held.append((i, part))
                size += len(part)
                if size >= SEGMENT:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]


def worker_cache(path: str) -> WordCache:
    """The cache of this Python worker."""
    if path not in _workers:
        _workers.clear()
        _workers[path] = WordCache(path)
    return _workers[path]


def encode_rows(path: str, texts: list[str | None], end_id: int) -> list[np.ndarray]:
    """Ids of each text with the end id appended."""
    end = np.array([end_id], DTYPE).tobytes()
    return [np.frombuffer(ids + end, DTYPE) for ids in worker_cache(path).encode_batch(texts)]
