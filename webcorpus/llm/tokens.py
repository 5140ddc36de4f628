"""Token ids of whole texts, as the tokenizers and sentencepiece libraries give them."""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np
import pyarrow as pa

from .shingles import hash_spans, mix

#: A single space between two plain characters. No pre-token, special token, merge or
#: normalisation of the vocabularies used here reaches across it, other than by taking the
#: space as the front of the second word. Blank spacing accents and combining marks are left out.
BREAK = re.compile(r" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")
PLAIN = re.compile(r"([A-Za-z]+)([.,]?)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_memory() -> dict:
    """What a Python worker keeps from task to task."""
    name = "_webcorpus_worker_memory"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].held = {}
    return sys.modules[name].held


def forget() -> None:
    """Frees what an earlier operator keeps in this worker."""
    worker_memory().clear()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    # the C library keeps freed memory unless told otherwise
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: A word of Latin letters and what ASCII marks follow it.
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


def split_words(data: np.ndarray, cut: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of UTF-8 between ``cut`` bytes: starts, ends, and whether they are letters alone.

    A ``line`` byte is a stretch of its own, and so are the marks at the end of what matches ``LETTERS``.
    """
    accent = data == 0xC3
    tail = np.r_[False, accent[:-1]] & (data != 0x97) & (data != 0xB7)
    ascii_, word = (data | 32) - np.uint8(97) < 26, ~cut
    mark = (data > 32) & (data < 127) & (data != 39) & (data - np.uint8(48) > 9) & ~ascii_
    letter = ascii_ | tail | np.r_[tail[1:], False]
    begin = word & (np.r_[True, (cut | line)[:-1]] | line)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, starts, np.zeros(0, bool)
    # any other byte, and a letter behind a mark
    other = np.flatnonzero(word & (~(letter | mark) | letter & np.r_[False, mark[:-1]]))
    plain, turn = letter[starts], np.flatnonzero(mark & np.r_[False, letter[:-1]])
    plain[np.searchsorted(starts, other, "right") - 1] = False
    begin[turn[plain[np.searchsorted(starts, turn, "right") - 1]]] = True
    letters = np.zeros(len(data), bool)
    letters[starts[plain]] = True
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(word & np.r_[(cut | begin)[1:], True]) + 1, letters[starts]


class WordEncoder:
    """Ids of texts as arrays of ``dtype`` (uint16 where the vocabulary fits).

    Texts are cut into words at places that nothing in the vocabulary reaches across: at every space or line feed where the
    tokenizer drops white space, else at single spaces between plain characters; byte-level vocabularies also break around a
    line feed between plain characters, and between the letters and the marks of a word. The ids of a text are those of its
    words in order. Words are known by a 64-bit hash in one table for the whole batch; only new words are looked at: words of
    letters behind a space go through the library many at a time, other words of letters straight to the merge model, all else
    through the library's pipeline. Beyond ``keep`` words the table starts anew.
    """

    def __init__(self, path: str, keep: int = 750_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tk, self.keep = Tokenizer.from_file(path), keep
        self.dtype = np.dtype("<u2" if self.tk.get_vocab_size() <= 1 << 16 else "<u4")
        #: whether a space becomes part of the word behind it, white space is dropped, and case is dropped
        self.spaced = self._ids([" a"]) != self._ids(["a"])
        self.dropped = not self._ids([" \n "])[0] and self._ids(["a\n  b"]) == self._ids(["a b"])
        self.lower = self._ids(["A"]) == self._ids(["a"])
        #: whether line feeds and marks stand alone, as in byte-level vocabularies
        self.fine = self.spaced and not self.dropped and self._ids(["ab.\nAb é,"])[0] == [i for x in self._ids(["ab", ".", "\n", "Ab", " é", ","]) for i in x]
        #: ids that begin with a space
        self.opens = np.zeros(self.tk.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tk.get_vocab().items() if t.startswith("Ġ")]] = True
        self.letters, self.stops, self.since = byte_letters(), {"": []}, 0
        self._start(1 << 17)

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """This worker's encoder for a vocabulary."""
        held = worker_memory()
        if path not in held:
            forget()
            held[path] = cls(path)
        give_back()
        return held[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _start(self, slots: int) -> None:
        self.keys, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.n, self.size = 0, 0
        self.begin, self.length, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.dtype)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where unknown."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        seen = self.keys[slot]
        out = np.where(seen == h, self.at[slot], -1)
        todo = np.flatnonzero((seen != h) & (seen != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            seen = self.keys[slot[todo]]
            hit = seen == h[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (seen != 0)]
        return out

    def _insert(self, h: np.ndarray, place: np.ndarray) -> None:
        """Different new hashes into free slots."""
        mask, slot, todo = len(self.keys) - 1, (h & np.uint64(len(self.keys) - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.at[slot[won]] = place[won]
            left = np.ones(len(h), bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _remember(self, h: np.ndarray, lengths: np.ndarray, new: np.ndarray) -> None:
        if 4 * (self.n + len(h)) > 3 * len(self.keys):
            old_keys, old_at = self.keys, self.at
            used = old_keys != 0
            size = len(old_keys)
            while 4 * (self.n + len(h)) > 3 * size:
                size *= 2
            self.keys, self.at = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._insert(old_keys[used], old_at[used])
        for name, need in (("begin", self.n + len(h)), ("length", self.n + len(h)), ("flat", self.size + len(new))):
            if need > len(getattr(self, name)):
                setattr(self, name, np.r_[getattr(self, name), np.zeros(max(need - len(getattr(self, name)), len(getattr(self, name)) // 2), getattr(self, name).dtype)])
        self.begin[self.n:self.n + len(h)] = self.size + np.cumsum(lengths) - lengths
        self.length[self.n:self.n + len(h)] = lengths
        self.flat[self.size:self.size + len(new)] = new
        self._insert(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n, self.size = self.n + len(h), self.size + len(new)

    def learn_spaced(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of words of letters that all have a space before them: the id that begins with it begins a word."""
        lengths, flat = [], []
        for a in range(0, len(words), 1000):
            run = words[a:a + 1000]
            ids = np.array(self._ids([(b" " + b" ".join(run)).decode()])[0], self.dtype)
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(run) or first[0]:
                each = self._ids([" " + w.decode() for w in run])
                ids, n = np.array([i for x in each for i in x], self.dtype), [len(x) for x in each]
            else:
                n = np.diff(first, append=len(ids))
            lengths.append(n)
            flat.append(ids)
        return np.concatenate(lengths), np.concatenate(flat)

    def learn(self, words: list[str], heads: list[bool]) -> list[list[int]]:
        """Ids of words; ``heads`` have no space before them."""
        out: list[list[int] | None] = [None] * len(words)
        odd, tokenize, letters, stops, lower, spaced = [], self.tk.model.tokenize, self.letters, self.stops, self.lower, self.spaced
        for i, (w, head) in enumerate(zip(words, heads)):
            m = LETTERS.fullmatch(w) if len(w) <= 64 else None
            if m is None:
                odd.append(i)
                continue
            base, stop = m.groups()
            if stop not in stops:
                if len(stops) > 100_000:
                    stops.clear()
                stops[stop] = self._ids([stop])[0] if stop else []
            if lower:
                base = base.lower()
            if not base.isascii():
                base = base.encode().decode("latin-1").translate(letters)
            out[i] = [t.id for t in tokenize("Ġ" + base if spaced and not head else base)] + stops[stop]
        for a in range(0, len(odd), 1000):
            run = odd[a:a + 1000]
            for i, ids in zip(run, self._ids([words[i] if heads[i] or not spaced else " " + words[i] for i in run])):
                out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.n > self.keep:
            self._start(1 << 17)
        if self.since > 1 << 24:
            # what the library frees piecemeal stays with the C library otherwise
            self.since = 0
            give_back()
        raw = [t.encode("utf-8") for t in texts]
        # a zero byte between texts; texts that hold one go through the library alone
        alone = {i: self._ids([t])[0] for i, t in enumerate(texts) if "\0" in t}
        for i in alone:
            raw[i] = b""
        buffer = b"\0".join([b"", *raw, b""])
        self.since += len(buffer)
        data = np.frombuffer(buffer, np.uint8)
        edge = data == 0
        if self.dropped:
            cut = edge | (data == 32) | (data == 10)
        elif self.spaced:
            ascii_, lead = (data > 32) & (data < 127), (data >= 0xC3) & (data <= 0xC8)
            front = ascii_ | lead
            back = ascii_ | np.r_[False, lead[:-1]]
            between = np.r_[False, back[:-1]] & np.r_[front[1:], False]
            cut = (data == 32) & between | edge
            line = (data == 10) & between
        else:
            cut = edge
        if self.fine:
            starts, ends, letters = split_words(data, cut, line)
        else:
            part = np.flatnonzero(np.diff((~cut).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            starts, ends = part[::2], part[1::2]
            letters = np.zeros(len(starts), bool)
        h = hash_spans(data, starts, ends)
        head = data[starts - 1] != 32
        if self.spaced:
            h = np.where(head, mix(h + np.uint64(1)), h)
        h[h == 0] = 1
        place = self._find(h)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            joined = letters[at] & ~head[at]
            if joined.any():
                self._remember(new[joined], *self.learn_spaced([buffer[s:e] for s, e in zip(starts[at[joined]].tolist(), ends[at[joined]].tolist())]))
            new, at = new[~joined], at[~joined]
            ids = self.learn([buffer[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())], head[at].tolist())
            self._remember(new, np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], self.dtype))
            place[miss] = self._find(h[miss])
        n = self.length[place].astype(np.int64)
        stops = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[place] - (stops - n), n) + np.arange(n.sum())]
        # the first word of every text, and with it the text's first id
        words = np.searchsorted(starts, np.flatnonzero(edge))
        bounds = np.r_[0, stops][words]
        return [np.array(alone[i], self.dtype) if i in alone else ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]


class PieceCounter:
    """Token counts by a sentencepiece model. Pieces never hold a word mark behind another
    character (checked), so a long text is cut at ``BREAK`` and its parts are counted alone."""

    def __init__(self, path: str, longest: int = 8192):
        import sentencepiece

        self.sp, self.longest = sentencepiece.SentencePieceProcessor(model_file=path), longest
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.safe = not any("▁" in p.lstrip("▁") for p in pieces)

    def parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.safe and len(text) - at > self.longest:
            m = BREAK.search(text, at + self.longest)
            if m is None:
                break
            out.append(text[at:m.start()])
            at = m.end()
        return [*out, text[at:]]

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.parts(t) for t in texts]
        each = iter([len(x) for x in self.sp.encode([p for t in parts for p in t], num_threads=1)])
        return [sum(next(each) for _ in t) for t in parts]
