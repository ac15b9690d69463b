"""Token ids of whole texts from a public byte-level BPE vocabulary, for use inside tasks.

The vocabulary's pre-tokens (contractions, runs of letters, digits, other signs or blanks, each with one leading blank) are found for a
block of texts at once in numpy; every distinct pre-token is encoded once by ``tokenizers`` and its ids are looked up after that, by a hash table
in arrays. The ids are those of encoding the whole text.

New pre-tokens go to ``tokenizers`` many in one text, as an encoding costs more than the few ids in it: one that begins with its blank is a pre-token of
its own behind any other, before the others stands a line feed, whose id is left out. The ids are dealt back by the bytes they stand for.
"""
import sys
import unicodedata

import numpy as np

from evalspark.llm.textcodes import _power_tables, mix

LETTER, DIGIT, BLANK, OTHER = 1, 2, 3, 4
#: What may follow an apostrophe as one pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_VOCAB_LIMIT = 2_000_000
#: Pre-tokens in one text handed to ``tokenizers``.
TOGETHER = 64


def _kinds() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        group = unicodedata.category(c)[0]
        if group == "L":
            table[code] = LETTER
        elif group == "N":
            table[code] = DIGIT
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return table


_state: dict = {}


def _pretokens(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First place of each pre-token in the code points; ``starts`` are the first places of the texts."""
    n = len(code)
    if "kinds" not in _state:
        _state["kinds"] = _kinds()
    kind = _state["kinds"][code]
    text_start = np.zeros(n + 1, bool)
    text_start[starts] = True
    text_start[n] = True
    run = text_start[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begin = run.copy()
    run_at = np.flatnonzero(run)
    run_kind = kind[run_at]
    last = np.append(run_at[1:], n) - 1  # last place of each run
    # A run of blanks gives its last one to what follows: a plain blank joins it, another one stands alone.
    blank = np.flatnonzero((run_kind == BLANK) & ~text_start[last + 1])
    end = last[blank]
    begin[end] = True
    joins = end[code[end] == 0x20]
    begin[joins + 1] = False
    # Contractions: an apostrophe that begins a pre-token, with its letters, is one; what follows begins another.
    quote = np.flatnonzero((code == 0x27) & begin)
    if len(quote):
        padded = np.concatenate([code, np.zeros(3, code.dtype)])
        following = np.zeros(n + 4, bool)
        following[:n] = text_start[:n]
        following[n:] = True
        taken = np.zeros(len(quote), bool)
        for word in CONTRACTIONS:
            hit = ~taken
            for i, c in enumerate(word):
                hit &= (padded[quote + 1 + i] == ord(c)) & ~following[quote + 1 + i]
            at = quote[hit]
            begin[at + 1] = False
            after = at + 1 + len(word)
            begin[after[after < n]] = True
            taken |= hit
    return np.flatnonzero(begin)


class Encoder:
    """Encodes lists of texts; keeps the ids of up to _VOCAB_LIMIT pre-tokens.

    Word w has ids[start[w]:start[w + 1]]. ``keys`` and ``word`` are the slots of the table, at most half of them taken; a key goes to the first free slot
    from its upper bits on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings inside a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character of a byte-level token is a byte
        self.clear()

    def clear(self) -> None:
        self.n, self.ids, self.start = 0, np.zeros(0, np.uint16), np.zeros(1, np.int64)
        self._slots(16)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the n + 1 offsets of the texts."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(code):
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        at = _pretokens(code, offs[:-1][np.diff(offs) > 0])
        stop = np.append(at[1:], len(code))
        key = _hashes(code, at, stop)
        where = self._find(key)
        missing = np.flatnonzero(where < 0)
        if self.n + len(missing) > _VOCAB_LIMIT:
            self.clear()
            missing = np.arange(len(key))
        if len(missing):
            new, first = np.unique(key[missing], return_index=True)
            places = missing[first]
            self._learn(new, [joined[a:b] for a, b in zip(at[places].tolist(), stop[places].tolist())])
            where[missing] = self._find(key[missing])
        begin = self.start[where]
        size = self.start[where + 1] - begin
        out_at = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(out_at[-1]) + np.repeat(begin - out_at[:-1], size)
        return self.ids[take], out_at[np.searchsorted(at, offs)]

    def _slots(self, bits: int) -> None:
        self.shift, self.keys, self.word = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The word of each key, -1 for those not known."""
        slot = (key >> self.shift).astype(np.int64)
        found = self.keys[slot]
        where = np.where(found == key, self.word[slot], -1).astype(np.int64)
        far = np.flatnonzero((found != key) & (found != 0))
        slot = slot[far]
        while len(far):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            here = found == key[far]
            where[far[here]] = self.word[slot[here]]
            on = ~here & (found != 0)
            far, slot = far[on], slot[on]
        return where

    def _put(self, key: np.ndarray, word: np.ndarray) -> None:
        """Takes slots for keys that are different and not in the table."""
        slot = (key >> self.shift).astype(np.int64)
        while len(key):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[free]  # where several want one slot, one gets it
            got = self.keys[slot] == key
            self.word[slot[got]] = word[got]
            key, word, slot = key[~got], word[~got], (slot[~got] + 1) & (len(self.keys) - 1)

    def _learn(self, new: np.ndarray, words: list[str]) -> None:
        blank = _state["kinds"][[ord(w[-1]) for w in words]] == BLANK
        apart, joined = np.flatnonzero(blank), np.flatnonzero(~blank)
        ids, size = self._encode_joined([words[i] for i in joined])
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in apart], add_special_tokens=False)]
        ids = np.concatenate([ids, np.array([i for x in lists for i in x], np.uint16)])
        ends = np.cumsum(np.concatenate([size, np.array([len(x) for x in lists], np.int64)]))
        kept, n = int(self.start[self.n]), self.n + len(new)
        self.ids, self.start = _room(self.ids, kept + len(ids)), _room(self.start, n + 1)
        self.ids[kept:kept + len(ids)] = ids
        self.start[self.n + 1:n + 1] = kept + ends
        if 2 * n > len(self.keys):
            old, word = self.keys, self.word
            self._slots(int(4 * n - 1).bit_length())
            self._put(old[old != 0], word[old != 0])
        self._put(new[np.concatenate([joined, apart])], np.arange(self.n, n, dtype=np.int32))
        self.n = n

    def _encode_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that do not end in a blank, one after the other, and how many each has."""
        parts = [w if w[0] == " " else "\n" + w for w in words]
        encoded = self.tokenizer.encode_batch_fast(["".join(parts[i:i + TOGETHER]) for i in range(0, len(parts), TOGETHER)], add_special_tokens=False)
        ids = np.array([i for e in encoded for i in e.ids], np.uint16)
        length = np.array([len(w.encode()) for w in words], np.int64)
        led = np.array([w[0] != " " for w in words], bool)
        end = np.cumsum(length + led)
        edge = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
        first, last = np.searchsorted(edge, end - length), np.searchsorted(edge, end)
        if edge[-1] != (end[-1] if len(end) else 0) or (edge[first] != end - length).any() or (edge[last] != end).any():
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]  # not cut between these words
            return np.array([i for x in lists for i in x], np.uint16), np.array([len(x) for x in lists], np.int64)
        return np.delete(ids, first[led] - 1), last - first


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a with places for n values, at least doubled where it has too few."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, which keeps what it has learned from task to task."""
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def _hashes(code: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the code points of each span."""
    up, down = _power_tables(len(code) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * up[:len(code)])])
    return np.maximum(mix((total[stop] - total[at]) * down[at]), np.uint64(1))  # 0 is a free slot
