"""Ids of the public byte-level BPE, made by the tokenizers library once for each distinct word.

A block of texts is cut into the words that the tokenizer's own pre-tokenizer would make, by the
classes of its bytes, all texts at once; Arrow tells equal words apart, and distinct words that the
worker's table (of bounded size) lacks go to the library's model, plain ones many at a time.  Any
text beyond Latin letters, with white space beyond ASCII or with a special token's string is given to
the library whole.  Both ways yield exactly Tokenizer.encode(text, add_special_tokens=False).ids.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The first byte of U+0240 in UTF-8; no byte of an earlier character is as great.
BEYOND = 0xC9
#: What the pre-tokenizer tells apart: letters, numbers, all else, white space.
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Word ends that stand by themselves after an apostrophe.
SHORT_ENDS, LONG_ENDS = b"stmd", (b"re", b"ve", b"ll")
END_ID = 0
#: Entries of each of the two generations of a worker's table of words (about 190 bytes each).
WORD_ENTRIES = 250_000
#: Bytes of text that are encoded at once, unless one text is longer.
BLOCK = 24 << 20
#: Plain words that the model gets in one call.
TOGETHER = 48


def _classes() -> np.ndarray:
    """The class of each character below U+0240."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x240)], np.uint8)
    out[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
    return out


CLASSES = _classes()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Generations(dict):
    """A table of bounded size: when the young half is full it becomes the old one, and what is used again moves back."""

    def __init__(self, make, entries: int):
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.entries:
            self.old = self.copy()
            self.clear()
        self[key] = value

    def put_all(self, keys: list, values: list) -> None:
        """Many entries, by parts that fill up the young half."""
        low = 0
        while low < len(keys):
            if len(self) >= self.entries:
                self.old = self.copy()
                self.clear()
            high = low + self.entries - len(self)
            self.update(zip(keys[low:high], values[low:high], strict=True))
            low = high


def _binary(bounds: np.ndarray, data: pa.Buffer | None) -> pa.BinaryArray:
    """The parts of data that lie between bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), data or pa.py_buffer(b"")])


def _bounds(some: pa.Array) -> np.ndarray:
    return np.frombuffer(some.buffers()[1], np.int32, len(some) + some.offset + 1)[some.offset :]


def word_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin in the UTF-8 bytes of texts (cut at bounds) without white space beyond ASCII."""
    kind = CLASSES[raw]
    wide = np.flatnonzero(raw >= 0xC0)
    kind[wide] = kind[wide + 1] = CLASSES[(raw[wide] & 0x1F).astype(np.intp) << 6 | raw[wide + 1] & 0x3F]
    opens = np.zeros(len(raw) + 1, bool)  # a text's first byte; the end counts as one
    opens[bounds] = True
    start = np.empty(len(raw), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[1:] &= raw[:-1] != 0x20  # a space belongs to what follows
    start |= opens[:-1]
    # Of a run of white space before something else, the last stands apart.
    blank = np.flatnonzero(kind == SPACE)
    last = blank[:-1][kind[blank[:-1] + 1] != SPACE] if len(blank) else blank
    if len(blank) and blank[-1] + 1 < len(raw):
        last = np.r_[last, blank[-1]]
    start[last[~opens[last + 1]]] = True
    # An end after an apostrophe is a word, unless the apostrophe belongs to signs or a space before it.
    mark = np.flatnonzero((raw == 0x27) & start)
    for n, ends in ((1, [bytes([c]) for c in SHORT_ENDS]), (2, LONG_ENDS)):
        at = mark[mark + n < len(raw)]
        hit = np.zeros(len(at), bool)
        for end in ends:
            hit |= np.logical_and.reduce([raw[at + 1 + i] == c for i, c in enumerate(end)])
        for i in range(1, n + 1):
            hit &= ~opens[at + i]
        at = at[hit]
        start[at + 1] = False
        start[at[at + n + 1 < len(raw)] + n + 1] = True
    return np.flatnonzero(start).astype(np.int32)


class Encoder:
    """Ids with END_ID appended to each text, as little-endian integers of .dtype."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        alphabet = _byte_letters()
        self.letters, self.space = str.maketrans(alphabet), alphabet[0x20]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith(self.space)
        self.words = Generations(self._word, WORD_ENTRIES)
        self.end = np.array([END_ID], self.dtype).tobytes()

    def _word(self, word: bytes) -> bytes:
        return np.array([x.id for x in self.model.tokenize(word.decode("latin-1").translate(self.letters))], self.dtype).tobytes()

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are a space and letters: no token holds a later word's space, so the model may get them joined."""
        out: list[bytes] = []
        for low in range(0, len(words), TOGETHER):
            some = words[low : low + TOGETHER]
            said = b"".join(some)
            said = said.decode().replace(" ", self.space) if said.isascii() else said.decode("latin-1").translate(self.letters)
            ids = np.array([x.id for x in self.model.tokenize(said)], self.dtype)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(some):
                raw, size = ids.tobytes(), self.dtype.itemsize
                ends = [*(at[1:] * size).tolist(), len(raw)]
                out += [raw[a:b] for a, b in zip((at * size).tolist(), ends, strict=True)]
            else:
                out += map(self._word, some)
        return out

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from the table as far as it goes."""
        young, old = self.words, self.words.old
        ids = list(map(young.get, words))
        missed = [i for i, x in enumerate(ids) if x is None]
        names = [words[i] for i in missed]
        found = list(map(old.get, names))
        lack = [k for k, x in enumerate(found) if x is None]
        plain = [k for k in lack if names[k][0] == 0x20 and (names[k][1:].isalpha() or names[k][1:].decode().isalpha())]
        for k, x in zip(plain, self._plain([names[k] for k in plain]), strict=True):
            found[k] = x
        for k in lack:
            if found[k] is None:
                found[k] = self._word(names[k])
        for i, x in zip(missed, found, strict=True):
            ids[i] = x
        young.put_all(names, found)
        return ids

    def encode_block(self, texts: pa.Array) -> pa.BinaryArray:
        """Ids of each text (a string array without nulls)."""
        n = len(texts)
        whole = self._whole(texts)
        odd = np.flatnonzero(whole)
        strange = [x.ids for x in self.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)] if len(odd) else []
        if len(odd):
            texts = pc.if_else(pa.array(whole), "", texts)
        bounds = _bounds(texts).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        starts = word_starts(raw, bounds)
        words = _binary(np.append(starts, np.int32(len(raw))), pa.py_buffer(raw)).dictionary_encode()
        # Each text's words, then the ids of a text that the library cuts itself, then the end id.
        codes, names = words.indices.to_numpy(), self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        past = np.searchsorted(starts, bounds)
        tail = np.full(n, len(names), np.int32)
        tail[odd] += 1 + np.arange(len(odd), dtype=np.int32)
        names += [self.end, *[np.array(x, self.dtype).tobytes() + self.end for x in strange]]
        parts = pa.array(names, pa.binary()).take(pa.array(np.insert(codes, past[1:], tail)))
        return _binary(_bounds(parts)[past + np.arange(n + 1)], parts.buffers()[2])

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts the library has to cut itself."""
        out = np.zeros(len(texts), bool)
        for x in self.special:
            out |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        bounds = _bounds(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        high = np.flatnonzero(raw >= 0xC2)
        first, second = raw[high], raw[high + 1]
        high = high[(first >= BEYOND) | ((first == 0xC2) & ((second == 0x85) | (second == 0xA0)))]
        out[np.searchsorted(bounds, high[high >= bounds[0]], "right") - 1] = True
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, pa.BinaryArray]]:
        """(first text, ids of each from there on), in blocks of bounded size; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        block = max(1, int(ends[-1]) // max(1, -(-int(ends[-1]) // BLOCK)) + 1) if len(ends) else 1
        low = 0
        while low < len(texts):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + block, "right")))
            yield low, self.encode_block(pa.concat_arrays([texts.slice(low, high - low)]))
            low = high
        pa.default_memory_pool().release_unused()  # workers are kept, their blocks' memory is not

    def encode(self, text: str | None) -> bytes:
        return self.encode_block(pa.array([text or ""], pa.string()))[0].as_py()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def joined(ids: pa.BinaryArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of an array of texts, how many each text has)."""
    bounds = _bounds(ids)
    raw = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return np.frombuffer(raw.tobytes(), dtype), (np.diff(bounds) // np.dtype(dtype).itemsize).astype(np.int64)
