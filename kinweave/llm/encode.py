"""Token ids of whole texts by the tokenizers library, with a bounded memo of repeated words.

Byte-level BPE never merges over the bounds of words and marks, so a text's ids are those of its
parts in turn. The bytes of many texts are cut in numpy, Arrow numbers the distinct parts, and only
those are looked up; new ones go to the library, many in one call. Latin letters, digits, ASCII
marks, spaces and line breaks are cut into words; what stands between two single spaces and holds
anything else is one part. Results equal those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
WORDS_HELD = 600_000  # entries of the memo; when it is full, a new one begins and takes over what is met again

#: kinds of bytes; from OTHER on a byte makes its part odd, one for the library to cut
LETTER, DIGIT, MARK, SPACE, BREAK, END, OTHER, BLANK = range(8)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = MARK
_KIND[[*range(32), 127]] = BLANK
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
_KIND[48:58] = DIGIT
_KIND[32], _KIND[10], _KIND[255] = SPACE, BREAK, END  # 255 is in no UTF-8 text and stands after each
_MAY_BE_BLANK = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_BLANKS = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def tokenizer_file(vocabulary: str) -> str:
    """A path as it is, or the place of a file of the installed public tokenizers."""
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _kinds(x: np.ndarray) -> np.ndarray:
    k = _KIND[x]
    at = np.flatnonzero(x == 0xC3)  # À to ÿ, of which × and ÷ are no letters
    k[at + 1] = LETTER
    at = at[(x[at + 1] == 0x97) | (x[at + 1] == 0xB7)]
    k[at] = k[at + 1] = OTHER
    at = np.flatnonzero(x == 0x7C)
    at = at[at > 0]
    at = at[x[at - 1] == 0x3C]  # <| may begin a special token
    k[at] = k[at - 1] = OTHER
    at = np.flatnonzero(_MAY_BE_BLANK[x])
    if len(at):
        two = x[at].astype(np.int64) << 8 | x[at + 1]
        three = two << 8 | x[np.minimum(at + 2, len(x) - 1)]
        for code, n in ((two, 2), (three, 3)):
            found = at[np.isin(code, _BLANKS)]
            for j in range(n):
                k[found + j] = BLANK
    return k


def parts_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts of texts that each end in a byte 255, itself a part, and starts of the odd ones."""
    k = _kinds(x)
    space = k == SPACE
    start = np.ones(len(x), bool)
    np.not_equal(k[1:], k[:-1], out=start[1:])
    start[1:] &= ~space[:-1]  # a space belongs to what follows it
    at = np.flatnonzero(k == BREAK)
    at = at[(at > 0) & (k[at - 1] == BREAK)]
    start[at[(k[at + 1] != BREAK) & (k[at + 1] != SPACE) & (k[at + 1] != END)]] = True  # the last of some before a word
    start[np.flatnonzero(k == END)] = True
    at = np.flatnonzero(x == 0x27)
    at = at[start[at] & (k[at + 1] == LETTER)]
    a, b = x[at + 1], x[np.minimum(at + 2, len(x) - 1)]
    for n, found in ((1, np.isin(a, list(b"stmd"))), (2, ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C))):
        start[at[found] + 1] = False  # 's, 't, 'm, 'd; 're, 've, 'll
        start[at[found] + 1 + n] = True
    spaces = np.flatnonzero(space)
    after = k[spaces + 1]
    odd = np.concatenate([np.flatnonzero(k >= OTHER), spaces[(after >= SPACE) & (after <= END)]])
    if len(odd):
        before = k[np.maximum(spaces - 1, 0)]
        word = [(kind <= MARK) | (kind == OTHER) for kind in (before, after)]
        ends = np.flatnonzero(k == END)
        edges = np.sort(np.concatenate([[0], spaces[word[0] & word[1] & (spaces > 0)], ends, ends + 1]))
        unit = np.unique(np.searchsorted(edges, odd, "right"))
        inside = np.zeros(len(x) + 1, np.int8)
        inside[edges[unit - 1]] += 1
        inside[edges[unit]] -= 1
        start &= np.cumsum(inside[:-1], dtype=np.int8) == 0
        odd = edges[unit - 1]
        start[odd] = True
    return np.flatnonzero(start), odd


class Encoder:
    def __init__(self, vocabulary: str, special: bool = True, held: int = WORDS_HELD) -> None:
        """``special``: strings of special tokens in a text are those tokens, not plain text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file(vocabulary))
        self.library.encode_special_tokens = not special
        self.held = held
        (self.line_break,) = self.library.encode("\n", add_special_tokens=False).ids
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes], odd: set[bytes]) -> list[bytes]:
        """The ids of distinct parts; new ones are learned."""
        out = list(map(self.words.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = {}
        for i in missing:
            out[i] = new[words[i]] = self.before.get(words[i])
        new = {w: ids for w, ids in new.items() if ids is not None}
        asked = [i for i in missing if out[i] is None]
        alone = [words[i] for i in asked if words[i] in odd or words[i][0] == 10]
        found = self.library.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)
        new.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(alone, found, strict=True))
        self._ask([words[i] for i in asked if words[i] not in odd and words[i][0] != 10], new)
        for i in asked:
            out[i] = new[words[i]]
        if len(self.words) + len(missing) > self.held:
            self.before, self.words = self.words, dict(zip(words, out, strict=True))
        else:
            self.words.update(new)
        return out

    def _ask(self, words: list[bytes], new: dict[bytes, bytes]) -> None:
        """Words without line breaks, joined by line breaks: one call for many, and a line break is one id."""
        for i in range(0, len(words), 500):
            some = words[i:i + 500]
            text = (b"\n".join(some) + b"\n").decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, np.flatnonzero(ids == self.line_break).tolist(), strict=True):
                new[w] = raw[4 * start:4 * end]
                start = end + 1

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of a large_string column without nulls, text after text, each with the ids ``end`` after it, and where each ends."""
        out = self._column(texts, end)
        pa.default_memory_pool().release_unused()  # else 100 MB stay with a worker
        return out

    def _column(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        nothing, mark = (pa.scalar(x, pa.large_binary()) for x in (b"", b"\xff"))
        data = pc.binary_join_element_wise(texts.cast(pa.large_binary()), nothing, mark).buffers()[2]
        x = np.frombuffer(data, np.uint8)
        starts, odd = parts_of(x)
        numbered = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(x))), data]).dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = numbered.indices.to_numpy()
        odd_words = {words[i] for i in at[np.searchsorted(starts, odd)].tolist()}
        mark = words.index(b"\xff")
        known = self._ids(words[:mark] + words[mark + 1:], odd_words)
        known.insert(mark, end)
        ids = pa.array(known, pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[1:len(ids) + 1]
        of_texts = ends[x[starts] == 255] // 4
        if len(of_texts) != len(texts):
            raise ValueError("a text is not UTF-8")
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4", int(ends[-1]) // 4)
        return flat, of_texts

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, without an end id."""
        some: list[str] = []
        size = 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > 1 << 20:
                yield from self._each(some)
                some, size = [], 0
        yield from self._each(some)

    def _each(self, some: list[str]) -> Iterator[bytes]:
        ids, ends = self.encode_column(pa.array(some, pa.large_string()))
        raw, start = ids.tobytes(), 0
        for end in ends.tolist():
            yield raw[4 * start:4 * end]
            start = end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, held: int = WORDS_HELD) -> Encoder:
    """One encoder for each vocabulary, size of memo and Python worker."""
    key = (vocabulary, held)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, held=held)
    return _ENCODERS[key]
