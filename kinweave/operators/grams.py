"""Word n-grams of texts as hashes, inside a task, a slice of some megabytes of text at once.

A slice names the different grams that the dictionary may hold, once each, and keeps where they stand; the answers
come back by slice, so a frequent gram is asked for once in a slice and not at each of its places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

SLICE_CHARS = 4 << 20  # bytes of text in a slice
BLOCK_CHARS = 1 << 19  # hashed at once
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so that they have inverses modulo 2^64
ONE = np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _characters() -> tuple[np.ndarray, list[np.ndarray]]:
    """Which characters belong to words, and a random number of each for either hash."""
    n = 0x110000
    of_words = np.fromiter((chr(i).isalnum() or i == 95 for i in range(n)), bool, n)
    return of_words, [_mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(base)) for base in BASES]


@lru_cache(1)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(np.full(n, x, np.uint64).cumprod() for x in (base, pow(base, -1, 1 << 64))) for base in BASES]


class Words:
    """Words of some texts in lower case, runs of letters, digits and underscores, with hashes of their grams.

    A hash is a sum over the characters from the first word's first to the last word's last, gaps included, each
    with the power of its place, so that of any gram comes from the sums before its two ends.
    """

    def __init__(self, texts: list[str]):
        parts: list[tuple] = []
        some: list[str] = []
        size = done = 0
        for text in [*texts, None]:
            if some and (text is None or size + len(text) > BLOCK_CHARS):
                parts.append(self._block(some, done))
                done += len(some)
                some, size = [], 0
            if text is not None:
                some.append(text)
                size += len(text) + 1
        self.text, *sums = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] + [np.zeros(0, np.uint64)] * 6
        self.lanes = [sums[:3], sums[3:]]
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.start = np.arange(len(self.text)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    @staticmethod
    def _block(some: list[str], done: int) -> tuple:
        of_words, numbers = _characters()
        x = np.frombuffer("\n".join([*some, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        edge = np.flatnonzero(np.diff(of_words[x], prepend=False))
        starts, ends = edge[::2], edge[1::2]  # the last character is a gap
        begins = np.cumsum([0] + [len(t) + 1 for t in some[:-1]])
        out = [np.searchsorted(begins, starts, "right") - 1 + done]
        powers = _powers(max(BLOCK_CHARS + 1, 1 << len(x).bit_length()))
        for number, (power, back) in zip(numbers, powers):
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(number[x] * power[:len(x)], out=total[1:])
            out += [total[starts], total[ends], back[starts]]
        return tuple(out)

    def grams(self, n: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words (of the given ones) that a gram of ``n`` words begins at, and its hashes of 64 and 16 bits."""
        if words is None:
            words = np.arange(max(len(self.text) - n + 1, 0))
        words = words[words + n <= len(self.text)]
        words = words[self.text[words] == self.text[words + n - 1]]
        k1, k2 = (_mixed((after[words + n - 1] - before[words]) * back[words] + np.uint64(n)) for before, after, back in self.lanes)
        return words, k1, k2 >> np.uint64(48)


class Filter:
    """Which grams the dictionary may hold: 64 bits a slot, two of them set by a gram."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def lets_through(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mask = (ONE << (k1 >> np.uint64(32) & np.uint64(63))) | (ONE << (k2 & np.uint64(63)))
        return self.bits[k1 & np.uint64(len(self.bits) - 1)] & mask == mask


def _signed(k1: np.ndarray, k2: np.ndarray) -> list[pa.Array]:
    return [pa.array(k1.view(np.int64)), pa.array(k2.astype(np.int32))]


def hashed_phrases(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Phrases ``text`` to their hashes and number of words, and the hashes of their first ``width`` words."""
    for batch in batches:
        words = Words(batch.column("text").to_pylist())
        n = words.counts
        hashes = {c: np.zeros(len(n), np.uint64) for c in ("k1", "k2", "h1", "h2")}
        first = np.cumsum(n) - n
        for kind, length in (("k", n), ("h", np.minimum(n, width))):
            for m in np.unique(length[length > 0]):
                rows = np.flatnonzero(length == m)
                _, hashes[f"{kind}1"][rows], hashes[f"{kind}2"][rows] = words.grams(int(m), first[rows])
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in rest] + _signed(hashes["k1"], hashes["k2"]) + _signed(hashes["h1"], hashes["h2"]) + [pa.array(n, pa.int32())],
            [*rest, *hashes, "n_words"]).filter(pa.array(n > 0))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Small numbers by their bytes' places, compressed."""
    planes = np.concatenate([c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in columns])
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, columns: int, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 4 * columns * n, "zstd", asbytes=True), np.uint8).reshape(columns, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").reshape(-1).astype(np.int64) for p in planes]


def _cut_up(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        cum = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(cum[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(cum, before + most - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(cum[to - 1]) - before
            if size >= most or to < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            at = to
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


FIELDS = ["dest", "slice", "row_no", "n", "data"]


def _rows(keys: pa.RecordBatch | None, schema: pa.Schema, dest, name: int, row_no, n, data) -> pa.RecordBatch:
    size = len(dest)
    own = [pa.nulls(size, f.type) if keys is None else keys.column(f.name) for f in schema if f.name != "text"]
    return pa.RecordBatch.from_arrays(
        own + [pa.array(dest, pa.int32()), pa.array(np.full(size, name)), pa.array(row_no, pa.int32()), pa.array(n, pa.int32()),
               pa.array(data, pa.binary())], [*(f.name for f in schema if f.name != "text"), *FIELDS])


def asked(batches: Iterable[pa.RecordBatch], known, lengths: list[int], width: int, places: bool, parts: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows with a ``text`` in lower case to slices, whose rows are of three kinds.

    A row for each text with a gram has its keys and ``row_no``; one row holds where the grams stand (only in which
    texts, without ``places``), in the order of texts and places, the longer first; and for each part of the
    dictionary a row with its ``row_no`` as -1 - part holds the hashes of the different grams that it is asked for.
    """
    told = Filter(known.value)
    for number, batch in enumerate(_cut_up(batches, most)):
        words = Words(batch.column("text").to_pylist())
        found = []
        begun = None
        for n in sorted({*lengths, width} if max(lengths, default=0) > width else lengths):
            at, k1, k2 = words.grams(n, begun if n > width else None)
            passed = told.lets_through(k1, k2)
            at, k1, k2 = at[passed], k1[passed], k2[passed]
            if n == width:
                begun = at  # longer phrases are looked for where one may begin
            if n in lengths:
                found.append((at.astype(np.int32), np.full(len(at), n, np.int32), k1, k2.astype(np.uint16)))
        at, n, k1, k2 = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        if not len(at):
            continue
        text, start = words.text[at].astype(np.int32), words.start[at].astype(np.int32)
        del found, words, begun, passed
        order = np.lexsort((k2, k1))
        new = np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
        gram = np.cumsum(new, dtype=np.int32) - 1
        often = np.argsort(-np.bincount(gram), kind="stable")
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often))
        idx = np.empty(len(at), np.int32)
        idx[order] = rank[gram]
        one = order[new][often]
        k1, k2 = k1[one].view(np.int64), k2[one]
        if places:
            order = np.lexsort((-n, at))
            text, start, idx = text[order], start[order], idx[order]
            held = [idx, np.where(np.diff(text, prepend=-1) != 0, start, np.diff(start, prepend=0))]
        else:
            both = np.unique(text.astype(np.int64) * len(often) + idx)
            text, idx = both // len(often), both % len(often)
            held = [np.where(np.diff(text, prepend=-1) != 0, idx, np.diff(idx, prepend=0))]
        some, row = np.unique(text, return_inverse=True)
        name = (TaskContext.get().partitionId() << 32) | number
        home = [int(_mixed(np.array([name], np.uint64))[0] % np.uint64(parts))]
        yield _rows(batch.take(pa.array(some)), batch.schema, home * len(some), name, np.arange(len(some)), [None] * len(some), [None] * len(some))
        yield _rows(None, batch.schema, home, name, [None], [len(idx)], [_packed([np.diff(row, prepend=0), *held])])
        part = k1 % parts
        order = np.argsort(part, kind="stable")
        dest, first = np.unique(part[order], return_index=True)
        groups = np.split(order, first[1:])
        yield _rows(None, batch.schema, dest, name, -1 - dest, [len(g) for g in groups],
                    [k1[g].tobytes() + k2[g].tobytes() + _packed([np.diff(g, prepend=0)]) for g in groups])


def met(rows: pa.Table, dictionary: pa.Table, named: bool) -> pa.Table:
    """Asks of one part of the dictionary answered, the other rows as they are; an answer lists different ``told`` of grams."""
    kept = rows.drop_columns(["dest"])
    asks = pc.less(pc.fill_null(rows["row_no"], 0), 0)
    told_type = pa.list_(pa.field("element", pa.struct(
        [("n_words", pa.int32()), ("labels", dictionary.schema.field("labels").type), ("phrase", pa.string())])))
    out = [kept.filter(pc.invert(asks))]
    out[0] = out[0].append_column("told", pa.nulls(out[0].num_rows, told_type))
    asks = kept.filter(asks)
    if asks.num_rows and dictionary.num_rows:
        own = [dictionary[c].to_numpy() for c in ("k1", "k2")]
        order = np.lexsort(own[::-1])
        k1, k2 = own[0][order], own[1][order]
        if named:
            code = np.arange(len(order))
        else:  # grams with the same words and labels are told alike
            _, alike, code = np.unique(dictionary["alike"].to_numpy(), return_index=True, return_inverse=True)
            order, code = alike, code[order]
        tell = pa.StructArray.from_arrays([
            dictionary["n_words"].combine_chunks(), dictionary["labels"].combine_chunks(),
            dictionary["phrase"].combine_chunks() if named else pa.nulls(dictionary.num_rows, pa.string())], ["n_words", "labels", "phrase"])
        n, data, told = [], [], []
        for size, ask in zip(asks["n"].to_pylist(), asks["data"].to_pylist()):
            a1, a2 = np.frombuffer(ask, np.int64, size), np.frombuffer(ask, "<u2", size, 8 * size).astype(np.int64)
            idx = np.cumsum(_unpacked(ask[10 * size:], 1, size)[0])
            low, high = np.searchsorted(k1, a1, "left"), np.searchsorted(k1, a1, "right")
            at = np.full(size, -1)
            for step in range(int((high - low).max(initial=0))):  # one, unless 64 bits agree
                try_at = np.minimum(low + step, len(k1) - 1)
                at = np.where((low + step < high) & (k2[try_at] == a2), try_at, at)
            hit = at >= 0
            which, local = np.unique(code[at[hit]], return_inverse=True)
            n.append(int(hit.sum()))
            data.append(_packed([np.diff(idx[hit], prepend=0), local]))
            told.append(order[which])
        ends = np.cumsum([0] + [len(t) for t in told])
        lists = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), tell.take(pa.array(np.concatenate(told), pa.int64())).cast(told_type.value_type), type=told_type)
        answers = asks.set_column(asks.schema.get_field_index("n"), "n", pa.array(n, pa.int32()))
        answers = answers.set_column(answers.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))
        out.append(answers.append_column("told", lists).filter(pc.greater(pa.array(n), 0)))
    return pa.concat_tables(out)


def answered(rows: pa.Table, keys: list[str], what: str, longest: bool) -> pa.Table:
    """What the dictionary says of a slice's grams, told for its texts.

    ``hits``: a row for each place and label; ``labels``: for each text and label; ``counts``: for each text and
    label with the number of hits and of different phrases. ``longest`` leaves out hits inside longer ones.
    """
    number = pc.fill_null(rows["row_no"], 0)
    texts = rows.filter(pc.and_(pc.is_valid(rows["row_no"]), pc.greater_equal(number, 0))).sort_by("row_no")
    places = rows.filter(pc.is_null(rows["row_no"]))
    answers = rows.filter(pc.less(number, 0))
    n = places["n"][0].as_py()
    text, idx, *start = _unpacked(places["data"][0].as_py(), 2 if what == "labels" else 3, n)
    text = np.cumsum(text)
    first = np.searchsorted(text, text)  # the first place of the same text

    def summed(step: np.ndarray) -> np.ndarray:
        total = np.cumsum(step)
        return total - (total[first] - step[first])

    idx, start = (summed(idx), None) if what == "labels" else (idx, summed(start[0]))
    answer = np.full(int(idx.max(initial=-1)) + 1, -1)
    base = 0
    for size, data, told in zip(answers["n"].to_pylist(), answers["data"].to_pylist(), pc.list_value_length(answers["told"]).to_pylist()):
        step, local = _unpacked(data, 2, size)
        answer[np.cumsum(step)] = local + base
        base += told
    told = answers["told"].combine_chunks().flatten()
    n_words, lists, phrase = (pc.struct_field(told, c) for c in ("n_words", "labels", "phrase"))
    n_words = n_words.to_numpy()
    met = answer[idx]
    kept = met >= 0
    text, idx, met = text[kept], idx[kept], met[kept]
    if start is not None:
        start = start[kept]
        if longest and len(met):
            end = (text << 32) + start + n_words[met]
            outer = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]]) < end
            text, idx, met, start = (x[outer] for x in (text, idx, met, start))
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    many = size[met]
    place = np.repeat(np.arange(len(met)), many)
    label_at = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + begin[met][place]
    pairs = lists.flatten()
    label, pos = (pc.struct_field(pairs, c) for c in ("label", "pos"))
    out = {}
    if what == "hits":
        row, of = text[place], label_at
        out = {"start": pa.array(start[place], pa.int32()), "n_words": pa.array(n_words[met][place], pa.int32()),
               "phrase": phrase.take(pa.array(met[place]))}
    else:
        codes = [c.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for c in (label, pos)]
        code = codes[0] * (codes[1].max(initial=0) + 1) + codes[1] if what == "labels" else codes[0]
        _, some, code = np.unique(code, return_index=True, return_inverse=True)  # any place of each different label
        key = text[place] * max(len(some), 1) + code[label_at]
        if what == "counts":
            grams = int(idx.max(initial=0)) + 1
            each, n = np.unique(key * grams + idx[place], return_counts=True)
            each //= grams
            key, first = np.unique(each, return_index=True)
            out = {"n_hits": pa.array(np.add.reduceat(n, first) if len(first) else n, pa.int64()),
                   "n_phrases": pa.array(np.diff(np.append(first, len(each))), pa.int64())}
        else:
            key = np.unique(key)
        row, of = key // max(len(some), 1), some[key % max(len(some), 1)] if len(some) else key
    taken = texts.select(keys).take(pa.array(row))
    of = pa.array(of, pa.int64())
    return pa.table({**{c: taken[c] for c in keys}, **out, "pos": pos.take(of), "label": label.take(of)})
