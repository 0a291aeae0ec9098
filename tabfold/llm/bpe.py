"""Byte-level BPE encoding and decoding.

Texts are cut into the slices of the usual pre-tokenisation pattern (contractions, words, numbers, other
signs, white space; each but white space with one blank before it) without a regular expression: code
points become class numbers, every class is a function on eight states, and an associative scan of those
functions gives the state before each code point, from which the cuts follow.  Slices are merged by
rank through a cache.  Null texts are empty and give no ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabfold.llm.arrays import flat, mix, short_batches, slices

LETTER, NUMBER, BLANK, SPACE, OTHER, SHORT, LONG, STOP = range(8)
IN_WORD, IN_NUMBER, IN_OTHER, AFTER_BLANK, AFTER_SPACE, ONE_MORE, TWO_MORE, FRESH = range(8)

#: Code points of the White_Space property. Fixed values.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions after an apostrophe. Fixed values.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

BLOCK = 64
#: Bytes of text cut and looked up at once; a longer text is worked on alone.
SLICE = 1 << 19
#: Longest slices that are keys, in bytes, and places for the keys of each kind.
KEY_BYTES = (16, 32)
PLACES = 1 << 19
#: Ids kept before the cache is emptied, and longer slices kept besides.
POOL = 1 << 22
CACHED_SLICES = 50_000
SHORT_SLICE = 100
NO_RANK = 1 << 40
#: By the number of bytes a word holds: ones in the bytes beyond.
_FILL = np.array([(1 << 64) - (1 << 8 * n) for n in range(8)] + [0], np.uint64)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            kinds[point] = LETTER
        elif major == "N":
            kinds[point] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    kinds[32] = BLANK
    kinds[-1] = STOP
    return kinds


def _next_state(kind: int, state: int) -> int:
    if kind == LETTER:
        return {TWO_MORE: ONE_MORE, ONE_MORE: FRESH}.get(state, IN_WORD)
    if kind in (SHORT, LONG):
        if state in (IN_OTHER, AFTER_BLANK):
            return IN_OTHER
        return ONE_MORE if kind == SHORT else TWO_MORE
    return {NUMBER: IN_NUMBER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, OTHER: IN_OTHER, STOP: FRESH}[kind]


#: States in which a class goes on with the running slice.
_GOES_ON = {
    LETTER: {IN_WORD, AFTER_BLANK, ONE_MORE, TWO_MORE},
    NUMBER: {IN_NUMBER, AFTER_BLANK},
    OTHER: {IN_OTHER, AFTER_BLANK},
    SHORT: {IN_OTHER, AFTER_BLANK},
    LONG: {IN_OTHER, AFTER_BLANK},
    BLANK: {AFTER_BLANK, AFTER_SPACE},
    SPACE: {AFTER_BLANK, AFTER_SPACE},
    STOP: set(),
}


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function id of each class, composition table, function values, and the cut table by state and class."""
    known: dict[tuple[int, ...], int] = {}
    for kind in range(8):
        known.setdefault(tuple(_next_state(kind, s) for s in range(8)), len(known))
    known.setdefault(tuple(range(8)), len(known))
    of_class = [known[tuple(_next_state(kind, s) for s in range(8))] for kind in range(8)]
    grew = True
    while grew:
        before = len(known)
        for first in list(known):
            for then in list(known):
                known.setdefault(tuple(then[s] for s in first), len(known))
        grew = len(known) > before
    values = np.array(list(known), np.uint8)
    compose = np.array([[known[tuple(then[s] for s in first)] for then in known] for first in known], np.uint8)
    cuts = np.array([[s not in _GOES_ON[k] for k in range(8)] for s in range(8)])
    return np.array(of_class, np.uint8), compose, values, cuts


def _scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition."""
    _, compose, _, _ = _machine()
    size = len(functions)
    if size <= BLOCK:
        out = functions.copy()
        for i in range(1, size):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-size // BLOCK)
    same = _identity()
    table = np.full(rows * BLOCK, same, np.uint8)
    table[:size] = functions
    table = np.ascontiguousarray(table.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        table[i] = compose[table[i - 1], table[i]]
    before = np.empty(rows, np.uint8)
    before[0] = same
    before[1:] = _scan(table[-1])[:-1]
    return compose[before[None, :], table].T.reshape(-1)[:size]


@lru_cache(maxsize=1)
def _identity() -> int:
    _, _, values, _ = _machine()
    return int(np.flatnonzero((values == np.arange(8)).all(axis=1))[0])


def cuts(points: np.ndarray) -> np.ndarray:
    """For code points of texts, each followed by the stop sign ``maxunicode + 1``: where slices begin."""
    kinds = class_table()[points]
    following = np.append(points[1:], points[-1:])
    second = np.append(points[2:], [sys.maxunicode + 1] * 2)[: len(points)]
    mark = np.flatnonzero(points == ord("'"))
    if len(mark):
        one, two = following[mark], second[mark]
        kinds[mark[np.isin(one, [ord(c) for c in ONE_LETTER])]] = SHORT
        for pair in TWO_LETTERS:
            kinds[mark[(one == ord(pair[0])) & (two == ord(pair[1]))]] = LONG
    of_class, _, values, cut = _machine()
    after = values[_scan(of_class[kinds]), FRESH]
    state = np.append(np.uint8(FRESH), after[:-1])
    begins = cut[state, kinds]
    white = (kinds == BLANK) | (kinds == SPACE)
    last = np.append(~(white[1:] | (kinds[1:] == STOP)), False)
    return begins | (white & last)


def slice_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every slice of UTF-8 texts laid end to end, and the slices of each text."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at_byte = np.concatenate([[0], np.cumsum(width)])
    ends = np.searchsorted(at_byte, offsets[1:]) + np.arange(len(offsets) - 1)
    stopped = np.full(len(points) + len(ends), sys.maxunicode + 1, np.uint32)
    inside = np.ones(len(stopped), bool)
    inside[ends] = False
    stopped[inside] = points
    if not len(stopped):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # every stop sign is a cut, and ends the slice before it
    at = np.flatnonzero(cuts(stopped))
    stop = ~inside[at]
    byte = at_byte[at - (np.cumsum(stop) - stop)]
    first = np.flatnonzero(~stop)
    count = np.diff(np.concatenate([[0], np.cumsum(~stop)[stop]]))
    return byte[first], byte[first + 1], count


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return ranks, pieces


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Joins the neighbours of the lowest rank, the leftmost first, until none has a rank."""
    if piece in ranks:
        return (ranks[piece],)
    return _merge_short(piece, ranks) if len(piece) <= SHORT_SLICE else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    get = ranks.get
    cut = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == NO_RANK:
            break
        i = pairs.index(low)
        del cut[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cut[i] : cut[i + 2]], NO_RANK)
        if i:
            pairs[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], NO_RANK)
    return tuple([ranks[piece[a:b]] for a, b in zip(cut, cut[1:])])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap, for slices on which a scan per join would be quadratic."""
    size = len(piece)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    end = list(range(1, size + 1))
    heap = []
    for i in range(size - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * size
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= size or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i] = stop
        after[i] = after[j]
        if after[j] < size:
            before[after[j]] = i
            longer = end[after[j]]
            rank = ranks.get(piece[i:longer])
            if rank is not None:
                heapq.heappush(heap, (rank, i, longer))
        if before[i] >= 0:
            rank = ranks.get(piece[before[i] : stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], stop))
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return tuple(out)


@lru_cache(maxsize=2)
def _pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys ``left << 32 | right`` of all pairs that join, the joined ids, and the ids of single bytes."""
    ranks, _ = load_ranks(path)
    found = []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                found.append((left << 32 | right, rank))
    table = np.array(sorted(found), np.int64).reshape(-1, 2)
    return table[:, 0].copy(), table[:, 1].copy(), np.array([ranks[bytes([i])] for i in range(256)], np.int64)


def merge_many(data: np.ndarray, sizes: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """``merge`` of many slices laid end to end: each round joins one pair in every slice that still has one.

    Returns the ids end to end and their number in each slice.
    """
    keys, joined, single = _pair_table(path)
    token = single[data]
    owner = np.repeat(np.arange(len(sizes)), sizes)

    def ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, joined[at], NO_RANK)

    rank = np.full(len(token), NO_RANK)
    same = np.flatnonzero(owner[1:] == owner[:-1])
    rank[same] = ranked(token[same], token[same + 1])
    done_tokens, done_owners = [], []
    while len(token):
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        count = np.diff(np.append(start, len(owner)))
        low = np.minimum.reduceat(rank, start)
        over = np.repeat(low == NO_RANK, count)
        done_tokens.append(token[over])
        done_owners.append(owner[over])
        at = np.flatnonzero((rank == np.repeat(low, count)) & ~over)
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
        token[at] = rank[at]
        keep = ~over
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        token, owner, rank = token[keep], owner[keep], rank[keep]
        at = place[at]
        for left in (at, at[at > 0] - 1):
            inside = left + 1 < len(token)
            left = left[inside]
            linked = owner[left] == owner[left + 1] if len(left) else np.zeros(0, bool)
            rank[left[~linked]] = NO_RANK
            left = left[linked]
            rank[left] = ranked(token[left], token[left + 1])
        if len(at) and at[-1] == len(token) - 1:
            rank[-1] = NO_RANK
    tokens, owners = np.concatenate(done_tokens), np.concatenate(done_owners)
    return tokens[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(sizes))


def _positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of every range, end to end."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _differ(keys: list[np.ndarray], place: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    out = keys[0][place] != own[0]
    for kept, k in zip(keys[1:], own[1:]):
        out |= kept[place] != k
    return out


class SliceCache:
    """Ids of slices seen before, in arrays.

    A slice of at most ``KEY_BYTES[-1]`` bytes is its own key: its bytes in 64-bit words, filled up with a byte that
    UTF-8 never has.  Each key has two places, where a later key may replace an earlier one, so memory is bounded; the
    ids lie in a pool that is emptied when full.  Longer slices are merged one by one through a small dictionary.
    """

    def __init__(self, path: str):
        self.path = path
        self.ranks, _ = load_ranks(path)
        self.clear()

    def clear(self) -> None:
        # words of ones belong to no key
        self.keys = [[np.full(PLACES, _FILL[0]) for _ in range(size // 8)] for size in KEY_BYTES]
        self.begin = [np.zeros(PLACES, np.int64) for _ in KEY_BYTES]
        self.count = [np.zeros(PLACES, np.int32) for _ in KEY_BYTES]
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _add(self, ids: np.ndarray) -> int:
        """The place of new ids in the pool."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            grown = np.zeros(max(self.used, 2 * len(self.pool)), np.int32)
            grown[:at] = self.pool[:at]
            self.pool = grown
        self.pool[at : self.used] = ids
        return at

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices end to end, and their number in each slice."""
        if self.used > POOL:
            self.clear()
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        padded = np.concatenate([data, np.zeros(KEY_BYTES[-1], np.uint8)])
        words = np.ndarray((len(data) + KEY_BYTES[-1] - 7,), "<u8", padded, strides=(1,))
        sizes = ends - starts
        least = 0
        for level, most in enumerate(KEY_BYTES):
            own = np.flatnonzero((sizes > least) & (sizes <= most))
            if len(own):
                begin[own], count[own] = self._short(level, padded, words, starts[own], sizes[own])
            least = most
        for i in np.flatnonzero(sizes > least).tolist():
            piece = data[starts[i] : ends[i]].tobytes()
            found = self.long.get(piece)
            if found is None:
                ids = np.array(merge(piece, self.ranks), np.int32)
                found = (self._add(ids), len(ids))
                if len(piece) <= SHORT_SLICE and len(self.long) < CACHED_SLICES:
                    self.long[piece] = found
            begin[i], count[i] = found
        return self.pool[_positions(begin, count)], count

    def _short(self, level: int, padded: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, begins, counts = self.keys[level], self.begin[level], self.count[level]
        own = []
        code = np.zeros(len(starts), np.uint64)
        for w in range(len(keys)):
            own.append(words[starts + 8 * w] | _FILL[np.clip(sizes - 8 * w, 0, 8)])
            code = mix(code ^ own[-1])
        near = (code & np.uint64(PLACES - 1)).astype(np.int64)
        begin, count = begins[near], counts[near].astype(np.int64)
        miss = np.flatnonzero(_differ(keys, near, own))
        if len(miss):
            far = (code[miss] >> np.uint64(40) & np.uint64(PLACES - 1)).astype(np.int64)
            begin[miss], count[miss] = begins[far], counts[far]
            still = _differ(keys, far, [k[miss] for k in own])
            miss, far = miss[still], far[still]
        if len(miss):
            # equal keys end to end, each merged once
            order = np.lexsort([k[miss] for k in own])
            fresh = np.zeros(len(miss), bool)
            fresh[0] = True
            for k in own:
                fresh[1:] |= k[miss[order[1:]]] != k[miss[order[:-1]]]
            one = miss[order[fresh]]
            ids, number = merge_many(padded[_positions(starts[one], sizes[one])], sizes[one], self.path)
            at = self._add(ids) + np.cumsum(number) - number
            which = np.cumsum(fresh) - 1
            begin[miss[order]], count[miss[order]] = at[which], number[which]
            # a new key takes its first place if that is free, else its second; of several for one place the last stays
            place = np.where(keys[0][near[one]] == _FILL[0], near[one], far[order[fresh]])
            stays = len(one) - 1 - np.unique(place[::-1], return_index=True)[1]
            for kept, k in zip(keys, own):
                kept[place[stays]] = k[one[stays]]
            begins[place[stays]] = at[stays]
            counts[place[stays]] = number[stays]
        return begin, count


def encode_flat(data: np.ndarray, offsets: np.ndarray, cache: SliceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of UTF-8 texts laid end to end, and ``len + 1`` offsets of the texts in them."""
    starts, ends, per_text = slice_bounds(data, offsets)
    ids, per_slice = cache.look_up(data, starts, ends)
    before = np.concatenate([[0], np.cumsum(per_slice)])
    return ids, before[np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)]


def encode_texts(texts: list[str], cache: SliceCache) -> list[list[int]]:
    data, offsets = flat(pa.array(texts, pa.string()))
    ids, bounds = encode_flat(data, offsets, cache)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def _bytes_of_ids(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids end to end, first byte and length of each."""
    _, pieces = load_ranks(path)
    sizes = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_flat(ids: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that lists of ids stand for, end to end, and ``len + 1`` offsets of the lists in them."""
    data, first, size = _bytes_of_ids(path)
    sizes = size[ids]
    before = np.concatenate([[0], np.cumsum(sizes)])
    return data[_positions(first[ids], sizes)], before[offsets]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``id, ids`` and, with ``offsets``, ``starts``: the byte at which each token starts.

    One row per input row, in any order; repeated rows stay repeated, a null text gives empty lists, other
    columns are left out.
    """
    short_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, ids array<int>" + (", starts array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, sizes = _bytes_of_ids(ranks_path)
        cache = SliceCache(ranks_path)
        for batch in slices(batches, "text", SLICE):
            ids, bounds = encode_flat(*flat(batch.column("text")), cache)
            columns = [batch.column("id"), _lists(ids, bounds)]
            if offsets:
                size = sizes[ids]
                total = np.concatenate([[0], np.cumsum(size)])
                columns.append(_lists(total[:-1] - np.repeat(total[bounds[:-1]], np.diff(bounds)), bounds))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "starts"][: len(columns)])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id, ids, decoded``: the bytes that the ids stand for.  Null ids give no bytes."""
    key = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 256
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column("ids")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                decoded = _binaries(*decode_flat(lists.flatten().to_numpy(), bounds, ranks_path))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, decoded], [id_col, "ids", "decoded"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"`{id_col}` {key}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of whole texts, after a full round trip.

    Ids and decoded bytes are hashed in the task that makes them; repeated rows stay repeated.
    """
    short_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SliceCache(ranks_path)
        for batch in slices(batches, "text", SLICE):
            ids, bounds = encode_flat(*flat(batch.column("text")), cache)
            decoded, byte = decode_flat(ids, bounds, ranks_path)
            numbers = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids).cast(pa.string()))
            written = pc.binary_join(numbers, ",").cast(pa.binary())
            raw = memoryview(np.ascontiguousarray(decoded))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(w.as_buffer()).hexdigest() for w in written]),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(byte.tolist(), byte[1:].tolist())]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
