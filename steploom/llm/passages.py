"""Operator 12: substring dedup at the level of bytes, by a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. One transform of a whole
corpus fits no machine, so strings are dealt out first, such that all places of one string meet:

* The anchor of a string is the least hash of an ANCHOR-gram in it, so equal strings have equal anchors, and neighbouring strings mostly
  share one. Documents are dealt in blocks; a block names its anchors once each. Those that two documents have are told to the blocks.
* A block sends, for each run of strings with such an anchor, the run's bytes (once for equal runs), a row for each tray of
  anchors. In a tray, lots of anchors are put together up to LOT bytes; their runs are one text, of which `bwt.boundaries` derives
  the common prefixes from 0 up to LENGTH: suffixes between two places with shorter ones are one string, and all but the places in
  its first document are repeats. Trays are larger than lots, since a block has a row for each.
* Where very many documents share an anchor (a common line), the runs around it differ in what stands beside it. There the strings
  go one by one, dealt by their own hash, and are merged in two levels: first in SALTS parts, then what was first in each.

A text that an earlier document has as a whole takes no part: it goes as a whole, and where its strings are first is in that
document or before. What a key has in one task is bounded by the number of blocks (one entry each, of about 10 bytes for an anchor;
a block is some megabytes of text), not of documents.

Anchors are compared by 48 bits (a chance match sends a run too many), strings by their bytes, whole texts by 128 bits.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; of rows with equal doc_ids none is earlier than the
other; a row without a doc_id cannot be compared, loses nothing and is nobody's reference; an empty table gives no rows.
Further columns are ignored. What is kept may end within a character, so it is bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bwt import ranges, repeats_in
from .common import column, mixed, record_batch, shuffle_partitions, stored
from .rlz import planes, unplaned

LENGTH, ANCHOR = 50, 24
#: Bytes of text in a block, about, and of those that are worked on at once; keys of anchors in a bucket.
BLOCK, SLICE, KEYS = 16_000_000, 150_000, 2_000_000
#: Bytes of text for each tray, lots in a tray, and bytes of runs in one transform, about.
TRAY, LOTS, LOT = 16_000_000, 256, 250_000
#: Documents that share an anchor before its strings go one by one, and parts in which these are merged first.
HOT, SALTS = 20_000, 64

LOW48 = np.uint64((1 << 48) - 1)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` bytes: polynomials, put together from runs of powers of two."""
    power, h, k = _BASE, _BYTES[data], 1
    out, got = None, 0
    while True:
        if size & k:
            out, got = (h, k) if out is None else (out[: len(h) - got] * np.uint64(power) + h[got : got + len(out)], got + k)
            out = out[: max(len(data) - got + 1, 0)]
        if 2 * k > size:
            return mixed(out)
        h = h[:-k] * np.uint64(power) + h[k:] if len(h) > k else h[:0]
        power, k = power * power % (1 << 64), 2 * k


def anchors(data: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes, 48 bits of the least hash of an ANCHOR-gram in them."""
    low, width, k = gram_hashes(data, ANCHOR), LENGTH - ANCHOR + 1, 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:]) if len(low) > k else low[:0]
        k *= 2
    rest = width - k
    return (np.minimum(low[: len(low) - rest], low[rest:]) if len(low) > rest else low[:0]) & LOW48


def dealt(keys: np.ndarray, lots: int) -> np.ndarray:
    """The lot that each key of 48 bits is in, in the order of the keys."""
    return ((keys >> np.uint64(16)) * np.uint64(lots) >> np.uint64(32)).astype(np.int64)


def string_hashes(strings: np.ndarray) -> np.ndarray:
    """Of each row of bytes, a hash."""
    padded = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    padded[:, : strings.shape[1]] = strings
    h = np.full(len(strings), _BASE, np.uint64)
    for word in padded.view(np.uint64).T:
        h = mixed(h ^ word)
    return h


def binary(data: np.ndarray | bytes, sizes: np.ndarray) -> pa.Array:
    """Strings of these sizes, which follow each other in the data."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def distinct(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different strings, and of each string the number of its equal there."""
    found = strings.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def in_lots(strings: pa.Array, lot: np.ndarray, of: np.ndarray, places: list[np.ndarray]) -> tuple:
    """The strings by lot: where each ends in the bytes of all (after a 0), those bytes, the lots; and in that order, the number of each place's string, and the places."""
    by = np.argsort(lot, kind="stable")
    rank = np.empty_like(by)
    rank[by] = np.arange(len(by))
    taken = strings.take(pa.array(by))
    of = rank[of]
    put = np.argsort(of, kind="stable")
    _, ends, data = taken.buffers()
    ends = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return ends, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), lot[by], of[put], [x[put] for x in places]


class Block:
    """The documents of a block in a fixed order, those without a part in the search left out of `runs`."""

    def __init__(self, table: pa.Table, copies: set[tuple[int, int]]):
        ids, whole = (table.column(c).to_numpy() for c in ("doc_id", "whole"))
        order = np.lexsort((whole, ids))
        texts = table.column("text").to_pylist()
        self.ids, self.texts = ids[order], [texts[i] or b"" for i in order.tolist()]
        self.copy = np.array([x in copies for x in zip(self.ids.tolist(), whole[order].tolist())], bool)

    def runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Document (its number here), start, number of strings, and anchor, of runs of strings with one anchor; a piece of the block at a time.
        Further, where each run begins in the bytes of the piece, and those bytes.

        A long text is cut into pieces of SLICE strings, which overlap by a string less a byte; a run that a cut meets is two.
        """
        some, size = [], 0
        for i, t in enumerate(self.texts):
            if len(t) >= LENGTH and not self.copy[i]:
                for at in range(0, len(t) - LENGTH + 1, SLICE):
                    stop = min(at + SLICE + LENGTH - 1, len(t))
                    some.append((i, at, stop))
                    size += stop - at
                    if size >= SLICE:
                        yield self._runs(some)
                        some, size = [], 0
        if some:
            yield self._runs(some)

    def _runs(self, some: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        docs, starts, stops = np.array(some, np.int64).T
        sizes = stops - starts
        first = np.cumsum(sizes) - sizes
        past = first + sizes - LENGTH + 1  # from here to the next text, no string begins
        data = np.frombuffer(b"".join([self.texts[i][a:b] for i, a, b in some]), np.uint8)
        key = anchors(data)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[first] = True
        new[past[:-1]] = True
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(key)))
        of = np.searchsorted(first, begin, "right") - 1
        real = begin < past[of]
        begin, n, of = begin[real], n[real], of[real]
        return docs[of], starts[of] + begin - first[of], n, key[begin], begin, data


ANCHORS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
TOLD = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary()), ("ids", pa.binary()), ("wholes", pa.binary())])
TOLD_DDL = "block long, keys binary, hot binary, ids binary, wholes binary"
PLACES = [("docs", 8), ("blocks", 4), ("rows", 4), ("starts", 4), ("n", 4)]
RUNS_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("data", "sizes", "lots", "of")], *[(c, pa.binary()) for c, _ in PLACES]])
RUNS_DDL = "bucket long, kind int, block long, data binary, sizes binary, lots binary, of binary, docs binary, blocks binary, rows binary, starts binary, n binary"
#: Kinds of rows: places that are repeats; runs of strings; single strings of hot anchors, in parts, and those that were first in their part.
FOUND, RUN, PART, WHOLE = range(4)


def copies_in(told: pa.Table) -> set[tuple[int, int]]:
    out = set()
    for a, b in zip(told.column("ids").to_pylist(), told.column("wholes").to_pylist()):
        if a:
            out.update(zip(unplaned(a).view(np.int64).tolist(), unplaned(b).view(np.int64).tolist()))
    return out


def block_anchors(block: int, texts: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """A block's anchors by bucket, each with the number of its documents that have it (255 at most)."""
    docs, keys = [], []
    for doc, _, _, key, _, _ in Block(texts, copies_in(told)).runs():
        docs.append(doc)
        keys.append(key)
    if not docs:
        return ANCHORS.empty_table()
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(keys)
    docs, keys = docs[order], keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(heads, len(keys)))
    several = n > 1
    if several.any():  # runs so far; of those in one document, one counts
        some = np.repeat(several, n)
        k, d = keys[some], docs[some]
        by = np.lexsort((d, k))
        k, d = k[by], d[by]
        again = np.append(False, (k[1:] == k[:-1]) & (d[1:] == d[:-1]))
        n[several] -= np.add.reduceat(again.astype(np.int64), np.cumsum(n[several]) - n[several])
    keys = keys[heads]
    bucket = dealt(keys, buckets)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    n = np.minimum(n, 255).astype(np.uint8)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        delta = keys[a:b].copy()
        delta[1:] -= keys[a : b - 1]
        out.append((int(bucket[a]), block, planes(delta, 8)[: 6 * (b - a)], n[a:b].tobytes()))
    return pa.Table.from_batches([record_batch(ANCHORS, *zip(*out))])


def shared_anchors(rows: pa.Table) -> pa.Table:
    """Of a bucket: to each block, those of its anchors that two documents have, and which of them are hot."""
    keys = [np.cumsum(unplaned(x + bytes(len(x) // 3)), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("n").to_pylist()]).astype(np.int64)
    sizes = [len(x) for x in keys]
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    total = np.empty(len(keys), np.int64)
    total[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out, at = [], 0
    for block, size in zip(rows.column("block").to_pylist(), sizes):
        t, k = total[at : at + size], keys[at : at + size]
        some = t > 1
        if some.any():
            out.append((block, planes(k[some]), np.packbits(t[some] > HOT).tobytes(), b"", b""))
        at += size
    return pa.Table.from_batches([record_batch(TOLD, *zip(*out))]) if out else TOLD.empty_table()


def split_places(docs: np.ndarray, of: np.ndarray, strings: int) -> np.ndarray:
    """Of each string (of is its number), the least doc_id."""
    least = np.full(strings, np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    return least


def found_row(block: int, places: list[np.ndarray]) -> tuple:
    return (block, FOUND, block, b"", b"", b"", b"", *(planes(x, size) for x, (_, size) in zip(places, PLACES)))


def tray_rows(kind: int, block: int, bucket: Callable[[int], int], strings: pa.Array, lot: np.ndarray, of: np.ndarray, places: list[np.ndarray]) -> list[tuple]:
    """A row of RUNS_SCHEMA for each tray: its different strings, by lot, and their places. A lot's tray is the number before its last LOTS; `bucket` names a tray's bucket."""
    ends, data, lot, of, places = in_lots(strings, lot, of, places)
    tray, sizes, lots = lot // LOTS, np.diff(ends), (lot % LOTS).astype(np.uint8)
    cuts = np.append(np.flatnonzero(np.diff(tray, prepend=-1)), len(tray))
    at = np.searchsorted(of, cuts).tolist()
    cuts = cuts.tolist()
    return [
        (bucket(int(tray[a])), kind, block, data[ends[a] : ends[b]].tobytes(), planes(sizes[a:b], 4), lots[a:b].tobytes(), planes(of[x:y] - a, 4), *(planes(p[x:y], size) for p, (_, size) in zip(places, PLACES)))
        for a, b, x, y in zip(cuts, cuts[1:], at, at[1:])
    ]


def block_runs(block: int, texts: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """A block's runs of strings that have a shared anchor, by bucket; places that this block already knows to be repeats, as such."""
    docs = Block(texts, copies_in(told))
    keys = [unplaned(x) for x in told.column("keys").to_pylist() if x]
    if not keys:
        return RUNS_SCHEMA.empty_table()
    hot = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8))[: len(k)] for h, k in zip((h for h, k in zip(told.column("hot").to_pylist(), told.column("keys").to_pylist()) if k), keys)])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys, hot = keys[order], hot[order].astype(bool)
    parts, salt = max(buckets // 4, 1), mixed(np.array([block % SALTS + 1], np.uint64))
    low = np.uint64((1 << 22) - 1)
    maybe = np.zeros(int(low) + 1, bool)  # most anchors are not shared, and most of those are seen here not to be
    maybe[keys & low] = True
    pieces: dict[int, list[tuple]] = {RUN: [], PART: []}

    def add(kind: int, data: np.ndarray, sizes: np.ndarray, lot: np.ndarray, *places: np.ndarray) -> None:
        strings, of = distinct(binary(data, sizes))
        lots = np.empty(len(strings), np.int64)
        lots[of] = lot
        pieces[kind].append((strings, lots, of, *places))

    for row, start, n, key, at, data in docs.runs():
        some = np.flatnonzero(maybe[key & low])
        where = np.minimum(np.searchsorted(keys, key[some]), len(keys) - 1)
        same = keys[where] == key[some]
        some, one_by_one = some[same], hot[where[same]]
        runs, single = some[~one_by_one], some[one_by_one]
        if len(runs):
            sizes = n[runs] + LENGTH - 1
            add(RUN, data[ranges(at[runs], at[runs] + sizes)[0]], sizes, dealt(key[runs], buckets * LOTS), row[runs], start[runs], n[runs])
        if len(single):
            each, of = ranges(at[single], at[single] + n[single])
            strings, single = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[each], single[of]
            lot = dealt(mixed(string_hashes(strings) + salt) & LOW48, parts * LOTS)
            add(PART, strings.ravel(), np.full(len(each), LENGTH), lot, row[single], start[single] + each - at[single], np.ones(len(each), np.int64))
    out, known = [], []
    for kind, some in pieces.items():
        if some:
            each, lots, of, rows, starts, n = zip(*some)
            before = np.cumsum([0] + [len(x) for x in each])
            strings, number = distinct(pa.concat_arrays(each))
            lot = np.empty(len(strings), np.int64)
            lot[number] = np.concatenate(lots)
            of = number[np.concatenate([x + b for x, b in zip(of, before)])]
            rows, starts, n = (np.concatenate(x) for x in (rows, starts, n))
            ids = docs.ids[rows]
            places = [ids, np.full(len(rows), block), rows, starts, n]
            repeated = ids > split_places(ids, of, len(strings))[of]
            known.append([x[repeated] for x in places])
            out += tray_rows(kind, block, (lambda t: t) if kind == RUN else (lambda t: buckets + t), strings, lot, of[~repeated], [x[~repeated] for x in places])
    known = [np.concatenate(x) for x in zip(*known)]
    if known and len(known[0]):
        out.append(found_row(block, known))
    return pa.Table.from_batches([record_batch(RUNS_SCHEMA, *zip(*out))]) if out else RUNS_SCHEMA.empty_table()


def merged(rows: pa.Table, lots: int) -> pa.Table:
    """Of a bucket: the places that are repeats, to each block; and those that were first in their part, for the next merge."""
    of_kind = lambda kind: rows.filter(pc.equal(rows.column("kind"), kind))
    known = of_kind(FOUND)
    found, left = [[_column(known, c, size) for c, size in PLACES]] if len(known) else [], []
    for kind in (RUN, PART, WHOLE):
        some = of_kind(kind)
        if len(some):
            for data, sizes, of, places in _lots(some):
                first_of, base = _firsts(data, sizes, of, places[0])
                hits, missed = _judged(of, places, first_of, base)
                found.append(hits)
                if kind == PART:
                    left.append((data.reshape(-1, LENGTH)[of[missed]], *(x[missed] for x in places)))
    found = [np.concatenate(x) for x in zip(*found)]
    out = (_passed_on(left, lots) if left else []) + (_by_block(found) if found else [])
    return pa.Table.from_batches([record_batch(RUNS_SCHEMA, *zip(*out))]) if out else RUNS_SCHEMA.empty_table()


def _column(rows: pa.Table, name: str, size: int) -> np.ndarray:
    return np.concatenate([unplaned(x, size) for x in rows.column(name).to_pylist()]).view(np.int64)


def _lots(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The different strings of all rows, in lots that are put together up to LOT bytes: their bytes and sizes, of each place the number of its string, and the places."""
    data, sizes, lots, of = (rows.column(c).to_pylist() for c in ("data", "sizes", "lots", "of"))
    sizes = [unplaned(x, 4).astype(np.int64) for x in sizes]
    before = np.cumsum([0] + [len(x) for x in sizes])
    of = np.concatenate([unplaned(x, 4).astype(np.int64) + b for x, b in zip(of, before)])
    strings, number = distinct(binary(b"".join(data), np.concatenate(sizes)))
    lot = np.empty(len(strings), np.uint8)
    lot[number] = np.frombuffer(b"".join(lots), np.uint8)
    ends, data, lot, of, places = in_lots(strings, lot, number[of], [_column(rows, c, size) for c, size in PLACES])
    heads = [*np.flatnonzero(np.diff(lot)) + 1, len(lot)]
    cuts = [0]
    for a, b in zip([0, *heads], heads):
        if a > cuts[-1] and ends[b] - ends[cuts[-1]] > LOT:
            cuts.append(a)
    cuts.append(len(lot))
    at = np.searchsorted(of, cuts)
    for a, b, x, y in zip(cuts, cuts[1:], at, at[1:]):
        yield data[ends[a] : ends[b]], np.diff(ends[a : b + 1]), of[x:y] - a, [p[x:y] for p in places]


def _firsts(data: np.ndarray, sizes: np.ndarray, of: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start of LENGTH bytes in each string in turn, the first document that has those bytes; and where each string's begin."""
    least = split_places(docs, of, len(sizes))
    fits = sizes - LENGTH + 1
    base = np.cumsum(fits) - fits
    owner, at, group = repeats_in(data, sizes, LENGTH)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    out = np.empty(int(fits.sum()), np.int64)
    out[base[owner] + at] = np.repeat(np.minimum.reduceat(least[owner], heads), np.diff(np.append(heads, len(group))))
    return out, base


def _judged(of: np.ndarray, places: list[np.ndarray], first_of: np.ndarray, base: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The repeats among the places, string by string of LENGTH bytes, what follows on in a place as one; and the places with none."""
    docs, blocks, rows, starts, n = places
    each, which = ranges(base[of], base[of] + n)
    hit = first_of[each] < docs[which]
    edge = np.ones(len(each), bool)
    edge[1:] = (which[1:] != which[:-1]) | (hit[1:] != hit[:-1])
    a = np.flatnonzero(edge)
    length = np.diff(np.append(a, len(each)))
    a, length = a[hit[a]], length[hit[a]]
    w = which[a]
    missed = np.ones(len(of), bool)
    missed[w] = False
    return [docs[w], blocks[w], rows[w], starts[w] + each[a] - base[of[w]], length], np.flatnonzero(missed)


def _passed_on(left: list[tuple], lots: int) -> list[tuple]:
    """Rows of WHOLE, one for each bucket: single strings and their places."""
    strings, *places = (np.concatenate(x) for x in zip(*left))
    strings, of = distinct(binary(strings.ravel(), np.full(len(strings), LENGTH)))
    each = np.frombuffer(strings.buffers()[2], np.uint8)[: len(strings) * LENGTH] if len(strings) else np.zeros(0, np.uint8)
    lot = dealt(string_hashes(each.reshape(-1, LENGTH)) & LOW48, lots * LOTS)
    return tray_rows(WHOLE, -1, lambda t: -1 - t, strings, lot, of, places)


def _by_block(places: list[np.ndarray]) -> list[tuple]:
    by = np.argsort(places[1], kind="stable")
    blocks = places[1][by]
    cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
    return [found_row(int(blocks[a]), [x[by[a:b]] for x in places]) for a, b in zip(cuts, [*cuts[1:], len(by)])]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary"


def without(doc_id: int | None, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    """A row of RESULT: the text without the bytes from starts to ends (which may overlap)."""
    if not len(starts):
        return doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest(), [], text
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    a, b = starts[new], ends[np.append(new[1:], True)]
    kept = b"".join([text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)])])
    return doc_id, len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), np.stack([a, b], axis=1).tolist(), kept


def block_results(texts: pa.Table, told: pa.Table, copies: pa.Table) -> pa.Table:
    docs = Block(texts, copies_in(copies))
    found = [[unplaned(x, size).view(np.int64) for x in told.column(c).to_pylist()] for c, size in PLACES]
    _, _, rows, starts, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    by = np.argsort(rows, kind="stable")
    rows, starts, ends = rows[by], starts[by], (starts + n + LENGTH - 1)[by]
    cuts = np.searchsorted(rows, np.arange(len(docs.texts) + 1))
    out = []
    for i, text in enumerate(docs.texts):
        s, e = (np.array([0]), np.array([len(text)])) if docs.copy[i] else (starts[cuts[i] : cuts[i + 1]], ends[cuts[i] : cuts[i + 1]])
        out.append(without(int(docs.ids[i]), text, s, e))
    return pa.Table.from_batches([record_batch(RESULT, *zip(*out))]) if out else RESULT.empty_table()


def whole_copies(rows: DataFrame) -> DataFrame:
    """TOLD rows for the blocks: the documents whose text an earlier one has."""
    small = rows.where(F.col("size") >= LENGTH).select("block", "doc_id", "whole", "check")
    firsts = small.groupBy("whole", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("whole", "check", "first")
    # Written first: Spark splits the many rows of a hot text only where nothing stands between the join and its exchanges.
    found = small.join(stored(firsts, "firsts"), ["whole", "check"]).where("first < doc_id").select("block", "doc_id", "whole")

    def packed(part: pa.Table) -> pa.Table:
        ids, whole = (part.column(c).to_numpy() for c in ("doc_id", "whole"))
        return pa.Table.from_batches([record_batch(TOLD, [part.column("block")[0].as_py()], [b""], [b""], [planes(ids.view(np.uint64))], [planes(whole.view(np.uint64))])])

    return stored(found.groupBy("block").applyInArrow(packed, TOLD_DDL), "copies")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end) and kept (bytes)."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    # The second hash has the text behind a fixed value, so it does not follow from the first.
    every = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("whole"), F.xxhash64(F.lit(1), text).alias("check"))
    # Written, so that the texts are read twice only: for their sizes and hashes, and to be dealt out.
    named = stored(every.select("doc_id", "whole", "check", F.octet_length("text").alias("size")), "named")
    total = named.agg(F.sum("size").alias("n")).first()["n"] or 0
    partitions = shuffle_partitions(spark)
    blocks = max(total // BLOCK + 1, 2 * partitions)
    # An anchor stands for about 14 strings; a run has about 63 bytes, and most runs are not sent.
    buckets, trays = max(total // (14 * KEYS) + 1, partitions), max(total // TRAY + 1, partitions)
    in_blocks = lambda rows: rows.where("doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id", "whole"), F.lit(blocks)))
    rows, copies = in_blocks(every), whole_copies(in_blocks(named))
    # All three rounds deal the texts alike, so they share one shuffle.
    texts = rows.select("block", "doc_id", "whole", "text").groupBy("block")
    block_of = lambda t, told: (t if len(t) else told).column("block")[0].as_py()

    # A block without texts is none: all that is told to a block comes from its texts.
    anchored = texts.cogroup(copies.groupBy("block")).applyInArrow(lambda t, told: block_anchors(block_of(t, told), t, told, buckets), "bucket long, block long, keys binary, n binary")
    shared = anchored.groupBy("bucket").applyInArrow(shared_anchors, TOLD_DDL)
    sent = texts.cogroup(shared.unionByName(copies).groupBy("block")).applyInArrow(lambda t, told: block_runs(block_of(t, told), t, told, trays), RUNS_DDL)
    for _ in range(2):  # what is left after the first merge is little
        sent = sent.groupBy("bucket").applyInArrow(lambda part: merged(part, max(trays // 4, partitions)), RUNS_DDL)
    nothing = F.lit(b"")
    found = sent.select("block", *[c for c, _ in PLACES], nothing.alias("ids"), nothing.alias("wholes")).unionByName(copies.select("block", *[nothing.alias(c) for c, _ in PLACES], "ids", "wholes"))
    out = texts.cogroup(found.groupBy("block")).applyInArrow(lambda t, told: block_results(t, told, told), RESULT_DDL)

    def as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            yield record_batch(RESULT, *zip(*[without(None, t or b"", none, none) for t in column(batch, "text")])) if len(batch) else record_batch(RESULT, *[[] for _ in RESULT])

    return out.unionByName(every.where("doc_id is null").select("text").mapInArrow(as_they_are, RESULT_DDL))
