"""Operator 3: substring dedup by relative Lempel-Ziv parsing.

Every document is factored greedily against the index of all reference blocks. The index names, for each window of WINDOW
words, the first place (document, word) in which it starts. A copy factor begins at a window that has a place in an earlier
document, and runs on, word by word, as long as the reference goes on at the next word too; where it does not, the window that
straddles the factor's end is looked up anew, so every window is judged by its own key and not by the factors around it. A
factor is (start, length, source document, source word); factors that begin inside the one before are those of its boundary.
Factors have WINDOW words at least; they are the duplicate spans, and the other words are literals. A text that is, as a
whole, the text of an earlier document is one factor.

The index is exact and spread over all tasks. Listing every window of the corpus would move more bytes than the texts
hold, so it is built in two steps. Each window has an anchor, the least hash of an ANCHOR-gram in it; equal windows have
equal anchors. First, the anchors that occur in two documents are found; then only windows with such an anchor are
indexed. Keys move in sorted blocks, one for each reference block (a batch of documents) and bucket; a block names a key once,
with its first place, so a key that all documents share costs one entry for each block. Of more than MERGED blocks, so many are
merged first, and what is left of each merge is one entry a key again: no task sees a key more often than MERGED times, or once for
each merge. Anchors are compared by hashes of 64 bits, windows by 96 bits, made of two hashes of each word.

Words are runs of bytes other than ASCII white space, unchanged.

Defined cases: a null text has no words; texts shorter than a window lose nothing; with equal doc_ids, the rows are judged
as one document's, each by its own windows (none is earlier than the other); a null doc_id cannot be compared, so such rows
lose nothing and are nobody's reference. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, integers, mixed, record_batch, rolled, shuffle_partitions, slices, stored, word_pairs

WINDOW, ANCHOR = 13, 6
#: Stands for a null doc_id where documents are put in order.
LAST = (1 << 63) - 1
#: Keys that a bucket holds, about, and bytes of text in a reference block.
BUCKET, BLOCK = 200_000, 1_000_000
#: Blocks whose entries of a key meet at once, about.
MERGED = 10_000
#: Marks, in the place of a word, a text that is a copy as a whole.
WHOLE = -1


def split(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every word of all texts in turn, and how many words each has."""
    words = [t.split() if t else [] for t in texts]
    return word_pairs(words), np.array([len(w) for w in words], np.int64)


def starts_of(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of n words each: where runs of `size` words within one text start, of which text and which of its words."""
    first = np.cumsum(n) - n
    fit = np.maximum(n - size + 1, 0)
    of = np.repeat(np.arange(len(n)), fit)
    at = np.arange(int(fit.sum())) - np.repeat(np.cumsum(fit) - fit, fit)
    return first[of] + at, of, at


def anchors(h: np.ndarray) -> np.ndarray:
    """For each start of WINDOW words, the least hash of an ANCHOR-gram in it."""
    low = rolled(h, ANCHOR)
    for step in (1, 2, 4):  # the least of 2, 4, 8
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
    return low


assert WINDOW - ANCHOR + 1 == 8


def windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 and 32 bits of each window, from the first and the second hash of its words."""
    return rolled(h[:, 0], WINDOW), rolled(h[:, 1], WINDOW, 0xD6E8FEB86659FD93) >> np.uint64(32)


def names(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """One number for both hashes, to look up within a document."""
    return mixed(keys) ^ checks


def planes(x: np.ndarray, size: int = 8) -> bytes:
    """Byte planes, which the shuffle's compression shortens where they are alike."""
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def unplaned(data: bytes, size: int = 8) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.uint64)


def _grouped(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, at: np.ndarray):
    """All four in order of key, document and place, with marks where a new key begins."""
    order = np.lexsort((at, docs, checks, keys))
    keys, checks, docs, at = keys[order], checks[order], docs[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return keys, checks, docs, at, new


BLOCKS = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("keys", "checks", "docs", "at", "many", "refs", "ref_at")]])
BLOCKS_DDL = "bucket long, keys binary, checks binary, docs binary, at binary, many binary, refs binary, ref_at binary"


def blocks_of(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, at: np.ndarray, buckets: int, places: bool):
    """Rows of BLOCKS. For each bucket, the block's keys, each with its first place; and the further documents that have a key, whose reference is known here already."""
    keys, checks, docs, at, new = _grouped(keys, checks, docs, at)
    group = np.cumsum(new) - 1
    first, first_at = docs[new], at[new]
    other = docs != first[group]
    many = np.zeros(len(first), bool)
    many[group[other]] = True
    bucket = (keys[new] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    k_all, c_all = keys[new], checks[new]
    for a, b in zip(cuts, [*cuts[1:], len(by)]):
        i = by[a:b]
        ks = k_all[i]  # still in ascending order
        delta = ks.copy()
        delta[1:] -= ks[:-1]
        yield int(bucket[i[0]]), planes(delta), planes(c_all[i], 4) if places else b"", planes(first[i].view(np.uint64)), planes(first_at[i], 4) if places else b"", np.packbits(many[i]).tobytes(), b"", b""
    if other.any():
        again = np.zeros(len(keys), bool)  # one entry for each further document and key
        again[1:] = ~new[1:] & (docs[1:] == docs[:-1])
        some = np.flatnonzero(other & ~again)
        for i in range(0, len(some), 4096):
            x = some[i : i + 4096]
            g = group[x]
            where = int(mixed(keys[x[:1]] + docs[x[:1]].view(np.uint64))[0] % np.uint64(buckets))
            yield where, planes(keys[x]), planes(checks[x], 4) if places else b"", planes(docs[x].view(np.uint64)), b"", b"", planes(first[g].view(np.uint64)) if places else b"", planes(first_at[g], 4) if places else b""


def _read(rows: pd.DataFrame, name: str, size: int = 8) -> np.ndarray:
    return np.concatenate([unplaned(x, size) for x in rows[name]])


def _found(pdf: pd.DataFrame, places: bool) -> pd.DataFrame:
    """Of a bucket: the (doc_id, key) that another document has too; with places, the (doc_id, name, ref, ref_at) of those that an earlier document has."""
    own = pdf["many"].map(len) > 0
    own, passed = pdf[own], pdf[~own]
    parts = []
    if len(passed):
        d, k = _read(passed, "docs").view(np.int64), _read(passed, "keys")
        parts.append((d, names(k, _read(passed, "checks", 4)), _read(passed, "refs").view(np.int64), _read(passed, "ref_at", 4)) if places else (d, k))
    if len(own):
        k, d = np.concatenate([np.cumsum(unplaned(x), dtype=np.uint64) for x in own["keys"]]), _read(own, "docs").view(np.int64)
        if places:
            k, c, d, at, new = _grouped(k, _read(own, "checks", 4), d, _read(own, "at", 4))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            hit = d != d[first]
            parts.append((d[hit], names(k[hit], c[hit]), d[first[hit]], at[first[hit]]))
        else:
            many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(y) // 8] for x, y in zip(own["many"], own["keys"])])
            zero = np.zeros(len(k), np.uint64)
            k, _, d, many, new = _grouped(k, zero, d, many)
            group = np.cumsum(new) - 1
            shared = np.zeros(int(new.sum()), bool)
            shared[group[(d != d[new][group]) | (many > 0)]] = True
            hit = shared[group]
            parts.append((d[hit], k[hit]))
    cols = [np.concatenate(x) for x in zip(*parts)]
    out = {"doc_id": cols[0], ("name" if places else "key"): cols[1].view(np.int64)}
    if places:
        out |= {"ref": cols[2], "ref_at": cols[3].astype(np.int32)}
    return pd.DataFrame(out)


def _merged(pdf: pd.DataFrame, places: bool, buckets: int) -> pd.DataFrame:
    """Of some blocks: rows of BLOCKS again. Of each key its first entry, and the further ones as those of documents whose reference is known."""
    own = pdf["many"].map(len) > 0
    own, passed = pdf[own], pdf[~own]
    if not len(own):
        return passed
    k, d = np.concatenate([np.cumsum(unplaned(x), dtype=np.uint64) for x in own["keys"]]), _read(own, "docs").view(np.int64)
    zero = np.zeros(len(k), np.uint64)
    c, at = (_read(own, "checks", 4), _read(own, "at", 4)) if places else (zero, zero)
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(y) // 8] for x, y in zip(own["many"], own["keys"])])
    out = pd.DataFrame(blocks_of(k, c, d, at.astype(np.int64), buckets, places), columns=[f.name for f in BLOCKS])
    # Keys that a block has more than once stay marked.
    marked = np.unique(k[many > 0])
    some = out["many"].map(len) > 0
    for i in out.index[some]:
        keys = np.cumsum(unplaned(out.at[i, "keys"]), dtype=np.uint64)
        bits = np.unpackbits(np.frombuffer(out.at[i, "many"], np.uint8))[: len(keys)] | np.isin(keys, marked)
        out.at[i, "many"] = np.packbits(bits).tobytes()
    return pd.concat([out, passed[out.columns]])


def repeated_keys(rows: DataFrame, keys_of, buckets: int, places: bool = False, sized: str | None = "text", block: int = BLOCK, *, blocks: int = 1, merged: int = MERGED) -> DataFrame:
    """doc_id, key: the keys of each document that another document has too; with places, doc_id, name, ref and ref_at: the first place of those that an earlier one has.

    keys_of gets a batch of rows, with about `block` bytes of column `sized`, and returns four arrays: keys, checks, documents and
    places. No row lists a group's members: a reference block sends a key once, and names the further documents that have it
    in rows of their own, dealt evenly. `blocks` is about how many blocks there are; above `merged`, they are merged in parts first.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, sized, block) if sized else [batch]:
                got = keys_of(part)
                if len(got[0]):
                    yield record_batch(BLOCKS, *zip(*blocks_of(*got, buckets, places)))

    out = "doc_id long, name long, ref long, ref_at int" if places else "doc_id long, key long"
    every = rows.mapInArrow(run, BLOCKS_DDL)
    salts = -(-blocks // merged)
    if salts > 1:
        # A block's rows go to one part of all blocks, and there to as many groups as keep a group's size.
        lot = F.pmod("bucket", F.lit(max(1, buckets // salts))) * salts + F.pmod(F.xxhash64("keys", "docs"), F.lit(salts))
        names = [f.name for f in BLOCKS]
        every = every.withColumn("lot", lot).groupBy("lot").applyInPandas(lambda pdf: _merged(pdf[names], places, buckets), BLOCKS_DDL)
    return every.groupBy("bucket").applyInPandas(lambda pdf: _found(pdf, places), out)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes) and two hashes of it."""
    text = F.col("text").cast("binary")
    # The second hash has the text behind a fixed value, so it does not follow from the first.
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("whole"), F.xxhash64(F.lit(1), text).alias("check"))


def text_names(part: pa.RecordBatch) -> np.ndarray:
    """The names of whole texts."""
    return names(integers(part, "whole").view(np.uint64), integers(part, "check").view(np.uint64) >> np.uint64(32)).view(np.int64)


def whole_copies(rows: DataFrame, buckets: int, blocks: int = 1) -> DataFrame:
    """doc_id, name, ref, ref_at (WHOLE), of rows with a doc_id: those whose text (by 96 bits of hash) an earlier document has; the name is the text's."""

    def keys_of(part):
        k, c, d = (integers(part, n) for n in ("whole", "check", "doc_id"))
        return k.view(np.uint64), c.view(np.uint64) >> np.uint64(32), d, np.zeros(len(k), np.int64)

    # A text of WINDOW words has 2 * WINDOW - 1 bytes at least; shorter ones lose nothing.
    long_enough = rows.where(F.octet_length("text") >= 2 * WINDOW - 1)
    found = repeated_keys(long_enough.select("doc_id", "whole", "check"), keys_of, buckets, True, None, blocks=blocks)
    return found.select("doc_id", "name", "ref", F.lit(WHOLE).alias("ref_at"))


def copied_windows(rows: DataFrame, copies: DataFrame, buckets: int, blocks: int = 1) -> DataFrame:
    """doc_id, name, ref, ref_at, of rows with a doc_id: the first place of each window that starts in an earlier document too. Whole copies send no windows."""

    def anchor_keys(part):
        h, n = split(column(part, "text"))
        where, of, _ = starts_of(n, WINDOW)
        a = anchors(h[:, 0])[where]
        keep = np.ones(len(a), bool)  # neighbours mostly share an anchor
        keep[1:] = (a[1:] != a[:-1]) | (of[1:] != of[:-1])
        zero = np.zeros(int(keep.sum()), np.uint64)
        return a[keep], zero, integers(part, "doc_id")[of[keep]], zero.astype(np.int64)

    shared = repeated_keys(rows.select("doc_id", "text"), anchor_keys, buckets, blocks=blocks)
    none = F.lit(None).cast("long")
    marks = shared.select("doc_id", "key", none.alias("name")).unionByName(copies.select("doc_id", none.alias("key"), "name"))
    marks = marks.groupBy("doc_id").agg(F.collect_list("key").alias("shared"), F.collect_list("name").alias("copied"))

    def window_keys(part):
        copied = [set(x) for x in column(part, "copied")]
        h, n = split([None if w in c else t for t, w, c in zip(column(part, "text"), text_names(part).tolist(), copied)])
        where, of, at = starts_of(n, WINDOW)
        lists = part.column(part.schema.get_field_index("shared"))
        owner = np.repeat(np.arange(len(n)), np.diff(np.asarray(lists.offsets)))
        # An anchor counts for its own document only; a chance hit sends a window too many.
        mine = lambda a, i: mixed(a + mixed(i.astype(np.uint64)))
        some = np.isin(mine(anchors(h[:, 0])[where], of), mine(np.asarray(lists.flatten()).view(np.uint64), owner))
        where, of, at = where[some], of[some], at[some]
        k, c = windows(h)
        return k[where], c[where], integers(part, "doc_id")[of], at

    return repeated_keys(rows.join(marks, "doc_id"), window_keys, buckets, True, blocks=blocks)


def factors(hit: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> np.ndarray:
    """Greedy parse of a text whose windows are found (hit) at a place of an earlier document: rows of start, length, source document and source word."""
    i = np.flatnonzero(hit)
    if not len(i):
        return np.zeros((0, 4), np.int64)
    ref, ref_at = ref[i], ref_at[i]
    on = (i[1:] == i[:-1] + 1) & (ref[1:] == ref[:-1]) & (ref_at[1:] == ref_at[:-1] + 1)
    begin = np.flatnonzero(np.concatenate([[True], ~on]))
    runs = np.diff(np.append(begin, len(i)))
    return np.stack([i[begin], runs + WINDOW - 1, ref[begin], ref_at[begin]], axis=1)


def covered(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a factor."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge)[:-1] > 0


def sizes_of(docs: DataFrame, per_word: float = 0.5) -> tuple[int, int]:
    """From the bytes of all texts: so many buckets that each holds about BUCKET keys, and about how many blocks there are."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(int(total / 6 * per_word / BUCKET) + 1, 4 * shuffle_partitions(docs.sparkSession)), total // BLOCK + 1


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())])
FOUND = pa.list_(pa.struct([("name", pa.int64()), ("ref", pa.int64()), ("ref_at", pa.int32())]))


def parsed(n: int, h: np.ndarray, whole: int, name: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> np.ndarray:
    """The factors of a text of n words with hashes h, given what was found for its document."""
    if n < WINDOW:
        return np.zeros((0, 4), np.int64)
    copy = np.flatnonzero((ref_at == WHOLE) & (name == whole))
    if len(copy):
        return np.array([[0, n, ref[copy].min(), 0]], np.int64)
    own = names(*windows(h)).view(np.int64)
    order = np.argsort(name, kind="stable")
    name, ref, ref_at = name[order], ref[order], ref_at[order]
    at = np.minimum(np.searchsorted(name, own), len(name) - 1)
    return factors((name[at] == own) & (ref_at[at] != WHOLE), ref[at], ref_at[at].astype(np.int64))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, factors (start, length, source document, source word; lengths and places in words) and kept (the text that is left, its words joined by blanks)."""
    rows, (buckets, blocks) = rows_of(docs), sizes_of(docs)
    # Both joins of the texts are by doc_id over the same rows and columns, so they share one shuffle; rows without an id need none.
    known, others = rows.where("doc_id is not null"), rows.where("doc_id is null")
    copies = stored(whole_copies(known, buckets, blocks), "copies")
    places = copied_windows(known, copies, buckets, blocks).unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("name", "ref", "ref_at")).alias("found"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                out, whole = [], text_names(part)
                lists = part.column(part.schema.get_field_index("found")).cast(FOUND)
                offsets, flat = np.asarray(lists.offsets), lists.values
                name, ref, ref_at = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for i, (doc, text) in enumerate(zip(column(part, "doc_id"), column(part, "text"))):
                    words = (text or b"").split()
                    keep, spans = words, []
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    if b > a and len(words) >= WINDOW:
                        got = parsed(len(words), word_pairs([words]), whole[i], name[a:b], ref[a:b], ref_at[a:b])
                        spans = got.tolist()
                        if spans:
                            keep = [words[k] for k in np.flatnonzero(~covered(got, len(words))).tolist()]
                    kept = b" ".join(keep)
                    out.append((doc, len(words), len(words) - len(keep), hashlib.sha256(kept).hexdigest(), spans, kept.decode()))
                if out:
                    yield record_batch(RESULT, *zip(*out))

    every = known.join(places, "doc_id", "left").unionByName(others.withColumn("found", F.lit(None).cast("array<struct<name:bigint,ref:bigint,ref_at:int>>")))
    return every.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<array<long>>, kept string")
