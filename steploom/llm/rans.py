"""Operator 2: token ids in a static range asymmetric numeral system (rANS) format.

Documents are range-partitioned and sorted by doc_id; each partition is a file of segments. A segment holds whole
documents of about SEGMENT ids: one static frequency table, shared by its blocks, and independent blocks of BLOCK ids.
In a block LANES coders with one stream of 32-bit words are interleaved, so that numpy codes a symbol of each lane at a
time. The directory of a segment gives, for each block, its count of ids, its place in the stream (a checkpoint from which
it can be decoded alone) and the CRC-32 of its ids; a block that does not give its checksum raises an error.

The container is Parquet: any store Spark reaches can hold it, and a lost task leaves no half-written file. All a
segment needs is in its row, so segments decode in parallel. A file's first id is a sum over the files before it, of
which there are as many as partitions.

Defined cases: a null text counts as empty (only the end id is written); equal or null doc_ids keep one row each, nulls
first, ties by text; a document longer than SEGMENT has a segment of its own with many blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import column, record_batch, shuffle_partitions, slices, stored

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
BLOCK = 1 << 18
SEGMENT = 1 << 20


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to a sum of 2**scale, at least 1 for every symbol that occurs."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not total:
        return out
    seen = counts > 0
    if int(seen.sum()) > 1 << scale:
        raise ValueError("more distinct ids than the table can hold")
    out[seen] = np.maximum(1, counts[seen] * (1 << scale) // total)
    excess = int(out.sum()) - (1 << scale)
    if excess < 0:
        out[int(out.argmax())] -= excess
    while excess > 0:  # what was rounded up to 1 is taken from the largest
        i = int(out.argmax())
        take = min(excess, max(1, int(out[i]) // 2))
        out[i] -= take
        excess -= take
    return out


def pack_table(freq: np.ndarray) -> bytes:
    ids = np.flatnonzero(freq)
    return zlib.compress(struct.pack("<I", len(ids)) + np.diff(ids, prepend=0).astype("<u4").tobytes() + freq[ids].astype("<u4").tobytes(), 1)


def unpack_table(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    ids = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    freq = np.zeros(int(ids[-1]) + 1 if n else 0, np.int64)
    freq[ids] = np.frombuffer(raw, "<u4", n, 4 + 4 * n)
    return freq


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    lanes = min(LANES, max(1, len(ids)))
    x = np.full(lanes, LOW, np.uint64)
    words = []
    f_all, s_all = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, s = f_all[at : at + lanes], s_all[at : at + lanes]
        n = len(f)
        y = x[:n]
        full = y >= f << np.uint64(63 - SCALE)
        words.append(y[full].astype("<u4"))
        y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:n] = (q << np.uint64(SCALE)) + (y - q * f) + s
    words.reverse()
    return struct.pack("<I", lanes) + x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in words)


def decode_block(data: bytes, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    lanes = struct.unpack_from("<I", data)[0]
    x = np.frombuffer(data, "<u8", lanes, 4).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=4 + 8 * lanes)
    out, at, mask = np.empty(n, np.int64), 0, np.uint64((1 << SCALE) - 1)
    freq, start = freq.astype(np.uint64), start.astype(np.uint64)
    for i in range(0, n, lanes):
        y = x[: min(lanes, n - i)]
        slot = y & mask
        s = symbol[slot.astype(np.int64)]
        out[i : i + len(y)] = s
        y = freq[s] * (y >> np.uint64(SCALE)) + slot - start[s]
        low = np.flatnonzero(y < LOW)
        y[low] = y[low] << np.uint64(32) | words[at : at + len(low)].astype(np.uint64)
        at += len(low)
        x[: len(y)] = y
    return out


def starts(freq: np.ndarray) -> np.ndarray:
    return np.cumsum(freq) - freq


def encode_segment(ids: np.ndarray) -> dict:
    """table and stream (bytes), and the directory: for each block its count, offset and checksum."""
    freq = frequencies(np.bincount(ids, minlength=1))
    start = starts(freq)
    blocks, sizes, offsets, sums = [], [], [], []
    at = 0
    for i in range(0, len(ids), BLOCK):
        some = ids[i : i + BLOCK]
        data = encode_block(some, freq, start)
        blocks.append(data)
        sizes.append(len(some))
        offsets.append(at)
        sums.append(zlib.crc32(some.astype("<u4").tobytes()))
        at += len(data)
    return {"table": pack_table(freq), "stream": b"".join(blocks), "sizes": sizes, "offsets": offsets, "sums": sums}


def decode_segment(table: bytes, stream: bytes, sizes, offsets, sums, blocks=None) -> np.ndarray:
    """The ids of a segment, or of the given blocks of it."""
    freq = unpack_table(table)
    start, symbol = starts(freq), np.repeat(np.arange(len(freq)), freq)
    ends, out = [*list(offsets)[1:], len(stream)], []
    for k in range(len(sizes)) if blocks is None else blocks:
        ids = decode_block(stream[offsets[k] : ends[k]], sizes[k], freq, start, symbol)
        if zlib.crc32(ids.astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"block {k} is damaged")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


#: The normaliser and the splitter for which texts are cut into words here. A file with others is read text by text.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
END = "</w>"

#: Lower-case letters of ASCII and Latin-1.
_LETTERS = "a-zß-öø-ÿ"
#: What SPLIT finds in lower-case text of plain characters.
WORD = re.compile(rf"[{_LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^{_LETTERS}0-9\t-\r ]+")
#: Text whose characters have a plain normal form, case and class.
PLAIN = re.compile(r"[\t-\r -~¡§«°·»¿À-ÖØ-öø-ÿ–—‘-„…]*")
BLANKS = re.compile(r"[\t-\r ]+")


def plain(text: str) -> bool:
    """Whether WORD finds in the lower-case text what SPLIT does, and no added token can begin in it."""
    return PLAIN.fullmatch(text) is not None and "<|" not in text


class Words:
    """Ids of texts by the public library, asked once for each new word of a slice of texts.

    In plain text (ASCII, Latin-1 letters, common marks) words are what the file's splitter finds after lower-casing. Other text
    is cut at blanks, across which no token reaches, and each part that is not plain goes to the library as it is.
    A full table becomes the older of two generations, out of which words still in use are taken over; very long words are not kept.
    """

    most, longest = 300_000, 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = spec["normalizer"] == NORMAL and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and spec["model"]["end_of_word_suffix"] == END and all("<|" in t["content"] for t in spec["added_tokens"])
        # The same model over words that are already normal and split.
        self.bare = Tokenizer(self.lib.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.lib.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.lib.get_vocab().items() if t.endswith(END)]] = True
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def words(self, text: str, odd: set[str]) -> list[str]:
        """A text's words; parts that are not plain stand as they are, and are put into odd."""
        if plain(text):
            return WORD.findall(text.lower())
        out = []
        for part in BLANKS.split(text):
            if part and plain(part):
                out += WORD.findall(part.lower())
            elif part:
                odd.add(part)
                out.append(part)
        return out

    def _ask(self, known: list[str], odd: list[str]) -> None:
        """Looks up new words, plain and odd ones. A word's last token, and no other, has the mark of a word's end."""
        for k in range(0, len(known), 4096):
            some = known[k : k + 4096]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                raise ValueError("words and their ends differ")
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, (4 * cuts).tolist()):
                self.now[w] = raw[at:end]
                at = end
        for k in range(0, len(odd), 4096):
            some = odd[k : k + 4096]
            self.now.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        if not self.known:
            return [np.array(e.ids, "<i4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        odd: set[str] = set()
        split = [self.words(t, odd) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.now)
        if self.before:
            kept = new.intersection(self.before)
            self.now.update(zip(kept, map(self.before.__getitem__, kept)))
            new -= kept
        self._ask(list(new - odd), list(new & odd))
        out = [b"".join(map(self.now.__getitem__, ws)) for ws in split]
        for w in [w for w in new if len(w) > self.longest]:
            del self.now[w]
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        return out


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


SEGMENTS = pa.schema([
    ("file", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("table", pa.binary()), ("stream", pa.binary()),
    ("sizes", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())),
])
SEGMENTS_DDL = "file int, segment int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, table binary, stream binary, sizes array<int>, offsets array<long>, sums array<long>"


def segments(docs: DataFrame, path: str, end_id: int, segment: int = SEGMENT) -> DataFrame:
    """The rows of the file format, of the ids of every whole text with end_id behind it, in ascending doc_id order."""

    def run(batches):
        file, k, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, names, total = [], [], [], 0
        end = np.array([end_id], np.int32).tobytes()

        def row():
            e = encode_segment(np.frombuffer(b"".join(ids), np.int32).astype(np.int64))
            return record_batch(SEGMENTS, [file], [k], [before], [total], [names], [sizes], [e["table"]], [e["stream"]], [e["sizes"]], [e["offsets"]], [e["sums"]])

        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                for doc, raw in zip(column(part, "doc_id"), words(path)([t or "" for t in column(part, "text")])):
                    ids += [raw, end]
                    sizes.append(len(raw) // 4 + 1)
                    names.append(doc)
                    total += sizes[-1]
                    if total >= segment:
                        yield row()
                        ids, sizes, names, total, k, before = [], [], [], 0, k + 1, before + total
        if names:
            yield row()

    n = shuffle_partitions(docs.sparkSession)
    # The text's beginning parts rows that share an id or have none; its order is the text's.
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SEGMENTS_DDL)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the segments."""
    # A row for each file, as many as the writer had partitions; a segment's row says how many ids of its file lie before it.
    first, at = {}, 0
    for r in sorted(files.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["file"]):
        first[r["file"]] = at
        at += r["n"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = decode_segment(r["table"], r["stream"], r["sizes"], r["offsets"], r["sums"])
                ends = np.cumsum(r["lengths"])
                begins = ends - np.array(r["lengths"], np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield record_batch(READ, r["doc_ids"], begins + (first[r["file"]] + r["before"]), r["lengths"], sums)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_ids(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the files in the shared folder, reads them back and returns a row for each document."""
    return read_documents(stored(segments(docs, path, end_id), "ids"))
