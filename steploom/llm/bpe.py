"""Operator 1: byte-level BPE as a bounded-lookahead streaming transducer.

The merge list determines a *sufficient lookahead*: the number of bytes behind a token that can still change it.
A merge (u, v) can be undone from the right only by a merge of higher priority whose left part lies on the right edge of
v, and so on along a chain of rising priority; the longest such chain, in bytes, is the bound. A token is emitted once so
many bytes behind it are known, so the encoder holds a constant amount of text however long the input or a run in it is.

Inside the bound, tokens are found from left to right: a sequence of tokens is the BPE encoding if and only if each two
neighbours are what BPE makes of their joined bytes, so the encoder takes the longest next token that is compatible with
the one before it and steps back when there is none.

Every text, short or long, takes this one way: windows of it are fed to the encoder, which cuts them into pieces as these end,
and each piece goes through the transducer. What the transducer gave for a piece that comes back is kept in a bounded table. Ids are
handed on as they come out (to the digests, and to the decoder), so no list of a text's ids is held where none is asked for.

Defined cases: a null text counts as empty; an empty text has no tokens, and decodes to an empty text. Added tokens
of the file (such as an end-of-text mark) that appear in a text become their own ids, as in the public library.
Repeated rows give repeated results; further columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import column, record_batch, slices

#: The piece pattern of this public family of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the public library's pattern engine defines it; Python's \s also has U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"[{_SPACE}]+(?![^{_SPACE}])").replace(r"|\s+", rf"|[{_SPACE}]+"))
WIDE = re.compile(r"[^\x00-\xff]")


def latin_piece() -> re.Pattern:
    """PIECE for text of Latin-1 alone, where the classes are short lists: the same pieces, found faster."""
    of = lambda c: "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == c)
    letter, number, space = of("L"), of("N"), r"\t-\r \x85\xa0"
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{letter}{number}{space}]+|[{space}]+(?![^{space}])|[{space}]+")


LATIN = latin_piece()
RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[^{_SPACE}\p{{L}}\p{{N}}]+")]
SPACES = regex.compile(f"[{_SPACE}]+")
LONG = 4096
NEVER = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 stands for itself; the other bytes, in order, for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks, and the sufficient lookahead of the merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in pairs]
        self.ranks = {m: r for r, m in enumerate(self.merges)}
        self.bytes_of = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for t, i in ids.items():
            self.bytes_of[i] = t
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.longest = max(map(len, ids))
        self.lookahead = self._lookahead()
        # A token stands only where BPE makes exactly it of its own bytes.
        self.ids = {t: i for t, i in ids.items() if len(t) == 1 or self.merge(t) == [t]}
        self.prefixes = self._longest_at()
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self)

    def _lookahead(self) -> int:
        right: dict[bytes, bytes] = {a + b: b for a, b in reversed(self.merges)}
        need: dict[bytes, int] = {}
        most = 0
        for a, b in self.merges:  # by rising rank: what can preempt a merge comes before it
            n, edge = 0, b
            while edge:
                n = max(n, need.get(edge, 0))
                edge = right.get(edge, b"")
            n += len(b)
            need[a] = max(need.get(a, 0), n)
            most = max(most, n)
        return most

    def _longest_at(self) -> dict[bytes, int]:
        """For each first three bytes, the longest token that begins so."""
        out: dict[bytes, int] = {}
        for t in self.ids:
            if len(t) > 2:
                out[t[:3]] = max(out.get(t[:3], 3), len(t))
        return out

    def merge(self, piece: bytes) -> list[bytes]:
        """The definition of BPE: join the pair of lowest rank, the leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        near = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while near and (best := min(near)) < NEVER:
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(near):
                near[i] = rank((parts[i], parts[i + 1]), NEVER)
        return parts

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            x, y = self.bytes_of[a], self.bytes_of[b]
            ok = self.pairs[key] = self.merge(x + y) == [x, y]
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        ids, longest, pairs, n = self.ids, self.prefixes, self.pairs, len(piece)
        out: list[int] = []
        ends = [0]
        dead: set[int] = set()
        at, size = 0, min(longest.get(piece[:3], 2), n)
        while at < n:
            last = out[-1] if out else -1
            while size:
                t = ids.get(piece[at : at + size])
                if t is not None and at + size not in dead:
                    if last < 0:
                        break
                    ok = pairs.get(last << 20 | t)
                    if ok if ok is not None else self.fits(last, t):
                        break
                size -= 1
            if size:
                out.append(t)
                at += size
                ends.append(at)
                size = min(longest.get(piece[at : at + 3], 2), n - at)
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                out.pop()
                ends.pop()
                size = at - ends[-1] - 1
                at = ends[-1]
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PieceTransducer:
    """Bytes of one piece in, stable token ids out; holds a few times the sufficient lookahead."""

    def __init__(self, v: Vocabulary):
        self.v, self.held, self.most = v, b"", 4 * (v.lookahead + v.longest)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.most):
            self.held += data[i : i + self.most]
            if len(self.held) >= self.most:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """The tokens that end where the lookahead behind them is known."""
        v, out, at = self.v, [], 0
        stable = len(self.held) - v.lookahead
        for t in v.encode_piece(self.held):
            if at + len(v.bytes_of[t]) > stable:
                break
            out.append(t)
            at += len(v.bytes_of[t])
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        """The end of a piece: nothing behind it can change it."""
        out, self.held = self.v.encode_piece(self.held) if self.held else [], b""
        return out


class Pieces(dict):
    """Piece -> what the transducer gives for it. Bounded: a piece stays from its second sight on, and a full table becomes the older of two."""

    most, longest, marks = 200_000, 64, 1 << 22

    def __init__(self, v: Vocabulary):
        self.v, self.before, self.seen = v, {}, bytearray(self.marks)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.before.get(piece)
        if out is None:
            t = PieceTransducer(self.v)
            out = tuple(t.feed(piece.encode()) + t.finish())
            mark = hash(piece) & (self.marks - 1)
            if len(piece) > self.longest or not self.seen[mark]:
                self.seen[mark] = 1
                return out
        if len(self) >= self.most:
            self.before, self.seen = dict(self), bytearray(self.marks)
            self.clear()
        self[piece] = out
        return out


class Encoder:
    """Text in by pieces of any size, ids out; constant memory, whatever the length of the text or of a run in it."""

    def __init__(self, v: Vocabulary):
        self.v, self.held, self.run, self.open = v, "", None, None

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        self.held += text
        while self.held:
            found = min(((i, t) for t in self.v.added if (i := self.held.find(t)) >= 0), key=lambda x: (x[0], -len(x[1])), default=None)
            if not found:
                break
            i, t = found
            rest, self.held = self.held[i + len(t) :], self.held[:i]
            out += self._pieces(True)
            out.append(self.v.added[t])
            self.held = rest
        hold = max((k for t in self.v.added for k in range(min(len(t) - 1, len(self.held)), 0, -1) if self.held.endswith(t[:k])), default=0)
        tail, self.held = self.held[len(self.held) - hold :], self.held[: len(self.held) - hold]
        out += self._pieces(False)
        self.held += tail
        return out

    def finish(self) -> list[int]:
        return self._pieces(True)

    def _pieces(self, end: bool) -> list[int]:
        out: list[int] = []
        if self.open and self.held:
            m = self.run.match(self.held)
            k = m.end() if m else 0
            blank = self.run is SPACES
            if k == len(self.held) and not end:
                keep = 1 if blank else 0
                out += self.open.feed(self.held[: k - keep].encode())
                self.held = self.held[k - keep :]
                return out
            k -= blank and k < len(self.held)  # the last white space before other text belongs to what follows
            out += self.open.feed(self.held[:k].encode())
            self.held = self.held[k:]
            out += self.open.finish()
            self.open = None
        elif self.open and end:
            out += self.open.finish()
            self.open = None
        n = len(self.held)
        pieces = (PIECE if WIDE.search(self.held) else LATIN).findall(self.held)
        at = n
        while pieces and not end:  # the last pieces may go on, or turn out to be others
            start = at - len(pieces[-1])
            if at < n and start + 3 <= n:
                break
            pieces.pop()
            at = start
        out += chain.from_iterable(map(self.v.pieces.__getitem__, pieces))
        self.held = self.held[at:]
        if not end and len(self.held) > LONG and (m := PIECE.match(self.held)) and m.end() == len(self.held):
            self.run = next((r for r in RUNS if r.match(self.held[-1])), SPACES)
            self.open = PieceTransducer(self.v)
            keep = self.run is SPACES
            out += self.open.feed(self.held[: n - at - keep].encode())
            self.held = self.held[n - at - keep :]
        return out


class Decoder:
    """Ids in, text out: a byte-to-text state machine that carries at most an unfinished character."""

    def __init__(self, v: Vocabulary):
        self.v, self.state = v, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.v.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


WINDOW = 65536


def streamed(text: str, v: Vocabulary, window: int = WINDOW):
    """The ids of a text, a list for each window of it."""
    e = Encoder(v)
    for i in range(0, len(text), window):
        yield e.feed(text[i : i + window])
    yield e.finish()


def encode(text: str, path: str) -> list[int]:
    """The ids of one whole text."""
    return list(chain.from_iterable(streamed(text, vocabulary(path))))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
STEP = 65536


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded from its ids."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            rows = []
            for part in slices(batch, "text"):
                for doc, text in zip(column(part, "doc_id"), column(part, "text")):
                    said, got, back, n = hashlib.sha256(), hashlib.sha256(), Decoder(v), 0
                    for ids in streamed(text or "", v):
                        if ids:
                            said.update((("," if n else "") + ",".join(map(v.text_of.__getitem__, ids))).encode())
                            got.update(back.feed(ids).encode())
                            n += len(ids)
                    got.update(back.finish().encode())
                    rows.append((doc, n, said.hexdigest(), got.hexdigest()))
            if rows:
                yield record_batch(DIGESTS, *zip(*rows))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                ids = [encode(t or "", path) for t in column(part, "text")]
                yield record_batch(IDS, column(part, "doc_id"), [len(x) for x in ids], ids)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in column(batch, "ids"):
                d = Decoder(v)
                texts.append("".join(d.feed((ids or [])[i : i + STEP]) for i in range(0, len(ids or []), STEP)) + d.finish())
            yield record_batch(out, column(batch, "doc_id"), texts)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_split(calls: DataFrame, path: str | None, name: str | None = None, reasoning: str = "reasoning", answer: str = "content") -> DataFrame:
    """calls with reasoning_tokens, answer_tokens and tokenizer: how many tokens of the file at `path` the two texts have.

    Without a file both counts are NULL and never a guess; tokenizer then says which one is not there, or is NULL if none is known.
    A NULL text has no tokens. Columns of these names are replaced.
    """
    rest = calls.drop("reasoning_tokens", "answer_tokens", "tokenizer")
    if path is None:
        none = F.lit(None).cast("long")
        return rest.select("*", none.alias("reasoning_tokens"), none.alias("answer_tokens"), F.lit(f"{name} (unavailable)" if name else None).cast("string").alias("tokenizer"))
    label = name or path.rsplit("/", 1)[-1]

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            counts = [pa.array([sum(map(len, streamed(t or "", v))) for t in column(batch, c)], pa.int64()) for c in (reasoning, answer)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array([label] * batch.num_rows, pa.string())], [*batch.schema.names, "reasoning_tokens", "answer_tokens", "tokenizer"])

    schema = T.StructType([*rest.schema.fields, T.StructField("reasoning_tokens", T.LongType()), T.StructField("answer_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])
    return rest.mapInArrow(run, schema)
