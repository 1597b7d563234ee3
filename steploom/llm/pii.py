"""Operator 6: personal data by patterns and a character-level bidirectional LSTM with CRF transitions, in numpy.

The patterns give the base spans. The tagger adds spans: it is trained from labelled spans (documents' own base spans, and
a seeded generator that writes the four kinds, alone or side by side, and look-alikes that are none, into carrier text), over at
most TRAIN_WINDOWS windows (a documented bound), of documents of 200 to 20,000 characters. It reads whole texts by a fixed grid
of overlapping windows: WINDOW characters, one every STRIDE. No kind can be written without a digit or @, so a window with
neither is known to hold none and is not scored. Windows that overlap are reconciled globally: the emissions of a
character are averaged over the windows it lies in, by its distance from their edges, and one Viterbi pass under the CRF's
transitions decodes each stretch of windows as a whole; a long one is scored in blocks of windows, and only its back pointers are held.
What it finds must then pass the check of its kind (`plausible`), such as a card's check digit, and touch no base span. It finds
what the patterns, which take the longest match and try no other, lose where one kind stands next to another.

Spans are kind, start, end in code points, end exclusive. Defined cases: a null or empty text has no spans; repeated
rows give repeated results; null doc_ids are kept; with no documents to train from, the generator's carrier text serves.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, finished, record_batch, shared_dir, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a phone number that the tagger finds may look like.
PHONE_LIKE = re.compile(r"(\+[0-9]{1,3}[ .-]?)?(\([0-9]{1,4}\)[ .-]?)?[0-9]+([ .-][0-9]+)*")
HINT = re.compile(r"[0-9@]")

WINDOW, STRIDE = 64, 32
TRAIN_WINDOWS, SAMPLE_DOCS, EPOCHS, HIDDEN, EMBED = 3000, 400, 8, 16, 10
TAGS = 1 + 2 * len(KINDS)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in LOCAL:
            i -= 1
        if i < at and (m := EMAIL.match(text, i)):
            out.append((i, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    return out


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if not HINT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Characters that have a class of their own; all others go by kind.
MARKS = "@.-+() %_:/,\n\"'=<>#*|"
CLASSES = len(MARKS) + 8
#: Which classes are a digit or @.
HINTS = np.zeros(CLASSES + 1, bool)
HINTS[[MARKS.index("@"), len(MARKS), len(MARKS) + 1]] = True


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point below 0x3000; later ones count as letters of a foreign script."""
    out = np.full(0x3000, CLASSES - 1, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c in MARKS:
            out[i] = MARKS.index(c)
        elif "0" <= c <= "9":
            out[i] = len(MARKS) + (c == "0")
        elif c.isascii() and c.isalpha():
            out[i] = len(MARKS) + (2 if c.islower() else 3)
        elif c.isalpha():
            out[i] = len(MARKS) + 4
        elif c.isspace():
            out[i] = len(MARKS) + 5
        elif c.isascii():
            out[i] = len(MARKS) + 6
    return out


def classes(text: str) -> np.ndarray:
    return class_table()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x2FFF)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, a forward and a backward LSTM, and a linear-chain CRF over tags O, B and I of each kind."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": init(CLASSES + 1, e), "out": init(2 * h, TAGS), "outb": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": init(e, 4 * h), f"wh{d}": init(h, 4 * h), f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), h)}
        self.allowed = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):  # I of a kind comes only after B or I of it
            self.allowed[:, 2 + 2 * k] = False
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True

    def _run(self, x: np.ndarray, d: str) -> np.ndarray:
        n, t = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        table = self.p["emb"] @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        out = np.empty((n, t, HIDDEN), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[x[:, i]] + h @ self.p[f"wh{d}"]
            g = _sigmoid(z[:, : 3 * HIDDEN])
            a, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c = f * c + a * u
            h = o * np.tanh(c)
            out[:, i] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2) @ self.p["out"] + self.p["outb"]

    def _steps(self) -> np.ndarray:
        return np.where(self.allowed, self.p["trans"], np.float32(-1e4))

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of tags, and summed over positions of pairs of tags, by forward-backward; each position's weights are scaled to a sum of 1."""
        n, t, _ = e.shape
        step = np.exp(self._steps().astype(np.float64))
        w = np.exp(e - e.max(axis=2, keepdims=True), dtype=np.float64)
        fw, bw, scale = np.empty_like(w), np.empty_like(w), np.empty((n, t, 1))
        a = w[:, 0] * (np.arange(TAGS) % 2 + (np.arange(TAGS) == 0))
        for i in range(t):
            if i:
                a = (fw[:, i - 1] @ step) * w[:, i]
            scale[:, i] = a.sum(axis=1, keepdims=True)
            fw[:, i] = a / scale[:, i]
        w /= scale
        bw[:, -1] = 1
        for i in range(t - 2, -1, -1):
            bw[:, i] = (w[:, i + 1] * bw[:, i + 1]) @ step.T
        pairs = step * (fw[:, :-1].reshape(-1, TAGS).T @ (w[:, 1:] * bw[:, 1:]).reshape(-1, TAGS))
        return fw * bw, pairs

    def _recurrent(self) -> dict[str, np.ndarray]:
        """The weights of both directions, the forward one first."""
        return {k: np.stack([self.p[f"{k}f"], self.p[f"{k}b"]]) for k in ("wx", "wh", "b")}

    def _forward_both(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Both LSTMs side by side, the second from the end on: all that back propagation needs, by step."""
        n, t = x.shape
        q, xs = self._recurrent(), np.stack([x, x[:, ::-1]])
        table = self.p["emb"] @ q["wx"] + q["b"][:, None, :]
        z0 = np.stack([table[d][xs[d]] for d in (0, 1)])
        gates = np.empty((t, 2, n, 4 * HIDDEN), z0.dtype)
        hs, cs, ss = (np.zeros((t + 1, 2, n, HIDDEN), z0.dtype) for _ in range(3))
        for i in range(t):
            z = z0[:, :, i] + hs[i] @ q["wh"]
            g = gates[i]
            g[..., : 3 * HIDDEN] = _sigmoid(z[..., : 3 * HIDDEN])
            g[..., 3 * HIDDEN :] = np.tanh(z[..., 3 * HIDDEN :])
            cs[i + 1] = g[..., HIDDEN : 2 * HIDDEN] * cs[i] + g[..., :HIDDEN] * g[..., 3 * HIDDEN :]
            ss[i + 1] = np.tanh(cs[i + 1])
            hs[i + 1] = g[..., 2 * HIDDEN : 3 * HIDDEN] * ss[i + 1]
        h = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2).transpose(1, 0, 2)
        return {"xs": xs, "gates": gates, "hs": hs, "cs": cs, "ss": ss, "h": h} | q

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        k = self._forward_both(x)
        e = k["h"] @ self.p["out"] + self.p["outb"]
        p, pairs = self._marginals(e)
        n, t = x.shape
        p[np.arange(n)[:, None], np.arange(t), y] -= 1
        de = (p / n).astype(e.dtype)
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {"trans": np.where(self.allowed, pairs / n, 0), "out": np.einsum("nth,ntk->hk", k["h"], de), "outb": de.sum(axis=(0, 1)), "emb": np.zeros_like(self.p["emb"])}
        back = (de @ self.p["out"].T).transpose(1, 0, 2)
        dhs = np.stack([back[:, :, :HIDDEN], back[::-1, :, HIDDEN:]], axis=1)
        dz, dh, dc = np.empty_like(k["gates"]), np.zeros_like(k["hs"][0]), np.zeros_like(k["hs"][0])
        wh = k["wh"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            a, f, o, u = (k["gates"][i][..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            s, dh = k["ss"][i + 1], dh + dhs[i]
            dc = dc + dh * o * (1 - s * s)
            z = dz[i]
            z[..., :HIDDEN], z[..., HIDDEN : 2 * HIDDEN] = dc * u * a * (1 - a), dc * k["cs"][i] * f * (1 - f)
            z[..., 2 * HIDDEN : 3 * HIDDEN], z[..., 3 * HIDDEN :] = dh * s * o * (1 - o), dc * a * (1 - u * u)
            dh, dc = z @ wh, dc * f
        # What no later step waits for is summed over all steps at once.
        for d, name in enumerate("fb"):
            z, at = dz[:, d].reshape(-1, 4 * HIDDEN), k["xs"][d].T.ravel()
            g[f"wx{name}"] = self.p["emb"][at].T @ z
            g[f"wh{name}"] = k["hs"][:-1, d].reshape(-1, HIDDEN).T @ z
            g[f"b{name}"] = z.sum(axis=0)
            np.add.at(g["emb"], at, z @ k["wx"][d].T)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.03, seed: int = 5) -> "Tagger":
        """Adam on the CRF's negative log likelihood."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for k in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                step += 1
                for name, g in self._gradients(x[some], y[some]).items():
                    g = np.clip(g, -5, 5).astype(np.float32)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] = self.p[name] - np.float32(rate * 0.7**k) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + np.float32(1e-6))
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window alone."""
        return np.concatenate([self.viterbi(self.emissions(x[k : k + BATCH])) for k in range(0, len(x), BATCH)]) if len(x) else np.zeros(x.shape, np.int8)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The likeliest tags of rows of emissions (rows x characters x tags)."""
        n, t, _ = e.shape
        tags = np.empty((n, t), np.int8)
        best, back = self._forward(None, e)
        tag = best.argmax(axis=1)
        for i in range(t - 1, -1, -1):
            tags[:, i] = tag
            tag = back[np.arange(n), i, tag]
        return tags

    def likeliest(self, blocks) -> np.ndarray:
        """The likeliest tags of one row of emissions that comes in blocks (characters x tags)."""
        best, backs = None, []
        for e in blocks:
            best, back = self._forward(best, e[None])
            backs.append(back[0])
        back = np.concatenate(backs)
        tags, tag = np.empty(len(back), np.int8), int(best[0].argmax())
        for i in range(len(back) - 1, -1, -1):
            tags[i] = tag
            tag = back[i, tag]
        return tags

    def _forward(self, best: np.ndarray | None, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best scores behind the emissions (rows x characters x tags), given those before them, and where each came from."""
        n, t, _ = e.shape
        step, back, first = self._steps(), np.zeros((n, t, TAGS), np.int8), 0
        if best is None:
            best, first = e[:, 0] + np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0), 0, -1e4), 1
        for i in range(first, t):
            s = best[:, :, None] + step
            back[:, i] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, i]
        return best, back


#: Windows scored at once, and bytes of text taken at once.
BATCH, STEP = 2048, 2_000_000


def grid(code: np.ndarray) -> np.ndarray:
    """The numbers of the windows (from k x STRIDE on) that hold a digit or @."""
    at = np.flatnonzero(HINTS[code]) // STRIDE
    k = np.unique(np.concatenate([at, at - 1]))
    return k[k >= 0]


def padded(code: np.ndarray) -> np.ndarray:
    """All windows of a text; the class after the last stands for no character."""
    n = -(-max(len(code), WINDOW) // STRIDE) + 1
    out = np.full((n + 1) * STRIDE, CLASSES, np.uint8)
    out[: len(code)] = code
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::STRIDE]


def stretches(k: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring windows: from and to (in k)."""
    cuts = [0, *(np.flatnonzero(np.diff(k) != 1) + 1).tolist(), len(k)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def in_part(e: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of the characters of neighbouring windows: averages, by the distance from a window's edges. `before` is the weighted second half
    of the window that stands before these, if one does; the last window's is returned apart, for the one after it."""
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    first, second = weight[:STRIDE], weight[STRIDE:]
    out, after = e[:, :STRIDE] * first[:, None], e[:, STRIDE:] * second[:, None]
    out[1:] += after[:-1]
    total = np.tile(first + second, (len(e), 1))
    if before is None:
        total[0] = first
    else:
        out[0] += before
    return (out / total[:, :, None]).reshape(-1, TAGS), after[-1]


def ended(after: np.ndarray) -> np.ndarray:
    """The emissions of the last window's second half, which no other window shares."""
    return after / np.arange(STRIDE, 0, -1).astype(np.float32)[:, None]


def reconciled(e: np.ndarray) -> np.ndarray:
    """Emissions of all characters of a stretch from those of its windows."""
    some, after = in_part(e)
    return np.concatenate([some, ended(after)])


assert WINDOW == 2 * STRIDE


def blocks_of(x: np.ndarray, model: Tagger):
    """The reconciled emissions of one stretch's windows, a block at a time."""
    after = None
    for i in range(0, len(x), BATCH):
        e, after = in_part(model.emissions(x[i : i + BATCH]), after)
        yield e
    yield ended(after)


def tagged(texts: list[str], model: Tagger) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans in each text."""
    rows, parts, base = [], [], 0  # windows, and for each stretch: text, first window, rows
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for t, text in enumerate(texts):
        if HINT.search(text):
            code = classes(text)
            k, windows = grid(code), padded(code)
            for a, b in stretches(k):
                if b - a > BATCH:
                    out[t] += spans_of(model.likeliest(blocks_of(windows[k[a] : k[b - 1] + 1], model)), int(k[a]) * STRIDE, len(text))
                else:
                    rows.append(windows[k[a] : k[b - 1] + 1])
                    parts.append((t, int(k[a]), base, base + b - a))
                    base += b - a
    x = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.uint8)
    e = np.concatenate([model.emissions(x[i : i + BATCH]) for i in range(0, max(1, len(x)), BATCH)])
    parts.sort(key=lambda p: p[3] - p[2])
    at = 0
    while at < len(parts):  # stretches of one length are decoded side by side
        size = parts[at][3] - parts[at][2]
        end = at
        while end < len(parts) and parts[end][3] - parts[end][2] == size and (end - at) * size < 16_384:
            end += 1
        tags = model.viterbi(np.stack([reconciled(e[a:b]) for _, _, a, b in parts[at:end]]))
        for (t, k, _, _), row in zip(parts[at:end], tags):
            out[t] += spans_of(row, k * STRIDE, len(texts[t]))
        at = end
    return [sorted(some, key=lambda s: s[1]) for some in out]


def spans_of(tags: np.ndarray, start: int, stop: int) -> list[tuple[str, int, int]]:
    """The spans that tags say, before character `stop`."""
    out = []
    for i in np.flatnonzero(tags % 2 == 1).tolist():  # B of a kind
        inside, end = tags[i] + 1, i + 1
        while end < len(tags) and tags[end] == inside:
            end += 1
        if start + i < stop:
            out.append((KINDS[(int(tags[i]) - 1) // 2], start + i, min(start + end, stop)))
    return out


def plausible(kind: str, s: str) -> bool:
    """What the tagger says must look like its kind: no cut-off or glued spans."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == "email":
        return EMAIL.fullmatch(s) is not None and not s.startswith(".")
    if kind == "ip":
        return IP.fullmatch(s) is not None and all(len(p) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and CARD.fullmatch(s) is not None and luhn(digits)
    return 8 <= len(digits) <= 15 and PHONE_LIKE.fullmatch(s) is not None and any(c in s for c in "+(-")


def found(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """Of each text: base spans, and all spans (in order of kind and start)."""
    order = {k: i for i, k in enumerate(KINDS)}
    out = []
    for text, more in zip(texts, tagged(texts, model)):
        base = base_spans(text)
        own = [(k, a, b) for k, a, b in more if plausible(k, text[a:b]) and all(b <= x or a >= y for _, x, y in base)]
        out.append((base, sorted(base + own, key=lambda s: (order[s[0]], s[1], s[2]))))
    return out


def card(rng: random.Random) -> str:
    """A card number with the right check digit. The sum is no matter for a tagger of this size: `plausible` tests it."""
    d = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
    d += next(c for c in "0123456789" if luhn(d + c))
    return rng.choice(["", "", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))


def written(rng: random.Random) -> tuple[str, str]:
    """A labelled span of one of the four kinds, or a look-alike of kind ''."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 8)))
    kind = rng.choice([*KINDS, *KINDS, "", ""])
    if kind == "email":
        user = rng.choice([w(), f"{w()}.{w()}", f"{w()}{d(2)}", f"{w()}_{w()}", d(2)])
        return kind, f"{user}@{rng.choice([w(), w() + d(1)])}{rng.choice(['', '.' + w()])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
    if kind == "ip":
        return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return kind, card(rng)
    if kind == "phone":
        return kind, rng.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)}{d(9)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])
    return kind, rng.choice([
        d(rng.randint(1, 6)), f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"@{w()}",
        f"{d(3)},{d(3)}", f'"{d(8)}"', d(rng.randint(9, 13)), d(rng.randint(20, 26)), "AK" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(18)), f"{w()}={''.join(rng.choice('0123456789abcdef') for _ in range(18))}",
    ])


def sample(rng: random.Random, carriers: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """One or several written things in carrier text, with their spans."""
    t = rng.choice(carriers)
    at = rng.randrange(0, max(1, len(t) - 150))
    left, right = rng.choice([(" ", " "), (" ", "\n"), ("\n", " "), (" ", ", "), (" ", ". "), ("", " "), (": ", " "), (" (", ") ")])
    head = t[at : at + rng.randint(0, 70)]
    text, spans = head + (left or " " * bool(head)), []
    for i in range(rng.choice([1, 1, 1, 2])):
        kind, s = written(rng)
        text += (rng.choice([" ", " ", "\n", ", "]) if i else "")
        if kind:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s
    return text + right + t[at + 70 : at + 150], spans


def training(texts: list[str], most: int = TRAIN_WINDOWS, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: stretches with base spans, and written spans within carrier text."""
    rng = random.Random(seed)
    xs, ys = [], []

    def add(text, spans, s):
        x, y = np.full(WINDOW, CLASSES, np.uint8), np.zeros(WINDOW, np.int64)
        some = classes(text[s : s + WINDOW])
        x[: len(some)] = some
        for kind, a, b in spans:
            for i in range(max(a, s), min(b, s + WINDOW, len(text))):
                y[i - s] = 1 + 2 * KINDS.index(kind) + (i > a and i > s)
        xs.append(x)
        ys.append(y)

    for text in texts:
        base = base_spans(text)
        for _, a, b in base[:4]:
            # Where a digit stands close by and in no span, the patterns may have lost a neighbour: that is no label.
            if all(any(x <= m.start() < y for _, x, y in base) for m in HINT.finditer(text, max(0, a - WINDOW), b + WINDOW)):
                add(text, base, max(0, a - rng.randint(0, WINDOW - 20)))
    xs, ys = xs[: most // 4], ys[: most // 4]
    carriers = carriers_of(texts)
    while len(xs) < most:
        text, spans = sample(rng, carriers)
        near = rng.choice(spans)[1] if spans else len(text) // 2
        add(text, spans, max(0, near - rng.randint(0, 60)))
    return np.stack(xs), np.stack(ys)


def carriers_of(texts: list[str]) -> list[str]:
    return [t for t in texts if len(t) > 200 and not HINT.search(t)] or ["lorem ipsum dolor sit amet. " * 40]


def fitted(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Tagger:
    """Trained on labelled spans of a share of the documents by hash of doc_id and text, from about `sample` to 2 x `sample` (or all, if fewer) of those with hints and as many of those without."""
    rows = docs.where(F.length("text").between(200, 20_000)).select("text", F.col("text").rlike("[0-9@]").alias("hint"), F.xxhash64("doc_id", "text").alias("h"))
    every = {r["hint"]: max(1, r["count"] // sample) for r in rows.groupBy("hint").count().collect()}
    # The share is taken where the rows are, and repeated rows count once: only about 4 x sample texts at most leave the tasks, however many tasks there are.
    some = rows.where(F.pmod("h", F.when(F.col("hint"), every.get(True, 1)).otherwise(every.get(False, 1))) == 0).distinct().collect()
    texts = [r["text"] for r in sorted(some, key=lambda r: (not r["hint"], r["h"], r["text"]))]
    # Whoever has fitted on these texts before has left the model where all can read it.
    spark, said = docs.sparkSession, hashlib.sha256(repr((TRAIN_WINDOWS, EPOCHS, HIDDEN, EMBED, WINDOW)).encode())
    for t in texts:
        said.update(b"%d:" % len(t) + t.encode("utf-8", "surrogatepass"))
    path = f"{shared_dir(spark)}/tagger-{said.hexdigest()[:32]}"
    if finished(spark, path):
        return loaded(spark, path)
    model = Tagger().fit(*training(texts))
    saved(spark, model, path)
    return model


def saved(spark, model: Tagger, path: str) -> None:
    """A model as a table: a row for each array. What is there already stays."""
    rows = [(k, list(a.shape), bytearray(np.ascontiguousarray(a, np.float32).tobytes())) for k, a in sorted(model.p.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("ignore").parquet(path)


def loaded(spark, path: str) -> Tagger:
    model = Tagger()
    for r in spark.read.parquet(path).collect():  # a dozen rows
        model.p[r["name"]] = np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]).copy()
    return model


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def spans(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all, as kind:start:end joined by commas)."""
    model = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))

    def run(batches):
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            for part in slices(batch, "text", STEP):
                rows = []
                for doc, (base, every) in zip(column(part, "doc_id"), found([t or "" for t in column(part, "text")], model.value)):
                    base = sorted(base, key=lambda s: (order[s[0]], s[1]))
                    rows.append((doc, *[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
                if rows:
                    yield record_batch(OUT, *zip(*rows))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, every) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind."""
    out, at = [], 0
    for kind, a, b in sorted(every, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents, with all their columns, each span replaced; n_chars counts the new text's characters."""
    model = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", STEP):
                texts = column(part, "text")
                new = [t if t is None else masked(t, every) for t, (_, every) in zip(texts, found([t or "" for t in texts], model.value))]
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                cols["text"] = pa.array(new, part.schema.field("text").type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in new], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
