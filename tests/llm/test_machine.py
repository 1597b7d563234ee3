"""The factorisation machine: margins pair by pair, and a training step by differences of the loss."""

import math

import numpy as np

from steploom.llm import fm


def rows_of(rng, n):
    """Sparse rows over few features, some of them shared, with repeats of none."""
    out = []
    for k in range(n):
        at = np.sort(rng.choice(12, rng.integers(1, 8), replace=False)).astype(np.int32)
        out.append((int(k % 3 == 0), at, rng.normal(size=len(at)).astype(np.float32)))
    return out


def margin(b, w, v, at, x):
    out = b + sum(w[i] * s for i, s in zip(at, x))
    for j in range(len(at)):
        for k in range(j):
            out += float(np.dot(v[at[j]], v[at[k]])) * x[j] * x[k]
    return out


def test_margins_pair_by_pair():
    rng = np.random.default_rng(1)
    m = fm.Machine()
    m.b, m.w = 0.3, rng.normal(size=fm.WIDTH).astype(np.float32)
    rows = rows_of(rng, 20)
    starts = np.concatenate([[0], np.cumsum([len(a) for _, a, _ in rows])[:-1]])
    got = m.margins(np.concatenate([a for _, a, _ in rows]), np.concatenate([x for _, _, x in rows]), starts)
    want = [margin(m.b, m.w, m.v, a.tolist(), x.tolist()) for _, a, x in rows]
    assert np.allclose(got, want, atol=1e-4)
    texts = [b"a b c a", None, b"", "é # $ a".encode()]
    idx, val, at = fm.features(texts)
    for k, (lo, hi) in enumerate(zip(at, [*at[1:], len(idx)])):
        assert math.isclose(m.margins(idx, val, at)[k], margin(m.b, m.w, m.v, idx[lo:hi].tolist(), val[lo:hi].tolist()), abs_tol=1e-4)


def test_a_training_step_by_differences():
    """One batch: every parameter moves by its gradient, scaled by the root of its square and the start value."""
    rng = np.random.default_rng(2)
    rows = rows_of(rng, 9)
    m = fm.Machine()
    share = sum(y for y, _, _ in rows) / len(rows)
    b, w, v = math.log(share / (1 - share)), m.w.astype(float).copy(), m.v.astype(float).copy()
    m.fit(rows, epochs=1, batch=len(rows))

    def loss():
        z = [margin(b, w, v, a.tolist(), x.tolist()) for _, a, x in rows]
        return sum(math.log1p(math.exp(-t if y else t)) for t, (y, _, _) in zip(z, rows)) / len(rows)

    def gradient(values, at):
        old, size = values[at], 1e-4
        values[at] = old + size
        up = loss()
        values[at] = old - size
        down = loss()
        values[at] = old
        return (up - down) / (2 * size)

    used = sorted({int(i) for _, a, _ in rows for i in a})
    for i in used:
        g = gradient(w, i)
        assert abs(m.w[i] - (w[i] - 0.1 * g / math.sqrt(1e-2 + g * g))) < 1e-4
        for f in range(fm.RANK):
            g = gradient(v, (i, f)) + 1e-5 * v[i, f]
            assert abs(m.v[i, f] - (v[i, f] - 0.03 * g / math.sqrt(1e-2 + g * g))) < 1e-4
    others = np.setdiff1d(np.arange(fm.WIDTH), used)
    assert not m.w[others].any() and np.array_equal(m.v[others], fm.Machine().v[others])
    z = [margin(b, w, v, a.tolist(), x.tolist()) for _, a, x in rows]
    g = sum(1 / (1 + math.exp(-t)) - y for t, (y, _, _) in zip(z, rows)) / len(rows)
    assert abs(m.b - (b - 0.1 * g / math.sqrt(1e-2 + g * g))) < 1e-6
