"""Steps of the language model's training against the plain formulas."""

import tracemalloc

import numpy as np

from relgrid.llm import lm_score as L


def test_sums_of_runs_do_not_depend_on_runs_before():
    rows = np.array([[1e8, -1e8], [3e7, 5], [1, 2], [0.25, 0.5]], np.float32)
    assert L.segment_sums(rows, np.array([0, 2])).tolist() == [[1.3e8, -99999992.0], [1.25, 2.5]]


def test_step_for_classes_is_that_of_the_formulas():
    rng = np.random.default_rng(1)
    n, size = 200, 40
    share = rng.random(size)
    share /= share.sum()
    v = L.Vocabulary(None, None, None, None, n, size, None, np.array([0, 1]), np.array([2.0]), share)
    t = L.Trainer(L.LogBilinear(share, 1), v, 7)
    a, b, w = rng.integers(0, size + 1, n), rng.integers(0, size + 1, n), rng.integers(0, size, n)
    m = {k: getattr(t.m, k).astype(float) for k in t.m.NAMES}
    noise = np.minimum(np.searchsorted(np.cumsum(share), np.random.default_rng(7).random(L.NOISE) * np.cumsum(share)[-1], "right"), size - 1)
    q = m["context"][a] @ m["first"] + m["context"][b] @ m["second"]
    bias = m["bias"] - np.log(L.NOISE * share)
    sigma = lambda x: 1 / (1 + np.exp(-x))
    hit, miss = (sigma((q * m["output"][w]).sum(1) + bias[w]) - 1) / n, sigma(q @ m["output"][noise].T + bias[noise]) / n
    back = hit[:, None] * m["output"][w] + miss @ m["output"][noise]
    g = {k: np.zeros(x.shape) for k, x in m.items()}
    np.add.at(g["output"], w, hit[:, None] * q)
    np.add.at(g["output"], noise, miss.T @ q)
    np.add.at(g["bias"], w, hit)
    np.add.at(g["bias"], noise, miss.sum(0))
    np.add.at(g["context"], a, back @ m["first"].T)
    np.add.at(g["context"], b, back @ m["second"].T)
    g["first"], g["second"] = m["context"][a].T @ back, m["context"][b].T @ back
    t.classes(a, b, w)
    for k, x in m.items():
        want = x - L.RATE * (0.1 if k in ("first", "second") else 1) * g[k] / np.sqrt(1e-4 + g[k] ** 2)
        assert np.allclose(getattr(t.m, k), want, atol=1e-4), k


def test_logistic_far_out():
    assert L.logistic(np.array([-200, 0, 200], np.float32)).tolist() == [0, 0.5, 1]


def shared_vocabulary(sizes: list[int], own: int = 5) -> L.Vocabulary:
    """Of `own` own classes and shared ones of so many rows."""
    rng = np.random.default_rng(2)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    share = rng.random(own + len(sizes)) + 0.1
    return L.Vocabulary(np.zeros(0, np.uint64), None, None, None, 100, 100, None, edge, rng.integers(1, 50, edge[-1]).astype(float), share / share.sum())


def test_step_inside_classes_is_that_of_the_formulas(monkeypatch):
    monkeypatch.setattr(L, "OWN", 5)
    rng = np.random.default_rng(3)
    v = shared_vocabulary([7, 1, 30, 12])
    rows, n = int(v.edge[-1]), 300
    t = L.Trainer(L.LogBilinear(v.share, rows), v, 7)
    t.m.inner += rng.standard_normal(t.m.inner.shape).astype(np.float32) * 0.3
    row = np.where(rng.random(n) < 0.7, rng.integers(0, rows, n), -1)
    w = np.where(row >= 0, 5 + np.searchsorted(v.edge, row, "right") - 1, rng.integers(0, 5, n)).astype(np.int32)
    a, b, x, y = rng.integers(0, 10, n), rng.integers(0, 10, n), rng.integers(0, 20, n), rng.integers(0, 20, n)
    drawn = np.stack([rng.integers(v.edge[c], v.edge[c + 1], L.WORD_NOISE) for c in range(4)])
    monkeypatch.setattr(t, "_noise_words", lambda: drawn)
    monkeypatch.setattr(t, "classes", lambda *_: None)
    m = {k: getattr(t.m, k).astype(float) for k in (*t.m.NAMES, *t.m.ROWS)}
    g = {k: np.zeros(m[k].shape) for k in t.m.ROWS}
    sigma = lambda z: 1 / (1 + np.exp(-z))
    for i in np.flatnonzero(row >= 0):
        q = (m["context"][a[i]] + m["own"][x[i]]) @ m["first"] + (m["context"][b[i]] + m["own"][y[i]]) @ m["second"]
        back = np.zeros(L.DIM)
        for r, hit in [(row[i], 1), *((r, 0) for r in drawn[w[i] - 5])]:
            e = sigma(q @ m["inner"][r] - np.log(L.WORD_NOISE)) - hit
            back += e * m["inner"][r]
            g["inner"][r] += e * q
        g["own"][x[i]] += m["first"] @ back
        g["own"][y[i]] += m["second"] @ back
    t.learn(a, b, w, x, y, row)
    k = row >= 0
    assert (t.used["inner"] == np.bincount(row[k], minlength=rows)).all()
    assert (t.used["own"] == np.bincount(np.concatenate([x[k], y[k]]), minlength=len(t.m.own))).all()
    for name in t.m.ROWS:
        want = m[name] - L.WORD_RATE * g[name] / np.sqrt(L.PAST + (g[name] ** 2).sum(1, keepdims=True) / L.DIM)
        assert np.allclose(getattr(t.m, name), want, atol=1e-4), name


def test_rows_are_summed_by_number():
    rng = np.random.default_rng(4)
    at, rows = rng.integers(0, 9, 50), rng.standard_normal((25, 6)).astype(np.float32)
    u, sums, back = L.gathered(at, rows, np.full(9, 77))
    assert sorted(u) == sorted(set(at)) and (u[back] == at).all()
    want = np.zeros((9, 6))
    np.add.at(want, at, np.concatenate([rows, rows]))
    assert np.allclose(sums, want[u], atol=1e-5)


def test_tokens_make_no_sums_by_byte():
    """Words are hashed eight bytes at a time: before, hashing took three tables of eight bytes for each byte of text."""
    text = np.frombuffer(b"some words of middling length, and others " * 20000, np.uint8)
    tracemalloc.start()
    L.tokens(text, np.array([0, len(text)]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 18 * len(text)


def test_equal_words_alone_have_equal_hashes():
    rng = np.random.default_rng(5)
    words = {bytes(rng.choice(list(b"a\0b"), n).astype(np.uint8)) for n in [*range(1, 80), 500] for _ in range(8)} | {b"x" * n for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 73)}
    words = sorted(words)
    text = b" ".join([*words, *(w.replace(b"a", b"A") for w in words)])
    key, _, _ = L.tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert key[: len(words)].tolist() == key[len(words) : -1].tolist() and len(set(key.tolist())) == len(words) + 1 and key[-1] == L.END


def test_keys_are_found_however_crowded():
    rng = np.random.default_rng(6)
    keys = np.unique(np.concatenate([rng.integers(low, high, 20, dtype=np.uint64, endpoint=True) for low, high in ((0, 40), (2**64 - 40, 2**64 - 1), *[(0, 2**64 - 1)] * 20)]))
    v = shared_vocabulary([9, 9])
    v.keys, v.splits, v.edge = keys, np.full(L.ENDINGS, 1), np.arange(L.ENDINGS + 1)
    v.classes, v.rows = np.arange(len(keys)).astype(np.int32), np.arange(len(keys)) * 2
    asked = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    w, row, at = v.classify(asked, np.full(len(asked), 3))
    want = {int(k): i for i, k in enumerate(keys)}
    for k, c, r, i in zip(asked.tolist(), w, row, at, strict=True):
        assert (c, r, i) == ((want[k], 2 * want[k], want[k]) if k in want else (L.OWN + 3, 3, -1))


def test_drawn_rows_are_those_of_the_summed_weights():
    v = shared_vocabulary([3000, 1, 2, 500])
    v.weight[7] = 1e7
    t = L.Trainer(L.LogBilinear(v.share, int(v.edge[-1])), v, 1)
    at = np.concatenate([np.random.default_rng(1).random(5000) * t.below[-1], t.below[:-1], np.nextafter(t.below[1:], 0)])
    assert (t._drawn(at) == np.searchsorted(t.below, at, "right") - 1).all()


def test_normalisers_are_sums_of_exponentials():
    share = np.full(30, 1 / 30)
    m = L.LogBilinear(share, 0)
    m.output *= 200  # far beyond single precision
    far, near = (m.context.astype(float) @ x @ m.output.T for x in (m.first, m.second))
    z = far[:, None] + near[None] + m.bias
    top = z.max(2)
    assert np.allclose(m.normalisers(), top + np.log(np.exp(z - top[..., None]).sum(2)), rtol=1e-5, atol=1e-3)


def test_rows_are_added_to_tables_of_any_length():
    rng = np.random.default_rng(7)
    for n in (1, 30, 8 * L.BATCH, 8 * L.BATCH + 5):
        to, rows = np.append(rng.integers(0, n, 400), n - 1).astype(np.int32), rng.standard_normal((401, 4)).astype(np.float32)
        got, want = np.ones((n, 4), np.float32), np.ones((n, 4))
        np.add.at(want, to, rows)
        L.add_rows(got, to, rows)
        assert np.allclose(got, want, atol=1e-4)
