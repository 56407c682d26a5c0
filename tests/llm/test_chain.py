import itertools

import numpy as np

from quire.llm.chain import Chain


def best(u, tr):
    """Brute force over all label paths."""
    paths = list(itertools.product(range(u.shape[1]), repeat=len(u)))
    score = [sum(u[t, p[t]] for t in range(len(p))) + sum(tr[p[t - 1], p[t]] for t in range(1, len(p))) for p in paths]
    return max(score), paths[int(np.argmax(score))]


def test_decoding_is_exact():
    rng = np.random.default_rng(1)
    for trial in range(60):
        net = Chain(["O", "B", "I"], lambda w: [w], barred=[("O", "I")], offsets=(0,))
        words = [f"w{i}" for i in range(6)]
        net.index = {(0, w): i for i, w in enumerate(words)}
        net.weights = rng.normal(0, 1.5, (6, 3)).astype(np.float32) + np.array([trial % 3, 0, 0], np.float32)
        net.trans = rng.normal(0, 1, (3, 3))
        seqs = [[words[rng.integers(6)] for _ in range(rng.integers(0, 7))] for _ in range(5)]
        tr = net.trans + net.bar
        for seq, path in zip(seqs, net.decode(seqs), strict=True):
            if not seq:
                assert len(path) == 0
                continue
            u = np.stack([net.weights[net.index[(0, w)]] for w in seq])
            got = sum(u[t, path[t]] for t in range(len(seq))) + sum(tr[path[t - 1], path[t]] for t in range(1, len(seq)))
            assert abs(got - best(u, tr)[0]) < 1e-3


def test_learns_context():
    seqs = [["call", "12", "now"], ["page", "12", "now"], ["call", "77"], ["page", "5"]] * 5
    tags = [["O", "N", "O"], ["O", "O", "O"], ["O", "N"], ["O", "O"]] * 5
    net = Chain(["O", "N"], lambda w: ["num"] if w.isdigit() else [w]).fit(seqs, tags, rounds=30, rate=0.1)
    assert [list(p) for p in net.decode([["call", "3"], ["page", "3"]])] == [[0, 1], [0, 0]]
