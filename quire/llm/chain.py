"""Linear-chain conditional random field in numpy, with batched training and Viterbi decoding.

A token's score for a label is a sum over positions around it: ``sum_d U[d][type(t + d)]``, where ``type`` is
the token's distinct form. The vector of a distinct form is made once per batch, so that decoding costs one
table look-up per token and position, however many features a form has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

OFFSETS = (-2, -1, 0, 1, 2)


class Chain:
    """Labels, feature weights per offset and transition scores.

    Args:
        labels: label names; index 0 is used for padding.
        features: maps a token to its feature strings.
        barred: pairs (a, b) of label names for which b may not follow a.
    """

    def __init__(self, labels: Sequence[str], features: Callable[[str], list[str]], barred=(), offsets=OFFSETS):
        self.labels, self.features, self.offsets = list(labels), features, tuple(offsets)
        self.index: dict[tuple[int, str], int] = {}
        self.weights = np.zeros((0, len(self.labels)))
        self._by: dict | None = None  # the weights by feature, made when first decoding
        self.trans = np.zeros((len(self.labels), len(self.labels)))
        self.bar = np.zeros_like(self.trans)
        at = {x: i for i, x in enumerate(self.labels)}
        for a, b in barred:
            self.bar[at[a], at[b]] = -1e4

    # -- training -----------------------------------------------------------------------------------------
    def fit(self, tokens: list[list], tags: list[list[str]], rounds: int = 10, ridge: float = 0.5, rate: float = 0.05, least: int = 1, bucket: int = 100):
        """Maximise the penalised conditional likelihood by Adam over batches of like length; deterministic."""
        at = {x: i for i, x in enumerate(self.labels)}
        counts: dict[tuple[int, str], int] = {}
        forms: dict = {}
        for seq in tokens:
            for w in seq:
                forms.setdefault(w, self.features(w))
            for t in range(len(seq)):
                for d in self.offsets:
                    if 0 <= t + d < len(seq):
                        for f in forms[seq[t + d]]:
                            counts[(d, f)] = counts.get((d, f), 0) + 1
                    else:
                        counts[(d, "<edge>")] = counts.get((d, "<edge>"), 0) + 1
        self.index = {k: i for i, k in enumerate(sorted(k for k, n in counts.items() if n >= least))}
        size = len(self.labels)
        order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        parts = [order[k : k + bucket] for k in range(0, len(order), bucket)]
        packs = [self._pack([tokens[i] for i in p], [[at[x] for x in tags[i]] for i in p], forms) for p in parts]
        w, tr = np.zeros((len(self.index), size), np.float32), np.zeros((size, size), np.float32)
        m = [np.zeros_like(w), np.zeros_like(tr)]
        v = [np.zeros_like(w), np.zeros_like(tr)]
        bar = self.bar.astype(np.float32)
        rng, step, steps = np.random.default_rng(3), 0, rounds * len(packs)
        for _ in range(rounds):
            for k in rng.permutation(len(packs)):
                n, width, lengths, mask, want_u, want_t, rows, cols, r_ids, r_at, rows_c, c_ids, c_at = packs[k]
                step += 1
                share = ridge * n / len(tokens)
                u = np.zeros((n * width, size), np.float32)
                u[r_ids] = np.add.reduceat(w[cols], r_at, axis=0)
                node, edge = self._marginals(u.reshape(n, width, size), tr + bar, lengths)
                diff = node.reshape(-1, size) * mask.ravel()[:, None] - want_u
                grads = [share * w, share * tr + edge - want_t]
                grads[0][c_ids] += np.add.reduceat(diff[rows_c], c_at, axis=0)
                for j, p in enumerate((w, tr)):
                    m[j] = 0.9 * m[j] + 0.1 * grads[j]
                    v[j] = 0.99 * v[j] + 0.01 * grads[j] ** 2
                    p -= rate * (1 - step / (steps + 1)) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        keep = np.abs(w).max(axis=1) > 1e-3
        names = [k for k, i in sorted(self.index.items(), key=lambda x: x[1]) if keep[i]]
        self.index = {k: i for i, k in enumerate(names)}
        self.weights, self.trans = w[keep].astype(np.float32), tr
        return self

    def _pack(self, tokens, gold_tags, forms):
        """Padded arrays of sequences of like length: which features each position has, and what is wanted."""
        n, width, size = len(tokens), max(map(len, tokens)), len(self.labels)
        rows, cols = [], []
        gold = np.zeros((n, width), int)
        for i, seq in enumerate(tokens):
            gold[i, : len(seq)] = gold_tags[i]
            for t in range(len(seq)):
                for d in self.offsets:
                    for f in forms[seq[t + d]] if 0 <= t + d < len(seq) else ("<edge>",):
                        j = self.index.get((d, f))
                        if j is not None:
                            rows.append(i * width + t)
                            cols.append(j)
        rows, cols = np.array(rows), np.array(cols)
        by_col = np.argsort(cols, kind="stable")
        r_ids, r_at = np.unique(rows, return_index=True)
        c_ids, c_at = np.unique(cols[by_col], return_index=True)
        lengths = np.array([len(s) for s in tokens])
        mask = np.arange(width)[None, :] < lengths[:, None]
        want_u = np.zeros((n * width, size), np.float32)
        want_u[np.arange(n * width), gold.ravel()] = mask.ravel()
        want_t = np.zeros((size, size), np.float32)
        np.add.at(want_t, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        return n, width, lengths, mask, want_u, want_t, rows, cols, r_ids, r_at, rows[by_col], c_ids, c_at

    @staticmethod
    def _marginals(u, tr, lengths):
        n, width, size = u.shape
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        a, b = np.zeros_like(u), np.zeros_like(u)
        a[:, 0] = u[:, 0]
        for t in range(1, width):
            a[:, t] = lse(a[:, t - 1][:, :, None] + tr[None], 1) + u[:, t]
        for t in range(width - 2, -1, -1):
            x = lse(tr[None] + (u[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where((t + 1 < lengths)[:, None], x, 0)
        z = lse(a[np.arange(n), lengths - 1], 1)
        node = np.exp(np.minimum(a + b - z[:, None, None], 0))
        edge = np.zeros((size, size))
        for t in range(width - 1):
            live = t + 1 < lengths
            if live.any():
                x = a[live, t][:, :, None] + tr[None] + (u[live, t + 1] + b[live, t + 1])[:, None, :] - z[live, None, None]
                edge += np.exp(np.minimum(x, 0)).sum(0)
        return node, edge

    # -- decoding -----------------------------------------------------------------------------------------
    def vectors(self, form) -> np.ndarray:
        """The scores that a form adds to the tokens around it: (offsets, labels)."""
        if self._by is None:
            place = {d: k for k, d in enumerate(self.offsets)}
            by: dict = {}
            for (d, f), j in self.index.items():
                by.setdefault(f, []).append((place[d], j))
            self._by = {f: (np.array([k for k, _ in x]), self.weights[[j for _, j in x]]) for f, x in by.items()}
        out = np.zeros((len(self.offsets), len(self.labels)), np.float32)
        for f in self.features(form):
            hit = self._by.get(f)
            if hit is not None:
                out[hit[0]] += hit[1]
        return out

    def __getstate__(self):
        return self.__dict__ | {"_by": None}

    def edge_vectors(self) -> np.ndarray:
        out = np.zeros((len(self.offsets), len(self.labels)), np.float32)
        for k, d in enumerate(self.offsets):
            j = self.index.get((d, "<edge>"))
            if j is not None:
                out[k] = self.weights[j]
        return out

    def decode(self, seqs: list[list], memo: dict | None = None, batch: int = 96) -> list[np.ndarray]:
        """Best label indices of each sequence. ``memo`` keeps forms' vectors between calls; it is emptied when large."""
        memo = {} if memo is None else memo
        if len(memo) > 60_000:
            memo.clear()
        if "<edge>" not in memo:
            memo["<edge>"] = (0, self.edge_vectors())
        rows: list[np.ndarray] = []
        local: dict = {}
        base = [memo["<edge>"][1]]
        for seq in seqs:
            for w in set(seq).difference(local):
                hit = memo.get(("w", w))
                if hit is None:
                    hit = memo[("w", w)] = self.vectors(w)
                local[w] = len(base)
                base.append(hit)
            rows.append(np.fromiter(map(local.__getitem__, seq), np.int32, len(seq)))
        bank = np.stack(base)
        out: list = [None] * len(seqs)
        order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
        for i in range(len(seqs)):
            if not len(seqs[i]):
                out[i] = np.zeros(0, int)
        lo = 0
        while lo < len(order):
            longest = len(seqs[order[min(lo + batch, len(order)) - 1]])
            hi = min(len(order), lo + max(1, min(batch, 400_000 // max(longest, 1))))
            part = order[lo:hi]
            lo = hi
            width = len(seqs[part[-1]])
            pad = max(abs(d) for d in self.offsets)
            ids = np.zeros((len(part), width + 2 * pad), np.int32)
            for k, i in enumerate(part):
                ids[k, pad : pad + len(rows[i])] = rows[i]
            u = np.zeros((len(part), width, len(self.labels)), np.float32)
            for k, d in enumerate(self.offsets):
                u += bank[ids[:, pad + d : pad + d + width], k]
            lengths = np.array([len(rows[i]) for i in part])
            live = self._live(u, lengths)
            for k, i in enumerate(part):
                out[i] = np.zeros(lengths[k], int)
            self._stretches(u, live, lengths, part, out)
        return out

    def _live(self, u, lengths):
        """Tokens that the best path may label other than 0.

        A stretch of other labels gains, over label 0 throughout, at most the sum of its tokens' best scores with the
        best transition into each label, and the best way out. A token can be in such a stretch only if the best sum of
        any stretch around it, found by two running maxima, isn't negative; elsewhere label 0 is certain.
        """
        tr = self.trans + self.bar
        lead = (u[:, :, 1:] + (tr[:, 1:].max(0) - tr[0, 0])).max(2) - u[:, :, 0]
        lead[:, 0] = u[:, 0, 1:].max(1) - u[:, 0, 0]  # nothing leads into the first
        lead[np.arange(u.shape[1])[None, :] >= lengths[:, None]] = -1e6
        ahead, behind = lead.copy(), lead.copy()
        for t in range(1, lead.shape[1]):
            ahead[:, t] += np.maximum(ahead[:, t - 1], 0)
        for t in range(lead.shape[1] - 2, -1, -1):
            behind[:, t] += np.maximum(behind[:, t + 1], 0)
        return ahead + behind - lead + max(0.0, float(tr[1:, 0].max() - tr[0, 0])) >= 0

    def _stretches(self, u, live, lengths, part, out):
        """Viterbi over the runs of live tokens, with label 0 on both sides of each."""
        edge = np.zeros((len(part), 1), bool)
        flat = np.diff(np.concatenate([edge, live, edge], 1).astype(np.int8), axis=1)
        seq, start = np.nonzero(flat == 1)
        stop = np.nonzero(flat == -1)[1]
        order = np.argsort(stop - start, kind="stable")
        for lo in range(0, len(order), 256):
            some = order[lo : lo + 256]
            n = stop[some] - start[some]
            at = start[some][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
            v = u[seq[some][:, None], at].copy()
            tr = (self.trans + self.bar).astype(np.float32)
            v[:, 0] += np.where((start[some] > 0)[:, None], tr[0], 0)
            rows = np.arange(len(some))
            v[rows, n - 1] += np.where((stop[some] < lengths[seq[some]])[:, None], tr[:, 0], 0)
            for k, path in zip(some, self._viterbi(v, n), strict=True):
                out[part[seq[k]]][start[k] : stop[k]] = path

    def _viterbi(self, u, lengths):
        n, width, size = u.shape
        tr = (self.trans + self.bar).astype(np.float32)
        back = np.zeros((n, width, size), np.int8)
        score = u[:, 0].copy()
        for t in range(1, width):
            x = score[:, :, None] + tr[None]
            back[:, t] = x.argmax(1)
            score = np.where((t < lengths)[:, None], x.max(1) + u[:, t], score)
        last = score.argmax(1)
        path = np.zeros((n, width), np.int8)
        cur, idx = last.copy(), np.arange(n)
        for t in range(width - 1, -1, -1):
            cur = np.where(t == lengths - 1, last, cur)
            path[:, t] = cur
            if t:
                cur = np.where(t < lengths, back[idx, t, cur], cur)
        return [path[k, : lengths[k]].astype(int) for k in range(n)]
