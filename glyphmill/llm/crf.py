"""A character-level bidirectional LSTM with a CRF over its tags, in numpy.

Trained by Adam on windows of one length; the gradient is the exact one, through
the CRF's forward and backward sums and both LSTMs.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class BiLstmCrf:
    def __init__(self, symbols: int, tags: int, embed: int = 12, hidden: int = 20, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(f)
        self.hidden = hidden
        self.p = {"emb": r.standard_normal((symbols, embed)).astype(f) * f(0.5), "out": n(2 * hidden, tags), "bias": np.zeros(tags, f), "trans": np.zeros((tags, tags), f), "start": np.zeros(tags, f)}
        for d in "fb":
            self.p |= {f"w{d}": n(embed, 4 * hidden), f"u{d}": n(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, f)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _lstm(self, x, d):
        """x: batch, time, embed. Outputs, and what the way back needs."""
        p, h = self.p, self.hidden
        b, t, _ = x.shape
        z = x @ p[f"w{d}"] + p[f"c{d}"]
        out = np.zeros((b, t, h), np.float32)
        hs, cs = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        kept = []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[:, k] + hs @ p[f"u{d}"]
            g = _sigmoid(a[:, : 3 * h])
            i, fo, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(a[:, 3 * h :])
            new = fo * cs + i * c
            tc = np.tanh(new)
            kept.append((k, hs, cs, i, fo, o, c, tc))
            hs, cs = o * tc, new
            out[:, k] = hs
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["emb"][ids]
        both = np.concatenate([self._lstm(x, "f")[0], self._lstm(x, "b")[0]], -1)
        return both @ self.p["out"] + self.p["bias"]

    def gradient(self, ids: np.ndarray, tags: np.ndarray):
        """Mean loss a character, and the gradient."""
        p, h = self.p, self.hidden
        b, t = ids.shape
        x = p["emb"][ids]
        hf, kf = self._lstm(x, "f")
        hb, kb = self._lstm(x, "b")
        both = np.concatenate([hf, hb], -1)
        e = both @ p["out"] + p["bias"]
        fw = np.zeros_like(e)
        bw = np.zeros_like(e)
        fw[:, 0] = e[:, 0] + p["start"]
        for k in range(1, t):
            fw[:, k] = e[:, k] + _logsum(fw[:, k - 1, :, None] + p["trans"], 1)
        for k in range(t - 2, -1, -1):
            bw[:, k] = _logsum(p["trans"] + (e[:, k + 1] + bw[:, k + 1])[:, None, :], 2)
        total = _logsum(fw[:, -1], 1)
        marginal = np.exp(fw + bw - total[:, None, None])
        gold = np.zeros_like(e)
        np.put_along_axis(gold, tags[..., None], 1, -1)
        path = (e * gold).sum((1, 2)) + p["start"][tags[:, 0]] + p["trans"][tags[:, :-1], tags[:, 1:]].sum(1)
        loss = float((total - path).mean() / t)
        scale = np.float32(1 / (b * t))
        de = (marginal - gold) * scale
        g = {"start": de[:, 0].sum(0), "bias": de.sum((0, 1)), "out": both.reshape(-1, 2 * h).T @ de.reshape(b * t, -1)}
        pair = np.zeros_like(p["trans"])
        for k in range(t - 1):
            pair += np.exp(fw[:, k, :, None] + p["trans"] + (e[:, k + 1] + bw[:, k + 1])[:, None, :] - total[:, None, None]).sum(0)
        seen = np.zeros_like(pair)
        np.add.at(seen, (tags[:, :-1], tags[:, 1:]), 1)
        g["trans"] = (pair - seen) * scale
        dboth = de @ p["out"].T
        dx = np.zeros_like(x)
        for d, kept, dh_all in (("f", kf, dboth[..., :h]), ("b", kb, dboth[..., h:])):
            u, da_all = p[f"u{d}"], np.zeros((b, t, 4 * h), np.float32)
            gu = np.zeros_like(u)
            dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
            for k, hp, cp, i, fo, o, c, tc in reversed(kept):
                dh = dh + dh_all[:, k]
                dc = dc + dh * o * (1 - tc * tc)
                da = np.concatenate([dc * c * i * (1 - i), dc * cp * fo * (1 - fo), dh * tc * o * (1 - o), dc * i * (1 - c * c)], 1)
                da_all[:, k] = da
                gu += hp.T @ da
                dh = da @ u.T
                dc = dc * fo
            g[f"u{d}"], g[f"c{d}"] = gu, da_all.sum((0, 1))
            g[f"w{d}"] = x.reshape(b * t, -1).T @ da_all.reshape(b * t, -1)
            dx += da_all @ p[f"w{d}"].T
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], ids, dx)
        return loss, g

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, sums = r.permutation(len(ids)), []
            for k in range(0, len(ids), batch):
                at = order[k : k + batch]
                loss, g = self.gradient(ids[at], tags[at])
                sums.append(loss)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                clip = min(1.0, 5.0 / (norm + 1e-9))
                step += 1
                now = rate * (1 - 0.9 * epoch / epochs)
                for name, x in g.items():
                    x = x * np.float32(clip)
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v[name] = 0.99 * v[name] + 0.01 * x * x
                    self.p[name] = (self.p[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags for one text's emissions (time, tags)."""
        trans = self.p["trans"]
        best = e[0] + self.p["start"]
        back = np.zeros(e.shape, np.int32)
        for k in range(1, len(e)):
            s = best[:, None] + trans
            back[k] = s.argmax(0)
            best = s.max(0) + e[k]
        out = np.zeros(len(e), np.int32)
        out[-1] = best.argmax()
        for k in range(len(e) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out
