"""A character tagger in numpy: a bidirectional LSTM under a linear-chain CRF, trained from labelled spans."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

KINDS = ("email", "ip", "card", "phone")
N_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
N_CHARS = 98


def _from_top(scores: np.ndarray) -> np.ndarray:
    return scores - scores.max(-1, keepdims=True)


@dataclass(frozen=True)
class TaggerSettings:
    window: int = 64
    stride: int = 32
    embedding: int = 12
    hidden: int = 20
    examples: int = 4096
    batch: int = 96
    steps: int = 280
    rate: float = 0.01
    seed: int = 7


def char_ids(text: str) -> np.ndarray:
    """ASCII by itself; controls, other letters and the rest as one class each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.fromiter(map(str.isalpha, text), bool, len(text)) if codes.size and codes.max() > 126 else np.zeros(len(text), bool)
    return np.where((codes >= 32) & (codes < 127), codes - 32, np.where(codes < 32, 95, np.where(letters, 96, 97))).astype(np.int64)


def tags_of(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for kind, start, end in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[start:end] = k + 1
        tags[start] = k
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one kind; an inside tag without a begin opens a span, too."""
    out: list[tuple[str, int, int]] = []
    at = 0
    while at < len(tags):
        if not tags[at]:
            at += 1
            continue
        kind, start = (tags[at] - 1) // 2, at
        at += 1
        while at < len(tags) and tags[at] == 2 * kind + 2:
            at += 1
        out.append((KINDS[kind], start, at))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


class Tagger:
    def __init__(self, s: TaggerSettings):
        rng, e, h = np.random.default_rng(s.seed), s.embedding, s.hidden
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.s = s
        self.p = {"emb": draw(N_CHARS, e, scale=0.3), "wx": draw(2, e, 4 * h, scale=e**-0.5), "wh": draw(2, h, 4 * h, scale=h**-0.5), "b": np.zeros((2, 1, 4 * h), np.float32), "out": draw(2 * h, N_TAGS, scale=h**-0.5), "bias": np.zeros(N_TAGS, np.float32), "trans": np.zeros((N_TAGS, N_TAGS), np.float32)}
        self.p["b"][:, :, h : 2 * h] = 1  # remember at first

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (time, batch, tag) of ids (batch, time), and what the way back needs."""
        p, h = self.p, self.s.hidden
        x = p["emb"][ids.T]  # time, batch, embedding
        x = np.stack([x, x[::-1]])
        xw = x @ p["wx"][:, None] + p["b"][:, None]
        n, size = ids.shape[1], ids.shape[0]
        hs, cs, gates = (np.zeros((2, n + 1, size, k), np.float32) for k in (h, h, 4 * h))
        for t in range(n):
            z = xw[:, t] + hs[:, t] @ p["wh"]
            g = gates[:, t]
            g[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
            g[..., 3 * h :] = np.tanh(z[..., 3 * h :])
            cs[:, t + 1] = g[..., h : 2 * h] * cs[:, t] + g[..., :h] * g[..., 3 * h :]
            hs[:, t + 1] = g[..., 2 * h : 3 * h] * np.tanh(cs[:, t + 1])
        both = np.concatenate([hs[0, 1:], hs[1, 1:][::-1]], -1)
        return both @ p["out"] + p["bias"], (ids, x, hs, cs, gates, both)

    def chain(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over paths up to and from each time, and over all."""
        trans, n = self.p["trans"], len(u)
        a, b = np.empty_like(u), np.zeros_like(u)
        a[0] = u[0]
        for t in range(1, n):
            a[t] = u[t] + _log_sum(a[t - 1][:, :, None] + trans, 1)
            b[n - 1 - t] = _log_sum(trans + (u[n - t] + b[n - t])[:, None, :], 2)
        return a, b, _log_sum(a[-1], 1)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h = self.p, self.s.hidden
        u, (ids, x, hs, cs, gates, both) = self.forward(ids)
        a, b, total = self.chain(u)
        n, size, gold = len(u), u.shape[1], tags.T
        rows = np.arange(size)
        hit = np.zeros_like(u)
        hit[np.arange(n)[:, None], rows[None], gold] = 1
        loss = float((total - (u * hit).sum((0, 2)) - p["trans"][gold[:-1], gold[1:]].sum(0)).mean())
        du = (np.exp(a + b - total[None, :, None]) - hit) / size
        pairs = np.exp(a[:-1, :, :, None] + p["trans"] + (u[1:] + b[1:])[:, :, None, :] - total[None, :, None, None]).sum((0, 1))
        np.subtract.at(pairs, (gold[:-1], gold[1:]), 1)
        out = {"trans": pairs / size, "bias": du.sum((0, 1)), "out": np.tensordot(both, du, ((0, 1), (0, 1)))}
        back = du @ p["out"].T
        back = np.stack([back[..., :h], back[::-1, :, h:]])
        dz = np.empty_like(gates[:, :n])
        dh = dc = np.zeros((2, size, h), np.float32)
        for t in range(n - 1, -1, -1):
            i, f, o, g = (gates[:, t, :, k * h : (k + 1) * h] for k in range(4))
            dh = back[:, t] + dh
            tc = np.tanh(cs[:, t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * cs[:, t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], -1)
            dh, dc = dz[:, t] @ p["wh"].transpose(0, 2, 1), dc * f
        flat = lambda v: v.reshape(2, n * size, -1)
        out["wx"], out["wh"] = flat(x).transpose(0, 2, 1) @ flat(dz), flat(hs[:, :n]).transpose(0, 2, 1) @ flat(dz)
        out["b"] = dz.sum((1, 2))[:, None]
        dx = dz @ p["wx"].transpose(0, 2, 1)[:, None]
        out["emb"] = np.zeros_like(p["emb"])
        np.add.at(out["emb"], ids.T, dx[0] + dx[1][::-1])
        return loss, out

    def fit(self, ids: np.ndarray, tags: np.ndarray) -> list[float]:
        """Adam over random batches; the losses."""
        s, rng = self.s, np.random.default_rng(self.s.seed + 1)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, s.steps + 1):
            pick = rng.integers(0, len(ids), s.batch)
            loss, grads = self.gradients(ids[pick], tags[pick])
            losses.append(loss)
            rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, scores: list[np.ndarray], most: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each sequence of scores (time, tag), its best tags as a whole and the probability that each place is outside.
        Sequences of like length are taken together, up to ``most`` places."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(scores)
        order = sorted((i for i, u in enumerate(scores) if len(u)), key=lambda i: len(scores[i]))
        while order:
            n = len(scores[order[-1]])
            part, order = order[-max(1, most // n) :], order[: -max(1, most // n)]
            sizes = np.array([len(scores[i]) for i in part])
            u = np.zeros((n, len(part), N_TAGS), np.float32)
            for k, i in enumerate(part):
                u[: sizes[k], k] = scores[i]
            tags, outside = self._decode(u, sizes)
            for k, i in enumerate(part):
                out[i] = tags[k, : sizes[k]], outside[k, : sizes[k]]
        return out

    def _decode(self, u: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        trans, n = self.p["trans"], len(u)
        best, came = u[0].copy(), np.empty(u.shape, np.int8)
        a, b = np.empty_like(u), np.zeros_like(u)
        a[0] = u[0]
        for t in range(1, n):
            on = (t < sizes)[:, None]  # beyond its end a sequence stays as it is
            step = best[:, :, None] + trans
            came[t] = np.where(on, step.argmax(1), np.arange(N_TAGS))
            # of each step only the differences between tags matter, so sums are brought back to zero and stay exact in texts of any length
            best = np.where(on, _from_top(step.max(1) + u[t]), best)
            a[t] = np.where(on, _from_top(u[t] + _log_sum(a[t - 1][:, :, None] + trans, 1)), a[t - 1])
            back = n - t
            b[back - 1] = np.where((back < sizes)[:, None], _from_top(_log_sum(trans + (u[back] + b[back])[:, None, :], 2)), 0)
        tags = np.empty((u.shape[1], n), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            tags[:, t - 1] = np.take_along_axis(came[t], tags[:, t][:, None], 1)[:, 0]
        both = a + b
        return tags, np.exp(both[..., 0] - _log_sum(both, 2)).T


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def labelled_texts(n: int, seed: int, width: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up prose of ``width`` characters with labelled personal data in usual and unusual spellings, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[rng.integers(len(items))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ["the", "an", "re", "on", "ti", "sch", "lich", "eau", "que", "ción", "ñas", "é", "ü", "or", "st", "en", "is", "ma", "lo", "vi"]

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
        w = w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.05 else w
        return w + (pick([".", ",", "!!", "***", "$$$", "###", " |", "\n", ":"]) if rng.random() < 0.25 else "")

    def email() -> str:
        local = pick([word().strip(".,!*$#| \n:") or "a", f"{pick(syllables)}.{rng.integers(1, 99)}", f"{pick(syllables)}_{pick(syllables)}", f"{pick(syllables)}+{pick(syllables)}"])
        return f"{local}@{pick(['mail', 'post', 'm', 'büro', pick(syllables)])}{pick(['', '-'])}{rng.integers(0, 20)}.{pick(['example.com', 'example.org', 'example.net', 'example'])}"

    def card() -> str:
        d = digits(15)
        d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
        sep = pick(["", "", " ", "-", ".", "/"])
        return sep.join([d[:4], d[4:8], d[8:12], d[12:]])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.integers(1, 99)} {a} {b} {c}"])

    def ip() -> str:
        return pick([".", ".", ".", "[.]"]).join(map(str, rng.integers(0, 256, 4)))

    def none() -> str:
        return pick([digits(rng.integers(1, 9)), f"{rng.integers(1900, 2100)}", f"{rng.integers(1, 9)}.{rng.integers(1, 9)}.{rng.integers(1, 9)}", f"{rng.integers(1, 30)}/{rng.integers(1, 12)}/{rng.integers(1990, 2030)}", f"{rng.integers(0, 24)}:{rng.integers(10, 60)}", f"@{pick(syllables)}", f"{rng.integers(1, 999)}%", "token = \"" + "".join(pick("0123456789abcdef") for _ in range(24)) + '"', f"${rng.integers(1, 9999)}.{rng.integers(10, 99)}"])

    makers = {"email": email, "card": card, "phone": phone, "ip": ip}
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 2 * width:
            if rng.random() < 0.12:
                kind = pick(list(makers)) if rng.random() < 0.7 else None
                made = makers[kind]() if kind else none()
                if kind:
                    spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += word()
            text += " "
        cut = rng.integers(0, width)
        inside = [(k, max(a, cut) - cut, min(b, cut + width) - cut) for k, a, b in spans if a < cut + width and b > cut]
        out.append((text[cut : cut + width], inside))
    return out


def fitted(s: TaggerSettings = TaggerSettings()) -> Tagger:
    """A tagger trained on labelled texts; the same settings give the same one."""
    rows = labelled_texts(s.examples, s.seed, s.window)
    tagger = Tagger(s)
    tagger.fit(np.stack([char_ids(t) for t, _ in rows]), np.stack([tags_of(s.window, x) for _, x in rows]))
    return tagger


_TRAINED: dict[TaggerSettings, Tagger] = {}


def trained(spark: SparkSession, s: TaggerSettings = TaggerSettings()) -> Tagger:
    """``fitted`` once a process, in a Spark task: the driver only receives the few thousand parameters."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"tagger": [pickle.dumps(fitted(s)) for _ in range(len(batch))]})

    if s not in _TRAINED:
        _TRAINED[s] = pickle.loads(spark.range(1, numPartitions=1).mapInPandas(fit, "tagger binary").first()["tagger"])
    return _TRAINED[s]
