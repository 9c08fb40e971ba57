"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network, in numpy, is trained from labelled spans: those of the patterns in a bounded sample of the
corpus, and forms that the patterns do not know (spelled-out addresses, national and odd groupings, secrets)
planted in cuts of the corpus's own texts. It reads every character of whole texts in overlapping windows; where two windows overlap, their
emissions are blended; one Viterbi pass runs over each stretch in which any tag but O is possible, across
the borders of windows, so that a span is decided once and as a whole, by its own text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_share

KINDS = ("email", "ip", "card", "phone")
#: The network also knows secrets (keys, tokens, passwords), for which there is no fixed pattern.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start alone: what fails there fails inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((2 * int(d)) % 10 + (int(d) > 4) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns, in the order of KINDS, then by start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- the network ---------------------------------------------------------------------------

TAGS = ["O"] + [f"{p}-{k}" for k in ALL_KINDS for p in "BI"]
#: Characters of a window and of its overlap with the next one; of a window in training.
WINDOW, OVERLAP, TRAINED = 512, 32, 96
#: Windows are read in multiples of so many.
ROWS = 64
#: The weight of the single places in the loss.
ALONE = 0.5
#: Where every other tag, with the best transition into it, is so much worse (in log units) than staying outside, no
#: Viterbi path is looked for: a span that pays has no such place.
CERTAIN = 2.0
#: What a span must hold by the type rules (`plausible`): a digit, an at sign or an at in brackets, or an at and a dot spelled out.
_SEED = re.compile(r"[0-9@]|[(\[]at[)\]]", re.IGNORECASE)
_AT_WORD, _DOT_WORD = re.compile(r"\b(?:at|arobase|arroba|ät)\b", re.IGNORECASE), re.compile(r"\b(?:dot|punkt|point|punto)\b", re.IGNORECASE)
_ALLOWED = np.array([[b[0] != "I" or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])
_STARTS = np.array([t[0] != "I" for t in TAGS])


def codes(text: str) -> np.ndarray:
    """Characters as 1..101: ASCII, other letters (100), other characters (101); 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.where((points >= 32) & (points < 127), points - 31, 97).astype(np.int64)
    out[points >= 128] = 100
    out[(points >= 0x2000) & (points < 0x2C00)] = 101
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Embedding E, one LSTM each way (W, U, b with gates i, f, o, g), an output layer and CRF transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(embed: int = 16, hidden: int = 8, seed: int = 5) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.3, (102, embed)), "V": r.normal(0, 0.2, (2 * hidden, len(TAGS))), "c": np.zeros(len(TAGS)), "T": np.zeros((len(TAGS), len(TAGS)))}
        for d in "fb":
            p |= {f"W{d}": r.normal(0, 0.3, (embed, 4 * hidden)), f"U{d}": r.normal(0, 0.25, (hidden, 4 * hidden)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: (time, batch, embed); in the order of reading."""
        U, n = self.p[f"U{d}"], len(self.p[f"U{d}"])
        z = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        h = c = np.zeros((x.shape[1], n), dtype=np.float32)
        out = np.empty((len(x), x.shape[1], n), dtype=np.float32)
        for t in range(len(x)):
            a = z[t] + h @ U
            s, g = _sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
            before, c = c, s[:, n : 2 * n] * c + s[:, :n] * g
            u = np.tanh(c)
            previous, h = h, s[:, 2 * n :] * u
            out[t] = h
            if keep is not None:
                keep.append((previous, before, s, g, u))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: codes (batch, time) -> (batch, time, tags)."""
        e = self.p["E"][x].transpose(1, 0, 2)
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._run(e, "f", kf), self._run(e[::-1], "b", kb)[::-1]], axis=2)
        if keep is not None:
            keep |= {"e": e, "h": h, "f": kf, "b": kb}
        return (h @ self.p["V"] + self.p["c"]).transpose(1, 0, 2)

    def _back(self, d: str, e: np.ndarray, dh: np.ndarray, steps: list, grad: dict) -> np.ndarray:
        U, n = self.p[f"U{d}"], len(self.p[f"U{d}"])
        da = np.empty((*dh.shape[:2], 4 * n), dtype=np.float32)
        carry_h = carry_c = np.zeros(dh.shape[1:], dtype=np.float32)
        for t in range(len(dh) - 1, -1, -1):
            previous, before, s, g, u = steps[t]
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            total = dh[t] + carry_h
            dc = carry_c + total * o * (1 - u * u)
            da[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), total * u * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            carry_h, carry_c = da[t] @ U.T, dc * f
            grad[f"U{d}"] += previous.T @ da[t]
        flat = da.reshape(-1, 4 * n)
        grad[f"W{d}"] += e.reshape(-1, e.shape[2]).T @ flat
        grad[f"b{d}"] += flat.sum(0)
        return da @ self.p[f"W{d}"].T

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences under the CRF, and ALONE times that of each tag by its
        emissions; pads are tagged O."""
        keep: dict = {}
        em, T = self.emissions(x, keep).astype(np.float64).transpose(1, 0, 2), self.p["T"].astype(np.float64)
        L, B, K = em.shape
        top = em.max(2, keepdims=True)
        E, M = np.exp(em - top), np.where(_ALLOWED, np.exp(T), 0)
        # forward and backward sums, each step scaled to 1
        alpha, beta, scale = np.empty((L, B, K)), np.ones((L, B, K)), np.empty((L, B, 1))
        for t in range(L):
            alpha[t] = E[t] * (alpha[t - 1] @ M if t else _STARTS)
            scale[t] = alpha[t].sum(1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(L - 2, -1, -1):
            beta[t] = (E[t + 1] * beta[t + 1] / scale[t + 1]) @ M.T
        total = (np.log(scale) + top).sum((0, 2))
        rows, steps = np.arange(B), np.arange(L)[:, None]
        gold = em[steps, rows, y.T].sum(0) + T[y[:, :-1], y[:, 1:]].sum(1)
        # beside the CRF's, the loss of each place by its emissions alone, so that they tell clean places by themselves
        alone = E / E.sum(2, keepdims=True)
        picked = np.log(alone[steps, rows, y.T]).sum(0)
        d = alpha * beta + ALONE * alone
        d[steps, rows, y.T] -= 1 + ALONE
        d = d.transpose(1, 0, 2)
        dT = M * (alpha[:-1].reshape(-1, K).T @ (E[1:] * beta[1:] / scale[1:]).reshape(-1, K))
        np.add.at(dT, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        d = (d / B).astype(np.float32).transpose(1, 0, 2)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        n = len(self.p["Uf"])
        grad["V"] += keep["h"].reshape(-1, 2 * n).T @ d.reshape(-1, K)
        grad["c"] += d.sum((0, 1))
        grad["T"] += np.where(_ALLOWED, dT / B, 0).astype(np.float32)
        dh = d @ self.p["V"].T
        de = self._back("f", keep["e"], dh[:, :, :n], keep["f"], grad) + self._back("b", keep["e"][::-1], dh[::-1, :, n:], keep["b"], grad)[::-1]
        np.add.at(grad["E"], x.T, de)
        return float((total - gold - ALONE * picked).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.015, seed: int = 9) -> Tagger:
        r, first, second, t = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(x), batch):
                _, grad = self.loss_and_gradient(x[order[k : k + batch]], y[order[k : k + batch]])
                size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                t += 1
                for name, g in grad.items():
                    g *= min(1.0, 5.0 / max(size, 1e-9))
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                    step = rate * 0.75**epoch * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
                    self.p[name] -= step.astype(np.float32)
        return self

    def viterbi(self, em: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
        """em: (tags, time, stretches) -> tags (time, stretches); a stretch begins after an O, and ends after its own
        `length` with whatever tag is best there, so its tags do not depend on what else is decoded."""
        T = np.where(_ALLOWED, self.p["T"], -1e4).astype(np.float32)[:, :, None]
        score, back = em[:, 0] + np.where(_STARTS, 0, -1e4).astype(np.float32)[:, None], np.zeros(em.shape, dtype=np.int8)
        same = np.arange(len(TAGS), dtype=np.int8)[:, None]
        for t in range(1, em.shape[1]):
            v = score[:, None] + T
            more = True if length is None else t < length
            back[:, t] = np.where(more, v.argmax(0), same)
            score = np.where(more, v.max(0) + em[:, t], score)
        tags, rows = np.empty(em.shape[1:], dtype=np.int8), np.arange(em.shape[2])
        tags[-1] = score.argmax(0)
        for t in range(em.shape[1] - 1, 0, -1):
            tags[t - 1] = back[tags[t], t, rows]
        return tags

    def reader(self) -> Reader:
        """The same network for reading alone: the input side as a table of characters, all arguments turned to those of exp in
        1 / (1 + exp(-x)), of which a tanh is the double less one, so that a step has one product and two exponentials."""
        n = len(self.p["Uf"])
        turn = np.repeat([-1.0, -1.0, -1.0, -2.0], n).astype(np.float32)
        sides = []
        for k, d in enumerate("fb"):
            table, U = (self.p["E"] @ self.p[f"W{d}"] + self.p[f"b{d}"]) * turn, self.p[f"U{d}"] * turn
            sides.append((np.ascontiguousarray(table.T, dtype=np.float32), np.ascontiguousarray(U.T), self.p["V"][k * n : (k + 1) * n]))
        T = np.where(_ALLOWED, self.p["T"], -1e4)
        return Reader(sides, self.p["c"], (T.max(0) - T[0, 0])[1:], self)


@dataclass
class Reader:
    sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    c: np.ndarray
    enter: np.ndarray
    tagger: Tagger

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: codes (time, batch) -> (tags, time, batch). Gates lie beneath each other, so that each step works on whole
        stretches of memory."""
        n, rows = self.sides[0][1].shape[1], x.shape[1]
        x = x.astype(np.intp)
        out = np.empty((len(x), 2 * n, rows), dtype=np.float32)
        a, given, e = (np.empty((k * n, rows), dtype=np.float32) for k in (4, 4, 1))
        i, f, o, g = (a[q * n : (q + 1) * n] for q in range(4))
        with np.errstate(over="ignore"):  # exp of much is infinite, and its reciprocal 0
            for k, (table, U, _) in enumerate(self.sides):
                h, c = np.zeros((n, rows), dtype=np.float32), np.zeros((n, rows), dtype=np.float32)
                for t in range(len(x))[:: -1 if k else 1]:
                    np.take(table, x[t], axis=1, out=given, mode="clip")
                    np.matmul(U, h, out=a)
                    a += given
                    np.exp(a, out=a)
                    a += 1
                    np.reciprocal(a, out=a)
                    g *= 2
                    g -= 1
                    c *= f
                    i *= g
                    c += i
                    np.multiply(c, -2, out=e)
                    np.exp(e, out=e)
                    e += 1
                    np.divide(2, e, out=e)
                    e -= 1
                    np.multiply(e, o, out=h)
                    out[t, k * n : (k + 1) * n] = h
        V = np.concatenate([side[2] for side in self.sides])
        em = np.matmul(np.ascontiguousarray(V.T), out)
        return em.transpose(1, 0, 2) + self.c[:, None, None]

    def spans(self, texts: list[str], most_windows: int = 512, every_window: bool = True) -> list[tuple[int, str, int, int]]:
        """(text, kind, start, end) of all spans in the whole texts. Without `every_window`, windows are not read that, with both their
        neighbours, hold nothing that a span must hold by the type rules: faster, and near the edges of such windows not the same reading."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        offset, stride = np.cumsum(size) - size, WINDOW - OVERLAP
        every = codes("".join(texts)).astype(np.int32)
        windows = np.maximum(1, -(-(size - OVERLAP) // stride)) * (size > 0)
        of = np.repeat(np.arange(len(texts)), windows)
        begin = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * stride
        if not every_window:
            seeded = np.zeros(len(of), dtype=bool)
            first = np.cumsum(windows) - windows
            for k, t in enumerate(texts):
                at = [m.start() for m in _SEED.finditer(t)]
                ats, dots = ([m.start() for m in w.finditer(t)] for w in (_AT_WORD, _DOT_WORD))
                near = np.searchsorted(dots, np.array(ats, dtype=np.int64))
                at += [x for x, j in zip(ats, near.tolist(), strict=True) if j < len(dots) and dots[j] - x <= 100]  # a span has 100 characters at most
                seeded[first[k] + np.minimum(np.array(at, dtype=np.int64) // stride, windows[k] - 1)] = True
            beside = seeded.copy()
            beside[1:] |= seeded[:-1]
            beside[:-1] |= seeded[1:]
            of, begin = of[beside], begin[beside]
        ramp = ((np.arange(OVERLAP) + 1) / (OVERLAP + 1)).astype(np.float32)[:, None]
        steps = np.arange(WINDOW)[:, None]
        places, found, tail = [], [], np.zeros((len(TAGS), OVERLAP, 1), dtype=np.float32)
        for at in range(0, len(of), most_windows):
            k, a = of[at : at + most_windows], begin[at : at + most_windows]
            inside, where = a + steps < size[k], offset[k] + a + steps
            x = np.where(inside, every[np.minimum(where, len(every) - 1)], 0)
            # products of one shape, whatever the batch: their last bits are the same then
            em = self.emissions(np.pad(x, ((0, 0), (0, -len(k) % ROWS))))[:, :, : len(k)]
            before, tail = np.concatenate([tail, em[:, stride:, :-1]], axis=2), em[:, stride:, -1:].copy()
            follows = np.concatenate([[at > 0 and of[at - 1] == k[0] and begin[at - 1] + stride == a[0]], (np.diff(k) == 0) & (np.diff(a) == stride)])
            later = np.flatnonzero(follows)
            em[:, :OVERLAP, later] = ramp * em[:, :OVERLAP, later] + (1 - ramp) * before[:, :, later]
            last = ~np.concatenate([(np.diff(k) == 0) & (np.diff(a) == stride), [at + len(k) < len(of) and of[min(at + len(k), len(of) - 1)] == k[-1] and begin[min(at + len(k), len(of) - 1)] == a[-1] + stride]])  # no window follows
            t, row = np.nonzero(((em[1:] + self.enter[:, None, None].astype(np.float32)).max(0) > em[0] - CERTAIN) & inside & (last | (steps < stride)))
            places.append(where[t, row])
            found.append(em[:, t, row].T)
        if not places:
            return []
        place, em = np.concatenate(places), np.concatenate(found)
        order = np.argsort(place)
        place, em = place[order], em[order]
        text = np.searchsorted(np.cumsum(size), place, "right")
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(text) != 0)])) if len(place) else np.zeros(0, np.int64)
        length = np.diff(np.append(new, len(place)))
        out, order = [], np.argsort(length, kind="stable")
        # stretches of about one length go together: the length doubles at most, and no more than 65,536 places
        groups, first = [], 0
        for q in range(1, len(order) + 1):
            if q == len(order) or length[order[q]] > 2 * length[order[first]] or (q - first) * length[order[q]] > 1 << 16:
                groups.append(order[first:q])
                first = q
        for part in groups if len(order) else []:
            padded = np.zeros((len(TAGS), int(length[part].max()), len(part)), dtype=np.float32)
            for r, q in enumerate(part.tolist()):
                padded[:, : length[q], r] = em[new[q] : new[q] + length[q]].T
            for q, tags in zip(part.tolist(), self.tagger.viterbi(padded, length[part]).T, strict=True):
                for t in np.flatnonzero((tags > 0) & (tags % 2 == 1)).tolist():  # odd tags begin a span
                    end = t + 1
                    while end < length[q] and tags[end] == tags[t] + 1:
                        end += 1
                    k, a = int(text[new[q]]), int(place[new[q]] + t - offset[text[new[q]]])
                    out.append((k, TAGS[tags[t]][2:], a, a + end - t))
        return sorted(out)


def tag_windows(text: str, spans: list[tuple[str, int, int]], window: int = TRAINED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Training windows of a text: codes and gold tags."""
    tags, c = np.zeros(len(text), dtype=np.int64), codes(text)
    for kind, a, b in spans:
        tags[a:b] = TAGS.index(f"I-{kind}")
        tags[a] = TAGS.index(f"B-{kind}")
    xs, ys = [], []
    for s in range(0, max(1, len(text) - window // 2), window // 2):
        x, y = np.zeros(window, dtype=np.int64), np.zeros(window, dtype=np.int64)
        n = min(window, len(text) - s)
        x[:n], y[:n] = c[s : s + n], tags[s : s + n]
        if y[0] and TAGS[y[0]][0] == "I":  # a window may begin inside a span
            y[0] -= 1
        xs.append(x)
        ys.append(y)
    return xs, ys


class Forms:
    """Written forms of personal data and secrets, most of which the patterns do not know, and of numbers that are neither."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def num(self, k: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, k)))

    def word(self) -> str:
        return "".join(self.pick(["an", "the", "ver", "ou", "ti", "ea", "st", "ing", "en", "que", "ch", "os", "ra", "li", "mo", "é", "ü", "ñ"]) for _ in range(self.r.integers(1, 5)))

    def pick(self, options: list) -> str:
        return options[int(self.r.integers(len(options)))]

    def host(self, dot: str = ".") -> str:
        name = "".join(c for c in self.word() if c < "\x7f") or "mail"
        return dot.join([name + self.pick(["", self.num(1)]), *self.pick([[], ["example"], ["uni"]]), self.pick(["com", "net", "org", "de", "fr", "es"])])

    def email(self) -> str:
        name = "".join(c for c in self.word() if c < "\x7f") or "me"
        name += self.pick(["", f".{self.num(2)}", f"_{self.num(1)}", self.num(2)])
        kind = self.r.integers(8)
        if kind < 2:
            return f"{name}@{self.host()}"
        if kind < 4:
            return name + self.pick([" (at) ", "[at]", " [at] ", "(at)"]) + self.host(self.pick([".", ".", "[.]", " (dot) "]))
        at, dot = self.pick([("at", "dot"), ("arobase", "point"), ("ät", "punkt"), ("arroba", "punto")])
        if kind < 7:
            return f"{name} {at} {self.host(f' {dot} ')}"
        return f"{name} @ {self.host(' . ')}"

    def ip(self) -> str:
        four = [str(self.r.integers(0, 256)) for _ in range(4)]
        if self.r.integers(6) == 0:
            return ":".join(f"{self.r.integers(1, 65536):x}" for _ in range(8))
        return self.pick([".", ".", "[.]", " . ", "(.)"]).join(four)

    def card(self) -> str:
        amex = self.r.integers(4) == 0
        d = self.num(14 if amex else 15)
        d += next(c for c in "0123456789" if luhn(d + c))
        cuts = [0, 4, 10, 15] if amex else [0, 4, 8, 12, 16]
        return self.pick(["", " ", "-", ".", " - ", "/"]).join(d[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def phone(self) -> str:
        n = self.num
        return self.pick([
            f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}",
            f"0{n(2)}/{n(7)}", f"(0{n(3)}) {n(6)}", f"6{n(2)} {n(2)} {n(2)} {n(2)}", f"00{n(2)} {n(3)} {n(3)} {n(3)}", f"+{n(2)} {n(3)} {n(3)} {n(3)}", f"0{n(3)} {n(4)} {n(3)}",
        ])

    def secret(self) -> str:
        letters = list(self.pick(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]))
        body = "".join(self.r.choice(letters, int(self.pick([20, 24, 32, 40, 40, 64]))))
        return body

    NAMES = ["token", "TOKEN", "api_key", "apikey", "secret", "SECRET_KEY", "password", "passwd", "Authorization", "access_token", "pwd", "clave", "mot de passe", "Passwort"]

    def clean(self) -> str:
        n = self.num
        return self.pick([
            n(int(self.r.integers(1, 17))), f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(1)}.{n(1)}.{n(2)}", f"version {n(1)}.{n(1)}", f"{n(2)},{n(3)}.{n(2)}", f"{n(2)}:{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", self.word() + n(3),
            f"@{self.word()}", f"{n(1)} {n(2)} {n(1)}", f"{self.word()} at {self.word()}", f"{self.word()} dot {self.word()}", f"{self.word()} point {self.word()}", f"{self.word()}.{self.word()}", f"({n(4)})", f"${n(3)}.{n(2)}", f"{n(3)}-{n(4)}", f"{n(1)}/{n(1)}", f"§ {n(3)}", f"{n(2)} %",
            f"http://{self.host()}/{self.word()}", f"www.{self.host()}", " ".join([self.word()] * 6), " ".join([self.pick(["at", "to", "de", "dot", "a"])] * int(self.r.integers(2, 12))),
        ])

    def planted(self, context: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with one or two forms between its words, and their spans (those of no kind have none)."""
        words, spans = context.split(" "), []
        for _ in range(int(self.r.integers(1, 3))):
            kind = self.pick([*ALL_KINDS, "email", "phone", "", "", ""])
            form = self.clean() if not kind else getattr(self, kind)()
            before = after = ""
            if kind == "secret":
                before = self.pick(self.NAMES) + self.pick([" = ", "=", ": ", " : ", " "])
                before, after = self.pick([(before + '"', '"'), (before + "'", "'"), (before, "")])
            spans.append((kind, form))
            after += self.pick(["", "", "", ",", ".", "!!", "***", ";"])
            words.insert(int(self.r.integers(len(words) + 1)), (before, form, after, kind))
        text, out = "", []
        for w in words:
            text += " " if text else ""
            if isinstance(w, str):
                text += w
            else:
                before, form, after, kind = w
                if kind:
                    out.append((kind, len(text) + len(before), len(text) + len(before) + len(form)))
                text += before + form + after
        return text, out


#: A token of 16 characters or more with letters and digits: what a secret may be.
_UNLABELLED = r"(?<![A-Za-z0-9+/_=-])(?=[+/_=-]*[0-9+/_=-]*[A-Za-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}"


def fit_tagger(
    docs: DataFrame, most_rows: int = 10_000, most_windows: int = 2_000, n_forms: int = 2_400, epochs: int = 7, doc_id: str = "doc_id", text: str = "text",
) -> Tagger:
    """Trains on two cuts of 160 characters (one around a digit or at sign, if there is one; one anywhere) of each of
    (about) the `most_rows` texts of the smallest id hashes: on at most `most_windows` as they are, with the patterns' spans,
    and on `n_forms` with forms planted in them. Cuts with a long token of letters and digits that no pattern labels may hold a secret and
    would teach that it is none: they are left out. Null and empty texts and cuts give none; repeated rows and null ids
    give their own; other columns are not read. Without texts it trains on planted forms alone."""
    rows = docs.select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("text"))
    sample = hash_share(rows, F.col("h"), most_rows).where("length(text) > 0")

    def cut(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            h, cuts = [], []
            for key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                marks = [m.start() for m in re.finditer("[0-9@]", s)] or [0]
                for turn, middle in enumerate((marks[key % len(marks)], key // 7 % len(s))):
                    a = max(0, middle - 80)
                    a = s.find(" ", a) + 1 if a else 0  # not within a word
                    h.append(xxhash.xxh64_intdigest(f"{key} {turn}") - (1 << 63))
                    cuts.append(s[a : a + 160])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(cuts, pa.string())], names=["h", "cut"])

    most = max(most_windows, n_forms)
    found = sample.mapInArrow(cut, "h long, cut string").where(~F.col("cut").rlike(_UNLABELLED))
    cuts = [r["cut"] for r in found.orderBy("h", "cut").limit(most).collect()]  # at most `most` short cuts
    xs, ys, forms = [], [], Forms(3)
    for s in cuts[:most_windows]:
        x, y = tag_windows(s, base_spans(s))
        xs += x
        ys += y
    for k in range(n_forms):
        context = cuts[k % len(cuts)] if cuts else " ".join(forms.word() for _ in range(12))
        s, spans = forms.planted(context)
        known = [b for b in base_spans(s) if all(b[2] <= a or b[1] >= e for _, a, e in spans)]
        x, y = tag_windows(s, spans + known)
        xs += x
        ys += y
    return Tagger.new().fit(np.stack(xs), np.stack(ys), epochs)


_DATE = re.compile(r"(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])")
_DIGITS_OF = {"card": (13, 19), "phone": (7, 15)}


def plausible(kind: str, text: str, start: int, end: int) -> bool:
    """What any span of its kind must have: whole words, an at and a dot of whatever spelling, a card's check digit, the kinds' numbers of digits;
    a calendar date is no phone number."""
    s, d = text[start:end], _digits(text[start:end])
    if start and text[start - 1].isalnum() and s[0].isalnum() or end < len(text) and text[end].isalnum() and s[-1].isalnum():
        return False
    if kind in _DIGITS_OF and not _DIGITS_OF[kind][0] <= len(d) <= _DIGITS_OF[kind][1]:
        return False
    if kind == "email":
        if len(s) > 100 or start and text[start - 1] == "@":
            return False
        return bool(re.search(r"@|[(\[]at[)\]]", s, re.IGNORECASE) and ("." in s or _DOT_WORD.search(s)) or _AT_WORD.search(s) and _DOT_WORD.search(s))
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return ":" in s and bool(d) or len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "secret":
        return len(s) >= 12 and " " not in s and bool(d) and any(c.isalpha() for c in s)
    if kind == "phone" and _DATE.fullmatch(s):
        return False
    return kind != "card" or luhn(d)


def all_spans(texts: list[str | None], reader: Reader, every_window: bool = True) -> list[list[tuple[str, int, int, str]]]:
    """(kind, start, end, by) for each text, by `base` or `tagger`, in the order of ALL_KINDS, then by start.
    The patterns' spans all stay; the network adds spans that overlap none of them."""
    out = [[(*s, "base") for s in base_spans(text)] for text in texts]
    for k, kind, s, e in reader.spans([t or "" for t in texts], every_window=every_window):
        text = texts[k]
        while e > s and text[e - 1] in " .,;:-!*\"'":
            e -= 1
        while e > s and text[s] in " .,;:-!*\"'":
            s += 1
        if e > s and all(e <= x[1] or s >= x[2] for x in out[k]) and plausible(kind, text, s, e):
            out[k].append((kind, s, e, "tagger"))
    return [sorted(s, key=lambda x: (ALL_KINDS.index(x[0]), x[1])) for s in out]


SPANS = "array<struct<kind:string,start:long,end:long,by:string>>"


#: Bytes of texts that are read at a time.
READ_BYTES = 2 << 20


def find_spans(docs: DataFrame, tagger: Tagger, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id and spans of every whole text: code points, end exclusive. Null and empty texts have none;
    null ids and repeated rows are rows like any; other columns are not read; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.reader())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by", pa.string())]))

    def find(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(tables, READ_BYTES):
            spans = all_spans(b.column(1).to_pylist(), shared.value)
            rows = [[dict(zip(("kind", "start", "end", "by"), s, strict=True)) for s in one] for one in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(find, f"doc_id long, spans {SPANS}")


def masked(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """Each span as <KIND>; where spans overlap, the one that begins first (ties: the longer) is named."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows of docs with all spans of the text masked, and their new length in code points in `length`,
    if there is such a column. All other columns stay as they are; null texts stay null; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.reader())
    at = docs.columns.index(text)

    def mask(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(tables, READ_BYTES):
            texts = b.column(at).to_pylist()
            new = [t and masked(t, s) for t, s in zip(texts, all_spans(texts, shared.value), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(k).type) if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn(length, F.length(text).cast("long")) if length in docs.columns else out
