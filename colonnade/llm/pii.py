"""Personal data: fixed base patterns, and a character-level BiLSTM-CRF that adds to them.

The base kinds (email, ip, card, phone) are found by pattern over the whole text.  The
model, a bidirectional LSTM over characters with CRF transitions between tags, is trained
in numpy on the driver from labelled spans: base spans in their contexts from a bounded
sample of documents, generated spans set into sampled contexts (written-out addresses,
numbers without prefix, credentials), and prose and numbers that are no personal data.
Texts are cut whole in overlapping windows, every window is scored, and the windows' tags
are reconciled over the whole text: of two windows the one whose middle is nearer decides a
character.  A window's best path is found by Viterbi, unless its scores prove that the best
path is outside everywhere: no tag gains enough over 'outside', whatever the transitions.

Scale: a map over all documents without any exchange; only snippets of at most ``sample``
documents, ``spans`` of each, reach the driver.  A worker holds BLOCK windows at a time.

Defined results: null text counts as empty; an empty text has no span and the digest of
the empty string; repeated rows are treated one by one; a null doc_id stays null; extra
columns are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, tune

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of a training window; of a decoded one, and from one of these to the next.
TRAINED, WINDOW, STRIDE = 96, 256, 192
#: Windows decoded together.
BLOCK = 512
#: Steps whose scores are held together.
SOME = 8

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            floor = m.end()
            at = text.find("@", m.end())
        else:
            floor = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, sorted by start, then kind."""
    out = _emails(text) if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return out
    for m in _IP.finditer(text):
        if all(len(n) <= 3 and int(n or 0) <= 255 for n in (p.lstrip("0") for p in m.groups())):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _alphabet() -> np.ndarray:
    """Codes of the characters below 0x2000, and of all others in the last place."""
    out = np.full(0x2001, 98, np.uint8)
    out[32:127] = np.arange(1, 96)
    out[[9, 10, 13]] = 96
    out[0xC0:0x2000] = 97
    return out


_CODES = _alphabet()


def codes(text: str) -> np.ndarray:
    """A small alphabet: ASCII by itself, then line ends, other letters, anything else."""
    if text.isascii():
        return _CODES[np.frombuffer(text.encode(), np.uint8)]
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODES[np.minimum(raw, 0x2000)]


ALPHABET = 99  # 0 pads
TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Bidirectional LSTM over characters with a linear-chain CRF on top."""

    def __init__(self, hidden: int = 8, embed: int = 8, seed: int = 11):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"E": r.normal(0, 0.3, (ALPHABET, embed)), "O": r.normal(0, 0.2, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "T": r.normal(0, 0.1, (TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, 0.3, (embed, 4 * hidden)), f"U{d}": r.normal(0, 0.2, (hidden, 4 * hidden)), f"B{d}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (steps, n, h) of one direction; ``x``: (steps, n) codes, in that direction's order."""
        p, h = self.p, self.h
        table = p["E"] @ p[f"W{d}"] + p[f"B{d}"]
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        out, trace = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)):
            z = table[x[t]] + state @ p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, prior = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            bent = np.tanh(cell)
            state = gates[:, 2 * h :] * bent
            out[t] = state
            if keep:
                trace.append((gates, new, before, prior, bent))
        return out, trace

    def _back(self, x, d, trace, grad, g):
        p, h = self.p, self.h
        dstate, dcell = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dtable = np.zeros((ALPHABET, 4 * h), np.float32)
        for t in range(len(x) - 1, -1, -1):
            gates, new, before, prior, bent = trace[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dstate = dstate + grad[t]
            dcell = dcell + dstate * o * (1 - bent * bent)
            dz = np.concatenate([dcell * new * i * (1 - i), dcell * before * f * (1 - f), dstate * bent * o * (1 - o), dcell * i * (1 - new * new)], axis=1)
            np.add.at(dtable, x[t], dz)
            g[f"U{d}"] += prior.T @ dz
            dstate, dcell = dz @ p[f"U{d}"].T, dcell * f
        g[f"B{d}"] += dtable.sum(axis=0)
        g[f"W{d}"] += p["E"].T @ dtable
        g["E"] += dtable @ p[f"W{d}"].T

    def scores(self, x: np.ndarray, keep: bool = False):
        """(n, steps) codes -> emission scores (steps, n, tags)."""
        fwd, tf = self._run(x.T, "f", keep)
        bwd, tb = self._run(x.T[::-1], "b", keep)
        both = np.concatenate([fwd, bwd[::-1]], axis=2)
        return both @ self.p["O"] + self.p["c"], both, tf, tb

    def _states(self, x: np.ndarray) -> np.ndarray:
        """(n, steps) codes -> rows (steps + 2, ., n) that hold the states of both directions.

        Both directions go side by side.  Row t + 1 is what step t reads: the backward state
        after it, embedding, a one, the forward state before it; each direction's part is one
        product away from its gates.  Gates are 1 / (1 + exp(-z)), and tanh(z) = 2 / (1 + exp(-2z)) - 1,
        as numpy's exp is fast on CPUs where its tanh isn't.  States and cells are held halved.
        """
        p, h, w = self.p, self.h, self.p["E"].shape[1]
        (n, steps), one = x.shape, h + w
        scale = np.repeat(np.array([-1, -1, -1, -2], np.float32), h)[:, None]
        parts = {d: (2 * p[f"U{d}"].T, p[f"W{d}"].T, p[f"B{d}"][:, None]) for d in "fb"}
        fwd = (np.hstack([parts["f"][k] for k in (1, 2, 0)]) * scale).astype(np.float32)
        bwd = (np.hstack(parts["b"]) * scale).astype(np.float32)
        held = np.empty((steps + 2, one + 1 + h, n), np.float32)
        held[1, one + 1 :], held[steps, :h], held[:, one] = 0, 0, 1
        embed, at = np.ascontiguousarray(p["E"].T.astype(np.float32)), x.T.astype(np.intp, order="C")
        for t in range(steps):
            np.take(embed, at[t], axis=1, out=held[t + 1, h:one], mode="clip")
        z, cell, bent = np.empty((2, 4 * h, n), np.float32), np.zeros((2, h, n), np.float32), np.empty((2, h, n), np.float32)
        into, keep, out, new = z.reshape(2, 4, h, n).swapaxes(0, 1)
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the limit, 0
            for t in range(steps):
                f, b = t + 1, steps - t
                np.dot(fwd, held[f, h:], out=z[0])
                np.dot(bwd, held[b, : one + 1], out=z[1])
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                new -= 0.5
                new *= into
                cell *= keep
                cell += new
                np.multiply(cell, -4, out=bent)
                np.exp(bent, out=bent)
                bent += 1
                np.reciprocal(bent, out=bent)
                bent -= 0.5
                np.multiply(bent[0], out[0], out=held[f + 1, one + 1 :])
                np.multiply(bent[1], out[1], out=held[b - 1, :h])
        return held

    def _emit(self, held: np.ndarray) -> np.ndarray:
        """Emission scores (steps, tags, n) from rows of ``_states``, two more than steps."""
        h, tags = self.h, 2 * self.p["O"].T
        out = np.hstack([self.p["c"][:, None], tags[:, :h]]).astype(np.float32) @ held[2:, -1 - h :]
        out += tags[:, h:].astype(np.float32) @ held[:-2, :h]
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(n, steps) codes -> emission scores (steps, tags, n), as ``scores``."""
        return self._emit(self._states(x))

    def undecided(self, emit: np.ndarray) -> np.ndarray:
        """Windows (of ``emissions``) whose best path might leave the tag 'outside'.

        A stretch of other tags gains at most the sum of its leads over 'outside', a move
        inside for each but one, a move in and a move out.  So the greatest sum of any
        stretch of (lead + move inside) tells whether one could win.
        """
        return self._winnable(self._leads(emit))

    @staticmethod
    def _leads(emit: np.ndarray) -> np.ndarray:
        return emit[:, 1:].max(axis=1) - emit[:, 0]

    def _winnable(self, lead: np.ndarray) -> np.ndarray:
        """``undecided`` from the greatest leads (steps, n) over 'outside'."""
        move, start = self.p["T"] - self.p["T"][0, 0], self.p["s"] - self.p["s"][0]
        inside = float(move[1:, 1:].max())
        around = max(float(move[0, 1:].max()), float(start[1:].max())) + max(float(move[1:, 0].max()), 0.0)
        lead = lead + inside
        run = np.zeros(lead.shape[1], np.float32)
        best = np.full_like(run, -np.inf)
        for now in lead:
            np.maximum(run, 0, out=run)
            run += now
            np.maximum(best, run, out=best)
        return best + around - inside >= -1e-3

    def decode(self, x: np.ndarray, prove: bool = True) -> np.ndarray:
        """Best tags (n, steps) of windows of codes, by Viterbi."""
        emit = self.emissions(x)
        out = np.zeros(x.shape, np.int8)
        some = np.flatnonzero(self.undecided(emit)) if prove else np.arange(len(x))
        if len(some):
            out[some] = self.viterbi(emit[:, :, some])
        return out

    def inside(self, blocks):
        """(owner, best tags) of the windows of ``blocks`` (windows, owners) that hold any tag but 'outside'.

        Undecided windows wait for those of other blocks: Viterbi's steps cost nearly the same
        for one window as for hundreds.  Scores are held for a few steps at a time; those of
        undecided windows are made again.
        """
        held, owners = [], []
        for x, own in itertools.chain(blocks, [(None, [])]):
            if x is not None:
                rows = self._states(x)
                leads = [self._leads(self._emit(rows[t : t + SOME + 2])) for t in range(0, len(rows) - 2, SOME)]
                some = np.flatnonzero(self._winnable(np.concatenate(leads)))
                held.append(self._emit(rows[:, :, some]))
                owners.extend(own[j] for j in some)
            if owners and (x is None or len(owners) >= BLOCK):
                tags = self.viterbi(np.concatenate(held, axis=2))
                yield from ((owners[j], tags[j]) for j in np.flatnonzero(tags.any(axis=1)))
                held, owners = [], []

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        """Best tags (n, steps) of emission scores (steps, tags, n)."""
        steps, k, n = emit.shape
        best, back = emit[0] + self.p["s"][:, None], np.empty((steps, k, n), np.int8)
        move = self.p["T"][:, :, None]
        for t in range(1, steps):
            moves = best[:, None, :] + move
            back[t] = moves.argmax(axis=0)
            best = moves.max(axis=0) + emit[t]
        out = np.empty((steps, n), np.int8)
        out[-1] = best.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, out[t], np.arange(n)]
        return out.T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags and its gradient."""
        p, n = self.p, len(x)
        emit, both, tf, tb = self.scores(x, True)
        steps = len(emit)
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + p["s"]
        for t in range(1, steps):
            alpha[t] = emit[t] + lse(alpha[t - 1][:, :, None] + p["T"][None], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(p["T"][None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        demit = np.exp(alpha + beta - z[None, :, None])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        yt, rows = y.T, np.arange(n)
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + p["T"][None] + (emit[t] + beta[t])[:, None, :] - z[:, None, None])
            g["T"] += pair.sum(axis=0)
            np.add.at(g["T"], (yt[t - 1], yt[t]), -1)
        gold = emit[np.arange(steps)[:, None], rows[None, :], yt].sum(axis=0) + p["s"][yt[0]] + p["T"][yt[:-1], yt[1:]].sum(axis=0)
        np.add.at(demit, (np.arange(steps)[:, None], rows[None, :], yt), -1)
        g["s"] += demit[0].sum(axis=0)
        g["c"] += demit.sum(axis=(0, 1))
        g["O"] += np.tensordot(both, demit, ((0, 1), (0, 1)))
        dboth = demit @ p["O"].T
        self._back(x.T, "f", tf, dboth[:, :, : self.h], g)
        self._back(x.T[::-1], "b", tb, dboth[::-1, :, self.h :], g)
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 32, rate: float = 0.02, seed: int = 2) -> Tagger:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step, total = np.random.default_rng(seed), 0, epochs * -(-len(x) // size)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                step += 1
                some = order[at : at + size]
                _, g = self.gradient(x[some], y[some])
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                pace = rate * (1 - step / (total + 1)) * min(1.0, 5 / (norm + 1e-9))
                for k, a in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    self.p[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


# ---- training windows


def _made(r: np.random.Generator) -> tuple[int, str]:
    """A generated span: (kind, or -1 for what is no personal data; text)."""
    pick = lambda chars, n: "".join(chars[i] for i in r.integers(0, len(chars), n))
    az, d9, hexa, up = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    what = int(r.integers(0, 12))
    name, host = pick(az, int(r.integers(2, 9))), f"{pick(az, int(r.integers(3, 8)))}{pick(d9, int(r.integers(0, 2)))}.{('com', 'org', 'net', 'de', 'fr')[r.integers(0, 5)]}"
    if what == 0:
        return 0, f"{name}.{pick(d9, 2)}@{host}"
    if what == 1:
        a, b = (("[", "]"), ("(", ")"))[r.integers(0, 2)]
        blank = " " * int(r.integers(0, 2))
        return 0, f"{name}{pick(d9, int(r.integers(0, 3)))}{blank or ' '}{a}at{b}{blank or ' '}{host.split('.')[0]} {a}dot{b} {host.split('.')[1]}"
    if what == 2:
        return 1, ".".join(str(int(x)) for x in r.integers(0, 256, 4))
    if what == 3:
        digits = f"4{pick(d9, 14)}"
        digits += next(c for c in d9 if luhn(digits + c))
        return 2, ("", " ", "-")[r.integers(0, 3)].join(digits[i : i + 4] for i in range(0, 16, 4))
    if what == 4:
        return 3, f"+{pick(d9, int(r.integers(1, 3)))} ({pick(d9, 3)}) {pick(d9, 3)}-{pick(d9, 4)}"
    if what == 5:
        return 3, (f"({pick(d9, 3)}) {pick(d9, 3)}-{pick(d9, 4)}", f"{pick(d9, 3)}-{pick(d9, 3)}-{pick(d9, 4)}", f"{pick(d9, 3)}.{pick(d9, 3)}.{pick(d9, 4)}")[r.integers(0, 3)]
    if what == 6:
        chars = (hexa, az, az + up, az + up + d9, az + d9 + "-_!#$%")[r.integers(0, 5)]
        return 4, f"{('password', 'passwd', 'secret', 'api_key')[r.integers(0, 4)]}{('=', ': ', ' = ')[r.integers(0, 3)]}{pick(chars, int(r.integers(12, 33)))}"
    if what == 7:
        return 4, f'{("token", "key", "secret")[r.integers(0, 3)]} = "{pick(hexa, 40)}"'
    if what == 8:
        return 4, f"AKIA{pick(up + d9, 16)}"
    return -1, (pick(d9, int(r.integers(1, 9))), f"{pick(d9, 1)}.{pick(d9, int(r.integers(1, 3)))}", f"version {pick(d9, 1)}.{pick(d9, 1)}", f"{r.integers(1900, 2031)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", f"{r.integers(1, 24)}:{r.integers(10, 60)}", f"${pick(d9, 3)},{pick(d9, 3)}.{pick(d9, 2)}", f"{pick(d9, 2)}%", f"#{pick(d9, int(r.integers(3, 12)))}", f"@{name}")[r.integers(0, 9)]


SNIPPET = 3 * TRAINED


def snippets(text: str, spans: int) -> list[str]:
    """Contexts of at most ``spans`` base spans, spread over the text, and one of any place."""
    base = base_spans(text)
    at = [base[k * len(base) // spans][1] for k in range(spans)] if len(base) > spans else [s for _, s, _ in base]
    at.append(int.from_bytes(hashlib.sha256(text[:SNIPPET].encode("utf-8", "surrogatepass")).digest()[:6], "little") % max(1, len(text)))
    return [text[max(0, a - SNIPPET // 2) : a + SNIPPET // 2] for a in at]


def training_windows(texts: list[str], made: int = 2000, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Windows of codes and tags: found base spans, generated spans, plain numbers and prose."""
    r = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text, spans, at):
        x, y = np.zeros(TRAINED, np.int64), np.zeros(TRAINED, np.int64)
        c, t = codes(text)[at : at + TRAINED], tags_of(len(text), spans)[at : at + TRAINED]
        x[: len(c)], y[: len(t)] = c, t
        xs.append(x)
        ys.append(y)

    for text in texts:
        base = base_spans(text)
        if base and not re.search(r"(?i)password|token|AKIA", text):
            _, start, end = base[len(base) // 2]
            low, high = max(0, end - TRAINED), max(0, start)
            add(text, base, int(r.integers(min(low, high), high + 1)))
        elif not base and not re.search("[0-9]", text):
            for at in range(0, max(1, len(text) - TRAINED), TRAINED):
                add(text, [], at)
    able = [t for t in texts if len(t) > 2 * TRAINED] or ["plain words and nothing else in a text that goes on for a while. " * 4]
    for _ in range(made):
        text = able[r.integers(0, len(able))]
        at = int(r.integers(0, len(text) - TRAINED))
        before, after = re.sub(r"[0-9@+=]", "", text[max(0, at - TRAINED) : at]), re.sub(r"[0-9@+=]", "", text[at : at + TRAINED])
        kind, inner = _made(r)
        before = before if before.endswith((" ", "\n")) or not before else f"{before} "
        tail = (" ", ", ", ". ", "\n")[r.integers(0, 4)] + after.lstrip()
        whole = before + inner + tail
        spans = [(kind, len(before), len(before) + len(inner))] if kind >= 0 else []
        start = int(r.integers(max(0, len(before) + min(len(inner), 80) - TRAINED), len(before) + 1)) if r.random() < 0.8 else int(r.integers(0, max(1, len(whole) - TRAINED)))
        add(whole, spans, start)
    return np.array(xs), np.array(ys)


# ---- whole texts


def windows(text: str) -> np.ndarray:
    """The codes of all windows (number, WINDOW) of a text; the last is padded."""
    code = codes(text)
    number = max(1, -(-(len(code) - (WINDOW - STRIDE)) // STRIDE))
    full = np.zeros((number - 1) * STRIDE + WINDOW, np.uint8)
    full[: len(code)] = code
    return np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::STRIDE]


def reconciled(length: int, tags: dict[int, np.ndarray]) -> list[Span]:
    """Spans of a text from the tags of its windows by number; windows left out are outside.

    Where two windows overlap, each decides the half that is nearer to its middle.
    """
    out: list[Span] = []
    half, last = (WINDOW - STRIDE) // 2, max(0, -(-(length - (WINDOW - STRIDE)) // STRIDE) - 1)
    for k in sorted(tags):
        low, high = half if k else 0, WINDOW if k == last else STRIDE + half
        own = tags[k][low : min(high, length - k * STRIDE)]
        for i in np.flatnonzero(own):
            kind, at = (int(own[i]) - 1) // 2, k * STRIDE + low + int(i)
            if out and out[-1][2] == at and out[-1][0] == kind and own[i] % 2 == 0:
                out[-1] = (kind, out[-1][1], at + 1)
            else:
                out.append((kind, at, at + 1))
    return out


_DIGITS = re.compile(r"[0-9]")
#: Least characters of an added span, and least digits of those that are numbers, by kind.
_LEAST = {0: (7, 0), 1: (7, 4), 2: (12, 12), 3: (9, 7), 4: (8, 0)}


_INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def added(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """Found spans, trimmed, that are whole enough and touch no base span.

    A span that begins or ends inside a word of letters, digits and '_' takes the whole
    word, up to a base span; of spans found in one word the first decides.
    """
    out, k, done = [], 0, 0
    for kind, start, end in sorted(found, key=lambda s: s[1]):
        piece = text[start:end]
        start, end = start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip(" \n\t.,;")))
        if end <= start or start < done:
            continue
        while k < len(base) and base[k][2] <= start:
            k += 1
        least = max([done, *(e for _, _, e in base[max(0, k - 2) : k])])
        most = min([len(text), *(s for _, s, _ in base[k : k + 8] if s >= end)])
        while start > least and text[start] in _INNER and text[start - 1] in _INNER:
            start -= 1
        while end < most and text[end - 1] in _INNER and text[end] in _INNER:
            end += 1
        done = end
        chars, digits = _LEAST[kind]
        if end - start < chars or len(_DIGITS.findall(text[start:end])) < digits:
            continue
        if kind == 0 and not re.search(r"@|[\[({]\s?at\s?[\])}]", text[start:end], re.I):
            continue
        if any(s < end and e > start for _, s, e in base[max(0, k - 2) : k + 8]):
            continue
        out.append((kind, start, end))
    return out


#: Rows of least hash searched first for the training sample, as a multiple of it.
NEAR = 20


def chosen_ids(texts: DataFrame, sample: int) -> list[int]:
    """Ids of the ``sample`` rows of least hash that hold a digit or '@', and of as many that don't.

    The NEAR * ``sample`` rows of least hash, found without their texts, are searched first;
    every text is searched only where these hold too few of either sort.
    """
    rows = texts.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    near = rows.select("doc_id", "h").orderBy("h", "doc_id").limit(NEAR * sample).select("doc_id").distinct()
    able = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False)).alias("able")
    met = rows.join(F.broadcast(near), "doc_id").select("doc_id", "h", able).groupBy("h", "doc_id").agg(F.count_if("able").alias("able"), F.count_if(~F.col("able")).alias("rest")).collect()
    total = {sort: sum(r[sort] for r in met) for sort in ("able", "rest")}
    if sum(total.values()) >= NEAR * sample and min(total.values()) < sample:
        rows = rows.select("doc_id", "h", able)
        chosen = [rows.where(F.col("able") == x).orderBy("h", "doc_id").limit(sample) for x in (True, False)]
        return [r["doc_id"] for r in chosen[0].union(chosen[1]).select("doc_id").distinct().collect()]
    out = set()
    for sort in total:
        seen = 0
        for r in sorted(met):
            if r[sort] and seen < sample:
                seen += r[sort]
                out.add(r["doc_id"])
    return list(out)


def fit_tagger(docs: DataFrame, sample: int = 300, spans: int = 4) -> Tagger:
    """Trained on snippets of at most ``sample`` documents that hold a digit or '@', and as many others.

    They are those of least hash; of each ``spans`` base spans and one other place are taken.
    """
    tune(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            found = [snippets(t, spans) for t in texts_of(batch)]
            ids = [k for k, f in zip(batch.column("doc_id").to_pylist(), found, strict=True) for _ in f]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for f in found for x in f], pa.string())], names=["doc_id", "snippet"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texts.where(F.col("doc_id").isin(chosen_ids(texts, sample))).mapInArrow(cut, "doc_id long, snippet string")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "snippet").limit(2 * sample * (spans + 1)).collect()
    x, y = training_windows([r["snippet"] for r in got])
    return Tagger().fit(x, y)


def _said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _blocks(texts: list[str]):
    """The windows of all texts, at most BLOCK at a time, with (text, window) of each."""
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        own = windows(text)
        for at in range(0, len(own), BLOCK):
            part = own[at : at + BLOCK]
            if size + len(part) > BLOCK:
                yield np.concatenate(held), owner
                held, owner, size = [], [], 0
            held.append(part)
            owner.extend((i, at + k) for k in range(len(part)))
            size += len(part)
    if held:
        yield np.concatenate(held), owner


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each document.

    The counts and the digest are of base spans; ``spans`` holds base and added ones.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((tagger or fit_tagger(docs)).p)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches):
        tagger = Tagger()
        tagger.p = model.value
        for batch in batches:
            texts = texts_of(batch)
            tags: list[dict[int, np.ndarray]] = [{} for _ in texts]
            for (i, k), found in tagger.inside(_blocks(texts)):
                tags[i][k] = found
            out = []
            for doc_id, text, t in zip(batch.column("doc_id").to_pylist(), texts, tags, strict=True):
                base = base_spans(text)
                more = added(text, base, reconciled(len(text), t)) if t else []
                count = [sum(k == j for k, _, _ in base) for j in range(4)]
                digest = hashlib.sha256(_said(base).encode()).hexdigest()
                out.append((doc_id, *count, digest, _said(sorted(base + more, key=lambda s: (s[1], s[0]))), len(more)))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
