"""Personal data: patterns for the base spans, and a character BiLSTM with CRF transitions, trained in numpy, for more.

The tagger learns from labelled spans of two sources: what the patterns find in a bounded sample of windows (SAMPLE
windows at most, of about POOL documents chosen by a hash of their text), and MADE windows of that sample's own text in
which such data stands in spellings that the patterns miss: values which the patterns found, or invented ones with words
of the corpus as names, amid dates, versions, licences, hexadecimal runs and the like, which are none. It reads windows of
WIDTH characters, STEP apart, over the stretches of a text that hold a digit, an at sign, a plus or the word "at", with
CONTEXT characters around; no span without one of these is plausible. Each window is decoded by Viterbi; every character
then takes its tag from the window in which it stands nearest to the middle, over the whole text. Spans read off that one
tagging grow to whole words and must be plausible for their kind (an address has an at and a dot, a card's digits pass the
Luhn check, no number is the middle of a longer word). Spans that overlap a base span give way.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, pick

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
WIDTH, STEP, CONTEXT = 64, 32, 24
HIDDEN, EMBEDDED, ROUNDS, BATCH, RATE, POOL, SAMPLE, MADE = 16, 8, 400, 64, 0.02, 32_000, 3000, 3500
TRIGGER = re.compile(r"[0-9@+]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")
#: Character classes: 0 stands for what lies outside the text.
CLASSES = ["", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"abcdefghijklmnopqrstuvwxyz", *"@.+-() %_,:/=\"'#$&*!\n[]"]
OTHER = len(CLASSES)
_CLASS = np.full(256, OTHER, np.int64)
for _k, _chars in enumerate(CLASSES):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
TAGS = 1 + 2 * len(KINDS)  # none; then begin and inside of each kind
_OPEN = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])


def _luhn(digits: str) -> bool:
    ds = [int(d) for d in reversed(digits)]
    return sum(ds[::2]) % 10 == sum(2 * d - 9 * (d > 4) for d in ds[1::2]) * -1 % 10


def _accepted(kind: int, match: str) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split("."))
    digits = re.sub("[^0-9]", "", match)
    return 16 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


_DIGITS = frozenset("0123456789")
#: For scans in linear time: an address is sought from its at sign, a dotted number from the start of its digits alone.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the first pattern. At signs stand in neither part of an address, so each has a run of its own before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start. A match that fails its check is dropped, without another try.

    Time is linear in the text's length, whatever it holds.
    """
    out = [(0, a, b) for a, b in _addresses(text)]
    for kind, pattern in ((1, _DOTTED), (2, PATTERNS[2]), (3, PATTERNS[3])):
        if kind != 3 or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _accepted(kind, m[0])]
    return out


def _written_apart(draw: np.random.Generator, kind: int, value: str) -> str:
    """A value of a kind, as the patterns would match it, in another spelling that they miss."""
    pick = lambda *xs: xs[draw.integers(len(xs))]
    if kind == 0:
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", "."), (" AT ", " DOT "), (" at ", "."), ("{at}", "{dot}"), (" @ ", " . "))
        name, _, host = value.partition("@")
        return name + at + host.replace(".", dot)
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return pick(" . ", "[.]", "(.)", " dot ", "[dot]", " .").join(value.split("."))
    if kind == 2:
        return pick(".", "/", "_", " - ", "  ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    mark, far, near = pick("-", ".", " ", "/"), digits[:-7], digits[-7:]
    return pick(f"({far}) {near[:3]}-{near[3:]}", f"{far}{mark}{near[:3]}{mark}{near[3:]}", f"00{far} {near}", f"0{far}{mark}{near}", f"0{far}/{near}", f"({far}) {near[:3]} {near[3:]}")


def _value(draw: np.random.Generator, kind: int, words: list[str]) -> str:
    """An invented value of a kind; names are words of the corpus."""
    pick = lambda *xs: xs[draw.integers(len(xs))]
    word = lambda: words[draw.integers(len(words))]
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    if kind == 0:
        return f"{word()}{pick('', '.', '_', '-')}{word()}{pick('', '', digits(2))}@{word()}{pick('', '-' + word())}.{pick('com', 'org', 'net', 'de', 'info', 'co.uk', 'edu', 'fr')}".lower()
    if kind == 1:
        return ".".join(str(x) for x in draw.integers(0, 256, 4))
    if kind == 2:
        stem = digits(15)
        return next(stem + c for c in "0123456789" if _luhn(stem + c))
    return f"+{digits(int(draw.integers(9, 13)))}"


_HEX = "0123456789abcdef"
_WORDLIKE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"


def _other(draw: np.random.Generator, words: list[str]) -> str:
    """Something with digits, dots or the word "at" that is no personal data."""
    pick = lambda *xs: xs[draw.integers(len(xs))]
    word = lambda: words[draw.integers(len(words))]
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    code = lambda alphabet, n: "".join(alphabet[c] for c in draw.integers(0, len(alphabet), n))
    year, n = str(draw.integers(1950, 2040)), int(draw.integers(1, 8))
    forms = (
        lambda: f"{year}-0{draw.integers(1, 10)}-{digits(2)}",
        lambda: f"{digits(1)}/{digits(2)}/{year}",
        lambda: pick(year, f"{year}-{year}", f"({pick('c', 'C')}) {year}"),
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"{digits(1)},{digits(3)}.{digits(2)}",
        lambda: digits(n),
        lambda: pick("v", "version ", "") + pick(f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(1)}.{digits(1)}"),
        lambda: pick(f"#{digits(5)}", f"{word()}{digits(3)}", f"{digits(2)}.{digits(1)}%"),
        lambda: pick(f"at {word()}", f"{digits(2)} at {word()} {word()}", f"{word()} at {word()}. {word().title()}"),
        lambda: f"{word()} at {pick('www.', 'http://', 'www.')}{word()}.{pick('com', 'org', 'de')}",
        lambda: f"Licensed under {pick('CC BY-NC', 'CC BY', 'CC BY-SA', 'GPL', 'Apache')} {digits(1)}.0",
        lambda: code(_HEX, int(draw.integers(16, 50))),
        lambda: code(_WORDLIKE[:36], int(draw.integers(12, 30))),
        lambda: code(_WORDLIKE, int(draw.integers(12, 40))),
        lambda: "-".join(code(_HEX, k) for k in (8, 4, 4, 4, 12)),
        lambda: pick("key=", "id: ", "sha ") + code(_HEX, 24),
        lambda: ", ".join(digits(2) for _ in range(n)),
        lambda: pick(f"@{word()}", f"{word()}@", f"{digits(1)} + {digits(1)} = {digits(2)}"),
    )
    return forms[draw.integers(len(forms))]()


def made_windows(sample: list[tuple[str, bytes]], n: int = MADE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the sample's own text, with values that the patterns find there, or invented ones, spelled otherwise, and with things that are none."""
    draw = np.random.default_rng(seed)
    carriers = [w for w, t in sample if not any(t)] or ["and then we read the page again before it was late"]
    words = sorted({w for c in carriers for w in re.findall("(?<![A-Za-z])[a-z]{3,10}(?![A-Za-z])", c)}) or ["page", "note", "reader"]
    values: list[list[str]] = [[] for _ in KINDS]
    for text, tags in sample:
        for kind, a, b in reconcile(len(text), [0], np.frombuffer(tags, np.uint8)[None].astype(np.int64)):
            # whole values only: a window may cut one
            if tags[a] % 2 and b < WIDTH and PATTERNS[kind].fullmatch(text[a:b]) and _accepted(kind, text[a:b]):
                values[kind].append(text[a:b])
    chars, tags = [], []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WIDTH + 20:
            carrier = carriers[draw.integers(len(carriers))]
            start = int(draw.integers(0, max(1, len(carrier) - 8)))
            text += carrier[start : start + int(draw.integers(4, 40))].rstrip() + " "
            kind = int(draw.integers(-4, len(KINDS)))
            own = values[kind] if kind >= 0 else []
            if kind < 0:
                value = _other(draw, words)
            else:
                value = own[draw.integers(len(own))] if own and draw.random() < 0.5 else _value(draw, kind, words)
                value = _written_apart(draw, kind, value)
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + " ,.;"[draw.integers(0, 4)] + " "
        start = int(draw.integers(0, len(text) - WIDTH + 1))
        chars.append(classes_of(text, [start])[0])
        tags.append(tags_of(len(text), spans)[start : start + WIDTH])
    return np.array(chars, np.int64), np.array(tags, np.int64)


def windows(text: str) -> list[int]:
    """Where windows begin: over each stretch around triggers, STEP apart."""
    out: list[int] = []
    for m in TRIGGER.finditer(text):
        at = m.start()
        if not out or at + CONTEXT > out[-1] + WIDTH:
            first = max(0, at - CONTEXT)
            if out and first < out[-1] + WIDTH:
                while at + CONTEXT > out[-1] + WIDTH:
                    out.append(out[-1] + STEP)
            else:
                out.append(first)
    return out


def classes_of(text: str, starts: list[int]) -> np.ndarray:
    """The character classes in each window, 0 past the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.where(codes < 256, _CLASS[np.minimum(codes, 255)], OTHER)
    at = np.array(starts)[:, None] + np.arange(WIDTH)
    return np.where(at < len(known), known[np.minimum(at, len(known) - 1)], 0).astype(np.uint8)


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """One tag for each of n characters; of overlapping spans, the earlier listed wins."""
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            out[a:b] = 2 * kind + 2
            out[a] = 2 * kind + 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    draw, h, d = np.random.default_rng(seed), HIDDEN, EMBEDDED
    model = {"e": draw.normal(0, 0.3, (OTHER + 1, d)), "o": draw.normal(0, 0.2, (2 * h, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
    model["w"] = draw.normal(0, 0.25, (2, d + h, 4 * h))
    model["b"] = np.tile(np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]), (2, 1))
    return model


def _both_ways(x: np.ndarray) -> np.ndarray:
    """(steps, rows, k) -> (steps, 2, rows, k): as it stands, and from its end."""
    return np.stack([x, x[::-1]], 1)


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (steps, 2, rows, HIDDEN) of inputs (steps, 2, rows, EMBEDDED), one direction of each two."""
    h = c = np.zeros((*x.shape[1:3], HIDDEN), x.dtype)
    out = np.empty((*x.shape[:3], HIDDEN), x.dtype)
    wx, wh = np.ascontiguousarray(w[:, :EMBEDDED]), np.ascontiguousarray(w[:, EMBEDDED:])
    for t in range(len(x)):
        z = x[t] @ wx + h @ wh + b[:, None]
        gates = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        g = np.tanh(z[..., 3 * HIDDEN :])
        before, c = c, f * c + i * g
        u = np.tanh(c)
        if keep is not None:
            keep.append((i, f, o, g, before, u, h))
        h = o * u
        out[t] = h
    return out


def _lstm_back(x: np.ndarray, w: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of w, b and x. The steps find those of the gates; the sums over all steps are one product each."""
    dz = np.empty((*dout.shape[:3], 4 * HIDDEN), x.dtype)
    dh = dc = np.zeros(dout.shape[1:], x.dtype)
    back = w[:, EMBEDDED:].transpose(0, 2, 1)
    for t in reversed(range(len(x))):
        i, f, o, g, before, u, _ = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - u * u)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * u * o * (1 - o), dc * i * (1 - g * g)], 2)
        dh, dc = dz[t] @ back, dc * f
    last = np.stack([k[6] for k in kept])
    dw = np.concatenate([np.einsum("tdri,tdrj->dij", part, dz, optimize=True) for part in (x, last)], 1)
    return dw, dz.sum((0, 2)), dz @ w[:, :EMBEDDED].transpose(0, 2, 1)


def emissions(model: dict[str, np.ndarray], chars: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Tag scores (steps, rows, TAGS) of windows (rows, steps)."""
    x = _both_ways(model["e"][chars.T])
    steps: list | None = [] if kept is not None else None
    two = _lstm(x, model["w"], model["b"], steps)
    hidden = np.concatenate([two[:, 0], two[::-1, 1]], 2)
    if kept is not None:
        kept.update(x=x, steps=steps, h=hidden)
    return hidden @ model["o"] + model["ob"]


def _loss_and_slopes(model: dict[str, np.ndarray], chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The CRF's mean negative log-likelihood of the tags, and its gradient, by forward and backward sums, scaled at each step."""
    kept: dict = {}
    e = emissions(model, chars, kept)
    steps, rows, _ = e.shape
    trans, y = np.where(_OPEN, model["t"], -1e4), tags.T
    top = e.max(2, keepdims=True)
    seen, step = np.exp(e - top), np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, rows, 1), e.dtype)
    for t in range(steps):
        alpha[t] = seen[t] * (alpha[t - 1] @ step if t else np.exp(model["s"]))
        scale[t] = alpha[t].sum(1, keepdims=True)
        alpha[t] /= scale[t]
    for t in reversed(range(steps - 1)):
        beta[t] = (seen[t + 1] * beta[t + 1]) @ step.T / scale[t + 1]
    total = (np.log(scale) + top).sum((0, 2))
    at, every = np.arange(steps)[:, None], np.arange(rows)[None, :]
    gold = e[at, every, y].sum(0) + model["s"][y[0]] + trans[y[:-1], y[1:]].sum(0)
    de = alpha * beta
    ds = de[0].sum(0)
    dt = step * np.einsum("tri,trj->ij", alpha[:-1], seen[1:] * beta[1:] / scale[1:], optimize=True)
    de[at, every, y] -= 1
    np.subtract.at(ds, y[0], 1)
    np.subtract.at(dt, (y[:-1], y[1:]), 1)
    de, out = de / rows, {"s": ds / rows, "t": np.where(_OPEN, dt / rows, 0)}
    out["o"], out["ob"] = np.einsum("trh,trk->hk", kept["h"], de, optimize=True), de.sum((0, 1))
    dh = de @ model["o"].T
    dh = np.stack([dh[..., :HIDDEN], dh[::-1, :, HIDDEN:]], 1)
    out["w"], out["b"], dx = _lstm_back(kept["x"], model["w"], kept["steps"], dh)
    dx = (dx[:, 0] + dx[::-1, 1]).reshape(-1, EMBEDDED)
    out["e"] = np.eye(OTHER + 1, dtype=dx.dtype)[chars.T.ravel()].T @ dx
    return float((total - gold).mean()), out


def train(chars: np.ndarray, tags: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over batches, in single precision; without any window, a model that tags nothing."""
    model = {k: v.astype(np.float32) for k, v in new_model(seed).items()}
    if not len(chars):
        model["ob"][0] = 50.0
        return model
    draw = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in "12")
    for n in range(1, rounds + 1):
        some = draw.integers(0, len(chars), BATCH)
        _, slopes = _loss_and_slopes(model, chars[some], tags[some])
        norm = np.sqrt(sum((g * g).sum() for g in slopes.values()))
        for k, g in slopes.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = model[k] - RATE * (1 - n / (rounds + 1)) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    return model


def decode(model: dict[str, np.ndarray], chars: np.ndarray) -> np.ndarray:
    """The best tags (rows, steps) of windows (rows, steps)."""
    e = emissions(model, chars)
    trans = np.where(_OPEN, model["t"], -1e4).astype(e.dtype)
    best, came = model["s"] + e[0], np.empty(e.shape, np.int8)
    for t in range(1, len(e)):
        scores = best[:, :, None] + trans
        came[t] = scores.argmax(1)
        best = scores.max(1) + e[t]
    out = np.empty(e.shape[:2], np.int64)
    out[-1] = best.argmax(1)
    for t in range(len(e) - 1, 0, -1):
        out[t - 1] = came[t][np.arange(e.shape[1]), out[t]]
    return out.T


def reconcile(n: int, starts: list[int], tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a text of n characters from its windows' tags: each character follows the window it is most central in."""
    size = min(n, starts[-1] + WIDTH) - starts[0]
    own, depth = np.zeros(size, np.int64), np.full(size, -1)
    inner = np.minimum(np.arange(WIDTH), WIDTH - 1 - np.arange(WIDTH))
    for s, row in zip(starts, tags, strict=True):
        a, m = s - starts[0], min(WIDTH, n - s)
        better = inner[:m] > depth[a : a + m]
        own[a : a + m] = np.where(better, row[:m], own[a : a + m])
        depth[a : a + m] = np.maximum(depth[a : a + m], inner[:m])
    # a span begins at a begin tag, or where an inside tag follows another kind
    kind = (own + 1) // 2
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | (own[1:] % 2 == 1)) + 1
    cuts = [0, *edge.tolist(), size]
    return [(int(kind[a]) - 1, a + starts[0], b + starts[0]) for a, b in zip(cuts, cuts[1:], strict=False) if kind[a] > 0]


_WRITTEN_OUT = re.compile(r"(@|(?<![A-Za-z])at(?![A-Za-z])).*(\.|(?<![A-Za-z])dot(?![A-Za-z]))[^A-Za-z0-9]*[A-Za-z]{2,}$", re.IGNORECASE | re.DOTALL)
LONGEST = 254  # an address has no more characters
_LETTERS = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _plausible(kind: int, value: str) -> bool:
    """What a span of the kind can't do without, however it is spelled."""
    if len(value) > LONGEST or "\n" in value:
        return False
    if kind == 0:
        return bool(_WRITTEN_OUT.search(value))
    groups = re.findall("[0-9]+", value)
    digits = "".join(groups)
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return 13 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 8 <= len(digits) <= 15 and sum(c in _LETTERS for c in value) == len(digits)


def _settled(kind: int, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span grown to whole words (numbers: to whole runs of digits), without white space and stops at its ends; None if it isn't plausible or is the middle of a longer word."""
    grow = _LETTERS if kind == 0 else _DIGITS
    while a > 0 and b - a <= LONGEST and text[a] in grow and text[a - 1] in grow:
        a -= 1
    while b < len(text) and b - a <= LONGEST and text[b - 1] in grow and text[b] in grow:
        b += 1
    while a < b and text[a] in " ,.;:\t":
        a += 1
    while a < b and text[b - 1] in " ,.;:\t":
        b -= 1
    cut = a < b and ((a > 0 and text[a] in _LETTERS and text[a - 1] in _LETTERS) or (b < len(text) and text[b - 1] in _LETTERS and text[b] in _LETTERS))
    if kind and not cut:  # a group of a longer code, joined to letters by a dash
        cut = (a > 1 and text[a - 1] in "-_" and text[a - 2] in _LETTERS) or (b + 1 < len(text) and text[b] in "-_" and text[b + 1] in _LETTERS)
    return (a, b) if not cut and _plausible(kind, text[a:b]) else None


def sampled_windows(docs: DataFrame, text_col: str = "text", most: int = SAMPLE, pool: int = POOL) -> list[tuple[str, bytes]]:
    """(window, tags by the patterns): those with the least hashes, up to half of `most` with spans and half without.

    They come from about `pool` documents, chosen by a hash of their text (all of them, if there are fewer). Each task
    gives no more than it could be asked for, so what is shuffled doesn't grow with the windows of the corpus.
    """
    rows = pick(docs, text=text_col).where("text is not null")
    share = min(1.0, pool / max(1, docs.count()))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).where(F.col("text").rlike("[0-9@+]|[Aa][Tt]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: tuple[dict, dict] = ({}, {})
        for batch in parts_of(batches, 2_000_000):
            for text in batch["text"]:
                tags = tags_of(len(text) + WIDTH, base_spans(text))
                for s in windows(text):
                    own = tags[s : s + WIDTH]
                    window = text[s : s + WIDTH]
                    h = zlib.crc32(window.encode())
                    kept[bool(own.any())].setdefault((h, window), own.astype(np.uint8).tobytes())
                for k in (0, 1):
                    if len(kept[k]) > 4 * most:
                        least = heapq.nsmallest(most // 2, kept[k])
                        some = {x: kept[k][x] for x in least}
                        kept[k].clear()
                        kept[k].update(some)
        out = [(bool(k), *x, kept[k][x]) for k in (0, 1) for x in heapq.nsmallest(most // 2, kept[k])]
        yield pd.DataFrame(out, columns=["full", "h", "window", "tags"])

    found = rows.mapInPandas(run, "full boolean, h long, window string, tags binary")
    found = found.groupBy("full", "h", "window").agg(F.min("tags").alias("tags"))
    place = F.row_number().over(Window.partitionBy("full").orderBy("h", "window"))
    rows = found.withColumn("place", place).where(F.col("place") <= most // 2).orderBy("full", "place").collect()
    return [(r["window"], bytes(r["tags"])) for r in rows]


def labelled_windows(docs: DataFrame, text_col: str = "text", most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The sampled windows' character classes and tags."""
    return _coded(sampled_windows(docs, text_col, most))


def _coded(sample: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    chars = [classes_of(w, [0])[0] for w, _ in sample]
    tags = [np.frombuffer(t, np.uint8) for _, t in sample]
    return np.array(chars, np.int64).reshape(-1, WIDTH), np.array(tags, np.int64).reshape(-1, WIDTH)


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """A model that has learnt from the patterns' spans in docs and from other spellings of such data amid windows of docs."""
    sample = sampled_windows(docs, text_col)
    return train(*[np.concatenate(x) for x in zip(_coded(sample), made_windows(sample), strict=True)])


def find_personal_data(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", everywhere: bool = False) -> DataFrame:
    """(doc_id, kinds, starts, ends, base) for each row: all spans by kind, then start; base marks the patterns' own.

    `everywhere` decodes all of each text, not only the stretches around digits, at signs, pluses and the word "at". No
    span without one of these is plausible, so this changes spans only by other windows around them.

    Defined cases: a null or empty text has none; repeated rows each get a result; of added spans that overlap (ties), the
    tagging has one; a very long text is a part of its own, scanned in linear time; other columns, however named, are not
    read; an empty table gives none.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    small = {k: v.astype(np.float32) for k, v in model.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_of(batches, 2_000_000):
            own = ["" if t is None else t for t in part["text"]]
            starts = [list(range(0, len(t), STEP)) if everywhere else windows(t) for t in own]
            some = [k for k, s in enumerate(starts) if s]
            tags = np.empty((0, WIDTH), np.int64)
            if some:
                chars = np.concatenate([classes_of(own[k], starts[k]) for k in some])
                different, back = np.unique(chars, axis=0, return_inverse=True)
                made = np.concatenate([decode(small, different[a : a + 2048]) for a in range(0, len(different), 2048)])
                tags = made[back.ravel()]
            spans, at = [], 0
            for text, s in zip(own, starts, strict=True):
                base = base_spans(text)
                more = _more(text, s, tags[at : at + len(s)], base) if s else []
                at += len(s)
                spans.append(sorted([(*b, True) for b in base] + [(*m, False) for m in more]))
            yield pd.DataFrame({"doc_id": part["doc_id"], "kinds": [[KINDS[x[0]] for x in xs] for xs in spans], "starts": [[x[1] for x in xs] for xs in spans], "ends": [[x[2] for x in xs] for xs in spans], "base": [[x[3] for x in xs] for xs in spans]})

    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>, base array<boolean>")


def _more(text: str, starts: list[int], tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagger's spans that are plausible and clear of the base spans; stretches of windows that don't touch are reconciled apart."""
    if not tags.any():
        return []
    taken = np.zeros(len(text), bool)
    for _, a, b in base:
        taken[a:b] = True
    out, first = [], 0
    for k in range(1, len(starts) + 1):
        if k == len(starts) or starts[k] >= starts[k - 1] + WIDTH:
            for kind, a, b in reconcile(len(text), starts[first:k], tags[first:k]) if tags[first:k].any() else ():
                found = _settled(kind, text, a, b)
                if found and not taken[found[0] : found[1]].any():
                    taken[found[0] : found[1]] = True
                    out.append((kind, *found))
            first = k
    return out


def op7_bilstm_crf_personal_data(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit(docs))
    spans = F.arrays_zip("kinds", "starts", "ends", "base")
    named = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(spans).alias("spans"))


def _is(kind: str):
    return lambda s: s["kinds"] == kind
