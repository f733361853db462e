"""Personal data: base patterns and a character-level BiLSTM with CRF transitions.

The base patterns find plain e-mail addresses, IP addresses, card numbers and phone
numbers. The network adds spans of the same kinds that the patterns miss: numbers
that stand next to others and merge with them, phone numbers without a country code,
spelled-out addresses. It is trained in numpy from labelled spans, which a seeded
generator writes. It reads overlapping windows of the whole text but those in which no
span could pass the checks that follow (no digits in a row, no phone number with a plus
sign, no at with a host behind it). The tag scores of adjoining windows are joined, each place by the window in whose centre it is, and a run
of such windows is decoded once by Viterbi, so that a span may be longer than a window.
The spans of a text are then reconciled: base spans stay, of overlapping others the one
with the highest score does.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_slices, whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- base patterns

_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = re.compile(rf"{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The same, only from the start of a run: a run that fails fails from each of its characters.
_EMAIL_RUN = re.compile(rf"(?<!{_LOCAL}){_EMAIL.pattern}")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str):
    at = 0
    if "@" not in text:
        return
    while m := _EMAIL.match(text, at) or _EMAIL_RUN.search(text, at):
        yield m.start(), m.end()
        at = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns: leftmost, not overlapping within a kind; failing ones dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- labelled spans for the training

_SYMBOLS = {c: i for i, c in enumerate(string.ascii_lowercase + "@.+-_()[] \n:;,/=#*\"'%", 4)}
_PAD, _DIGIT, _UPPER, _OTHER = range(4)
SYMBOLS = 4 + len(_SYMBOLS)
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def symbols(text: str) -> list[int]:
    return [_DIGIT if c in "0123456789" else _UPPER if "A" <= c <= "Z" else _SYMBOLS.get(c, _OTHER) for c in text]


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng) -> str:
    letters = string.ascii_lowercase + "éñüß"
    word = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(1, 10)))
    return word.capitalize() if rng.random() < 0.15 else word.upper() if rng.random() < 0.05 else word


def _card(rng) -> str:
    body = str(rng.integers(3, 7)) + _number(rng, int(rng.choice([14, 14, 14, 13])))
    body += next(d for d in "0123456789" if luhn(body + d))
    gap = str(rng.choice(["", "", " ", "-"]))
    return gap.join(body[i : i + 4] for i in range(0, len(body), 4))


def _phone(rng) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return str(
        rng.choice(
            [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_number(rng, 2)} {a} {b} {c}",
             f"+1-{a}-{b}-{c}", f"({a}){b}-{c}", f"+{_number(rng, 2)}{a}{b}{c}"]
        )
    )


def _email(rng) -> str:
    ascii_word = lambda: "".join(string.ascii_lowercase[i] for i in rng.integers(0, 26, rng.integers(2, 9)))
    name = ascii_word() + str(rng.choice(["", ".", "_", "-"])) + (ascii_word() if rng.random() < 0.5 else _number(rng, 2))
    host, end = ascii_word() + str(rng.choice(["", _number(rng, 1)])), str(rng.choice(["com", "org", "net", "de", "fr", "io"]))
    at, dot = (
        ("@", ".") if rng.random() < 0.5
        else ([" at ", " (at) ", " [at] ", "(at)", "[at]"][rng.integers(5)], [" dot ", " (dot) ", " [dot] ", "."][rng.integers(4)])
    )
    if rng.random() < 0.4:
        host = f"{host}{dot}example"
    found = f"{name}{at}{host}{dot}{end}"
    # a line may end at any blank of a spelled-out address
    return "".join("\n" if c == " " and rng.random() < 0.15 else c for c in found)


def _ip(rng) -> str:
    return ".".join(str(rng.integers(0, 256)) for _ in range(4))


def _plain(rng) -> str:
    """Numbers and strings that are no personal data."""
    n, hexed = int(rng.integers(1, 9)), "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.choice([8, 32, 40])))
    choices = [
        _number(rng, n), f"{_number(rng, 4)}-{_number(rng, 2)}-{_number(rng, 2)}", f"{_number(rng, 2)}.{_number(rng, 2)}.{_number(rng, 4)}",
        f"${_number(rng, 3)}.{_number(rng, 2)}", f"{_number(rng, 1)},{_number(rng, 3)},{_number(rng, 3)}", hexed, f'"{hexed}"',
        f"token = \"{hexed}\"", f"v{_number(rng, 1)}.{_number(rng, 1)}.{_number(rng, 2)}", f"{_number(rng, 2)}:{_number(rng, 2)}:{_number(rng, 2)}",
        f"@{_word(rng)}", f"{_word(rng)} at {_word(rng)}", "dot", f"({_number(rng, 4)})", f"{_number(rng, 3)}-{_number(rng, 3)}", f"#{_number(rng, 6)}",
    ]
    return str(choices[rng.integers(len(choices))])


_MAKERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def labelled_text(rng, length: int) -> tuple[str, list[Span]]:
    """A text of about the length with labelled spans."""
    parts, spans, at = [], [], 0
    while at < length:
        x = rng.random()
        kind = KINDS[rng.integers(4)] if x < 0.25 else None
        piece = _MAKERS[kind](rng) if kind else _plain(rng) if x < 0.35 else _word(rng)
        if kind:
            spans.append((kind, at, at + len(piece)))
        gap = str(rng.choice([" ", " ", " ", " ", ", ", ".\n", ". ", "### ", "&&& "]))
        parts += [piece, gap]
        at += len(piece) + len(gap)
    return "".join(parts), spans


WINDOW, STRIDE = 96, 48


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of n windows cut from labelled texts at random places."""
    rng = np.random.default_rng(seed)
    xs, ys = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = labelled_text(rng, 3 * WINDOW // 2)
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            tags[a:b], tags[a] = k + 1, k
        size = WINDOW if rng.random() < 0.85 else int(rng.integers(20, WINDOW))
        a = int(rng.integers(0, max(1, len(text) - size)))
        own = symbols(text[a : a + size])
        xs[i, : len(own)], ys[i, : len(own)] = own, tags[a : a + len(own)]
    return xs, ys


# ---- the network


@dataclass
class Model:
    """Gates of each symbol and recurrent weights of both directions, tag weights, CRF transitions."""

    symbol: list[np.ndarray]  # 2 x (SYMBOLS, 4H)
    recur: list[np.ndarray]  # 2 x (H, 4H)
    tag: np.ndarray  # (2H, K)
    bias: np.ndarray  # (K,)
    moves: np.ndarray  # (K, K)

    def all(self) -> list[np.ndarray]:
        return [*self.symbol, *self.recur, self.tag, self.bias, self.moves]


def new_model(hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    k = len(TAGS)
    start = [rng.normal(0, 0.3, (SYMBOLS, 4 * hidden)).astype(np.float32) for _ in range(2)]
    for table in start:
        table[:, hidden : 2 * hidden] += 1.0  # forget gates start open
    recur = [rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32) for _ in range(2)]
    tag = rng.normal(0, 0.2, (2 * hidden, k)).astype(np.float32)
    return Model(start, recur, tag, np.zeros(k, np.float32), np.zeros((k, k), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(table: np.ndarray, recur: np.ndarray, x: np.ndarray, steps, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) for symbols x (B, T), gone through in the order of steps."""
    hidden, rows = recur.shape[0], len(x)
    h = np.zeros((rows, hidden), np.float32)
    c = np.zeros_like(h)
    out = np.empty((x.shape[1], rows, hidden), np.float32)
    for t in steps:
        z = table[x[:, t]] + h @ recur
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((t, i, f, o, g, before, tc, h))
        h = o * tc
        out[t] = h
    return out


def _lstm_back(recur, x, kept, dout, dtable, drecur) -> None:
    dh = dc = np.zeros_like(dout[0])
    for t, i, f, o, g, before, tc, last in reversed(kept):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
        )
        np.add.at(dtable, x[:, t], dz)
        drecur += last.T @ dz
        dh, dc = dz @ recur.T, dc * f


def emissions(model: Model, x: np.ndarray) -> np.ndarray:
    """Tag scores (T, B, K)."""
    n = x.shape[1]
    both = np.concatenate(
        [_lstm(model.symbol[0], model.recur[0], x, range(n)), _lstm(model.symbol[1], model.recur[1], x, range(n - 1, -1, -1))],
        axis=2,
    )
    return both @ model.tag + model.bias


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(e: np.ndarray, y: np.ndarray, moves: np.ndarray):
    """(mean loss, gradient of the emissions, gradient of the transitions); y is (B, T)."""
    n, rows, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, n):
        alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + moves, 1)
    for t in range(n - 2, -1, -1):
        beta[t] = _log_sum(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    whole = _log_sum(alpha[-1], 1)
    at, row = np.arange(n)[:, None], np.arange(rows)[None, :]
    gold = e[at, row, y.T].sum(axis=0) + moves[y[:, :-1], y[:, 1:]].sum(axis=1)
    de = np.exp(alpha + beta - whole[None, :, None])
    de[at, row, y.T] -= 1
    pair = alpha[:-1][:, :, :, None] + moves + (e[1:] + beta[1:])[:, :, None, :] - whole[None, :, None, None]
    dmoves = np.exp(pair).sum(axis=(0, 1))
    np.subtract.at(dmoves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    return float((whole - gold).mean()), de / rows, dmoves / rows


@lru_cache(maxsize=1)
def train(hidden: int = 20, steps: int = 400, batch: int = 48, windows: int = 5000, rate: float = 0.02, seed: int = 5) -> Model:
    """The network, fitted by Adam to windows of generated labelled texts."""
    model = new_model(hidden, seed)
    x, y = training_windows(windows, seed)
    rng = np.random.default_rng(seed)
    params = model.all()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = x.shape[1]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        own, gold = x[pick], y[pick]
        kept: list[list] = [[], []]
        ways = [range(n), range(n - 1, -1, -1)]
        outs = [_lstm(model.symbol[d], model.recur[d], own, ways[d], kept[d]) for d in range(2)]
        both = np.concatenate(outs, axis=2)
        _, de, dmoves = _crf(both @ model.tag + model.bias, gold, model.moves)
        grads = [np.zeros_like(p) for p in params]
        dboth = de @ model.tag.T
        for d in range(2):
            _lstm_back(model.recur[d], own, kept[d], dboth[:, :, d * hidden : (d + 1) * hidden], grads[d], grads[2 + d])
        grads[4][:] = both.reshape(-1, 2 * hidden).T @ de.reshape(-1, de.shape[2])
        grads[5][:] = de.sum(axis=(0, 1))
        grads[6][:] = dmoves
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second):
            g *= min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
    return model


def viterbi(e: np.ndarray, moves: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Best tags (N,) of runs that lie one after the other in e (N, K), each decoded once from its start to its end.

    ``edges`` has 0 and the ends of the runs. Where O wins by more than any transitions
    could give another tag, it is in the best path for certain; only the stretches
    between such places are gone through, from O to O, which gives the same path.
    """
    n = len(e)
    first, last, tags = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n, np.int64)
    first[edges[:-1]], last[edges[1:] - 1] = True, True
    into = (moves[:, 1:] - moves[:, :1]).max(axis=0).clip(0)
    onward = (moves[1:] - moves[:1]).max(axis=1).clip(0)
    unsure = ~(e[:, :1] - e[:, 1:] > into + onward).all(axis=1)
    begins = np.flatnonzero(unsure & (first[:-1] | ~np.concatenate([[False], unsure[:-1]])))
    ends = np.flatnonzero(unsure & (last[:-1] | ~np.concatenate([unsure[1:], [False]]))) + 1
    order = np.argsort(ends - begins, kind="stable")
    begins, ends = begins[order], ends[order]
    sizes = ends - begins
    at = 0
    while at < len(sizes):
        # a batch holds about a million scores of places, or one stretch
        upto = at + max(1, int(np.searchsorted(sizes[at : at + 1024] * np.arange(1, len(sizes[at : at + 1024]) + 1), 1_000_000)))
        low, high, size = begins[at:upto], ends[at:upto], sizes[at:upto]
        at = upto
        score = e[low] + np.where(first[low][:, None], 0, moves[0])
        back = np.empty((int(size[-1]), len(low), e.shape[1]), np.int8)
        done = np.searchsorted(size, np.arange(size[-1]), side="right").tolist()
        for t in range(1, int(size[-1])):
            k = done[t]
            whole = score[k:, :, None] + moves
            back[t, k:] = whole.argmax(axis=1)
            score[k:] = whole.max(axis=1) + e[low[k:] + t]
        tag = (score + np.where(last[high - 1][:, None], 0, moves[:, 0])).argmax(axis=1)
        row = np.arange(len(low))
        for t in range(int(size[-1]) - 1, -1, -1):
            k = done[t]
            tags[low[k:] + t] = tag[k:]
            if t:
                tag[k:] = back[t, row[k:], tag[k:]]
    return tags


# ---- windows, reconciliation

#: Every card number, address of four parts and phone number without a plus sign has such digits in a row.
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,3}[0-9]){3,}")
#: Every phone number with a plus sign begins such a run, however far its digits lie apart.
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"@|\bat\b", re.I)
#: A host with a dot, plain or spelled out, behind an at.
_DOT = r"(?:\.|\s*+(?:[(\[]\s*+)?+\bdot\b\s*+(?:[)\]]\s*+)?+)"
_HOST = re.compile(rf"\s*+(?:[)\]]\s*+)?+[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_NAME = frozenset(string.ascii_letters + string.digits + "._%+-")


def _skipped(text: str, a: int, stop: int, brackets: str) -> int:
    """Where the white space and brackets before ``a`` begin."""
    while a > stop and (text[a - 1].isspace() or text[a - 1] in brackets):
        a -= 1
    return a


def _name_start(text: str, a: int, stop: int) -> int:
    """Where the name before an at begins, spelled-out dots included."""
    a = _skipped(text, a, stop, "([")
    while True:
        while a > stop and text[a - 1] in _NAME:
            a -= 1
        b = _skipped(text, a, stop, ")]")
        if b == a or b - 3 < stop or text[b - 3 : b].lower() != "dot":
            return a
        a = _skipped(text, b - 3, stop, "([")


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches in one of which every span lies that ``plausible`` lets pass."""
    found = [m.span() for m in _NUMBER.finditer(text)]
    if "+" in text:
        found += [m.span() for m in _PLUS.finditer(text)]
    ats = [m.span() for m in _AT.finditer(text)]
    # an address has one at, so it neither begins before the last one nor goes on behind the next one
    ends = [0, *(b for _, b in ats)]
    starts = [*(a for a, _ in ats[1:]), len(text)]
    for (a, b), stop, upto in zip(ats, ends, starts):
        host = _HOST.match(text, b, upto)
        if host or text[a] == "@":
            found.append((_name_start(text, a, stop), host.end() if host else b))
    return found


def window_starts(text: str) -> list[int]:
    """Starts of the windows (on a grid of STRIDE) that touch a place, in order.

    A window is scored by itself, and each position of a place has all windows of the grid
    that hold it, so its scores are those of looking at every window of the text. In the
    windows left out no span could pass ``plausible``.
    """
    starts: set[int] = set()
    for a, b in places(text):
        starts.update(range(max(0, (a - WINDOW) // STRIDE + 1), (b - 1) // STRIDE + 1))
    return sorted(STRIDE * k for k in starts)


_SPELLED = re.compile(r"\s*[(\[]?\s*\b(?:at|dot)\b\s*[)\]]?\s*", re.I)


def plausible(kind: str, text: str) -> bool:
    """Whether a decoded span can be what it is called."""
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[ -]?[0-9])+", text) is not None
    if kind == "phone":
        form = r"\+[0-9][\x20().0-9-]+[0-9]" if text[0] == "+" else r"(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
        return 9 <= len(digits) <= 15 and re.fullmatch(form, text) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", text) is not None and all(int(p) <= 255 for p in text.split("."))
    plain = _SPELLED.sub(lambda m: "@" if "at" in m[0].lower() else ".", text)
    return _EMAIL.fullmatch(plain) is not None and plain.count("@") == 1


def _decoded(tags: np.ndarray, e: np.ndarray, edges: np.ndarray) -> list[tuple[float, str, int, int]]:
    """(score, kind, start, end) of the spans of all runs; the score is what the tags win over O."""
    kind = (tags - 1) // 2
    goes_on = np.zeros(len(tags) + 1, bool)
    goes_on[1:-1] = (tags[1:] > 0) & (tags[1:] % 2 == 0) & (tags[:-1] > 0) & (kind[1:] == kind[:-1])
    goes_on[edges] = False
    begins = np.flatnonzero((tags > 0) & ~goes_on[:-1])
    ends = np.flatnonzero((tags > 0) & ~goes_on[1:]) + 1
    won = np.concatenate([[0.0], np.cumsum(e[np.arange(len(tags)), tags] - e[:, 0], dtype=np.float64)])
    return [
        (float(won[b] - won[a]), KINDS[k], a, b)
        for a, b, k in zip(begins.tolist(), ends.tolist(), kind[begins].tolist())
    ]


def joined_scores(texts: list[str], model: Model, together: int = 1024) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(tag scores, edges, (text, start)) of the runs of adjoining windows of all texts, one after the other.

    Where two windows overlap, each gives the half of the overlap that is nearer to its centre.
    """
    jobs = [(i, s) for i, text in enumerate(texts) for s in window_starts(text)]
    asked, half = set(jobs), (WINDOW - STRIDE) // 2
    scores, sizes, runs, edges = [np.zeros((0, len(TAGS)), np.float32)], [], [], []
    for at in range(0, len(jobs), together):
        part = jobs[at : at + together]
        x = np.zeros((len(part), WINDOW), np.int64)
        inside = np.zeros((len(part), WINDOW), bool)
        for r, (i, s) in enumerate(part):
            own = symbols(texts[i][s : s + WINDOW])
            x[r, : len(own)] = own
            begins = (i, s - STRIDE) not in asked
            if begins:
                runs.append((i, s))
                edges.append(len(sizes))
            low, high = 0 if begins else half, WINDOW - half if (i, s + STRIDE) in asked else WINDOW
            inside[r, low : min(high, len(own))] = True
            sizes.append(int(inside[r].sum()))
        scores.append(emissions(model, x).transpose(1, 0, 2)[inside])
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return np.concatenate(scores), upto[[*edges, len(sizes)]], runs


def added_spans(texts: list[str], bases: list[list[Span]], model: Model, together: int = 1024) -> list[list[Span]]:
    """The network's spans of each text that do not overlap base spans or better ones."""
    found: list[list] = [[] for _ in texts]
    e, edges, runs = joined_scores(texts, model, together)
    for score, kind, a, b in _decoded(viterbi(e, model.moves, edges), e, edges):
        run = int(np.searchsorted(edges, a, side="right")) - 1
        i, shift = runs[run][0], runs[run][1] - int(edges[run])
        whole = texts[i][a + shift : b + shift]
        left = len(whole) - len(whole.lstrip(" \n.,;:#&*'\"-"))
        whole = whole.strip(" \n.,;:#&*'\"-")
        if whole and plausible(kind, whole):
            found[i].append((-score, kind, a + shift + left, a + shift + left + len(whole)))
    out = []
    for text, base, own in zip(texts, bases, found):
        taken = sorted((a, b) for _, a, b in base)
        kept: list[Span] = []
        for _, kind, a, b in sorted(set(own)):
            # inside a run of digits or letters that goes on, a span is a cut-off piece
            cut = a and text[a - 1].isalnum() and text[a].isalnum() or b < len(text) and text[b].isalnum() and text[b - 1].isalnum()
            if not cut and all(b <= x or y <= a for x, y in taken):
                kept.append((kind, a, b))
                taken.append((a, b))
        out.append(kept)
    return out


def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, base (spans as kind:start:end, joined), spans (all, likewise), found (all, as structs).

    Positions are code points, ends exclusive. Null text counts as empty; repeated rows
    give a row each.
    """
    model = model or train()
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), whole_text(docs).alias("text"))

    def work(batches):
        for batch in small_slices(batches):
            texts = batch.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            added = added_spans(texts, bases, model)
            every = [a + b for a, b in zip(bases, added)]
            yield [
                batch.column(0),
                *([sum(s[0] == k for s in base) for base in bases] for k in KINDS),
                [_joined(s) for s in bases],
                [_joined(s) for s in every],
            ]

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_arrow(rows, work, f"doc_id bigint, {counts}, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows with personal data in text replaced and n_chars, if there, counted anew; null stays null.

    Other columns stay as they are. Texts are read whole, however long. Repeated rows give
    a row each; an empty table gives no rows.
    """
    model = model or train()
    at = docs.columns.index("text")
    names = docs.columns
    import pyarrow as pa

    def run(batches):
        for batch in small_slices(batches):
            texts = batch.column(at).to_pylist()
            whole = [t or "" for t in texts]
            bases = [base_spans(t) for t in whole]
            added = added_spans(whole, bases, model)
            clean = [
                None if t is None else redacted(t, a + b) for t, a, b in zip(texts, bases, added)
            ]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in names else out
