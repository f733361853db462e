"""Secrets in texts: candidate strings and a random forest that removes false findings.

Candidates are runs of at least 16 letters, digits and ``_-+/=.`` without a leading
``NAME=``, and values of at least 8 characters of any kind but blanks and quotes that stand
after a telling name and ``=`` or ``:``. The forest sees a candidate's length, the
transitions between its characters, how much of it dictionary words cover, words of
the path and the words on both sides of it. It is trained from labelled findings that a seeded
generator writes after public key formats and usual false findings.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_slices, whole_text
from .hashing import words_of

LEAST, LEAST_VALUE, BESIDE = 16, 8, 40
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
#: The names and values of a run.
_PARTS = re.compile(r"[^=]+")
#: Words that tell a finding apart, by what stands before it or in its path.
TELLING = frozenset("token secret password passwd pwd key apikey api auth authorization bearer credential credentials private access".split())
HARMLESS = frozenset("sha sha1 sha256 md5 commit revision checksum digest hash integrity uuid guid id version etag url href src file path build blob tree".split())
HARMLESS_PATH = frozenset("test tests spec mock example examples sample fixture docs doc lock min vendor dist".split())
_WORD = "|".join(sorted(TELLING, key=len, reverse=True))
#: A telling word, the rest of the name, and what assigns; the value begins after it.
_ASSIGNS = rf"(?:{_WORD})[A-Za-z0-9_.-]{{0,40}}[\"'\]]{{0,2}}[ \t]{{0,3}}(?::=|=>|=|:)[ \t]{{0,3}}"
_ASSIGNED = re.compile(rf"{_ASSIGNS}(?![:=]|//)", re.I)
_VALUE = {q: re.compile(rf"[^{q}\s]+(?={q})") for q in "\"'`"} | {"": re.compile(r"[^\s\"'`<>]+")}
_NAME_END = re.compile(r"([A-Za-z0-9_.-]+)[\"'\]]{0,2}[ \t]{0,3}(?::=|=>|=|:)[ \t]{0,3}\Z")
DICTIONARY = frozenset(
    "access account action address async await back base before board book build button call cache change "
    "char check client code comment common config content context control create data date default device "
    "docs document down element error event example factory false field file filter find first float form "
    "format from function handle head header help home host html http image import index input item java "
    "json label last layer length license line link load local lock login main make manager master memory "
    "menu message method mode model module name network next node null number object offset open output "
    "package page parent parse part path project public query queue read record render report request "
    "reset response result return row screen script search select send server service session set source "
    "space spring start state static status step store stream string style switch system table tag target "
    "task template test text that this thread time title token true type update upload user util value "
    "variable vector version website window word work".split()
)

FEATURES = (
    "length", "upper", "lower", "digit", "symbol", "changes", "case_changes", "digit_changes", "vowel_steps", "repeats",
    "entropy", "hex", "covered", "prefix", "telling", "harmless", "path_harmless", "quoted", "assigned", "dots", "slashes", "dashes",
    "telling_after", "harmless_after", "calls",
)
#: Public prefixes of keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "glpat-", "npm_", "eyJ", "SG.", "hf_")

_CLASS = np.full(256, 3, np.int8)
_CLASS[48:58] = 2
_CLASS[65:91] = 0
_CLASS[97:123] = 1
_VOWEL = np.isin(np.arange(256), list(b"aeiouAEIOU"))


def covered(text: str) -> float:
    """Share of the characters that dictionary words of four to eight letters cover, longest first."""
    low, at, n = text.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(8, 3, -1) if low[at : at + k] in DICTIONARY), 0)
        n += size
        at += size or 1
    return n / len(text)


def _beside(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower()))


def features(found: str, before: str, after: str, path: str) -> list[float]:
    raw = np.frombuffer(found.encode("ascii", "replace"), np.uint8)
    kind, n = _CLASS[raw], len(raw)
    share = np.bincount(kind, minlength=4) / n
    counts = np.bincount(raw)
    p = counts[counts > 0] / n
    a, b = kind[:-1], kind[1:]
    letters = (a < 2) & (b < 2)
    words, later = _beside(before), _beside(after)
    places = set(re.findall(r"[a-z]+", path.lower()))
    return [
        float(n), *share.tolist(), float((a != b).mean()), float((letters & (a != b)).mean()),
        float(((a == 2) != (b == 2)).mean()), float((letters & (_VOWEL[raw[:-1]] != _VOWEL[raw[1:]])).mean()),
        float((raw[1:] == raw[:-1]).mean()), float(-(p * np.log2(p)).sum()),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", found) is not None), covered(found), float(found.startswith(PREFIXES)),
        float(len(words & TELLING)), float(len(words & HARMLESS)), float(len(places & HARMLESS_PATH)),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')), float(re.search(r"[:=]\s*[\"']?$", before) is not None),
        found.count(".") / n, found.count("/") / n, found.count("-") / n,
        float(len(later & TELLING)), float(len(later & HARMLESS)), sum(map(found.count, "()[]{}<>$")) / n,
    ]


# ---- labelled findings


def _random(rng, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))


def labelled(n: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of n generated findings, about half of them secrets."""
    rng = np.random.default_rng(seed)
    alnum = string.ascii_letters + string.digits
    hexed, base64 = "0123456789abcdef", alnum + "+/"
    dictionary = sorted(DICTIONARY)
    word = lambda: dictionary[rng.integers(len(dictionary))]
    syllables = lambda: "".join(_random(rng, "bcdfghklmnprstvw", 1) + _random(rng, "aeiou", 1) for _ in range(rng.integers(2, 5)))
    pick = lambda *x: x[rng.integers(len(x))]
    leet = str.maketrans("aeios", "43105")

    def password() -> str:
        """Words with digits for letters, digits or signs at their end, at least 8 characters."""
        body = "".join(str(pick(word(), syllables())).capitalize() if rng.random() < 0.6 else syllables() for _ in range(2))
        body = body.translate(leet) if rng.random() < 0.5 else body + pick("", "!", "#", "$", "&") + _random(rng, string.digits, int(rng.integers(1, 5)))
        return body + pick("", "!", "x", "#") + _random(rng, string.digits, max(0, 8 - len(body)))

    def code() -> str:
        """What stands for a value in programs and manuals."""
        return pick(
            lambda: f"{word()}.{word()}", lambda: f"{word()}_{word()}", lambda: f"{word()}.{word()}()", lambda: f"get{word().capitalize()}({word()})",
            lambda: f"process.env.{word().upper()}", lambda: f"${{{word().upper()}_{word().upper()}}}", lambda: f"os.environ[{word()}]", lambda: f"{word()}{word().capitalize()}",
            lambda: "x" * int(rng.integers(8, 16)), lambda: f"your-{word()}-here", lambda: "".join(syllables() for _ in range(3)),
            lambda: f"{{{{{word()}.{word()}}}}}", lambda: f"https://{syllables()}.example.com/{word()}", lambda: f"/{word()}/{word()}/{word()}",
        )()
    x, y = [], []
    for _ in range(n):
        telling = str(pick(*sorted(TELLING)))
        if rng.random() < 0.5:
            found = pick(
                lambda: _random(rng, hexed, int(pick(32, 40, 40, 64))), lambda: "AKIA" + _random(rng, string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + _random(rng, alnum, 36), lambda: "sk_live_" + _random(rng, alnum, 24), lambda: "AIza" + _random(rng, alnum + "_-", 35),
                lambda: _random(rng, base64, 40), lambda: _random(rng, alnum, int(rng.integers(20, 48))),
                lambda: "xoxb-" + _random(rng, string.digits, 12) + "-" + _random(rng, alnum, 24),
                lambda: _random(rng, alnum + "!@#$&%^*?", int(rng.integers(8, 24))), lambda: _random(rng, string.ascii_letters, int(rng.integers(20, 48))),
                lambda: password(), lambda: password(),
                lambda: "eyJ" + _random(rng, alnum, 20) + "." + _random(rng, alnum, 60) + "." + _random(rng, alnum + "_-", 43),
            )()
            known = found.startswith(PREFIXES)
            before = pick(f"{syllables()} {telling} = \"", f"{telling}: ", f"{telling}=", f"{word()}_{telling} = '", f"{word()} {telling} ") if not known or rng.random() < 0.6 else f"{syllables()} {word()} "
            after, label = ('"' if before[-1] == '"' else "'" if before[-1] == "'" else " "), 1
            if len(found) >= LEAST and rng.random() < 0.2:  # the telling word comes after
                before, after = pick(f"{syllables()} {word()} ", "", f"{word()}: "), pick(f" is the {telling}", f" ({telling})", f" as {telling} ")
            elif rng.random() < 0.5:
                after += pick(f"\n{word()}", f" {syllables()} {word()}", f"\n{word().upper()}_{telling.upper()}=", f" # {word()}")
        else:
            harmless = str(pick(*sorted(HARMLESS)))
            found = pick(
                lambda: _random(rng, hexed, int(pick(32, 40, 64))),
                lambda: "-".join(_random(rng, hexed, k) for k in (8, 4, 4, 4, 12)),
                lambda: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(word() for _ in range(5))),
                lambda: "_".join(word() for _ in range(4)), lambda: "/".join(word() for _ in range(5)) + ".html",
                lambda: "-".join(syllables() for _ in range(4)), lambda: syllables() + syllables() + syllables() + syllables(),
                lambda: _random(rng, string.digits, int(rng.integers(16, 30))), lambda: pick("=", "-", "_", "a", "0", ".") * int(rng.integers(16, 60)),
                lambda: f"{syllables()}.{_random(rng, string.digits, 2)}@"[:-1] + f".{syllables()}.example.com", lambda: f"{word()}.{word()}.{word()}.{word()}",
                lambda: _random(rng, string.ascii_uppercase, 3).join(("THE", "ING", "TION", "ABLE", "EN", "OU")),
            )()
            before = pick(f"{harmless} ", f"{harmless}: ", f"{harmless}=\"", f"{syllables()} {syllables()} ", f"{word()} {harmless} ")
            if not re.fullmatch(r"[0-9a-f-]{32,}", found) and rng.random() < 0.2:
                before = f"{telling} = "
            if rng.random() < 0.2:
                found, before = code(), pick(f"{telling}: ", f"{telling}=", f"{word()}_{telling} = ", f"{telling.upper()}=")
            after, label = ('"' if before[-1] == '"' else " "), 0
            if rng.random() < 0.5:
                after += pick(f" {harmless} {word()}", f"\n{word()}", f" {syllables()} {word()}", f"\n{word().upper()}_{telling.upper()}=")
        path = f"{word()}/{word()}.py" if label or rng.random() < 0.6 else f"{pick(*sorted(HARMLESS_PATH))}/{word()}"
        x.append(features(found, before, after, str(path) if rng.random() < 0.5 else ""))
        y.append(label)
    return np.array(x), np.array(y)


# ---- forest


def _grow(x, y, rng, depth: int, least: int):
    share = y.mean()
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return float(share)
    best = None
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (left >= least) & (left <= len(y) - least)
        if not ok.any():
            continue
        p, q = hits[:-1] / left, (hits[-1] - hits[:-1]) / (len(y) - left)
        impurity = np.where(ok, left * p * (1 - p) + (len(y) - left) * q * (1 - q), np.inf)
        at = int(impurity.argmin())
        if best is None or impurity[at] < best[0]:
            best = (impurity[at], f, (v[at] + v[at + 1]) / 2)
    if best is None:
        return float(share)
    _, f, edge = best
    low = x[:, f] <= edge
    return int(f), float(edge), _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least)


@lru_cache(maxsize=1)
def forest(trees: int = 30, depth: int = 10, least: int = 3, seed: int = 13) -> list:
    """Trees on bootstrap samples of the labelled findings, each split among a few random features."""
    x, y = labelled()
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(_grow(x[pick], y[pick], rng, depth, least))
    return out


def _leaf(node, row) -> float:
    while not isinstance(node, float):
        f, edge, low, high = node
        node = low if row[f] <= edge else high
    return node


def scores(x: np.ndarray, trees: list) -> np.ndarray:
    return np.array([sum(_leaf(t, row) for t in trees) / len(trees) for row in x])


def assigned(text: str) -> list[tuple[int, int]]:
    """Places of the values after a telling name; of one inside another only the inner one."""
    out: list[tuple[int, int]] = []
    bare = 0  # where the last value without quotes ends
    for m in _ASSIGNED.finditer(text):
        name = _NAME_END.search(text, max(0, m.start() - BESIDE), m.end())
        a, quote = m.end(), text[m.end() : m.end() + 1]
        if not name or not _beside(name[1]) & TELLING:
            continue
        if quote in _VALUE and quote:
            a += 1
            value = _VALUE[quote].match(text, a)
            b = value.end() if value else a
        else:
            if a >= bare:
                value = _VALUE[""].match(text, a)
                bare = value.end() if value else a
            b = bare
            while b > a and text[b - 1] in ",;.":
                b -= 1
            # closing brackets that were not opened inside
            spare = {c: text.count(c, a, b) - text.count(o, a, b) for o, c in ("()", "[]", "{}")} if text[b - 1] in ")]}" else {}
            while b > a and spare.get(text[b - 1], 0) > 0:
                b -= 1
                spare[text[b]] -= 1
        if b - a >= LEAST_VALUE:
            while out and out[-1][1] > a:
                out.pop()
            out.append((a, b))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of the candidate strings of a whole text, in order, ends exclusive, not overlapping."""
    runs = []
    for m in _CANDIDATE.finditer(text):
        for part in _PARTS.finditer(m[0]):
            found = part[0].strip(".=/-_+")
            if len(found) >= LEAST:
                a = m.start() + part.start() + part[0].index(found)
                runs.append((a, a + len(found)))
    values = assigned(text)
    out, i = [], 0
    for a, b in values:
        while i < len(runs) and runs[i][1] <= a:
            out.append(runs[i])
            i += 1
        inside = []
        while i < len(runs) and runs[i][0] < b:
            inside.append(runs[i])
            i += 1
        # a known key inside a longer value, as in an address, is the finding
        known = [(x, y) for x, y in inside if x > a and text.startswith(PREFIXES, x)]
        out += known or [(a, b)]
    return out + runs[i:]


def find(docs: DataFrame, path: Column | None = None, trees: list | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (start:end of those kept, comma-joined) of every row.

    Positions are code points. Null text counts as empty, a null path as none; repeated
    rows give a row each. Texts without a long word or a value after a telling name are passed
    over by arrays alone.
    """
    trees = trees or forest()
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        whole_text(docs).alias("text"),
        F.coalesce(path if path is not None else F.lit(""), F.lit("")).alias("path"),
    )

    def work(batches):
        for batch in small_slices(batches):
            words = words_of(batch.column(1), lower=False)
            long = np.concatenate([[0], np.cumsum(words.ends - words.begins >= LEAST)])
            named = pc.match_substring_regex(batch.column(1), rf"{_ASSIGNS}[\"'`]?\S{{8}}", ignore_case=True)
            asked = np.flatnonzero((np.diff(long[words.upto]) > 0) | named.to_numpy(zero_copy_only=False))
            n = batch.num_rows
            tried, kept, spans = [0] * n, [0] * n, [""] * n
            for r in asked.tolist():
                text, where = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                places = candidates(text)
                tried[r] = len(places)
                if places:
                    x = np.array([features(text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE], where) for a, b in places])
                    good = [p for p, s in zip(places, scores(x, trees)) if s >= threshold]
                    kept[r], spans[r] = len(good), ",".join(f"{a}:{b}" for a, b in good)
            yield [batch.column(0), tried, kept, spans]

    return map_arrow(rows, work, "doc_id bigint, n_candidates bigint, n_secrets bigint, secrets string")
