"""Token ids of two tokenizers side by side: groups between the bytes where both end a token.

A stretch of a text's bytes yields a fragment: tokens before its first common end
(open prefix), groups between common ends (closed), tokens after the last one (open
suffix). Fragments compose associatively, so texts longer than ``chunk`` bytes are
tokenized and grouped as byte ranges in many tasks and composed up a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payerlens.operators.stages import settle

from .common import map_arrow, partition_id, small_slices, whole_text
from .tokens import _WORD_CUT, _WORD_ODD, TOGETHER, BytePieces, SentencePieces, Slots

CHUNK = 65_536
#: Fragments that one step of the tree composes, as a power of two.
FAN = 3
#: Tokens of a block of documents, whose counts are summed before they leave the task.
BLOCK_TOKENS = 1_000_000
#: Pieces that a worker remembers for each tokenizer.
REMEMBERED = 300_000
#: Groups with more links than this are counted by their distinct ids.
WIDE = 65_536


@dataclass
class Fragment:
    """Ids of a stretch of bytes; sizes of its open prefix, closed groups and open suffix.

    A stretch without a common end is all prefix: its sizes have one entry.
    """

    a: np.ndarray
    b: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    sound: bool = True

    def __add__(self, right: Fragment) -> Fragment:
        """The fragment of both stretches: this one's suffix and the other's prefix meet."""

        def met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([x[:-1], x[-1:] + y[:1], y[1:]])

        return Fragment(
            np.concatenate([self.a, right.a]),
            np.concatenate([self.b, right.b]),
            met(self.sizes_a, right.sizes_a),
            met(self.sizes_b, right.sizes_b),
            self.sound and right.sound,
        )

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the groups of a whole text, whose first byte and end are common."""
        return self.sizes_a[:-1], self.sizes_b[:-1]


EMPTY = Fragment(*(np.zeros(0, np.uint16),) * 2, *(np.zeros(1, np.int64),) * 2)
UNSOUND = replace(EMPTY, sound=False)


def _common(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Values of both ascending arrays without repeats."""
    if not len(ends_b):
        return ends_b
    return ends_a[ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a]


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of tokens with these byte ends (ascending)."""
    common = _common(ends_a, ends_b)
    sizes = []
    for ends in (ends_a, ends_b):
        upto = np.searchsorted(ends, common, "right")
        sizes.append(np.diff(np.concatenate([[0], upto, [len(ends)]])))
    return Fragment(a, b, *sizes)


@lru_cache(maxsize=1)
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """(digits of each number below 2**16 and room for a mark, number of its digits)."""
    numbers = np.arange(1 << 16)
    width = np.searchsorted(10 ** np.arange(1, 6), numbers, "right") + 1
    powers = 10 ** np.maximum(width[:, None] - 1 - np.arange(6), 0)
    return (numbers[:, None] // powers % 10 + 48).astype(np.uint8), width


def spelled(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids (below 2**16) of each group."""
    if not len(sizes_a):
        return b""
    upto_a, upto_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    place_a = np.arange(len(a)) + np.repeat(upto_b - sizes_b, sizes_a)
    place_b = np.arange(len(b)) + np.repeat(upto_a, sizes_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[place_a[upto_a - 1]] = ord("|")
    mark[place_b[upto_b - 1]] = ord(";")
    digits, widths = _signs()
    signs, width = digits[ids], widths[ids]
    signs[np.arange(len(ids)), width] = mark
    return signs[np.arange(6) <= width[:, None]][:-1].tobytes()


def links(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs of ids in one group as a * 2**32 + b, ascending; how often each is linked)."""
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    n = sizes_a * sizes_b
    wide = np.flatnonzero(n > WIDE)
    few = np.where(n > WIDE, 0, n)
    group = np.repeat(np.arange(len(few)), few)
    at = np.arange(len(group)) - np.repeat(np.cumsum(few) - few, few)
    left = a[first_a[group] + at // sizes_b[group]].astype(np.int64)
    right = b[first_b[group] + at % sizes_b[group]].astype(np.int64)
    pairs, times = np.unique((left << 32) | right, return_counts=True)
    if not len(wide):
        return pairs, times
    parts, counts = [pairs], [times]
    for g in wide.tolist():
        x, n_x = np.unique(a[first_a[g] : first_a[g] + sizes_a[g]].astype(np.int64), return_counts=True)
        y, n_y = np.unique(b[first_b[g] : first_b[g] + sizes_b[g]].astype(np.int64), return_counts=True)
        parts.append(((x << 32)[:, None] | y).ravel())
        counts.append((n_x[:, None] * n_y).ravel())
    pairs, back = np.unique(np.concatenate(parts), return_inverse=True)
    return pairs, np.bincount(back, np.concatenate(counts)).astype(np.int64)


class _Pool:
    """Runs of numbers by the number of their piece."""

    def __init__(self, dtype):
        self.data, self.first, self.size, self.used = np.zeros(4096, dtype), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    def keep(self, known: int, sizes: np.ndarray, data: np.ndarray) -> None:
        n, used = known + len(sizes), self.used + len(data)
        if n > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * n), np.resize(self.size, 2 * n)
        if used > len(self.data):
            self.data = np.resize(self.data, 2 * used)
        self.first[known:n] = self.used + np.cumsum(sizes) - sizes
        self.size[known:n] = sizes
        self.data[self.used : used] = data
        self.used = used

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(runs of the pieces one after the other, end of each)."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(total)], ends


class Aligner:
    """Tokens of texts by both files, with a blank in front of each text.

    A text is cut at blanks between two other characters, which no token of either
    side crosses, so both end a token there and the groups of a piece do not depend on
    the rest. Pieces repeat, so their ids and groups are remembered, up to ``limit`` of them.
    """

    def __init__(self, byte_file: str, piece_file: str, limit: int):
        self.coders = BytePieces(byte_file), SentencePieces(piece_file)
        tables = [coder.bytes_of() for coder in self.coders]
        if max(map(len, tables)) > 1 << 16:
            raise ValueError("ids of 65,536 and more are not supported")
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in tables]
        self.starts = [np.concatenate([[0], np.cumsum(s)[:-1]]) for s in self.sizes]
        self.data = [np.frombuffer(b"".join(t), np.uint8) for t in tables]
        self.limit = limit
        self.slot = Slots()
        self.ids, self.groups = ([_Pool(np.uint16), _Pool(np.uint16)] for _ in range(2))
        self.sound, self.uses = np.zeros(1024, bool), np.zeros(0, np.int64)
        self.names: list[bytes] = []

    def _forget(self) -> None:
        """Keeps the pieces that came up often, at most half the limit."""
        least = 2
        while (self.uses >= least).sum() > self.limit // 2:
            least *= 2
        kept = np.flatnonzero(self.uses >= least)
        names, numbers = list(self.slot), kept.tolist()
        self.slot = Slots()
        self.slot.update((names[i], k) for k, i in enumerate(numbers))
        self.names = [self.names[i] for i in numbers]
        self.sound, self.uses = self.sound[kept], np.zeros(len(kept), np.int64)
        for pools in (self.ids, self.groups):
            for k, old in enumerate(pools):
                pools[k] = _Pool(old.data.dtype)
                pools[k].keep(0, old.size[kept], old.of(kept)[0])

    def _learn(self) -> None:
        pieces, self.slot.waiting = self.slot.waiting, []
        known = len(self.slot) - len(pieces)
        for first in range(0, len(pieces), TOGETHER):
            own = pieces[first : first + TOGETHER]
            raw = [b" " + p.encode() for p in own]
            length = np.array([len(x) for x in raw])
            begin, whole = np.cumsum(length) - length, np.frombuffer(b"".join(raw), np.uint8)
            # a piece of its own that begins with a blank is told from one that begins a text
            told = ["  " + p if p[:1] == " " or not p else p for p in own]
            found, sound = [], np.ones(len(own), bool)
            for k, coder in enumerate(self.coders):
                n, ids = coder.fresh(told)
                piece, size = np.repeat(np.arange(len(own)), n), self.sizes[k][ids]
                total = np.bincount(piece, size, len(own)).astype(np.int64)
                end = np.cumsum(size) - np.repeat(np.cumsum(total) - total, n)
                good = total == length
                fit = good[piece]
                at = np.repeat(self.starts[k][ids[fit]] - (np.cumsum(size[fit]) - size[fit]), size[fit]) + np.arange(size[fit].sum())
                place = np.repeat((begin[piece] + end - size)[fit] - (np.cumsum(size[fit]) - size[fit]), size[fit]) + np.arange(size[fit].sum())
                wrong = self.data[k][at] != whole[place]
                good[np.repeat(piece[fit], size[fit])[wrong]] = False
                sound &= good
                found.append((n, ids, piece, begin[piece] + end))
            ends, sizes = [], []
            for k, (n, ids, piece, end) in enumerate(found):
                keep = sound[piece]
                self.ids[k].keep(known, np.where(sound, n, 0), ids[keep])
                ends.append(end[keep])
            both = fragment(ends[0], ends[0], ends[1], ends[1])
            common = _common(*ends)
            count = np.bincount(np.searchsorted(begin + length, common), minlength=len(own))
            for k in range(2):
                self.groups[k].keep(known, count, (both.sizes_a, both.sizes_b)[k][:-1])
            if known + len(own) > len(self.sound):
                self.sound = np.resize(self.sound, 2 * (known + len(own)))
            self.sound[known : known + len(own)] = sound
            ids = [found[k][1][sound[found[k][2]]] for k in range(2)]
            names = spelled(*ids, *both.groups()).split(b";")
            upto = np.cumsum(count).tolist()
            self.names += [b";".join(names[a:b]) for a, b in zip([0, *upto], upto)]
            known += len(own)

    def fragments(self, texts: list[str]) -> Iterator[tuple[Fragment, bytes]]:
        """(closed fragment, its groups spelled) of a blank and each text; empty ones where bytes are not met."""
        if len(self.slot) > self.limit:
            self._forget()
        pieces: list[str] = []
        edges = [0]
        for text in texts:
            pieces += _WORD_CUT.split(text) if _WORD_ODD.search(text) else text.split(" ")
            edges.append(len(pieces))
        at = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        if self.slot.waiting:
            self._learn()
        uses = np.bincount(at, minlength=len(self.slot))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        whole = [pool.of(at) for pool in (*self.ids, *self.groups)]
        upto = [np.concatenate([[0], ends])[edges] for _, ends in whole]
        numbers, sound = at.tolist(), self.sound[at]
        for i in range(len(texts)):
            low, high = edges[i], edges[i + 1]
            if sound[low:high].all():
                a, b, sizes_a, sizes_b = (x[u[i] : u[i + 1]] for (x, _), u in zip(whole, upto))
                name = b";".join([self.names[k] for k in numbers[low:high]])
                yield Fragment(a, b, np.append(sizes_a, 0), np.append(sizes_b, 0)), name
            else:
                yield UNSOUND, b""

    def ends(self, x: Fragment) -> list[np.ndarray]:
        """Byte ends of the tokens of both sides."""
        return [np.cumsum(self.sizes[k][ids]) for k, ids in enumerate((x.a, x.b))]


@lru_cache(maxsize=1)
def aligner(byte_file: str, piece_file: str, limit: int) -> Aligner:
    """The worker's aligner."""
    return Aligner(byte_file, piece_file, limit)


#: A fragment as a row: ids as little-endian uint16, sizes of its parts packed.
_FRAGMENT = "ids_a binary, ids_b binary, sizes binary, sound boolean"


def packed_sizes(sizes_a: np.ndarray, sizes_b: np.ndarray) -> bytes:
    """Sizes of groups, a byte for both where they are below 16 and not both 0.

    Others are a zero byte here and two little-endian uint32 each behind all the bytes.
    """
    small = (sizes_a < 16) & (sizes_b < 16) & (sizes_a + sizes_b > 0)
    heads = np.where(small, sizes_a * 16 + sizes_b, 0).astype(np.uint8)
    rest = np.stack([sizes_a[~small], sizes_b[~small]], axis=1).astype("<u4")
    return np.uint32(len(heads)).tobytes() + heads.tobytes() + rest.tobytes()


def unpacked_sizes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    heads = np.frombuffer(data, np.uint8, n, 4)
    sizes_a, sizes_b = (heads >> 4).astype(np.int64), (heads & 15).astype(np.int64)
    large = np.flatnonzero(heads == 0)
    if len(large):
        rest = np.frombuffer(data, "<u4", 2 * len(large), 4 + n).reshape(-1, 2)
        sizes_a[large], sizes_b[large] = rest[:, 0], rest[:, 1]
    return sizes_a, sizes_b


def _ids(x: np.ndarray) -> bytes:
    return x.astype("<u2").tobytes()


def _row(x: Fragment) -> list:
    return [_ids(x.a), _ids(x.b), packed_sizes(x.sizes_a, x.sizes_b), x.sound]


def _fragment(a: bytes, b: bytes, sizes: bytes, sound: bool = True) -> Fragment:
    return Fragment(np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2"), *unpacked_sizes(sizes), sound)


class _Groups:
    """Rows of the documents' groups: their ids, sizes and spelling."""

    schema = "ids_a binary, ids_b binary, sizes binary, groups string"

    def add(self, doc, n_bytes: int, x: Fragment, text: bytes) -> list[list]:
        sizes = x.groups()
        return [[doc, n_bytes, _ids(x.a), _ids(x.b), packed_sizes(*sizes), text.decode()]]

    def end(self) -> list[list]:
        return []


class _Blocks:
    """Rows of the documents' links, by blocks of about ``tokens`` A tokens of one task.

    A block's distinct pairs are one row with the number of documents of each; a
    document's row has the places of its pairs among them, ascending and as differences,
    and how often it links each.
    """

    schema = (
        "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block bigint, "
        "places binary, times binary, pairs array<bigint>, docs array<bigint>"
    )

    def __init__(self, branch: int, tokens: int):
        self.number, self.tokens = (branch << 62) + (partition_id() << 32), tokens
        self.held, self.rows, self.own = 0, [], []

    def add(self, doc, n_bytes: int, x: Fragment, text: bytes) -> list[list]:
        sizes = x.groups()
        pairs, times = links(x.a, x.b, *sizes)
        digest = hashlib.sha256(text).hexdigest() if text else ""
        self.rows.append([doc, n_bytes, len(x.a), len(x.b), len(sizes[0]), int(times.sum()), digest])
        self.own.append((pairs, times))
        self.held += len(x.a)
        return self.end() if self.held >= self.tokens else []

    def end(self) -> list[list]:
        if not self.rows:
            return []
        known, docs = np.unique(np.concatenate([p for p, _ in self.own]), return_counts=True)
        out = [[None] * 7 + [self.number, None, None, known.tolist(), docs.tolist()]]
        for row, (pairs, times) in zip(self.rows, self.own):
            step = np.diff(np.searchsorted(known, pairs), prepend=0)
            out.append([*row, self.number, _short(step), _short(times), None, None])
        self.number, self.held, self.rows, self.own = self.number + 1, 0, [], []
        return out


def _short(numbers: np.ndarray) -> bytes:
    """Numbers below 255 as a byte, others as 255 here and a uint32 behind all the bytes."""
    large = numbers >= 255
    heads = np.where(large, 255, numbers).astype(np.uint8)
    return np.uint32(len(heads)).tobytes() + heads.tobytes() + numbers[large].astype("<u4").tobytes()


def _long(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    numbers = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    large = np.flatnonzero(numbers == 255)
    numbers[large] = np.frombuffer(data, "<u4", len(large), 4 + n)
    return numbers


def _columns(rows: list[list]) -> list[list]:
    return [list(c) for c in zip(*rows)]


def pieces_of(text: str, chunk: int) -> Iterator[tuple[int, str]]:
    """(byte place, part) of the parts of a text of about ``chunk`` characters, cut where no token crosses.

    Such a place is a blank between two other characters, which goes before the part
    behind it; a run without one stays whole. Places count the blank before the text.
    """
    first, place = 0, 0
    while first < len(text):
        cut = first + chunk
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = len(text)
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        part = text[first:cut]
        yield place, part
        place += len(part.encode()) + 1
        first = cut + 1


def aligned(
    docs: DataFrame, byte_file: str, piece_file: str, chunk: int = CHUNK, remembered: int = REMEMBERED
) -> DataFrame:
    """(doc_id, n_bytes, ids_a, ids_b, sizes, groups) of every document.

    ``groups`` spells the ids of each group (``a1,a2|b1;a3|b2,b3``); the binary columns
    hold them as little-endian uint16, the number of ids of each group in ``sizes`` (see
    ``unpacked_sizes``). Null and empty texts, and those whose tokens do not join to a blank
    and the text, have no tokens. Repeated rows and rows with a null doc_id are rows of
    their own; an empty table gives none. Other columns are not looked at. Texts of more
    than ``chunk`` bytes are cut, spread over the tasks and composed; the result does not
    depend on ``chunk``.
    """
    return _mapped(docs, byte_file, piece_file, chunk, remembered, _Groups.schema, lambda branch: _Groups())


def _mapped(docs, byte_file, piece_file, chunk, remembered, columns: str, collector) -> DataFrame:
    """Rows that collectors (one a task; 0 for short, 1 for composed texts) make of the documents' groups."""
    texts = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("place"), whole_text(docs).alias("text")
    ).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    short = texts.where(F.col("n_bytes") <= chunk).select("doc_id", "n_bytes", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    schema = f"doc_id {id_type}, n_bytes bigint, {columns}"

    def whole(batches):
        rows = collector(0)
        for batch in small_slices(batches):
            own = [batch.column(k).to_pylist() for k in range(3)]
            found = aligner(byte_file, piece_file, remembered).fragments(own[2])
            out = []
            for doc, n, text, (x, name) in zip(*own, found):
                out += rows.add(doc, n, x, name) if text and x.sound else rows.add(doc, n, EMPTY, b"")
            if out:
                yield _columns(out)
        out = rows.end()
        if out:
            yield _columns(out)

    done = map_arrow(short, whole, schema)

    def cut(batches):
        for batch in small_slices(batches, "text"):
            for i in range(batch.num_rows):
                doc, place, n, text = (batch.column(k)[i].as_py() for k in range(4))
                for at, part in pieces_of(text, chunk):
                    yield [[doc], [place], [n], [at], [part]]

    def ranges(batches):
        for batch in small_slices(batches, "text"):
            aligns = aligner(byte_file, piece_file, remembered)
            keys = [batch.column(k).to_pylist() for k in range(4)]
            for i, (whole, _) in enumerate(aligns.fragments(batch.column(4).to_pylist())):
                doc, place, n, at = (k[i] for k in keys)
                sides = list(zip((whole.a, whole.b), aligns.ends(whole)))
                last = max([1, *(int(ends[-1]) for _, ends in sides if len(ends))])
                for number in range(at // chunk, (at + last - 1) // chunk + 1):
                    parts = []
                    for ids, ends in sides:
                        low, high = np.searchsorted(ends + at, [number * chunk, (number + 1) * chunk], "right")
                        parts += [ids[low:high], ends[low:high]]
                    x = replace(fragment(*parts), sound=whole.sound)
                    yield [[doc], [place], [n], [max(at, number * chunk)], *_columns([_row(x)])]

    keys = f"doc_id {id_type}, place bigint, n_bytes bigint, at bigint"
    long = texts.where(F.col("n_bytes") > chunk).select("doc_id", "place", "n_bytes", "text")
    parts = map_arrow(long, cut, f"{keys}, text string").repartition("place", "at")
    found = map_arrow(parts, ranges, f"{keys}, {_FRAGMENT}")
    longest = long.agg(F.max("n_bytes")).first()[0]
    if longest is None:
        return done
    width = chunk
    while True:
        width <<= FAN
        found = _composed(found, width, keys)
        if width > longest + 1:
            break

    def finished(batches):
        rows = collector(1)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, n, *parts = (batch.column(k)[i].as_py() for k in range(6))
                x = _fragment(*parts)
                x = x if x.sound else EMPTY
                out = rows.add(doc, n, x, spelled(x.a, x.b, *x.groups()))
                if out:
                    yield _columns(out)
        out = rows.end()
        if out:
            yield _columns(out)

    return done.union(map_arrow(found.drop("place", "at"), finished, schema))


def _composed(found: DataFrame, width: int, keys: str) -> DataFrame:
    """One step up the tree: the fragments of a document within ``width`` bytes become one."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["node"]).to_pylist(), key=lambda r: r["at"])
        total = None
        for r in rows:
            x = _fragment(r["ids_a"], r["ids_b"], r["sizes"], r["sound"])
            total = x if total is None else total + x
        first = [rows[0][k] for k in ("doc_id", "place", "n_bytes", "at")]
        return pa.Table.from_arrays(
            [pa.array([v], type=f.type) for v, f in zip([*first, *_row(total)], table.schema)],
            schema=pa.schema([f for f in table.schema if f.name != "node"]),
        )

    node = found.withColumn("node", F.floor(F.col("at") / width))
    return node.groupBy("place", "node").applyInArrow(join, f"{keys}, {_FRAGMENT}")


def linked(
    docs: DataFrame,
    byte_file: str,
    piece_file: str,
    chunk: int = CHUNK,
    remembered: int = REMEMBERED,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(doc_id, n_bytes, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    Links are the pairs of an A and a B token in one group. The count of a pair of ids is
    the number of documents with a link of it; n_best are the links whose pair has its
    A id's highest count (ties too), count_sum adds the counts over the links.
    groups_sha256 is of the groups as ``aligned`` spells them, '' without tokens. A
    block of documents sums its counts before they are shuffled and fetches those of its
    pairs once, so a pair that every document has is one row a block. For nulls,
    repeated rows and other columns see ``aligned``.
    """
    rows = settle(
        _mapped(
            docs, byte_file, piece_file, chunk, remembered, _Blocks.schema, lambda branch: _Blocks(branch, block_tokens)
        )
    )
    pairs = rows.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p"))
    pairs = pairs.select(F.col("block").alias("owner"), "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    fetched = pairs.select("owner", "at", "pair").join(counts, "pair").select("owner", "at", "n", "best")

    names = ("doc_id", "n_bytes", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    of = rows.where("pairs IS NULL").select("block", "places", "times", *names)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"

    def scored(own: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["at"].to_numpy())
        n = known["n"].to_numpy()[order]
        best = known["best"].to_numpy(zero_copy_only=False)[order]
        sums = []
        for places, times in zip(own["places"].to_pylist(), own["times"].to_pylist()):
            at, times = np.cumsum(_long(places)), _long(times)
            sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
        out = own.select(names)
        for name, column in zip(("n_best", "count_sum"), zip(*sums)):
            out = out.append_column(name, pa.array(column, pa.int64()))
        return out

    both = of.groupBy("block").cogroup(fetched.groupBy("owner"))
    return both.applyInArrow(scored, f"{fields}, n_best bigint, count_sum bigint")
