"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?!\S)")
#: Places where no byte-level and no sentence piece crosses from word to blank.
_WORD_CUT = re.compile(r"(?<=\S) (?=\S)")
_WORD_ODD = re.compile(r" (?!\S)|(?<!\S) ")


#: Pieces whose ids a worker remembers, at some 250 bytes each.
REMEMBERED = 1_000_000
#: A character that parts pieces in one call of the library.
_MARK = "\x01"
TOGETHER = 500
#: Pieces in one call where their sizes are known.
MEASURED_TOGETHER = 2000
#: Characters that the files in use neither join, drop nor change in size, but for blanks and line ends.
_EVEN = re.compile("[\n -~\xc0-\xff]*")


class Slots(dict):
    """Number of each piece; new ones are numbered on sight and wait to be learned."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.waiting.append(piece)
        return number


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A text is cut before every blank that a non-blank follows. The tokenizers in
    use never let a token cross such a place, so the ids of the pieces, one after
    the other, are the ids of the text (a property test holds it against the
    library on the whole text). Pieces repeat, so their ids are remembered; once
    there are more than ``limit``, those that came up only once are forgotten.

    Strings of special tokens inside a text are what the library makes of them, their
    ids: such texts go to it whole. With ``plain`` they are ordinary text.
    """

    cut, odd = _CUT, _ODD
    #: Bytes of text that each id stands for, if they are known, and whether blanks are among them.
    spans: np.ndarray | None = None
    blanks = True

    def __init__(self, path: str, limit: int = REMEMBERED, plain: bool = False):
        self.literals: tuple[str, ...] = ()
        self._load(path, plain)
        self.limit = limit
        self.between = self._ids([" " + _MARK])[0]
        self.slot = Slots()
        self.first = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.uses = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _load(self, path: str, plain: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if plain:
            self.tokenizer.encode_special_tokens = True
        else:
            self.literals = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._measure()

    def _measure(self) -> None:
        """Sizes of the entries of a byte-level file, in which a character stands for a byte."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        spans = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, i in vocabulary.items():
            spans[i] = len(entry.removesuffix(suffix))
        shown = " aé b"
        found = int(spans[self._ids([shown])[0]].sum())
        if found in (6, 4):  # é takes two bytes; without blanks 4
            self.spans, self.blanks = spans, found == 6

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces by number one after the other, end of each)."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(total)], ends

    def _forget(self) -> None:
        """Keeps the pieces that came up often, at most half the limit."""
        uses, least = self.uses[: len(self.slot)], 2
        while (uses >= least).sum() > self.limit // 2:
            least *= 2
        kept = uses >= least
        names = [p for p, k in zip(self.slot, kept.tolist()) if k]
        ids, _ = self._gathered(np.flatnonzero(kept))
        sizes = self.size[: len(kept)][kept]
        self.slot = Slots()
        self.slot.update(zip(names, range(len(names))))
        self.uses = np.zeros(len(self.first), np.int64)
        self.used = 0
        self._keep(sizes, ids, 0)

    def _keep(self, sizes: np.ndarray, ids: np.ndarray, known: int) -> int:
        """Adds the ids of the pieces from number ``known`` on."""
        n = known + len(sizes)
        if n > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * n), np.resize(self.size, 2 * n)
            self.uses = np.concatenate([self.uses, np.zeros(2 * n - len(self.uses), np.int64)])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        self.size[known:n] = sizes
        self.first[known:n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return n

    def _learn(self) -> None:
        """Encodes the pieces that wait and keeps their ids."""
        pieces, self.slot.waiting = self.slot.waiting, []
        known = len(self.slot) - len(pieces)
        together = TOGETHER if self.spans is None else MEASURED_TOGETHER
        for at in range(0, len(pieces), together):
            known = self._keep(*self.fresh(pieces[at : at + together]), known)

    def fresh(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, the ids one after the other), in one call for many pieces."""
        return self._measured(own) or self._marked(own)

    def _measured(self, own: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Pieces as one text, told apart by the bytes that their ids stand for.

        None where sizes are not known or do not meet at every blank; pieces of
        other characters and those that do not stand behind a blank are left to the marks.
        """
        if self.spans is None:
            return None
        apart = [i for i, p in enumerate(own) if p[:1] == " " or p[-1:] in "\n"]
        rest = own
        if apart:
            held = set(apart)
            rest = [p for i, p in enumerate(own) if i not in held]
        text = " " + " ".join(rest)
        if not _EVEN.fullmatch(text) or text.count(" ") != len(rest):
            apart = [i for i, p in enumerate(own) if " " in p or p[-1:] in "\n" or not _EVEN.fullmatch(p)]
            held = set(apart)
            rest = [p for i, p in enumerate(own) if i not in held]
            text = " " + " ".join(rest)
        if not rest:
            return None
        ids = np.array(self._ids([text])[0], np.uint32)
        place = np.frombuffer(text.encode(), np.uint8)
        starts = np.flatnonzero(place == 32)
        if not self.blanks:
            starts = (np.cumsum((place != 32) & (place != 10)) - 1)[starts] + 1
        ends = np.cumsum(self.spans[ids])
        firsts = np.concatenate([[0], ends])
        at = np.searchsorted(firsts, starts)
        if (firsts[np.minimum(at, len(ids))] != starts).any():
            return None
        sizes = np.diff(np.append(at, len(ids)))
        if not apart:
            return sizes, ids
        other = self._marked([own[i] for i in apart])
        return _merged(len(own), apart, (sizes, ids), other)

    def _marked(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with a mark between them.

        A piece stands behind a blank; one that begins a text has a blank before it instead.
        The mark stands behind a blank and before one, so pieces meet it as they meet
        the rest of a text. Pieces that begin a text, hold the mark or end with
        white space are encoded one by one.
        """
        mark, gap = self.between[-1], len(self.between)
        alone = [i for i, p in enumerate(own) if p[:1] == " " or _MARK in p or p[-1:].isspace()]
        texts = {i: own[i][1:] if own[i][:1] == " " else " " + own[i] for i in alone}
        rest = [p for i, p in enumerate(own) if i not in texts]
        ids = np.array(self._ids([" " + f" {_MARK} ".join(rest)])[0], np.uint32) if rest else np.zeros(0, np.uint32)
        marks = np.flatnonzero(ids == mark)
        if len(marks) != max(0, len(rest) - 1):
            texts |= {i: " " + p for i, p in enumerate(own) if i not in texts}
            rest, marks = [], marks[:0]
        singles = dict(zip(texts, self._ids(list(texts.values()))))
        edges = np.concatenate([[-1], marks, [len(ids) + gap - 1]])
        if singles:
            bounds = iter(zip((edges[:-1] + 1).tolist(), (edges[1:] - gap + 1).tolist()))
            found = [np.array(singles[i], np.uint32) if i in singles else ids[slice(*next(bounds))] for i in range(len(own))]
            return np.array([len(x) for x in found]), np.concatenate(found)
        inside = np.ones(len(ids), bool)
        for j in range(gap):
            inside[marks - j] = False
        return np.diff(edges) - gap, ids[inside]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint32, number of ids of each text)."""
        whole = [i for i, text in enumerate(texts) if any(name in text for name in self.literals)]
        if not whole:
            return self._encode_pieces(texts)
        held = set(whole)
        ids, sizes = self._encode_pieces(["" if i in held else text for i, text in enumerate(texts)])
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, own in zip(whole, self._ids([texts[i] for i in whole])):
            parts[i], sizes[i] = np.array(own, np.uint32), len(own)
        return np.concatenate(parts), sizes

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slot) > self.limit:
            self._forget()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            own = self.cut.split(text) if self.odd.search(text) else text.split(" ")
            own[0] = " " + own[0]
            counts[i] = len(own)
            pieces += own
        at = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        if self.slot.waiting:
            self._learn()
        self.uses[: len(self.slot)] += np.bincount(at, minlength=len(self.slot))
        ids, ends = self._gathered(at)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)

    def documents(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        """Ids of each text with the end id behind."""
        ids, sizes = self.encode(texts)
        at = 0
        for n in sizes.tolist():
            yield np.append(ids[at : at + n], np.uint32(end))
            at += n


def _merged(n, apart, rest, other) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids) of n pieces, those at the places ``apart`` from ``other``, the rest in order from ``rest``."""
    own = np.zeros(n, bool)
    own[apart] = True
    sizes = np.zeros(n, np.int64)
    sizes[own], sizes[~own] = other[0], rest[0]
    ids = np.zeros(int(sizes.sum()), np.uint32)
    inside = np.repeat(own, sizes)
    ids[inside], ids[~inside] = other[1], rest[1]
    return sizes, ids


#: Fixed value: how the byte-level file parts a text before it merges bytes.
_BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePieces(Encoder):
    """Byte-level ids, cut where sentence pieces are cut too; special strings are ordinary text.

    The file's entries are numbered in the order of its merges (checked when it is loaded),
    so that a rank-based encoder, which is faster on single pieces, gives the same ids.
    """

    cut, odd = _WORD_CUT, _WORD_ODD

    def __init__(self, path: str):
        super().__init__(path, plain=True)

    def _load(self, path: str, plain: bool) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        vocabulary = model["vocab"]
        if sorted(vocabulary[m] for m in merged) != [vocabulary[m] for m in merged]:
            raise ValueError("entries are not numbered in the order of the merges")
        ranks = {bytes(byte[c] for c in entry): i for entry, i in vocabulary.items() if all(c in byte for c in entry)}
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in ranks.items():
            self.entries[i] = entry
        ranks.pop(b"<|endoftext|>", None)  # a special token, not a merge
        self.tokenizer = tiktoken.Encoding("file", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode_ordinary(t) for t in texts]

    def bytes_of(self) -> list[bytes]:
        return self.entries


class SentencePieces(Encoder):
    """Ids of a sentencepiece file for texts with a blank in front (the one that the library adds).

    None of the pieces holds a blank behind another character, so none crosses a cut.
    """

    cut, odd = _WORD_CUT, _WORD_ODD

    def _load(self, path: str, plain: bool) -> None:
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.tokenizer.get_piece_size()
        self.blank = self.tokenizer.piece_to_id("\u2581")
        pieces = [self.tokenizer.id_to_piece(i) for i in range(size)]
        if any(re.search("[^\u2581]\u2581", p) for p in pieces):
            raise ValueError("a piece crosses from word to blank")
        self.pieces = [
            bytes([int(p[3:5], 16)]) if self.tokenizer.is_byte(i) else p.replace("\u2581", " ").encode()
            for i, p in enumerate(pieces)
        ]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode([t[1:] for t in texts], num_threads=1)
        return [[self.blank] if t == " " else ids for t, ids in zip(texts, found)]

    def bytes_of(self) -> list[bytes]:
        return self.pieces


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path, remembered)
