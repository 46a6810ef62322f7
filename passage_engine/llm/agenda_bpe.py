"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs.

The encoder serves merge-type (BPE) models with byte fallback. White space is written as ``▁``, one is put before
the text, and every character starts as a symbol. All adjacent pairs whose joined text is a piece wait in an agenda
ordered by score, then by position; the best pair is joined and its new neighbours enter the agenda, until it is
empty. No piece holds ``▁`` after another character or a line break (checked when the model is loaded), so a text falls
apart into units that begin with ``▁`` or a line break, each of which is encoded by itself, and a unit met before is
taken from a bounded table. The units that a batch meets first are encoded together: their agendas are columns of one
array, and each step joins the best pair of every column. Longer units have a heap each.

Every unit met first is compared with the sentencepiece library's result for it, a batch at a time, and so is one
whole text per Arrow batch; a difference stops the job.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows each get their own row;
a text of any length is encoded whole; columns other than the two named are ignored.
"""

from __future__ import annotations

import heapq
import re
from hashlib import sha256
from itertools import chain
from operator import add, itemgetter

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from passage_engine.llm.batches import per_document

SPACE = "▁"
#: Units after which a Python worker starts a new table, keeping the full one beside it until the next is full, and
#: the length from which units are not kept but encoded each time.
TABLE_UNITS, TABLE_CHARS = 200_000, 48
#: Units whose agendas are one array, and the bits of a cost that hold the place in a unit.
TOGETHER, PLACE_BITS = 8192, 6
#: The cost of two symbols whose joined text is no piece.
NEVER = np.iinfo(np.int64).max

_UNIT = re.compile(f"\n[^{SPACE}\n]*|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_models: dict[str, AgendaModel] = {}


class Table(dict):
    """[ids, ids in decimal] of the units met; those met first wait in ``fresh`` for their values."""

    def __init__(self):
        super().__init__()
        self.old, self.fresh = {}, {}

    def __missing__(self, unit: str) -> list:
        if (found := self.old.get(unit)) is None:
            found = self.fresh[unit] = []
        self[unit] = found
        return found

    def forget(self) -> None:
        """Nothing is left, as after units without values."""
        self.clear()
        self.old, self.fresh = {}, {}

    def settle(self) -> None:
        """To be called when all units have values: long ones go, and the units of a full table become the old ones."""
        for u in [u for u in self.fresh if len(u) >= TABLE_CHARS]:
            del self[u]
        self.fresh = {}
        if len(self) > TABLE_UNITS:
            self.old = dict(self)
            self.clear()


class AgendaModel:
    """A BPE model of the sentencepiece library and the agenda encoder for it."""

    def __init__(self, path: str):
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.ids = {library.id_to_piece(i): i for i in normal}
        self.cost = {p: -library.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self._number()
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece holds white space after another character; units would not be independent")
        if library.encode(" a") != [*self.encode_unit(SPACE * 2 + "a")]:
            raise ValueError("the model normalises white space; this encoder serves models that keep it")
        self.table = Table()

    def _number(self) -> None:
        """Symbols as numbers: a piece is its id, other characters of pieces follow, the last is any other character."""
        size = self.library.get_piece_size()
        number = dict(self.ids)
        for c in sorted({*chain.from_iterable(self.ids)}):
            number.setdefault(c, size + len(number) - len(self.ids))
        self.size, self.other = size, size + len(number) - len(self.ids)
        self.characters = np.full(0x110000, self.other, np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.characters[ord(c)] = k
        # All ways to join two symbols to a piece, by both numbers; equal costs have equal ranks.
        ranks = {x: r for r, x in enumerate(sorted({*self.cost.values()}))}
        pairs = sorted((number[p[:k]] * (self.other + 2) + number[p[k:]], ranks[x], self.ids[p]) for p, x in self.cost.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair, self.rank, self.joined = np.array([*pairs, (NEVER, 0, 0)], np.int64).T.copy()
        self.rank <<= PLACE_BITS

    def _costs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each pair, without its place, and the number of the piece it gives."""
        key = left.astype(np.int64) * (self.other + 2) + right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], NEVER), self.joined[at]

    def encode_together(self, units: list[str]) -> list[tuple[int, ...]]:
        """``encode_unit`` of each of these units, of fewer than ``1 << PLACE_BITS`` - 2 characters."""
        out: list = [None] * len(units)
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        for start in range(0, len(units), TOGETHER):
            part = order[start : start + TOGETHER]
            for k, ids in zip(part, self._agendas([units[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _agendas(self, units: list[str]) -> list[tuple[int, ...]]:
        n, lengths = len(units), np.fromiter(map(len, units), np.int64, len(units))
        # A row for each place and one of no symbol at both ends, a column for each unit.
        none, rows = self.other + 1, int(lengths.max()) + 2
        places = np.arange(rows)
        by_unit = np.full((n, rows), none, np.int32)
        by_unit[(places > 0) & (places <= lengths[:, None])] = self.characters[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        symbols = by_unit.T.ravel()
        cost, joined = np.full((rows, n), NEVER), np.zeros((rows, n), np.int64)
        c, joined[:-1] = self._costs(symbols[:-n].reshape(-1, n), symbols[n:].reshape(-1, n))
        cost[:-1] = np.where(c < NEVER, c | places[:-1, None], NEVER)
        agenda, cost, joined = cost, cost.ravel(), joined.ravel()
        before, after = np.arange(-n, (rows - 1) * n), np.arange(n, (rows + 1) * n)
        while True:
            best = agenda.min(axis=0)
            column = np.flatnonzero(best < NEVER)
            if not len(column):
                break
            i = (best[column] & ((1 << PLACE_BITS) - 1)) * n + column
            j = after[i]
            h, k, piece = before[i], after[j], joined[i]
            symbols[i], symbols[j], cost[j] = piece, none, NEVER
            after[i], before[k] = k, i
            at = np.concatenate((i, h))
            c, joined[at] = self._costs(np.concatenate((piece, symbols[h])), np.concatenate((symbols[k], piece)))
            cost[at] = np.where(c < NEVER, c | at // n, NEVER)
        by_unit = np.ascontiguousarray(symbols.reshape(rows, n).T)
        left = by_unit != none
        ids, ends = by_unit[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        out = [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]
        for x in np.flatnonzero(((by_unit >= self.size) & left).any(axis=1)).tolist():
            # Characters that are no piece, still at their places, are written in bytes.
            at = np.flatnonzero(left[x]).tolist()
            out[x] = tuple(chain.from_iterable((s,) if s < self.size else [self.bytes[b] for b in units[x][p - 1].encode()] for s, p in zip(out[x], at, strict=True)))
        return out

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit, with its ``▁``."""
        cost, symbols, n = self.cost, list(unit), len(unit)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        push, pop = heapq.heappush, heapq.heappop
        agenda = [(cost[p], i, p) for i, p in enumerate(map(add, symbols, symbols[1:])) if p in cost]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = pop(agenda)
            left, j = symbols[i], after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != len(pair):
                continue  # one of the two was joined to another meanwhile
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := pair + symbols[k]) in cost:
                    push(agenda, (cost[p], i, p))
            if (h := before[i]) >= 0 and (p := symbols[h] + pair) in cost:
                push(agenda, (cost[p], h, p))
        out: list[int] = []
        for s in symbols:
            if s:
                out.append(i) if (i := self.ids.get(s)) is not None else out.extend(self.bytes[b] for b in s.encode())
        return tuple(out)

    def units(self, text: str) -> list[list]:
        """[ids, ids in decimal] of each unit; those of units not met before are empty until ``settle``.

        A unit is named by what follows its first ``▁``, or by all of it where it begins with a line break.
        """
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            names = [u[1:] if u[0] == SPACE else u for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]
        else:
            names = text.replace("\n", " \n").split(" ")
        return [*map(self.table.__getitem__, names)]

    def settle(self) -> None:
        """Encodes the units not met before and compares them with the library, which puts a ``▁`` before each."""
        fresh = self.table.fresh
        short = [u for u in fresh if len(u) < TABLE_CHARS]
        found = dict(zip(short, self.encode_together([u if u[:1] == "\n" else SPACE + u for u in short]), strict=True))
        for u, value in fresh.items():
            if (ids := found.get(u)) is None:
                ids = found[u] = self.encode_unit(u if u[:1] == "\n" else SPACE + u)
            value += ids, ",".join(map(str, ids))
        units = [u for u in fresh if u]  # the library gives an empty text no mark to encode
        theirs = self.library.encode([u.replace(SPACE, " ") for u in units], num_threads=1)
        mark = self.ids[SPACE]
        for u, ids in zip(units, theirs, strict=True):
            if tuple(ids) != (found[u] if u[0] != "\n" else (mark, *found[u])):
                raise ValueError(f"the agenda and the sentencepiece library differ on {u!r}")
        self.table.settle()


def model(path: str) -> AgendaModel:
    """The model of this path, loaded once per Python worker."""
    if path not in _models:
        _models[path] = AgendaModel(path)
    return _models[path]


def encode_texts(texts: list[str], path: str) -> list[list[list]]:
    """[ids, ids in decimal] of the units of each text, checked against the library."""
    m = model(path)
    try:
        out = [m.units(text) for text in texts]
        m.settle()
    except BaseException:
        m.table.forget()
        raise
    if texts and [*chain.from_iterable(map(itemgetter(0), out[0]))] != m.library.encode(texts[0]):
        raise ValueError("the agenda and the sentencepiece library differ on a whole text")
    return out


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document the ids' count and digest and the digest of the text they decode to; with ``with_ids`` also the ids
    (decimal, joined by commas) and the decoded text. No shuffle.
    """

    def rows(texts: list[str]) -> dict:
        m = model(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
        for units in encode_texts(texts, path):
            ids = [*chain.from_iterable(map(itemgetter(0), units))]
            written, decoded = ",".join([u[1] for u in units]), m.library.decode(ids) if ids else ""
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256(written.encode()).hexdigest())
            out["decoded_sha256"].append(sha256(decoded.encode()).hexdigest())
            if with_ids:
                out["ids"].append(written)
                out["decoded"].append(decoded)
        return out

    return per_document(docs, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids, doc_id, text)
