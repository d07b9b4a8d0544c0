"""Token ids of whole texts, asking the tokenizers library once per distinct unit.

A unit is a run of non-blank characters with the one blank before it.  The byte-level
pre-tokenizer never joins pieces across such units, so a text's ids are those of its
units, one after the other.  Words repeat, texts do not: each Python worker keeps the ids
of the units it has met and calls the library for new ones only.  Arrow cuts texts into units
and tells a slice's distinct ones, which alone become Python strings.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already

from tokenizers import Tokenizer  # noqa: E402

#: Unicode white space as the byte-level pattern's ``\s`` has it.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_RARE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\x0b", "\x0c")
#: Distinct units of a generation.  A worker keeps two; when the young one is full the old
#: one is forgotten, but for what has been met again since.
MAX_UNITS = 500_000
#: New units that the library is given as one text.
JOINED = 500
#: Texts that the library is given at once: what it returns takes far more memory than ids.
LOTS = 32
#: Characters of text whose units are looked up at once.
_SLICE = 3 << 20
#: The first character of a unit that no blank precedes, and of one that is taken as it is.
_NO_BLANK, _AS_IT_IS = "\x0b", " "
#: Kinds of units: after a blank, of letters with other signs behind them, and by the first character.
_PLAIN, _SIGNED, _AFTER_FEED, _BARE, _VERBATIM = range(5)
_MARKS = {"\n": _AFTER_FEED, _NO_BLANK: _BARE, _AS_IT_IS: _VERBATIM}
#: Letters before this one are letters to the library too, whatever its version of Unicode.
_NEWER = "\u0250"


def _kind(unit: str) -> int:
    if not unit[-1].isalnum():
        word = unit.rstrip(string.punctuation)
        if len(word) < len(unit) and word.isalpha() and (word.isascii() or max(word) < _NEWER):
            return _SIGNED  # the pre-tokenizer cuts letters from signs, which are one piece
    return _MARKS.get(unit[0], _PLAIN)


class _Units:
    """Units with their ids."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, numbers: np.ndarray, flat: np.ndarray, counts: np.ndarray, skip: int | np.ndarray = 0) -> None:
        """The ids of the numbered units, one after the other, without the first ``skip`` of each."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.index) > len(self.count):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.count[numbers] = counts - skip
        self.start[numbers] = self.used + np.cumsum(counts) - counts + skip
        self.used += len(flat)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered units, one after the other, and how many each has."""
        counts = self.count[numbers]
        where = np.repeat(self.start[numbers] - np.cumsum(counts) + counts, counts)
        where += np.arange(len(where))
        return self.ids[where], counts


class UnitEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                        and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and not spec["model"].get("dropout"))
        # How many bytes of text an id stands for; every sign of the byte-level alphabet is one.
        self.bytes = np.zeros(self.vocabulary, np.int64)
        added = self.tokenizer.get_added_tokens_decoder()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(token.encode()) if i in added else len(token)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.young = self.old = _Units()

    def units(self, text: str) -> list[str] | None:
        """The text's units, or nothing if it is cut at its single blanks and before its line
        feeds.  A unit without a mark stands for one after a single blank or, if it starts with
        a line feed, for itself."""
        if any(s in text for s in _RUNS) or text[0].isspace() or text[-1].isspace() \
                or not text.isascii() and _RARE_BLANK.search(text):
            return [_AS_IT_IS + u if u.isspace() else u[1:] if u[0] == " " else _NO_BLANK + u for u in _UNITS.findall(text)]
        return None

    def _numbers(self, units: np.ndarray) -> np.ndarray:
        """The young generation's numbers of distinct units."""
        numbers = np.fromiter(map(self.young.index.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._learn(units[new])
        return numbers

    def _learn(self, units: np.ndarray) -> np.ndarray:
        """Numbers for units met for the first time, with ids from the old generation, from a
        word and the signs behind it, or from the library."""
        index = self.young.index
        own = numbers = np.arange(len(index), len(index) + len(units))
        index.update(zip(units, own.tolist()))
        if self.old is not self.young:
            known = np.fromiter(map(self.old.index.get, units, repeat(-1)), np.int64, len(units))
            met = known >= 0
            self.young.add(numbers[met], *self.old.ids_of(known[met]))
            numbers, units = numbers[~met], units[~met]
        kinds = np.fromiter(map(_kind, units), np.uint8, len(units))
        for kind, blank in ((_PLAIN, " "), (_AFTER_FEED, "")):
            self._ask(numbers[kinds == kind], units[kinds == kind].tolist(), blank)
        # A line feed, whose id is left out, keeps units apart that no blank precedes.
        self._ask(numbers[kinds == _BARE], ["\n" + u[1:] for u in units[kinds == _BARE]], "", len(self.feed))
        self.young.add(numbers[kinds == _VERBATIM], *self._one_by_one([u[1:] for u in units[kinds == _VERBATIM]]))
        pieces = [p for u in units[kinds == _SIGNED] for word in [u.rstrip(string.punctuation)]
                  for p in (word, _NO_BLANK + u[len(word):])]
        if pieces:
            place = dict(zip(dict.fromkeys(pieces), count()))
            found = self._numbers(np.array(list(place), object))
            flat, counts = self.young.ids_of(found[np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))])
            self.young.add(numbers[kinds == _SIGNED], flat, counts.reshape(-1, 2).sum(axis=1))
        return own

    def _ask(self, numbers: np.ndarray, units: list[str], blank: str, skip: int = 0) -> None:
        """Learn units from the library, each after ``blank``.  They are joined, as the
        pre-tokenizer joins nothing to a blank or line feed before it; the ids' lengths in
        bytes tell where each ends.  A text whose ids do not end there is asked unit by unit."""
        lots = [units[a:a + JOINED] for a in range(0, len(units), JOINED)]
        texts = [blank + blank.join(lot) for lot in lots]
        counts = [np.zeros(0, np.int64)]
        parts = [np.zeros(0, np.uint32)]
        for lot, text, ids in zip(lots, texts, self._library(texts)):
            ids = np.array(ids, np.uint32)
            sizes = map(len, lot) if text.isascii() else (len(u.encode()) for u in lot)
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(lot)) + len(blank))
            reached = np.cumsum(self.bytes[ids])
            cut = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and (reached[cut] == ends).all():
                counts.append(np.diff(cut + 1, prepend=0))
            else:
                ids, sizes = self._one_by_one([blank + u for u in lot])
                counts.append(sizes)
            parts.append(ids)
        self.young.add(numbers, np.concatenate(parts), np.concatenate(counts), skip)

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        for a in range(0, len(texts), LOTS):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[a:a + LOTS], add_special_tokens=False))

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(self._library(texts))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32), counts

    def _coded(self, units: pa.Array) -> np.ndarray:
        if len(self.young.index) > MAX_UNITS:
            self.old, self.young = self.young, _Units()
        coded = units.dictionary_encode()
        return self._numbers(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]

    def _plain(self, text: str) -> bool:
        return not self.by_unit or any(s in text for s in self.special)

    def _slices(self, texts: list[str]) -> Iterator[tuple[list[str], list[int], np.ndarray, np.ndarray]]:
        """Consecutive texts with the places among them of those that are put together from
        units, how many units each of these has, and all their units' numbers."""
        at = 0
        while at < len(texts):
            even, odd, own, size, start = [], [], [], 0, at
            while at < len(texts) and size < _SLICE:
                text = texts[at]
                size += len(text)
                if text and not self._plain(text):
                    units = self.units(text)
                    if units is None:
                        even.append(at - start)
                    else:
                        odd.append(at - start)
                        own.append(units)
                at += 1
            lot = texts[start:at]
            cut = pc.split_pattern(pc.replace_substring(pa.array([_NO_BLANK + lot[k] for k in even], pa.string()), "\n", " \n"), " ")
            units = pa.concat_arrays([cut.flatten(), pa.array(chain.from_iterable(own), pa.string())])
            sizes = np.concatenate([pc.list_value_length(cut).to_numpy(), np.fromiter(map(len, own), np.int64, len(own))])
            yield lot, even + odd, sizes, self._coded(units)  # may start a generation

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for lot, places, sizes, numbers in self._slices(texts):
            found = np.full(len(lot), -1, np.int64)
            sums = np.concatenate([[0], np.cumsum(self.young.count[numbers])])
            ends = np.cumsum(sizes)
            found[places] = sums[ends] - sums[ends - sizes]
            for k in np.flatnonzero(found < 0):
                found[k] = len(self._whole(lot[k]))
            out.append(found)
        return np.concatenate([np.zeros(0, np.int64), *out])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for lot, places, sizes, numbers in self._slices(texts):
            ids, counts = self.young.ids_of(numbers)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(sizes)]
            found = dict(zip(places, np.split(ids, ends[:-1])))
            for k, text in enumerate(lot):
                yield found[k] if k in found else np.array(self._whole(text), np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """This process's encoder for a vocabulary file."""
    return UnitEncoder(path)
