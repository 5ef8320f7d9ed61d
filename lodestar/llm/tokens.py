"""Exact encoding of whole texts with a public tokenizer, remembering the ids of units that recur.

A byte-pair tokenizer cuts a text into units by a pattern before any merge, so equal units have equal ids. Texts
made of plain Latin letters, digits and common signs are cut here by the same pattern, and only units not seen
before go to the tokenizer. Most of those need no pattern: arrays of code points tell where classes of letters
change, and a unit is known by a 64-bit hash that prefix sums give for all units of a batch at once. Any other
text goes to the tokenizer whole. What is remembered is bounded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r -~{_L}¡¿«»‘’“”–—…€]*")
_UNITS = {
    "byte_bpe_50k.json": re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+"),
    "word_bpe_49k.json": re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[0-9]|[^\s{_L}0-9]+"),
}
_FOLDED = {"word_bpe_49k.json"}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(0x100 + i) for i in range(256))
    return {b: chr(b) if b in own else next(rest) for b in range(256)}


_LETTERS = _byte_letters()
#: Units remembered in one worker, characters encoded at once, and the longest unit that is known by its hash.
REMEMBER, AT_ONCE, LONGEST = 200_000, 200_000, 200
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_CODES = 0x2100


def _classes() -> np.ndarray:
    """Letters 1, digits 2, signs 3, space 4, line feed 5."""
    out = np.full(_CODES, 3, np.uint8)
    for c in range(_CODES):
        if re.fullmatch(f"[{_L}]", chr(c)):
            out[c] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[ord(" ")], out[ord("\n")] = 4, 5
    return out


class _Store:
    """Ids of numbered units in one array."""

    def __init__(self, model):
        self.model, self.count, self.used = model, 0, 0
        self.offset = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)

    def add(self, units: list[str]) -> None:
        """Number units on. A unit needs no cutting, so the library's model takes it in the letters that stand for bytes."""
        merge, letters = self.model.tokenize, _LETTERS
        got = [[t.id for t in merge(u.encode().decode("latin-1").translate(letters))] for u in units]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        first, total = self.count, int(lengths.sum())
        self.count += len(units)
        while self.count > len(self.length):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.length[first : self.count] = lengths
        self.offset[first : self.count] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
        self.used += total

    def cut_back(self, count: int) -> None:
        """The units met first, which hold the frequent ones, stay."""
        if count < self.count:
            self.count = count
            self.used = int(self.offset[count - 1] + self.length[count - 1]) if count else 0

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of units, and the end of each unit's."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths, dtype=np.int32)
        where = np.repeat(self.offset[numbers] - (ends - lengths), lengths)
        where += np.arange(len(where), dtype=np.int32)
        return self.flat[where], ends


class Encoder:
    """ids of texts as the tokenizers library gives them with add_special_tokens=False."""

    def __init__(self, file: str, directory: str | None = None, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if directory is None:
            import public_tokenizers

            path = public_tokenizers.path(file)
        else:
            path = os.path.join(directory, file)
        self.tokenizer = Tokenizer.from_file(path)
        # The library finds special tokens in a text before any cut, so a text that holds one goes to it whole.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.units = _UNITS.get(file)
        self.fold = file in _FOLDED
        self.remember = remember
        self.by_hash, self.by_text = _Store(self.tokenizer.model), _Store(self.tokenizer.model)
        self.memo: dict[str, int] = {}
        self.shift = 64 - max(8, (2 * remember).bit_length())
        self.keys = np.zeros(1 << (64 - self.shift), np.uint64)
        self.values = np.zeros(len(self.keys), np.int32)
        self.known = 0
        n = 2 * AT_ONCE + 2
        self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.classes = _classes()
        self.noise = np.random.default_rng(41).integers(1, _MASK, _CODES, np.uint64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for those not known."""
        out = np.full(len(h), -1, np.int32)
        at, slot, mask = np.arange(len(h)), (h >> np.uint64(self.shift)).astype(np.int64), len(self.keys) - 1
        while len(at):
            key = self.keys[slot]
            hit = key == h[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            at, slot = at[on], (slot[on] + 1) & mask
        return out

    def _keep(self, h: np.ndarray, first: int) -> None:
        h = h[: max(0, self.remember - self.known)]
        self.known += len(h)
        at, slot, mask = np.arange(len(h)), (h >> np.uint64(self.shift)).astype(np.int64), len(self.keys) - 1
        while len(at):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)  # of those that want a slot, one gets it
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = h[at[won]], first + at[won]
            lost = np.ones(len(at), bool)
            lost[won] = False
            at, slot = at[lost], (slot[lost] + 1) & mask

    def _runs(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of simple texts, whose units are runs of one class. A text with a unit too long to go by its hash is matched."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        kind = self.classes[code]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        # A space belongs to what follows; where spaces are dropped, every digit is a unit.
        edge = (kind != before) | (kind == 2) if self.fold else (kind >= 4) | ((kind != before) & (before != 4))
        edge[starts[sizes > 0]] = True
        at = np.flatnonzero(edge)
        ends = np.append(at[1:], len(code))
        if self.fold:
            own = kind[at] <= 3
            at, ends = at[own], ends[own]
        if len(long := at[ends - at > LONGEST]):
            apart = set((np.searchsorted(starts, long, side="right") - 1).tolist())
            rest = iter(self._runs([t for i, t in enumerate(texts) if i not in apart]))
            return [self._matched(t) if i in apart else next(rest) for i, t in enumerate(texts)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.noise[code] * self.powers[: len(code)], dtype=np.uint64)])
        h = (sums[ends] - sums[at]) * self.inverses[at]
        h[h == 0] = 1
        numbers = self._find(h)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, first, same = np.unique(h[new], return_index=True, return_inverse=True)
            base = self.by_hash.count
            self.by_hash.add([joined[at[i] : ends[i]] for i in new[first]])
            numbers[new] = base + same
            self._keep(fresh, base)
        ids, stops = self.by_hash.ids(numbers)
        self.by_hash.cut_back(self.known)
        bounds = np.concatenate([[0], stops])[np.searchsorted(at, np.append(starts, len(code)))]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _matched(self, text: str) -> np.ndarray:
        """Ids of a plain text whose units the pattern has to find."""
        units = self.units.findall(text)
        fresh = list(dict.fromkeys(u for u in units if u not in self.memo))
        for i, u in enumerate(fresh):
            self.memo[u] = self.by_text.count + i
        if fresh:
            self.by_text.add(fresh)
        ids, _ = self.by_text.ids(np.fromiter((self.memo[u] for u in units), np.int32, len(units)))
        for u in reversed(fresh):
            if len(self.memo) <= self.remember // 4:
                break
            del self.memo[u]
        self.by_text.cut_back(len(self.memo))
        return ids

    def _simple(self, t: str) -> bool:
        return len(t) <= AT_ONCE and "'" not in t and "\t" not in t and "\r" not in t and (self.fold or not ("  " in t or "\n\n" in t or " \n" in t or "\n " in t))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32; null is the empty text."""
        out: list[np.ndarray | None] = []
        simple: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for (i, _), ids in zip(simple, self._runs([t for _, t in simple])):
                out[i] = ids
            simple.clear()
            size = 0

        for text in texts:
            t = text or ""
            if self.units is None or not _PLAIN.fullmatch(t) or self.special and self.special.search(t):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            t = t.lower() if self.fold else t
            if self._simple(t):
                simple.append((len(out), t))
                out.append(None)
                size += len(t)
                if size > AT_ONCE:
                    flush()
            else:
                out.append(self._matched(t))
        flush()
        return out
