"""Name similarity: a word-order-free ratio and a best-window ratio, both on the longest common subsequence.

ratio(a, b) = round(100 * 2 * LCS / (len(a) + len(b))), halves to the even number. For a row of two strings the ratio is a Column: one
row of the table as the bits of integers (Hyyro, 2004), in limbs of 62 bits with a carry, so strings of any length fit. For some strings
against many, ``NameIndex`` advances the bits of many pairs together. Letters in common, whatever their order, bound the subsequence from above;
they are counted for many strings at once, by a product of two tables that holds the letters a match needs as well, and only pairs that could
still pass are advanced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright.constants import VERSION_WORDS

LIMB = 62
_WORD = 64
# Columns that count shared letters; rarer letters share columns, which only loosens the bound.
_COLUMNS = 192
# From this number of strings on, shared letters are counted first.
_LEAST_COUNTED = 64
# A text that faces fewer strings is advanced together with others; pairs advanced at once.
_FEW, _AT_ONCE = 128, 8192


def sorted_words(name: Column) -> Column:
    """Lower-cased letters and digits, words in sorted order."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))
    return F.array_join(F.array_sort(F.split(plain, " ")), " ")


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _shifted(side: str, bits: Column, by: Column) -> Column:
    return F.call_function(f"shift{side}", bits, by)


def _percent(common: Column, lengths: Column) -> Column:
    return F.bround(200 * common / lengths, 0).cast("int")


def common_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two non-empty strings."""
    letters = _characters(a)
    limbs = F.sequence(F.lit(0), F.ceil(F.size(letters) / LIMB).cast("int") - 1)
    zero, one, full = (F.lit(x).cast("long") for x in (0, 1, (1 << LIMB) - 1))

    def of_limb(k: Column) -> Column:
        return F.slice(letters, k * LIMB + 1, LIMB)

    def masks(c: Column) -> Column:
        start = F.struct(zero.alias("mask"), one.alias("bit"))

        def mark(found: Column, x: Column) -> Column:
            return F.struct((found["mask"] + F.when(x == c, found["bit"]).otherwise(zero)).alias("mask"), (found["bit"] * 2).alias("bit"))

        return F.transform(limbs, lambda k: F.aggregate(of_limb(k), start, mark, lambda found: found["mask"]))

    def advance(row: Column, c: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("row"), zero.alias("carry"))

        def limb(made: Column, pair: Column) -> Column:
            bits, hit = pair["row"], pair["row"].bitwiseAND(pair["masks"])
            total = bits + hit + made["carry"]
            new = total.bitwiseAND(full).bitwiseOR(bits - hit)
            return F.struct(F.concat(made["row"], F.array(new)).alias("row"), F.shiftright(total, LIMB).alias("carry"))

        pairs = F.zip_with(row, masks(c), lambda bits, mask: F.struct(bits.alias("row"), mask.alias("masks")))
        return F.aggregate(pairs, start, limb, lambda made: made["row"])

    rows = F.aggregate(_characters(b), F.transform(limbs, lambda k: full), advance)
    kept = F.zip_with(rows, limbs, lambda bits, k: F.bit_count(bits.bitwiseAND(_shifted("left", one, F.size(of_limb(k))) - 1)))
    return F.size(letters) - F.aggregate(kept, F.lit(0), lambda x, y: x + y)


def sorted_ratio(a: Column, b: Column) -> Column:
    """Ratio of two strings that went through ``sorted_words``."""
    both = F.length(a) + F.length(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when((a == "") | (b == ""), 0).otherwise(_percent(common_length(a, b), both)))


def _word_masks(word: str) -> dict[str, int]:
    return {c: sum(1 << i for i, x in enumerate(word) if x == c) for c in word}


def _common_with(size: Column, masks: Column) -> Column:
    """Longest common subsequence of a text with a short word, given as the length of the word and its mask of each letter of the text."""
    full = _shifted("left", F.lit(1).cast("long"), size) - 1

    def advance(row: Column, mask: Column) -> Column:
        hit = row.bitwiseAND(mask)
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(masks, full, advance))


def version_word_ratio(name: Column, words: list[str] = VERSION_WORDS) -> Column:
    """Best ratio of the shorter of the name and a word that marks derived versions against the windows of that length in the longer.

    Of equal length, the windows are those of the word.
    """
    n, zero, best = F.length(name), F.lit(0).cast("long"), []
    for word in words:
        k = len(word)
        whole = F.create_map(*[F.lit(x) for c, m in _word_masks(word).items() for x in (c, F.lit(m).cast("long"))])
        letters = F.transform(_characters(name), lambda c: F.coalesce(F.element_at(whole, c), zero))

        def in_name(masks: Column, i: Column) -> Column:
            window = F.slice(masks, i, F.lit(k))
            return _percent(_common_with(F.lit(k), window), k + F.size(window))

        def in_word(masks: Column, i: Column) -> Column:
            size = F.least(n, k - i)
            full = _shifted("left", F.lit(1).cast("long"), size) - 1
            return _percent(_common_with(size, F.transform(masks, lambda m: _shifted("right", m, i).bitwiseAND(full))), n + size)

        def of_letters(masks: Column) -> Column:
            # A window that begins with no letter of the word is no better than the next one.
            begins = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(masks, i) != zero)
            long = F.coalesce(F.array_max(F.transform(begins, lambda i: in_name(masks, i))), F.lit(0))
            short = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: in_word(masks, i)))
            return F.when(n > k, long).otherwise(short)

        # The variable of a function keeps the letters, which are looked up once.
        best.append(F.get(F.transform(F.array(letters), of_letters), 0))
    return F.when(name.isNotNull(), F.when(n == 0, 0).otherwise(F.greatest(*best)))


class NameIndex:
    """Strings in a given order; finds those whose ratio with a string passes the threshold."""

    def __init__(self, texts: list[str], threshold: float):
        self.threshold = threshold
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        rows, codes = _letters_of(texts)
        place = np.arange(len(rows)) - (np.cumsum(self.lengths) - self.lengths)[rows]
        self.letters, kind = np.unique(codes, return_inverse=True)
        # Strings of as many machine words stand together: their places, and their masks by word and letter, the last of no letter.
        words, self.slot, self.groups = -(-self.lengths // _WORD), np.zeros(len(texts), dtype=np.int64), {}
        bits = (self.lengths % _WORD).astype(np.uint64)
        self.last = np.where(bits == 0, ~np.uint64(0), (np.uint64(1) << bits) - np.uint64(1))
        for n in np.unique(words[words > 0]):
            places = np.flatnonzero(words == n)
            self.slot[places] = np.arange(len(places))
            masks = np.zeros((n, len(self.letters) + 1, len(places)), dtype=np.uint64)
            own = words[rows] == n
            bit = np.uint64(1) << (place[own] % _WORD).astype(np.uint64)
            np.bitwise_or.at(masks, (place[own] // _WORD, kind[own], self.slot[rows[own]]), bit)
            self.groups[int(n)] = places, masks
        self._columns: np.ndarray | None = None

    def _passes(self, common: np.ndarray, places: np.ndarray | slice, length: np.ndarray | int) -> np.ndarray:
        lengths = self.lengths[places]
        return (np.rint(200 * common / (lengths + length)) > self.threshold) & (lengths > 0)

    def _count_letters(self) -> None:
        """The table of letters and occurrences, the most frequent ones first, with two more columns that hold what a match needs."""
        rows, letters = _numbered_letters(self.texts)
        self._columns, column, n = np.unique(letters, return_inverse=True, return_counts=True)
        self._column = np.empty(len(n), dtype=np.int64)
        self._column[np.argsort(-n, kind="stable")] = np.arange(len(n))
        # The rest shares the last quarter.
        shared = max(1, _COLUMNS // 4)
        self._column = np.where(self._column < _COLUMNS, self._column, _COLUMNS - 1 - self._column % shared)
        # A rounded ratio is above the threshold only from the half below the next whole number on.
        self._needed = (np.floor(self.threshold) + 0.5) / 200 * (1 - 1e-5)
        more = [np.ones(len(self.texts)), -self._needed * self.lengths]
        self._counts = _counted(rows, self._column[column], len(self.texts), min(len(n), _COLUMNS), more)

    def _shared(self, texts: list[str], begin: int, end: int, least: bool) -> np.ndarray:
        """Shared letters, with ``least`` less those that a match has at least."""
        if self._columns is None:
            self._count_letters()
        rows, letters = _numbered_letters(texts)
        column = np.searchsorted(self._columns, letters)
        known = np.append(self._columns, -1)[column] == letters
        lengths = np.array([len(t) for t in texts])
        more = [0.01 - self._needed * lengths, np.ones(len(texts))] if least else [np.zeros(len(texts))] * 2
        counts = _counted(rows[known], self._column[column[known]], len(texts), self._counts.shape[1] - 2, more)
        return counts @ self._counts[begin:end].T

    def letters_shared(self, texts: list[str], begin: int, end: int) -> np.ndarray:
        """At least the letters that each text has in common with the strings begin to end - 1, as often as both have them."""
        return self._shared(texts, begin, end, False)

    def _kinds(self, texts: list[str]) -> np.ndarray:
        """The number of each letter: a row per place in the text, a column per text; letters that the index lacks are its last number."""
        rows, codes = _letters_of(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        kind = np.searchsorted(self.letters, codes)
        kind[np.append(self.letters, -1)[kind] != codes] = len(self.letters)
        kinds = np.full((lengths.max(initial=0), len(texts)), len(self.letters), dtype=np.int64)
        kinds[np.arange(len(rows)) - (np.cumsum(lengths) - lengths)[rows], rows] = kind
        return kinds

    def _common(self, kinds: np.ndarray, some: list[np.ndarray]) -> np.ndarray:
        """Longest common subsequences of texts with strings of one machine word, given as places for each text."""
        masks, places, ends = self.groups[1][1][0], np.concatenate(some), np.cumsum([len(x) for x in some]).tolist()
        slots = self.slot[places]
        mask, hit, total = np.empty((3, len(places)), dtype=np.uint64)
        row = np.full(len(places), ~np.uint64(0))
        parts = []
        for text, begin, end in zip(kinds.T.tolist(), [0, *ends], ends):
            parts.append((mask[begin:end], {k: masks[k].take(slots[begin:end]) for k in set(text)}, text))
        for step in range(len(kinds)):
            for part, own, text in parts:
                part[:] = own[text[step]]
            np.bitwise_and(row, mask, out=hit)
            np.add(row, hit, out=total)
            np.bitwise_xor(row, hit, out=row)
            np.bitwise_or(row, total, out=row)
        return self._missing(row[None], places)

    def _common_pairs(self, kinds: np.ndarray, rows: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
        """Longest common subsequences of pairs of a text and a string of that many machine words."""
        masks, slots = self.groups[words][1], self.slot[places]
        kinds, masks = kinds * masks.shape[2], masks.reshape(words, -1)
        row = np.full((words, len(places)), ~np.uint64(0))
        for kind in kinds:
            at = kind.take(rows)
            at += slots
            for w in range(words):
                hit = masks[w].take(at)
                hit &= row[w]
                total = row[w] + hit
                if w:
                    total += carry
                if w + 1 < words:
                    over = total < hit
                    carry = (over | ((total == hit) & (carry > 0)) if w else over).astype(np.uint64)
                row[w] ^= hit
                row[w] |= total
        return self._missing(row, places)

    def _missing(self, row: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The bits of the strings' letters that are not set; the words are full but for the last."""
        last = np.bitwise_count(row[-1] & self.last[places])
        return self.lengths[places] - (last if len(row) == 1 else last + np.bitwise_count(row[:-1]).sum(axis=0, dtype=np.int64))

    def matches(self, texts: list[str], begin: int, end: int, near: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of texts, places): every match among the strings begin to end - 1, some at a time; an empty string matches none.

        ``near`` has a row per text, true at the strings that may match; by default those with enough letters in common.
        """
        if begin >= end or not texts:
            return
        if near is None and end - begin < _LEAST_COUNTED:
            near = np.ones((len(texts), end - begin), dtype=bool)
        near = self._shared(texts, begin, end, True) >= 0 if near is None else near
        kinds, lengths = self._kinds(texts), np.array([len(t) for t in texts], dtype=np.int64)
        near[lengths == 0] = False
        near[:, self.lengths[begin:end] == 0] = False
        pairs = []
        for words, (places, _) in self.groups.items():
            if words > 1:
                places = places[slice(*np.searchsorted(places, [begin, end]))]
                rows, column = np.nonzero(near[:, places - begin])
                near[:, places - begin] = False
                pairs.append((words, rows, places[column]))
        few, many, faced = [], [], 0
        for i in range(len(texts)):
            places = begin + np.flatnonzero(near[i])
            if len(places) < _FEW:
                few.append((i, places))
            else:
                many.append((i, places))
                faced += len(places)
            if many and (faced >= _AT_ONCE or i + 1 == len(texts)):
                rows, some = np.repeat([i for i, _ in many], [len(x) for _, x in many]), [x for _, x in many]
                common, places = self._common(kinds[:, [i for i, _ in many]], some), np.concatenate(some)
                hit = self._passes(common, places, lengths[rows])
                if hit.any():
                    yield rows[hit], places[hit]
                many, faced = [], 0
        if few:
            pairs.append((1, np.repeat([i for i, _ in few], [len(places) for _, places in few]), np.concatenate([places for _, places in few])))
        for words, rows, places in pairs:
            for at in range(0, len(rows), _AT_ONCE):
                own, some = rows[at : at + _AT_ONCE], places[at : at + _AT_ONCE]
                hit = self._passes(self._common_pairs(kinds, own, some, words), some, lengths[own])
                if hit.any():
                    yield own[hit], some[hit]

    def first(self, text: str, begin: int, end: int, shared: np.ndarray | None = None) -> int | None:
        """Place of the first match among the strings begin to end - 1; ``shared`` is the text's row of ``letters_shared`` for these."""
        near = None if shared is None else self._passes(shared, slice(begin, end), len(text))[None]
        return min((int(places.min()) for _, places in self.matches([text], begin, end, near)), default=None)


def _letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts one after the other, as (number of the text, code point)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.repeat(np.arange(len(texts)), [len(t) for t in texts]), codes


def _numbered_letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, each with the number of its earlier occurrences in its text: (number of the text, letter and occurrence)."""
    rows, codes = _letters_of(texts)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    begins = np.append(True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1]))[: len(rows)]
    starts = np.flatnonzero(begins)
    return rows, (codes << 32) + np.arange(len(rows)) - starts[np.cumsum(begins) - 1]


def _counted(rows: np.ndarray, column: np.ndarray, n_rows: int, n_columns: int, more: list[np.ndarray]) -> np.ndarray:
    """How often each row names each column, and ``more`` columns."""
    counts = np.zeros((n_rows, n_columns + len(more)), dtype=np.float32)
    np.add.at(counts, (rows, column), 1)
    counts[:, n_columns:] = np.stack(more, axis=1)
    return counts
