"""Byte-pair encoding by backtracking over longest token matches, and decoding through an offset table.

A token sequence is the byte-pair encoding of its bytes exactly when every token is its own encoding and every two neighbours
stay apart when their joined bytes are encoded. So the encoder takes, at each position, the longest token that an Aho-Corasick
automaton found there and that the pair table allows after the token before it; where none is allowed it takes shorter ones, or
goes back by a token. Positions that failed once are never tried again, which keeps the time linear in the length.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

# The split pattern of byte-level tokenizer files, with white space as Unicode defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct chunks whose ids a worker remembers, and as many that came before them; pairs likewise.
REMEMBERED = 300_000
#: Longer chunks are not remembered.
LONG_CHUNK = 64
#: Marks that are one piece together when they end a chunk; the apostrophe is not one of them.
MARKS = ".,;:!?*$%&|<>#@()[]{}=+-_/\\\"~^`"


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in vocabulary files: printable ones for themselves, the others from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """What encoding needs of a tokenizer file: bytes of every id, rank and result of every merge, added tokens."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        alphabet = byte_alphabet()
        ids = file["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.spelling = {i: bytes(alphabet[c] for c in token) for token, i in ids.items() if token not in self.added}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.single = [0] * 256
        for i, spelling in self.spelling.items():
            if len(spelling) == 1:
                self.single[spelling[0]] = i
        #: Tokens that are their own encoding; others never come out.
        self.own = [i for i, spelling in self.spelling.items() if self.merge(spelling) == [i]]

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the pair of least rank, leftmost first, until none is left. For short strings."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            ranked = [(self.merges[pair][0], k) for k, pair in enumerate(zip(ids, ids[1:])) if pair in self.merges]
            if not ranked:
                break
            k = min(ranked)[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids


class Encoder:
    """Encodes the pieces of a text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.spelling = vocabulary.spelling
        self.length = {i: len(s) for i, s in self.spelling.items()}
        self.id_of = {self.spelling[i]: i for i in vocabulary.own}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.automaton.add_word(s.decode("latin-1"), (len(s), i))
        self.automaton.make_automaton()
        self.most = max(map(len, self.id_of), default=0)
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[int, int | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        parts = {product: (rank, pair) for pair, (rank, product) in vocabulary.merges.items()}
        # Trained merges make a new token each, out of tokens made before.
        made = {t: r for t, (r, _) in parts.items()}
        self.regular = len(parts) == len(vocabulary.merges) and all(
            made.get(a, -1) < r and made.get(b, -1) < r for r, (a, b) in parts.values()
        )
        self.parts = parts

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at the left (0) or right (1) end of `token` while it is merged, each with the rank that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, at, until = [], token, float("inf")
            while at is not None:
                known.append((at, until))
                until, pair = self.parts.get(at, (0, (None, None)))
                at = pair[side]
            self.edges[side][token] = known
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether a|b, encoded together, is [a, b]: no merge across the border comes before those that bury its two sides."""
        if not self.regular:
            return self.vocabulary.merge(self.spelling[a] + self.spelling[b]) == [a, b]
        merges, right = self.vocabulary.merges, self.edge(b, 0)
        for x, until_x in self.edge(a, 1):
            for y, until_y in right:
                across = merges.get((x, y))
                # Of equal ranks the left one goes first.
                if across is not None and across[0] < until_x and across[0] <= until_y:
                    return False
        return True

    def allowed(self, a: int, b: int) -> bool:
        """The pair table, filled as pairs turn up."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.stay_apart(a, b)
        return known

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of `token`."""
        if token not in self.prefixes:
            s = self.spelling[token]
            self.prefixes[token] = next((self.id_of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.id_of), None)
        return self.prefixes[token]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.id_of.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        # Longest matches one after the other are mostly right already; go back only from where they are not.
        tokens = [match[1] for _, match in self.automaton.iter_long(text)]
        for k in range(1, len(tokens)):
            if not self.allowed(tokens[k - 1], tokens[k]):
                return self.backtrack(data, text, tokens[:k], tokens[k])
        return tokens

    def longest(self, data: bytes, text: str, at: int) -> int:
        """The longest token at a position."""
        k = self.automaton.longest_prefix(text[at : at + self.most])
        while (token := self.id_of.get(data[at : at + k])) is None:
            k -= 1
        return token

    def backtrack(self, data: bytes, text: str, tokens: list[int], token: int | None) -> list[int]:
        """Finish an encoding whose first `tokens` fit together; `token` is the longest match after them."""
        failed = set()
        at = sum([self.length[t] for t in tokens])
        n = len(data)
        while at < n:
            while token is not None:
                end = at + self.length[token]
                if end not in failed and (not tokens or self.allowed(tokens[-1], token)):
                    break
                token = self.shorter(token)
            if token is None:
                failed.add(at)
                token = tokens.pop()
                at -= self.length[token]
                token = self.shorter(token)
            else:
                tokens.append(token)
                at = end
                token = self.longest(data, text, at) if at < n else None
        return tokens


class _Chunks(dict):
    """Ids, as bytes, of the text between two spaces; words are remembered, other chunks are put together from them."""

    def __init__(self, coder: TextEncoder, lead: str):
        super().__init__()
        self.coder, self.lead, self.older = coder, lead, {}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters after at most one space are one piece
            ids = self.older.get(chunk)
            if ids is None:
                ids = array("I", self.coder.encoder.encode_piece((self.lead + chunk).encode("utf-8"))).tobytes()
            if len(chunk) <= LONG_CHUNK:
                if len(self) >= REMEMBERED:  # words seen since the last change stay at hand
                    self.older = dict(self)
                    self.clear()
                self[chunk] = ids
            return ids
        word = chunk.rstrip(MARKS)
        if word.isalpha():
            return self[word] + self.coder.mark(chunk[len(word) :])
        pieces = self._at_line_breaks(chunk)
        if len(pieces) == 1:
            return self.coder.split_and_encode(self.lead + chunk)
        out = [self[pieces[0]]]
        for piece in pieces[1:]:
            out += (self.coder.mark("\n"), self.coder.first[piece])
        return b"".join(out)

    @staticmethod
    def _at_line_breaks(chunk: str) -> list[str]:
        """The chunk cut at line breaks that are a piece of their own: after something other than white space, before a letter."""
        pieces, held = [], []
        for line in chunk.split("\n"):
            if held and line[:1].isalpha() and held[-1] and not held[-1][-1].isspace():
                pieces.append("\n".join(held))
                held = []
            held.append(line)
        return [*pieces, "\n".join(held)]


class TextEncoder:
    """Whole texts to ids (little-endian unsigned 32-bit, as bytes) and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoder = Encoder(vocabulary)
        self.pattern = regex.compile(SPLIT)
        self.added = vocabulary.added
        names = sorted(vocabulary.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.first, self.later = _Chunks(self, ""), _Chunks(self, " ")
        self.marks: dict[str, bytes] = {}
        last = max([*vocabulary.spelling, *vocabulary.added.values()], default=-1)
        parts = [vocabulary.spelling.get(i, b"") for i in range(last + 1)]
        for name, i in vocabulary.added.items():
            parts[i] = name.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def mark(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self.split_and_encode(marks)
            if len(self.marks) < REMEMBERED and len(marks) <= LONG_CHUNK:
                self.marks[marks] = ids
        return ids

    def split_and_encode(self, text: str) -> bytes:
        pieces = [self.encoder.encode_piece(piece.encode("utf-8")) for piece in self.pattern.findall(text)]
        return array("I", chain.from_iterable(pieces)).tobytes()

    def _encode_plain(self, text: str) -> bytes:
        # A single space before something else always starts a piece, so the text can be cut there and chunks be remembered.
        head, *chunks = text.split(" ")
        if "" in chunks or not head:
            return self.split_and_encode(text)
        return self.first[head] + b"".join(map(self.later.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added_pattern is None or not any(name in text for name in self.added):
            return self._encode_plain(text)
        ids = []
        for part in self.added_pattern.split(text):
            ids.append(array("I", [self.added[part]]).tobytes() if part in self.added else self.encode(part))
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, dtype="<u4")
        starts = self.offsets[tokens]
        lengths = self.offsets[tokens + 1] - starts
        ends = np.cumsum(lengths)
        where = np.repeat(starts - (ends - lengths), lengths)
        where += np.arange(len(where))
        return self.blob[where].tobytes().decode("utf-8", errors="replace")


_ENCODERS: dict[str, TextEncoder] = {}


def text_encoder(key: str, vocabulary) -> TextEncoder:
    """One encoder per worker process and broadcast vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(vocabulary.value)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; null texts are empty ones. No shuffle.

    `tokenizer` is the path of a byte-level tokenizer file on the driver; the vocabulary (tens of thousands of tokens, fixed) is
    broadcast. Added tokens in a text become their ids. Equal and empty texts, repeated and null ids give a row each.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = text_encoder(key, shared)
        for batch in batches:
            n, id_hash, text_hash = [], [], []
            for text in batch["text"]:
                ids = coder.encode(text or "")
                n.append(len(ids) // 4)
                id_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": id_hash, "decoded_sha256": text_hash})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
