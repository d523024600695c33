"""Exact BPE encoding by per-prefix dynamic programming, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_STEP, Words, steps, tidy

END = "\x00"  # stands for the end-of-word suffix inside the automaton
#: Printable ASCII needs no Unicode tables: the pre-tokenizer's rule restated for it.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """A BPE vocabulary with an end-of-word suffix, read from a tokenizer file; its ids follow merge order above the single characters."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.library = Tokenizer.from_file(path)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # two ids -> (rank, merged id)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y = self.ids[a], self.ids[b]
            merged = self.ids[a + b]
            self.pairs.setdefault((x, y), (rank, merged))
            self.halves.setdefault(merged, (x, y))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            inner = s[: -len(self.suffix)] + END if s.endswith(self.suffix) and s != self.suffix else s
            self.automaton.add_word(inner, (i, len(inner)))
        self.automaton.make_automaton()
        self.rank = {m: self.pairs[h][0] for m, h in self.halves.items()}
        self.fits: dict[int, bool] = {}
        self.canonical: dict[int, bool] = {}
        self.byte_chars = _byte_alphabet()

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE over the joined text of two tokens gives back these two: no merge across their border comes before the border parts are built."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Walk back in time: undo the later of the two border tokens, and see at each moment whether the border pair had merged first.
        whole = 1 << 60
        made_a, made_b = self.rank.get(a, -1), self.rank.get(b, -1)
        until = whole  # a border pair that exists merges if its rank is below this moment
        while True:
            found = self.pairs.get((a, b))
            if found is not None and found[0] < until:
                return False
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b or (made_a == made_b and made_a >= 0):
                # at equal rank merges run left to right: the left token was built first, so undo the right one first
                if made_a == made_b:
                    until, b = made_b, self.halves[b][0]
                    made_b = self.rank.get(b, -1)
                else:
                    until, a = made_a, self.halves[a][1]
                    made_a = self.rank.get(a, -1)
            else:
                until, b = made_b + 1, self.halves[b][0]
                # the pair (a, left half of b) stood until b was built; it merges first at an equal rank only if it starts further left
                made_b = self.rank.get(b, -1)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token (in byte characters). last[i] is the only token that can end the exact encoding of the first i characters. The automaton's
        matches come by their ends and are used at once, so a very long word takes eight bytes a character."""
        text = word + END
        n = len(text)
        if n == 2:
            return [self.ids[word + self.suffix]]
        last, back = ([-1] * (n + 1), [0] * (n + 1)) if n < 4096 else (array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1))
        fits, whole = self.fits, self.canonical
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            # the last character is one symbol with its suffix, so no token ends between them
            if last[end] >= 0 or end == n - 1:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                good = fits.get(before << 32 | token)
                if good is None:
                    good = self.compatible(before, token)
            else:
                good = whole.get(token)
                if good is None:
                    good = self._canonical(token)
            if good:
                last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _canonical(self, token: int) -> bool:
        """Whether BPE over a token's own text gives the token: its halves must be compatible up to their own merge."""
        known = self.canonical.get(token)
        if known is None:
            half = self.halves.get(token)
            known = self.canonical[token] = half is None or (self._canonical(half[0]) and self._canonical(half[1]) and self._until(half, self.rank[token]))
        return known

    def _until(self, half: tuple[int, int], rank: int) -> bool:
        saved = self.pairs.pop(half)
        try:
            return self._compatible(*half)
        finally:
            self.pairs[half] = saved

    def pretokens(self, chunk: bytes) -> list[str]:
        """Pre-tokens of a text piece between ASCII white space, as byte characters."""
        if chunk.isascii() and (plain := chunk.decode("ascii")).isprintable():
            return ASCII_WORDS.findall(plain.lower())
        text = self.library.normalizer.normalize_str(chunk.decode("utf-8"))
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_chunk(self, chunk: bytes, words: Recent) -> list[int]:
        parts = [chunk]
        if self.added_split is not None and b"<|" in chunk:
            parts = [p.encode() for p in self.added_split.split(chunk.decode("utf-8")) if p]
        out: list[int] = []
        for part in parts:
            special = self.added.get(part.decode("utf-8")) if len(parts) > 1 or b"<|" in part else None
            if special is not None:
                out.append(special)
                continue
            for word in self.pretokens(part):
                out += words[word]
        return out


class Recent(dict):
    """make(key), kept in two generations of `room` entries each: a full one becomes the old one, from which keys that are met again come back. So what is
    frequent stays, and memory is bounded; keys of over LONGEST characters are not kept."""

    LONGEST = 64

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.LONGEST:
                return found
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


def _byte_alphabet() -> dict[int, str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LOADED: dict[str, tuple[Vocabulary, Recent]] = {}


def loaded(path: str) -> tuple[Vocabulary, Recent]:
    """A worker's vocabulary and its cache of words."""
    if path not in _LOADED:
        vocabulary = Vocabulary(path)
        _LOADED[path] = (vocabulary, Recent(vocabulary.encode_word, 350_000))
    return _LOADED[path]


_CHUNKS: dict[str, Recent] = {}


def chunks(path: str) -> Recent:
    """chunk -> (number of ids, the ids as decimal text, the tokens' strings in UTF-8), a space before each id and string."""
    if path not in _CHUNKS:
        vocabulary, words = loaded(path)
        decimal, names = ({i: f" {t}".encode() for i, t in texts} for texts in (((i, i) for i in vocabulary.names), vocabulary.names.items()))
        joined = b"".join

        def make(chunk: bytes) -> tuple[int, bytes, bytes]:
            ids = vocabulary.encode_chunk(chunk, words)
            return len(ids), joined(map(decimal.__getitem__, ids)), joined(map(names.__getitem__, ids))

        _CHUNKS[path] = Recent(make, 250_000)
    return _CHUNKS[path]


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, one row per input row.

    Null and empty texts encode to no ids (digests of the empty string). Special tokens in a text are recognised as such. A narrow map over the
    input: no shuffle, memory bounded by one text and the caches; repeated rows and null ids pass through."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(path)
        for batch in steps(batches, text_col, WORD_STEP):
            words = Words(batch.column(text_col))
            found = [known[c] for c in words.distinct]
            counts = np.append(0, np.cumsum(np.array([f[0] for f in found], dtype=np.int64)[words.codes.to_numpy()]))[words.bounds]
            digests = []
            for k in (1, 2):
                blob, at = words.joined([f[k] for f in found])
                at = at.tolist()
                digests.append(pa.array([hashlib.sha256(blob[a + 1 : b] if b > a else b"").hexdigest() for a, b in zip(at, at[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(np.diff(counts)), *digests], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(text: str | None, vocabulary: str | None = None) -> list[int]:
    """Ids of one text."""
    path = vocabulary or default_vocabulary()
    v, words = loaded(path)
    out: list[int] = []
    for chunk in (text or "").encode().split():
        out += v.encode_chunk(chunk, words)
    return out


def decode(ids: list[int], vocabulary: str | None = None) -> str:
    """The tokens' strings joined by a space, as a tokenizer without a decoder does; unknown ids are left out."""
    names = loaded(vocabulary or default_vocabulary())[0].names
    return " ".join(names[i] for i in ids if i in names)
