"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
MOST_WORDS = 600_000  # words remembered by a Python worker before it drops those met only once
MOST_PARTS = 100_000  # parts of words remembered beside them
# fixed value: the split of a text into parts that are encoded on their own
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# a cut before a space is a cut between parts unless the space stands between other white space
ODD = r"[\s\p{Z}\x{85}] [\s\p{Z}\x{85}]|[\s\p{Z}\x{85}] $|[\x1c-\x1f]|<\|"

SPACE, EMPTY = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts word by word; a word seen before costs one look-up.

    Parts of a text are encoded independently by this kind of vocabulary, and a new part
    starts wherever a space follows other text. So texts are cut at spaces, words are told
    apart in one vectorised step, and only words that are new to this worker are encoded by
    the library. Texts with odd white space or special strings go to it as a whole. The words
    themselves stay in Arrow: only new ones ever become Python strings.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = "".join(letter for _, letter in sorted(_byte_letters().items()))
        self.words = pa.array([], pa.large_string())  # by number
        self.parts: dict[str, tuple[int, ...]] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)  # batches of texts that held the word

    @property
    def known(self) -> list[str]:
        return self.words.to_pylist()

    def _forget(self) -> None:
        """Drops the words met in one batch only; all of them if too few are."""
        kept = np.flatnonzero(self.met > 1)
        if 2 * len(kept) > MOST_WORDS:
            kept = kept[:0]
        self.words = self.words.take(pa.array(kept))
        self.ids = self._ids_at(kept)[0]
        self.lengths = self.lengths[kept]
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.met = np.ones(len(kept), np.int32)

    def _ids_at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after another, and the words' bounds in them."""
        lengths = self.lengths[numbers]
        bounds = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=bounds[1:])
        at = np.repeat(self.starts[numbers] - bounds[:-1], lengths)
        at += np.arange(bounds[-1], dtype=np.int32)
        return self.ids[at], bounds

    def _part(self, part: str) -> tuple[int, ...]:
        word = charmap_decode(part.encode("utf-8"), "strict", self.letters)[0]
        ids = self.parts[part] = tuple([t.id for t in self.model.tokenize(word)])
        return ids

    def _learn(self, fresh: pa.Array) -> None:
        """Encodes words not seen before and numbers them on from the known ones."""
        words = fresh.to_pylist()
        seen, encode_part = self.parts.get, self._part
        flat: list[int] = []
        lengths: list[int] = []
        for word in words:
            before = len(flat)
            body = word[1:] if word[:1] == " " else word
            if body.isalpha():
                flat += seen(word) or encode_part(word)
            elif body[:-1].isalpha() and body[-1] in ".,":
                flat += seen(word[:-1]) or encode_part(word[:-1])
                flat += seen(body[-1]) or encode_part(body[-1])
            else:
                for part in PIECES.findall(word):
                    flat += seen(part) or encode_part(part)
            lengths.append(len(flat) - before)
        self.words = pa.concat_arrays([self.words, fresh])
        sizes = np.array(lengths, np.int32)
        ends = len(self.ids) + np.cumsum(sizes, dtype=np.int32)
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int32)])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of these distinct words; new ones are learnt."""
        found = pc.index_in(words, value_set=self.words)
        numbers = pc.fill_null(found, -1).to_numpy().copy()
        new = numbers < 0
        if new.any():
            numbers[new] = np.arange(len(self.words), len(self.words) + new.sum(), dtype=np.int32)
            self._learn(words.filter(pa.array(new)))
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the texts' offsets into them. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        plain, bounds = self._plain(texts.filter(pa.array(~odd)))
        strange = [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            for t in texts.filter(pa.array(odd)).to_pylist()
        ]
        pieces, a, b = [], iter(range(len(bounds) - 1)), iter(strange)
        for is_odd in odd:
            if is_odd:
                pieces.append(next(b))
            else:
                i = next(a)
                pieces.append(plain[bounds[i] : bounds[i + 1]])
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.words) > MOST_WORDS:
            self._forget()
        if len(self.parts) > MOST_PARTS:
            self.parts = {}
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        flat = split.flatten()
        coded, heads = flat.dictionary_encode(), flat.take(pa.array(bounds[:-1])).dictionary_encode()
        spaced = pc.binary_join_element_wise(SPACE, coded.dictionary, EMPTY)
        met = self._numbers(pa.concat_arrays([spaced, heads.dictionary]))
        self.met[met[: len(spaced)]] += 1
        numbers = met[coded.indices.to_numpy()]
        numbers[bounds[:-1]] = met[len(spaced) :][heads.indices.to_numpy()]
        ids, ends = self._ids_at(numbers)
        return ids, ends[bounds].astype(np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary, kept from task to task."""
    return Encoder(path)
