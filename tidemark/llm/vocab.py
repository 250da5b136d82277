"""Byte-pair vocabularies read from public tokenizer files (their path is a parameter), and exact merging of many words at once."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

NO_RANK = np.int32(2**31 - 1)
_SHIFT = 17  # ids are below 2**17


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and the texts of ids of a tokenizers .json file of kind BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = [""] * (1 + max([*ids.values(), *self.specials.values()]))
        for text, i in [*ids.items(), *self.specials.items()]:
            self.texts[i] = text
        letters = byte_letters()
        self.byte_id = np.array([ids[c] for c in letters], np.int32)
        self.last_id = np.array([ids[c + self.end] for c in letters], np.int32)
        self.pair_rank = {ids[a] << _SHIFT | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self._table()

    def _table(self) -> None:
        """An open-addressing table of the pairs, for lookups of whole arrays."""
        bits = 20
        self._bits = np.uint64(64 - bits)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NO_RANK, np.int32)
        for key, rank in self.pair_rank.items():
            slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits)
            while self._keys[slot] >= 0:
                slot = slot + 1 & (1 << bits) - 1
            self._keys[slot], self._ranks[slot] = key, rank

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._bits).astype(np.int64)
        found = self._keys[slot]
        out = np.where(found == keys, self._ranks[slot], NO_RANK)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while rest.size:
            slot[rest] = slot[rest] + 1 & len(self._keys) - 1
            found = self._keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self._ranks[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each non-empty word, one after another, and where each word's ids begin (with the total at the end).

        Every round merges all occurrences of each word's lowest-ranked pair; a merge always outranks those that made its parts,
        so this equals popping one pair at a time.
        """
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.byte_id[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last_id[flat[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while sym.size:
            keys = np.empty(sym.size, np.int64)
            keys[:-1] = sym[:-1].astype(np.int64) << _SHIFT | sym[1:]
            rank = np.full(sym.size, NO_RANK, np.int32)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner] = self.ranks_of(keys[inner])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, sym.size]))
            over = best == NO_RANK
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                sym, word, rank, best = sym[live], word[live], rank[live], best[live]
                if not sym.size:
                    break
            hit = np.flatnonzero(rank == best)
            # of overlapping occurrences (aaa), the leftmost are merged: every second one of a run
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(np.arange(hit.size) - np.repeat(run, np.diff(np.r_[run, hit.size]))) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stay = np.ones(sym.size, bool)
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        ids, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library on one thread, as a task has one core; truncation and padding off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _simple_classes() -> tuple[str, str]:
    """Letters and numbers below U+0250, as the inside of a character class."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x250)]
    return tuple("".join(re.escape(chr(c)) for c in range(0x250) if kinds[c] == k) for k in "LN")


LETTERS, NUMBERS = _simple_classes()
#: The pre-splitting rule of lower-cased word vocabularies, and of byte-level ones, over characters below U+0250.
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Text with other characters is composed, lower-cased and split by the library: there Unicode versions matter. U+0130 lower-cases to two
#: characters; U+001C to U+001F are white space to Python alone.
ODD = re.compile("[ɐ-\U0010ffffİ\x1c-\x1f]")
_INNER = re.compile(r"[\S\x1c-\x1f]+")
_LETTER_BYTES = {c: b for b, c in enumerate(byte_letters())}


class WordCoder:
    """Exact ids of texts under a lower-casing word-end BPE vocabulary, resolved once for each distinct white-space chunk.

    White space is never part of a piece, and neither composition nor lower-casing reaches across it, so a text's ids are those of
    its chunks in order. Special strings are chunks of their own. Every other chunk's pieces come from the lexicon or are merged here,
    in any script; the library only composes, lower-cases and splits chunks with characters from U+0250 on.
    """

    def __init__(self, path: str, lexicon=None):
        self.vocab, self.path, self.lexicon = vocabulary(path), path, lexicon
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.vocab.specials, key=len, reverse=True))) + ")")

    def chunks(self, text: str) -> list[str]:
        """A text's special strings and what stands between white space, in order."""
        if "<|" in text and self.special.search(text):
            return [c for i, part in enumerate(self.special.split(text)) for c in ([part] if i % 2 else self._spaced(part))]
        return self._spaced(text)

    @staticmethod
    def _spaced(text: str) -> list[str]:
        return _INNER.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def pieces(self, chunk: str) -> list[bytes]:
        """What a chunk is split into before merging; nothing for a special string."""
        if not ODD.search(chunk):
            return [] if chunk in self.vocab.specials else [p.encode() for p in WORD_PIECES.findall(chunk.lower())]
        lib = library(self.path)
        return [bytes(map(_LETTER_BYTES.__getitem__, p)) for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(chunk))]

    def ids_of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids as little-endian unsigned 32-bit bytes."""
        plain = [self.pieces(c) for c in chunks]
        distinct = list(dict.fromkeys(p for ps in plain for p in ps))
        held: dict[bytes, bytes] = {}
        if self.lexicon is not None:
            held = self.lexicon.find(distinct)
            distinct = [p for p in distinct if p not in held]
        if distinct:
            ids, at = self.vocab.merge_all(distinct)
            raw, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
            held.update({p: raw[at[i] : at[i + 1]] for i, p in enumerate(distinct)})
        special = self.vocab.specials
        return [np.array([special[c]], "<u4").tobytes() if c in special else b"".join([held[p] for p in ps]) for c, ps in zip(chunks, plain, strict=True)]
