"""Byte-pair encoding and decoding with a public vocabulary (operator 5).

The vocabulary file is a parameter. Texts are cut at white space; the words of pieces that a worker
hasn't met are encoded together: all their symbols lie in one flat array, and in each round every word merges
the pair of lowest rank that it holds, found by binary search over the sorted keys of known pairs.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.base import CHUNK_BYTES, Words, parts, raw_texts, read_table, slices, small_batches, widened

#: Bytes of pieces, ids and their bookkeeping that a worker remembers before it starts anew; longer pieces aren't remembered.
CACHE_BYTES, ENTRY_BYTES, LONGEST_KEPT = 80 << 20, 150, 200
#: Bytes of words that a flat encoder knows before it starts anew.
FLAT_BYTES = 128 << 20
NONE = np.iinfo(np.int64).max

# What the tokenizers library's Unicode tables have beyond, or short of, those of Python.
# Letters and numbers that are newer than Python's table, first and last.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Newer capitals, first and last, and how far their small letters are from them.
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x0264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x019B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
#: Marks that the library's normaliser is too old to reorder or compose, first and last.
UNKNOWN_MARKS = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E),
    (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]


def _character_class(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _of_category(letter: str) -> list[tuple[int, int]]:
    """Ranges of the code points whose general category begins with a letter."""
    has = np.fromiter((unicodedata.category(chr(i))[0] == letter for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    edges = np.flatnonzero(np.diff(has, prepend=False, append=False))
    return list(zip(edges[0::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


_UNKNOWN_MARK = re.compile(f"([{_character_class(UNKNOWN_MARKS)}])")
#: Below it, Python's tables are the library's.
FIRST_UNKNOWN = chr(min(a for a, *_ in NEWER_LETTERS + NEWER_NUMBERS + NEWER_CAPITALS + UNKNOWN_MARKS))
_NEWER_LOWER = {c: c + step for a, b, step in NEWER_CAPITALS for c in range(a, b + 1)}


def lowered(text: str) -> str:
    """The text in form NFC and lower case, as the library has it."""
    if text.isascii():
        return text.lower()
    if max(text) < FIRST_UNKNOWN:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    # a mark that the normaliser doesn't know parts what is before it from what is after it
    text = "".join(unicodedata.normalize("NFC", x) for x in _UNKNOWN_MARK.split(text))
    # one character at a time, a capital sigma has one lower-case form
    return text.replace("Σ", "σ").lower().translate(_NEWER_LOWER)


def word_pattern(contractions: str) -> re.Pattern:
    """Contractions, runs of letters, single numbers, and runs of what is neither these nor white space."""
    letter, number = (_character_class(_of_category(k) + newer) for k, newer in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)))
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"{contractions}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


def byte_characters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Bpe:
    """A word-level BPE vocabulary with an end-of-word suffix, as in a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t.decode() for t, i in self.special.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        contractions, *rest = split.partition("|[\\p{L}]+")
        if "".join(rest) != r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError(f"words of another kind than expected: {split}")
        self.word = word_pattern(contractions)
        chars = byte_characters()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        size = len(self.tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.size, self.keys, self.ranks = size, key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def pieces(self, text: bytes) -> list[bytes]:
        """The text cut at ASCII white space, which no word spans, and at special tokens, which stay whole."""
        if self.split_special is None or not self.split_special.search(text):
            return text.split()
        out = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else part.split()
        return out

    def words(self, piece: bytes) -> list[str]:
        return self.word.findall(lowered(piece.decode()))

    def pair_ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; NONE at the end of a word and for unknown pairs."""
        after = np.minimum(at + 1, len(symbols) - 1)
        pair = symbols[at] * self.size + symbols[after]
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = (self.keys[found] == pair) & (owner[at] == owner[after]) & (after > at)
        return np.where(known, self.ranks[found], NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        data = [w.encode() for w in words]
        length = np.array([len(x) for x in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols, owner = self.inner[flat], np.repeat(np.arange(len(words)), length)
        last = np.cumsum(length)[length > 0] - 1
        symbols[last] = self.final[flat[last]]
        keep = symbols >= 0  # a byte without a symbol gives no token
        symbols, owner = symbols[keep], owner[keep]
        done_ids, done_owner = [], []
        rank = self.pair_ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            width = np.diff(np.append(begin, len(owner)))
            least = np.repeat(np.minimum.reduceat(rank, begin), width)
            live = least < NONE
            if not live.all():
                done_ids.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, least = symbols[live], owner[live], rank[live], least[live]
                if not len(symbols):
                    break
            hit = rank == least
            # of hits that overlap, as in a run of one symbol, every second goes, counted from the left
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(~hit, place, -1))) % 2 == 1
            where = np.flatnonzero(hit)
            symbols[where] = self.made[rank[where]]
            left = np.ones(len(symbols), bool)
            left[where + 1] = False
            symbols, owner, rank = symbols[left], owner[left], rank[left]
            where -= np.arange(len(where))
            near = np.concatenate((where, np.maximum(where - 1, 0)))
            rank[near] = self.pair_ranks(symbols, owner, near)
        ids, owner = np.concatenate(done_ids or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        raw, begin = ids[order].astype("<u4").tobytes(), 0
        out = []
        for end in ends.tolist():
            out.append(raw[begin:end])
            begin = end
        return out

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers; a long text goes in parts."""
        texts = list(texts)
        if all(len(t) <= CHUNK_BYTES for t in texts):
            return self._encode_some(texts)
        return [b"".join(self._encode_some([part])[0] for part in parts(t)) for t in texts]

    def _encode_some(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known, once = self.known, {}
        if new := list({p for pieces in cut for p in pieces if p not in known}):
            words = [[] if p in self.special else self.words(p) for p in new]
            ids = iter(self.encode_words([w for ws in words for w in ws]))
            for piece, ws in zip(new, words, strict=True):
                own = self.special[piece].to_bytes(4, "little") if piece in self.special else b"".join(next(ids) for _ in ws)
                if len(piece) <= LONGEST_KEPT:
                    known[piece] = own
                    self.held += len(piece) + len(own) + ENTRY_BYTES
                else:
                    once[piece] = own
        if once:
            return [b"".join(once[p] if p in once else known[p] for p in pieces) for pieces in cut]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by a space: the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class FlatEncoder:
    """Ids of many texts in one array. What is known of words lies in arrays sorted by the words' hashes, some 45 bytes for each.

    Words are told apart by a 64-bit hash together with their length and first eight bytes. Where these disagree, and for texts that
    hold special tokens, `Bpe.encode` is asked.
    """

    def __init__(self, bpe: Bpe, most_bytes: int = FLAT_BYTES) -> None:
        self.bpe, self.most_bytes = bpe, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.heads, self.lengths, self.begin, self.width = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _learn(self, at: np.ndarray, hashes: np.ndarray, heads: np.ndarray, lengths: np.ndarray, words: list[bytes]) -> None:
        """Put new words, in the order of their hashes, at their places."""
        pieces = [self.bpe.words(w) for w in words]
        flat = [w for own in pieces for w in own]
        distinct = list(dict.fromkeys(flat))
        known = dict(zip(distinct, self.bpe.encode_words(distinct), strict=True))
        raw = [b"".join(map(known.__getitem__, own)) for own in pieces]
        width = np.array([len(x) // 4 for x in raw], np.int64)
        ids = np.frombuffer(b"".join(raw), "<u4")
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(self.used + 2 * len(ids), "<u4")))
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(width) - width
        self.used += len(ids)
        new = (hashes, heads, lengths, begin, width)
        self.hashes, self.heads, self.lengths, self.begin, self.width = (np.insert(old, at, x) for old, x in zip((self.hashes, self.heads, self.lengths, self.begin, self.width), new, strict=True))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other, how many each has), as `Bpe.encode` gives them."""
        special = self.bpe.split_special
        if special is None or not any(map(special.search, texts)):
            words = Words(texts)
            raw, length = words.raw + bytes(8), words.end - words.start
            head = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[words.start]
            head &= np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * np.minimum(length, 8).astype(np.uint64))
            hashes, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
            if 40 * len(self.hashes) + 4 * len(self.ids) > self.most_bytes:
                self._forget()
            at = np.searchsorted(self.hashes, hashes)
            new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
            new = np.union1d(new, np.flatnonzero(at == len(self.hashes)))
            if len(new):
                spans = zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
                self._learn(at[new], hashes[new], head[first[new]], length[first[new]], [raw[a:b] for a, b in spans])
                at = np.searchsorted(self.hashes, hashes)
            place = at[of]
            if (self.lengths[place] == length).all() and (self.heads[place] == head).all():
                count = self.width[place]
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
                ids = self.ids[np.repeat(self.begin[place] - ends[:-1], count) + np.arange(ends[-1])]
                return ids, np.diff(ends[words.first])
        coded = [np.frombuffer(x, "<u4") for x in self.bpe.encode(texts)]
        return np.concatenate([np.zeros(0, "<u4"), *coded]), np.array([len(x) for x in coded], np.int64)


@functools.lru_cache(2)
def flat(path: str) -> FlatEncoder:
    """One encoder for all tasks of a Python worker."""
    return FlatEncoder(loaded(path))


@functools.lru_cache(2)
def loaded(path: str) -> Bpe:
    """One vocabulary for all tasks of a Python worker."""
    return Bpe(path)


def _added(df: DataFrame, vocabulary: str, column: str, **columns: str):
    """Rows with columns that a function of (Bpe, values of a column) gives; columns of their names are replaced."""
    small_batches(df.sparkSession)
    kept = df.drop(*columns)

    def by(function) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe = loaded(vocabulary)
            for batch in slices(batches, column):
                yield pa.RecordBatch.from_arrays([*batch.columns, *function(bpe, raw_texts(batch.column(column)))], names=[*batch.schema.names, *columns])

        return kept.mapInArrow(run, widened(kept, **columns))

    return by


def _ids(bpe: Bpe, texts: list[bytes]) -> list[pa.Array]:
    ids = bpe.encode(texts)
    return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]


def _texts(bpe: Bpe, ids: list[bytes]) -> list[pa.Array]:
    return [pa.array([bpe.decode(x) for x in ids], pa.string())]


def encode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add `ids` (binary: little-endian unsigned 32-bit integers) and `n_tokens` to each row.

    A null or empty text has no ids; a very long one is encoded in parts, with the same ids. Rows that repeat are encoded
    each; an empty table gives an empty result. Other columns stay as they are; columns named ids or n_tokens are
    replaced. `vocabulary` must be readable on every executor.
    """
    return _added(df, vocabulary, text, ids="binary", n_tokens="long")(_ids)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the text that the ids stand for; null ids decode to an empty text. A column of that name is replaced."""
    return _added(df, vocabulary, ids, decoded="string")(_texts)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add `ids`, `n_tokens` and `decoded` to each row, as encode and then decode do, in one pass."""

    def both(bpe: Bpe, texts: list[bytes]) -> list[pa.Array]:
        ids, n = _ids(bpe, texts)
        return [ids, n, *_texts(bpe, ids.to_pylist())]

    return _added(df, vocabulary, text, ids="binary", n_tokens="long", decoded="string")(both)


def digest(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, for every row of `documents`.

    A null or empty text has no tokens and the digests of nothing. Rows that repeat are returned each; other columns aren't
    read; an empty table gives an empty result.
    """
    coded = round_trip(documents.select("doc_id", "text"), vocabulary).drop("text")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"), vocabulary_path())
