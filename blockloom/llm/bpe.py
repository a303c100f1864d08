"""Byte-level BPE encoding and decoding.

Pre-tokens come from the published pattern; their bytes are merged by the rank
queue of ``rank_queue``, a whole batch of unseen pieces at once.  Pieces that
were seen before come from a cache of bounded size, which changes no result.
Texts are cut at single blanks first: where no white space stands directly
before a blank, no match of the pattern crosses the place before a blank.

Defined cases: a null text is empty and has no ids; texts of any length and
pieces of any length are encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from blockloom.llm.common import sliced, texts
from blockloom.llm.rank_queue import Merges, merge

CACHE_ENTRIES, ROWS_AT_ONCE = 200_000, 2_500
BLANK_RUN = re.compile(r"[\s\x1c-\x1f\x85] ")


class Cache(dict):
    """Encodings by piece, ``bound`` of them at most; further pieces live for one batch in ``extra``."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.extra = bound, {}

    def __missing__(self, key):
        return self.extra[key]

    def learn(self, keys: Iterable[str], encode) -> None:
        """Make sure that all ``keys`` are known; ``encode`` takes a list of them and returns their encodings."""
        missing = [k for k in keys if k not in self]
        found = zip(missing, encode(missing)) if missing else iter(())
        self.update(islice(found, max(self.bound - len(self), 0)))
        self.extra = dict(found)


def layout(found: list[list[bytes]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The pieces' bytes in one string, where each piece begins (and the last ends), and the first piece of each word."""
    flat = [t for ts in found for t in ts]
    starts = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)), out=starts[1:])
    firsts = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=firsts[1:])
    return b"".join(flat), starts, firsts


class ByteBPE:
    """Encoder and decoder by a table of ranks (base64 of the bytes, blank, rank)."""

    def __init__(self, path: str, pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.vocabulary = [b""] * size
        for t, r in self.ranks.items():
            self.vocabulary[r] = t
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = (np.array(x, np.int64) for x in zip(*pairs))
        self.merges = Merges(a, b, r, np.arange(size))
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.inner, self.first = Cache(cache_entries), Cache(cache_entries // 10)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32 bits) of each piece; the pattern cuts it into pre-tokens."""
        cut = self.pattern.findall
        found = [[p.encode()] if p[1:].isalpha() and p[0] == " " else [p[:-1].encode(), p[-1:].encode()] if p[-1] in ".," and p[1:-1].isalpha() and p[0] == " " else [t.encode("utf-8", "replace") for t in cut(p)] for p in pieces]
        raw, starts, firsts = layout(found)
        ids, at = merge(self.byte_id[np.frombuffer(raw, np.uint8)], starts[:-1], self.merges)
        cuts = (np.searchsorted(at, starts)[firsts] * 4).tolist()
        out = ids.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        parts = [[] if not t else [t] if BLANK_RUN.search(t) else t.split(" ") for t in batch]
        self.first.learn({p[0] for p in parts if p and p[0]}, self.encode_pieces)  # a text that starts with a blank has an empty first part
        rest = set()
        for p in parts:
            rest.update(p[1:])
        self.inner.learn(rest, lambda words: self.encode_pieces([" " + w for w in words]))
        for p in parts:
            yield np.frombuffer((self.first[p[0]] if p[0] else b"") + b"".join(map(self.inner.__getitem__, p[1:])) if p else b"", "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


_loaded: dict[tuple, ByteBPE] = {}


def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in sliced(batches, ROWS_AT_ONCE):
            ids = [i.astype(np.int32) for i in bpe.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes that they decode to, for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        decimal = [b"%d" % i for i in range(len(bpe.vocabulary))]
        for b in sliced(batches, ROWS_AT_ONCE):
            n, digests, decoded = [], [], []
            for ids in bpe.encode(b.column("text").to_pylist()):
                n.append(len(ids))
                digests.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from U+0100 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBPE:
    """BPE with word ends, read from a ``tokenizers`` file: NFC, lower case, pieces by the file's pattern.

    Plain texts (scripts whose case and composition are the same everywhere) are
    cut into words, whose ids come from the same merges as ranks; all others, and
    texts that hold one of the file's added tokens, take the library itself.
    """

    PLAIN = re.compile(r"[\t-\r -~ -įı-ɏЀ-џ‐-‧ぁ-ゖァ-ヺ一-鿿]*")

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES // 2):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec["added_tokens"]]
        vocabulary, model = spec["model"]["vocab"], spec["model"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the same merges as ranks of byte strings, the word end written as byte 0, which plain texts don't have
        end, alphabet = model["end_of_word_suffix"], byte_alphabet()
        value = {c: bytes([i]) for i, c in enumerate(alphabet)}
        spell = lambda t: b"".join(value[c] for c in t.removesuffix(end)) + b"\0" * t.endswith(end)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [*alphabet, *(c + end for c in alphabet), *("".join(p) for p in pairs)]
        self.ids = np.array([vocabulary.get(t, 0) for t in order], "<u4")
        ranks = {spell(t): i for i, t in reversed([*enumerate(order)])}
        self.ends = np.array([t.endswith(end) for t in order])
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.words = Cache(cache_entries)
        del spec, vocabulary, model, pairs, order, ranks  # large, and of no use from here on

    def encode_words(self, words: list[str]) -> list[bytes]:
        cut = self.pattern.findall
        found = [[w] if w.isalpha() else [w[:-1], w[-1]] if w[-1] in ".," and w[:-1].isalpha() else cut(w) for w in words]
        got = np.array(self.merger.encode_ordinary("".join(t + "\0" for ts in found for t in ts)), np.int64)
        firsts = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=firsts[1:])
        piece_ends = np.concatenate([[0], np.flatnonzero(self.ends[got]) + 1])
        cuts = (piece_ends[firsts] * 4).tolist()
        out = self.ids[got].tobytes()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        import unicodedata

        parts, need = [], set()
        for t in batch:
            special = any(a in t for a in self.added)
            t = unicodedata.normalize("NFC", t)
            words = t.lower().split() if not special and self.PLAIN.fullmatch(t) else None
            parts.append(words)
            if words:
                need.update(words)
        self.words.learn(need, self.encode_words)
        for t, words in zip(batch, parts):
            if words is None:
                yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(self.words.__getitem__, words))


_words: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    if path not in _words:
        _words[path] = WordBPE(path)
    return _words[path]
