"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct words of a partition's batch are laid out in one symbol array. An
index maps the rank of each mergeable pair to all positions where the pair
stands. Active ranks are applied in ascending order; each merge updates only
the lists of the pairs beside the merged positions. Words are independent, so
taking the lowest active rank of the whole batch is the lowest of each word.

Texts: null counts as empty and gives no tokens; very long texts are encoded
whole; repeated rows are encoded alike; an empty table gives an empty table.
Other columns pass through unless `ids_col` or `decoded_col` replaces them.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import no_cycles, slices, texts_of

#: How the byte-level vocabulary splits text before the merges (public pattern of that vocabulary).
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Distinct pieces whose ids a worker remembers from batch to batch, and their characters in all.
REMEMBERED = 250_000
REMEMBERED_CHARS = 8 << 20
#: Longer texts are encoded in sections of about so many characters, cut between a letter and a space before a letter.
SECTION = 1 << 20
#: Positions that enter the pair index at once.
WIDE = 1 << 20
SAFE_CUT = regex.compile(r"\p{L}(?= \p{L})")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sections(text: str) -> Iterator[str]:
    """Parts of a long text that can be encoded apart: no piece of SPLIT goes from a letter over a space."""
    at = 0
    while len(text) - at > SECTION and (cut := SAFE_CUT.search(text, at + SECTION)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class PairIndexBpe:
    """Merges and vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"].get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in (token.removesuffix(end) if end else token))
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte, self.of_last_byte = np.empty(256, np.int32), np.empty(256, np.int32)
        for c, b in alphabet.items():
            self.of_byte[b], self.of_last_byte[b] = vocab[c], vocab[c + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a.removesuffix(end) + b if end else a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.held = 0  # characters of remembered pieces

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where there is none."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.by_key[at], -1)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word after all merges."""
        flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        sym = self.of_byte[flat]
        sym[ends - 1] = self.of_last_byte[flat[ends - 1]]
        sym[ends] = -1  # a wall behind each word
        n = len(sym)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put pairs that begin at these positions into the index."""
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, i, j in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        for i in range(0, n - 1, WIDE):
            enter(np.flatnonzero(sym[i : min(i + WIDE, n - 1)] >= 0) + i)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)] if len(at) > 0 else at
            if len(lists) > 1 or a == b:
                at = np.unique(at)
            if not len(at):
                continue
            if a == b and len(at) > 1:  # runs of one symbol pair up from the left
                starts = np.r_[True, at[1:] != after[at[:-1]]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            gone = after[at]
            sym[at], sym[gone] = self.made[r], -2
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            left = left[left >= 0]
            enter(np.unique(np.concatenate([left, at])) if len(at) > 1 else np.concatenate([left, at]))
        live = np.flatnonzero(sym != -2)
        packed = sym[live].astype("<u4").tobytes()
        stops = np.searchsorted(live, ends) * 4
        starts = np.r_[0, stops[:-1] + 4]
        return [packed[i:j] for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]

    def _learn(self, first: set[str], later: set[str]) -> None:
        """Encode pieces that are not remembered; None marks those that are not independent of their neighbours."""
        bound = [x for x in later if not x or x[0].isspace()]
        self.later.update(dict.fromkeys(bound))
        free = list(later.difference(bound))
        for memo, keys, before in ((self.first, list(first), ""), (self.later, free, " ")):
            parts = [SPLIT.findall(before + x) for x in keys]
            words = list(set(chain.from_iterable(parts)))
            ids = dict(zip(words, self.merge_words([w.encode("utf-8", "surrogatepass") for w in words]), strict=True)) if words else {}
            memo.update(zip(keys, [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in parts], strict=True))
            self.held += sum(map(len, keys))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        with no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.later) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.first, self.later, self.held = {}, {}, 0
        rows: list[list[list]] = []
        for t in texts:
            parts = self.special_split.split(t) if self.special and any(s in t for s in self.special) else [t]
            rows.append([[self.special[s].to_bytes(4, "little")] if s in self.special else self._look(x.split(" "), x) for s in parts if s for x in ([s] if s in self.special else sections(s))])
        self._fill(rows, careful=True)
        return [b"".join(chain.from_iterable(row)) for row in rows]

    def _look(self, pieces: list[str], text: str) -> list:
        """Ids of the pieces that are remembered; where some are missing, the pieces and the text follow as one entry."""
        got = list(map(self.later.get, pieces))
        got[0] = self.first.get(pieces[0])
        if None in got:
            got.append((pieces, text))
        return got

    def _fill(self, rows: list[list[list]], careful: bool) -> None:
        open_parts = [p for row in rows for p in row if type(p[-1]) is tuple]
        holes = [[i for i, x in enumerate(p) if x is None] for p in open_parts]
        first = {p[-1][0][0] for p, h in zip(open_parts, holes, strict=True) if h[0] == 0}
        later = {p[-1][0][i] for p, h in zip(open_parts, holes, strict=True) for i in h if i}
        self._learn(first, later.difference(self.later))
        again = []
        for p, h in zip(open_parts, holes, strict=True):
            pieces, text = p.pop()
            for i in h:
                p[i] = self.later[pieces[i]] if i else self.first[pieces[0]]
            if None in p:  # some spaces belong together with what stands beside them
                p[:] = self._look(re.split(r" (?=\S)", text), text)
                again.append([p])
        if again:
            assert careful
            self._fill(again, careful=False)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _extended(df: DataFrame, drop: list[str], add: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(*drop)
    return kept, T.StructType([*kept.schema.fields, *add])


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids_le", path: str | None = None) -> DataFrame:
    """Add `ids_col`: the ids as packed little-endian unsigned 32-bit integers."""
    where = path or vocabulary_path()
    kept, schema = _extended(df, [ids_col] if ids_col != text_col else [], [T.StructField(ids_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(where)
        for b in slices(batches, text_col):
            ids = codec.encode_batch(texts_of(b, text_col))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, ids_col])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids_le", decoded_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Add `decoded_col`: the text of packed ids; null ids count as none."""
    where = path or vocabulary_path()
    kept, schema = _extended(df, [decoded_col] if decoded_col != ids_col else [], [T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(where)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec.decode(x or b"") for x in column], pa.string())], names=[*b.schema.names, decoded_col])

    return kept.mapInArrow(run, schema)


def encode_decode(df: DataFrame, text_col: str = "text", ids_col: str = "ids_le", decoded_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Both steps in one pass over the rows: adds `ids_col` and `decoded_col`."""
    where = path or vocabulary_path()
    kept, schema = _extended(df, [c for c in (ids_col, decoded_col) if c != text_col], [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(where)
        for b in slices(batches, text_col):
            ids = codec.encode_batch(texts_of(b, text_col))
            decoded = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*b.schema.names, ids_col, decoded_col])

    return kept.mapInArrow(run, schema)
