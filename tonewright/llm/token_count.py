"""Token counts by compiled finite-state transducers.

The pre-tokenizer is a deterministic transducer over character classes. Text is
cut into fixed-size chunks; each chunk gives a map from every entry state to its
exit state, and a parallel prefix scan composes these maps, so that each chunk
learns its true entry state without reading what stands before it. The second
half is the word transducer, whose states are the beginnings of words: closing a
word is a transition that is annotated with the number of tokens it emits. Its
transitions and annotations are compiled when first asked for and kept, as sorted
arrays, from batch to batch. Words share a state only if all their characters agree.

Texts: null counts as empty and has 0 tokens; very long texts are read whole;
repeated rows are counted alike; an empty table gives an empty table. Other
columns pass through unless one of the count columns replaces them.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PairIndexBpe, vocabulary_path
from .common import no_cycles, slices, texts_of

# Classes of characters: white space, letters, digits, others, the apostrophe, and the letters of contractions.
WHITE, LETTER, DIGIT, OTHER, QUOTE = range(5)
SHORT = {c: 5 + i for i, c in enumerate("strevmld")}
N_CLASSES = 5 + len(SHORT)
# States: nothing open, in letters, in others, after an opening apostrophe, and after ' with r, v or l.
FRESH, IN_WORD, IN_OTHER, IN_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
N_STATES = 7
CHUNK = 64
#: States that a worker keeps from batch to batch.
REMEMBERED = 3_000_000
#: Longer words are merged at once, without states of their own.
LONG = 64


def transitions() -> np.ndarray:
    """Next state by state and class; the contractions are 's 't 'm 'd 're 've 'll."""
    table = np.empty((N_STATES, N_CLASSES), np.uint8)
    letters = [LETTER, *SHORT.values()]
    for state in range(N_STATES):
        table[state, WHITE] = table[state, DIGIT] = FRESH
        table[state, OTHER] = IN_OTHER
        table[state, QUOTE] = IN_OTHER if state in (IN_OTHER, IN_QUOTE) else IN_QUOTE
        table[state, letters] = IN_WORD
    for c in "stmd":
        table[IN_QUOTE, SHORT[c]] = FRESH
    for c, pending in (("r", QUOTE_R), ("v", QUOTE_V), ("l", QUOTE_L)):
        table[IN_QUOTE, SHORT[c]] = pending
    table[QUOTE_R, SHORT["e"]] = table[QUOTE_V, SHORT["e"]] = table[QUOTE_L, SHORT["l"]] = FRESH
    return table


def character_classes(pre_tokenizer) -> np.ndarray:
    """The class of each code point; letters that this Python does not know are letters only if the tokenizer's splitter says so."""
    points = "".join(map(chr, [x for x in range(sys.maxunicode + 1) if not 0xD800 <= x < 0xE000]))
    classes = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for name, code in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(name, points):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                classes[a : b + 1] = code
            else:  # a run over the surrogates' gap
                classes[[ord(c) for c in m[0]]] = code
    classes[ord("'")] = QUOTE
    for c, code in SHORT.items():
        classes[ord(c)] = code
    unsure = [chr(x) for x in np.flatnonzero(classes == LETTER).tolist() if unicodedata.category(chr(x)) == "Cn"]
    pieces = {span for _, span in pre_tokenizer.pre_tokenize_str("".join(f"\na{c}" for c in unsure))}
    classes[[ord(c) for i, c in enumerate(unsure) if (3 * i + 1, 3 * i + 3) not in pieces]] = OTHER
    return classes


def odd_characters(normalizer) -> np.ndarray:
    """By code point, whether this is a character that this Python's Unicode tables treat otherwise than the tokenizer's normalizer, or do not know."""
    points = [chr(x) for x in range(0x80, sys.maxunicode + 1) if not 0xD800 <= x < 0xE000]
    points = [c for c in points if (k := unicodedata.category(c)) != "Co" and k != "Cc" and not c.isspace() and (k != "Lo" or unicodedata.decomposition(c))]
    known = [c for c in points if unicodedata.category(c) != "Cn"]
    theirs = normalizer.normalize_str("\n".join(known)).split()
    ours = [unicodedata.normalize("NFC", c).lower() for c in known]
    odd = {c for c, x, y in zip(known, ours, theirs, strict=True) if x != y} | set(points).difference(known)
    table = np.zeros(sys.maxunicode + 1, bool)
    table[[ord(c) for c in odd]] = True
    return table


def entry_states(classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of chunks, one in each row of classes: maps of all entry states, composed by a prefix scan from FRESH."""
    flat = table.ravel().astype(np.intp)
    state = np.tile(np.arange(N_STATES, dtype=np.intp), (len(classes), 1))
    for j in range(classes.shape[1]):
        state = flat[state * N_CLASSES + classes[:, j, None]]
    maps, step = state, 1
    while step < len(maps):  # after each round a map spans twice as many chunks
        later = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    return np.r_[FRESH, maps[:-1, FRESH]]


def word_starts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (pre-tokens) in an array of character classes."""
    table = transitions()
    n = len(classes)
    padded = np.full(-(-max(n, 1) // CHUNK) * CHUNK, WHITE, np.uint8)
    padded[:n] = classes
    rows = padded.reshape(-1, CHUNK)
    state = entry_states(rows, table)
    before, flat = np.empty(rows.shape, np.uint8), table.ravel().astype(np.intp)
    for j in range(CHUNK):
        before[:, j] = state
        state = flat[state * N_CLASSES + rows[:, j]]
    before = before.ravel()[:n]
    after = np.r_[before[1:], np.uint8(state[-1])] if n else before
    letter = (classes == LETTER) | (classes >= 5)
    other = (classes == OTHER) | (classes == QUOTE)
    # A character goes on with the word before it in these cases; every other one that isn't white opens a word.
    ended = letter & (after == FRESH)
    goes_on = letter & (before == IN_WORD) | other & ((before == IN_OTHER) | (before == IN_QUOTE)) | ended
    pending = (before >= QUOTE_R) & (before <= QUOTE_L)
    goes_on |= letter & pending & ~ended
    starts = (classes != WHITE) & ~goes_on
    held = letter & (after >= QUOTE_R) & (after <= QUOTE_L) & (before == IN_QUOTE)
    done = np.r_[ended[1:], False]
    starts = np.where(held, ~done, starts)  # 'r opens a new word at r unless e completes it
    at = np.flatnonzero(starts)
    stop = np.r_[np.flatnonzero((classes == WHITE) & np.r_[True, classes[:-1] != WHITE]), n] if n else np.array([0])
    ends = np.minimum(np.r_[at[1:], n], stop[np.searchsorted(stop, at)]) if len(at) else at
    return at, ends


class CountTransducer:
    """Counts the tokens of texts by a deterministic transducer over the characters of words.

    States are the beginnings of words, one level for each number of characters, so that two
    words share a state only if they share all characters. Transitions inside a word emit
    nothing; the one that closes a word is annotated with the number of tokens that the word
    gives. Transitions and annotations are compiled when a word first asks for them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = PairIndexBpe(path)
        special = sorted(self.bpe.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        library = Tokenizer.from_file(path)  # its tables of letters and of lower case are asked, not its model
        self.normalizer = library.normalizer
        self.classes = character_classes(library.pre_tokenizer)
        self.odd = odd_characters(self.normalizer)
        self.forget()

    def forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.emits = np.full(1, -1, np.int32)  # by state: tokens on closing the word there, -1 where not compiled

    def normal(self, text: str) -> tuple[str, int]:
        """The text as the tokenizer's normalizer leaves it, with its special strings cut out and counted."""
        if self.special is None or not any(x in text for x in self.bpe.special):
            return self.lower(text), 0
        parts = self.special.split(text)
        return "\n".join(map(self.lower, parts)), len(parts) - 1

    def lower(self, text: str) -> str:
        if not text.isascii():
            if self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
                return self.normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the normalizer has no final sigma
                return "".join(map(str.lower, text))
        return text.lower()

    def closing_states(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The state in which each word ends; all words take a step at a time."""
        order = np.argsort(-sizes, kind="stable")
        first, falling = starts[order], -sizes[order]
        state = np.zeros(len(order), np.int64)
        for k in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(falling, -k))  # words of more than k characters
            key = state[:m] << 21 | points[first[:m] + k]
            if k == len(self.levels):
                self.levels.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            keys, to = self.levels[k]
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            missing = keys[at] != key if len(keys) else np.ones(m, bool)
            if missing.any():
                new = np.unique(key[missing])
                both, more = np.r_[keys, new], np.r_[to, len(self.emits) + np.arange(len(new))]
                again = np.argsort(both, kind="stable")
                self.levels[k] = keys, to = both[again], more[again]
                self.emits = np.r_[self.emits, np.full(len(new), -1, np.int32)]
                at = np.searchsorted(keys, key)
            state[:m] = to[at]
        out = np.empty(len(order), np.int64)
        out[order] = state
        return out

    def emitted(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        sizes = ends - starts
        counts = np.empty(len(starts), np.int32)
        encoded = lambda which: [text[i:j].encode("utf-8", "surrogatepass") for i, j in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            counts[long] = [len(x) // 4 for x in self.bpe.merge_words(encoded(long))]
        short = np.flatnonzero(sizes <= LONG)
        if len(self.emits) > REMEMBERED:
            self.forget()
        state = self.closing_states(points, starts[short], sizes[short])
        open_ = np.flatnonzero(self.emits[state] < 0)
        if len(open_):
            new, where = np.unique(state[open_], return_index=True)
            self.emits[new] = [len(x) // 4 for x in self.bpe.merge_words(encoded(short[open_[where]]))]
        counts[short] = self.emits[state]
        return counts

    def count(self, texts: list[str]) -> np.ndarray:
        with no_cycles():
            normal = [self.normal(t) for t in texts]
            text = "\n".join(x for x, _ in normal) + "\n"
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            starts, ends = word_starts(self.classes[points])
            total = np.r_[0, np.cumsum(self.emitted(text, points, starts, ends), dtype=np.int64)] if len(starts) else np.zeros(1, np.int64)
            stops = np.cumsum([len(x) + 1 for x, _ in normal])
            upto = total[np.searchsorted(starts, stops)]
            return np.diff(np.r_[0, upto]) + np.array([n for _, n in normal], np.int64)


@lru_cache(maxsize=2)
def _transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_tokens(df: DataFrame, text_col: str = "text", count_col: str = "n_tokens", bytes_col: str = "n_bytes", path: str | None = None) -> DataFrame:
    """Add the UTF-8 bytes and the tokens of each text."""
    where = path or vocabulary_path("word_bpe_49k.json")
    kept = df.drop(*[c for c in (count_col, bytes_col) if c != text_col])
    schema = T.StructType([*kept.schema.fields, T.StructField(bytes_col, T.LongType()), T.StructField(count_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(where)
        for b in slices(batches, text_col, 4 << 20):
            texts = texts_of(b, text_col)
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, size, pa.array(machine.count(texts), pa.int64())], names=[*b.schema.names, bytes_col, count_col])

    return kept.mapInArrow(run, schema)
