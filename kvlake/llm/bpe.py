"""Byte-level BPE over a minimal acyclic transducer lexicon.

The corpus's frequent pre-token words (counted over all documents) are compiled into a minimal automaton with shared
suffixes. Each arc carries the number of words that sort before it, so the path of a word adds up to its rank, and the
rank gives its token ids. The arrays are bounded by the lexicon's size, reach workers as one broadcast value and are
memory-mapped there. Words outside the lexicon are merged exactly by rank.

Everything is done on arrays for about a megabyte of texts at once: a table of character kinds cuts the texts into
words, equal words become one number (by a hash whose groups are compared byte for byte), each distinct word is looked
up or merged once, and ids and decoded bytes are gathered through offsets. A bounded memo keeps merged words.

Cases: a NULL or empty text has no ids and decodes to the empty text; strings of special tokens in a text are those
tokens; texts of any length are encoded whole, word by word; bytes that are not UTF-8 count as U+FFFD; repeated rows do
not matter; a column that already has the name of a result column is replaced; an empty table gives an empty result and
an empty lexicon.
"""
from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kvlake.llm.common import pieces, with_field, worker_cache
from kvlake.sources import scratch

#: Words in the lexicon at most, words in a worker's memo after which it is emptied, and bytes of text that a worker takes at once.
LEXICON, MEMO, PIECE = 1 << 16, 1 << 17, 1 << 20
#: Bytes up to which words are merged together, and up to which they are grouped by hash.
LONG, KEYED = 256, 32
# The endings that the pre-tokenizer's pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the mask of the first k bytes


def character_kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE (the Unicode property White_Space) of every code point.

    Characters on which two installed versions of Unicode differ are as the tokenizers library takes them."""
    import unicodedata

    import regex
    from tokenizers import pre_tokenizers

    everything = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(everything), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            out[m.start(): m.end()] = kind
    other = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in everything], np.uint8)
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero((out != other) & (out != SPACE)).tolist():
        out[c] = next((kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(before + chr(c))) == 1), SPACE)
    return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of that size, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, followed by KEYED zeros, and where each text starts, and the end."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.zeros(at[-1] - at[0] + KEYED, np.uint8)
    if data is not None:
        raw[:-KEYED] = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0])
    return raw, at - at[0]


def text_array(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings raw[at[k]:at[k + 1]]; bytes that are not UTF-8 become U+FFFD."""
    whole = raw.tobytes()
    try:
        whole.decode()
        fine = not len(at) or not ((raw[at[:-1][at[:-1] < len(raw)]] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        fine = False
    if not fine:
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(whole)])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Token ids by bytes, merge ranks and special tokens of a byte-level tokenizer file's text."""

    def __init__(self, text: str, kinds: np.ndarray | None = None):
        import re

        spec = json.loads(text)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.letter = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.find = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        spelled = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            spelled[i] = raw(token)
        for token, i in self.special.items():
            spelled[i] = token
        self.size = np.array([len(x) for x in spelled], np.int64)  # of each id's bytes
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        merges = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.merge = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        keys = np.array([*(a << 32 | b for a, b in self.merge), 1 << 62], np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.array([*self.merge.values(), len(merges)], np.int64)[order]
        self.letter_ranks = self.pair_ranks(np.repeat(self.letter, 256), np.tile(self.letter, 256))
        self.kinds = character_kinds() if kinds is None else kinds

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of tokens; the number of merges for pairs that do not merge."""
        key = a << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at], len(self.made))

    def split(self, column: pa.Array) -> Words:
        """The words of a column of texts, in order: a run of letters, of numbers or of other characters with a space
        before it, if there is one; an apostrophe with an ending; and white space, without the last character before a word."""
        raw, rows = text_bytes(column)
        try:
            text = raw[:-KEYED].tobytes().decode()
        except UnicodeDecodeError:
            return self.split(text_array(raw[:-KEYED], rows))
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000) + 1
        at = np.zeros(len(code) + 1, np.int64)
        np.cumsum(size, out=at[1:])  # the byte at which each character starts
        n, kind = len(code), self.kinds[code]
        specials = [(m.start(), m.end(), self.special[m.group()]) for m in self.find.finditer(raw[:-KEYED].tobytes())] if self.find else []
        if specials:  # one that two texts spell together is none
            row = np.searchsorted(rows, [s[0] for s in specials], "right")
            specials = [s for s, r in zip(specials, row) if s[1] <= rows[r]]
        edge = np.zeros(n + 1, bool)  # where a stretch of text starts that is split alone
        edge[np.searchsorted(at, rows)] = edge[n] = True
        places = [(int(np.searchsorted(at, a)), int(np.searchsorted(at, b)), i) for a, b, i in specials]
        for a, b, _ in places:
            edge[a] = edge[b] = True
        opens = edge.copy()
        opens[1:n] |= kind[1:] != kind[:-1]
        inner = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:n]) + 1 if n else np.empty(0, np.int64)
        opens[inner - 1] = True
        opens[inner[code[inner - 1] == 32]] = False
        mark = np.flatnonzero((code == 39) & opens[:n])
        if len(mark):
            # characters after the apostrophe in its stretch, as letters; 0 beyond
            after = np.zeros((len(mark), 2), np.uint32)
            for k in (1, 2):
                there = mark + k < n
                there[there] = ~edge[mark[there] + k] & (kind[mark[there] + k] == LETTER)
                after[there, k - 1] = code[mark[there] + k]
            after[after[:, 0] == 0, 1] = 0
            done = np.zeros(len(mark), bool)
            for ending in ENDINGS:
                c = [ord(x) for x in ending]
                hit = ~done & (after[:, 0] == c[0]) & (after[:, 1] == c[1] if len(c) > 1 else True)
                opens[mark[hit] + 1] = False
                if len(c) > 1:
                    opens[mark[hit] + 2] = False
                opens[mark[hit] + 1 + len(c)] = True
                done |= hit
        for a, b, _ in places:
            opens[a:b] = False
            opens[a] = True
        opens[n] = False
        first = np.flatnonzero(opens)
        fixed = np.full(len(first), -1, np.int64)
        for a, _, i in places:
            fixed[np.searchsorted(first, a)] = i
        start = at[first]
        return Words(raw, start, np.append(start[1:], at[n])[: len(start)] - start, np.searchsorted(start, rows), fixed)

    def merged(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, one word after the other, and their numbers: the lowest-ranked adjacent pair, the
        leftmost of equals, merges until none is left.

        All words take a step at once. `rank` holds the rank of each token with the next one of its word; words
        that have no pair left drop out."""
        place = np.cumsum(size) - size
        out, count = np.empty(int(size.sum()), np.int64), np.zeros(len(size), np.int64)
        for i in np.flatnonzero(size > LONG).tolist():
            ids = self._merged_long(raw[start[i]: start[i] + size[i]])
            out[place[i]: place[i] + len(ids)], count[i] = ids, len(ids)
        word = np.flatnonzero((size > 0) & (size <= LONG))  # the words still in work
        n = size[word]
        byte = raw[spread(start[word], n)].astype(np.int64)
        ids, none = self.letter[byte], len(self.made)
        rank = np.full(len(ids), none, np.int64)
        rank[:-1] = self.letter_ranks[byte[:-1] << 8 | byte[1:]]
        rank[np.cumsum(n) - 1] = none
        while len(word):
            end = np.cumsum(n)
            low = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), end - n)
            live = low >> 32 < none
            if not live.all():
                w, m = word[~live], n[~live]
                out[spread(place[w], m)] = ids[spread((end - n)[~live], m)]
                count[w] = m
            at, best = low[live] & 0xFFFFFFFF, low[live] >> 32
            opens, closes = at == (end - n)[live], at + 2 == end[live]
            stay = np.repeat(live, n)
            ids[at] = self.made[best]
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            ids, rank, word, n = ids[stay], rank[stay], word[live], n[live] - 1
            rank[at] = none
            for pair in (at[~closes], at[~opens] - 1):
                rank[pair] = self.pair_ranks(ids[pair], ids[pair + 1])
        return out[spread(place, count)], count

    def _merged_long(self, word: np.ndarray) -> list[int]:
        """The same merges with a heap, for words of thousands of bytes."""
        import heapq

        ids = self.letter[word].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap, made = [], self.made.tolist()

        def offer(i):
            if i >= 0 and after[i] < n and (m := self.merge.get((ids[i], ids[after[i]]))) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made[m], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x, keep in zip(ids, alive) if keep]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids, count = self.merged(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if words else []

    def texts(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The text of ids[at[k]:at[k + 1]] for each k; bytes that are not UTF-8 become U+FFFD."""
        size = self.size[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return text_array(self.bytes[spread(self.start[ids], size)], ends[at])


class Words:
    """The words of some texts: spans of `raw`, the first word of each text (and the end), and special tokens' ids or -1."""

    def __init__(self, raw, start, size, rows, fixed):
        self.raw, self.start, self.size, self.rows, self.fixed = raw, start, size, rows, fixed

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A word of each kind, and for each word the number of its kind. Words group by a hash of their bytes; one
        that differs from the first of its group, or is longer than KEYED bytes, is a kind of its own."""
        n = len(self.start)
        eight = np.ndarray((max(0, len(self.raw) - 7),), "<u8", self.raw, strides=(1,))
        kept = _LOW[np.minimum(self.size, 8)]
        parts = [(np.arange(n), eight[self.start] & kept if n else np.empty(0, np.uint64))]
        for k in range(8, KEYED, 8):
            at = np.flatnonzero(self.size > k)
            parts.append((at, eight[self.start[at] + k] & _LOW[np.minimum(self.size[at] - k, 8)]))
        key = (parts[0][1] ^ self.size.astype(np.uint64) * _MIX[3]) * _MIX[0]
        for (at, word), mix in zip(parts[1:], _MIX[1:]):
            x = word * mix
            key[at] = (key[at] ^ x ^ (x >> np.uint64(31))) * _MIX[0]
        key ^= key >> np.uint64(29)
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        rep = first[kind]
        odd = (self.size != self.size[rep]) | (self.size > KEYED) | (self.fixed != self.fixed[rep])
        for at, word in parts:
            full = np.zeros(n, np.uint64)
            full[at] = word
            odd[at] |= word != full[rep[at]]
        odd &= rep != np.arange(n)
        if odd.any():
            alone = np.flatnonzero(odd)
            kind[alone] = len(first) + np.arange(len(alone))
            first = np.append(first, alone)
        return first, kind

    def bytes_of(self, at: np.ndarray) -> list[bytes]:
        whole = self.raw.tobytes()
        return [whole[a: a + n] for a, n in zip(self.start[at].tolist(), self.size[at].tolist())]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal automaton of sorted distinct words, and their ids by rank, as one byte string of arrays.

    Built from sorted input: the states below the last common prefix are final and merge with their equals."""
    registry: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...))
    counts: list[int] = []

    def settle(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
            counts.append(int(final) + sum(counts[t] for _, t in arcs))
        return registry[key]

    path: list[list] = [[False, []]]  # open states along the last word: [final, arcs]
    last = b""
    for word in words:
        same = next((i for i, (x, y) in enumerate(zip(word, last)) if x != y), min(len(word), len(last)))
        while len(path) > same + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, arcs = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
    root = settle(*path[0])
    keys, target, skip = [], [], []
    for state, (final, arcs) in enumerate(states):
        at = int(final)
        for byte, t in arcs:
            keys.append(state << 8 | byte)
            target.append(t)
            skip.append(at)
            at += counts[t]
    parts = [np.array([*keys, 1 << 62], np.int64), np.array(target, np.int32), np.array(skip, np.int32), np.cumsum([0, *map(len, ids)], dtype=np.int32),
             np.fromiter(chain.from_iterable(ids), np.int32), np.array([s[0] for s in states], np.uint8)]
    head = np.array([root, *[p.nbytes for p in parts]], np.int64)
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """A compiled lexicon, read from a memory map. Arcs are sorted by state and byte."""

    def __init__(self, packed: bytes):
        import mmap
        import tempfile

        with tempfile.TemporaryFile() as f:  # the map keeps the pages; the name is gone at once
            f.write(packed)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, np.int64, 7)
        self.root, at, views = int(head[0]), head.nbytes, []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.int32, np.int32, np.uint8)):
            views.append(np.frombuffer(self.map, kind, n // np.dtype(kind).itemsize, at))
            at += n
        self.keys, self.target, self.skip, self.offsets, self.ids, self.final = views

    def ranks(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ranks of the words, -1 for words outside the lexicon; all walk an arc at a time."""
        n = len(start)
        state, rank, out = np.full(n, self.root, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        on, step = np.arange(n), 0
        while on.size:
            there = size[on] == step
            ends, on = on[there], on[~there]
            out[ends] = np.where(self.final[state[ends]] > 0, rank[ends], -1)
            key = state[on] << 8 | raw[start[on] + step]
            arc = np.searchsorted(self.keys, key)
            goes = self.keys[arc] == key
            on, arc = on[goes], arc[goes]
            rank[on] += self.skip[arc]
            state[on] = self.target[arc]
            step += 1
        return out

    def get(self, words: list[bytes]) -> list[list[int] | None]:
        """Token ids of each word, None for words outside the lexicon."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ranks = self.ranks(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        return [None if r < 0 else self.ids[self.offsets[r]: self.offsets[r + 1]].tolist() for r in ranks.tolist()]


class Encoder:
    """Ids of texts by the lexicon, and by merging for words outside it, which a bounded memo keeps."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self):
        self.memo: dict[bytes, int] = {}  # a word's place in the two arrays
        self.start, self.ids = np.zeros(1, np.int64), np.empty(0, np.int64)

    def _learned(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Places in the memo of the words at `at`."""
        if len(self.memo) > MEMO:
            self._forget()
        keys = words.bytes_of(at)
        new = {k: i for i, k in enumerate(keys) if k not in self.memo}
        if new:
            which = at[list(new.values())]
            ids, count = self.v.merged(words.raw, words.start[which], words.size[which])
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
            self.start = np.append(self.start, self.start[-1] + np.cumsum(count))
            self.ids = np.append(self.ids, ids)
        return np.array([self.memo[k] for k in keys], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text start, and the end."""
        words = self.v.split(column)
        first, kind = words.distinct()
        fixed, ranks = words.fixed[first], self.lexicon.ranks(words.raw, words.start[first], words.size[first])
        ranks[fixed >= 0] = -1
        known, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero((ranks < 0) & (fixed < 0))
        place = self._learned(words, first[unseen])
        count = np.ones(len(first), np.int64)
        start = np.zeros(len(first), np.int64)
        lex = self.lexicon
        # the ids of the lexicon, then the memo's, then the special tokens
        count[known], start[known] = lex.offsets[ranks[known] + 1] - lex.offsets[ranks[known]], lex.offsets[ranks[known]]
        count[unseen], start[unseen] = self.start[place + 1] - self.start[place], len(lex.ids) + self.start[place]
        start[fixed >= 0] = len(lex.ids) + len(self.ids) + np.arange((fixed >= 0).sum())
        source = np.concatenate([lex.ids, self.ids, fixed[fixed >= 0]])
        each = count[kind]
        ends = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        return source[spread(start[kind], each)], ends[words.rows]


def text_pieces(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE bytes of the text column, one row at least."""
    for b in batches:
        size = np.nan_to_num(pc.binary_length(b.column(col)).to_numpy(zero_copy_only=False).astype(float))
        part = (np.cumsum(size) // PIECE).astype(np.int64)
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for x, y in zip(bounds, bounds[1:]):
            if y > x:
                yield b.slice(x, y - x)


def _vocabulary(spec) -> Vocabulary:
    held = worker_cache()
    if ("vocabulary", spec.id) not in held:
        held["vocabulary", spec.id] = Vocabulary(*spec.value)
    return held["vocabulary", spec.id]


def _without(names: list[str], *gone: str | None) -> list[str]:
    """The columns that do not have one of these names, upper or lower case."""
    low = {g.lower() for g in gone if g}
    return [n for n in names if n.lower() not in low]


class Tokenizer:
    """Encoder and decoder of a tokenizer file; `fit` compiles the lexicon of a corpus.

    The file is read once by the driver (through Spark if the path has a scheme), and its text is broadcast: its size does not depend on data."""

    def __init__(self, spark: SparkSession, path: str):
        if "://" in path:
            text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        else:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        self.spark, self.vocabulary = spark, Vocabulary(text)
        self.spec = _Shared(spark, (text, self.vocabulary.kinds))
        self.lexicon = _Shared(spark, compile_lexicon([], []))

    def count_words(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(word, n) over all texts: counted in each task first, in a table that is passed on before it grows large."""
        spec = self.spec

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, seen = _vocabulary(spec), Counter()

            def out():
                rows = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen.clear()
                return rows

            for b in text_pieces(batches, 0):
                words = v.split(b.column(0))
                first, kind = words.distinct()
                own = words.fixed[first] < 0
                count = np.bincount(kind, minlength=len(first))[own].tolist()
                for word, n in zip(words.bytes_of(first[own]), count):
                    seen[word] += n
                if len(seen) > 250_000:
                    yield out()
            if seen:
                yield out()

        return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def fit(self, docs: DataFrame, size: int = LEXICON, text_col: str = "text") -> Tokenizer:
        """Compiles the most frequent words. A histogram of counts (on a log scale, so of bounded size) gives the least
        count that keeps the lexicon within `size`; only those words reach the driver."""
        counts = scratch.written(self.count_words(docs, text_col).filter((F.octet_length("word") <= 64) & (F.col("n") > 1)), "words")
        level = F.floor(F.log2(F.col("n")) * 32).cast("int")
        least = None
        for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
            size -= r.words
            if size < 0:
                break
            least = r.level
        if least is not None:
            words = sorted(bytes(r.word) for r in counts.filter(level >= least).select("word").collect())
            self.lexicon = _Shared(self.spark, compile_lexicon(words, self.vocabulary.encode_words(words)))
        return self

    def encode(self, docs: DataFrame, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
        """`docs` with the token ids of each whole text as `out`; the text is kept out of the result. With `decoded`, the ids
        are decoded again in the same task into a column of that name, which saves a second Python worker."""
        spec, lexicon = self.spec, self.lexicon
        rest = _without(docs.columns, text_col, out, decoded)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, held = _vocabulary(spec), worker_cache()
            if ("lexicon", lexicon.id) not in held:
                held["lexicon", lexicon.id] = Lexicon(lexicon.value)
            encoder = Encoder(v, held["lexicon", lexicon.id])
            for b in text_pieces(batches, -1):
                ids, at = encoder.encode(b.column(b.num_columns - 1))
                made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                if decoded:
                    made.append(v.texts(ids, at))
                yield pa.record_batch([*b.columns[:-1], *made], [*rest, out, *([decoded] if decoded else [])])

        schema = with_field(docs.select(*rest), out, T.ArrayType(T.IntegerType()))
        schema = T.StructType([*schema.fields, T.StructField(decoded, T.StringType())]) if decoded else schema
        return docs.select(*rest, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)

    def decode(self, rows: DataFrame, ids_col: str = "ids", out: str = "text") -> DataFrame:
        """`rows` with the text of the ids as `out`; bytes that are not UTF-8 become U+FFFD, NULL ids are skipped."""
        spec = self.spec
        rest = _without(rows.columns, out)
        rows = rows.select(*rest, F.coalesce(F.filter(ids_col, lambda x: x.isNotNull()), F.array().cast("array<int>")).alias("__ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = _vocabulary(spec)
            for b in pieces(batches, 1024):
                lists = b.column(b.num_columns - 1)
                at = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))
                yield pa.record_batch([*b.columns[:-1], v.texts(lists.flatten().to_numpy().astype(np.int64), at)], [*rest, out])

        return rows.mapInArrow(run, with_field(rows.select(*rest), out, T.StringType()))


class _Shared:
    """A broadcast value with a name that workers can keep it by."""

    def __init__(self, spark: SparkSession, value):
        import uuid

        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value
