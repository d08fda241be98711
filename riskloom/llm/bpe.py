"""Byte-level BPE encoding and decoding.

Each word is merged in a contiguous array of parts: the ids of its parts and, beside them, the rank of every adjacent
pair. The lowest rank is found by a scan, the boundary between its two parts is deleted, and the two neighbouring ranks
are looked up again. Short words of one length go through this together, as rows of one matrix that loses a column with
each merge; words of more than SHORT_WORD bytes one by one, and those of more than LONG_WORD bytes, for which repeated
scans would take quadratic time, by the same rule with a heap over the same ranks. Words recur, so the ids of words are
kept in a table of bounded size, which is emptied when it is full.

Words are found for whole batches: every byte gets the class of its character, runs of one class are words, and the few
rules of WORDS about blanks and apostrophes move their ends.

Rows: a null text counts as empty; an empty text has no ids and decodes to an empty text; a very long text is cut
between two words into pieces of about PIECE bytes, which changes no id; repeated rows give repeated results; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import short_batches, slices, utf8

# Fixed value: the pattern by which the public byte-level vocabulary splits text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT_WORD, LONG_WORD = 15, 192
PIECE = 2 << 20
NO_RANK = 1 << 62
NONE = np.iinfo(np.int32).max
SHIFT = 24
OTHER, LETTER, NUMBER, BLANK = range(4)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: A place between two words whatever stands around it.
BETWEEN = re.compile(rb"[A-Za-z](?= [A-Za-z])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point in the sense of WORDS."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character to which each byte of UTF-8 belongs."""
    table = character_classes()
    kinds = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        points = np.frombuffer(data[data >= 0x80].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kinds[lead] = kinds[lead + 1] = table[points]
        for least, step in ((0xE0, 2), (0xF0, 3)):
            long = lead[data[lead] >= least]
            kinds[long + step] = kinds[long]
    return kinds


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of several texts begin; equal to searches for WORDS in each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds, edge = byte_kinds(data), np.ones(n, bool)
    edge[1:] = kinds[1:] != kinds[:-1]
    text_end = np.zeros(n + 1, bool)
    text_end[offsets] = True
    edge |= text_end[:n]
    begins = np.flatnonzero(edge)
    ends = np.append(begins[1:], n)
    kind = kinds[begins]
    blank = (kind == BLANK) & ~text_end[ends]  # blanks before something: the last one parts from the others
    stop = ends[blank]
    last = stop - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    edge[last] = True
    edge[stop[data[last] == 32]] = False
    mark = (kind == OTHER) & (ends - begins == 1) & (data[begins] == 39) & edge[begins] & ~text_end[ends]
    at = begins[mark]
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[at + 1], padded[at + 2]
        two = np.where(text_end[np.minimum(at + 2, n)], 0, two)
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        edge[at[single | double] + 1] = False
        cut = np.concatenate([at[single] + 2, at[double] + 3])
        edge[cut[cut < n]] = True
    return np.flatnonzero(edge)


class WordTable:
    """Ids of words of at most SHORT_WORD bytes, found by their bytes: an open-addressed table over two integers."""

    def __init__(self, most: int):
        self.bits = max(12, int(2 * most - 1).bit_length())
        self.slots = 1 << self.bits
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.begin, self.count = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.uint8)
        self.claim = np.zeros(self.slots, np.int32)
        self.clear()

    def clear(self) -> None:
        self.high[:] = 0  # a word's length is in its high part, so 0 is free
        self.used, self.pool, self.filled = 0, np.zeros(1 << 16, np.uint32), 0

    def place(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of every word, slots of words that are new)."""
        mixed = (low ^ (high * GOLDEN) ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        new, left = [], np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        while len(left):
            at = slot[left]
            free = self.high[at] == 0
            takers = left[free]
            self.claim[at[free]] = takers
            takers = takers[self.claim[slot[takers]] == takers]  # one of those that want the slot
            self.low[slot[takers]], self.high[slot[takers]] = low[takers], high[takers]
            new.append(slot[takers])
            wrong = (self.low[at] != low[left]) | (self.high[at] != high[left])
            left = left[wrong]
            slot[left] = (slot[left] + 1) & (self.slots - 1)
            right = (self.low[slot[left]] == low[left]) & (self.high[slot[left]] == high[left])
            left = left[~right]
        fresh = np.concatenate(new) if new else np.zeros(0, np.int64)
        self.used += len(fresh)
        return slot, fresh

    def put(self, slots: np.ndarray, ids: np.ndarray) -> None:
        """ids: a row for each slot."""
        n, width = ids.shape
        if self.filled + ids.size > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), ids.size), np.uint32)])
        self.pool[self.filled : self.filled + ids.size] = ids.ravel()
        self.begin[slots], self.count[slots] = self.filled + width * np.arange(n), width
        self.filled += ids.size


def gather(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pieces of a pool, one after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)]


class ByteBPE:
    """A tokenizer read from a public vocabulary file; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached: int = 1 << 20):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in vocab.items():
            tokens[i] = text.encode() if text in self.special else as_bytes(text)
        for text, i in self.special.items():
            tokens[i] = text.encode()
        self.token_size = np.array([len(t) for t in tokens])
        self.token_begin = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)
        self.merges, self.made = {}, np.zeros(len(spec["model"]["merges"]), np.int32)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << SHIFT | vocab[b], rank << SHIFT | vocab[a + b])
            self.made[rank] = vocab[a + b]
        self.index_pairs()
        one = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.byte_ranks = self.look_up(*one).reshape(256, 256)
        self.find = regex.compile(WORDS).findall
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.table = WordTable(cached)
        self.long = lru_cache(maxsize=max(1, cached // 16))(self.merge)

    def index_pairs(self) -> None:
        """Ranks of pairs by multiplicative hashing, nine of ten slots free."""
        keys = np.array(list(self.merges), np.int64)
        ranks = np.array(list(self.merges.values()), np.int64) >> SHIFT
        self.pair_bits = max(4, int(8 * max(1, len(keys))).bit_length())
        self.pair_keys, self.pair_ranks = np.full(1 << self.pair_bits, -1, np.int64), np.full(1 << self.pair_bits, NONE, np.int32)
        slot = self.pair_slot(keys).tolist()
        for key, rank, at in zip(keys.tolist(), ranks.tolist(), slot):
            while self.pair_keys[at] >= 0:
                at = (at + 1) & ((1 << self.pair_bits) - 1)
            self.pair_keys[at], self.pair_ranks[at] = key, rank

    def pair_slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GOLDEN) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair is no merge."""
        keys = a.astype(np.int64) << SHIFT | b
        slot = self.pair_slot(keys)
        held = self.pair_keys[slot]
        out = np.where(held == keys, self.pair_ranks[slot], NONE)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.pair_bits) - 1)
            held = self.pair_keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.pair_ranks[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def merge(self, word: bytes) -> list[int]:
        parts = [int(self.single[b]) for b in word]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        find = self.merges.get
        ranks = [find(a << SHIFT | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = best & ((1 << SHIFT) - 1)
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(parts[i - 1] << SHIFT | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = find(parts[i] << SHIFT | parts[i + 1], NO_RANK)
        return parts

    def merge_many(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) of words of one length: row i of `parts` and `ranks` is the contiguous array of word i. Every word that isn't done merges once in each round, so all have the same number of parts."""
        parts, ranks = self.single[words], self.byte_ranks[words[:, :-1], words[:, 1:]]
        live = np.arange(len(words))
        while len(live):
            if not ranks.shape[1]:
                yield live, parts
                return
            best = ranks.argmin(1)
            row = np.arange(len(live))
            low = ranks[row, best]
            if (end := low == NONE).any():
                yield live[end], parts[end]
                go = ~end
                live, parts, ranks, best, low = live[go], parts[go], ranks[go], best[go], low[go]
                row = row[: len(live)]
            width = ranks.shape[1]
            columns = np.arange(width + 1)
            parts[row, best] = self.made[low]
            parts = parts[columns != (best + 1)[:, None]].reshape(len(row), width)
            ranks = ranks[columns[:-1] != best[:, None]].reshape(len(row), width - 1)
            left = np.flatnonzero(best > 0)
            at = best[left]
            ranks[left, at - 1] = self.look_up(parts[left, at - 1], parts[left, at])
            right = np.flatnonzero(best < width - 1)
            at = best[right]
            ranks[right, at] = self.look_up(parts[right, at], parts[right, at + 1])

    def learn(self, slots: np.ndarray) -> None:
        """Fills new slots of the table with the ids of their words."""
        table = self.table
        size = (table.high[slots] >> np.uint64(56)).astype(np.int64)
        raw = np.stack([table.low[slots], table.high[slots]], 1).astype("<u8").view(np.uint8)
        for n in range(1, SHORT_WORD + 1):
            own = np.flatnonzero(size == n)
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)]
                for rows, ids in self.merge_many(raw[part, :n]):
                    table.put(slots[part[rows]], ids)

    def words(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words that follow each other, how many each word has)."""
        table, size = self.table, ends - begins
        if table.used + len(begins) > table.slots * 3 // 4:
            table.clear()
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        at = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        short = size <= SHORT_WORD
        low = at[begins] & masks[np.minimum(size, 8)]
        high = at[np.minimum(begins + 8, len(data) + 8)] & masks[np.clip(size - 8, 0, 7)] | np.minimum(size, SHORT_WORD).astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(~short)
        if len(long):
            low[long], high[long] = 32, 1 << 56  # a blank stands in; its ids are replaced below
        slot, new = table.place(low, high)
        self.learn(new)
        begin, count = table.begin[slot].astype(np.int64), table.count[slot].astype(np.int64)
        if not len(long):
            return gather(table.pool, begin, count), count
        raw = data.tobytes()
        own = [self.long(raw[a:b]) for a, b in zip(begins[long].tolist(), ends[long].tolist())]
        count[long] = [len(x) for x in own]
        begin[long] = table.filled + np.cumsum(count[long]) - count[long]
        pool = np.concatenate([table.pool[: table.filled], np.array([i for x in own for i in x], np.uint32)])
        return gather(pool, begin, count), count

    def encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens and where each text's ids begin and the last ones end."""
        begins = word_starts(data, offsets)
        ends, block = np.append(begins[1:], len(data)), self.table.slots // 4
        done = [self.words(data, begins[i : i + block], ends[i : i + block]) for i in range(0, len(begins), block)]
        flat = np.concatenate([ids for ids, _ in done]) if done else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], *(count for _, count in done)]).cumsum()
        return flat, upto[np.searchsorted(begins, offsets)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last ones end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = np.zeros(len(texts), bool)
        for mark in self.special:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if odd.any():
            own = {i: np.frombuffer(self.encode(texts[i].as_py()), "<u4") for i in np.flatnonzero(odd).tolist()}
            flat, at = self.encode_batch(pc.if_else(pa.array(odd), "", texts))
            pieces = [own[i] if i in own else flat[a:b] for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))]
            return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        data, offsets = utf8(texts)
        cuts = self.pieces(data, offsets)
        if len(cuts) == 2:
            return self.encode_plain(data, offsets)
        flats, at, before = [], [np.zeros(1, np.int64)], 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            inner = offsets[(offsets > a) & (offsets <= b)]
            flat, upto = self.encode_plain(data[a:b], np.concatenate([[0], inner - a, [b - a]]))
            at.append(upto[1:-1] + before)
            flats.append(flat)
            before += len(flat)
        empty = np.zeros((offsets[1:] == 0).sum(), np.int64)  # texts before the first byte
        return np.concatenate(flats), np.concatenate([at[0], empty, *at[1:]])

    @staticmethod
    def pieces(data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Ends of pieces of about PIECE bytes: ends of texts or, in long texts, places between two words."""
        cuts, raw = [0], None
        while len(data) - cuts[-1] > 2 * PIECE:
            i = np.searchsorted(offsets, cuts[-1] + PIECE)
            end = int(offsets[i])
            if end - cuts[-1] > 2 * PIECE:
                raw = raw or data.tobytes()
                found = BETWEEN.search(raw, cuts[-1] + PIECE, end)
                end = found.end() if found else end
            cuts.append(end)
        return [*cuts, len(data)] if cuts[-1] < len(data) or len(cuts) == 1 else cuts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges with a heap of (rank, place); stale entries are recognised and skipped."""
        n, find = len(parts), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := find(parts[i] << SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or find(parts[i] << SHIFT | parts[j]) != rank:
                continue
            parts[i], parts[j], after[i] = rank & ((1 << SHIFT) - 1), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := find(parts[a] << SHIFT | parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def plain(self, text: str) -> np.ndarray:
        raw = text.encode()
        return self.encode_plain(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [self.plain(text[at : m.start()]), [self.special[m[0]]]]
            at = m.end()
        return np.concatenate([*out, self.plain(text[at:])]).astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.token_bytes, self.token_begin[ids], self.token_size[ids]).tobytes().decode("utf-8", "replace")

    def decode_batch(self, flat: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of several sequences of ids."""
        size = self.token_size[flat]
        data = gather(self.token_bytes, self.token_begin[flat], size)
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        out = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that cut characters
            raw = data.tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.large_string())
        return out


@lru_cache(maxsize=1)
def tokenizer(path: str, cached: int = 1 << 20) -> ByteBPE:
    """One for each worker process; it stays with the worker, so `cached` bounds what later stages leave it."""
    return ByteBPE(path, cached)


def encode_decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", cached: int = 1 << 20) -> DataFrame:
    """Encodes every whole text and decodes the ids again: id column, n_tokens, ids (binary), decoded."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocab, cached)
        for batch in slices(batches, 4096, PIECE):
            flat, at = bpe.encode_batch(batch["text"])
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(flat)])
            texts = bpe.decode_batch(flat, at).cast(pa.string())
            yield pa.record_batch([batch["id"], pa.array(np.diff(at), pa.int64()), ids.cast(pa.binary()), texts], ["id", "n_tokens", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
