"""Near-duplicate documents by SimHash fingerprints, found through Golay-code keys.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 hashes (seed 42) of the text's runs of
three words, repeats included. Two fingerprints link if they differ in at most three bits; a document's component is the
smallest id that links lead to.

Candidates. The 64 bits are three segments of 22, 21 and 21 bits, each padded with zeros to a word of the binary Golay
code of length 23, which is perfect: every word lies within three bits of exactly one codeword. At most one segment can
hold more than one of three differing bits, so some two segments differ in one bit each at most. If words x and y differ
in one bit, the codeword nearest to x is within four bits of y; and if y is within two bits of a codeword, both have that
one as their nearest. So y is known by its nearest codeword and, if that is three bits away, by the five that are four
bits away: six keys at most, of which one is the codeword nearest to x. For each pair of segments a fingerprint takes
the keys (nearest of the first, any of the second) and (any of the first, nearest of the second), about 29 in all, and
any two linked fingerprints share one. Nothing is lost, whatever the data.

Verification. Fingerprints are distinct before they get keys, so copies of a text, however many, are one. Members of a
key meet in one partition, which compares them bit by bit: pairs of small groups at once, larger groups by a search
that hands out a spanning forest, so a group of m yields m - 1 links instead of m * m. A group of more than BIG members is
handed on: two fingerprints that differ in three bits have a word between them that is two bits from one and one bit
from the other. Those words are the keys then (2081 for a fingerprint), and all within two bits of a word link to the
least that is within one bit of it, which needs neither pairs nor groups in memory.

Rows: each row counts as a document of its own, also where ids repeat; a null id takes part, and its component is the
smallest id reached, or null if no linked row has one; null, empty and blank texts have the fingerprint zero, which links
like any other; texts of one or two words are a single run; very long texts are read in parts of PART bytes, with the
same runs; an empty table gives an empty table; extra columns are ignored. Only A-Z are lower-cased; words end at blanks
and the characters 9 to 13.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import discard, materialize, short_batches, slices, utf8
from riskloom.llm.minhash_dedup import components

WORDS, SEED, DISTANCE = 3, 42, 3
PART = 1 << 20
#: Where segments begin, and the end.
CUTS = (0, 22, 43, 64)
#: Groups of so many members are compared pair by pair; of more than BIG, by the words between them.
SMALL, BIG = 32, 1 << 15
SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: So many links (16 bytes each) are followed in one task.
LOCAL_LINKS = 1_000_000
#: Fixed value: the generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR, LENGTH, CHECKS = 0xAE3, 23, 11


class Golay:
    """Codewords near to words of 23 bits, named by their 12 message bits (the upper ones)."""

    def __init__(self):
        rest = np.arange(1 << (LENGTH - CHECKS), dtype=np.int64) << CHECKS
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
        self.rest = rest  # of message bits, divided by the polynomial
        weights = {w: np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), w)], np.int64) for w in range(5)}
        self.errors = np.full((1 << CHECKS, 6), -1, np.int64)
        for w in range(4):  # within three bits of the code: one pattern for each remainder
            self.errors[self.remainder(weights[w]), 0] = weights[w]
        far = np.bitwise_count(self.errors[:, 0].astype(np.uint64)) == 3
        four = self.remainder(weights[4])
        order = np.argsort(four, kind="stable")
        self.errors[far, 1:] = weights[4][order].reshape(-1, 5)  # five of weight four for each remainder with one of weight three

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return words & ((1 << CHECKS) - 1) ^ self.rest[words >> CHECKS]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Six columns: the nearest codeword, and those four bits away if the nearest is three bits away (-1 if not)."""
        errors = self.errors[self.remainder(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)


def parts(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; each list begins with the last words of the one before, so that no run is lost."""
    at, last = 0, []
    while at < len(text):
        end = len(text)
        if at + size < end and (found := SPACE.search(text, at + size)):
            end = found.start()
        words = last + text[at:end].lower().split()
        yield words
        at, last = end, words[len(words) - WORDS + 1 :] if len(words) >= WORDS else words


def fingerprint(text: bytes, part: int = PART) -> int:
    ones, n, words = np.zeros(64, np.int64), 0, []
    for words in parts(text, part):
        if len(words) < WORDS:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -WORDS] + 1])
        joined = b" ".join(words)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1 :].tolist())), np.uint64, len(starts))
        ones += bits_set(hashes)
        n += len(hashes)
    if not n and words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many have each bit, the lowest first."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8")
        out += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def sketches(texts: DataFrame, part: int = PART) -> DataFrame:
    """fp (the 64 bits as a bigint) of each row of id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 4 << 20):
            data, offsets = utf8(batch["text"])
            found = [fingerprint(data[a:b].tobytes(), part) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch["id"], pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    return texts.mapInArrow(run, "id bigint, fp bigint")


def keyed(nodes: DataFrame) -> DataFrame:
    """key, fp: every key of every fingerprint once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in slices(batches, 20_000):
            signed = batch["fp"].to_numpy()
            bits = signed.view(np.uint64)
            near = [code.keys(((bits >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)) for a, b in zip(CUTS, CUTS[1:])]
            keys, owners = [], []
            for which, (i, j) in enumerate(combinations(range(3), 2)):
                for column in range(6):
                    for one, two in [(near[i][:, 0], near[j][:, column])] + ([(near[i][:, column], near[j][:, 0])] if column else []):
                        there = (one >= 0) & (two >= 0)
                        keys.append(which << 24 | one[there] << 12 | two[there])
                        owners.append(signed[there])
            yield pa.record_batch([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(np.concatenate(owners))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key int, fp bigint")


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= DISTANCE


def forest(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (ends, ends) that join what is connected among some fingerprints; each is reached once."""
    rest, out = np.arange(1, len(values)), []
    ahead = [0] if len(values) else []
    while len(rest):
        if not ahead:
            ahead, rest = [int(rest[0])], rest[1:]
        at = ahead.pop()
        found = near(values[rest], values[at])
        if found.any():
            reached, rest = rest[found], rest[~found]
            out.append((np.full(len(reached), values[at]), values[reached]))
            ahead += reached.tolist()
    return out


def linked(keys: np.ndarray, values: np.ndarray, small: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within groups of equal keys (sorted, whole)."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    out = []
    few = np.repeat(sizes <= small, sizes)
    k, v, step = keys[few], values[few], 1
    while len(v) > step:  # all pairs of small groups, by their distance in the order
        same = k[step:] == k[:-step]
        if not same.any():
            break
        a, b = v[:-step][same], v[step:][same]
        found = near(a, b)
        out.append((a[found], b[found]))
        step += 1
    for at, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        out += forest(values[at : at + size])
    return out


def matches(members: DataFrame, small: int, big: int) -> DataFrame:
    """a, b: links found within keys; b is null for a member of a key with more than big members, which are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int32), np.zeros(0, np.uint64)
        over = None  # the key whose members are handed on
        none = np.zeros(0, np.uint64)

        def rows(a: np.ndarray, b: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
            ends = pa.concat_arrays([pa.array(b.view(np.int64)), pa.nulls(len(alone), pa.int64())])
            return pa.record_batch([pa.array(np.concatenate([a, alone]).view(np.int64)), ends], ["a", "b"])

        def flat(found: list) -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.concatenate([none, *[f[i] for f in found]]) for i in (0, 1))

        for batch in slices(batches, 1 << 16):
            k, v = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if over is not None:
                go = k == over
                yield rows(none, none, v[go])
                k, v = k[~go], v[~go]
            keys, values = np.concatenate([keys, k]), np.concatenate([values, v])
            if not len(keys):
                continue
            over = None
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            large = np.repeat(sizes > big, sizes)
            if large.any():
                yield rows(none, none, values[large])
                over = int(keys[-1]) if large[-1] else None
                keys, values = keys[~large], values[~large]
            held = len(keys) if over is not None else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield rows(*flat(linked(keys[:held], values[:held], small)), none)
            keys, values = keys[held:], values[held:]
        yield rows(*flat(linked(keys, values, small)), none)

    dealt = members.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def flips(most: int) -> list[int]:
    """All words of 64 bits with at most so many bits set, as signed integers."""
    signed = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    return [sum(bits) for w in range(most + 1) for bits in combinations(signed, w)]


def between(nodes: DataFrame) -> DataFrame:
    """Links a, b of fingerprints by the words between them: all within two bits of a word, if one is within one bit."""

    def words(most: int) -> DataFrame:
        flip = F.explode(F.expr(f"array({', '.join(f'bigint({x})' for x in flips(most))})"))
        return nodes.select("fp", flip.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))

    around, hubs = words(2), words(1).groupBy("word").agg(F.min("fp").alias("hub"))
    return around.join(hubs, "word").filter("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that links lead to) of the ends of some links."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = np.minimum(new, new[label])
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def connected(links: DataFrame, most: int = LOCAL_LINKS) -> DataFrame:
    """(id, label): the smallest id that links lead to. Up to `most` links meet in one task, where a few array operations do it; more are followed in rounds of joins."""
    if links.count() > most:
        return components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches]
        none = np.zeros(0, np.int64)
        ids, label = spread(*(np.concatenate([none, *[p[i] for p in parts]]) for i in (0, 1)))
        yield pa.record_batch([pa.array(ids), pa.array(label)], ["id", "label"])

    return materialize(links.select("a", "b").repartition(1).mapInArrow(run, "id bigint, label bigint"), "labels")


def fuzzy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, big: int = BIG, part: int = PART) -> DataFrame:
    """A row for each row: the id column, fp (the fingerprint as a bigint) and component (the smallest id reached)."""
    short_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    rows = materialize(sketches(texts, part), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    found = materialize(matches(keyed(nodes), small, big), "links")
    links = found.filter("b is not null").select("a", "b")
    handed = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if not handed.isEmpty():
        links = materialize(links.unionByName(between(materialize(handed, "handed-on"))), "links")
    labels = connected(links)
    discard(found)
    named = nodes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component"))
    known = materialize(named.join(smallest, "label").select(F.col("fp").alias("own"), "component"), "components")
    return rows.join(known, F.col("fp") == F.col("own")).select(F.col("id").alias(id_col), "fp", "component")
