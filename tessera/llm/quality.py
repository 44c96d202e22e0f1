"""Quality classifier: interpolated modified Kneser-Ney trigrams, one model a language.

A model counts half of the language's trusted texts, whole, and is normalised by itself;
the other half, also whole, sets its threshold. Words that the counted half has rarely are
modelled by their shape (classes of characters, runs shortened), so that casing, symbols
and layout count where words are new. Counts are tables in hash shards: blocks of texts
send their distinct trigrams to the shard of their last two words, where those of all
blocks are summed and the words before each pair are distinct. What a probability needs of
other shards (how a context goes on, how many pairs end in a word) is sent to the shards
of those keys, summed there and sent back. The log-probability of a document is a sum
over its n-grams: the unigrams give what backing off all the way would, each bigram and
trigram that the model counted adds what it changes. So the count tables are joined by
shard: the values of the most frequent n-grams, a bounded number, are with the blocks of
documents. What else a Bloom filter lets pass is sent, with the documents that have it, to
the shard and salt of its keys, where a shard of the tables meets it and returns one sum a
document. An n-gram has the same value either way.
A document is rejected if its perplexity exceeds the quantile that the language's trusted
documents not trained on, all of them, set.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import GOLD, MOST_IDS, among, bucketed, drop, hash_of, lean, materialize, mix, release, sent_ids, small_batches, spread, squeezed, steps, summed, utf8_column

CLASSES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
RUNS = [(re.compile(rb"aa+"), b"a"), (re.compile(rb"AA+"), b"A"), (re.compile(rb"00+"), b"0"), (re.compile(rb"([^aA0\n])\1\1+"), rb"\1\1")]
POOLED = ""
NEW_SHAPE = b"\x00"
#: Words that a worker remembers over all languages.
KNOWN_WORDS = 150_000
#: Classes of counts by powers of 2 ** (1 / 8).
CLASSES_OF_COUNTS = 512
#: Words that a block looks up at a time, in arrays that stay in the cache.
PIECE_WORDS = 50_000
#: Bits of a trigram's key that are those of its last two words: these give the shard.
SHARD_BITS = np.uint64(20)
#: Bits of the Bloom filter (16 MB), at most.
MOST_BITS = 1 << 27
WORDS = "model string, shard int, keys binary, shapes binary, counts binary"
GRAMS = "model string, shard int, u binary, v binary, w binary, n binary, counts array<long>"
NEEDS = "model string, part int, shard int, keys binary, sums binary"
FREQUENT = "shard int, keys binary, value binary, back binary, bits binary"
DOCS = "ids array<long>, langs array<string>, models array<string>, sizes array<long>, base array<double>, probes array<boolean>"
TABLES = "shard int, salt int, role int, model string, part int, u binary, v binary, w binary, n binary"
ASKED = f"block long, shard int, salt int, u binary, v binary, w binary, n binary, {DOCS}"
SUMMED = f"block long, shard int, sums binary, {DOCS}"
SCORED = "doc_id long, lang string, model string, n_words long, total double, probe boolean"
#: Arrow types of the schemas' columns.
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_()), "double": pa.float64()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], KINDS[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def shape(word: bytes) -> bytes:
    """The classes of the characters; runs of one are shortened to one, or two of a symbol."""
    return shapes([word])[0]


def shapes(words: list[bytes]) -> list[bytes]:
    """Of many words at once; no word has a line feed."""
    out = b"\n".join(words).translate(CLASSES)
    for of, by in RUNS:
        out = of.sub(by, out)
    return out.split(b"\n")


def discounts(n: list[int]) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n = [max(1, int(x)) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0.0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.05, [0.05, 0.95, 1.9, 2.9])


def ones_to_fours(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def salt_of(model: str) -> np.uint64:
    return np.uint64(hash_of(model.encode()))


def pair_keys(u: np.ndarray, v: np.ndarray, salt) -> np.ndarray:
    """Keys of pairs of places in the vocabulary of a model."""
    return mix(u.astype(np.uint64) * GOLD + v.astype(np.uint64) + salt)


def triple_keys(u: np.ndarray, v: np.ndarray, w: np.ndarray, salt) -> np.ndarray:
    """u: places + 1, or 0 where a document begins with the pair. The first SHARD_BITS are those of (v, w)."""
    return with_tail(mix((u.astype(np.uint64) * GOLD + v.astype(np.uint64)) * GOLD + w.astype(np.uint64) + salt + np.uint64(3)), pair_keys(v, w, salt))


def with_tail(keys: np.ndarray, tail: np.ndarray) -> np.ndarray:
    rest = np.uint64(64) - SHARD_BITS
    return tail >> rest << rest | keys & np.uint64((1 << int(rest)) - 1)


def word_keys(w: np.ndarray, model: str) -> np.ndarray:
    return mix(w.astype(np.uint64) + np.uint64(hash_of(model.encode() + b" words")))


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the first SHARD_BITS, so that the keys of a shard are a range and trigrams are where their last two words are."""
    return ((keys >> (np.uint64(64) - SHARD_BITS)) * np.uint64(shards) >> SHARD_BITS).astype(np.int64)


def parts_of(keys: np.ndarray, shards: int):
    """(shard, slice) of ascending keys."""
    cuts = np.searchsorted(shards_of(keys, shards), np.arange(shards + 1)).tolist()
    return ((k, slice(cuts[k], cuts[k + 1])) for k in range(shards) if cuts[k] < cuts[k + 1])


def _in_blocks(block_words: int, schema: str, own_rows):
    """own_rows(model, texts as words) for blocks of the texts of a model."""

    @lean
    def run(batches):
        held, total = {}, 0
        make = own_rows()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                for model, text in zip(rows.column(0).to_pylist(), utf8_column(rows.column(1)), strict=True):
                    own = text.split()
                    held.setdefault(model, []).append(own)
                    total += len(own)
                    if total >= block_words:
                        for name, docs in held.items():
                            yield batch_of(make(name, docs), schema)
                        held, total = {}, 0
        for name, docs in held.items():
            yield batch_of(make(name, docs), schema)

    return run


def _word_counter(shards: int):
    def make():
        def rows(model: str, docs: list[list[bytes]]) -> list[tuple]:
            own = Counter(itertools.chain.from_iterable(docs))
            keys = np.fromiter(map(hash_of, own), np.uint64, len(own))
            own_shapes = np.fromiter((hash_of(NEW_SHAPE + x) for x in shapes(list(own))), np.uint64, len(own))
            counts, order = np.fromiter(own.values(), np.int64, len(own)), np.argsort(keys)
            keys, own_shapes, counts = keys[order], own_shapes[order], counts[order]
            return [(model, k, steps(keys[at]), squeezed(own_shapes[at]), squeezed(counts[at])) for k, at in parts_of(keys, shards)]

        return rows

    return make


def _tokens_of(vocabulary_count: int):
    def run(table: pa.Table) -> pa.Table:
        """All words of a shard: those that are often there, and the shapes of the others."""
        keys, at, back = np.unique(np.concatenate([summed(x) for x in table["keys"].to_pylist()]), return_index=True, return_inverse=True)
        shapes = np.concatenate([spread(x, np.uint64) for x in table["shapes"].to_pylist()])[at]
        often = np.bincount(back, np.concatenate([spread(x, np.int64) for x in table["counts"].to_pylist()])) >= vocabulary_count
        tokens = np.unique(np.concatenate([keys[often], shapes[~often]]))
        return pa.table({"model": table["model"][:1], "tokens": pa.array([tokens.tobytes()], pa.binary())})

    return run


def merged(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, salt) -> tuple:
    """Distinct (u, v, w) with their counts, in the order of pairs (v, w), and the keys of these."""
    keys = triple_keys(u, v, w, salt)
    order = np.argsort(keys)
    first = starts(keys[order])
    n = np.add.reduceat(n[order], first) if len(first) else n
    at = order[first]
    u, v, w = u[at], v[at], w[at]
    tail = pair_keys(v, w, salt)
    order = np.argsort(tail)
    return u[order], v[order], w[order], n[order], tail[order]


def starts(ascending: np.ndarray) -> np.ndarray:
    """Places at which another value begins."""
    return np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)


def _gram_counter(models, shards: int):
    def make():
        vocabulary = Vocabulary(models.value)

        def rows(model: str, docs: list[list[bytes]]) -> list[tuple]:
            places = [vocabulary.places(model, x) for x in docs]
            doc = np.repeat(np.arange(len(places)), [len(x) for x in places])
            tokens = np.concatenate([*places, np.zeros(0, np.int64)])
            inside = doc[1:] == doc[:-1]
            u = np.zeros(len(inside), np.int64)
            u[1:][inside[:-1]] = tokens[:-2][inside[:-1]] + 1
            u, v, w, n, tail = merged(u[inside], tokens[:-1][inside], tokens[1:][inside], np.ones(int(inside.sum()), np.int64), salt_of(model))
            return [(model, k, *(squeezed(x[at].astype(np.uint32)) for x in (u, v, w, n)), None) for k, at in parts_of(tail, shards)]

        return rows

    return make


class Pairs:
    """What the sorted (u, v, w) of a shard say of its pairs (v, w)."""

    def __init__(self, model: str, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, tail: np.ndarray):
        first = starts(tail)
        self.model, self.keys, self.v, self.w = model, tail[first], v[first], w[first]
        self.some = u > 0  # triples; the others are pairs that begin a document
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tail))))
        self.of, self.n = of[self.some], n[self.some]
        # continuation counts: how many words stand before a pair, or 1 before one that only begins documents
        self.before = np.maximum(np.bincount(self.of, minlength=len(first)), 1)
        self.times = np.bincount(of, n, len(first)).astype(np.int64)
        self.triple = u[self.some], v[self.some], w[self.some]

    def ask(self) -> Pairs:
        """Find the keys whose sums over all shards are needed."""
        u, v, _ = self.triple
        asked = [pair_keys(u - 1, v, salt_of(self.model)), self.keys, word_keys(self.v, self.model), word_keys(self.w, self.model)]
        self.needs, at = np.unique(np.concatenate(asked), return_inverse=True)
        self.context, self.own, self.at_v, self.at_w = np.split(at, np.cumsum([len(x) for x in asked])[:-1])
        return self

    def gives(self) -> np.ndarray:
        """For each key of needs: how often it goes on 1, 2, 3 or more times, and in all; the pairs that end in it; whether it is a word."""
        out = np.zeros((6, len(self.needs)), np.int64)
        for at, n in ((self.context, self.n), (self.at_v, self.before)):
            for k in range(3):
                out[k] += np.bincount(at[np.minimum(n, 3) == k + 1], minlength=len(self.needs))
            out[3] += np.bincount(at, n, len(self.needs)).astype(np.int64)
        out[4] = np.bincount(self.at_w, minlength=len(self.needs))
        out[5][self.at_v] = out[5][self.at_w] = 1
        return out

    def values(self, sums: np.ndarray, p1: np.ndarray, back1: np.ndarray, d2: np.ndarray, d3: np.ndarray) -> tuple:
        """(keys, values, back-off weights, counts) of pairs, then triples, from the sums over all shards for needs."""
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = (self.before - d2[np.minimum(self.before, 3)]) / sums[3][self.at_v] + np.exp(back1[self.v] + p1[self.w])
            held, total = d3[1:] @ sums[:3], sums[3]
            back = np.where(total > 0, np.log(held / total), 0.0)
        c = self.context
        p3 = (self.n - d3[np.minimum(self.n, 3)]) / total[c] + np.exp(back[c]) * p2[self.of]
        two = np.log(p2) - p1[self.w] - back1[self.v]
        three = np.log(p3) - back[c] - np.log(p2[self.of])
        return np.concatenate([self.keys, triple_keys(*self.triple, salt_of(self.model))]), np.concatenate([two, three]), np.concatenate([back[self.own], np.zeros(len(three))]), np.concatenate([self.times, self.n])


def pairs_of(model: str, u: bytes, v: bytes, w: bytes, n: bytes) -> Pairs:
    u, v, w, n = (spread(x, np.uint32).astype(np.int64) for x in (u, v, w, n))
    return Pairs(model, u, v, w, n, pair_keys(v, w, salt_of(model))).ask()


def class_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(8 * np.log2(counts)), CLASSES_OF_COUNTS - 1).astype(np.int64)


def _gatherer(table: pa.Table) -> pa.Table:
    """All trigrams of a shard of a model, summed; how many have counts of 1 to 4, pairs likewise, and the classes of both."""
    model = table["model"][0].as_py()
    parts = [np.concatenate([spread(x, np.uint32) for x in table[c].to_pylist()]).astype(np.int64) for c in "uvwn"]
    u, v, w, n, tail = merged(*parts, salt_of(model))
    p = Pairs(model, u, v, w, n, tail)
    counts = [*ones_to_fours(p.n), *ones_to_fours(p.before), *np.bincount(class_of(np.concatenate([p.n, p.times])), minlength=CLASSES_OF_COUNTS).tolist()]
    return pa.Table.from_batches([batch_of([(model, table["shard"][0].as_py(), *(squeezed(x.astype(np.uint32)) for x in (u, v, w, n)), counts)], GRAMS)])


def _needer(shards: int):
    @lean
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                p = pairs_of(*(row[c] for c in ("model", "u", "v", "w", "n")))
                gives = p.gives()
                yield batch_of([(row["model"], k, row["shard"], steps(p.needs[own]), squeezed(gives[:, own].ravel())) for k, own in parts_of(p.needs, shards)], NEEDS)

    return run


def _summer(table: pa.Table) -> pa.Table:
    """All that shards give for the keys of one: the sums for each; those of words once more, in a row of shard -1."""
    keys = [summed(x) for x in table["keys"].to_pylist()]
    gives = np.concatenate([spread(x, np.int64).reshape(6, -1) for x in table["sums"].to_pylist()], axis=1)
    each, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.stack([np.bincount(back, x, len(each)).astype(np.int64) for x in gives])
    cuts = np.cumsum([0, *map(len, keys)])
    model, part = table["model"][0].as_py(), table["part"][0].as_py()
    rows = [(model, part, shard, None, squeezed(sums[:4, back[cuts[k] : cuts[k + 1]]].ravel())) for k, shard in enumerate(table["shard"].to_pylist())]
    word = sums[5] > 0
    rows.append((model, part, -1, each[word].tobytes(), squeezed(sums[:5, word].ravel())))
    return pa.Table.from_batches([batch_of(rows, NEEDS)])


def unigrams_of(model: str, tokens: np.ndarray, parts: list[tuple[bytes, bytes]], d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the probabilities and back-off weights of a model's words."""
    sums = np.zeros((5, len(tokens)), np.int64)
    own = word_keys(np.arange(len(tokens)), model)
    order = np.argsort(own)
    for keys, packed in parts:
        if keys:
            sums[:, order[np.searchsorted(own[order], np.frombuffer(keys, np.uint64))]] = spread(packed, np.int64).reshape(5, -1)
    into, size = sums[4], len(tokens)
    d1 = discounts(ones_to_fours(into))[np.minimum(into, 3)] * (into > 0)
    p1 = (into - d1) / into.sum() + d1.sum() / into.sum() / size if into.sum() else np.full(size, 1 / size)
    back = np.where(sums[3] > 0, d2[1:] @ sums[:3] / np.maximum(sums[3], 1), 1.0)
    return np.log(p1), np.log(back)


class Vocabulary:
    """Places and unigram values of the words of a language; words met are kept in a bounded dict."""

    def __init__(self, models: dict[str, tuple]):
        self.own, self.known, self.n_known = models, {name: {} for name in models}, 0

    def places(self, model: str, words: list[bytes]) -> np.ndarray:
        tokens = self.own[model][0]
        if self.n_known >= KNOWN_WORDS:
            for x in self.known.values():
                x.clear()
            self.n_known = 0
        known = self.known[model]
        new = list(set(words).difference(known))
        if new:

            def at(kept: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                hashes = np.fromiter(map(hash_of, kept), np.uint64, len(kept))
                place = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                return place, tokens[place] == hashes

            place, there = at(new)
            rare = np.flatnonzero(~there)
            if len(rare):
                of_shape, there = at([NEW_SHAPE + x for x in shapes([new[k] for k in rare.tolist()])])
                place[rare] = np.where(there, of_shape, at([NEW_SHAPE])[0][0])
            known.update(zip(new, place.tolist(), strict=True))
            self.n_known += len(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked keys among ascending ones, and whether they are there."""
    place = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return place, keys[place] == asked if len(keys) else np.zeros(len(asked), bool)


class Frequent:
    """The hot n-grams, found by the bits of their keys that follow those of the shard."""

    def __init__(self, keys: np.ndarray, value: np.ndarray, back: np.ndarray):
        """keys: as turned gives them, ascending."""
        self.keys, self.value, self.back = keys, value, back
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.low = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.low[1:])

    @staticmethod
    def turned(keys: np.ndarray) -> np.ndarray:
        return keys << SHARD_BITS | keys >> (np.uint64(64) - SHARD_BITS)

    def found(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the asked keys, and whether they are there."""
        asked = self.turned(asked)
        first = (asked >> self.shift).astype(np.int64)
        place, end = self.low[first], self.low[first + 1]
        there = np.zeros(len(asked), bool)
        left = np.flatnonzero(place < end)
        while len(left):
            own, key = self.keys[place[left]], asked[left]
            there[left[own == key]] = True
            left = left[own < key]
            place[left] += 1
            left = left[place[left] < end[left]]
        return place, there


def bits_of(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each key among the bits of its shard."""
    h = mix(keys)
    return [((x * np.uint64(bits)) >> np.uint64(32)).astype(np.int64) for x in (h & np.uint64(0xFFFFFFFF), h >> np.uint64(32))]


def filter_of(keys: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits // 8, np.uint8)
    for at in bits_of(keys, bits):
        np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out.tobytes()


def passed(filter_: np.ndarray, keys: np.ndarray, shards: int) -> np.ndarray:
    """Which keys the filters of their shards let pass."""
    bits = 8 * len(filter_) // shards
    base, out = shards_of(keys, shards) * bits, np.ones(len(keys), bool)
    for at in bits_of(keys, bits):
        at += base
        out &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


class Asked:
    """The n-grams of a block of documents: the sums of the hot ones, and those to ask for."""

    def __init__(self, hot: Frequent, filter_: np.ndarray, shards: int):
        self.hot, self.filter, self.shards = hot, filter_, shards
        self.n_docs, self.keys, self.whose, self.last, self.sums = 0, [], [], [], []

    def take(self, docs: list[np.ndarray], salts: list[np.uint64]) -> None:
        """Further documents, of places."""
        sizes = np.array([len(x) for x in docs], np.int64)
        tokens, doc = np.concatenate([*docs, np.zeros(0, np.int64)]), np.repeat(np.arange(len(docs)), sizes)
        salt = np.repeat(np.array(salts, np.uint64), sizes)
        at = np.flatnonzero(doc[1:] == doc[:-1])  # first places of pairs
        two = pair_keys(tokens[at], tokens[at + 1], salt[at])
        whose = doc[at]
        sums, there, cold = self._looked_up(two, whose, len(docs))
        has = there | cold
        both = np.flatnonzero(has[:-1] & has[1:] & (whose[:-1] == whose[1:]))  # a trigram has two pairs
        u, v, w = (tokens[at[both] + k] for k in range(3))
        three = with_tail(mix(((u + 1).astype(np.uint64) * GOLD + v.astype(np.uint64)) * GOLD + w.astype(np.uint64) + salt[at[both]] + np.uint64(3)), two[both + 1])
        more, _, cold3 = self._looked_up(three, whose[both], len(docs))
        sums += more
        ends = np.flatnonzero(np.append(whose[1:] != whose[:-1], True)) if len(at) else at  # the last pairs, which nothing follows
        hot = ends[there[ends]]
        place, _ = self.hot.found(two[hot])
        sums -= np.bincount(whose[hot], self.hot.back[place], len(docs))
        ends = ends[cold[ends]]
        self.sums.append(sums)
        self.last.append((two[ends], whose[ends] + self.n_docs))
        self.keys += [two[cold], three[cold3]]
        self.whose += [(whose[cold] + self.n_docs).astype(np.uint16), (whose[both][cold3] + self.n_docs).astype(np.uint16)]
        self.n_docs += len(docs)

    def _looked_up(self, keys: np.ndarray, whose: np.ndarray, n: int) -> tuple:
        """The sums of the hot ones, which are hot, and which others may be in the tables."""
        place, there = self.hot.found(keys)
        own = place[there]
        sums = np.bincount(whose[there], self.hot.value[own] + self.hot.back[own], n)
        cold = ~there
        cold[cold] = passed(self.filter, keys[cold], self.shards)
        return sums, there, cold

    def rows(self) -> tuple[list[tuple], np.ndarray]:
        """(shard, keys, how many n-grams have each, their documents, last pairs), and the sums of the hot ones."""
        keys, whose = np.concatenate(self.keys), np.concatenate(self.whose)
        order = np.argsort(keys)
        keys, whose = keys[order], whose[order]
        ends, of = (np.concatenate(x) for x in zip(*self.last, strict=True))
        of_shard = shards_of(ends, self.shards)
        out = []
        for k, own in parts_of(keys, self.shards):
            first = starts(keys[own])
            n = np.diff(np.append(first, own.stop - own.start))
            some = of_shard == k
            out.append((k, steps(keys[own][first]), squeezed(n.astype(np.uint32)), squeezed(whose[own]), ends[some].tobytes() + of[some].astype(np.uint32).tobytes()))
        return out, np.concatenate(self.sums)


def _asker(models, filter_, hot, shards: int, salts: int, block_words: int, block_docs: int):
    @lean
    def run(batches):
        vocabulary, frequent = Vocabulary(models.value), Frequent(*hot.value)
        part, seq = TaskContext.get().partitionId(), 0
        new_block = lambda: Asked(frequent, filter_.value, shards)
        asked, docs, salt, meta, base, total, piece = new_block(), [], [], [], [], 0, 0

        def flush():
            block = part << 32 | seq
            rest, of = divmod(int(mix(np.array([block], np.uint64))[0]), salts)
            asks, sums = asked.rows()
            rows = [(block, k, of, *own, *[None] * 6) for k, *own in asks]
            ids, langs, names, sizes, probes = map(list, zip(*meta, strict=True))
            rows.append((block, -1 - rest % shards, of, *[None] * 4, ids, langs, names, sizes, (np.array(base) + sums).tolist(), probes))
            return batch_of(rows, ASKED)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                for doc, lang, model, probe, text in zip(*(rows.column(k).to_pylist() for k in range(4)), utf8_column(rows.column(4)), strict=True):
                    _, p1, back1 = vocabulary.own[model][:3]
                    places = vocabulary.places(model, (text or b"").split())
                    docs.append(places)
                    salt.append(salt_of(model))
                    meta.append((doc, lang, model, len(places), probe))
                    base.append(float(p1[places].sum() + back1[places[:-1]].sum()))
                    total, piece = total + len(places), piece + len(places)
                    full = total >= block_words or len(meta) >= block_docs
                    if full or piece >= PIECE_WORDS:
                        asked.take(docs, salt)
                        docs, salt, piece = [], [], 0
                    if full:
                        yield flush()
                        asked, meta, base, total, seq = new_block(), [], [], 0, seq + 1
        if docs:
            asked.take(docs, salt)
        if meta:
            yield flush()

    return run


class Shard:
    """The values of a shard, from the trigrams and the sums of its models."""

    def __init__(self, models: dict[str, tuple]):
        self.models, self.grams, self.sums = models, [], {}

    def take(self, row: dict) -> None:
        if row["role"] == 0:
            self.grams.append([row[c] for c in ("model", "u", "v", "w", "n")])
        else:
            self.sums.setdefault(row["model"], {})[row["part"]] = row["u"]

    def values(self) -> tuple:
        """(keys, values, back-off weights, counts), ascending."""
        out = []
        for gram in self.grams:
            parts = self.sums[gram[0]]
            out.append(pairs_of(*gram).values(np.concatenate([spread(parts[k], np.int64).reshape(4, -1) for k in sorted(parts)], axis=1), *self.models[gram[0]][1:]))
        joined = [np.concatenate([*(x[k] for x in out), np.zeros(0, t)]) for k, t in enumerate((np.uint64, np.float64, np.float64, np.int64))]
        order = np.argsort(joined[0])
        return tuple(x[order] for x in joined)


def lean_on_tables(run):
    """lean for a function of whole tables."""
    whole = lean(lambda given: iter([run(*given)]))
    return lambda *given: next(iter([*whole(given)]))


def _hot_ones(models, least: int, bits: int):
    """The n-grams of a shard that are of the class of counts `least` or more, and the filter of the others."""

    def of(table: pa.Table) -> pa.Table:
        shard = Shard(models.value)
        for at in range(table.num_rows):
            shard.take(table.slice(at, 1).to_pylist()[0])
        keys, value, back, counts = shard.values()
        hot = class_of(counts) >= least
        return pa.Table.from_batches([batch_of([(table["shard"][0].as_py(), *(x[hot].tobytes() for x in (keys, value, back)), filter_of(keys[~hot], bits))], FREQUENT)])

    alone = lean_on_tables(of)
    return lambda table: alone(table)


def _joiner(models):
    """A shard of the tables and what blocks ask of it: the sums for these."""
    names = [x.split()[0] for x in SUMMED.split(", ")]

    def of(tables: pa.Table, asks: pa.Table) -> pa.Table:
        shard, table, sums = Shard(models.value), None, []
        for at in range(tables.num_rows):
            shard.take(tables.slice(at, 1).to_pylist()[0])
        for at in range(0, asks.num_rows, 4):
            for row in asks.slice(at, 4).select(["shard", "u", "v", "w", "n"]).to_pylist():
                if row["shard"] < 0:
                    sums.append(None)
                    continue
                if table is None:
                    table, shard = shard.values(), None
                keys, value, back, _ = table
                place, there = found(keys, summed(row["u"]))
                each = np.zeros(len(place))
                each[there] = value[place[there]] + back[place[there]]
                out = np.bincount(spread(row["w"], np.uint16), np.repeat(each, spread(row["v"], np.uint32)))
                n = len(row["n"]) // 12
                place, there = found(keys, np.frombuffer(row["n"], np.uint64, n))
                np.subtract.at(out, np.frombuffer(row["n"], np.uint32, n, 8 * n)[there], back[place[there]])
                sums.append(out.tobytes())
        return pa.table([asks["block"], asks["shard"], pa.array(sums, pa.binary()), *(asks[c] for c in names[3:])], names)

    alone = lean_on_tables(of)
    return lambda tables, asks: alone(tables, asks)


@lean
def _adder(batches):
    """Rows sorted by block and shard: the documents of a block, then their sums from the shards."""

    def rows_of(meta: dict, totals: np.ndarray) -> pa.RecordBatch:
        base = np.array(meta["base"]) + totals
        return pa.RecordBatch.from_arrays([pa.array(meta["ids"], pa.int64()), pa.array(meta["langs"], pa.string()), pa.array(meta["models"], pa.string()), pa.array(meta["sizes"], pa.int64()), pa.array(base), pa.array(meta["probes"], pa.bool_())], ["doc_id", "lang", "model", "n_words", "total", "probe"])

    meta, totals, block = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] < 0:
                if meta is not None:
                    yield rows_of(meta, totals)
                meta, totals, block = row, np.zeros(len(row["sizes"])), row["block"]
            else:
                if row["block"] != block:
                    raise ValueError("sums of a block that isn't there")
                own = np.frombuffer(row["sums"])
                totals[: len(own)] += own
    if meta is not None:
        yield rows_of(meta, totals)


RESULT = "doc_id long, lang string, n_words long, perplexity double, threshold double, kept boolean"


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", least: int = 40, max_languages: int = 32, vocabulary_count: int = 3, shards: int = 8, shard_bytes: int = 8 << 20, hot: int = 1 << 21, block_words: int = 200_000, block_docs: int = 512, round_rows: int = 100_000, most_ids: int = MOST_IDS, quantile: float = 0.99, slack: float = 0.1, prior: float = 12.0) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept for every row of docs.

    Trusted rows are those whose label is 1. A hash of the id halves them, with no bound
    on their number or length: one half, whole, is counted for the models, all of the other
    sets the thresholds. Each of the max_languages largest languages with at least `least`
    trusted rows has a model of its own. Other languages, null among them, use a pooled
    model, trained on the counted half of all languages.

    The threshold of a model is the `quantile` of the perplexity of all trusted rows that
    use it and didn't train it (of those that did, if there are no others), its logarithm
    raised by `slack`. The pooled model's is the greater of that over its own languages and
    that over all, for which the other languages' rows that it wasn't trained on are scored
    with it. Perplexities are drawn to the mean as if by `prior` more words.

    A text without words (null, empty or white space) has no perplexity and is not kept.
    Without trusted rows that have words there is no model: perplexity and threshold are
    null and every text with words is kept. Repeated rows and ties are scored each; of
    several labels any 1 makes a row trusted. A very long text is a block of its own; a
    task holds one block and one shard of the tables, of which there are `shards`, or more so
    that each counts some shard_bytes of text. The driver and the workers hold 24 bytes
    for each word that the models know, and at most `hot` n-grams with their values; the
    results don't depend on that number. From round_rows rows on, documents are scored in two
    or three rounds. Up to most_ids trusted ids of a half go to the texts; if there are more, the
    texts are shuffled to them. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    counted = F.pmod(F.xxhash64(F.lit(41), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30) < 0.5
    usable = rows.where(F.octet_length(F.ltrim("text", F.lit(" \t\n\v\f\r"))) > 0)
    sizes = materialize(usable.select("doc_id", F.coalesce("lang", F.lit(POOLED)).alias("lang")).join(trusted, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "trusted")
    own = sorted(r["lang"] for r in sizes.where((F.col("n") >= least) & (F.col("lang") != POOLED)).orderBy(F.desc("n"), "lang").limit(max_languages).collect())
    is_own = F.coalesce(F.col("lang").isin(own), F.lit(False))
    if sizes.isEmpty():
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
        return rows.select("doc_id", "lang", words.cast("long").alias("n_words"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (words > 0).alias("kept"))
    pools = not rows.where(~is_own).isEmpty()
    of_half = trusted.where(counted)
    sent = sent_ids(of_half, most_ids)
    training = materialize(among(usable.where(counted), of_half, sent).select("lang", "text"), "training")
    if sent is not None:
        sent.destroy()
    probing = pools
    if training.isEmpty():  # every row of a few fell into the other half
        training, pools, probing = materialize(usable.join(trusted, "doc_id", "left_semi").select("lang", "text"), "training"), True, False
    names = F.when(is_own & F.lit(pools), F.array("lang", F.lit(POOLED))).when(is_own, F.array("lang")).otherwise(F.array(F.lit(POOLED)))
    texts, training = training, training.select(F.explode(names).alias("model"), "text")
    shards = max(shards, int(training.agg(F.sum(F.octet_length("text"))).first()[0]) // shard_bytes)

    words = training.mapInArrow(_in_blocks(block_words, WORDS, _word_counter(shards)), WORDS)
    words = materialize(words.groupBy("model", "shard").applyInArrow(_tokens_of(vocabulary_count), "model string, tokens binary"), "words")
    listed: dict[str, list] = {}
    for model, own_tokens in zip(*words.toArrow().to_pydict().values(), strict=True):
        listed.setdefault(model, [np.array([hash_of(NEW_SHAPE)], np.uint64)]).append(np.frombuffer(own_tokens, np.uint64))
    tokens = {model: np.unique(np.concatenate(parts)) for model, parts in listed.items()}
    drop(words)
    del listed
    vocabulary = spark.sparkContext.broadcast({model: (x,) for model, x in tokens.items()})
    grams = training.mapInArrow(_in_blocks(block_words, GRAMS, _gram_counter(vocabulary, shards)), GRAMS)
    grams = materialize(grams.groupBy("model", "shard").applyInArrow(_gatherer, GRAMS), "trigrams")
    vocabulary.destroy()
    drop(texts)
    sums = grams.drop("counts").mapInArrow(_needer(shards), NEEDS)
    sums = materialize(sums.groupBy("model", "part").applyInArrow(_summer, NEEDS), "sums")

    counts: dict[str, np.ndarray] = {}
    for r in grams.select("model", F.posexplode("counts").alias("at", "n")).groupBy("model", "at").agg(F.sum("n").alias("n")).where("n > 0").collect():  # at most 520 a model
        counts.setdefault(r["model"], np.zeros(8 + CLASSES_OF_COUNTS, np.int64))[r["at"]] = r["n"]
    of_words: dict[str, list] = {}
    for model, *packed in zip(*sums.where("shard = -1").select("model", "keys", "sums").toArrow().to_pydict().values(), strict=True):
        of_words.setdefault(model, []).append(tuple(packed))
    models = {}
    for model, x in tokens.items():
        n = counts.get(model, np.zeros(8, np.int64))
        d3, d2 = discounts(n[:4]), discounts(n[4:8])
        models[model] = (x, *unigrams_of(model, x, of_words.pop(model, []), d2), d2, d3)
    vocabulary = spark.sparkContext.broadcast(models)
    used = F.when(is_own & F.col("lang").isin(list(models)), F.col("lang")).otherwise(F.lit(POOLED if POOLED in models else min(models)))
    del tokens, models

    above = np.cumsum(sum((x[8:] for x in counts.values()), np.zeros(CLASSES_OF_COUNTS, np.int64))[::-1])[::-1]
    least_hot = int((above > hot).sum())
    n_cold = int(above[0]) - (int(above[least_hot]) if least_hot < CLASSES_OF_COUNTS else 0)
    bits = -(-max(min(10 * n_cold, MOST_BITS), shards << 10) // (8 * shards)) * 8  # of a shard
    # rounds over parts of the documents, so that what blocks ask is not all on disk at once
    n_rows = rows.count()
    rounds = 1 if n_rows < round_rows else 2 if n_rows < 10 * round_rows else 3
    salts = max(1, -(-n_rows // (50_000 * shards * rounds)))
    columns = [x.split() for x in TABLES.split(", ")]
    filled = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns if c != "salt"])
    dealt = filled(grams.withColumn("role", F.lit(0)).drop("counts"))
    dealt = dealt.union(filled(sums.where("shard >= 0").select("shard", F.lit(1).alias("role"), "model", "part", F.col("sums").alias("u"))))
    # in buckets, as the hot n-grams and each round read them by shard
    tables = bucketed(dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select([c for c, _ in columns]), ["shard", "salt"], "tables")
    drop(grams)
    drop(sums)
    frequent = tables.where("salt = 0").groupBy("shard", "salt").applyInArrow(_hot_ones(vocabulary, least_hot, bits), FREQUENT).toArrow()
    filter_ = np.zeros(shards * bits // 8, np.uint8)
    for shard, own_bits in zip(*(frequent[c].to_pylist() for c in ("shard", "bits")), strict=True):
        filter_[shard * bits // 8 : (shard + 1) * bits // 8] = np.frombuffer(own_bits, np.uint8)
    hottest = [np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in frequent[c].to_pylist())]) for c, t in (("keys", np.uint64), ("value", np.float64), ("back", np.float64))]
    hottest[0] = Frequent.turned(hottest[0])
    order = np.argsort(hottest[0])
    hottest = spark.sparkContext.broadcast(tuple(x[order] for x in hottest))
    filter_ = spark.sparkContext.broadcast(filter_)
    del frequent
    release(spark)
    every = rows.select("doc_id", "lang", used.alias("model"), F.lit(False).alias("probe"), "text")
    sent = None
    if probing:
        of_half = trusted.where(~counted)
        sent = sent_ids(of_half, most_ids)
        every = every.union(among(usable.where(is_own & ~counted), of_half, sent).select("doc_id", "lang", F.lit(POOLED), F.lit(True), "text"))
    parts = []
    for k in range(rounds):
        of_round = every.where(F.pmod(F.xxhash64(F.lit(43), F.col("doc_id")), F.lit(rounds)) == k)
        asked = of_round.mapInArrow(_asker(vocabulary, filter_, hottest, shards, salts, block_words, min(block_docs, 1 << 16)), ASKED)
        met = tables.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(_joiner(vocabulary), SUMMED)
        parts.append(materialize(met.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_adder, SCORED), "scored"))
        del asked, met, of_round
        release(spark)
    scored = functools.reduce(DataFrame.union, parts)
    names = list(vocabulary.value)
    for x in (vocabulary, hottest, filter_, *([] if sent is None else [sent])):
        x.destroy()
    drop(tables)

    held = scored.where("n_words > 0 and not probe").join(trusted, "doc_id", "left_semi").select("model", "lang", "n_words", "total", counted.alias("trained"))
    held = materialize(held.unionByName(scored.where("probe").select("model", "lang", "n_words", "total", F.lit(False).alias("trained"))), "held")
    counts = {(r["model"], r["trained"]): (r["total"], r["n"]) for r in held.groupBy("model", "trained").agg(F.sum("total").alias("total"), F.sum("n_words").alias("n")).collect()}  # two rows a model
    levels = [(m, (m, False) not in counts, -t / n) for m in names for t, n in [counts.get((m, False)) or counts.get((m, True)) or (0.0, 1)]]
    levels = spark.createDataFrame(pa.Table.from_batches([batch_of(levels, "model string, trained boolean, mean double")]))
    each = (prior * F.col("mean") - F.col("total")) / (F.col("n_words") + prior)
    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    # a language of its own may use the pooled model only in probes
    most = held.join(F.broadcast(levels), ["model", "trained"]).groupBy("model").agg((F.greatest(at(each), F.coalesce(at(F.when(~is_own, each)), at(each))) + slack).alias("most"))
    levels = levels.join(materialize(most, "levels"), "model", "left").select("model", "mean", "most")
    out = scored.where("not probe").join(F.broadcast(levels), "model")
    some = F.col("n_words") > 0
    return out.select(
        "doc_id", "lang", "n_words", F.when(some, F.exp(F.least(each, F.lit(700.0)))).alias("perplexity"), F.exp("most").alias("threshold"),
        (some & F.coalesce(each <= F.col("most"), F.lit(True))).alias("kept"),
    )
