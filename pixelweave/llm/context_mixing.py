"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased) and one end. Each token is coded in bits:

* follower bits: whether it is the word that the hashed context of the last two
  words, then of the last word, predicts; predicted from that context's counts, the
  other context's if it names the same word, and the run of hits before;
* escape bits: whether it is a word of the training texts; from the rate of unknown
  words in the corpus and in the text so far, and from the words the text has spelled;
* tree bits of a known word, along a binary tree over the hashes of all known words:
  the node alone, and the node with the class of the last short word, which follows
  language through a text, as two states of adaptation; classes are groups of hashed
  short words that stand near each other, found from their counts in sequence;
* byte bits of an unknown word: the partial byte and the word's last 1, 2, 3, 4 and 6 bytes.

The log-odds of a bit's predictors are combined by weights chosen by a gate (how much
the contexts have seen), and the result is refined by an adaptive probability map
(hits by quantised log-odds). Both learn online: each chunk of bits is predicted first
and learned from afterwards, from training texts only. Counts are those of all training
texts; follower and byte contexts leave an occurrence itself out, so that a training
text isn't predicted from itself and rare contexts earn no trust that they wouldn't
have on new text.

Texts are read once, into blocks of word numbers. Tables grow with the corpus and are
dealt by hash: words to shards (each a subtree with byte contexts of its own), contexts
to others, frequent last words split by the word before. Blocks send each shard their
distinct entries as packed arrays and get costs back in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged
from pixelweave.llm.text import byte_words

#: Text bytes in a block of documents; entries that a shard of words, and one of contexts, gets from all blocks.
BLOCK_BYTES, WORD_ENTRIES, FOLLOWER_ENTRIES = 8 << 20, 400_000, 1_000_000
#: Context classes (0: none yet), the hash buckets that they group, and the longest word, in bytes, that sets one.
CLASSES, BUCKETS, CONTEXT_BYTES = 7, 1024, 3
#: The end of a text; no word holds a line feed.
END = b"\n"
#: Rows that the mixers predict before they learn from them.
CHUNK = 16_384
TREE_GATES, TREE_INPUTS = 12 * 6, 3
#: Bytes of the word that each byte predictor knows, and its slots as a power of two.
ORDERS, SLOT_BITS = (1, 2, 3, 4, 6), (14, 16, 17, 18, 18)
SPELL_GATES, SPELL_INPUTS = 8 * 3 * 2, len(ORDERS)
SPELL_STARTS = tuple(sum(1 << b for b in SLOT_BITS[:i]) for i in range(SPELL_INPUTS))
SPELL_SLOTS = sum(1 << b for b in SLOT_BITS)
#: Bits of the hash of the word before last and of the follower in an entry (those of the last word follow the vocabulary).
BEFORE_BITS, FOLLOWER_BITS = 18, 12
#: Upper ends of the steps in which a follower's hits and misses are told, and gates by the run of hits before.
HIT_STEPS, MISS_STEPS = np.array([1, 2, 3, 5, 9, 33]), np.array([0, 1, 2, 4, 8, 16, 64])
RUNS = np.array([1, 2, 3, 5, 9])
FOLLOW_GATES, FOLLOW_INPUTS = (len(RUNS) + 1) * 2, 3
#: Tokens that the corpus rate of unknown words weighs against the rate in the text so far.
ESCAPE_WEIGHT = 30.0
#: Steps of the adaptive probability map: quarter units of log-odds in [-12, 12].
MAP_STEPS, MAP_UNIT = 97, 0.25
STIFF = 10.0

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]
_START_KEY = np.uint64(0x5851F42D4C957F2D)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def packed(numbers: np.ndarray) -> bytes:
    """An array as zstd-compressed byte planes."""
    numbers = np.ascontiguousarray(numbers)
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def word_key(word: bytes) -> int:
    """The 64-bit hash that stands for a word in tables and in the tree."""
    return xxhash.xxh3_64_intdigest(word)


def context_bucket(word: bytes) -> int:
    """Hash bucket of a short word of letters; -1 for others, which leave the context as it is."""
    if len(word) > CONTEXT_BYTES or not (97 <= word[0] <= 122 or word[0] >= 128):
        return -1
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


def bucket_classes(follows: np.ndarray) -> np.ndarray:
    """Class (from 1) of each bucket, from how often one follows another; 0 for buckets without counts.

    Spectral grouping: buckets as points of the leading eigenvectors of the
    normalised counts, then weighted k-means from points far apart.
    """
    near = follows + follows.T
    mass = near.sum(axis=1)
    used = np.flatnonzero(mass > 0)
    classes = np.zeros(len(mass), np.int64)
    if not len(used):
        return classes
    near, mass = near[np.ix_(used, used)], mass[used]
    k = min(CLASSES - 1, len(used))
    _, vectors = np.linalg.eigh(near / np.sqrt(np.outer(mass, mass)))
    points = vectors[:, -k:] / np.sqrt(mass)[:, None]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centres = points[[mass.argmax()]]
    for _ in range(k - 1):
        far = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * mass
        centres = np.concatenate([centres, points[[far.argmax()]]])
    for _ in range(30):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if (own == c).any():
                centres[c] = np.average(points[own == c], axis=0, weights=mass[own == c])
    classes[used] = own + 1
    return classes


def _refined(z: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Natural log of the probability with log-odds ``z``, averaged with what the map has seen there.

    A bin's probability is its hits over those of it and its mirror, so the two
    outcomes of a bit always add up to one.
    """
    pos = np.clip(z / MAP_UNIT, -(MAP_STEPS // 2), MAP_STEPS // 2) + MAP_STEPS // 2
    low = np.minimum(pos.astype(np.int64), MAP_STEPS - 2)
    part = pos - low
    centre = (np.arange(MAP_STEPS) - MAP_STEPS // 2) * MAP_UNIT
    prior = 20.0 / (1 + np.exp(-centre))
    seen = (hits + prior) / (hits + hits[::-1] + 20.0)
    mapped = seen[low] * (1 - part) + seen[low + 1] * part
    return np.log(0.5 * mapped + 0.5 / (1 + np.exp(-np.clip(z, -50, 50))))


class Mixer:
    """Gated weights and a probability map; ``learn`` makes an online Newton step of each gate."""

    def __init__(self, gates: int, start: list[float]):
        inputs = len(start)
        self.w, self.hits = np.tile(np.array(start, float), (gates, 1)), np.zeros(MAP_STEPS)
        #: Curvature so far; its start holds the first steps small.
        self.curve = np.tile(STIFF * np.eye(inputs), (gates, 1, 1))

    def cost(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Log probability of the outcomes that happened; x: log-odds in their favour (rows x inputs)."""
        return _refined((self.w[gate] * x).sum(axis=1), self.hits)

    def learn(self, x: np.ndarray, gate: np.ndarray, count: np.ndarray) -> None:
        gates = len(self.w)
        z = (self.w[gate] * x).sum(axis=1)
        miss = 1 / (1 + np.exp(np.clip(z, -50, 50)))
        pull, bend = count * miss, count * miss * (1 - miss)
        used = np.flatnonzero(np.bincount(gate, minlength=gates))
        slope = np.zeros(self.w.shape)
        if len(used) <= 8:  # few gates: products of their rows
            for g in used:
                at_g = gate == g
                own = x[at_g]
                slope[g] = pull[at_g] @ own
                self.curve[g] += (own * bend[at_g][:, None]).T @ own
        else:
            for i in range(x.shape[1]):
                slope[:, i] = np.bincount(gate, pull * x[:, i], gates)
                for k in range(i + 1):
                    more = np.bincount(gate, bend * x[:, i] * x[:, k], gates)
                    self.curve[:, i, k] += more
                    if k < i:
                        self.curve[:, k, i] += more
        self.w[used] += np.linalg.solve(self.curve[used], slope[used][:, :, None])[:, :, 0]
        pos = np.clip(np.rint(z / MAP_UNIT), -(MAP_STEPS // 2), MAP_STEPS // 2).astype(np.int64) + MAP_STEPS // 2
        self.hits += np.bincount(pos, count, MAP_STEPS)

    def follow(self, x: np.ndarray, gate: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Costs in order, each chunk learned (rows times their count) after it was predicted."""
        out = np.empty(len(x))
        for at in range(0, len(x), CHUNK):
            s = slice(at, at + CHUNK)
            out[s] = self.cost(x[s], gate[s])
            rows = at + np.flatnonzero(count[s] > 0)
            if len(rows):
                self.learn(x[rows], gate[rows], count[rows])
        return out


def tree_mixer() -> Mixer:
    return Mixer(TREE_GATES, [0.2, 0.4, 0.4])


def spell_mixer() -> Mixer:
    return Mixer(SPELL_GATES, [0.05, 0.1, 0.2, 0.4, 0.3])


def follow_mixer() -> Mixer:
    return Mixer(FOLLOW_GATES, [0.6, 0.4, 0.0])


def tree_costs(keys: np.ndarray, counts: np.ndarray, leaf: np.ndarray, cls: np.ndarray, times: np.ndarray, mixer: Mixer) -> np.ndarray:
    """Log probability of each (leaf, class) row along the tree of the sorted ``keys``.

    counts: leaves x CLASSES; times: how often to learn from a row, 0 for not at all.
    Only nodes with leaves on both sides take a bit.
    """
    by_class = np.concatenate([np.zeros((1, CLASSES), np.int64), np.cumsum(counts, axis=0)])
    total = by_class.sum(axis=1)
    flat = by_class.reshape(-1)
    n = len(keys)
    low, high = np.zeros(n, np.int64), np.full(n, n)
    cost = np.zeros(len(leaf))

    def inputs(took, all_, took_c, all_c):
        x = np.stack([np.log((t + d) / (n_ - t + d)) for t, n_, d in ((took, all_, 0.05), (took_c, all_c, 0.1), (took_c, all_c, 2.0))], axis=1)
        return x, np.minimum(11, np.log2(all_c + 1).astype(np.int64)) * 6 + np.minimum(5, np.log2(all_ + 1).astype(np.int64) // 3)

    for depth in range(64):
        if not ((high - low) > 1).any():
            break
        bit = (keys >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(bit)])
        middle = high - (ones[high] - ones[low])
        to_low, to_high = np.where(bit == 1, middle, low), np.where(bit == 1, high, middle)
        rows = np.flatnonzero(((middle > low) & (middle < high))[leaf])
        for at in range(0, len(rows), CHUNK):
            r = rows[at : at + CHUNK]
            i, c = leaf[r], cls[r]
            a, b, ca, cb = low[i], high[i], to_low[i], to_high[i]
            sums = [total[cb] - total[ca], total[b] - total[a], flat[cb * CLASSES + c] - flat[ca * CLASSES + c], flat[b * CLASSES + c] - flat[a * CLASSES + c]]
            cost[r] += mixer.cost(*inputs(*sums))
            learn = np.flatnonzero(times[r] > 0)
            if len(learn):
                mixer.learn(*inputs(*(s[learn] - 1 for s in sums)), times[r][learn])
        low, high = to_low, to_high
    return cost


#: Words that are spelled together.
_TOGETHER = 4096


def _byte_bits(words: list[bytes]):
    """For each of the 8 bit places: slots (bytes x contexts), bits; and the word of each byte."""
    joined = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    past, contexts = np.zeros(len(joined), np.uint64), []
    for k in range(1, max(ORDERS) + 1):
        before = np.concatenate([np.zeros(k, np.uint64), joined[:-k]])[: len(joined)]
        past = past | (np.where(place >= k, before, np.uint64(0)) << np.uint64(8 * (k - 1)))
        if k in ORDERS:
            h = (past + np.uint64(k)) * _MIX[0]
            contexts.append(h ^ (h >> np.uint64(29)))
    for j in range(8):
        node = (np.uint64(1) << np.uint64(j)) | (joined >> np.uint64(8 - j))
        slots = []
        for h, start, bits in zip(contexts, SPELL_STARTS, SLOT_BITS, strict=True):
            s = (h + node) * _MIX[1]
            slots.append((s >> np.uint64(64 - bits)).astype(np.int64) + start)
        yield j, np.stack(slots, axis=1), (joined >> np.uint64(7 - j) & np.uint64(1)).astype(np.int64), word


def byte_counts(words: list[bytes]) -> np.ndarray:
    """Counts (slots x 2, flat) of the bits of these words, each once."""
    out = np.zeros(SPELL_SLOTS * 2, np.float32)
    for at in range(0, len(words), 16 * _TOGETHER):
        for _, slots, bits, _ in _byte_bits(words[at : at + 16 * _TOGETHER]):
            out += np.bincount((slots * 2 + bits[:, None]).reshape(-1), minlength=len(out))
    return out


def spell_costs(words: list[bytes], counts: np.ndarray, mixer: Mixer, learn: bool) -> np.ndarray:
    """Log probability of spelling each word; ``learn``: the words are counted, so they are left out of the counts and learned from instead."""
    cost, own = np.zeros(len(words)), np.float32(learn)
    for at in range(0, len(words), _TOGETHER):
        some = words[at : at + _TOGETHER]
        for j, slots, bits, word in _byte_bits(some):
            took = counts[slots * 2 + bits[:, None]] - own
            other = counts[slots * 2 + 1 - bits[:, None]]
            x = np.log((took + np.float32(0.2)) / (other + np.float32(0.2)))
            seen = took[:, 3] + other[:, 3]
            gate = (j * 3 + (seen > 2).astype(np.int64) + (seen > 14)) * 2 + (took[:, 2] + other[:, 2] > 2)
            if learn:
                mixer.learn(x, gate, np.ones(len(x)))
            else:
                cost[at : at + _TOGETHER] += np.bincount(word, mixer.cost(x, gate), len(some))
    return cost


# ---- blocks of documents


class _Numbers(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    def __init__(self):
        self.known, self.ids, self.rows, self.sizes, self.bytes = _Numbers(), [], [], [], 0

    def add(self, text: bytes | None) -> None:
        words = byte_words(text) if text else []
        words.append(END)
        self.ids.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
        self.sizes.append(len(text or b""))
        self.bytes += len(text or b"") + 64


def _list(flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its words, the tokens of all its texts as numbers of these, and its documents."""
    number, block, held, doc_ids = TaskContext.get().partitionId() << 32, _Block(), [], []

    def out() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in block.ids], np.int64)
        columns = {
            "block": pa.array([number], pa.int64()), "n_words": pa.array([len(block.known)], pa.int64()), "n_tokens": pa.array([int(lengths.sum())], pa.int64()), "words": _list(pa.array(list(block.known), pa.binary())),
            "ids": pa.array([packed(np.concatenate(block.ids))], pa.binary()), "lengths": _list(pa.array(lengths)), "bytes": _list(pa.array(block.sizes, pa.int64())),
            "held": _list(pa.array(held, pa.bool_())), "doc_ids": _list(pa.concat_arrays(doc_ids)),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for batch in batches:
        ids, texts, flags = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for i in range(batch.num_rows):
            block.add(texts[i].as_py())
            held.append(flags[i])
            doc_ids.append(ids.slice(i, 1))
            if block.bytes >= BLOCK_BYTES:
                yield out()
                number, block, held, doc_ids = number + 1, _Block(), [], []
    if held:
        yield out()


class _Tokens:
    """A block row as arrays over its tokens."""

    def __init__(self, row: dict):
        self.words, self.ids = row["words"], unpacked(row["ids"], np.uint32).astype(np.int64)
        self.lengths, self.held = np.array(row["lengths"]), np.array(row["held"], bool)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.start = np.repeat(self.first, self.lengths)
        self.keys = np.fromiter(map(word_key, self.words), np.uint64, len(self.words))
        self.by_key = np.argsort(self.keys)

    def token_held(self) -> np.ndarray:
        return np.repeat(self.held, self.lengths)

    def classes(self, of_bucket: np.ndarray) -> np.ndarray:
        """The class before each token."""
        sets = np.zeros(len(self.words), np.int64)
        for n, w in enumerate(self.words):
            if len(w) <= CONTEXT_BYTES and w != END and (b := context_bucket(w)) >= 0:
                sets[n] = of_bucket[b]
        cls = sets[self.ids]
        last = np.maximum.accumulate(np.where(cls > 0, np.arange(1, len(cls) + 1), 0))
        before = np.concatenate([[0], last[:-1]])
        return np.where(before > self.start, cls[np.maximum(before - 1, 0)], 0)

    def pairs(self, of_bucket: np.ndarray):
        """(present, counts): which (word by key, class) pairs occur, and how often in training texts."""
        place = np.empty(len(self.keys), np.int64)
        place[self.by_key] = np.arange(len(self.keys))
        pair = place[self.ids] * CLASSES + self.classes(of_bucket)
        size = len(self.keys) * CLASSES
        return np.bincount(pair, minlength=size) > 0, np.bincount(pair[~self.token_held()], minlength=size), pair

    def entries(self, last_bits: int, hot: np.ndarray, salts: int, inverse: bool = False):
        """(sorted distinct entries, how often, place of each token's): context hashes, follower hash and held flag of each token."""
        key = self.keys[self.ids]
        last = np.concatenate([[_START_KEY], key[:-1]])
        before = np.concatenate([[_START_KEY, _START_KEY], key[:-2]])[: len(key)]
        at = np.arange(len(key)) - self.start
        last[at == 0], before[at <= 1] = _START_KEY, _START_KEY
        is_hot = np.concatenate([[False], np.isin(self.keys, hot)[self.ids][:-1]]) & (at > 0)
        if is_hot.any():  # a frequent last word is split by the word before
            last[is_hot] += _scramble(before[is_hot]) % np.uint64(salts) + np.uint64(1)
        entry = _scramble(last * _MIX[0]) >> np.uint64(64 - last_bits) << np.uint64(BEFORE_BITS)
        entry = (entry | (_scramble(before * _MIX[2] + last) >> np.uint64(64 - BEFORE_BITS))) << np.uint64(FOLLOWER_BITS)
        entry = (entry | (_scramble(key) >> np.uint64(64 - FOLLOWER_BITS))) << np.uint64(1)
        entry |= self.token_held().astype(np.uint64)
        if inverse:
            return np.unique(entry, return_inverse=True)
        return np.unique(entry, return_counts=True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        pa.default_memory_pool().release_unused()


def _follow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, n): how often a short word of bucket j is the next short one after one of bucket i, in training texts."""
    counts = np.zeros(BUCKETS * BUCKETS, np.int64)
    for row in _rows(batches):
        ids, lengths = unpacked(row["ids"], np.uint32), np.array(row["lengths"])
        bucket = np.array([context_bucket(w) if len(w) <= CONTEXT_BYTES and w != END else -1 for w in row["words"]])[ids]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        use = (bucket >= 0) & ~np.repeat(np.array(row["held"], bool), lengths)
        bucket, doc = bucket[use], doc[use]
        same = doc[1:] == doc[:-1]
        counts += np.bincount((bucket[:-1] * BUCKETS + bucket[1:])[same], minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(counts[at])], ["i", "j", "n"])


# ---- shards of words


def _cuts(sorted_keys: np.ndarray, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Shards that occur, and where each begins and the last ends."""
    shard = (sorted_keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(sorted_keys), np.int64)
    shards, first = np.unique(shard, return_index=True)
    return shards, np.append(first, len(shard))


def _binary_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*rows, strict=True)], names)


_WORD_ROWS = "shard long, block long, keys binary, masks binary, counts binary, sizes binary, letters binary"


def _word_rows(batches: Iterator[pa.RecordBatch], bits: int, of_bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each block's words for each shard: keys, the classes they occur after, training counts, spellings."""
    for row in _rows(batches):
        t = _Tokens(row)
        present, counts, _ = t.pairs(of_bucket)
        keys = t.keys[t.by_key]
        masks = np.packbits(present.reshape(-1, CLASSES), axis=1, bitorder="little")[:, 0]
        shards, cut = _cuts(keys, bits)
        for s, a, b in zip(shards.tolist(), cut[:-1], cut[1:], strict=True):
            words = [t.words[i] for i in t.by_key[a:b]]
            pair = slice(a * CLASSES, b * CLASSES)
            data = (packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(masks[a:b]), packed(counts[pair][present[pair]].astype(np.uint32)), packed(np.array([len(w) for w in words], np.uint32)), zstandard.compress(b"".join(words), 1))
            yield _binary_batch([(s, row["block"], *data)], ["shard", "block", "keys", "masks", "counts", "sizes", "letters"])


_SHARD = "shard long, n_words long, known long, once long, by_class array<long>, words array<binary>, keys binary, counts binary, seen binary, blocks array<long>, places array<binary>, masks array<binary>"


def _merged(table: pa.Table) -> pa.Table:
    """One row a shard: the counts of its words over all blocks, and what each block asks of it."""
    rows = table.to_pylist()
    keys = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    every, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    words: list[bytes] = [b""] * len(every)
    counts, seen, places = np.zeros(len(every) * CLASSES, np.int64), np.zeros(len(every) * CLASSES, bool), []
    for r, k, end in zip(rows, keys, ends, strict=True):
        begin, at = end - len(k), place[end - len(k) : end]
        cut = np.cumsum([0, *unpacked(r["sizes"], np.uint32).tolist()]).tolist()
        letters = zstandard.decompress(r["letters"])
        for j in np.flatnonzero(first[at] == np.arange(begin, end)):
            words[at[j]] = letters[cut[j] : cut[j + 1]]
        present = np.unpackbits(unpacked(r["masks"], np.uint8)[:, None], axis=1, bitorder="little")[:, :CLASSES].astype(bool)
        leaf, cls = np.nonzero(present)
        counts[at[leaf] * CLASSES + cls] += unpacked(r["counts"], np.uint32)
        seen[at[leaf] * CLASSES + cls] = True
        places.append(packed(at.astype(np.uint32)))
    total = counts.reshape(-1, CLASSES).sum(axis=1)
    columns = {
        "shard": pa.array([rows[0]["shard"]], pa.int64()), "n_words": pa.array([len(every)], pa.int64()), "known": pa.array([int((total > 0).sum())], pa.int64()), "once": pa.array([int((total == 1).sum())], pa.int64()),
        "by_class": _list(pa.array(counts.reshape(-1, CLASSES).sum(axis=0))), "words": _list(pa.array(words, pa.binary())), "keys": pa.array([packed(every)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary()), "seen": pa.array([packed(seen)], pa.binary()),
        "blocks": _list(pa.array([r["block"] for r in rows], pa.int64())), "places": _list(pa.array(places, pa.binary())), "masks": _list(pa.array([r["masks"] for r in rows], pa.binary())),
    }
    pa.default_memory_pool().release_unused()
    return pa.table(columns)


def _hot_rows(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        keys, total = unpacked(row["keys"], np.uint64), unpacked(row["counts"], np.int64).reshape(-1, CLASSES).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[total > least].view(np.int64))], ["k"])


def word_costs(words: list[bytes], keys: np.ndarray, counts: np.ndarray, seen: np.ndarray, all_counts: np.ndarray, bits: int) -> np.ndarray:
    """Log probability (words x CLASSES) of each word of a shard: of known ones among all known words, of others' spellings.

    keys are sorted; counts and seen: words x CLASSES, of training tokens and of all that occurs (costs of
    other pairs aren't worked out); all_counts: training tokens of the whole corpus by class.
    """
    total, own = counts.sum(axis=1), counts.sum(axis=0)
    cost = np.zeros((len(words), CLASSES))
    known = np.flatnonzero(total > 0)
    if len(known):
        # the shard, after a class: its share there, drawn towards its share of all tokens
        cost[known] = np.log((own + 50.0 * own.sum() / all_counts.sum()) / (all_counts + 50.0))
        leaf, cls = np.nonzero(seen[known])
        # a word of one occurrence would have been escaped, so there is nothing to learn from it
        times = np.where(total[known][leaf] > 1, counts[known][leaf, cls], 0).astype(float)
        cost[known[leaf], cls] += tree_costs(keys[known] << np.uint64(bits), counts[known], leaf, cls, times, tree_mixer())
    new = np.flatnonzero(total == 0)
    if len(new):
        spelled, mixer = byte_counts([words[i] for i in known]), spell_mixer()
        # words seen once are what words not seen are like
        spell_costs([words[i] for i in known[total[known] == 1]], spelled, mixer, learn=True)
        cost[new] = spell_costs([words[i] for i in new], spelled, mixer, learn=False)[:, None]
    return cost


_ANSWER = "block long, part long, kind int, one binary, two binary"


def _answers(rows: list[tuple], kind: int) -> pa.RecordBatch:
    block, part, one, two = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(part, pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array(one, pa.binary()), pa.array(two, pa.binary())], ["block", "part", "kind", "one", "two"]
    )


def _cost_rows(batches: Iterator[pa.RecordBatch], all_counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """For each block, the log10 costs of its (word, class) pairs and the counts of its words, in its order."""
    for row in _rows(batches):
        keys, counts, seen = unpacked(row["keys"], np.uint64), unpacked(row["counts"], np.int64).reshape(-1, CLASSES), unpacked(row["seen"], np.bool_).reshape(-1, CLASSES)
        cost = (word_costs(row["words"], keys, counts, seen, all_counts, bits) / math.log(10)).astype(np.float32)
        total = counts.sum(axis=1)
        for block, place, masks in zip(row["blocks"], row["places"], row["masks"], strict=True):
            at = unpacked(place, np.uint32)
            present = np.unpackbits(unpacked(masks, np.uint8)[:, None], axis=1, bitorder="little")[:, :CLASSES].astype(bool)
            yield _answers([(block, row["shard"], packed(cost[at][present]), packed(total[at]))], 0)


# ---- shards of contexts


def _entry_rows(batches: Iterator[pa.RecordBatch], bits: int, last_bits: int, hot: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    width = last_bits + BEFORE_BITS + FOLLOWER_BITS + 1
    for row in _rows(batches):
        entries, times = _Tokens(row).entries(last_bits, hot, salts)
        shards, cut = _cuts(entries, bits, width)
        for s, a, b in zip(shards.tolist(), cut[:-1], cut[1:], strict=True):
            yield _binary_batch([(s, row["block"], packed(np.diff(entries[a:b], prepend=np.uint64(0))), packed(times[a:b].astype(np.uint32)))], ["shard", "block", "entries", "times"])


def _predictions(context: np.ndarray, follower: np.ndarray, count: np.ndarray, entry: np.ndarray, own: np.ndarray):
    """What each entry's context predicts without the entry's own occurrence: (follower, its count, all counts), -1 for nothing.

    context, follower, count: the counted followers, sorted; entry: each entry's place among them.
    """
    begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(context))))
    all_ = np.add.reduceat(count, begins)
    # most frequent first, then by hash
    order = np.argsort(group.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.minimum(count, 0xFFFFFFFF).astype(np.uint64)), kind="stable")
    top = order[begins]
    next_ = np.where(np.diff(np.append(begins, len(context))) > 1, order[np.minimum(begins + 1, len(context) - 1)], -1)
    g = group[entry]
    best, rival, left = top[g], next_[g], all_[g] - own
    is_best = best == entry
    mine = count[entry] - own
    rival_count = np.where(rival >= 0, count[rival], 0)
    falls = is_best & (own > 0) & ((rival_count > mine) | ((rival_count == mine) & (rival >= 0) & (rival < best)))
    best_count = np.where(falls, rival_count, np.where(is_best, mine, count[best]))
    chosen = np.where(left > 0, np.where(falls, rival, best), -1)
    return chosen, best_count, left


def _state(hit: np.ndarray, count: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """A byte: 0 for no prediction, else whether it was right, its count and the others' in steps."""
    step = np.searchsorted(HIT_STEPS, count) * (len(MISS_STEPS) + 1) + np.searchsorted(MISS_STEPS, all_ - count)
    return (1 + hit + 2 * step).astype(np.uint8)


def _odds() -> np.ndarray:
    """Log-odds of the prediction that each state byte tells."""
    out = np.zeros(256)
    for step in range((len(HIT_STEPS) + 1) * (len(MISS_STEPS) + 1)):
        i, j = divmod(step, len(MISS_STEPS) + 1)
        hits, misses = [*HIT_STEPS, 2 * HIT_STEPS[-1]][i], [*MISS_STEPS, 2 * MISS_STEPS[-1]][j]
        out[1 + 2 * step : 3 + 2 * step] = math.log((hits + 0.4) / (misses + 0.4))
    return out


def follower_states(entries: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State bytes of each entry (of all blocks, any order) by its last two words and by its last word; 128 is added to the second if both name one follower."""
    held, key = (entries & np.uint64(1)).astype(np.int64), entries >> np.uint64(1)
    every, place = np.unique(key, return_inverse=True)
    count = np.bincount(place, times * (1 - held), len(every)).astype(np.int64)
    own, mask = 1 - held, np.uint64((1 << FOLLOWER_BITS) - 1)
    follower = every & mask
    two, n_two, all_two = _predictions(every >> np.uint64(FOLLOWER_BITS), follower, count, place, own)
    short = (every >> np.uint64(FOLLOWER_BITS + BEFORE_BITS) << np.uint64(FOLLOWER_BITS)) | follower
    fewer, to_short = np.unique(short, return_inverse=True)
    count_one = np.bincount(to_short, count, len(fewer)).astype(np.int64)
    place_one = to_short[place]
    one, n_one, all_one = _predictions(fewer >> np.uint64(FOLLOWER_BITS), fewer & mask, count_one, place_one, own)
    same = (two >= 0) & (one >= 0) & (to_short[np.maximum(two, 0)] == one)
    state_two = np.where(two >= 0, _state(two == place, n_two, all_two), np.uint8(0))
    state_one = np.where(one >= 0, _state(one == place_one, n_one, all_one), np.uint8(0))
    return state_two, state_one | (same.astype(np.uint8) << np.uint8(7))


def _matched(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    entries = [np.cumsum(unpacked(r["entries"], np.uint64), dtype=np.uint64) for r in rows]
    two, one = follower_states(np.concatenate(entries), np.concatenate([unpacked(r["times"], np.uint32) for r in rows]).astype(float))
    cut = np.cumsum([0, *map(len, entries)])
    out = _answers([(r["block"], r["shard"], packed(two[a:b]), packed(one[a:b])) for r, a, b in zip(rows, cut[:-1], cut[1:], strict=True)], 1)
    del entries, two, one
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches([out])


# ---- scores


def follower_costs(two: np.ndarray, one: np.ndarray, start: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, hit) of each token's follower bits, in natural logs, in the order of texts.

    start: where each token's text begins; learn: whether the token is a training one.
    """
    odds, both = _odds(), one >= 128
    one = one & np.uint8(127)
    hit_two, hit_one = (two > 0) & (two & 1 == 0), (one > 0) & (one & 1 == 0)
    hit = hit_two | hit_one
    at = np.arange(len(two))
    miss = np.maximum.accumulate(np.where(hit, -1, at))
    run = at - 1 - np.maximum(np.concatenate([[-1], miss[:-1]]), start - 1)
    gate = np.searchsorted(RUNS, run, side="right")
    cost = np.zeros(len(two))
    for rows, state, other, right, kind in (
        (np.flatnonzero(two > 0), two, np.where(both, odds[one], 0.0), hit_two, both),
        (np.flatnonzero((one > 0) & ~both & ~hit_two), one, np.zeros(len(two)), hit_one, two > 0),
    ):
        if len(rows):
            x = np.stack([odds[state[rows]], other[rows], np.ones(len(rows))], axis=1) * np.where(right[rows], 1.0, -1.0)[:, None]
            cost[rows] += follow_mixer().follow(x, gate[rows] * 2 + kind[rows], learn[rows].astype(float))
    return cost, hit


def token_costs(t: _Tokens, c: np.ndarray, word_cost: np.ndarray, two: np.ndarray, one: np.ndarray, rate: float) -> np.ndarray:
    """Log10 cost of each token. c, word_cost: each token's training count and the cost of its word."""
    cost, hit = follower_costs(two, one, t.start, ~t.token_held())
    cost /= math.log(10)
    reached, unknown = ~hit, (c == 0) & ~hit

    def before(flags: np.ndarray) -> np.ndarray:
        """How many tokens before this one in its text have the flag."""
        total = np.cumsum(flags) - flags
        return total - total[t.start]

    p = (before(unknown) + ESCAPE_WEIGHT * rate) / (before(reached) + ESCAPE_WEIGHT)
    cost += np.where(hit, 0.0, np.log10(np.where(unknown, p, 1 - p)))
    known = reached & ~unknown
    cost[known] += word_cost[known]
    at = np.flatnonzero(unknown)
    if len(at):
        # a word that the text has spelled is repeated, evenly among those; the first of a text can't be
        doc = t.start[at]
        first = np.zeros(len(at), bool)
        first[np.unique(doc * (len(t.words) + 1) + t.ids[at], return_index=True)[1]] = True
        begin = np.searchsorted(doc, doc)
        spelled, again = np.cumsum(first) - first, np.cumsum(~first) - ~first
        spelled, again = spelled - spelled[begin], again - again[begin]
        q = np.where(np.arange(len(at)) == begin, 0.0, (again + 0.2) / (np.arange(len(at)) - begin + 1.0))
        cost[at] += np.where(first, np.log10(1 - q) + word_cost[at], np.log10(np.maximum(q, 1e-300)) - np.log10(np.maximum(spelled, 1)))
    return cost


def _score_block(blocks: pa.Table, answers: pa.Table, of_bucket: np.ndarray, tokens: int, kinds: int, rate: float, last_bits: int, hot: np.ndarray, salts: int) -> pa.Table:
    row = blocks.to_pylist()[0]
    t = _Tokens(row)
    parts = sorted(answers.select(["kind", "part", "one", "two"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
    words, followers = [r for r in parts if r["kind"] == 0], [r for r in parts if r["kind"] == 1]
    _, place = t.entries(last_bits, hot, salts, inverse=True)
    two, one = (np.concatenate([unpacked(r[x], np.uint8) for r in followers])[place] for x in ("one", "two"))
    del place
    present, _, pair = t.pairs(of_bucket)
    by_pair = np.zeros(len(present), np.float32)
    by_pair[present] = np.concatenate([unpacked(r["one"], np.float32) for r in words])
    c = np.empty(len(t.keys), np.int64)
    c[t.by_key] = np.concatenate([unpacked(r["two"], np.int64) for r in words])
    c, word_cost = c[t.ids], by_pair[pair].astype(float)
    score = np.add.reduceat(token_costs(t, c, word_cost, two, one, rate), t.first)
    base = np.add.reduceat(np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1))), t.first)
    size = np.array(row["bytes"])
    bits = pa.array(-score / math.log10(2) / np.maximum(size, 1), mask=size == 0)
    out = {
        "doc_id": blocks.column("doc_ids").combine_chunks().flatten(), "held_out": pa.array(t.held), "n_tokens": pa.array(t.lengths), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), t.first)),
        "train_tokens": pa.array(np.full(len(size), tokens)), "base_score": pa.array(base), "score": pa.array(score), "bits_per_byte": bits,
    }
    pa.default_memory_pool().release_unused()
    return pa.table(out)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from rows whose crc32(doc_id as text) mod 10 isn't 0 (a null id counts
    as the empty text). Null text is empty: its one token is the end, and
    bits_per_byte is null for it. Repeated rows count and are scored one by one.
    Without training rows every word is unknown. An empty table gives no rows.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), (F.crc32(key.cast("binary")) % 10 == 0).alias("held"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    block_row = f"block long, n_words long, n_tokens long, words array<binary>, ids binary, lengths array<long>, bytes array<long>, held array<boolean>, doc_ids array<{kind}>"
    blocks = staged(rows.mapInArrow(_block_rows, block_row), "blocks")
    entries, all_tokens = blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    bits, context_bits = (max(0, math.ceil(math.log2(max(1, (n or 0) / most)))) for n, most in ((entries, WORD_ENTRIES), (all_tokens, FOLLOWER_ENTRIES)))

    seen = blocks.select("words", "ids", "lengths", "held")
    follows = seen.mapInArrow(_follow_rows, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS squared rows, whatever the corpus
    matrix = np.zeros((BUCKETS, BUCKETS))
    matrix[follows["i"], follows["j"]] = follows["n"]
    classes = bucket_classes(matrix)

    asked = blocks.mapInArrow(lambda b: _word_rows(b, bits, classes), _WORD_ROWS)
    shards = staged(asked.groupBy("shard").applyInArrow(_merged, _SHARD), "shards")
    sums = shards.agg(F.sum("n_words"), F.sum("known"), F.sum("once"), *(F.sum(F.col("by_class")[c]) for c in range(CLASSES))).first()
    n_words, kinds, once, *by_class = (x or 0 for x in sums)
    tokens = sum(by_class)
    rate = min(0.5, max(1e-9, (once + 0.5) / (tokens + 1.0)))
    by_class = np.array(by_class)
    costs = shards.mapInArrow(lambda b: _cost_rows(b, by_class, bits), _ANSWER)

    last_bits = min(63 - BEFORE_BITS - FOLLOWER_BITS, max(context_bits, math.ceil(math.log2(n_words + 2)) + 4))
    # a last word with more tokens than this is split; at most eight words a shard can have so many
    least = max(1.0, tokens / (8 << context_bits))
    hot = shards.select("keys", "counts").mapInArrow(lambda b: _hot_rows(b, least), "k long").toPandas()["k"].to_numpy().astype(np.int64).view(np.uint64) if context_bits else np.zeros(0, np.uint64)
    salts = 8 << context_bits
    met = blocks.mapInArrow(lambda b: _entry_rows(b, context_bits, last_bits, hot, salts), "shard long, block long, entries binary, times binary")
    states = met.groupBy("shard").applyInArrow(_matched, _ANSWER)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    answers = costs.unionByName(states)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda b, a: _score_block(b, a, classes, tokens, kinds, rate, last_bits, hot, salts), schema)


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_context_mixing": op1_context_mixing}
SQL: dict[str, str] = {}
