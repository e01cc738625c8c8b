"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words at its spaces (no piece of the model reaches over one), and
each distinct word of a batch is encoded once. All words of a batch lie in flat
numpy arrays of symbols. In each round every word finds its adjacent pair of
minimum rank by a segmented minimum, the leftmost such pair merges in all words
at once, and the arrays are compacted, until no word has a pair left. One merge
a word and round keeps the library's order exactly, also where a merge makes a
pair that outranks the one just used.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of more symbols than this is merged with a heap, as rounds would take time by its square.
LONG_WORD = 400
#: Distinct words that a worker remembers before it starts afresh, which bounds its memory.
REMEMBERED = 250_000
#: Bytes of text that a worker reads and encodes at a time, and distinct words that merge together.
TOGETHER, WORDS_TOGETHER = 1_000_000, 20_000
MARK = "▁"


class PieceModel:
    """Pieces, scores and the byte fallback of a BPE model file, as tables for numpy."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are read")
        self.unk, self.bos, self.eos = proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal) or any(p.type == 4 for p in proto.pieces):
            raise ValueError("a piece reaches over a space")
        self.ids = normal
        self.byte_id = np.zeros(256, np.int32)
        self.byte_of = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        # every split of a piece in two pieces or characters is a pair; its rank is the piece's by falling score
        chars = {c for p in normal for c in p}
        self.symbol = {c: k for k, c in enumerate(sorted(set(normal) | chars))}
        n = self.n_symbols = len(self.symbol)
        order = sorted(normal, key=lambda p: (-proto.pieces[normal[p]].score, normal[p]))
        scores = np.array([proto.pieces[normal[p]].score for p in order])
        rank = np.concatenate([[0], np.cumsum(scores[1:] != scores[:-1])]) if len(order) else np.zeros(0, int)
        keys, ranks, made = [], [], []
        for p, r in zip(order, rank, strict=True):
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(r)
                    made.append(self.symbol[p])
        self.pair_of = dict(zip(keys, zip(ranks, made, strict=True), strict=True))
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[at], np.array(ranks, np.int32)[at], np.array(made, np.int32)[at]
        self.text_of_symbol = [None] * n
        for s, k in self.symbol.items():
            self.text_of_symbol[k] = s

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank ``2**31 - 1`` where none."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.n_symbols + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], 2**31 - 1), self.made[at]

    def merged(self, words: list[str]) -> list[list]:
        """Symbols of each word after all merges: symbol numbers, or characters that the model lacks."""
        out: list = [None] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[k] = self._by_heap(w)
            else:
                short.append(k)
        if not short:
            return out
        texts = [words[k] for k in short]
        lengths = np.array([len(w) for w in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        # a character without a symbol keeps its code point as a negative number
        symbol = np.array([self.symbol.get(chr(c), -int(c) - 1) for c in kinds], np.int64)[inverse]
        word = np.repeat(np.arange(len(texts)), lengths)
        done_symbols, done_words = [], []
        while len(symbol) > 1:
            rank, made = self.pairs(symbol[:-1], symbol[1:])
            rank = np.where(word[:-1] == word[1:], rank, 2**31 - 1)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(np.append(rank, 2**31 - 1), starts)  # the last symbol of a word has no pair
            size = np.diff(np.append(starts, len(word)))
            active = best < 2**31 - 1
            if not active.all():  # words without a pair leave
                stay = np.repeat(active, size)
                done_symbols.append(symbol[~stay])
                done_words.append(word[~stay])
                if not active.any():
                    symbol, word = symbol[:0], word[:0]
                    break
                keep_pair = stay[:-1]
                symbol, word = symbol[stay], word[stay]
                rank, made = rank[keep_pair], made[keep_pair]
                if len(rank) == len(symbol):
                    rank, made = rank[:-1], made[:-1]
                size, best = size[active], best[active]
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            first = np.flatnonzero(rank == np.repeat(best, size)[: len(rank)])
            _, lead = np.unique(word[first], return_index=True)
            at = first[lead]
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        done_symbols.append(symbol)
        done_words.append(word)
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        by_word = np.argsort(word, kind="stable")
        ends = np.searchsorted(word[by_word], np.arange(len(texts)), side="right")
        flat, begin = symbol[by_word].tolist(), 0
        for k, end in zip(short, ends.tolist(), strict=True):
            out[k] = flat[begin:end]
            begin = end
        return out

    def _by_heap(self, word: str) -> list[int]:
        """The same merges for one long word, in time by its length times the logarithm."""
        symbol = [self.symbol.get(c, -ord(c) - 1) for c in word]
        n, left, right = len(symbol), list(range(-1, len(symbol) - 1)), list(range(1, len(symbol) + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if symbol[i] >= 0 and symbol[j] >= 0 and (found := self.pair_of.get(symbol[i] * self.n_symbols + symbol[j])):
                heapq.heappush(heap, (found[0], i, symbol[i], symbol[j]))

        alive = [True] * n
        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], alive[j] = self.pair_of[a * self.n_symbols + b][1], False
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s, ok in zip(symbol, alive, strict=True) if ok]

    def ids_of(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            text = self.text_of_symbol[s] if s >= 0 else chr(-s - 1)
            if (known := self.ids.get(text)) is not None:
                out.append(known)
            else:
                out += self.byte_id[list(text.encode())].tolist()
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self.ids_of(s) for s in self.merged(words)]

    def piece_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of normal, byte and control pieces, with marks as spaces."""
        return b"".join(
            bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in (self.bos, self.eos) else " ⁇ ".encode() if i == self.unk else self.pieces[i].replace(MARK, " ").encode()
            for i in ids
        )


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of this file, read once in each worker."""
    return PieceModel(path)


def split_words(text: str) -> list[str]:
    """Words of a text after the dummy prefix: a mark starts a word unless a mark stands before it."""
    if not text:
        return []
    marked = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
    words, run = [], 1
    for part in marked:
        if part:
            words.append(MARK * run + part)
            run = 1
        else:
            run += 1
    if run > 1:
        words.append(MARK * (run - 1))
    return words


class Codec:
    """Encodes texts word by word, and remembers words up to ``REMEMBERED``."""

    def __init__(self, path: str):
        self.model, self.known = load(path), {}

    def learn(self, texts: list[str]) -> list[list[str]]:
        split = [split_words(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in self.known})
        if new and len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list({w for ws in split for w in ws})
        for at in range(0, len(new), WORDS_TOGETHER):
            some = new[at : at + WORDS_TOGETHER]
            for w, ids in zip(some, self.model.encode_words(some), strict=True):
                self.known[w] = (len(ids), " ".join(map(str, ids)), self.model.piece_bytes(ids))
        return split

    def encode(self, text: str) -> list[int]:
        words = self.learn([text])[0]
        return [int(i) for w in words for i in self.known[w][1].split()] + [self.model.eos]

    def decode(self, ids: list[int]) -> str:
        raw = self.model.piece_bytes(ids)
        return decoded(raw)


def decoded(raw: bytes) -> str:
    """Text of decoded bytes without the dummy space; each byte that is no UTF-8 is U+FFFD."""
    raw = raw.removeprefix(b" ")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace")


ENCODED = "n_tokens long, ids string, decoded string"


def _coded(batches: Iterator[pa.RecordBatch], path: str, hashed: bool) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for batch in batches:
        sizes, at = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist(), 0
        while at < len(sizes):  # rows of some bytes at a time are read, coded and handed on, as a batch may hold very long texts
            end, held = at, 0
            while end < len(sizes) and (end == at or held + sizes[end] < TOGETHER):
                held += sizes[end]
                end += 1
            part, at = batch.slice(at, end - at), end
            rest = [part.column(i) for i in range(1, part.num_columns)]
            counts, ids, back = [], [], []
            for words in codec.learn([t or "" for t in part.column(0).to_pylist()]):
                known = [codec.known[w] for w in words]
                counts.append(sum(k[0] for k in known) + 1)
                for out, made in ((ids, " ".join([k[1] for k in known] + [str(codec.model.eos)])), (back, decoded(b"".join(k[2] for k in known)))):
                    out.append(hashlib.sha256(made.encode()).hexdigest() if hashed else made)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [*[f"c{i}" for i in range(len(rest))], "n_tokens", "ids", "decoded"])
        pa.default_memory_pool().release_unused()


def encode_table(docs: DataFrame, path: str, keep: list[str], text: str = "text", hashed: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens (with the end id), ids (decimal, joined by a space) and decoded text.

    With ``hashed``, ids and decoded are lower-case hex SHA-256 digests instead.
    Null text is empty: one id, the end. Every row is encoded, repeated ones too.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(fields)), ENCODED])
    out = docs.select(F.col(text), *keep).mapInArrow(lambda b: _coded(b, path, hashed), schema)
    return out.toDF(*keep, "n_tokens", "ids", "decoded")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The digest rows of ``op8_piece_codec`` for a documents table."""
    return encode_table(docs, path, ["doc_id"], hashed=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())


QUERIES = {"op8_piece_codec": op8_piece_codec}
SQL: dict[str, str] = {}
