"""Alignment of a byte-level BPE (A) with a SentencePiece BPE (B) on the bytes of each text.

A text is cut before each space that follows a visible character. No token of
either side reaches over such a cut and no token depends on what lies beyond
it, so a piece has the same tokens wherever it stands, and each distinct piece
of a block of texts is tokenised and aligned once, as a document of its own key:

* the tokens of all pieces of a batch lie in two frames (start, key), and
  ``pandas.merge_asof`` by key finds, for each token start, the token of the
  other side that covers it. Both directions together are all overlaps;
* bytes where a token of A and one of B end cut the piece into groups.

A block of texts is one row: the texts' pieces, the pieces' links and the
distinct id pairs. Pair counts of the corpus are summed by Spark, joined back on
(block, pair), and added up along links, pieces and texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged

#: Characters of text in a block, and in a call of the tokenizers; a longer text is a block of its own.
BLOCK_CHARS, CALL_CHARS = 12_000_000, 400_000
#: Pieces aligned by one pair of merges.
PIECES_A_MERGE = 20_000
#: An id pair is A's id times this plus B's id.
B_IDS = 1 << 15
_CUT, _ODD = re.compile(r"(?<=\S) "), re.compile(r"\s ")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in model["added_tokens"]}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in t)
        merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])]
        order = [vocab[t] for t in merged]
        if order != sorted(order) or model["pre_tokenizer"]["type"] != "ByteLevel" or not model["pre_tokenizer"].get("use_regex", True) or model["normalizer"]:
            raise ValueError("only a byte-level BPE whose ids follow its merges is read")
        # ids that follow the merges are ranks, which the faster library takes
        self.a = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if b}, special_tokens={})
        proto = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            proto.ParseFromString(f.read())
        if len(proto.pieces) > B_IDS or len(self.a_bytes) > 2**31 // B_IDS:
            raise ValueError("vocabularies are too large for a pair in 31 bits")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        self.mark = self.b.piece_to_id("▁")
        self.signed = pa.array([f"{i}{sign}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in (",", "|", ";", "")], pa.large_string())
        self.a_size, self.b_size = np.array([len(b) for b in self.a_bytes]), np.array([len(b) for b in self.b_bytes])

    def both(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of space+text by A and of text by B, which puts the space itself."""
        return self.a.encode_ordinary(" " + text), self.b.encode(text) if text else [self.mark]

    def whole(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both sides join to ``raw``."""
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A with their piece numbers, ids of B with theirs, and which pieces have no tokens as their bytes differ."""
        bad, parts, at = np.zeros(len(pieces), bool), [], 0
        # what ends in white space would change if another piece followed
        joins = np.array([bool(p) and not p[-1].isspace() and "▁" not in p for p in pieces])
        together, alone = np.flatnonzero(joins), np.flatnonzero(~joins).tolist()
        sizes = np.cumsum([len(pieces[k]) + 1 for k in together.tolist()]) if len(together) else np.zeros(0, int)
        while at < len(together):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CALL_CHARS)))
            some = together[at:end]
            texts = [pieces[k] for k in some.tolist()]
            joined = " ".join(texts)
            a, b = self.both(joined)
            ends = np.cumsum([len(t.encode()) + 1 for t in texts])
            a_, b_ = np.array(a), np.array(b)
            a_ends, b_ends = np.cumsum(self.a_size[a_]), np.cumsum(self.b_size[b_])
            if self.whole(b" " + joined.encode(), a, b) and np.isin(ends, a_ends).all() and np.isin(ends, b_ends).all():
                parts.append((a_, some[np.searchsorted(ends, a_ends)], b_, some[np.searchsorted(ends, b_ends)]))
            else:
                alone += some.tolist()
            at = end
        for k in alone:
            a, b = self.both(pieces[k])
            bad[k] = not self.whole(b" " + pieces[k].encode(), a, b)
            if not bad[k]:
                parts.append((np.array(a), np.full(len(a), k), np.array(b), np.full(len(b), k)))
        a, a_key, b, b_key = (np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(4))
        by_a, by_b = np.argsort(a_key, kind="stable"), np.argsort(b_key, kind="stable")
        return a[by_a], a_key[by_a], b[by_b], b_key[by_b], bad


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Tokenizers:
    """Both tokenizers, read once in each worker."""
    return Tokenizers(a_path, b_path)


def pieces_of(text: str) -> list[str]:
    """The parts of a text between spaces that follow a visible character; each stands for itself with a space before it."""
    if text[0] != " " and not _ODD.search(text):
        return text.split(" ")
    first, *rest = _CUT.split(" " + text)
    return [first[1:], *rest]


def overlaps(a_at: np.ndarray, a_key: np.ndarray, b_at: np.ndarray, b_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all tokens that overlap, by A then B; starts grow along keys and within them."""
    a = pd.DataFrame({"at": a_at, "key": a_key, "a": np.arange(len(a_at))})
    b = pd.DataFrame({"at": b_at, "key": b_key, "b": np.arange(len(b_at))})
    covered = pd.merge_asof(a, b, on="at", by="key")
    covering = pd.merge_asof(b, a.assign(start=a_at), on="at", by="key")
    covering = covering[covering["start"] < covering["at"]]  # equal starts are found above
    of_a = np.concatenate([covered["a"].to_numpy(), covering["a"].to_numpy(np.int64)])
    of_b = np.concatenate([covered["b"].to_numpy(np.int64), covering["b"].to_numpy()])
    order = np.lexsort((of_b, of_a))
    return of_a[order], of_b[order]


def aligned(tools: Tokenizers, pieces: list[str]) -> dict:
    """Of each piece: numbers of tokens, groups and links, the groups as text, whether it is bad; and the id pairs of all links in order of pieces."""
    a, a_key, b, b_key, bad = tools.tokens(pieces)
    a_end, b_end = np.cumsum(tools.a_size[a]), np.cumsum(tools.b_size[b])  # both sides hold the same bytes, so ends agree
    of_a, of_b = overlaps(a_end - tools.a_size[a], a_key, b_end - tools.b_size[b], b_key)
    cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
    n, last = len(pieces), len(cuts) - 1
    count = lambda key: np.bincount(key, minlength=n)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    group_key = a_key[np.searchsorted(a_end, cuts)]
    groups = count(group_key)
    # every id is followed by a comma, at the end of A's part of a group by a bar, at a group's end by a semicolon, at a piece's end by nothing
    a_sign = np.where(np.append(a_group[1:] != a_group[:-1], True), 1, 0) if len(a) else a
    ends = np.append(group_key[1:] != group_key[:-1], True)[np.minimum(b_group, last)] if len(b) else np.zeros(0, bool)
    b_sign = np.where(np.append(b_group[1:] != b_group[:-1], True), np.where(ends, 3, 2), 0) if len(b) else b
    shown = np.empty(len(a) + len(b), np.int64)
    shown[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a * 4 + a_sign
    shown[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = b * 4 + b_sign
    letters = tools.signed.take(pa.array(shown))
    until = np.frombuffer(letters.buffers()[1], np.int64, len(letters) + 1)
    offsets = until[np.append(0, np.cumsum(count(a_key) + count(b_key)))]
    return {
        "n_a": count(a_key), "n_b": count(b_key), "n_groups": groups, "n_links": count(a_key[of_a]) if len(of_a) else np.zeros(n, int), "bad": bad,
        "groups": pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), letters.buffers()[2]).to_pylist(), "pairs": (a[of_a] * B_IDS + b[of_b]).astype(np.int32),
    }


class _Numbered(dict):
    """Numbers new pieces in the order of their first use."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


def _squeezed(a: np.ndarray) -> bytes:
    return zlib.compress(a.astype("<u4").tobytes(), 1)


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)


def _block(tools: Tokenizers, keys: list, numbers: list, known: _Numbered) -> dict:
    """The row of one block: its texts' counts and digests, and arrays that lead from texts to pieces, links and id pairs."""
    pieces, parts = list(known), []
    for at in range(0, len(pieces), PIECES_A_MERGE):
        parts.append(aligned(tools, pieces[at : at + PIECES_A_MERGE]))
    put = lambda name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64)
    counts = np.stack([put(c) for c in ("n_a", "n_b", "n_groups", "n_links")], axis=1).astype(np.int64)
    groups, bad, links = [g for p in parts for g in p["groups"]], put("bad").astype(bool), put("pairs").astype(np.int32)
    docs, kept = [], []
    for key, own in zip(keys, numbers, strict=True):
        if own is None or bad[own].any():
            docs.append((key, 0, 0, 0, 0, ""))
            kept.append(np.zeros(0, np.uint32))
        else:
            digest = hashlib.sha256(";".join([groups[k] for k in own.tolist()]).encode()).hexdigest()
            docs.append((key, *counts[own].sum(axis=0).tolist(), digest))
            kept.append(own)
    words = np.concatenate(kept) if kept else np.zeros(0, np.uint32)
    pairs, of_link = np.unique(links, return_inverse=True)
    uses = np.repeat(np.bincount(words, minlength=len(pieces)), counts[:, 3]) if len(pieces) else np.zeros(0, int)
    total = np.bincount(of_link, weights=uses, minlength=len(pairs)).astype(np.int64)
    return {
        "docs": docs, "pairs": pairs, "uses": total, "doc_words": _squeezed(np.array([len(k) for k in kept])), "words": _squeezed(words),
        "word_links": _squeezed(counts[:, 3]), "links": _squeezed(of_link),
    }


def _blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, key_type: pa.DataType, block_chars: int) -> Iterator[pa.RecordBatch]:
    tools, part, n = load(a_path, b_path), TaskContext.get().partitionId(), 0
    doc = pa.struct([("key", key_type), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])
    kinds = [("block", pa.int64()), ("docs", pa.list_(doc)), ("pairs", pa.list_(pa.int32())), ("uses", pa.list_(pa.int64()))]
    schema = pa.schema(kinds + [(c, pa.binary()) for c in ("doc_words", "words", "word_links", "links")])
    keys, numbers, known, held = [], [], _Numbered(), 0

    def done() -> pa.RecordBatch:
        row = _block(tools, keys, numbers, known)
        names = [f.name for f in doc]
        row["docs"] = [dict(zip(names, d, strict=True)) for d in row["docs"]]
        return pa.RecordBatch.from_pylist([row | {"block": (part << 24) + n}], schema=schema)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            numbers.append(np.array([known[p] for p in pieces_of(text)], np.uint32) if text else None)
            held += len(text or "")
            if held >= block_chars:
                yield done()
                keys, numbers, known, held, n = [], [], _Numbered(), 0, n + 1
    if keys:
        yield done()


SUMS = "n_best long, count_sum long"


def _summed(batches: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c).slice(i, 1) for c in batch.schema.names}
            found = row["found"].flatten()
            at = found.field("at").to_numpy(zero_copy_only=False)
            count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            count[at], best[at] = found.field("count").to_numpy(zero_copy_only=False), found.field("best").to_numpy(zero_copy_only=False)
            doc_words, words, word_links, links = (_read(row[c][0].as_py()) for c in ("doc_words", "words", "word_links", "links"))
            along = lambda each, lengths: np.diff(np.append(0, np.cumsum(each))[np.append(0, np.cumsum(lengths))])
            sums = [along(along(x[links], word_links)[words], doc_words) for x in (best, count)]
            docs = row["docs"].flatten()
            yield pa.RecordBatch.from_arrays([*(docs.field(c) for c in names), *(pa.array(s, pa.int64()) for s in sums)], schema=schema)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A null or empty text, or one that a tokenizer doesn't give back (it holds
    U+2581), has no tokens: zeros and an empty digest. Repeated rows and null
    keys count as rows of their own; ties for a B id's best partner all count.
    Other columns of ``docs`` are not read, whatever their names. An empty
    table gives no rows. A text is held whole in its task.
    """
    field = docs.schema[key]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = field.dataType.simpleString()
    doc = f"struct<key: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>"
    key_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    made = rows.mapInArrow(
        lambda b: _blocks(b, a_path, b_path, key_type, block_chars),
        f"block long, docs array<{doc}>, pairs array<int>, uses array<long>, doc_words binary, words binary, word_links binary, links binary",
    )
    blocks = staged(made, "align-blocks")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "uses")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.uses").alias("uses"))
    counts = staged(asked.groupBy("pair").agg(F.sum("uses").alias("count")), "align-pairs").withColumn("b", F.col("pair") % B_IDS)
    tops = counts.groupBy("b").agg(F.max("count").alias("top"))
    known = counts.join(F.broadcast(tops), "b").select("pair", "count", (F.col("count") == F.col("top")).cast("byte").alias("best"))  # a row for each id of B at most
    answers = asked.join(known, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    whole = blocks.drop("pairs", "uses").join(answers, "block", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at: int, count: bigint, best: tinyint>>")))
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = pa.schema([("key", key_type), *((c, pa.int64()) for c in names[1:5]), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    done = whole.mapInArrow(lambda b: _summed(b, names, out), f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {SUMS}")
    return done.withColumnRenamed("key", key)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_paths())


QUERIES = {"op11_token_alignment": op11_token_alignment}
SQL: dict[str, str] = {}
