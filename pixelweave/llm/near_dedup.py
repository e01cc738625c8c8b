"""Near-duplicate groups by SuperMinHash, banding, exact verification and components.

1. Each text becomes its set of word shingles and a SuperMinHash signature: an
   element takes its ranks from one random permutation of the slots, so ranks of
   an element are correlated and estimates vary less than with independent
   hashes; an element stops as soon as its next rank can't lower any slot.
2. Equal sets are one class; from here on, only classes are looked at.
3. Classes that agree in a band of the signature share a bucket. In each bucket
   all members are held against one leader on their full sets.
4. Members that are then outside their leader's component are held against every
   member of the bucket in another component, so no link between candidates is
   lost, and no pairs are made inside a component that is known already.
5. Components of the links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.graph import components
from pixelweave.functions.staging import fresh, staged
from pixelweave.llm.text import byte_words

SHINGLE = 5
THRESHOLD = 80
#: Slots of a signature; 40 bands of 6 find a pair of similarity 0.8 but for 5 in a million.
BANDS, ROWS = 40, 6
SLOTS = BANDS * ROWS
#: Slots whose bits of one place are in a word.
PLANE = 60
#: A pair whose estimate is this far below the threshold (five standard errors) isn't verified.
MARGIN = 0.135
#: Shingle elements that are worked on together, and words whose hashes a worker remembers.
_ELEMENTS, _REMEMBERED = 200_000, 500_000

_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    x ^= x >> np.uint64(31)
    return x


def shingle_set(words: list[bytes], k: int, known: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < k:
        acc = h[:1]
        for i in range(1, n):
            acc = _scramble(acc * _MIX[0] + h[i : i + 1])
        return _scramble(acc + np.uint64(n))
    acc = h[: n - k + 1]
    for i in range(1, k):
        acc = acc * _MIX[3 + i % 3] + h[i : n - k + 1 + i]
    return np.unique(_scramble(acc))


def super_minhash(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots) of consecutive sets; ``inf`` where a set is empty.

    Round j offers each element's j-th slot with rank j + r, r in [0, 1). A set
    is done when all its slots are below j + 1, as later ranks are larger.
    """
    docs = len(sizes)
    out = np.full(docs * slots, np.inf)
    doc = np.repeat(np.arange(docs), sizes)
    order = None  # each element's permutation, as far as it is drawn
    active = elements
    for j in range(slots):
        if not len(active):
            break
        u = _scramble(active + np.uint64((j + 1) * int(_MIX[0]) & 0xFFFFFFFFFFFFFFFF))
        rank = (u >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        pick = j + ((u & np.uint64(0x7FF)) * np.uint64(slots - j) >> np.uint64(11)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            at = np.arange(len(active))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[at, j]
            order[at, j] = slot
        np.minimum.at(out, doc * slots + slot, rank)
        unfinished = (out.reshape(docs, slots) >= j + 1).any(axis=1)
        go = unfinished[doc]
        if order is None:
            active, doc, slot = active[go], doc[go], slot[go]
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(active), 1))
            order[np.arange(len(active)), slot] = 0
            order[:, 0] = slot
        elif not go.all():
            active, doc, order = active[go], doc[go], order[go]
    return out.reshape(docs, slots)


def _bands(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x BANDS) and four bits of each slot, sixty slots to four words: their first bits, second, third, fourth."""
    bits = _scramble(signature.view(np.uint64).reshape(signature.shape))
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0], (len(bits), BANDS)).copy()
    for r in range(ROWS):
        acc = _scramble(acc * _MIX[5] + bits[:, r::ROWS])
    planes = [((bits >> np.uint64(p) & np.uint64(1)).reshape(len(bits), -1, PLANE) << np.arange(PLANE, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) for p in range(4)]
    return acc.view(np.int64), np.stack(planes, axis=2).reshape(len(bits), -1).view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def signatures(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, bits) of each row; set_key is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            ids, at, texts = batch.column(0), 0, batch.column(1)
            while at < batch.num_rows:
                sets, held = [], 0
                while at + len(sets) < batch.num_rows and held < _ELEMENTS and len(sets) < 4096:
                    raw = texts[at + len(sets)].as_py()
                    sets.append(shingle_set(byte_words(raw) if raw else [], k, known))
                    held += len(sets[-1])
                    if len(known) > _REMEMBERED:
                        known.clear()
                sizes = np.array([len(s) for s in sets])
                bands, bits = _bands(super_minhash(np.concatenate(sets), sizes))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(bands), _lists(bits)],
                    ["doc_id", "n_shingles", "set_key", "bands", "bits"],
                )
                at += len(sets)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """(rep, items): the full shingle sets of (rep, text) rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            at, texts = 0, batch.column(1)
            while at < batch.num_rows:
                sets, held = [], 0
                while at + len(sets) < batch.num_rows and held < 4 * _ELEMENTS:
                    raw = texts[at + len(sets)].as_py()
                    sets.append(shingle_set(byte_words(raw) if raw else [], k, known))
                    held += len(sets[-1])
                    if len(known) > _REMEMBERED:
                        known.clear()
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), items], ["rep", "items"])
                at += len(sets)

    return rows.mapInArrow(work, "rep long, items array<long>")


def _likely(bits_a: Column, bits_b: Column, size_a: Column, size_b: Column, threshold: int) -> Column:
    """Whether sizes allow the threshold and the estimate from four-bit slots comes near it."""

    def differing(word: int) -> Column:
        x = bits_a[word].bitwiseXOR(bits_b[word])
        for i in range(word + 1, word + 4):
            x = x.bitwiseOR(bits_a[i].bitwiseXOR(bits_b[i]))
        return F.bit_count(x)

    # each word is named once: a join's condition computes again what it names again, and Java compiles no method of over 8,000 bytes
    differ = differing(0)
    for word in range(4, SLOTS // PLANE * 4, 4):
        differ = differ + differing(word)
    # a slot of different elements still agrees in four bits once in sixteen
    most = int(SLOTS * (1 - (threshold / 100 - MARGIN)) * 15 / 16)
    return (100 * F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b)) & (differ <= most)


def _linked(x: Column, y: Column, threshold: int) -> Column:
    """Whether 100 * intersection >= threshold * union, with the intersection named once."""
    return (100 + threshold) * F.size(F.array_intersect(x, y)) >= threshold * (F.size(x) + F.size(y))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) whose full sets have 100 * intersection >= threshold * union."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_linked(F.col("x"), F.col("y"), threshold)).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when their shingle sets have at least ``threshold`` percent
    of their union in common. component_id is the least id that links reach, and
    kept is true for it. A text without words (or null) is linked with nothing. A
    row with a null id is linked with nothing and kept. Rows that share an id are
    one document. Ties need no rule, as groups don't depend on order. An empty
    table gives no rows.
    """
    base = staged(signatures(docs, doc_id, text, k), "signatures")
    filled = base.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = staged(
        filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes"
    )
    about = classes.select("rep", "n", "bits")
    bands = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("bucket", "leader")
    members = staged(bands.join(shared, "bucket"), "members")

    def near(pairs: DataFrame) -> DataFrame:
        one = about.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
        two = about.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
        full = pairs.join(one, "a").join(two, "b")
        return full.where(_likely(F.col("xa"), F.col("xb"), F.col("na"), F.col("nb"), threshold)).select("a", "b")

    star = near(members.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct())
    # the sets of all that share a bucket, from one more pass over the texts
    wanted = members.select("rep").distinct()
    first = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("binary").alias("text"))
    # rows of one id with different texts are all there, and a link of any of them counts
    sets = staged(_sets(first.join(wanted, "rep", "left_semi"), k), "sets")
    links = staged(_verified(star, sets, threshold), "links")
    roots = components(links)

    # the second look: members outside their leader's component against the others of the bucket
    found = roots.select(F.col("v").alias("rep"), "root")
    placed = members.join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lead = roots.select(F.col("v").alias("leader"), F.col("root").alias("lead_root"))
    placed = staged(placed.join(lead, "leader", "left").withColumn("lead_root", F.coalesce("lead_root", "leader")), "placed")
    strangers = placed.where("root <> lead_root").select("bucket", F.col("rep").alias("a"), F.col("root").alias("ra"))
    torn = strangers.select("bucket").distinct()
    facts = sets.join(about, "rep")
    sized_a = facts.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("items").alias("ia"))
    sized_b = facts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("items").alias("ib"))
    # two strangers are met from both sides, of which one is enough
    one_way = (F.col("rb") == F.col("lead_b")) | (F.col("a") < F.col("b"))
    rest = placed.where("rep <> leader").join(torn, "bucket", "left_semi").select("bucket", F.col("rep").alias("b"), F.col("root").alias("rb"), F.col("lead_root").alias("lead_b"))
    # the full sets are held against each other inside the join, so near misses of a large group are never rows
    near_enough = _likely(F.col("xa"), F.col("xb"), F.col("na"), F.col("nb"), threshold) & _linked(F.col("ia"), F.col("ib"), threshold)
    again = strangers.join(sized_a, "a").join(rest.join(sized_b, "b"), "bucket").where((F.col("ra") != F.col("rb")) & one_way & near_enough).select("a", "b").distinct()
    again = staged(again, "links")
    roots = components(links.unionByName(again))

    group = classes.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    out = base.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(group, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep, with their columns as they were."""
    gone = near_duplicates(docs, doc_id, text, k, threshold).where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    key = fresh(docs, "near_key")
    gone = gone.select(F.col(doc_id).alias(key))
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(key), "left_anti").select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


QUERIES = {"op3_near_dedup": op3_near_dedup}
SQL: dict[str, str] = {}
