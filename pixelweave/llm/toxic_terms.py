"""Toxicity by a learned lexicon of terms, matched with misspellings.

Fitting, on a bounded sample of labelled rows:

* the lexicon is selected by label from all word beginnings: the shortest ones
  (stems) and the whole words that toxic documents hold after too many
  different words for chance, each lengthened as long as that tells more;
* terms are matched as below; each term, distance and misspelled variant gets a
  shrunk rate of toxic documents. A variant never seen counts like the
  variants seen once;
* two small logistic regressions weigh a hit by its window (within quotation
  marks, other hits near by, exclamation marks) and a document by its hits.

Matching: a word's Levenshtein automaton (with transpositions of neighbours),
as bit sets of positions for each number of errors, walks down the lexicon's
trie and leaves a branch when no position is alive. A stem matches any word
that begins like it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged

#: Labelled rows that the model is fitted on at most, by the hash of their id.
SAMPLE = 12_000
#: Letters of a stem, from and to; a whole word may be longer.
STEM = (3, 20)
#: Words before and after a hit that make its window.
WINDOW = 6
#: Share of toxic documents among those with a term, at least; chance of taking any term that has no such share.
PURE, CHANCE = 0.6, 0.05
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Mean and precision of the weights' prior: (1, log-odds, in quotation marks, hits near by, loud); (1, best hit, sum of hits, density).
HIT_PRIOR = (np.array([0.0, 1.0, -1.5, 0.3, 0.2]), np.array([0.2, 4.0, 2.0, 4.0, 4.0]))
TEXT_PRIOR = (np.array([-1.0, 1.0, 0.3, 0.3]), np.array([0.1, 4.0, 4.0, 4.0]))
LEAST = -6.0
_PART, _DRAWN = re.compile(r"[^\W_]+"), re.compile(r"(.)\1{2,}")
_OPEN, _CLOSE = "\"'“„«‘‹»", "\"'”“»’›«"


def errors(term: str, stem: bool) -> int:
    """Edits that a match of this term may need: longer terms take more, stems fewer."""
    n = len(term)
    return (1 if n >= 6 else 0) if stem else 2 if n >= 9 else 1 if n >= 4 else 0


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    #: Errors that any term below may have.
    room: int = 0
    word: int = -1
    stem: int = -1


class Lexicon:
    """Terms (text, whether a stem) as a trie that automata walk down."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms, self.root = terms, Node()
        self.errors = [errors(t, stem) for t, stem in terms]
        #: Letters of whole words and their errors by the length of what may match; of stems by how far they reach into a word.
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.by_reach: dict[int, list[tuple[int, int]]] = {}
        #: Stems that allow no error.
        self.exact = tuple(t for (t, stem), room in zip(terms, self.errors, strict=True) if stem and not room)
        for (term, stem), room in zip(terms, self.errors, strict=True):
            need = (self._mask(term), room)
            if stem and not room:
                continue
            if stem:
                self.by_reach.setdefault(len(term) + room, []).append(need)
            else:
                for n in range(len(term) - room, len(term) + room + 1):
                    self.by_length.setdefault(n, []).append(need)
        for number, (term, stem) in enumerate(terms):
            node, room = self.root, errors(term, stem)
            node.room = max(node.room, room)
            for c in term:
                node = node.children.setdefault(c, Node())
                node.room = max(node.room, room)
            if stem:
                node.stem = number
            else:
                node.word = number

    @staticmethod
    def _mask(text: str) -> int:
        mask = 0
        for c in text.encode("utf-32-le")[::4]:  # the lowest byte of each letter
            mask |= 1 << c
        return mask

    def _possible(self, word: str) -> bool:
        """False for words that can't match, as an edit brings in one letter at most and takes away one at most."""
        if word.startswith(self.exact):
            return True
        have = ~self._mask(word)
        for need, room in self.by_length.get(len(word), ()):
            if (need & have).bit_count() <= room and (~have & ~need).bit_count() <= room:
                return True
        for reach, stems in self.by_reach.items():
            for need, room in stems:
                if (need & have).bit_count() <= room and (need & ~self._mask(word[:reach])).bit_count() <= room:
                    return True
        return False

    def find(self, word: str) -> dict[int, int]:
        """Term number -> least distance, of all terms within their errors of ``word`` (of its beginning for stems)."""
        if not self._possible(word):
            return {}
        n = len(word)
        last, full = 1 << n, (1 << (n + 1)) - 1
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        start = []
        for e in range(self.root.room + 1):  # position i alive with e errors: i letters skipped before
            start.append((1 << min(n, e) + 1) - 1)
        found: dict[int, int] = {}
        stack = [(self.root, tuple(start), (0,) * len(start), "")]
        while stack:
            node, alive, before, came = stack.pop()
            for number, whole in ((node.word, True), (node.stem, False)):
                if number >= 0:
                    for e in range(min(len(alive), self.errors[number] + 1)):
                        if alive[e] & last if whole else alive[e]:
                            found[number] = min(found.get(number, e), e)
                            break
            for c, child in node.children.items():
                hit, swapped, states = at.get(c, 0), at.get(came, 0) if came else 0, []
                for e in range(child.room + 1):
                    bits = (alive[e] & hit) << 1
                    if e:
                        bits |= (alive[e - 1] << 1) | alive[e - 1] | states[e - 1] << 1  # replaced, left out of the word, put in
                        # neighbours in the other order: the term's last two letters are the word's next two reversed
                        bits |= (before[e - 1] & hit & (swapped >> 1)) << 2
                    states.append(bits & full)
                if any(states):
                    stack.append((child, tuple(states), alive, c))
        return found


@dataclass
class Model:
    lexicon: Lexicon
    #: Log-odds over the base rate of a term itself, of its misspelled variants seen in the sample, and of others at a distance.
    by_term: dict[int, float] = field(default_factory=dict)
    by_variant: dict[tuple[int, str], float] = field(default_factory=dict)
    unseen: dict[tuple[int, int], float] = field(default_factory=dict)
    hit_weights: np.ndarray = field(default_factory=lambda: HIT_PRIOR[0].copy())
    text_weights: np.ndarray = field(default_factory=lambda: TEXT_PRIOR[0].copy())


class Reader:
    """Finds the hits of texts; words are looked up once."""

    def __init__(self, model: Model):
        #: Words looked up, and the hits of those that have any.
        self.model, self.known, self.matched = model, set(), {}

    def _look(self, token: str) -> list[tuple[int, int, str]]:
        """(term, distance, variant) of the best match of a token's parts, or of the token with its inner signs."""
        parts, find = [token] if token.isalnum() else _PART.findall(token), self.model.lexicon.find
        if len(parts) > 1:
            parts.append(token[token.index(parts[0]) : token.rindex(parts[-1]) + len(parts[-1])])
        best: dict[int, tuple[int, str]] = {}
        for part in parts:
            for term, distance in find(_DRAWN.sub(r"\1\1", part)).items():  # a letter drawn out counts twice
                if term not in best or (distance, part) < best[term]:
                    best[term] = (distance, part)
        return [(t, d, p) for t, (d, p) in sorted(best.items(), key=lambda x: (x[1], x[0]))[:1]] if best else []

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, int, int, str]]]:
        """The text's tokens, and its hits (token, term, distance, variant)."""
        tokens, matched = text.lower().split(), self.matched
        own = set(tokens)
        new = own - self.known
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = set(), own
            matched.clear()
        self.known |= new
        for token in new:
            if found := self._look(token):
                matched[token] = found
        if own.isdisjoint(matched):
            return tokens, []
        return tokens, [(i, *hit) for i, token in enumerate(tokens) if token in matched for hit in matched[token]]

    def evidence(self, term: int, distance: int, variant: str) -> float:
        if distance == 0:
            return self.model.by_term[term]
        found = self.model.by_variant.get((term, variant))
        return self.model.unseen[term, distance] if found is None else found

    def windows(self, text: str) -> tuple[int, list[tuple[float, int, int, int]]]:
        """Number of tokens, and of each hit (log-odds, in quotation marks, hits near by up to 3, loud)."""
        tokens, hits = self.hits(text)
        places, out = [h[0] for h in hits], []
        lo = hi = 0
        for i, *hit in hits:
            while places[lo] < i - WINDOW:
                lo += 1
            while hi < len(places) and places[hi] <= i + WINDOW:
                hi += 1
            out.append((self.evidence(*hit), int(quoted(tokens, i)), min(3, hi - lo - 1), int("!" in tokens[i] or i + 1 < len(tokens) and tokens[i + 1][:1] == "!")))
        return len(tokens), out


def quoted(tokens: list[str], i: int) -> bool:
    """Whether a quotation opens and closes around token i within its window."""
    for j in range(i, max(-1, i - WINDOW - 1), -1):
        if j < i and tokens[j].rstrip(".,;:!?")[-1:] in _CLOSE:
            return False
        if tokens[j][0] in _OPEN:
            break
    else:
        return False
    return any(tokens[k].rstrip(".,;:!?")[-1:] in _CLOSE for k in range(i, min(len(tokens), i + WINDOW + 1)))


def hit_logits(model: Model, hits: list[tuple[float, int, int, int]]) -> np.ndarray:
    return np.array([(1.0, *h) for h in hits]) @ model.hit_weights


def text_features(model: Model, n_tokens: int, hits: list) -> tuple[float, float, float, float]:
    """(1, best hit, sum of hits, density): logarithms of how many hits count, alone and in a hundred words."""
    if not hits:
        return 1.0, LEAST, 0.0, 0.0
    z = hit_logits(model, hits)
    total = float((1 / (1 + np.exp(-z))).sum())
    return 1.0, max(LEAST, float(z.max())), math.log1p(total), math.log1p(100 * total / n_tokens)


def logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray, prior: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weights of the most likely regression under a Gaussian prior, by Newton steps."""
    mean, precision = prior
    w = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = ones + zeros
        slope = x.T @ (ones - n * p) - precision * (w - mean)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(precision), slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def beginnings(text: str, only: set[str] | None = None) -> set[tuple[str, str]]:
    """(stem or whole word, word before) of a text, each once; a whole word has a space behind."""
    words, out = _PART.findall(text.lower()), set()
    for before, word in set(zip(["", *words], words, strict=False)):
        for node in (*(word[:k] for k in range(STEM[0], min(len(word), STEM[1]) + 1)), word + " "):
            if only is None or node in only:
                out.add((node, before))
    return out


def choose_terms(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """The lexicon from how many different words stand before each stem and whole word, so that copies of one document count once."""
    base = (n_toxic + 1) / (n_toxic + n_clean + 10)
    need = math.log(max(1, len(toxic)) / CHANCE)

    def gain(node: str) -> float:
        """How much likelier the counts are at the node's own share than at the base rate; 0 below ``PURE``."""
        t, c = toxic[node], clean[node]
        share = t / (t + c) if t else 0.0
        return t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0.0) if share >= PURE else 0.0

    toxic = Counter({node: t for node, t in toxic.items() if t * math.log(1 / base) >= need})
    children: dict[str, list[str]] = {}
    for node in toxic:
        if len(node) > STEM[0] and node[-1] != " ":
            children.setdefault(node[:-1], []).append(node)
    chosen = set()
    for node in sorted(toxic, key=lambda x: (len(x), x)):
        word, stem = node[-1] == " ", node.rstrip(" ")
        if gain(node) < need or any((stem[:k], True) in chosen for k in range(STEM[0], len(stem) + word)):
            continue  # by chance, or a stem of it is in the lexicon
        if word:
            chosen.add((stem, False))
            continue
        while (below := max(children.get(node, []), key=gain, default=None)) and gain(below) >= 0.98 * gain(node):
            node = below
        whole = gain(node + " ") >= max(need, 0.9 * gain(node))
        chosen.add((node, not whole))
    return sorted(chosen)


# ---- fitting on Spark


def _counted(batches: Iterator[pa.RecordBatch], only: set[str] | None) -> Iterator[pa.RecordBatch]:
    held: set[tuple[str, str]] = set()

    def out() -> pa.RecordBatch:
        nodes, before = zip(*held, strict=True)
        return pa.RecordBatch.from_pydict({"node": pa.array(nodes), "before": pa.array(before)})

    for batch in batches:
        for text in batch.column("text").to_pylist():
            held |= beginnings(text, only)
            if len(held) > 200_000:
                yield out()
                held.clear()
    if held:
        yield out()


def _matched(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    reader, counts = Reader(model), Counter()
    for batch in batches:
        for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
            counts.update({(*hit, toxic) for _, *hit in reader.hits(text)[1]})
    rows = list(counts.items())
    if rows:
        term, distance, variant, toxic = zip(*(k for k, _ in rows), strict=True)
        ints = lambda x: pa.array(x, pa.int32())
        yield pa.RecordBatch.from_pydict({"term": ints(term), "distance": ints(distance), "variant": list(variant), "toxic": ints(toxic), "n": [n for _, n in rows]})


def _featured(batches: Iterator[pa.RecordBatch], model: Model, of_hits: bool) -> Iterator[pa.RecordBatch]:
    reader, counts = Reader(model), Counter()
    for batch in batches:
        for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic")), strict=True):
            n, hits = reader.windows(text)
            rows = [(1.0, *h) for h in hits] if of_hits else [text_features(model, n, hits)]
            counts.update((tuple(round(v, 1) for v in row), toxic) for row in rows)
    rows = list(counts.items())
    if rows:
        yield pa.RecordBatch.from_pydict({"x": pa.array([list(k[0]) for k, _ in rows], pa.list_(pa.float64())), "toxic": pa.array([k[1] for k, _ in rows], pa.int32()), "n": [n for _, n in rows]})


def _weights(sample: DataFrame, model: Model, of_hits: bool, prior: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Regression on feature rows rounded to tenths and counted, so few rows come back, whatever the sample."""
    rows = sample.mapInArrow(lambda b: _featured(b, model, of_hits), "x array<double>, toxic int, n long").groupBy("x", "toxic").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return prior[0].copy()
    x, n, y = np.array([r["x"] for r in rows]), np.array([r["n"] for r in rows], float), np.array([r["toxic"] for r in rows])
    return logistic(x, n * y, n * (1 - y), prior)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows, by the hash of their id; each text once, toxic if any label says so."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # ``sample`` rows at most
    return found.groupBy(F.md5("text").alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("same")


def fit(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows whose id ``learn`` accepts. What comes to the driver is bounded by ``sample``."""
    rows = staged(labelled_sample(docs, labels, learn, sample), "toxic-sample")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    base = (n_toxic + 1) / (n_toxic + n_clean + 10)

    def nodes(part: DataFrame, only: set[str] | None) -> DataFrame:
        pairs = part.select("text").mapInArrow(lambda b: _counted(b, only), "node string, before string")
        return pairs.groupBy("node", F.xxhash64("before").alias("before")).agg(F.lit(1)).groupBy("node").agg(F.count(F.lit(1)).alias("n"))

    least = max(2, math.ceil(math.log(1 / CHANCE) / math.log(1 / base)))  # fewer documents are never beyond chance
    toxic = Counter({r["node"]: r["n"] for r in nodes(rows.where("toxic = 1"), None).where(F.col("n") >= least).collect()})
    # where even no clean document at all would leave a node to chance, none is counted
    need = math.log(max(1, len(toxic)) / CHANCE) / math.log(1 / base)
    some = {node for node, n in toxic.items() if n >= need}
    clean = Counter({r["node"]: r["n"] for r in nodes(rows.where("toxic = 0"), some).collect()}) if some else Counter()
    model = Model(Lexicon(choose_terms(toxic, clean, n_toxic, n_clean)))
    seen = rows.mapInArrow(lambda b: _matched(b, model), "term int, distance int, variant string, toxic int, n long").groupBy("term", "distance", "variant").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    _rates(model, [tuple(r) for r in seen.select("term", "distance", "variant", "t", "c").collect()], base)
    model.hit_weights = _weights(rows, model, True, HIT_PRIOR)
    model.text_weights = _weights(rows, model, False, TEXT_PRIOR)
    return model


def _rates(model: Model, seen: list[tuple[int, int, str, int, int]], base: float) -> None:
    """Log-odds of terms, of misspelled variants, and of variants unseen, which count like those of the term seen in one document."""
    odds = lambda p: math.log(p / (1 - p)) - math.log(base / (1 - base))
    exact, once, variants = Counter(), Counter(), []
    for term, distance, variant, t, c in seen:
        if distance == 0:
            exact[term, 1] += t
            exact[term, 0] += c
        else:
            variants.append((term, distance, variant, t, c))
            once.update({(term, distance, 1): t, (term, distance, 0): c} if t + c == 1 else {})
    rate = {}
    for term in range(len(model.lexicon.terms)):
        t, c = exact[term, 1], exact[term, 0]
        model.by_term[term] = odds((t + 1.6) / (t + c + 2))
        for d in (1, 2):
            t, c = once[term, d, 1], once[term, d, 0]
            rate[term, d] = (t + 1) / (t + c + 2)
            model.unseen[term, d] = odds(rate[term, d])
    for term, d, variant, t, c in variants:
        model.by_variant[term, variant] = odds((t + 2 * rate[term, d]) / (t + c + 2))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    reader = Reader(model)
    for batch in batches:
        scores, hits, inside = [], [], []
        for text in batch.column("text").to_pylist():
            n, found = reader.windows(text or "")
            z = float(np.dot(text_features(model, n, found), model.text_weights))
            scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
            hits.append(len(found))
            inside.append(sum(h[1] for h in found))
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), pa.array(inside, pa.int64())], [*batch.schema.names[1:], "score", "n_hits", "n_quoted"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, score (0 to 1), n_hits (words that match a term) and n_quoted (those in quotation marks) of every row of ``docs``.

    A null text is empty; an empty text, or one without a hit, gets the score of
    texts without hits. Repeated rows and null ids are rows of their own. Other
    columns are not read, whatever their names. An empty table gives no rows.
    A text is held whole in its task.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("key"))
    return rows.mapInArrow(lambda b: _scored(b, model), f"key {kind}, score double, n_hits long, n_quoted long").withColumnRenamed("key", doc_id)


def held_out(doc_id):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op12_toxic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c) for t, c in (("documents", ("doc_id", "text")), ("labels", ("doc_id", "toxic"))))
    model = fit(docs, labels, lambda i: ~held_out(i))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits", "n_quoted"
    )


QUERIES = {"op12_toxic_terms": op12_toxic_terms}
SQL: dict[str, str] = {}
