"""Toxic terms: automata against the distance table, the lexicon from counts, windows, held-out accuracy and hard tables."""

import random

from pyspark.sql import functions as F

from pixelweave.llm import toxic_terms as tt


def distance(a, b):
    """Edit distance with swaps of neighbours, by the table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automata_agree_with_the_distance_table():
    rng = random.Random(2)
    spell = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    terms = [(spell(rng.randrange(3, 12)), rng.random() < 0.4) for _ in range(30)]
    terms = sorted(set(terms))
    lexicon, hits = tt.Lexicon(terms), 0
    words = [spell(rng.randrange(0, 14)) for _ in range(1500)]
    for term, _ in terms * 20:  # misspellings of terms
        w = list(term)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "dd"])
        words.append("".join(w))
    for word in words:
        want = {}
        for number, (term, stem) in enumerate(terms):
            least = min((distance(term, word[:k]) for k in range(len(word) + 1)), default=99) if stem else distance(term, word)
            if least <= tt.errors(term, stem):
                want[number] = least
        assert lexicon.find(word) == want, word
        hits += len(want)
    assert hits > 500


def test_lexicon_takes_stems_and_words_and_leaves_common_ones():
    texts = [(f"nice w{i}{w} {w} day here", 1) for i in range(10) for w in ("foolish", "fooling", "fooled", "foolery", "fools")] + [(f"y{i} zonk it", 1) for i in range(20)]
    texts += [(f"w{i} nice w{i} day w{i} here with w{i} food and w{i} zonking", 0) for i in range(400)] + [("a copied word many copies hold", 1)] * 60
    pairs = {(node, before, y) for text, y in texts for node, before in tt.beginnings(text)}
    counts = {y: tt.Counter(node for node, _, k in pairs if k == y) for y in (0, 1)}
    chosen = tt.choose_terms(counts[1], counts[0], 70, 400)
    assert ("fool", True) in chosen and ("zonk", False) in chosen and not any(t in ("nice", "day", "here", "foo", "copied", "cop") for t, _ in chosen)


def test_windows_tell_quotation_from_abuse():
    model = tt.Model(tt.Lexicon([("idiot", False), ("worthless", False)]))
    tt._rates(model, [(0, 0, "idiot", 40, 0), (1, 0, "worthless", 40, 0)], 0.1)
    reader = tt.Reader(model)
    score = lambda text: tt.text_features(model, *reader.windows(text))[1]
    assert reader.windows('He wrote "what an idiot he is", then left.')[1][0][1] == 1
    assert reader.windows('"Well," he said. You idiot, "go".')[1][0][1] == 0
    assert score('they call it "idiot" in the book') < score("they call it idiot in the book")
    assert score("you idiot, you worthless idiot!") > score("the idiot of the book")
    assert [h[2] for h in reader.hits("an iddiot, idoit id!ot WORTHLESSS wortles idiooooot")[1]] == [1, 1, 1, 0, 2, 1]
    assert not reader.hits("id it idle worth")[1]


def test_held_out_accuracy_and_no_label_leaks(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = tt.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = tt.fit(docs, labels, lambda i: ~tt.held_out(i))
    again = tt.fit(docs, flipped, lambda i: ~tt.held_out(i))
    assert model.by_term == again.by_term and (model.text_weights == again.text_weights).all()
    some = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(held)
    got = tt.score(some.drop("toxic"), model).join(labels, "doc_id").select(F.col("score") >= 0.3, F.col("toxic") == 1).collect()
    caught, wrong = sum(p and y for p, y in got), sum(p and not y for p, y in got)
    assert caught >= 0.9 * sum(y for _, y in got) and wrong <= 0.02 * sum(not y for _, y in got)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(i, f"all is well, you nice thing number n{i}", 0) for i in range(40)] + [(100 + i, f"you n{i} stupid thing n{i} stupid", 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t, 1.0, "a", 3) for i, t, _ in rows], "doc_id long, text string, score double, key string, n_hits int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    model = tt.fit(docs, labels, lambda i: F.lit(True))
    assert [t for t, _ in model.lexicon.terms] == ["stupid"]
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "so stupid"), (3, "x" * 500_000), (4, "fine words " * 50_000 + "stupid")], "doc_id long, text string")
    got = {(r["doc_id"], i): r for i, r in enumerate(sorted(tt.score(odd, model).collect(), key=lambda r: (r["doc_id"] or 0)))}
    scores = [r["score"] for r in got.values()]
    assert len(scores) == 6 and scores[0] == scores[1] == scores[2] == scores[4] and scores[3] > 0.3 > scores[0] and all(0 <= s <= 1 for s in scores)
    assert tt.score(docs.limit(0), model).count() == 0
    bare = tt.fit(docs.limit(0), labels.limit(0), lambda i: F.lit(True))
    assert not bare.lexicon.terms and all(r["score"] < 0.3 for r in tt.score(odd, bare).collect())
