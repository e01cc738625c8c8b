"""Context mixing against plain Python: followers, classes, escapes and the sum of a text's bits."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from pixelweave.llm import context_mixing as cm

RNG = np.random.default_rng(5)
VOCABULARY = [f"{a}{b}" for a in ("th", "er", "la", "den", "of") for b in ("", "on", "in", "s", "ly", "x")]
PASSAGE = " ".join(RNG.choice(VOCABULARY, 60))


def corpus():
    rows = [(i, " ".join(RNG.choice(VOCABULARY, RNG.integers(3, 90)))) for i in range(60)]
    rows += [(100 + i, f"{PASSAGE} {i}") for i in range(20)]
    return [*rows, (200, rows[0][1]), (201, None), (202, f"brandnew {PASSAGE} brandnew other brandnew")]


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def brute_states(rows):
    """What the last two words and the last one predict for each token, counting everything but the token itself."""
    events = []
    for i, text in rows:
        w = ["^", "^", *(text or "").split(), "\n"]
        events += [(i, (w[k - 2], w[k - 1]), (w[k - 1],), w[k]) for k in range(2, len(w))]
    seen = defaultdict(Counter)
    for i, two, one, w in events:
        if not held(i):
            seen[two][w] += 1
            seen[one][w] += 1
    out = []
    for i, two, one, w in events:
        found = []
        for context in (two, one):
            counts = seen[context].copy()
            if not held(i):
                counts[w] -= 1
            left = sum(counts.values())
            most = max(counts.values(), default=0)
            found.append((left, most, {x for x in counts if counts[x] == most} if left else set(), w))
        out.append((i, found))
    return out


def test_follower_states_against_plain_counts():
    rows = corpus()
    block = cm._Block()
    for _, text in rows:
        block.add(None if text is None else text.encode())
    row = {"words": list(block.known), "ids": cm.packed(np.concatenate(block.ids)), "lengths": [len(x) for x in block.ids], "held": [held(i) for i, _ in rows]}
    tokens = cm._Tokens(row)
    entries, times = tokens.entries(40 - cm.BEFORE_BITS // 2, np.zeros(0, np.uint64), 8)
    # the same entries as if from two blocks: counts are of both
    two, one = cm.follower_states(entries, times.astype(float))
    half = [times // 2, times - times // 2]
    again = cm.follower_states(np.concatenate([entries, entries]), np.concatenate(half).astype(float))
    assert (again[0][: len(two)] == two).all() and (again[1][: len(one)] == one).all()
    _, place = tokens.entries(40 - cm.BEFORE_BITS // 2, np.zeros(0, np.uint64), 8, inverse=True)
    for at, (_, found) in enumerate(brute_states(rows)):
        for state, (left, most, best, w) in zip((two[place[at]], one[place[at]] & 127), found, strict=True):
            assert (state > 0) == (left > 0)
            if state:
                hit = state % 2 == 0
                assert hit == (w in best) if len(best) == 1 else (not hit or w in best)
                assert state == cm._state(np.array([hit]), np.array([most]), np.array([left]))[0]


def test_a_frequent_last_word_is_split_by_the_word_before():
    tokens = cm._Tokens({"words": [b"a", b"b", b"c", b"\n"], "ids": cm.packed(np.array([1, 0, 2, 0, 1, 0, 3], np.uint32)), "lengths": [7], "held": [False]})
    plain, _ = tokens.entries(30, np.zeros(0, np.uint64), 8)
    split, _ = tokens.entries(30, np.array([cm.word_key(b"a")], np.uint64), 8)
    width = np.uint64(cm.BEFORE_BITS + cm.FOLLOWER_BITS + 1)
    assert len(np.unique(plain >> width)) == 4 and len(np.unique(split >> width)) == 5


def test_token_costs_against_plain_python():
    """Escapes, repeats and follower bits of one text, bit by bit."""
    words = [b"a", b"b", b"new", b"other", b"\n"]
    ids = np.array([0, 2, 1, 2, 3, 2, 3, 0, 4])
    tokens = cm._Tokens({"words": words, "ids": cm.packed(ids.astype(np.uint32)), "lengths": [len(ids)], "held": [True]})
    c, cost = np.array([5, 4, 0, 0, 9])[ids], np.array([-1.0, -1.5, -7.0, -8.0, -0.5])[ids]
    two, one = np.zeros(len(ids), np.uint8), np.zeros(len(ids), np.uint8)
    two[2], one[7], two[8] = cm._state(np.array([1]), np.array([3]), np.array([4]))[0], cm._state(np.array([0]), np.array([1]), np.array([5]))[0], cm._state(np.array([1]), np.array([9]), np.array([9]))[0]
    got = cm.token_costs(tokens, c, cost, two, one, 0.1)
    odds, want = cm._odds(), []
    weights, prior = cm.follow_mixer().w[0], lambda z: math.log10(0.5 * refined(z) + 0.5 / (1 + math.exp(-z)))

    def refined(z):
        """The map before it has seen anything: sigmoids at its steps, with lines between."""
        low = math.floor(z / cm.MAP_UNIT)
        part = z / cm.MAP_UNIT - low
        s = [1 / (1 + math.exp(-(low + k) * cm.MAP_UNIT)) for k in (0, 1)]
        return s[0] * (1 - part) + s[1] * part

    reached = unknown = repeats = 0
    spelled = []
    for k, i in enumerate(ids):
        bits = 0.0
        if two[k] or one[k]:
            state, right = (two[k], two[k] % 2 == 0) if two[k] else (one[k], one[k] % 2 == 0)
            sign = 1 if right else -1
            bits += prior(sign * (weights[0] * odds[state] + weights[2]))
            if right:
                want.append(bits)
                continue
        p = (unknown + cm.ESCAPE_WEIGHT * 0.1) / (reached + cm.ESCAPE_WEIGHT)
        if c[k]:
            bits += math.log10(1 - p) + cost[k]
        else:
            q = (repeats + 0.2) / (len(spelled) + repeats + 1) if spelled else 0.0
            if i in spelled:
                bits += math.log10(p) + math.log10(q) - math.log10(len(spelled))
                repeats += 1
            else:
                bits += math.log10(p) + math.log10(1 - q) + cost[k]
                spelled.append(i)
            unknown += 1
        reached += 1
        want.append(bits)
    assert np.allclose(got, want, atol=1e-6)


def test_blocks_shards_and_learning(spark, monkeypatch):
    """Small blocks and many shards change what is learned first, and little else; copies score apart; held-out texts gain."""
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r for r in cm.score_documents(frame).collect()}
    monkeypatch.setattr(cm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(cm, "WORD_ENTRIES", 40)
    monkeypatch.setattr(cm, "FOLLOWER_ENTRIES", 500)
    parts = {r.doc_id: r for r in cm.score_documents(frame).collect()}
    for i, r in whole.items():
        assert math.isclose(r.base_score, parts[i].base_score, rel_tol=1e-12) and abs(r.score - parts[i].score) < 0.25 * abs(r.score) + 2
    assert max(whole[100 + i].bits_per_byte for i in range(20)) < min(whole[i].bits_per_byte for i in range(1, 60) if whole[i].n_tokens > 30)
    some = [r for i, r in whole.items() if r.held_out]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)
