"""Token alignment against both libraries on whole texts and a loop over all pairs."""

import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from pixelweave.llm import token_alignment as ta

A, B = ta.default_paths()
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_loops(texts):
    """The same rows by whole texts, byte ranges and all pairs."""
    a_lib, b_lib, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), ta.byte_alphabet()
    a_lib.encode_special_tokens = True
    docs = []
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            raw = (" " + text).encode()
            a = [(i, bytes(alphabet[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
            for i in b_lib.encode(text):
                p = b_lib.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        last = 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last < e <= c) for side in spans))
            last = c
        docs.append((len(a), len(b), groups, links))
    count = Counter(x for d in docs for x in d[3])
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [
        (na, nb, len(g), len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for na, nb, g, k in docs
    ]


TEXTS = [
    None, "", " ", "  ", "\n", "a", "word", " lead", "two  spaces   three ", "tab\t  then", "line\n next\n  two\r\n\r\n end\n", "ends ", "ends\n", "naïve façade – “quoted” 漢字かな 🙂🙂", "don't we'll I'M they've",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b and more", "\x00\x01 ctrl", "1234567 89,000.5", "nbsp  here  wide", "x" * 3000, "word word word", "word word word", "the end. The  End!", "​ zero ‍", "tail\t", "﻿bom",
]


def rows_of(out):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0), *[r[c] for c in COLUMNS]) for r in out.collect())


def test_alignment_is_that_of_all_pairs_whatever_the_blocks(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["ab", " ", "\n", "é", "the", " the", "  ", ".", "ing ", "\t", "7", "ß"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, block string, pairs string")
    want = sorted(((True, i), *row) for i, row in enumerate(by_loops(texts)))
    assert rows_of(ta.align(docs.repartition(3), A, B)) == want
    assert rows_of(ta.align(docs.repartition(2), A, B, block_chars=200)) == want


def test_alignment_of_repeated_rows_null_keys_and_empty_tables(spark):
    rows = [(None, "some text"), (4, "some text"), (4, "some text"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_loops([t for _, t in rows])
    assert rows_of(ta.align(docs, A, B)) == sorted(((k is not None, k or 0), *w) for (k, _), w in zip(rows, want, strict=True))
    assert ta.align(docs.limit(0), A, B).count() == 0


def test_a_piece_has_the_same_tokens_wherever_it_stands():
    tools = ta.load(A, B)
    text = "Many words,  some\n of them\tre-used; words some\n words " * 40
    a, b = tools.both(text)
    parts = [tools.both(p) for p in ta.pieces_of(text)]
    assert [i for p in parts for i in p[0]] == a and [i for p in parts for i in p[1]] == b


def test_a_very_long_text_without_spaces(spark):
    text = "abcé" * 100_000
    docs = spark.createDataFrame([(1, text), (2, "z " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ta.align(docs, A, B).collect()}
    a, b = ta.load(A, B).both(text)
    assert (got[1]["n_a"], got[1]["n_b"]) == (len(a), len(b)) and got[1]["n_links"] >= max(len(a), len(b)) and got[2]["n_a"] == len(ta.load(A, B).both("z " * 50_000)[0])
