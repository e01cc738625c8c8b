"""Repair of conversations: the search against all edit sequences, the query against its SQL, and hard tables."""

import hashlib
import itertools
import random

import duckdb

from pixelweave.llm import conversation_repair as cr


def by_trying(rows):
    """Cheapest (cost, audit) over every sequence of edits with at most two insertions between rows."""
    best = None
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):
        for marks in itertools.product("DKR", repeat=len(rows)):
            cost, audit, out = 2 * sum(gaps), "", []  # out: the initials a slot may have
            for k in range(len(rows) + 1):
                audit, out = audit + "I" * gaps[k], out + ["ua"] * gaps[k]
                if k < len(rows):
                    initial, gone, cut = rows[k]
                    audit += marks[k]
                    if marks[k] == "D":
                        cost += 3
                    elif gone:
                        break
                    else:
                        cost += (2 if marks[k] == "R" else 0) + cut
                        out.append("ua" if marks[k] == "R" else initial)
            else:
                body = out[1:] if out and out[0] == "s" else out
                if len(body) % 2 == 0 and (body or not out) and all("ua"[i % 2] in x for i, x in enumerate(body)):
                    best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def test_search_finds_the_cheapest_and_least_of_all_sequences():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.choice("suax-"), rng.random() < 0.2, False) for _ in range(rng.randrange(5))]
        rows = [(r, g, not g and rng.random() < 0.3) for r, g, _ in rows]
        assert cr.cheapest(rows) == by_trying(rows), rows


def test_long_conversations_take_linear_time():
    rng = random.Random(1)
    rows = [(rng.choice("sua"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(60_000)]
    cost, audit = cr.cheapest(rows)
    assert cost == cr.bounds(rows)[0] and len(audit) - audit.count("I") == len(rows)


def compared(spark, path, folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{path}'")
    cols = ["conv_id", *cr.FIGURES, "audit", "repaired_sha256"]
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({cr.SQL['op13_conversation_repair']})").fetchall()
    got = [tuple(r[c] for c in cols) for r in cr.op13_conversation_repair(spark, folder).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)
    return got


def test_query_equals_its_sql_on_the_given_table(spark):
    assert len(compared(spark, "", "/root/testdata/sf0.001")) > 0


def test_nulls_ties_repeats_and_odd_roles(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Hi.", "yes", "No!", "", " \t\n", None, "wait. ", "why?\n", "…", "so. x", " "]
    rows = [
        (rng.choice([None, 1, 2, 3, 4, 5, -6, 70]), rng.choice([None, None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts))
        for _ in range(160)
    ] + [(500 + i, i % 4, r, "Well.") for i, r in enumerate(["user", "assistant"] * 30)]
    schema = "conv_id long, turn long, role string, text string, audit string, conv string, n int"
    spark.createDataFrame([(*r, "x", "y", 3) for r in rows], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = compared(spark, "/*.parquet", str(tmp_path))
    assert {r[0] for r in got} == {r[0] for r in rows}
    dropped = [r for r in got if r[-1] == hashlib.sha256(b"").hexdigest() and not r[6] and not r[7]]
    assert dropped and all(r[1:7] == (0,) * 6 for r in dropped)


def test_empty_table_and_one_very_long_text(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cr.repair(spark.createDataFrame([], schema)).count() == 0
    text = "word " * 400_000 + "end."
    out = cr.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "ok.")], schema)).collect()
    assert out[0]["audit"] == "KK" and out[0]["repaired_sha256"] == hashlib.sha256(f"user:{text}\nassistant:ok.".encode()).hexdigest()
