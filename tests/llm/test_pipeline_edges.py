"""The pipeline's stages on hard tables, and on a small one against a plain version."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=80):
    return " ".join(f"w{k}x{i * 7 % 53}y{i}" for i in range(n)) + "."


def hard(spark):
    rows = [(i, prose(i), "en", f"s{i % 3}", 10) for i in range(12)]
    rows += [(20, prose(3), "en", "s0", 10), (21, prose(3), None, None, None), (3, prose(3), "en", "s0", 10)]  # copies, one with a used id
    rows += [(None, prose(30), "en", "s1", 1), (None, None, None, None, None), (40, None, "en", "s1", 0), (41, "", "en", "s1", 0), (42, " \n ", "en", "s1", 3)]
    rows += [(50, prose(50, 40_000), "en", "s2", 1)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_takes_nulls_empty_tables_and_clashing_names(spark, name, stage):
    docs = hard(spark)
    extra = docs.withColumns({c: F.lit(7) for c in ("n_tokens", "ids", "decoded", "kept", "component_id", "host", "rank", "block", "weight", "words", "row", "key")})
    for given in (docs, docs.where("text IS NULL"), docs.limit(0), docs.where("doc_id IS NULL"), extra):
        out = stage(spark, given, "")
        rows = out.count()
        assert rows <= given.count() or name == "source mixing"
        if name != cp.STAGES[-1][0]:
            assert set(COLUMNS.replace(" long", "").replace(" string", "").split(", ")) <= set(out.columns)
    if name == "piece encoding":
        assert stage(spark, docs, "").count() == docs.count()


def test_first_two_stages_keep_what_a_plain_reading_keeps(spark):
    docs = hard(spark)
    good = cp.quality_rules(spark, docs, "")
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"][:20]) for r in good.collect())
    assert not [k for k in kept if not k[2].strip()] and (True, 0, prose(0)[:20]) in kept  # short ones go, clean ones stay
    first = cp.near_duplicates(spark, good, "")
    texts = {}
    for r in first.collect():
        texts.setdefault(r["text"], set()).add(r["doc_id"])
    assert set(texts) == {r["text"] for r in good.collect()} and all(len(ids) == 1 for ids in texts.values())
    assert texts[prose(3)] == {3} and first.where("doc_id = 3").count() == 2 and first.where("doc_id IS NULL").count() == 1  # rows of one id stay together
