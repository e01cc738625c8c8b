"""Rules of the pipeline's first stage."""

from pixelweave.llm import host_quality


def test_crowds_of_symbols_go(spark):
    rows = [(1, " ".join(f"word{i}" for i in range(60)), "a"), (2, " ".join(f"word{i}%%%" for i in range(60)), "a"), (3, " ".join(f"word{i}" for i in range(60)) + " 5% & #1", "a")]
    kept = host_quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_hosts_move_the_limit_of_symbols(spark):
    plain, dirty, edge = (" ".join(f"word{i}{s if i % 8 == 0 else ''}" for i in range(80)) for s in ("", "%%%%%%", "%%%%"))
    rows = [(h * 100 + i, dirty if h == 0 and i % 3 == 0 else plain, f"h{h}") for h in range(6) for i in range(60)]
    # the same text in a host that often fails and in one that never does; a host of one failing page is not condemned by it
    rows += [(900, edge, "h0"), (901, edge, "h1"), (902, dirty, "tiny"), (903, edge, "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r.doc_id: r for r in host_quality.quality_table(frame).collect()}
    assert 5 < 100 * by[900].n_symbols / by[900].word_chars < 10
    assert not by[900].kept and by[901].kept and by[1].kept and by[900].symbol_percent < 10 < by[901].symbol_percent
    assert by[0].host_ok and by[902].host_ok
    kept = host_quality.keep_good(frame)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in by.items() if r.kept) and kept.columns == frame.columns
