"""The style tree decides inside and beside articles."""

from pixelweave.llm import site_style

COLUMNS = "page_id long, url string, html string"


def test_importance_decides_inside_and_beside_an_article(spark):
    page = '<article><div>Same box on each page</div><p>Own words {0}</p></article><div class="bx">Own end {0}</div><div class="by">Same end</div>'
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(8)] + [(100 + i, "http://few/", page.format(i)) for i in range(2)]
    out = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(out[i] == f"Own words {i}\n\nOwn end {i}" for i in range(8))
    # two pages tell little of the box, and nothing against what differs
    assert out[100] == "Same box on each page\n\nOwn words 0\n\nOwn end 0"


def test_a_host_of_one_page_is_judged_by_the_tree_of_all_hosts(spark):
    page = '<div class="ta"><a>same links</a></div><div class="tb"><p>{0}</p></div><div class="tc">call us today</div>'
    words = lambda i: " ".join(f"v{(i * 17 + j * j) % 89}" for j in range(60))
    rows = [(10 * h + i, f"http://h{h}/{i}", page.format(words(10 * h + i))) for h in range(4) for i in range(6)] + [(900, "http://alone/", page.format(words(900)))]
    out = site(rows, spark, evidence=False)
    assert out == {i: words(i) for i in out} and len(out) == 25


def test_pages_without_any_other_to_learn_from_are_judged_by_names(spark):
    rows = [(1, "http://one/", '<nav>home two</nav><article><p>The words</p></article><div class="sidebar">else</div>')]
    assert site(rows, spark) == {1: "The words"}


def test_a_host_of_very_many_pages(spark):
    page = '<div class="ta">same links</div><article><p>words {0} of {0} own {0}</p></article>'
    rows = [(i, f"http://big/{i}", page.format(i)) for i in range(3000)]
    assert site(rows, spark) == {i: f"words {i} of {i} own {i}" for i in range(3000)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h/{i}", '<div class="x1">The same text</div><p>More of it</p>') for i in range(8)]
    out = site_style.extract(spark.createDataFrame(rows, COLUMNS)).collect()
    assert all(r.text == "The same text\n\nMore of it" for r in out)


def site(rows, spark, **switches):
    return {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, COLUMNS), **switches).collect()}


def test_the_tree_decides_without_the_evidence_of_names(spark):
    page = '<div class="qa"><a>home</a><a>two {0}</a></div><div class="qb"><p>{1}</p><p>{2}</p></div><div class="qc">Call {0}</div>'
    words = lambda i, k: " ".join(f"w{(i * 31 + k * 7 + j * j) % 97}" for j in range(40))
    rows = [(i, f"http://h/{i}", page.format(i, words(i, 1), words(i, 2))) for i in range(9)]
    want = {i: f"{words(i, 1)}\n\n{words(i, 2)}" for i in range(9)}
    assert site(rows, spark) == site(rows, spark, evidence=False) == want
    assert site(rows, spark, tree=False) != want


def test_a_name_around_the_main_text_does_not_cut_it(spark):
    page = '<div class="with-sidebar"><div class="text1"><p>{0}</p></div><div class="sidebar">one two {1}</div></div>'
    rows = [(i, f"http://h/{i}", page.format(" ".join(f"a{i}b{j}" for j in range(50)), i)) for i in range(9)]
    assert all(text.startswith(f"a{i}b0 ") and "one two" not in text for i, text in site(rows, spark).items())


def test_deep_pages_take_memory_by_their_length(spark):
    import tracemalloc

    source = "<div>x" * 100_000
    tracemalloc.start()
    page = site_style.Page(source)
    assert len(page.blocks) == 100_000 and tracemalloc.get_traced_memory()[1] < 200 * len(source)
    tracemalloc.stop()
    assert site_style.main_text(page).count("x") == 100_000


def test_very_long_page_and_repeated_rows(spark):
    long = "<article>" + "<p>words of a long page</p>" * 20_000 + "</article>"
    out = site_style.extract(spark.createDataFrame([(1, "u", long), (1, "u", long), (None, None, "<p>a")], COLUMNS)).collect()
    assert sorted(r.n_chars for r in out) == [1, 20_000 * 22 - 2, 20_000 * 22 - 2]
