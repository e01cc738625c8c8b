"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by path (tag, class and id from the
body down, as a hash). For each branch of the merged tree:

* content importance: what the branch says on each page, as one feature; one minus the
  entropy of the features over the pages, in units of the log of the page count. A
  branch that says the same on all pages is a template, one that differs informs;
* presentation importance: the entropy of its child sequences;
* information: content importance times characters. A container whose information is a
  small part of what its largest sibling container carries is beside the main text;
* evidence: an element like ``nav`` or a class like ``sidebar`` raises the bar that the
  importance must pass, standing inside an article lowers it.

Branches under their bar are cut from every page of the host. Pages of a host with the
same whole content count once. Importance is shrunk, by how many pages a host has of a branch,
towards that of its path on all hosts, and this towards what the evidence says (1, or 0 where
a name speaks against it): a host of one page is judged by the tree that others have grown. Forms, scripts, styles and reader comments go whatever their importance, as what
differs from page to page and still isn't the article can't be told by entropy.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged

#: Pages that what is known of a branch elsewhere weighs like: its path on all hosts, and before that its evidence.
PRIOR_PAGES = 2.0
#: The bar for the importance of branches: without evidence, inside an article, and for those whose element or name says that they are no main text.
BAR, BAR_INSIDE, BAR_NAMED = 0.24, 0.05, 0.7
#: Weight of the presentation in the importance of a branch.
PRESENTATION = 0.1
#: Style counts that a task gathers before it hands them on.
_FLUSH = 100_000

#: Fixed lists of HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("script style noscript template svg math iframe object embed canvas audio video select option optgroup button input textarea form fieldset datalist dialog head title".split())
BESIDE = frozenset("nav footer aside menu header".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("div section nav aside header footer menu article main center td body".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start of the first closes an open one of the second, unless one of the third stands between.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"),
    "thead": ("tr td th tbody thead", "table"), "tbody": ("tr td th tbody thead", "table"), "option": ("option", "select"), "body": ("head", ""),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Parts of class and id names of reader comments and of what isn't shown.
NEVER = frozenset("comment comments commentlist reply replies respond disqus hidden".split())
#: Parts of class and id names that are evidence of no main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup discussion social share sharing "
    "related recommended widget toolbar login search pagination pager skip copyright legal disclaimer form".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


#: An article's own head holds its title.
NAMES_INSIDE = NAMES - {"header", "masthead"}


def _named(attributes: str, names: frozenset[str]) -> tuple[str, bool, bool]:
    """Class and id for the path (numbers as one), whether they are evidence of no main text, and whether they are reader comments or hidden."""
    shown, beside, never = "", False, False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            parts = _PART.findall(value)
            beside |= any(p in names for p in parts)
            never |= any(p in NEVER for p in parts)
            shown += ("." if key == "class" else "#") + _DIGITS.sub("0", ".".join(value.split()))
        elif key == "role":
            beside |= value in _ROLES
        elif key == "style":
            never |= "display:none" in value.replace(" ", "")
        else:
            never |= key == "hidden" or value == "true"
    return shown, beside, never


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


class _Open:
    """An open element: its branch, and what it has said so far."""

    __slots__ = ("tag", "path", "off", "content", "said", "chars", "kids", "whole")

    def __init__(self, tag: str, path: int, off: bool, content: bool, whole: bool):
        self.tag, self.path, self.off, self.content, self.whole = tag, path, off, content, whole
        self.said, self.chars, self.kids = 0, 0, 0


#: Flags of a branch: evidence of no main text, inside an article, a container, an article itself or around one.
NAMED, INSIDE, CONTAINER, HOLDS = 1, 2, 4, 8


class Page:
    """Text blocks of a page in order, and its branches.

    blocks: (path, text, inside an article); parents: path to (path above, flags);
    spoken: path to (digest of what it says, characters, digest of its child sequences).
    Paths are hashes of the path above and of the element with its class and id, so the
    page takes memory by its length, however deep it is.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, bool]] = []
        self.parents: dict[int, tuple[int, int]] = {}
        self.spoken: dict[int, tuple[int, int, int]] = {}
        self.has_content = False
        self._stack = [_Open("", 0, False, False, True)]
        self._text: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            block = self._block
            text = "".join(self._text)
            self._text = []
            if not block.off:
                if "&" in text:
                    text = html_entities.unescape(text)
                if text := " ".join(text.split()):
                    self.blocks.append((block.path, text, block.content))
                    self.has_content |= block.content
                    block.said = _mixed(block.said, _hash(text))
                    block.chars += len(text)

    def _close_to(self, depth: int) -> None:
        if any(x.whole for x in self._stack[depth:]):
            self._flush()
        while len(self._stack) > depth:
            x = self._stack.pop()
            if x.whole and x.chars:
                said, chars, kids = self.spoken.get(x.path, (0, 0, 0))
                self.spoken[x.path] = (_mixed(said, x.said), chars + x.chars, _mixed(kids, x.kids))
                above = next(y for y in reversed(self._stack) if y.whole)
                above.said, above.chars = _mixed(above.said, x.said), above.chars + x.chars
                if x.content and above.path and not above.content:
                    self._mark(above.path)

    def _mark(self, path: int) -> None:
        """All above an article hold it."""
        while path:
            up, flags = self.parents[path]
            if flags & HOLDS:
                return
            self.parents[path] = (up, flags | HOLDS)
            path = up

    def _start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i].tag == "p":
                    self._close_to(i)
                    break
                if self._stack[i].tag not in INLINE:
                    break
        if tag in CLOSES:
            these, walls = CLOSES[tag]
            while True:
                for i in range(len(self._stack) - 1, 0, -1):
                    name = self._stack[i].tag
                    if name in these:
                        self._close_to(i)
                        break
                    if name in walls:
                        i = 0
                        break
                else:
                    break
                if i == 0:
                    break
        if tag == "br":
            self._add(" ")
            return
        above = self._stack[-1]
        if tag in INLINE:
            off = above.off or bool(attributes and _named(attributes, NAMES)[2])
            if tag != "wbr":
                self._stack.append(_Open(tag, above.path, off, above.content, False))
            return
        self._flush()
        shown, beside, never = _named(attributes, NAMES_INSIDE if above.content else NAMES) if attributes else ("", False, False)
        path = _hash(f"{above.path}/{tag}{shown}")
        container = next(x for x in reversed(self._stack) if x.whole)
        container.kids = _mixed(container.kids, _hash(tag + shown))
        content = above.content or tag in CONTENT
        if path not in self.parents:
            named = (beside and tag not in ("html", "body", *CONTENT)) or (tag in BESIDE and not (tag == "header" and above.content))
            self.parents[path] = (above.path, NAMED * named | INSIDE * above.content | CONTAINER * (tag in CONTAINERS) | HOLDS * (tag in CONTENT and not above.content))
        if tag not in VOID:
            self._stack.append(_Open(tag, path, above.off or tag in NO_TEXT or (never and tag not in ("html", "body")), content, True))

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._add(" ")
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                self._close_to(i)
                return
            if tag in INLINE and self._stack[i].tag not in INLINE:
                return  # a stray end of an inline element doesn't close blocks

    def _add(self, text: str) -> None:
        if not self._text:
            self._block = next(x for x in reversed(self._stack) if x.whole)
        if self._stack[-1].off:
            return
        self._text.append(text)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                elif tag in RAW:
                    if end := re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at):
                        at = end.end()
                    else:
                        at = size
                else:
                    self._start(tag, m[3].strip())
        self._close_to(1)
        self._flush()


def _mixed(one: int, two: int) -> int:
    """A digest of a sequence: ``one`` of its beginning, with ``two`` at its end."""
    return (one * 0x9E3779B97F4A7C15 + two + 1) % ((1 << 63) - 25)


def whole(page: Page) -> int:
    """Digest of all text of a page, of its articles if it has some."""
    return _hash("\n".join(text for _, text, content in page.blocks if content or not page.has_content))


_FEATURES = "host string, whole long, path long, above long, flags int, said long, chars long, kids long"


def style_rows(pages: DataFrame, host: str, html: str) -> DataFrame:
    """What each branch says on each page, once for pages of a host with the same whole content in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FEATURES.split(", ")]

        def out(found: set) -> pa.RecordBatch:
            kinds = (pa.string(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        found: set = set()
        for batch in batches:
            hosts, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                if source := texts[i].as_py():
                    h, page = hosts[i].as_py(), Page(source)
                    key = whole(page)
                    found.update((h, key, path, *page.parents[path], *said) for path, said in page.spoken.items())
                if len(found) >= _FLUSH:
                    yield out(found)
                    found = set()
        if found:
            yield out(found)

    return pages.select(F.col(host), F.col(html)).mapInArrow(work, _FEATURES)


def style_tree(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(host, path, above, flags, pages, importance, share) of every branch of the merged trees.

    ``share`` is the information of a container as a part of that of its largest sibling
    container (1 for others, and for what stands beside text that isn't in a container).
    """
    rows = style_rows(pages, host, html).groupBy("host", "path", "said", "kids").agg(
        F.min("above").alias("above"), F.bit_or("flags").alias("flags"), F.count_distinct("whole").alias("n"), F.max("chars").alias("chars")
    )
    rows = staged(rows, "style")
    node = rows.groupBy("host", "path").agg(F.min("above").alias("above"), F.bit_or("flags").alias("flags"), F.sum("n").alias("pages"), F.sum(F.col("n") * F.col("chars")).alias("chars"))
    # entropies over the features that repeat
    m = F.greatest("pages", F.lit(2))
    tree = node
    for feature, name in (("said", "content"), ("kids", "look")):
        same = rows.groupBy("host", "path", feature).agg(F.sum("n").alias("n")).groupBy("host", "path").agg(F.sum(F.col("n") * F.ln("n")).alias(f"nln_{name}"))
        tree = tree.join(same, ["host", "path"])
    raw = F.when(F.col("pages") < 2, 1.0).otherwise(1 - F.col("nln_content") / F.col("pages") / F.ln(m))
    tree = _shrunk(tree.withColumn("content", raw))
    content = F.col("content")
    look = F.when(F.col("pages") < 2, 1.0).otherwise((F.ln("pages") - F.col("nln_look") / F.col("pages")) / F.ln(m))
    tree = tree.withColumn("importance", F.when(F.col("flags").bitwiseAND(CONTAINER) == 0, content).otherwise((1 - PRESENTATION) * content + PRESENTATION * content * look))
    container = F.col("flags").bitwiseAND(CONTAINER) > 0
    tree = tree.withColumn("info", content * F.col("chars"))
    largest = tree.groupBy("host", "above").agg(F.max(F.when(container, F.col("info"))).alias("most"), F.max("info").alias("most_any"))
    tree = tree.join(largest, ["host", "above"])
    share = F.when(container & (F.col("most") == F.col("most_any")) & (F.col("most") > 0), F.col("info") / F.col("most")).otherwise(1.0)
    return tree.select("host", "path", "above", "flags", "pages", "importance", share.alias("share"))


def _shrunk(tree: DataFrame) -> DataFrame:
    """``tree`` with ``content`` shrunk towards that of the path on all hosts, and this towards what the evidence says; one page alone tells nothing."""
    seen = F.col("pages") - 1
    evidence = F.when(F.col("flags").bitwiseAND(NAMED) > 0, 0.0).otherwise(1.0)
    paths = tree.groupBy("path").agg(((F.sum(seen * F.col("content")) + PRIOR_PAGES * F.avg(evidence)) / (F.sum(seen) + PRIOR_PAGES)).alias("of_path"))
    own = (seen * F.col("content") + PRIOR_PAGES * F.col("of_path")) / (seen + PRIOR_PAGES)
    return tree.join(paths, "path").withColumn("content", own).drop("of_path")


def main_text(page: Page, low: frozenset[int] = frozenset(), good: frozenset[int] = frozenset(), evidence: bool = True) -> str:
    """Blocks outside of the low branches. Branches that are neither low nor good are judged by ``evidence``: named ones go, and those beside an article."""
    verdicts: dict[int, bool] = {0: True}

    def stays(path: int) -> bool:
        todo = []
        while path not in verdicts:
            todo.append(path)
            path = page.parents[path][0]
        fine = verdicts[path]
        for p in reversed(todo):
            flags = page.parents[p][1]
            fine = fine and p not in low and (p in good or not evidence or not flags & NAMED or bool(flags & HOLDS))
            verdicts[p] = fine
        return fine

    kept = []
    for path, text, content in page.blocks:
        if stays(path) and (content or not evidence or not page.has_content or path in good):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", tree: bool = True, evidence: bool = True) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars.

    Blocks are joined by two line feeds; white space inside one is one space.
    Null html gives the empty text. A null url is a host of its own, ''. An empty
    table gives no rows; repeated rows are pages like others. ``tree`` and
    ``evidence`` switch one of the two off, to see what the other does.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    marks = _marks(style_tree(own, "host", "html"), evidence).where(F.lit(tree))
    # a host's list grows with its templates, not with its pages
    low = staged(marks.groupBy("host").agg(F.collect_set("low").alias("low"), F.collect_set("good").alias("good")), "low")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, hosts, sources, lows, goods = (batch.column(i) for i in range(6))
            known: dict[str, tuple[frozenset, frozenset]] = {}
            texts = []
            for i in range(batch.num_rows):
                source, h = sources[i].as_py(), hosts[i].as_py()
                if h not in known:
                    known[h] = frozenset(lows[i].as_py() or ()), frozenset(goods[i].as_py() or ())
                texts.append(main_text(Page(source), *known[h], evidence) if source else "")
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return own.join(low, "host", "left").select("page_id", "url", "host", "html", "low", "good").mapInArrow(work, kinds)


def _marks(tree: DataFrame, evidence: bool) -> DataFrame:
    """(host, low, good): branches with a known importance under their bar (topmost ones only), or above the one that their evidence sets."""

    def flag(f: int) -> Column:
        return F.col("flags").bitwiseAND(f) > 0

    known = tree
    holders = known.where(flag(HOLDS)).groupBy("host").agg(F.lit(True).alias("articles"))
    known = known.join(holders, "host", "left")
    beside = F.coalesce("articles", F.lit(False)) & ~flag(HOLDS) & ~flag(INSIDE)
    score = F.col("importance") * F.col("share")
    # what holds an article, or stands inside one without evidence against it, isn't judged by how much its siblings say
    bar = F.when(flag(HOLDS), 0.0)
    if evidence:
        bar = bar.when(flag(NAMED), BAR_NAMED)
    bar = bar.when(flag(INSIDE), BAR_INSIDE).otherwise(BAR)
    judged = F.when(flag(HOLDS) | (flag(INSIDE) & ~(flag(NAMED) if evidence else F.lit(False))), F.col("importance")).otherwise(score)
    verdict = staged(known.select("host", "path", "above", (judged < bar).alias("is_low"), (flag(NAMED) | beside).alias("doubted")), "verdicts")
    ups = verdict.where("is_low").select("host", F.col("path").alias("above"))
    low = verdict.where("is_low").join(ups, ["host", "above"], "left_anti").select("host", F.col("path").alias("low"), F.lit(None).cast("long").alias("good"))
    good = verdict.where("NOT is_low AND doubted").select("host", F.lit(None).cast("long").alias("low"), F.col("path").alias("good"))
    return low.unionByName(good)


def op7_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_site_style": op7_site_style}
SQL: dict[str, str] = {}
