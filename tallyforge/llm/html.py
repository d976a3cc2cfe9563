"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: elements by their path of tags and classes, and text blocks with the path they are in.
Two tokens of a host are equivalent if their occurrence vectors over the host's pages (how often in which page) are
equal; vectors are compared by sums of hashes, so a token costs one aggregation. The class of tokens that occur exactly
once in every page is the root of the host's template. Other classes are valid if they are in at least ``MIN_SHARE`` of
the pages, and nest: the elements around a class must be of one other class, which is its parent. What is not template
are slots.

The main slot is an element of the root class: the deepest one that can hold blocks and holds ``MAIN_SHARE`` of the text
of the host's slots, links aside. A path counts as slot if any of its texts is none of the template, so that paragraphs
which copies of one article share still count where the copies differ in one of them; if no text differs, all count.
Below <article> or <main> no deeper element is looked for. All text in the main slot is extracted, however often the host
repeats it, without elements that are marked as menus, sidebars, notices, adverts, forms or comments; of a main slot
without <h1> the one before it is the title.

Names decide only where no such element exists (``by`` says which did): then <article> or <main> of the page, else the
slots of the template's classes. For these the template is walked from its root: a class counts in a page if its parent
does, and its texts as far as they are inside of it and follow each other as they do on average. A class whose texts are
more than ``COPIES`` of the text of its pages is none of the template, and a repeated text between slots stays if its
path holds slots too. A page is never left without text by that.

White space in a block becomes one space, blocks are joined in order by a line end, a <br> ends a block. Markup that
never ends is text. Below ``DEPTH`` nested elements more of them aren't told apart, as in browsers.

Nulls and edge cases: null html is empty, its text too; a null or odd url has the host ''; a host of one page has the
elements that occur once as its root class; repeated rows are pages each; an empty table gives no rows; other columns are
ignored. Pages are parsed in linear time where they are read; a popular host's tokens are summed before the shuffle and no
group of pages is ever gathered. A host's classes have at most 1 / ``MIN_SHARE`` times the tokens of its average page.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table, tidy, work_dir, written

MIN_SHARE, MAIN_SHARE, COPIES, DEPTH = 0.5, 0.7, 0.5, 512

_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|([^\s=\"'/]++)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDES = re.compile(r"display\s*:\s*none")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.IGNORECASE) for x in "script style textarea title xmp iframe noembed noframes".split()}
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_HOLDERS = frozenset("article main div section td center".split())
_CLOSES_P = _BLOCK - {"br", "option", "body", "html", "caption"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NEVER = frozenset("head script style title noscript template iframe svg math canvas object nav footer aside form button select textarea input label fieldset dialog menu noembed noframes xmp audio video".split())
# A class or id names what is left out if it has a word of the first list and no word that is in neither.
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar side aside ad ads adv advert adverts advertisement advertising advertorial adsense"
    " sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager search form skip hidden".split()
)
_FILLERS = frozenset(
    "list lists link links box bar button buttons container wrapper wrap inner outer section area block panel item items top bottom left right unit slot zone row column col group body text author"
    " meta date content title heading thread post posts article articles story stories entry entries icon icons site page global main primary secondary mobile desktop sticky fixed field input".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CONTENT = frozenset("article main body html".split())
#: How far an element is left out: not, unless the main slot is around it, always.
SHOWN, HEADER, APART = 0, 1, 2


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): entities.unescape(m[2].strip("\"'")) if m[2] else "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _named(value: str, inside_main: bool) -> bool:
    """Whether a class or id attribute names a part of the page that holds no main text."""
    for name in value.split():
        words = {x.lower() for x in _NAME.findall(name)}
        telling = words & _NAMES
        if telling - {"header", "masthead"} if inside_main else telling:
            if all(w in _NAMES or w in _FILLERS or w.isdigit() for w in words):
                return True
    return False


def _apart(tag: str, attributes: dict[str, str], inside_main: bool) -> int:
    """SHOWN, HEADER or APART."""
    if tag in _NEVER:
        return APART
    if tag == "header":
        return SHOWN if inside_main else HEADER
    if not attributes or tag in _CONTENT and tag != "article":
        return SHOWN
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDES.search(attributes.get("style", "")):
        return APART
    named = any(_named(attributes.get(key, ""), inside_main) for key in ("class", "id"))
    return APART if named or attributes.get("role") in _ROLES else SHOWN


def _hash(up: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d|" % up + text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Element(NamedTuple):
    tag: str
    code: int  # hash of its path
    apart: int
    region: str  # article or main, of the elements around it or itself
    link: bool
    heading: bool


class Block(NamedTuple):
    text: str
    code: int  # hash of path and text
    region: str
    apart: int
    chars: int  # outside of links
    heading: bool
    around: tuple[int, ...]  # elements, the innermost last


_TOP = Element("", 0, SHOWN, "", False, False)


class Page:
    """blocks in order; tags: for the hash of each path its parent's, its depth, how often it occurs, and its form.

    The form is 2 for <article> and <main>, 1 for other elements that may be the main slot, else 0.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.tags: dict[int, list[int]] = {}
        self._stack: list[Element] = []
        self._text: list[list[tuple[str, bool]]] = [[], [], []]  # of the block, apart by how far it is left out
        self._unended: set[str] = set()
        at, n = 0, len(source)
        while at < n:
            mark = source.find("<", at)
            if mark < 0:
                mark = n
            if mark > at:
                self._add(source[at:mark])
            if mark == n:
                break
            at = self._markup(source, mark, n)
        self._flush()

    def _find(self, source: str, what: str, at: int) -> int:
        """As str.find; what isn't there is never looked for again."""
        if what in self._unended:
            return -1
        found = source.find(what, at)
        if found < 0:
            self._unended.add(what)
        return found

    def _markup(self, source: str, at: int, n: int) -> int:
        """Handles the markup that begins at a <, and gives the place behind it."""
        if source.startswith("<!--", at):
            end = self._find(source, "-->", at + 4)
            return n if end < 0 else end + 3
        if source.startswith(("<!", "<?"), at):
            end = self._find(source, ">", at)
            if end >= 0:
                return end + 1
        elif (m := _TAG.match(source, at + 1)) and self._find(source, ">", m.end()) >= 0:
            start = end = m.end()
            while True:
                end = _PLAIN.match(source, end).end()
                if end == n or source[end] == ">":
                    break
                quote = self._find(source, source[end], end + 1)
                if quote < 0:
                    end = n
                    break
                end = quote + 1
            if end == n:  # a quote that isn't closed ends with the tag
                end = self._find(source, ">", start)
            if end >= 0:
                return self._tag(source, m[1].lower(), source[at + 1] == "/", source[start:end], end + 1, n)
        self._add("<")
        return at + 1

    def _tag(self, source: str, tag: str, ends: bool, rest: str, at: int, n: int) -> int:
        if ends:
            self._close(tag)
            return at
        self._open(tag, _attributes(rest), rest.rstrip().endswith("/"))
        if tag in _RAW:
            end = _RAW[tag].search(source, at) if f"</{tag}" not in self._unended else None
            if not end:
                self._unended.add(f"</{tag}")
            close = self._find(source, ">", end.end()) if end else -1
            self._close(tag)
            return n if close < 0 else close + 1
        return at

    def _add(self, text: str) -> None:
        top = self._stack[-1] if self._stack else _TOP
        self._text[top.apart].append((text, top.link))

    def _flush(self) -> None:
        if not any(self._text):
            return
        for apart, parts in enumerate(self._text):
            text = " ".join(entities.unescape("".join(x for x, _ in parts)).split()) if parts else ""
            if text:
                around = self._stack[: next((k for k in range(len(self._stack), 0, -1) if self._stack[k - 1].apart <= apart), 0)]
                top = around[-1] if around else _TOP
                linked = len(" ".join("".join(x for x, link in parts if link).split()))
                self.blocks.append(Block(text, _hash(top.code, text), top.region, apart, max(0, len(text) - linked), top.heading, tuple(x.code for x in around)))
        self._text = [[], [], []]

    def _pop_to(self, k: int) -> None:
        if any(x.tag in _BLOCK for x in self._stack[k:]):
            self._flush()
        del self._stack[k:]

    def _open(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag in _BLOCK:
            self._flush()
        if tag in _CLOSES_P:
            for k in range(len(self._stack) - 1, -1, -1):
                if self._stack[k].tag == "p":
                    self._pop_to(k)
                    break
                if self._stack[k].tag in _BLOCK:
                    break
        if tag in _IMPLIED:
            ends, scope = _IMPLIED[tag]
            for k in range(len(self._stack) - 1, -1, -1):
                if self._stack[k].tag in scope:
                    break
                if self._stack[k].tag in ends:
                    self._pop_to(k)
                    break
        if tag in _VOID or len(self._stack) >= DEPTH:
            return
        top = self._stack[-1] if self._stack else _TOP
        code = _hash(top.code, f"{tag}.{' '.join(sorted(attributes.get('class', '').split()))}")
        out = max(top.apart, _apart(tag, attributes, bool(top.region)))
        region = top.region
        if not out:
            if tag == "article":
                region = "article"
            elif not region and (tag == "main" or attributes.get("role") == "main"):
                region = "main"
        form = 0 if out else 2 if region and region != top.region else int(tag in _HOLDERS)
        seen = self.tags.setdefault(code, [top.code, len(self._stack), 0, form])
        seen[2] += 1
        seen[3] = min(seen[3], form)
        if not closed or tag in _BLOCK:
            self._stack.append(Element(tag, code, out, region, top.link or tag == "a", top.heading or tag == "h1"))

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k].tag == tag:
                self._pop_to(k)
                return


def host_of(url: Column) -> Column:
    """The host of a url in lower case, '' for none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


#: Kinds of tokens: the page itself, elements (up: parent), texts (up: element), text below an element (up: its path).
PAGE, ELEMENT, TEXT, BELOW = range(4)
_TOKENS = "key long, host string, kind long, token long, up long, n long, chars long, total long, place long, form long"


def _tokens_of(page: Page) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(kind, token, up, n, chars, place, form) of a page; place is the depth of an element, the number of a text."""
    shown = [b for b in page.blocks if b.apart != APART]
    texts, below = {}, Counter()
    for k, b in enumerate(shown):
        leaf = b.around[-1] if b.around else 0
        x = texts.setdefault(b.code, [leaf, 0, 0, k])
        x[1] += 1
        x[2] += b.chars
        for e in {0, *b.around}:
            below[e, leaf] += b.chars
    yield PAGE, 0, 0, 1, sum(b.chars for b in shown), 0, 0
    for code, (up, depth, n, form) in page.tags.items():
        yield ELEMENT, code, up, n, 0, depth, form
    for code, (leaf, n, chars, place) in texts.items():
        yield TEXT, code, leaf, n, chars, place, 0
    for (e, leaf), chars in below.items():
        yield BELOW, e, leaf, 1, chars, 0, 0


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html, key -> the tokens of each page."""
    names = [x.split()[0] for x in _TOKENS.split(", ")]
    kinds = [pa.string() if x == "host" else pa.int64() for x in names]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for host, source, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = None
            for kind, token, up, n, chars, place, form in _tokens_of(Page(source or "")):
                total = chars if total is None else total
                for column, value in zip(out, (key, host, kind, token, up, n, chars, total, place, form), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, classes) of pages (host, key, html): the hash of the main slot, and without it the template's classes.

    A class has its id, its parent's (null: the root), its texts in order and the elements they must be in (null: the root).
    """
    mark = F.xxhash64("key", "n")
    tokens = pages.select("host", "html", "key").mapInArrow(tidy(_tokens), _TOKENS).groupBy("host", "kind", "token", "up").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v1"),
        F.sum(F.shiftrightunsigned(mark, 32)).alias("v2"),
        F.sum("chars").alias("chars"),
        F.sum("total").alias("total"),
        F.sum("place").alias("place"),
        F.min("form").alias("form"),
    )
    # Texts of a single page are of no template; they are most of all tokens.
    tokens = written(tokens.where(f"kind <> {TEXT} or pages > 1 and least = most"), work_dir(pages.sparkSession), "tokens")
    roots = tokens.where(f"kind = {PAGE}").select("host", F.col("pages").alias("all"), F.col("v1").alias("r1"), F.col("v2").alias("r2"), F.col("total").alias("host_total"))
    own = tokens.where(f"kind <> {PAGE}").join(roots, "host")
    full = (F.col("v1") == F.col("r1")) & (F.col("v2") == F.col("r2"))
    often = (F.col("pages") >= MIN_SHARE * F.col("all")) & (F.col("least") == F.col("most"))
    # The text of the slots below each element of the root class.
    fixed = own.where(f"kind = {TEXT}").where(often).groupBy("host", "up").agg(F.sum("chars").alias("fixed"))
    paths = own.where(f"kind = {BELOW} and token <> 0").groupBy("host", "token", "up").agg(F.sum("chars").alias("chars")).join(fixed, ["host", "up"], "left")
    leaves = own.where(f"kind = {BELOW} and token = 0").join(fixed, ["host", "up"], "left").where("chars > coalesce(fixed, 0)").select("host", "up", F.lit(True).alias("slot"))
    paths = paths.drop("fixed").join(leaves, ["host", "up"], "left")
    below = paths.groupBy("host", "token").agg(F.sum("chars").alias("every"), F.sum(F.expr("if(slot, chars, 0)")).alias("slots"))
    whole = own.where(f"kind = {BELOW} and token = 0").join(leaves, ["host", "up"], "left").groupBy("host").agg(F.sum("chars").alias("all_every"), F.sum(F.expr("if(slot, chars, 0)")).alias("all_slots"))
    can = own.where(f"kind = {ELEMENT} and form > 0").where(full).select("host", "token", "form", F.expr("place / pages").alias("depth"))
    holds = can.join(below, ["host", "token"]).join(whole, "host")
    enough = F.expr(f"if(all_slots > 0, slots >= {MAIN_SHARE} * all_slots, all_every > 0 and every >= {MAIN_SHARE} * all_every)")
    main = holds.where(enough).groupBy("host").agg(F.max_by("token", F.struct(F.col("form") == 2, "depth", "token")).alias("main"))
    main = written(main, work_dir(pages.sparkSession), "main")
    # The other hosts' classes, nested by the elements around them.
    left = own.where(f"kind in ({ELEMENT}, {TEXT}) and pages > 1").where(often).join(main, "host", "left_anti").withColumn("own", F.when(full, F.lit(None)).otherwise(F.struct("v1", "v2")))
    around = left.where(f"kind = {ELEMENT}").select("host", F.col("token").alias("up"), F.struct("own").alias("outer"))
    inner = left.join(around, ["host", "up"], "left").withColumn("outer", F.when(F.col("up") == 0, F.struct(F.lit(None).cast("struct<v1: bigint, v2: bigint>").alias("own"))).otherwise(F.col("outer")))
    nested = inner.groupBy("host", "own", "host_total").agg(
        F.max("total").alias("total"),
        F.sum("chars").alias("chars"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == TEXT, F.struct("place", "token")))).alias("texts"),
        F.collect_list(F.when(F.col("kind") == ELEMENT, F.col("token"))).alias("inside"),
        # The classes around: another one, or none that is of the template.
        F.collect_set(F.when((F.col("kind") == ELEMENT) & F.col("outer").isNotNull() & ~F.col("outer.own").eqNullSafe(F.col("own")), F.col("outer"))).alias("outer"),
        F.bool_or((F.col("kind") == ELEMENT) & F.col("outer").isNull()).alias("loose"),
    )
    root = F.col("own").isNull()
    valid = nested.where(root | (F.size("inside") > 0) & (F.size("outer") == 1) & ~F.col("loose")).where(F.col("chars") <= COPIES * F.col("total"))
    one = F.struct(
        F.col("own.v1").alias("id"), F.get("outer", F.lit(0))["own"]["v1"].alias("parent"), F.transform("texts", lambda t: t["token"]).alias("texts"), F.when(~root, F.col("inside")).alias("inside")
    )
    classes = valid.groupBy("host", "host_total").agg(F.collect_list(one).alias("classes"), F.sum("chars").alias("chars")).where(F.col("chars") <= COPIES * F.col("host_total"))
    return main.join(classes.select("host", "classes"), "host", "full").select("host", "main", "classes")


def _in_order(ranks: list[int]) -> set[int]:
    """Members of a longest rising subsequence of distinct numbers."""
    tops: list[int] = []
    before: dict[int, int | None] = {}
    for r in ranks:
        k = bisect.bisect_left(tops, r)
        before[r] = tops[k - 1] if k else None
        tops[k : k + 1] = [r]
    out, r = set(), tops[-1] if tops else None
    while r is not None:
        out.add(r)
        r = before[r]
    return out


def _template(blocks: list[Block], classes: list[dict]) -> set[int]:
    """Places of the blocks that belong to the host's template, walked from its root."""
    out: set[int] = set()
    inside_of, seen, going = {}, set(), [c for c in classes if c["id"] is None]
    by_parent: dict[int | None, list[dict]] = {}
    for c in classes:
        if c["id"] is not None:
            by_parent.setdefault(c["parent"], []).append(c)
    present = {e for b in blocks for e in b.around}
    if not going:
        going = [{"id": None, "texts": [], "inside": None}]
    while going:
        one = going.pop()
        if one["id"] in seen:
            continue
        seen.add(one["id"])
        inside_of[one["id"]] = None if one["inside"] is None else set(one["inside"]) & present
        inside = inside_of[one["id"]]
        if inside is not None and not inside:
            continue
        ranks = {t: k for k, t in enumerate(one["texts"])}
        nested = [i for i, b in enumerate(blocks) if b.code in ranks and (inside is None or not inside.isdisjoint(b.around))]
        ordered = _in_order(list(dict.fromkeys(ranks[blocks[i].code] for i in nested)))
        out |= {i for i in nested if ranks[blocks[i].code] in ordered}
        going += by_parent.get(one["id"], [])
    slots = [i for i in range(len(blocks)) if i not in out]
    if slots:
        paths = {blocks[i].around for i in slots}
        out -= {i for i in out if slots[0] < i < slots[-1] and blocks[i].around in paths}
    return out


def extract(page: Page, main: int | None = None, classes: list[dict] | None = None) -> tuple[str, str]:
    """(main text, what decided: template, names, classes or page) of one page under its host's template."""
    if main is not None and main in page.tags:
        inside = [i for i, b in enumerate(page.blocks) if main in b.around]
        shown = [page.blocks[i] for i in inside if page.blocks[i].apart != APART]
        if inside and not any(b.heading for b in shown):
            shown = [b for b in page.blocks[: inside[0]] if b.heading and not b.apart][-1:] + shown
        return "\n".join(b.text for b in shown), "template"
    blocks = [b for b in page.blocks if not b.apart]
    for region in ("article", "main"):
        if any(b.region == region for b in blocks):
            return "\n".join(b.text for b in blocks if b.region == region), "names"
    left_out = _template(blocks, classes or [])
    slots = [b for i, b in enumerate(blocks) if i not in left_out]
    return "\n".join(b.text for b in slots or blocks), "classes" if classes else "page"


_EXTRACTED = "page_id long, url string, text string, n_chars long, by string"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, sources, mains, classes = (c.to_pylist() for c in batch.columns)
        found = [extract(Page(s or ""), m, c) for s, m, c in zip(sources, mains, classes, strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([b for _, b in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "by"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and by (what decided) of each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    keyed = rows.select("host", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    # Written first, so that the planner knows its size: broadcast below the session's threshold, else a merge join.
    found = written(templates(keyed), work_dir(pages.sparkSession), "templates")
    return rows.join(found, "host", "left").select("page_id", "url", "html", "main", "classes").mapInArrow(tidy(_extracted), _EXTRACTED)


def query(spark, sf_dir):
    """op2: the main text of all pages."""
    return extracted(table(spark, sf_dir, "pages"))
