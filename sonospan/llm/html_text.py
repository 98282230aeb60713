"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: opening tags with their place, and whole text
blocks with their place.

1. All different pages of a host count, however many: a page's tokens, as hashes,
   are folded by (host, page), then every token gets its occurrence vector over
   the host's pages (a hash of how often each page has it, and the number of
   pages) by an aggregate over (host, token).
2. Tokens that share an occurrence vector form an equivalence class.  Classes of
   two tokens or more that over half of the pages have are tested against every
   page: a class is valid when its tokens stand in one order on every page, as
   often as it occurs, and when it nests: all of an occurrence lies in one gap of
   each more frequent class.  The nested valid classes are the host's template.
3. Pages are read once more: text blocks of the template go, and what stands in
   its gaps are the slots.  A slot is article text unless its place says
   otherwise: menus, headers, footers, sidebars, notices, adverts, forms, comments
   and the like, and everything outside ``article`` or ``main`` where a page has
   one that holds as much text as its other slots.

A class or id marks a region only if all words of one of its names are words of
regions: ``site-footer`` is one, ``no-sidebar`` and ``related-work`` are none.  Where
regions that only such names mark hold all of a page's text, they mark nothing.

Inside articles a class is boilerplate only if it and the more frequent ones make
up less than half of the article blocks of the pages that have it: pages that
share more than that are copies of one article, and keep it.  A host with fewer
than ``LEAST_PAGES`` different pages has no template and is judged by places
alone.  Nothing depends on how rows are dealt to tasks.

What meets by host is a row a page at most, never its html, and hosts with more
than a thousandth of the pages are joined from a broadcast table of at most
1,000 rows; a table of all hosts is broadcast only while it is small.

Null and empty html has no text; a null url is a host of its own.  Repeated rows
give repeated rows and count once.  Malformed html never fails: unclosed tags end
with what holds them, an unfinished tag or comment ends the page, and after a tag
whose quotes never end, tags end at their first ``>``.  Very long pages are
parsed in one pass.  Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.llm.common import row_count, written
from sonospan.llm.rule_stats import mixed

LEAST_PAGES = 3
#: Hosts with more than this share of all pages are joined apart.
HOT_SHARE = 1000
#: A table of hosts of up to so many bytes is broadcast whole.
BROADCAST_BYTES = 32 << 20
#: Pages that a task remembers to have written.
PAGES_HELD = 500_000

MARKUP = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
#: The same where a quote has been left open.
LOOSE_MARKUP = re.compile(r"<!--(?s:.*?)(?:-->|\Z)|<!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# HTML element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
#: Elements whose end tags are often left out; they never hold a region.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption html body h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav header footer aside form button select dialog menu object canvas audio video map fieldset head".split())
#: Regions that an article is never part of; others end where an article begins, as their own end was left out.
HOLDING = frozenset("aside comments".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager copyright skip".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond discussion".split())


#: Words that say nothing of their own in the name of a region.
PLAIN_NAMES = frozenset(
    "area bar block blocks body bottom box btn button buttons col column container content entries entry fixed form global group head holder icon icons inline inner item items js left level like likes link links list lists main "
    "mobile module more outer page pages panel post posts primary region right row secondary section site slot small sticky stories story tag tags text title top unit units user view wrap wrapper zone articles".split()
)
#: Inline elements are left out only by names that no word of a sentence has.
INLINE_NAMES = frozenset("ad ads adv advert adverts advertisement sponsored share sharing social newsletter subscribe cookie popup modal breadcrumb breadcrumbs pagination pager".split())


@dataclass
class Block:
    """A run of text between block boundaries, with its place."""

    place: tuple[str, ...]
    inside: bool
    outside: bool
    in_form: bool
    #: left out by names alone
    named: bool = False
    parts: list[str] = field(default_factory=list)
    text: str = ""
    token: int = 0


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)
    #: 0: tag, 1: text, 2: text of an article
    kinds: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def add(self, kind: int, place: tuple[str, ...], content: str) -> int:
        h = xxhash.xxh3_64_intdigest("\0".join((str(kind > 0), *place, content)).encode("utf-8", "surrogatepass"))
        self.tokens.append(h)
        self.kinds.append(kind)
        return h


def attributes(source: str | None) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source and not source.isspace() else {}


def hidden(found: dict[str, str]) -> bool:
    return bool(found) and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")) is not None)


def name_words(found: dict[str, str]) -> list[set[str]]:
    return [{w.lower() for w in NAME_PART.findall(name)} for value in (found.get("class", ""), found.get("id", "")) for name in value.split()]


def region(name: str, found: dict[str, str]) -> str:
    """The kind of region an element opens: "", "outside", "named" (by its class or id alone), "form", "aside" or "comments"."""
    names = name_words(found) if found else []
    if name in ("html", "body", "main"):
        return ""

    def named(of: frozenset[str]) -> bool:
        return any(w & of and all(x in of or x in OUTSIDE_NAMES or x in PLAIN_NAMES or x.isdigit() for x in w) for w in names)

    if named(COMMENT_NAMES):
        return "comments"
    if name == "article":
        return ""
    if name == "aside":
        return "aside"
    if hidden(found) or found.get("role", "").lower() in OUTSIDE_ROLES:
        return "outside"
    if name == "form":
        return "outside" if named(OUTSIDE_NAMES) else "form"
    if name in OUTSIDE:
        return "outside"
    return "named" if named(OUTSIDE_NAMES) else ""


def parsed(source: str) -> Page:
    """Tokens and text blocks of a page."""
    page = Page()
    stack: list[tuple[str, str, bool]] = []  # element, region, article or main
    block: Block | None = None
    #: an inline or loose element that is left out: name, depth of the stack, open elements of that name
    muted: list | None = None

    def close() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(entities.unescape("".join(block.parts)).split())
            if block.text:
                page.blocks.append(block)
                block.token = page.add(2 if block.inside and not block.outside else 1, block.place, block.text)
        block = None

    def text(part: str) -> None:
        nonlocal block
        if not part or muted:
            return
        if block is None:
            if part.isspace():
                return
            kinds = {s[1] for s in stack} - {""}
            block = Block(tuple(s[0] for s in stack[-6:]), any(s[2] for s in stack), bool(kinds), kinds == {"form"}, bool(kinds) and kinds <= {"named", "comments"})
        block.parts.append(part)

    at, end, markup = 0, len(source), MARKUP
    while at < end:
        m = markup.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(entities.unescape(m[0][9:].removesuffix("]]>")).replace("&", "&amp;"))
            continue
        if not m[2]:
            markup = LOOSE_MARKUP
        closing = bool(m[1] or m[4])
        source_of = m[3] if m[2] else m[6]
        if name in RAW and not closing:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            at = stop.end() if stop else end
            if name not in ("svg", "math"):
                close()
            continue
        if muted and (len(stack) < muted[1] or muted[0] == name):
            muted[2] += -1 if closing or name in LOOSE else 1
            if len(stack) < muted[1] or muted[2] <= 0:
                muted = None
                if closing and name in INLINE:
                    continue
        if muted and muted[0] in INLINE and name in LOOSE:  # a paragraph ends what an inline element has left open
            muted = None
        if name in INLINE:
            if not closing and not muted and source_of and name not in VOID:
                found = attributes(source_of)
                if hidden(found) or any(w & INLINE_NAMES and all(x in OUTSIDE_NAMES or x in PLAIN_NAMES or x.isdigit() for x in w) for w in name_words(found)):
                    muted = [name, len(stack), 1]
            continue
        close()
        if name in VOID:
            continue
        if closing:
            held = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0].split(".")[0] == name), None)
            if held is not None:
                del stack[held:]
                if muted and len(stack) < muted[1]:
                    muted = None
            continue
        if name in ("html", "body"):
            page.add(0, (), name)
            if name == "body":
                stack.clear()
            continue
        found = attributes(source_of)
        kind = region(name, found)
        if stack and stack[-1][0].split(".")[0] == "head" and name not in IN_HEAD:  # its end tag was left out
            stack.pop()
        label = ".".join([name, *sorted(found.get("class", "").split())[:3]])
        page.add(0, tuple(s[0] for s in stack[-6:]), label)
        if name in LOOSE:
            if kind and not muted:
                muted = [name, len(stack), 1]
            continue
        main = not kind and (name in ("article", "main") or found.get("role", "").lower() in ("main", "article"))
        if main and not any(s[1] in HOLDING for s in stack):
            while stack and stack[-1][1]:
                stack.pop()
        stack.append((label, kind, main))
    close()
    return page


def occurrences(tokens: np.ndarray, page: int) -> tuple[np.ndarray, np.ndarray]:
    """A page's different tokens, and its part of their occurrence vectors."""
    token, count = np.unique(tokens, return_counts=True)
    return token, mixed(mixed(np.uint64(page) + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class Classes:
    """Candidate classes of a host, most frequent first: their tokens with class numbers."""

    def __init__(self, tokens: bytes, numbers: bytes):
        self.token, self.number = np.frombuffer(tokens, dtype="<u8"), np.frombuffer(numbers, dtype="<i4")
        self.size = np.bincount(self.number, minlength=0)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Class numbers of tokens, -1 for none."""
        if not len(self.token):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        return np.where(self.token[at] == tokens, self.number[at], -1)

    def tested(self, tokens: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
        """(class, hash of its order, article blocks in it and more frequent ones, article blocks, whether it is ordered and nested) on a page."""
        number = self.of(tokens)
        article = kinds == 2
        places: list[np.ndarray] = []
        for c, size in enumerate(self.size.tolist()):
            at = np.flatnonzero(number == c)
            if not len(at):
                continue
            seen = tokens[at]
            first = seen[:size]
            good = len(at) % size == 0 and len(np.unique(first)) == size and bool((seen.reshape(-1, size) == first).all())
            if good:
                for outer in places:
                    gap = np.searchsorted(outer, at).reshape(-1, size)
                    good = good and bool((gap == gap[:, :1]).all())
                places.append(at)
            yield c, xxhash.xxh3_64_intdigest(first.tobytes()) >> 1, int((article & (number >= 0) & (number <= c)).sum()), int(article.sum()), good


def main_text(page: Page, template: np.ndarray, within: np.ndarray) -> str:
    """Slots that are article text, joined by one space.  ``template``, ``within``: sorted tokens that go, within articles those of the second."""

    def slots(blocks: list[Block], gone: np.ndarray) -> list[Block]:
        if not len(gone) or not blocks:
            return blocks
        tokens = np.array([b.token for b in blocks], dtype=np.uint64)
        return [b for b, go in zip(blocks, np.isin(tokens, gone).tolist(), strict=True) if not go]

    size = lambda blocks: sum(len(b.text) for b in blocks)
    inside = slots([b for b in page.blocks if b.inside and not b.outside], within)
    open_ = [b for b in page.blocks if not b.outside]
    formed = [b for b in page.blocks if b.in_form]
    if size(formed) > 4 * size(open_):  # the whole page is in a form
        open_ = [b for b in page.blocks if not b.outside or b.in_form]
    if not open_:  # names alone leave nothing
        open_ = [b for b in page.blocks if b.named]
    kept = slots(open_, template) or open_
    if any(b.inside and not b.outside for b in page.blocks):
        beside, own = [b for b in kept if not b.inside], {id(b) for b in inside}
        kept = inside if size(inside) >= size(beside) else [b for b in kept if not b.inside or id(b) in own]
    return " ".join(b.text for b in kept)


def with_host(rows: DataFrame, table: DataFrame, hot: list[int], n_bytes: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (a row a host at most): broadcast while small, else hot hosts apart."""
    if n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), "host", "left")
    some = F.col("host").isin(hot) if hot else F.lit(False)
    return rows.filter(~some).join(table.filter(~some), "host", "left").unionByName(rows.filter(some).join(F.broadcast(table.filter(some)), "host", "left"))


def page_tokens(rows: DataFrame) -> DataFrame:
    """A row for each different page of a host: host, page, tokens, kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for host, page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (host, page) in seen:
                    continue
                if len(seen) < PAGES_HELD:
                    seen.add((host, page))
                found = parsed(html.as_py())
                if found.tokens:
                    for column, value in zip(out, (host, page, np.array(found.tokens, dtype="<u8").tobytes(), bytes(found.kinds)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["host", "page", "tokens", "kinds"])

    found = rows.filter("html is not null").select("host", "page", "html").mapInArrow(run, "host long, page long, tokens binary, kinds binary")
    return found.groupBy("host", "page").agg(F.first("tokens").alias("tokens"), F.first("kinds").alias("kinds"))


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, vector, n, article text, text) of a task's pages, a batch's pages folded."""
    for batch in batches:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for host, page, tokens, kinds in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            tokens = np.frombuffer(tokens, dtype="<u8")
            token, vector = occurrences(tokens, page & (1 << 64) - 1)
            text = np.zeros(len(token), dtype=bool)
            text[np.searchsorted(token, tokens[np.frombuffer(kinds, dtype=np.uint8) > 0])] = True
            for column, value in zip(cols, (np.full(len(token), host), token, vector, text), strict=True):
                column.append(value)
        if not cols[0]:
            continue
        host, token, vector, text = (np.concatenate(c) for c in cols)
        order = np.lexsort((token, host))
        host, token, vector, text = (x[order] for x in (host, token, vector, text))
        first = np.flatnonzero(np.concatenate([[True], (host[1:] != host[:-1]) | (token[1:] != token[:-1])]))
        columns = [host[first], token[first].view(np.int64), np.bitwise_xor.reduceat(vector, first).view(np.int64), np.diff(np.append(first, len(host))), text[first]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["host", "token", "vector", "n", "text"])


def tested_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tests of classes on a task's pages, folded: host, class, least and greatest hash of the order, article blocks, whether all are good."""
    total: dict[tuple[int, int], list] = {}
    names = ["host", "class", "low", "high", "shared", "blocks", "good"]

    def folded() -> pa.RecordBatch:
        rows = [(*key, *value) for key, value in total.items()]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.bool_()), strict=True)], names)

    for batch in batches:
        for host, tokens, kinds, class_tokens, numbers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            for c, order, shared, blocks, good in Classes(class_tokens, numbers).tested(np.frombuffer(tokens, dtype="<u8"), np.frombuffer(kinds, dtype=np.uint8)):
                old = total.get((host, c))
                total[host, c] = [order, order, shared, blocks, good] if old is None else [min(old[0], order), max(old[1], order), old[2] + shared, old[3] + blocks, old[4] and good]
        if len(total) > 200_000:
            yield folded()
    if total:
        yield folded()


def packed_classes(members: DataFrame, flags: list[str]) -> DataFrame:
    """A row a host: its sorted tokens as bytes, with class numbers or flags as bytes.  A host has at most twice as many as a page."""
    kind = {"number": ("<i4", "binary")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(2 + len(flags))]
            for host, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                token = np.array([x["token"] for x in found], dtype="<i8").view("<u8")
                order = np.argsort(token)
                out[0].append(host)
                out[1].append(token[order].tobytes())
                for column, flag in zip(out[2:], flags, strict=True):
                    column.append(np.array([x[flag] for x in found]).astype(kind.get(flag, ("u1",))[0])[order].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(c, pa.binary()) for c in out[1:]]], ["host", "class_tokens", *flags])

    lists = members.groupBy("host").agg(F.collect_list(F.struct("token", *flags)).alias("found"))
    return lists.mapInArrow(run, "host long, class_tokens binary, " + ", ".join(f"{f} binary" for f in flags))


def table_bytes(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum(F.octet_length("class_tokens") * 2 + 64), F.lit(0)).alias("n")).first()["n"]


def templates(pages: DataFrame) -> tuple[DataFrame, list[int], int]:
    """(host, class_tokens, within) for the hosts with a template, the hot hosts, and the table's bytes.  ``pages``: host, page, tokens, kinds, written."""
    total = row_count(pages)
    counts = written(pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES))
    hot = [r["host"] for r in counts.filter(F.col("pages") > max(1000, total // HOT_SHARE)).select("host").collect()]  # at most HOT_SHARE hosts
    occurring = pages.mapInArrow(token_rows, "host long, token long, vector long, n long, text boolean").groupBy("host", "token")
    occurring = occurring.agg(F.bit_xor("vector").alias("vector"), F.sum("n").alias("n"), F.max("text").alias("text")).filter(F.col("n") >= -(-LEAST_PAGES // 2))
    frequent = written(with_host(occurring, counts, hot, 64 * row_count(counts)).filter(2 * F.col("n") > F.col("pages")).select("host", "token", "vector", "n", "text"))
    # a host's frequent tokens are at most twice as many as a page has, and its classes fewer
    classes = frequent.groupBy("host", "n", "vector").agg(F.count("*").alias("size"), F.max("text").alias("text"), F.collect_list("token").alias("tokens")).filter("size > 1 and text")
    ranked = classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "vector", "tokens"))).alias("found"))
    members = written(ranked.select("host", F.posexplode("found").alias("number", "x")).select("host", "number", F.explode("x.tokens").alias("token")))
    candidates = written(packed_classes(members, ["number"]))
    met = with_host(pages.select("host", "tokens", "kinds"), candidates, hot, table_bytes(candidates)).filter("class_tokens is not null")
    tested = met.select("host", "tokens", "kinds", "class_tokens", "number").mapInArrow(tested_rows, "host long, class int, low long, high long, shared long, blocks long, good boolean")
    tested = tested.groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("shared").alias("shared"), F.sum("blocks").alias("blocks"), F.min("good").alias("good"))
    valid = tested.filter("good and low = high").select("host", F.col("class").alias("number"), (2 * F.col("shared") < F.col("blocks")).alias("within"))
    found = written(packed_classes(members.join(valid, ["host", "number"]).select("host", "token", "within"), ["within"]))
    return found, hot, table_bytes(found)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), F.xxhash64(host).alias("host"), F.xxhash64(html_col).alias("page"))
    found, hot, n_bytes = templates(written(page_tokens(rows)))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, tokens, within in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                gone = np.frombuffer(tokens.as_py() or b"", dtype="<u8")
                texts.append(main_text(parsed(html.as_py()), gone, gone[np.frombuffer(within.as_py() or b"", dtype="u1") > 0]) if html.is_valid else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    met = with_host(rows.select("host", "id", "url", "html"), found, hot, n_bytes).select("id", "url", "html", "class_tokens", "within")
    return met.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
