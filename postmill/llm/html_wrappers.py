"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page becomes a stream of tokens, one for each block of text: its path of elements and its text.
Adjacent repetitions fold into repeated groups. Streams of one host are then aligned one after the
other with the wrapper so far: equal paths match, texts that differ become slots, tokens that only
one side has become optional, runs become repeated. No alternatives arise, so a wrapper is as
long as a page's layout. Aligning two wrappers is the same operation, so a host of any size is
inferred in a tree: equal streams collapse in the tasks that read them, groups of some of a host's
streams give partial wrappers, and some of these one, in rounds until a host has one.

Pages whose streams and texts are equal are copies and count as one.

All that decides about a page is read off its host's wrapper; a page alone is no more than its blocks.

* Regions: the wrapper's article elements that hold more than template texts, on pages without one its
  main elements, else the element under which most text stands. What is outside them goes.
* Template texts: a token whose text is the same on all pages that have it (in a repeated group: texts
  that all pages with the group have in it). How sure that is grows with the pages, and how sure it has
  to be grows with the share of such texts in the host's pages (near copies of one page agree in most
  of it) and is higher inside an article, where texts may repeat for their own sake (:func:`verdict`).
* Marked tokens: elements that say that they aren't content (nav, aside, forms, what is hidden, or classes
  made of nothing but words like "advert" or "comments" and of place words like "list" or "top").

"""

from __future__ import annotations

import bisect
import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, stage_table
from .urls import split_url

#: Distinct streams of a host (expected) that one task aligns, and partial wrappers that one task merges.
STREAMS, MERGED = 200, 16
#: Wrappers of up to so many hosts and bytes are broadcast; more are joined, with a host's pages dealt to so many salts.
BROADCAST_HOSTS, BROADCAST_BYTES, SALTS = 20_000, 1 << 24, 16
#: Most tokens of a wrapper beyond those that all pages have. A host that has more isn't aligned but counted by joins, see :func:`_told`.
MOST_TOKENS = 4096
#: How likely it is that a text which two pages share is the template's, inside an article and elsewhere.
SHARED_INSIDE, SHARED_OUTSIDE = 0.05, 1.0
#: Share of the slot text that the region must hold.
REGION_SHARE = 0.7

#: Fixed: elements whose text isn't content, raw text elements, blocks, and marks in class, id or role.
NOT_CONTENT = set("head nav header footer aside form button select textarea noscript template iframe svg canvas object dialog menu label fieldset".split())
RAW = set("script style noscript template iframe textarea title xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption nav header footer aside form fieldset address details summary hr center menu dialog title noscript template".split()
)
MARKS = set(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer foot bottombar colophon sidebar aside rail widget widgets related recommended recommendations teaser share sharing social follow subscribe "
    "subscription newsletter signup cookie cookies consent gdpr notice notification notifications alert popup modal overlay comment comments commentlist discussion reply "
    "replies respond disqus form search searchbox login pagination pager toolbar copyright skip".split()
)
#: Words that tell an element's place or shape and nothing about what it says.
PLACES = set("list box wrapper wrap container section block area item items bar slot top bottom left right main inner outer site page post article col row unit content group panel global primary secondary js the".split())
REGIONS = ("article", "main")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = set("article main section div body table ul ol dl td th blockquote nav aside header footer form".split())


class Block:
    """A block of text: its path, whether an element on the path says that it isn't content, and its text."""

    __slots__ = ("path", "left_out", "text")

    def __init__(self, path: tuple, left_out: bool, text: str):
        self.path, self.left_out, self.text = path, left_out, text


#: What an element says of itself: content, not content, a header.
CONTENT, NO_CONTENT, HEADER = 0, 1, 2


def _says(tag: str, attributes: str) -> tuple[int, str]:
    """What an element says of itself, and its name in paths."""
    if not attributes.strip(" /"):
        return HEADER if tag == "header" else NO_CONTENT if tag in NOT_CONTENT else CONTENT, tag
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    first = re.split(r"\s+", names.strip())[0]
    name = f"{tag}.{re.sub(r'[0-9]+', '#', first)}" if first else tag
    if tag in ("html", "body", "article", "main"):
        return CONTENT, name
    marks = [p for p in ({x.lower() for x in _PART.findall(n) if not x.isdigit()} for n in names.split()) if p & MARKS and p <= MARKS | PLACES]
    parts = set().union(*marks) - PLACES
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if (tag == "header" or parts & MARKS == {"header"}) and not hidden:
        return HEADER, name
    return NO_CONTENT if tag in NOT_CONTENT or parts & MARKS or found.get("role", "").lower() in ROLES or hidden else CONTENT, name


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with character references decoded and white space collapsed."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, name, what it says
    words: list[str] = []

    def left_out() -> bool:
        """An article's own header counts, as far as its headings go; a page's header doesn't."""
        for i, (_, _, says) in enumerate(stack):
            if says == HEADER:
                if not any(t in ("article", "main") for t, *_ in stack[:i]) or not any(t in HEADINGS for t, *_ in stack[i:]):
                    return True
            elif says == NO_CONTENT:
                return True
        return False

    def flush():
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                out.append(Block(tuple(n for t, n, _ in stack if t in BLOCKS), left_out(), text))

    def close(tags, stops) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            words.append(page[at:])
            break
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                words.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCKS:
            flush()
        if closing:
            if tag == "p" and not any(t == "p" for t, *_ in stack):
                continue
            close({tag}, {"article", "body"} - {tag} if tag not in ("html", "body", "article", "main") else set())
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in BLOCKS:
            close({"p"}, _STOPS)
        if tag in _CLOSES:
            close(_CLOSES[tag], {"ul", "ol", "dl", "table"})
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
            if stop:
                at = page.find(">", at) + 1 or end
            continue
        if tag in VOID:
            continue
        says, name = _says(tag, m[3] or "")
        stack.append((tag, name, says))
    flush()
    return out


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1 or 1


def page_digest(blocks: list[Block]) -> bytes:
    """Of the stream with its texts, without marked blocks: pages with equal ones are copies and count as one page."""
    return xxhash.xxh3_128_digest("\0".join(f"{'/'.join(b.path)}\0{b.text}" for b in blocks if not b.left_out))


#: A token of a wrapper: path, repeated, optional, digest of its text (0: a slot), pages, characters, and
#: the digests of the texts that all pages with the token have there (where absent: that of its text).
Item = list


def common(x: Item) -> list[int]:
    return x[6] if len(x) > 6 else [x[3]] if x[3] else []


def _both(a: Item, b: Item) -> list[int]:
    return sorted({*common(a)} & {*common(b)})


def fold(items: list[Item]) -> list[Item]:
    """Adjacent repetitions of up to four tokens become one repeated group."""
    for width in (1, 2, 3, 4):
        out: list[Item] = []
        for x in items:
            out.append(list(x))
            while len(out) >= 2 * width and all(a[0] == b[0] for a, b in zip(out[-2 * width : -width], out[-width:], strict=True)):
                for a, b in zip(out[-2 * width : -width], out[-width:], strict=True):
                    texts = _both(a, b) if a[2] or b[2] else sorted({*common(a), *common(b)})  # an optional one's pages may lack the other
                    a[1], a[2], a[3], a[5], a[6:] = True, a[2] and b[2], a[3] if a[3] == b[3] else 0, a[5] + b[5], [texts]
                del out[-width:]
        items = out
    return items


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal tokens in the order of both: the longest chain among pairs of the nth occurrences of a token; n log n."""
    seen: dict[str, int] = {}
    place = {}
    for j, x in enumerate(b):
        seen[x] = seen.get(x, 0) + 1
        place[x, seen[x]] = j
    seen.clear()
    ends: list[int] = []  # least end of a chain of each length
    chains: list[tuple[int, int, int]] = []  # i, j, the pair before
    last: list[int] = []
    for i, x in enumerate(a):
        seen[x] = seen.get(x, 0) + 1
        j = place.get((x, seen[x]))
        if j is None:
            continue
        n = bisect.bisect_left(ends, j)
        chains.append((i, j, last[n - 1] if n else -1))
        ends[n : n + 1], last[n : n + 1] = [j], [len(chains) - 1]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = chains[at]
        out.append((i, j))
    return out[::-1]


def align(a: list[Item], b: list[Item], gone: list[str] | None = None, most: int = MOST_TOKENS) -> list[Item]:
    """The least general wrapper of both: matches stay, texts that differ become slots, the rest optional.

    Of layouts without end the optional tokens on the fewest pages leave the wrapper; their paths go to ``gone``,
    which says that this isn't the host's wrapper.
    """
    if not a or not b:
        return [[*x[:2], True, *x[3:]] for x in a or b]
    out: list[Item] = []
    i = j = 0
    for k, n in [*_matches([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[*x[:2], True, *x[3:]] for x in [*a[i:k], *b[j:n]]]
        if k < len(a):
            x, y = a[k], b[n]
            out.append([x[0], x[1] or y[1], x[2] or y[2], x[3] if x[3] == y[3] else 0, x[4] + y[4], x[5] + y[5], _both(x, y)])
        i, j = k + 1, n + 1
    out = fold(out)
    if len(out) > most:
        optional = sorted((x[4], i) for i, x in enumerate(out) if x[2])
        left = {i for _, i in optional[: len(out) - most]}
        if gone is not None:
            gone += sorted(out[i][0] for i in left)
        out = [x for i, x in enumerate(out) if i not in left]
    return out


#: Ends the path of a marked block, whose element says that it isn't content.
MARK = "!"


def path_of(block: Block) -> str:
    return "/".join(block.path) + MARK * block.left_out


def page_items(blocks: list[Block]) -> list[Item]:
    return fold([[path_of(b), False, False, digest(b.text), 1, len(b.text)] for b in blocks])


def _in_article(path: str) -> bool:
    return any(part.split(".")[0] in REGIONS for part in path.split("/"))


def verdict(wrapper: list[Item]) -> dict:
    """What to do with a host's pages: the regions of the main text, the template's own texts, and whether marked blocks go.

    A text that is the same on all k pages with its token is the template's if 2^-(k-1) < shared * (1 - same):
    ``same`` is the share of such texts in all text, ``shared`` SHARED_INSIDE in an article and SHARED_OUTSIDE else.
    So one page tells nothing, two tell a short line, and pages that agree in most of their text need to be many.
    """
    open_ = [x for x in wrapper if not x[0].endswith(MARK)]
    constant = lambda x: x[3] != 0 and not x[1] and x[4] > 1
    whole = sum(x[5] for x in open_)
    varied = 1 - sum(x[5] for x in open_ if constant(x)) / whole if whole else 0.0
    sure = lambda x: x[4] > 1 and 0.5 ** min(x[4] - 1, 1000) < (SHARED_INSIDE if _in_article(x[0]) else SHARED_OUTSIDE) * varied
    drop = sorted({(x[0], d) for x in open_ if sure(x) for d in common(x)})
    total: dict[str, int] = {}
    marked: dict[str, set[str]] = {kind: set() for kind in REGIONS}
    said = 0
    for x in open_:
        if not (constant(x) and sure(x)):
            said += x[5]
            parts = x[0].split("/")
            for n in range(1, len(parts) + 1):
                prefix, kind = "/".join(parts[:n]), parts[n - 1].split(".")[0]
                if kind in marked:
                    marked[kind].add(prefix)
                if n < len(parts):
                    total[prefix] = total.get(prefix, 0) + x[5]
    region = max((p for p, n in total.items() if n >= REGION_SHARE * said), key=lambda p: (p.count("/"), p), default="")
    return {"regions": [sorted(marked[kind]) for kind in REGIONS] + [[region] if region else []], "drop": drop, "marks": True}


def main_text(blocks: list[Block], advice: dict) -> str:
    """The page's main text: what stands in the first of the wrapper's kinds of regions that the page has, without the template's texts and marked blocks."""
    kept = [("/".join(b.path), b.text) for b in blocks if not (b.left_out and advice.get("marks"))]
    for told in advice.get("regions", ()):
        within = tuple(f"{r}/" for r in told)
        if inside := [x for x in kept if f"{x[0]}/".startswith(within)]:
            kept = inside
            break
    template = {(p, d) for p, d in advice.get("drop", ())}
    left = [x for x in kept if (x[0], digest(x[1])) not in template] if template else kept
    return "\n".join(text for _, text in left or kept)  # a page of nothing but the template's texts keeps them


_STREAM = "host string, page binary, shape string, digests array<bigint>, chars array<bigint>, texts array<array<bigint>>"
_SHAPE = "host string, shape string, slot int, low bigint, high bigint, pages bigint, chars bigint, texts array<bigint>"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded stream of every page with blocks; of copies that a task meets in a row of pages, one."""
    seen: set[tuple] = set()
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            blocks = blocks_of(page.as_py() or "")
            items = page_items(blocks)
            key = (host, page_digest(blocks))
            if not items or key in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(key)
            shape = "\n".join(f"{'+' if x[1] else ' '}{x[0]}" for x in items)
            rows.append((*key, shape, [x[3] for x in items], [x[5] for x in items], [common(x) if x[1] else [] for x in items]))
        if rows:
            numbers = pa.list_(pa.int64())
            types = (pa.string(), pa.binary(), pa.string(), numbers, numbers, pa.list_(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["host", "page", "shape", "digests", "chars", "texts"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every host and folded stream, by slot: least and largest text digest, distinct pages, characters, texts of a group on all; equal ones collapse here."""
    seen: dict[tuple, list] = {}

    def out():
        rows = [(h, s, i, int(v[0]), int(v[1]), v[2], int(v[3]), sorted(v[4])) for (h, s), slots in seen.items() for i, v in enumerate(slots)]
        types = (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _SHAPE.replace(",", "").split()[::2])

    for batch in batches:
        for host, shape, digests, chars, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            slots = seen.setdefault((host, shape), [[d, d, 0, 0, {*t}] for d, t in zip(digests, texts, strict=True)])
            for v, d, n, t in zip(slots, digests, chars, texts, strict=True):
                low, high = (d, d) if d else (0, 1)  # a slot within the page already
                v[0], v[1], v[2], v[3] = min(v[0], low), max(v[1], high), v[2] + 1, v[3] + n
                v[4].intersection_update(t)
        if len(seen) > 20_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


#: A wrapper, or that the host has too many tokens for one.
_WRAPPER = "host string, wrapper string, long boolean, part int"


def _wrapped(host: str, wrapper: list[Item] | None, part: int) -> pd.DataFrame:
    return pd.DataFrame({"host": [host], "wrapper": [json.dumps(wrapper or [])], "long": [wrapper is None], "part": [part]})


def _partial(key: tuple, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Align the distinct streams of a part of a host, commonest first."""
    streams = []
    for shape, slots in rows.groupby("shape", sort=True):
        slots = slots.sort_values("slot")
        paths = shape.split("\n")
        columns = (slots[c] for c in ("low", "high", "pages", "chars", "texts"))
        items = [
            [p[1:], p[0] == "+", False, int(a) if a == b else 0, int(n), int(c), sorted(map(int, t)) if p[0] == "+" else [int(a)] if a == b else []]
            for p, a, b, n, c, t in zip(paths, *columns, strict=True)
        ]
        streams.append((-items[0][4], shape, items))
    wrapper, gone = None, []
    for *_, items in sorted(streams, key=lambda x: x[:2]):
        wrapper = items if wrapper is None else align(wrapper, items, gone, most)
        if gone:
            return _wrapped(key[0], None, int(key[1]))
    return _wrapped(key[0], wrapper, int(key[1]))


def _merged(key: tuple, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Align partial wrappers of a host."""
    wrapper, gone = None, []
    for text in sorted(rows["wrapper"]):
        wrapper = json.loads(text) if wrapper is None else align(wrapper, json.loads(text), gone, most)
        if gone or rows["long"].any():
            return _wrapped(key[0], None, int(key[1]))
    return _wrapped(key[0], wrapper, int(key[1]))


def _advice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [json.dumps(verdict(json.loads(x))) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), batch.column(2)], ["a_host", "advice", "long"])


def infer_wrappers(pages: DataFrame, streams: int = STREAMS, most_tokens: int = MOST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper, long) from (host, html), and the hosts' streams; a task aligns about ``streams`` distinct streams of a host at once."""
    distinct = pages.select("host", "html").mapInArrow(_streams, _STREAM).dropDuplicates(["host", "page"])
    shapes = distinct.select("host", "shape", "digests", "chars", "texts").mapInArrow(_shapes, _SHAPE)
    shapes = stage_table(shapes, "shapes")
    key = ["host", "shape", "slot"]
    sums = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.count("*").alias("met")]
    merged = shapes.groupBy(*key).agg(*sums)
    # texts that every task which met the stream found on all its pages: counted, not gathered
    every = shapes.select(*key, F.explode("texts").alias("text")).groupBy(*key, "text").agg(F.count("*").alias("n")).join(merged.select(*key, "met"), key).where("n = met")
    merged = merged.drop("met").join(every.groupBy(*key).agg(F.collect_list("text").alias("texts")), key, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<bigint>")))
    merged = stage_table(merged, "streams")
    parts = merged.where("slot = 0").groupBy("host").agg(F.ceil(F.count("*") / streams).cast("int").alias("parts"))
    most = parts.agg(F.max("parts")).first()[0] or 1
    dealt = merged.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.col("parts")).cast("int")).drop("parts")
    wrappers = dealt.groupBy("host", "part").applyInPandas(lambda key, rows: _partial(key, rows, most_tokens), _WRAPPER)
    while most > 1:
        most = -(-most // MERGED)
        level = wrappers.withColumn("part", F.floor(F.col("part") / MERGED).cast("int"))
        wrappers = level.groupBy("host", "part").applyInPandas(lambda key, rows: _merged(key, rows, most_tokens), _WRAPPER)
    return wrappers.select("host", "wrapper", "long"), merged


def _prefixes(tokens: DataFrame, *keep: str) -> DataFrame:
    """Every prefix of a path, with the kind of its last element, its number of elements, and whether it is the whole path."""
    parts = F.split("path", "/")
    rows = tokens.select(*keep, parts.alias("_parts"), F.posexplode(parts).alias("_n", "_part"))
    return rows.select(*keep, F.array_join(F.slice("_parts", F.lit(1), F.col("_n") + 1), "/").alias("prefix"), F.split_part("_part", F.lit("."), F.lit(1)).alias("kind"), F.col("_n").alias("depth"), (F.col("_n") + 1 == F.size("_parts")).alias("whole"))


def _told(streams: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What :func:`verdict` says, by joins: for hosts with more tokens than a wrapper takes, however many these are.

    Tokens of equal paths and numbers among those of their path in a page are one; nothing is left out, and neither order
    nor tasks decide. Gives (host, region), (host, kind, prefix) of articles and mains, and (host, path, text) of the template's texts.
    """
    key = ["host", "path", "nth"]
    line = F.element_at(F.split("shape", "\n"), F.col("slot") + 1)
    tokens = streams.withColumns({"path": F.substring(line, 2, 1 << 30), "repeated": F.substring(line, 1, 1) == "+", "digest": F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0)})
    tokens = tokens.withColumn("nth", F.row_number().over(Window.partitionBy("host", "shape", "path").orderBy("slot"))).where(~F.col("path").endswith(MARK))
    texts = F.when(F.col("repeated"), F.col("texts")).when(F.col("digest") != 0, F.array("digest")).otherwise(F.array().cast("array<bigint>"))
    tokens = stage_table(tokens.select(*key, "repeated", "digest", "pages", "chars", texts.alias("texts")), "tokens")
    low, high = F.min("digest"), F.max("digest")
    sums = [F.bool_or("repeated").alias("repeated"), F.when(low == high, low).otherwise(0).alias("digest"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.count("*").alias("met")]
    merged = tokens.groupBy(*key).agg(*sums).withColumn("constant", (F.col("digest") != 0) & ~F.col("repeated") & (F.col("pages") > 1))
    hosts = merged.groupBy("host").agg(F.sum("chars").alias("all_chars"), F.coalesce(F.sum(F.when(F.col("constant"), F.col("chars"))), F.lit(0)).alias("same_chars"))
    varied = F.when(F.col("all_chars") > 0, 1 - F.col("same_chars") / F.col("all_chars")).otherwise(0.0)
    shared = F.when(F.col("path").rlike(rf"(^|/)({'|'.join(REGIONS)})(\.[^/]*)?(/|$)"), SHARED_INSIDE).otherwise(SHARED_OUTSIDE)
    sure = (F.col("pages") > 1) & (F.pow(F.lit(0.5), F.least(F.col("pages") - 1, F.lit(1000))) < shared * varied)
    merged = stage_table(merged.join(hosts, "host").withColumn("sure", sure).drop("all_chars", "same_chars"), "merged-tokens")
    every = tokens.select(*key, F.explode("texts").alias("text")).groupBy(*key, "text").agg(F.count("*").alias("n"))
    drop = every.join(merged.where("sure").select(*key, "met"), key).where("n = met").select("host", "path", "text").distinct()
    live = merged.where(~(F.col("constant") & F.col("sure"))).select("host", "path", "chars")
    prefixes = _prefixes(live, "host", "chars")
    marked = prefixes.where(F.col("kind").isin(*REGIONS)).select("host", "kind", "prefix").distinct()
    said = live.groupBy("host").agg(F.sum("chars").alias("said"))
    total = prefixes.where("not whole").groupBy("host", "prefix", "depth").agg(F.sum("chars").alias("n")).join(said, "host")
    best = total.where(F.col("n") >= F.lit(REGION_SHARE) * F.col("said")).groupBy("host").agg(F.max(F.struct("depth", "prefix"))["prefix"].alias("region"))
    return hosts.select("host").join(best, "host", "left"), marked, drop


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct paths and texts of a page's blocks that no mark leaves out."""
    for batch in batches:
        for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = sorted({("/".join(b.path), digest(b.text)) for b in blocks_of(text or "") if not b.left_out})
            if found:
                paths, texts = zip(*found, strict=True)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([host] * n), pa.array([page] * n), pa.array(paths), pa.array(texts, pa.int64())], ["host", "page", "path", "text"])


def _with_own_advice(rows: DataFrame, streams: DataFrame) -> DataFrame:
    """Pages of hosts with more tokens than a wrapper takes, with what the host's tokens say of the page's own paths and texts."""
    hosts, marked, drop = _told(streams)
    hosts = stage_table(hosts, "long-hosts")
    rows = rows.join(hosts.select("host"), "host", "left_semi").withColumn("page", F.sha2(F.coalesce("html", F.lit("")), 256))
    pieces = rows.select("host", "page", "html").dropDuplicates(["host", "page"]).mapInArrow(_pieces, "host string, page string, path string, text bigint")
    pieces = stage_table(pieces, "pieces")
    own = _prefixes(pieces.select("host", "page", "path").distinct(), "host", "page").where(F.col("kind").isin(*REGIONS)).select("host", "page", "kind", "prefix").distinct().join(marked, ["host", "kind", "prefix"])
    lists = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("prefix")))).alias(k) for k in REGIONS]
    gone = pieces.join(drop, ["host", "path", "text"]).groupBy("host", "page").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("drop"))
    told = pieces.select("host", "page").distinct().join(own.groupBy("host", "page").agg(*lists), ["host", "page"], "left").join(gone, ["host", "page"], "left").join(hosts, "host")
    none = F.array().cast("array<string>")
    regions = F.array(*[F.coalesce(k, none) for k in REGIONS], F.when(F.col("region").isNull(), none).otherwise(F.array("region")))
    advice = F.to_json(F.struct(regions.alias("regions"), F.coalesce("drop", F.array().cast("array<struct<path:string,text:bigint>>")).alias("drop"), F.lit(True).alias("marks")))
    told = stage_table(told.select("host", "page", advice.alias("advice")), "own-advice")
    return rows.join(told, ["host", "page"], "left").select("page_id", "url", "html", F.coalesce("advice", F.lit('{"marks": true}')).alias("advice"))  # a page of marked blocks only


@releasing
def extract(pages: DataFrame, streams: int = STREAMS, broadcast_hosts: int = BROADCAST_HOSTS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    ``streams`` (distinct streams that a task aligns at once) and ``broadcast_hosts`` with BROADCAST_BYTES (wrappers
    that are broadcast) bound memory; beyond them wrappers are merged in rounds and joined by salted host. What a host's
    pages say is counted by joins (:func:`_told`) where its wrapper has more than ``most_tokens`` tokens.

    * A null or empty html gives the empty text; a page without blocks too.
    * A null url, or one without ://, belongs to the host "" like all such pages.
    * Broken markup is read as far as it goes: unclosed elements end with their parent or the page.
    * Repeated rows and null ids are extracted each for itself. Other columns are ignored.
    """
    rows = split_url(pages.select("page_id", "url", "html")).drop("path")
    wrappers, host_streams = infer_wrappers(rows, streams, most_tokens)
    advice = wrappers.select("host", "wrapper", "long").mapInArrow(_advice, "a_host string, advice string, long boolean")
    advice, own = stage_table(advice, "wrappers"), None
    long_hosts = advice.where("long").select(F.col("a_host").alias("host"))
    if not long_hosts.isEmpty():
        own = _with_own_advice(*(d.join(long_hosts, "host", "left_semi") for d in (rows, host_streams)))
        rows = rows.join(long_hosts, "host", "left_anti")
    advice = advice.where("not long").drop("long")
    size = advice.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("advice") + F.length("a_host")), F.lit(0)).alias("chars")).first()
    if size["n"] <= broadcast_hosts and 4 * size["chars"] <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(advice), F.col("host") == F.col("a_host"), "left")
    else:
        salted = advice.withColumn("a_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, (F.col("host") == F.col("a_host")) & (F.col("salt") == F.col("a_salt")), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = []
            for page, told in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if told not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[told] = json.loads(told) if told else {}
                    known[told]["drop"] = [(x["path"], x["text"]) if isinstance(x, dict) else tuple(x) for x in known[told].get("drop", ())]
                texts.append(main_text(blocks_of(page.as_py() or ""), known[told]))
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(n)], ["page_id", "url", "text", "n_chars"])

    rows = rows.select("page_id", "url", "html", "advice")
    return (rows if own is None else rows.unionByName(own)).mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
