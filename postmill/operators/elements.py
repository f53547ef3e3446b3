"""Whole elements of pages, nested ones too: one pass of a stack automaton over a page's tags, in an Arrow function."""

from __future__ import annotations

import re
from html.entities import name2codepoint
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip_all

#: A tag, a comment, a declaration, or a script or style with what is in it.
TAG = r"""(?is)<!--.*?-->|<(script|style)\b[^>]*+>.*?</\1\s*>|<[!?][^>]*+>|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""

# Fixed values of HTML: elements without an end, elements that the start of another ends, blocks that end a paragraph.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)} | dict.fromkeys(BLOCKS, ("p",))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, in quotes or bare; null if it isn't there or is empty."""
    found = [F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", i) for i in (1, 2, 3)]
    return F.nullif(F.concat(*found), F.lit(""))


#: The same for Python; an element's name, and the whole of a script or style, in groups.
_TAG = re.compile(r"""<!--.*?-->|<(script|style)\b[^>]*+>.*?</\1\s*>|<[!?][^>]*+>|<(/?)(?=([a-z][^\s/>]*+))[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.I | re.S | re.A)
_CLASS = re.compile(r"""[\s"']class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I | re.S | re.A)
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ORDER = itemgetter(0, 1, 2, 3)
_ELEMENT = pa.struct([("at", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("tag", pa.string()), ("parts", pa.list_(pa.string()))])


def _reference(m: re.Match) -> str:
    ref = m[0][1:-1]
    if not ref.startswith("#"):
        return _NAMED.get(ref, m[0])
    code = int(ref[2:], 16) if ref[1] in "xX" else int(ref[1:])
    return chr(code) if 1 <= code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]


def _tag(m: re.Match, wanted: dict[str, str]) -> tuple:
    """(name, whether it closes, whether it opens, what it ends, the selectors it meets, the start tag); a comment or a declaration has none."""
    text, script, slash, name = m.group(0, 1, 2, 3)
    if name is None and script is None:
        return None, False, False, (), (), text
    name = name and name.lower()
    if slash:
        return name, True, False, (), (), text
    if name is None:
        text = text[: text.index(">") + 1]
    met = ()
    if found := _CLASS.search(text):
        css = found[1] or found[2] or found[3] or ""
        names = re.split(r"\s+", css, flags=re.A)
        met = tuple(k for k, s in wanted.items() if (s[1:] in css if s.startswith("*") else s in names))
    return name, False, name is not None and name not in VOID, ENDS.get(name, ()), met, text


def _scan(page: str, wanted: dict[str, str], known: dict[str, tuple]) -> list[tuple]:
    """The elements of a page as (at, end, name, tag, parts); ``known`` keeps what tags were found to say."""
    stack: list[str] = []
    open_: list[tuple] = []  # depth, at, name, tag, parts
    done, at, n = [], 0, 0

    def close(depth: int, end: int) -> None:
        while open_ and open_[-1][0] > depth:
            _, begin, name, tag, parts = open_.pop()
            done.append((begin, end, name, tag, parts))

    def says(text: str) -> None:
        if "&" in text:
            text = _REFERENCES.sub(_reference, text)
        if text := text.strip(_SPACE):
            for o in open_:
                o[4].append(text)

    for m in _TAG.finditer(page):
        start, inside = m.span()
        if open_ and start > at:
            says(page[at:start])
        at, whole = inside, m[0]
        if (tag := known.get(whole)) is None:
            tag = known[whole] = _tag(m, wanted)
        name, closes, pushes, ends, met, text = tag
        if closes:
            if name in stack:
                while stack.pop() != name:
                    pass
                n = len(stack)
                if open_:
                    close(n, start)
            continue
        if ends and stack and stack[-1] in ends:
            stack.pop()
            if stack and stack[-1] in ends:
                stack.pop()
            n = len(stack)
            if open_:
                close(n, start)
        for k in met:
            if pushes:
                open_.append((n + 1, inside, k, text, []))
            else:
                done.append((inside, inside, k, text, []))
        if pushes:
            stack.append(name)
            n += 1
    if open_:
        says(page[at:])
        close(-1, len(page))
    done.sort(key=_ORDER)
    return done


def _scanned(pages: pa.Array, wanted: dict[str, str]) -> pa.Array:
    known: dict[str, tuple] = {}
    out = []
    for page in pages.to_pylist():
        if len(known) > 10_000:  # a memo only
            known.clear()
        out.append(None if page is None else _scan(page, wanted, known))
    flat = [e for found in out if found for e in found]
    ends = list(accumulate((len(found or ()) for found in out), initial=0))
    columns = zip(*flat, strict=True) if flat else [[]] * 5
    rows = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ELEMENT, strict=True)], fields=list(_ELEMENT))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=pa.array([found is None for found in out]))


def marked(page: Column, wanted: dict[str, str]) -> Column:
    """All elements that meet a selector, in order of their start: array of struct(at, end, name, tag, parts).

    ``wanted``: selectors by name, a class or, behind ``*``, a part of the class attribute. ``at`` and ``end``
    bound the element's inside (from 0, in characters), ``tag`` is its start tag, ``parts`` are the pieces of text
    inside it as :func:`text_parts` gives them.

    The automaton keeps the stack of open elements. An end tag closes the innermost open element of its
    name with all that is open inside it, and is ignored if there is none; a start tag first closes what
    can't go on beside it (a list item before the next one, a paragraph before a block); what is open at
    the end of the page ends there. Tags inside comments, scripts and styles don't count. The pass is
    linear in the tags, times the depth. A page without such elements has an empty array, a null page null.
    """
    scan = F.arrow_udf(lambda pages: _scanned(pages, wanted), "array<struct<at:int,end:int,name:string,tag:string,parts:array<string>>>")
    return scan(F.make_valid_utf8(page))


def bodies(page: Column, elements: Column, name: str) -> Column:
    """The markup inside each of the elements of a name."""
    return F.transform(F.filter(elements, lambda e: e["name"] == name), lambda e: F.substring(page, e["at"] + 1, e["end"] - e["at"]))


def start_tags(elements: Column, name: str) -> Column:
    return F.transform(F.filter(elements, lambda e: e["name"] == name), lambda e: e["tag"])


_REFERENCE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_REFERENCES = re.compile(_REFERENCE, re.A)
_NAMED = {name: chr(code) for name, code in {**name2codepoint, "apos": 39}.items()}


def decoded(text: Column) -> Column:
    """Character references as characters, each once; those that name none stay."""
    named = F.str_to_map(F.lit("\x02".join(f"{name}\x01{char}" for name, char in _NAMED.items())), F.lit("\x02"), F.lit("\x01"))

    def char(code: Column) -> Column:
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def one(ref: Column) -> Column:
        inner = F.substring(ref, F.lit(2), F.length(ref) - 2)
        number = F.when(inner.rlike("^#[xX]"), F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10).try_cast("bigint")).when(inner.startswith("#"), F.substring(inner, F.lit(2), F.length(inner)).try_cast("bigint"))
        return F.coalesce(char(number), F.try_element_at(named, inner), ref)

    parts, refs = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    whole = F.array_join(F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(one(r), F.lit("")))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def text_parts(fragment: Column) -> Column:
    """A fragment's pieces of text between tags, each stripped, blank ones left out."""
    pieces = F.transform(F.split(fragment, TAG, -1), lambda p: strip_all(decoded(p)))
    return F.filter(pieces, lambda p: p != "")


def text_of(fragment: Column, between: str = "") -> Column:
    """A fragment's text: its pieces, joined."""
    return F.array_join(text_parts(fragment), between)


def with_parts(page: Column, elements: Column) -> Column:
    """The elements as array of struct(name, tag, parts): the pieces of each one's whole text."""
    return F.transform(elements, lambda e: F.struct(e["name"].alias("name"), e["tag"].alias("tag"), e["parts"].alias("parts")))
