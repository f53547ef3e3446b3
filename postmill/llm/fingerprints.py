"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is cut into paragraphs (lines), and these into pieces: a piece ends with its paragraph, or with
a word whose hash says so: one of FINE words among a text's first FINE_WORDS, one of COARSE behind them
(what ends a piece there does so here too). That is one rule for all texts, whatever their length: borders
depend on the words themselves, and a word that comes or goes changes a piece or two. Words of over
CHUNK bytes (writing without spaces) count as words of CHUNK characters. The digests of the pieces
(the n-th repetition of a piece has a digest of its own) go into the cells of a sketch: each
digest into one cell of each of three rows; a cell keeps its count, the xor of its digests and the
xor of their check hashes. Two sketches subtract cell by cell: what both have cancels, and peeling
(take a cell that holds one digest, remove that from its other cells, again) recovers the digests
that differ. The fingerprint is the sketch of FIRST_CELLS cells. Where its difference can't be
peeled, larger sketches of the same digests are made: they are parted by their leading bits into sub-sketches
of 12 cells for a few differences each, and a sub-sketch that fails is retried with 24, 48 and 96
cells under other hashes. What fails even then (its chance is below 1e-6) is compared digest by
digest, so that likeness is exact: common pieces to all pieces, repetitions counted.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, whole_text

#: Cells of the fingerprint, and of the sub-sketches tried one after the other; three rows of a power of two.
FIRST_CELLS, RETRY_CELLS = 12, (12, 24, 48, 96)
#: Expected digests of a sub-sketch, and most buckets of the order by id (their first keys go to the driver, 16 bytes each).
PART_KEYS, MOST_BUCKETS = 4, 1 << 16
#: Expected words of a piece among a text's first FINE_WORDS words (and line breaks), and behind them: a multiple of the former.
FINE_WORDS, FINE, COARSE = 48, 4, 24
#: Bytes beyond which a word is cut, into parts of so many characters.
CHUNK = 32
_NAMES = itertools.count()


def _fresh(stem: str) -> str:
    return f"{stem}_{next(_NAMES)}"


def _let(value: str, body: Callable[[str], str]) -> str:
    """body(value), with value computed once."""
    x = _fresh("v")
    return f"get(transform(array({value}), {x} -> {body(x)}), 0)"


def words_of(text: str) -> str:
    """The words of a text (all but U+0020 and U+0009 to U+000D), line breaks as words of their own, long words in parts."""
    x = _fresh("x")
    spaced = f"replace({text}, char(10), concat(' ', char(10), ' '))"
    plain = f"if({text} rlike '[\\\\x09\\\\x0B-\\\\x0D]', translate({spaced}, concat(char(9), char(11), char(12), char(13)), '    '), {spaced})"
    parts = lambda w: f"if(exists({w}, {x} -> octet_length({x}) > {CHUNK}), flatten(transform({w}, {x} -> if(octet_length({x}) > {CHUNK}, regexp_extract_all({x}, '(?s).{{1,{CHUNK}}}', 0), array({x})))), {w})"
    return _let(f"array_remove(split({plain}, ' '), '')", parts)


def digests(text: str) -> str:
    """Digests of the text's pieces; the n-th of equal pieces has its own. Linear in the text, but for a sort of its pieces."""
    x, i, j = _fresh("x"), _fresh("i"), _fresh("j")

    def cut(w: str) -> str:
        border = f"pmod(xxhash64(get({w}, {x} - 1)), if({x} <= {FINE_WORDS}, {FINE}, {COARSE})) = 0"
        ends = f"filter(sequence(1, size({w})), {x} -> get({w}, {x} - 1) <> char(10) and ({x} = size({w}) or get({w}, {x}) = char(10) or {border}))"
        pieces = _let(ends, lambda e: f"transform({e}, ({x}, {i}) -> xxhash64(slice({w}, coalesce(get({e}, {i} - 1), 0) + 1, {x} - coalesce(get({e}, {i} - 1), 0)), 31))")
        return f"if(size({w}) = 0, cast(array() as array<bigint>), {pieces})"

    def numbered(a: str) -> str:
        """The runs of equal pieces of a sorted array, each member numbered."""
        starts = f"filter(sequence(1, size({a})), {x} -> {x} = 1 or get({a}, {x} - 1) <> get({a}, {x} - 2))"
        runs = _let(starts, lambda s: f"flatten(transform({s}, ({x}, {i}) -> transform(sequence(0, coalesce(get({s}, {i} + 1), size({a}) + 1) - {x} - 1), {j} -> xxhash64(get({a}, {x} - 1), {j}))))")
        return f"if(size({a}) = 0, {a}, {runs})"

    return _let(f"array_sort({_let(words_of(text), cut)})", numbered)


def _placed(keys: str, cells: int, sign: int) -> str:
    """Each digest with its sign, its check hash and its cells, one in each row."""
    row, k, h = cells // 3, _fresh("k"), _fresh("h")
    at = _let(f"xxhash64({k}, {cells})", lambda h: "array(" + ", ".join(f"cast(shiftrightunsigned({h}, {16 * j}) & {row - 1} as int) + {j * row}" for j in range(3)) + ")")
    return f"transform({keys}, {k} -> named_struct('n', {sign}, 'key', {k}, 'check', xxhash64({k}, 77), 'at', {at}))"


def _cells(placed: str, cells: int) -> str:
    """Of every cell: signed count, xor of digests and xor of check hashes."""
    c, k, s, row = _fresh("c"), _fresh("k"), _fresh("s"), cells // 3
    add = f"named_struct('n', {s}.n + {k}.n, 'key', {s}.key ^ {k}.key, 'check', {s}.check ^ {k}.check)"
    empty = "named_struct('n', 0, 'key', 0L, 'check', 0L)"
    return _let(placed, lambda a: f"transform(sequence(0, {cells - 1}), {c} -> aggregate(filter({a}, {k} -> get({k}.at, {c} div {row}) = {c}), {empty}, ({s}, {k}) -> {add}))")


def sketch(keys: str, cells: int) -> str:
    return _cells(_placed(keys, cells, 1), cells)


def subtract(a: str, b: str) -> str:
    x, y = _fresh("x"), _fresh("y")
    return f"zip_with({a}, {b}, ({x}, {y}) -> named_struct('n', {x}.n - {y}.n, 'key', {x}.key ^ {y}.key, 'check', {x}.check ^ {y}.check))"


def peel(cells: str, size: int) -> str:
    """How many digests of a subtracted sketch are only in its left and only in its right side; null if some can't be recovered.

    A round takes the cells of one row that hold a single digest (a digest has one cell in a row,
    so none is taken twice) and removes those from all rows.
    """
    row = size // 3
    state, r, c, i, p, s, g, h = (_fresh(x) for x in ("state", "r", "c", "i", "p", "s", "g", "h"))
    at = _let(f"xxhash64({c}.key, {size})", lambda h: "array(" + ", ".join(f"cast(shiftrightunsigned({h}, {16 * j}) & {row - 1} as int) + {j * row}" for j in range(3)) + ")")
    alone = f"filter(slice({state}.cells, ({r} % 3) * {row} + 1, {row}), {c} -> abs({c}.n) = 1 and xxhash64({c}.key, 77) = {c}.check)"
    pure = f"transform({alone}, {c} -> named_struct('n', {c}.n, 'key', {c}.key, 'check', {c}.check, 'at', {at}))"
    remove = f"named_struct('n', {s}.n - {g}.n, 'key', {s}.key ^ {g}.key, 'check', {s}.check ^ {g}.check)"

    def after(pure: str) -> str:
        left = f"transform({state}.cells, ({c}, {i}) -> aggregate(filter({pure}, {g} -> get({g}.at, {i} div {row}) = {i}), {c}, ({s}, {g}) -> {remove}))"
        count = lambda sign: f"size(filter({pure}, {g} -> {g}.n = {sign}))"
        return f"if(size({pure}) = 0, {state}, named_struct('cells', {left}, 'a', {state}.a + {count(1)}, 'b', {state}.b + {count(-1)}))"

    begin = f"named_struct('cells', {cells}, 'a', 0, 'b', 0)"
    rounds = 3 * (2 + size // 12)
    end = f"aggregate(sequence(0, {rounds - 1}), {begin}, ({state}, {r}) -> {_let(pure, after)})"
    done = lambda x: f"if(exists({x}.cells, {p} -> {p}.n <> 0 or {p}.key <> 0 or {p}.check <> 0), null, named_struct('a', {x}.a, 'b', {x}.b))"
    return _let(end, done)


def _parted(a: str, b: str) -> str:
    """How many digests are only in a, and only in b, by sub-sketches of the digests' leading bits."""
    bits = f"least(24, greatest(0, cast(ceil(log2((size({a}) + size({b})) / {PART_KEYS}D)) as int)))"

    def one(x: str, y: str) -> str:
        tried = [peel(_cells(f"concat({_placed(x, m, 1)}, {_placed(y, m, -1)})", m), m) for m in RETRY_CELLS]
        rest = f"named_struct('a', size(array_except({x}, {y})), 'b', size(array_except({y}, {x})))"  # what no sketch recovers
        return f"coalesce({', '.join(tried)}, {rest})"

    def side(keys: str, n: str) -> str:
        """The sorted digests, and where those of each value of the leading bits begin (and the last end), by binary search."""
        g, lo, step, i = _fresh("g"), _fresh("lo"), _fresh("step"), _fresh("i")
        steps = lambda k: f"transform(sequence(cast(ceil(log2(size({k}) + 1)) as int), 0, -1), {i} -> shiftleft(1, {i}))"
        first = f"shiftleft(cast({g} as bigint) - shiftleft(1L, {n} - 1), 64 - {n})"
        below = lambda k, by: _let(first, lambda v: f"aggregate({by}, 0, ({lo}, {step}) -> if({lo} + {step} <= size({k}) and get({k}, {lo} + {step} - 1) < {v}, {lo} + {step}, {lo}))")
        at = lambda k, by: f"transform(sequence(0, shiftleft(1, {n})), {g} -> case when {g} = 0 then 0 when {g} = shiftleft(1, {n}) then size({k}) else {below(k, by)} end)"
        return _let(f"array_sort({keys})", lambda k: _let(steps(k), lambda by: f"named_struct('k', {k}, 'at', {at(k, by)})"))

    def pick(x: str, g: str) -> str:
        return f"slice({x}.k, get({x}.at, {g}) + 1, get({x}.at, {g} + 1) - get({x}.at, {g}))"

    def part(sides: str, g: str) -> str:
        same = "named_struct('a', 0, 'b', 0)"
        return _let(f"named_struct('x', {pick(sides + '.a', g)}, 'y', {pick(sides + '.b', g)})", lambda s: f"if({s}.x = {s}.y, {same}, {one(s + '.x', s + '.y')})")

    g, s, x = _fresh("g"), _fresh("s"), _fresh("x")
    sides = _let(bits, lambda n: f"named_struct('a', {side(a, n)}, 'b', {side(b, n)})")
    parts = _let(sides, lambda both: f"transform(sequence(0, size({both}.a.at) - 2), {g} -> {part(both, g)})")
    return f"aggregate({parts}, named_struct('a', 0, 'b', 0), ({s}, {x}) -> named_struct('a', {s}.a + {x}.a, 'b', {s}.b + {x}.b))"


def differences(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """struct(a, b): digests only in a, only in b. First by the fingerprints, then by larger sketches."""
    return f"coalesce({peel(subtract(sketch_a, sketch_b), FIRST_CELLS)}, {_parted(a, b)})"


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """Common digests to all digests of both; two texts without pieces are alike."""
    out = lambda d: f"if(size({a}) + {d}.b = 0, 1D, cast(size({a}) - {d}.a as double) / (size({a}) + {d}.b))"
    return F.expr(_let(differences(a, b, sketch_a, sketch_b), out))


def as_text(keys: str, cells: str) -> Column:
    """A fingerprint: its pieces, and the cells in hexadecimal, whole: what :func:`from_text` reads can be subtracted and peeled."""
    return F.expr(f"lower(concat(size({keys}), ':', array_join(transform({cells}, c -> concat_ws('.', hex(c.n), hex(c.key), hex(c.check))), ',')))")


def from_text(fingerprint: str) -> str:
    """The cells of a fingerprint that :func:`as_text` wrote."""
    c, x = _fresh("c"), _fresh("x")
    number = lambda i: f"cast(conv(get(split({c}, '[.]'), {i}), 16, -10) as bigint)"
    return f"transform(split(substring_index({fingerprint}, ':', -1), ','), {c} -> named_struct('n', cast({number(0)} as int), 'key', {number(1)}, 'check', {number(2)}))"


def _bucket(heads: list[tuple[int, int]]) -> Column:
    """How many of the ascending ``heads`` (order_id, tie) are below the row's, by binary search."""
    table = F.from_json(F.lit("[" + ",".join(f'{{"order_id":{i},"tie":{t}}}' for i, t in heads) + "]"), "array<struct<order_id:bigint,tie:bigint>>")
    step, steps = 1, []
    while step <= len(heads):
        steps.insert(0, step)
        step *= 2
    below = lambda at: F.get(table, at - 1) < F.struct("order_id", "tie")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= len(heads)) & below(lo + s), lo + s).otherwise(lo))


def with_next(docs: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text (null: empty) and next_text: of the next document by descending id, after the last the first.

    ``more``: SQL by name that is computed once for each text and comes beside it, as name and next_name.

    Null ids come last; rows that repeat an id follow a hash of their text. Keys are dealt into
    ranges (four for each shuffle partition), also between rows that repeat an id, so the texts move
    once and no task holds the whole order; the first document of the range below is put behind the
    last of each.
    """
    lowest = -(2**63)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumns({"order_id": F.coalesce("doc_id", F.lit(lowest)), "tie": F.xxhash64("text")})
    n = min(MOST_BUCKETS, 4 * shuffle_width(docs.sparkSession))
    ranges = rows.select("order_id", "tie").repartitionByRange(n, "order_id", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("order_id", "tie")).alias("h"))
    heads = sorted((r["h"]["order_id"], r["h"]["tie"]) for r in ranges.collect())  # at most MOST_BUCKETS
    rows = rows.withColumn("bucket", _bucket(heads) if heads else F.lit(0))
    below = [(i, *heads[i - 1]) for i in range(len(heads))]  # the lowest range wraps around
    more = {name: F.expr(sql) for name, sql in (more or {}).items()}
    whose = F.lit(None).cast("array<struct<g_bucket:int,g_id:bigint,g_tie:bigint>>")
    if below:
        whose = F.from_json(F.lit("[" + ",".join(f'{{"g_bucket":{b},"g_id":{i},"g_tie":{t}}}' for b, i, t in below) + "]"), "array<struct<g_bucket:int,g_id:bigint,g_tie:bigint>>")
    ghosts = docs.sparkSession.range(1).select(F.inline(whose))
    ghosts = rows.join(F.broadcast(ghosts), (F.col("order_id") == F.col("g_id")) & (F.col("tie") == F.col("g_tie"))).dropDuplicates(["g_bucket"])
    ghosts = ghosts.select("doc_id", "text", "order_id", "tie", F.col("g_bucket").alias("bucket"), F.lit(True).alias("ghost")).withColumns(more)
    both = rows.select("doc_id", "text", "order_id", "tie", "bucket", F.lit(False).alias("ghost")).withColumns(more).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy(F.col("ghost"), F.col("order_id").desc(), F.col("tie").desc())
    names = ["text", *more]
    return both.withColumns({f"next_{x}": F.lead(x).over(order) for x in names}).where(~F.col("ghost")).select("doc_id", *names, *[f"next_{x}" for x in names])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), as the contract of op10 says.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The two
    fingerprints of a likeness are of one grain: each text's digests are made once.

    * A null text is the empty text; two texts without words are alike (1.0), one without isn't like others (0.0).
    * Order: see :func:`with_next`. A table of one row is its own next document.
    * Texts of any length are taken whole. Other columns of ``docs`` are ignored. No rows in, no rows out.
    """
    rows = with_next(docs, {"a": digests("text")}).withColumns({"n_chars": F.length("text").cast("bigint"), "next_text": F.coalesce("next_text", F.lit(""))})
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    steps = [
        {"b": "coalesce(next_a, cast(array() as array<bigint>))", "e": digests("edited")},
        {"s_a": sketch("a", FIRST_CELLS), "s_e": sketch("e", FIRST_CELLS), "s_b": sketch("b", FIRST_CELLS)},
    ]
    for step in steps:
        rows = rows.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("a", "s_a").alias("fingerprint"),
        as_text("e", "s_e").alias("edited_fingerprint"),
        likeness("a", "e", "s_a", "s_e").alias("near_edited"),
        likeness("a", "b", "s_a", "s_b").alias("near_next"),
    )
