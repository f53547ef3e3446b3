"""URL rules behind a blocked Bloom filter, with DataFrame functions only.

A list entry is a canonical URL prefix (host, path, verdict). It fits its host and all subdomains
where the path starts with the entry's; the longest that fits wins. Each URL is expanded into the
keys that could be listed: its host suffixes times its path prefixes, of the numbers of labels and
the lengths that occur in the list. A blocked Bloom filter (one 256-bit block a key, ``PROBES`` bits in it) passes possible
hits, and an exact hash join with the list removes its false positives.

The filter is built by one grouped bit_or over the list and has a fixed largest size, whatever the
list's; a fuller filter passes more rows to the join but changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Words of 64 bits in a block, bits set for a key, keys for each block when sized, and most blocks (8 MB).
BLOCK_WORDS, PROBES, KEYS_A_BLOCK, MOST_BLOCKS = 4, 6, 20, 1 << 18
#: Lists of up to so many entries (some 200 bytes each) are broadcast in the exact join.
BROADCAST_ENTRIES = 50_000
_SEED = 17


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path: null or no :// gives both empty."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\x1f"), path)


def _spot(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Of a key: its block, and for each word of the block the bits that it sets."""
    h = F.xxhash64(key, F.lit(_SEED))
    block = F.pmod(F.xxhash64(key, F.lit(_SEED + 1)), F.lit(blocks)).cast("int")
    spots = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]
    words = []
    for w in range(BLOCK_WORDS):
        bits = F.lit(0).cast("bigint")
        for s in spots:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), s.bitwiseAND(F.lit(63)))
            bits = bits.bitwiseOR(F.when(F.floor(s / 64) == w, bit).otherwise(F.lit(0).cast("bigint")))
        words.append(bits)
    return block, words


def bloom_words(entries: DataFrame, blocks: int) -> list[int]:
    """The filter's words; at most MOST_BLOCKS * BLOCK_WORDS."""
    block, words = _spot(_key(F.col("r_host"), F.col("r_path")), blocks)
    built = entries.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    built = built.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])
    out = [0] * (blocks * BLOCK_WORDS)
    for r in built.collect():
        out[r["block"] * BLOCK_WORDS : (r["block"] + 1) * BLOCK_WORDS] = list(r)[1:]
    return out


def judge(pages: DataFrame, entries: DataFrame, default: str = "allow", id_col: str = "page_id") -> DataFrame:
    """One row for each row of ``pages`` (id_col, url): id_col, host, path, rule, verdict.

    ``entries``: host, path, verdict; listed canonical URL prefixes. ``rule`` is host and path of
    the longest that fits, else null; ``default`` is the verdict for URLs that nothing fits.

    * A null URL, or one without ://, has an empty host and path; no entry with a host fits.
    * Of entries that repeat host and path the smallest verdict counts ("allow" before "block");
      of different ones of equal length, the one whose host is longer.
    * Entries with a null in host or path are ignored. An empty list gives the default to all.
    * Rows that repeat an id are judged each for itself. Other columns of ``pages`` are ignored.
    """
    listed = entries.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna(subset=["r_host", "r_path"])
    listed = listed.groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    n = listed.count()
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())  # few: lengths, not entries
    labels = sorted(r[0] for r in listed.select(F.size(F.split("r_host", r"\.", -1))).distinct().collect())  # few too
    blocks = max(1, min(MOST_BLOCKS, -(-n // KEYS_A_BLOCK)))
    words = bloom_words(listed, blocks)
    filter_ = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    rows = split_url(pages.select(F.col(id_col).alias("id"), "url"))
    if not lengths:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.", -1)
    counts = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: x <= F.size(parts))
    suffixes = F.transform(counts, lambda x: F.array_join(F.slice(parts, F.size(parts) - x + 1, x), "."))
    prefixes = F.array_distinct(F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x)))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("c_host"), p.alias("c_path")))))

    def passes(c: Column) -> Column:
        block, bits = _spot(_key(c["c_host"], c["c_path"]), blocks)
        tests = [F.get(filter_, block * BLOCK_WORDS + i).bitwiseAND(b) == b for i, b in enumerate(bits)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    possible = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("c", F.explode_outer(F.filter(keys, passes)))
    possible = possible.select("id", "rid", "host", "path", F.col("c.c_host").alias("c_host"), F.col("c.c_path").alias("c_path"))
    if n <= BROADCAST_ENTRIES:
        listed = F.broadcast(listed)
    hits = possible.join(listed, (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path")), "left")
    rule = F.struct((F.length("c_host") + F.length("c_path")).alias("n"), F.length("c_host").alias("m"), F.concat("c_host", "c_path").alias("rule"), "r_verdict")
    best = F.max(F.when(F.col("r_verdict").isNotNull(), rule)).alias("best")  # a page's rows are neighbours: they meet before the shuffle
    out = hits.groupBy("rid", "id", "host", "path").agg(best)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
