"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The corpus's frequent words (pieces that the tokenizer's pattern splits off) are compiled into a
minimal acyclic automaton that shares prefixes and suffixes. Every edge carries the number of
words that sort before it below its state, so that a walk yields the word's index, and the index
its ids: a transducer from words to ids. It is a few flat arrays in one file, which each Python
worker maps into memory; the workers of a machine share its pages. Words that it doesn't accept
are merged exactly by the ranks, once for each batch.

Counts of words are taken over all texts and whole texts. The lexicon's size is bounded
(``LEXICON_WORDS`` of ``WORD_BYTES`` each); which words it holds changes the speed, never the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, share_file, stage_table, whole_text

#: Most words in the lexicon, and least count of a word in it.
LEXICON_WORDS, LEAST_COUNT = 1 << 18, 2
#: Longer words (UTF-8) are not in the lexicon, and words of more characters are neither counted nor remembered by a worker: so all these are bounded in bytes.
WORD_BYTES = 64
#: A worker's counts and memo are emptied beyond so many words, and texts are taken in slices of so many characters.
WORDS_HELD, SLICE_CHARS = 400_000, 1 << 20
_NONE = 1 << 60
#: Fixed: the pattern of byte-level BPE that splits text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for texts of Latin letters, where the standard library's classes agree with the pattern's; all other texts take the pattern.
_LATIN = re.compile(r"[\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
_LATIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


#: Fixed: settings of a tokenizer file that this module follows; a setting that is absent or null asks for nothing.
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_OFF = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


def refuse_other_settings(spec: dict) -> None:
    """ValueError for a tokenizer file that asks for anything but byte-level BPE as it is done here.

    Read are vocabulary, merges and the contents of added tokens; truncation, padding and the
    post-processor play no part in encoding without special tokens.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [f"model.{k}" for k in _OFF if model.get(k)]
    wrong += ["model.type"] * (model.get("type", "BPE") != "BPE")
    wrong += ["normalizer"] * bool(spec.get("normalizer"))
    wrong += ["pre_tokenizer"] * any(split.get(k, True if k == "use_regex" else None) != v for k, v in _SPLIT.items())
    wrong += ["decoder"] * ((spec.get("decoder") or {}).get("type") != "ByteLevel")
    for token in spec.get("added_tokens") or []:
        wrong += [f"added_tokens.{token['content']}.{k}" for k in ("single_word", "lstrip", "rstrip") if token.get(k)]
    if wrong:
        raise ValueError(f"not followed here: {', '.join(wrong)}")


class Merges:
    """Ids and ranks of a byte-level tokenizer file; exact merging of single words."""

    def __init__(self, spec: dict):
        stands = {c: b for b, c in byte_alphabet().items()}
        model = spec["model"]
        self.pieces: dict[int, bytes] = {i: bytes(stands[c] for c in t) for t, i in model["vocab"].items() if all(c in stands for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for text, i in self.special.items():
            self.pieces[i] = text.encode()
        of = {p: i for i, p in self.pieces.items() if i not in self.special.values()}
        self.single = [of.get(bytes([b])) for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for pair in model["merges"]:
            x, y = (bytes(stands[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[of[x], of[y]] = len(self.made)
            self.made.append(of[x + y])
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of lowest rank, leftmost first. A heap keeps long words near-linear."""
        ids, get, made = [self.single[b] for b in word], self.rank.get, self.made
        if len(ids) <= 64:
            ranks = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (least := min(ranks)) < _NONE:
                i = ranks.index(least)
                ids[i] = made[least]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), _NONE)
            return ids
        after, before = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
        heap = [(r, i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made[rank], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i is not None]


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of the words, built from their sorted order, with their ids.

    ``first``: of each state its first edge; ``label``, ``to``, ``skip``: of each edge its byte,
    its target, and how many words sort before those that pass it; ``final``: whether a word ends
    in a state; ``at``, ``ids``: of each word by index its ids.
    """
    order = sorted(words)
    states: list[tuple[bool, tuple]] = []  # final, ((label, target), ...)
    register: dict[tuple, int] = {}

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    stack: list[list] = [[False, []]]  # the open path: final, closed edges, label to the next
    labels: list[int] = []
    last = b""
    for word in order:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        while len(labels) > common:
            target = freeze(stack.pop())
            stack[-1][1].append((labels.pop(), target))
        for b in word[common:]:
            labels.append(b)
            stack.append([False, []])
        stack[-1][0] = True
        last = word
    while labels:
        target = freeze(stack.pop())
        stack[-1][1].append((labels.pop(), target))
    root = freeze(stack.pop())
    below = np.zeros(len(states), np.int64)
    first, label, to, skip = [0], [], [], []
    for s, (final, edges) in enumerate(states):  # targets have lower numbers
        n = int(final)
        for b, t in edges:
            label.append(b)
            to.append(t)
            skip.append(n)
            n += int(below[t])
        below[s] = n
        first.append(len(label))
    at = np.zeros(len(order) + 1, np.int64)
    at[1:] = np.cumsum([len(words[w]) for w in order])
    ids = np.fromiter((i for w in order for i in words[w]), np.uint32, int(at[-1]))
    as32 = lambda x: np.array(x, np.int32)
    return {"root": as32([root]), "first": as32(first), "label": as32(label), "to": as32(to), "skip": as32(skip), "final": np.array([f for f, _ in states], np.int32), "at": at, "ids": ids}


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    NAMES = ("root", "first", "label", "to", "skip", "final", "at", "ids")

    @staticmethod
    def packed(parts: dict[str, np.ndarray]) -> bytes:
        """The file that workers map: a head that says where each array stands, and the arrays."""
        head, at = {}, 0
        for name in Lexicon.NAMES:
            head[name] = [str(parts[name].dtype), at, len(parts[name])]
            at += parts[name].nbytes + -parts[name].nbytes % 8
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        return b"".join([len(text).to_bytes(8, "little"), text, *[parts[name].tobytes() + b"\0" * (-parts[name].nbytes % 8) for name in Lexicon.NAMES]])

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(bytes(whole[:8]), "little")
        for name, (kind, at, length) in json.loads(bytes(whole[8 : 8 + n])).items():
            size = np.dtype(kind).itemsize * length
            setattr(self, name, np.asarray(whole[8 + n + at : 8 + n + at + size].view(kind)))  # still mapped; plain arrays are sliced faster
        self.edge_key = (np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first)) << 8) | self.label  # sorted: states in order, labels in order

    def index(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 for words that it doesn't accept; all words walk at once."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.edge_key):
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        live, state, rank = np.arange(len(words)), np.full(len(words), self.root[0], np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            done = lengths[live] == step
            if done.any():
                ends = done & (self.final[state] == 1)
                out[live[ends]] = rank[ends]
                live, state, rank = live[~done], state[~done], rank[~done]
                if not len(live):
                    break
            key = (state << 8) | flat[starts[live] + step]
            e = np.searchsorted(self.edge_key, key)
            e[e == len(self.edge_key)] = 0
            ok = self.edge_key[e] == key
            e, live = e[ok], live[ok]
            state, rank = self.to[e].astype(np.int64), rank[ok] + self.skip[e]
            step += 1
        return out


def word_pieces(text: str, merges: Merges, pattern) -> Iterator[list[str] | int]:
    """The words of each stretch between special tokens, and the special tokens' ids."""
    for k, part in enumerate(merges.split.split(text) if merges.split else [text]):
        if k % 2:
            yield merges.special[part]
        elif part:
            yield (_LATIN_PATTERN if _LATIN.fullmatch(part) else pattern).findall(part)


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts in slices of bounded length; a longer text is a slice of its own."""
    held, size = [], 0
    for x in column:
        text = x.as_py() or ""
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _counter(spec: dict):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pattern, seen = Merges(spec), regex.compile(PATTERN), Counter()

        def out():
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])

        for batch in batches:
            for texts in _slices(batch.column(0)):
                for text in texts:
                    for part in word_pieces(text, merges, pattern):
                        if not isinstance(part, int):
                            seen.update([w for w in part if len(w) <= WORD_BYTES])  # characters; bytes are looked at behind the shuffle
                if len(seen) > WORDS_HELD:
                    yield out()
                    seen.clear()
        yield out()

    return count


def _frequent(docs: DataFrame, spec: dict, most: int) -> DataFrame:
    """(word): at most ``most`` of the most frequent words of all texts; counted in the tasks before the shuffle.

    All words of at most ``WORD_BYTES`` from a certain count on: steps of counts, not words, are ordered in one place.
    """
    counts = docs.select(whole_text().alias("text")).mapInArrow(_counter(_small(spec)), "word string, n bigint")
    counts = stage_table(counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST_COUNT) & (F.octet_length("word") <= WORD_BYTES)), "words")
    steps = counts.groupBy("n").agg(F.count("*").alias("words"))
    total = F.sum("words").over(Window.orderBy(F.desc("n")))
    fit = steps.withColumn("step", F.floor(F.log2("n") * 64)).groupBy("step").agg(F.sum("words").alias("words"), F.min("n").alias("n"))  # some thousand steps at most
    least = fit.withColumn("total", total).where(F.col("total") <= most).agg(F.min("n")).first()[0]
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word")


def frequent_words(docs: DataFrame, spec: dict, most: int = LEXICON_WORDS) -> list[str]:
    return [r["word"] for r in _frequent(docs, spec, most).collect()]


def _small(spec: dict) -> dict:
    """What counting needs of a tokenizer file: the special tokens."""
    return {"added_tokens": spec.get("added_tokens"), "model": {"vocab": {}, "merges": []}}


class Encoder:
    """Encodes texts with a lexicon and exact merging of the rest."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon, self.pattern = merges, lexicon, regex.compile(PATTERN)
        self.memo: dict[str, np.ndarray] = {}

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        at, merge, found = self.lexicon.index(raw), self.merges.merge, np.zeros((2, len(words)), np.int64)
        known = at >= 0
        if known.any():
            found[0, known], found[1, known] = self.lexicon.at[at[known]], self.lexicon.at[at[known] + 1]
        for w, b, begin, end in zip(words, raw, *found.tolist(), strict=True):
            if end:
                self.memo[w] = self.lexicon.ids[begin:end].tobytes()
            else:
                merged = merge(b)
                self.memo[w] = struct.pack(f"<{len(merged)}I", *merged)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        split = [list(word_pieces(t, self.merges, self.pattern)) for t in texts]
        new = {w for parts in split for part in parts if not isinstance(part, int) for w in part}
        missing = [w for w in new if w not in self.memo]
        if len(self.memo) + len(missing) > WORDS_HELD:
            self.memo.clear()
            missing = list(new)
        self.learn(missing)
        of = self.memo.__getitem__
        ids = [b"".join(part.to_bytes(4, "little") if isinstance(part, int) else b"".join(map(of, part)) for part in parts) for parts in split]
        for w in new:
            if len(w) > WORD_BYTES:
                del self.memo[w]
        return ids


class Decoder:
    """Ids to text: the bytes of all ids, joined, then decoded; broken UTF-8 gives U+FFFD."""

    def __init__(self, merges: Merges):
        self.pieces = merges.pieces

    def decode(self, ids: bytes) -> str:
        of = self.pieces.__getitem__
        return b"".join(map(of, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: Bytes of a compiled lexicon in one row.
_CHUNK = 1 << 21


def _compiled(words: DataFrame, tokenizer: str) -> bytes:
    """The file of the lexicon of ``words``, at most LEXICON_WORDS of WORD_BYTES.

    It is made in one task: ids, states and register of so many words are some hundred MB of Python objects,
    which the driver hasn't room for. Only the packed arrays come to the driver.
    """

    def compile_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(tokenizer), encoding="utf-8") as f:
            merges = Merges(json.load(f))
        packed = Lexicon.packed(compile_lexicon({(b := w.encode()): merges.merge(b) for batch in batches for w in batch.column(0).to_pylist()}))
        for at in range(0, len(packed), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed[at : at + _CHUNK]], pa.binary())], ["at", "part"])

    parts = words.repartition(1).mapInArrow(compile_words, "at bigint, part binary").collect()
    return b"".join(bytes(r["part"]) for r in sorted(parts, key=lambda r: r["at"])) or Lexicon.packed(compile_lexicon({}))


def prepare(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS) -> tuple[str, str]:
    """Count words and compile the lexicon; names of the lexicon's and the tokenizer's file, which all workers get."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    refuse_other_settings(spec)
    small, tokenizer = _small(spec), share_file(docs.sparkSession, "tokenizer", text.encode())
    del spec, text
    return share_file(docs.sparkSession, "lexicon", _compiled(_frequent(docs, small, most), tokenizer)), tokenizer


_LOADED: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def _load(names: tuple[str, str]) -> tuple[Encoder, Decoder]:
    """A worker's encoder and decoder; its later tasks find the memo filled."""
    if names not in _LOADED:
        _LOADED.clear()
        with open(SparkFiles.get(names[1]), encoding="utf-8") as f:
            merges = Merges(json.load(f))
        _LOADED[names] = Encoder(merges, Lexicon(SparkFiles.get(names[0]))), Decoder(merges)
    return _LOADED[names]


@releasing
def encode_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, with_decoded: bool | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``with_ids`` adds ids (binary, little-endian unsigned 32-bit), ``with_decoded`` decoded (string);
    if that isn't said, both or none.

    * A null or empty text has no ids; special tokens' strings in a text give their ids.
    * doc_id is passed through, nulls and repeated ones too. No rows in, no rows out.
    * Texts and words of any length are encoded whole. Other columns of ``docs`` are ignored.
    * A tokenizer file with settings that aren't followed here raises a ValueError.
    """
    files = prepare(docs, tokenizer_path)
    with_decoded = with_ids if with_decoded is None else with_decoded

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _load(files)
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(1)):
                ids = encoder.encode(texts)
                decoded = [decoder.decode(x) for x in ids]
                columns = [
                    batch.column(0).slice(done, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                if with_decoded:
                    columns.append(pa.array(decoded, pa.string()))
                    names.append("decoded")
                done += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_decoded
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Texts of rows with ids (binary, as :func:`encode_documents` returns them; null: null): doc_id, text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    refuse_other_settings(spec)
    shared = encoded.sparkSession.sparkContext.broadcast(json.dumps(spec))  # one tokenizer file, of fixed size

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Merges(json.loads(shared.value)))
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(decode, "doc_id bigint, text string")
