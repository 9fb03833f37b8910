"""Byte-level BPE over a table of distinct words, and decoding by an id-to-piece join.

A word is a run of white space with the run of other characters after it. The pre-tokenizer's
pattern never matches across the start of a white-space run that follows another character, so
the ids of a text are the ids of its words in order. Words are split in Spark; each distinct
word is encoded once by the library; ids go back to the documents by position.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, Protocol, exchange, fans_for, gather, ids_from_bytes, ids_to_bytes, narrow, pack, unpack
from .common import parts_for, tune

_WORDS = re.compile(r"\s*\S+|\s+")
#: Python takes these for white space and Unicode does not: a text with one is one word.
_ODD = re.compile("[\x1c-\x1f]")
#: Input bytes for each part of the word table.
PART_BYTES = 16 << 20
#: Words filled in at a time.
FILL_WORDS = 1 << 18


def split_words(text: str) -> list[str]:
    if _ODD.search(text):
        return [text]
    return _WORDS.findall(text)


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _asks(words: list[bytes], part: np.ndarray, n_parts: int) -> tuple[np.ndarray, list[bytes | None]]:
    """Where each word stands by part, and the parts' words, in order within a part."""
    by_part = np.argsort(part, kind="stable")
    place = np.empty(len(words), "<u4")
    place[by_part] = np.arange(len(words))
    asks: list[bytes | None] = []
    for at in np.split(by_part, np.searchsorted(part[by_part], np.arange(1, n_parts))):
        own = [words[i] for i in at]
        asks.append(pack(narrow(np.fromiter(map(len, own), "<u4", len(own))), b"".join(own)) if own else None)
    return place, asks


def _make(n_leaves: int, n_parts: int):
    stride = n_leaves // n_parts

    def make(ids: pa.Array, texts: list[bytes]) -> tuple[bytes, list[bytes | None]]:
        slots: defaultdict[str, int] = defaultdict(count().__next__)
        seqs = []
        for k, t in enumerate(texts):
            seqs.append(np.fromiter(map(slots.__getitem__, split_words(t.decode("utf-8", "replace"))), "<u4"))
            texts[k] = b""  # its words are counted; a block's texts and words are not held at once
        words = [w.encode() for w in slots]
        slots.clear()
        seq, lengths = np.concatenate(seqs), np.fromiter(map(len, seqs), "<u4", len(seqs))
        seqs.clear()
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), "<u4")
        rank[order] = np.arange(len(words))
        words = [words[i] for i in order]
        part = np.fromiter((zlib.crc32(w) % n_leaves // stride for w in words), "<u4", len(words))
        return pack(ids_to_bytes(ids), lengths, rank[seq], narrow(part)), _asks(words, part, n_parts)[1]

    return make


def _numbered(asks: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of asks, and the number of each word of each ask."""
    slots: defaultdict[bytes, int] = defaultdict(count().__next__)
    seqs = []
    for a in asks:
        lengths, raw = unpack(a)
        seqs.append(np.fromiter(map(slots.__getitem__, _cut(lengths, raw)), "<i8", len(lengths)))
    return list(slots), seqs


def _split(n_leaves: int):
    def split(asks: list[bytes], stride: int, fan: int) -> tuple[bytes, list[bytes | None]]:
        words, seqs = _numbered(asks)
        part = np.fromiter((zlib.crc32(w) % n_leaves // stride % fan for w in words), "<u4", len(words))
        place, kids = _asks(words, part, fan)
        return pack(np.fromiter(map(len, seqs), "<u4", len(seqs)), place[np.concatenate(seqs)], narrow(np.sort(part))), kids

    return split


def _filled(part: np.ndarray, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, starts, ids) of words, given the part of each."""
    lengths, starts, flat, base = np.zeros(len(part), "<i8"), np.zeros(len(part), "<i8"), [], 0
    for p, reply in replies.items():
        n, ids = unpack(reply)
        at = np.nonzero(part == p)[0]
        lengths[at] = n
        starts[at] = base + np.cumsum(n, dtype="<i8") - n
        flat.append(ids)
        base += len(ids)
    return lengths, starts, np.concatenate(flat) if flat else np.zeros(0, "<u2")


def _join(own: bytes, replies: dict[int, bytes]) -> list[bytes]:
    sizes, seq, part = unpack(own)
    lengths, starts, values = _filled(part, replies)
    return [pack(narrow(lengths[s]), values[gather(starts[s], lengths[s])]) for s in np.split(seq, np.cumsum(sizes)[:-1])]


def _cut(lengths: np.ndarray, raw: bytes) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends)]


def _answer(path: str):
    def answer(asks: list[bytes]) -> tuple[list[bytes], list[int]]:
        words, seqs = _numbered(asks)
        t = load_tokenizer(path)
        lengths, ids = np.zeros(len(words), "<u4"), []
        for k in range(0, len(words), 4096):
            got = [e.ids for e in t.encode_batch_fast([w.decode() for w in words[k : k + 4096]], add_special_tokens=False)]
            lengths[k : k + len(got)] = [len(x) for x in got]
            ids.append(np.fromiter((i for x in got for i in x), "<u4"))
        flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        starts = np.cumsum(lengths, dtype="<i8") - lengths
        small = flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 else flat
        return [pack(narrow(lengths[s]), small[gather(starts[s], lengths[s].astype("<i8"))]) for s in seqs], []

    return answer


def _id_lists(ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, lists], ["id", "ids"])


def _fill(finish: Callable, own: bytes, _made: list, replies: dict[int, bytes]) -> pa.Table:
    raw_ids, doc_lengths, seq, part = unpack(own)
    lengths, starts, values = _filled(part, replies)
    words = np.concatenate([[0], np.cumsum(doc_lengths, dtype="<i8")])
    doc_ids, out, at = ids_from_bytes(raw_ids), [], 0
    while at < len(doc_ids):  # a bounded number of words at a time, one document at least
        to = max(at + 1, int(np.searchsorted(words, words[at] + FILL_WORDS, "right")) - 1)
        some = seq[words[at] : words[to]]
        n = lengths[some]
        ends = np.concatenate([[0], np.cumsum(n)])[words[at : to + 1] - words[at]]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(values[gather(starts[some], n)].astype("<i4")))
        out.append(finish(doc_ids.slice(at, to - at), lists))
        at = to
    return pa.Table.from_batches(out)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids array<int>, as the library encodes the whole text
    with add_special_tokens=False and no truncation or padding.

    Null counts as empty and gives an empty list; repeated ids and rows each give a row; an
    empty table gives none. Other columns of docs are ignored, whatever their names.
    `tokenizer` is the path of a byte-level tokenizer file without a normalizer, readable
    by every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return _encode(docs, tokenizer, id_col, text_col, _id_lists, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _encode(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, finish: Callable, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    with open(tokenizer) as f:
        spec = json.load(f)
    if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("words are independent only under a plain byte-level pre-tokenizer")
    if any(a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"]):
        raise ValueError("an added token reaches over white space")
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fans = fans_for(parts_for(docs, PART_BYTES))
    n = prod(fans)
    says = Protocol(_make(n, fans[0]), _split(n), _join, _answer(tokenizer), functools.partial(_fill, finish))
    return exchange(rows, fans, says, schema, "bpe", block_bytes=block_bytes)


@functools.lru_cache(maxsize=4)
def piece_table(tokenizer: str) -> pa.Array:
    """The bytes of every id, in order; ids without a piece are null."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    vocab = load_tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    pieces: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return pa.array(pieces, pa.binary())


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids, special tokens included, in out_col.

    The id-to-piece table has one row per vocabulary entry, so every task joins its ids with a
    copy of it. Null ids give null; ids outside the vocabulary have no piece and add nothing;
    bytes that are not UTF-8 become U+FFFD.
    """
    tune(encoded.sparkSession)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return join_pieces(ids, piece_table(tokenizer))

    return encoded.withColumn(out_col, run(F.col(ids_col)))


def join_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    flat = ids.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
    got = pc.fill_null(pieces.take(pc.if_else(known, flat, None)), b"")
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    ends = np.asarray(pc.cast(pc.binary_length(got), pa.int64())) if len(got) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(ends)])[offsets]
    data = b"".join(got.to_pylist()) if len(got) < 1024 else bytes(memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), got), b"")[0].as_buffer()))
    texts = [data[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])]
    return pa.array(texts, pa.string(), mask=np.asarray(ids.is_null()))


def _digest_rows(ids: pa.ListArray, pieces: pa.Array) -> list[pa.Array]:
    """Token counts and SHA-256 of ids (little-endian u32) and of the decoded text."""
    flat, off = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
    shas = [hashlib.sha256(flat[i:j]).hexdigest() for i, j in zip(off[:-1], off[1:])]
    texts = join_pieces(ids, pieces).cast(pa.binary())
    return [pa.array(np.diff(off).astype(np.int64)), pa.array(shas, pa.string()), pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())]


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every row: encode, then decode by piece.

    The same work as decode(encode(docs)), in the worker that fills a block in, so that ids do
    not travel to the JVM and back. Rows are those of encode.
    """
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def finish(ids: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *_digest_rows(lists, piece_table(tokenizer))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encode(docs, tokenizer, id_col, text_col, finish, schema, block_bytes).withColumnRenamed("id", id_col)
