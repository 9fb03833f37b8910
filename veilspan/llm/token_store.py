"""Token ids in Parquet list columns, laid out for selective reads.

One file per range of ids, sorted by id. The token lists are dictionary-encoded (a vocabulary
of 49k fits one dictionary page of 200 kB), ids and offsets are delta-encoded, row groups and
pages are small, and the writer leaves column and offset indexes, so a reader that wants a few
documents, or only the metadata columns, touches only those pages.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import gather
from .bpe import load_tokenizer
from .common import give_back, parts_for, scratch_path, tune

END_ID = 1
#: Text bytes of a file, at least, and files of a table, at most: past that, files grow.
FILE_BYTES, MOST_FILES = 16 << 20, 100_000
#: Text bytes encoded at a time, and words in a worker's memo; it is emptied once there are more.
STEP_BYTES, MEMO = 4 << 20, 600_000

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
}


@functools.lru_cache(maxsize=4)
def _splits_at_space(tokenizer: str) -> bool:
    """Whether ids of a text are the ids of its white-space separated words."""
    with open(tokenizer) as f:
        spec = json.load(f)
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    known = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in steps)
    pre = spec["pre_tokenizer"].get("pretokenizers", [{}])
    drops = pre[0].get("type") == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not re.search(r"\\s[+*?]", pre[0]["pattern"]["Regex"])
    plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"])
    return bool(steps) and known and drops and plain


_PIECE = re.compile(r"[^\W\d_]+|[\W\d_]+")


@functools.lru_cache(maxsize=4)
def _word_ends(tokenizer: str) -> np.ndarray:
    """Whether each id closes a word."""
    vocab = load_tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return out


#: Latin letters; in lower case they are one word to the pre-tokenizer.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+").fullmatch
_BEYOND = re.compile("[\u0250-\U0010ffff]")


def _is_plain(piece: str) -> bool:
    return bool(_LATIN(piece)) and (piece.isascii() or piece == piece.lower())


class _Pool:
    """Items numbered as they come, each with its ids in one flat array."""

    def __init__(self) -> None:
        self.slots: defaultdict = defaultdict(count().__next__)
        self.lengths, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<i4")

    def number(self, items: Iterable, n: int, resolve: Callable) -> np.ndarray:
        """Slots of n items; resolve(new items) -> (flat ids, lengths) is called for those not seen."""
        known = len(self.slots)
        got = np.fromiter(map(self.slots.__getitem__, items), np.int64, n)
        if len(self.slots) > known:
            flat, lengths = resolve(list(islice(self.slots, known, None)))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        return got

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lengths[slots]
        return self.flat[gather(self.starts[slots], n)], n


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), "<i4"), np.fromiter(map(len, lists), np.int64, len(lists))


def _resolve_pieces(tokenizer: str):
    """Ids of new pieces. Plain ones are encoded many at a time, each ending at a word end."""
    t, ends = load_tokenizer(tokenizer), _word_ends(tokenizer)

    def run(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, rest = [], []
        for i, p in enumerate(pieces):
            (plain if _is_plain(p) else rest).append(i)
        flat, lengths, order = [], [], []
        for k in range(0, len(plain), 1 << 14):
            part = [pieces[i] for i in plain[k : k + (1 << 14)]]
            ids = np.concatenate([np.array(e.ids, "<i4") for e in t.encode_batch_fast([" ".join(part[a : a + 128]) for a in range(0, len(part), 128)], add_special_tokens=False)])
            cuts = np.nonzero(ends[ids])[0] + 1
            if len(cuts) == len(part):
                order += plain[k : k + (1 << 14)]
                flat.append(ids)
                lengths.append(np.diff(cuts, prepend=0))
            else:  # some word did not end where its letters do: one by one
                rest += plain[k : k + (1 << 14)]
        for k in range(0, len(rest), 4096):
            ids, n = _flat([e.ids for e in t.encode_batch_fast([pieces[i] for i in rest[k : k + 4096]], add_special_tokens=False)])
            flat.append(ids)
            lengths.append(n)
        n = np.concatenate(lengths)
        back = np.argsort(np.array([*order, *rest]), kind="stable")
        return np.concatenate(flat)[gather((np.cumsum(n) - n)[back], n[back])], n[back]

    return run


def _split_words(words: list[str]) -> tuple[list[str], np.ndarray]:
    """(pieces, pieces of each word): runs of letters and of other characters, in lower case.

    The pre-tokenizer never joins such runs unless an apostrophe stands between them; words with
    one, and those beyond Latin, stay whole and as they are.
    """
    pieces: list[str] = []
    n = np.ones(len(words), np.int64)
    for i, (w, low) in enumerate(zip(words, " ".join(words).lower().split(" "))):
        if _is_plain(low):
            pieces.append(low)
        elif "'" in w or "<|" in w or _BEYOND.search(low):
            pieces.append(w)
        else:
            own = _PIECE.findall(low)
            n[i] = len(own)
            pieces += own
    return pieces, n


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str):
    """texts -> (flat ids, lengths), as the library encodes each whole text, END_ID after it.

    A worker that is used again keeps its memo from task to task.
    """
    t, by_word = load_tokenizer(tokenizer), _splits_at_space(tokenizer)
    words, pieces, resolve = _Pool(), _Pool(), _resolve_pieces(tokenizer) if by_word else None

    def resolve_words(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own, n = _split_words(new)
        got, lengths = pieces.ids(pieces.number(own, len(own), resolve))
        return got, np.add.reduceat(lengths, np.cumsum(n) - n)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal words, pieces
        if not by_word:
            return _flat([[*e.ids, END_ID] for e in t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        if len(words.slots) > MEMO:
            words, pieces = _Pool(), _Pool()
        # Split and told apart by Arrow, so that Python sees each distinct word of a step once.
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        which, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
        if "" in distinct:  # white space at an end of a text
            keep = which != distinct.index("")
            which, doc = which[keep], doc[keep]
            distinct[distinct.index("")] = "a"  # nothing refers to it now
        slots = words.number(distinct, len(distinct), resolve_words)
        ids, lengths = words.ids(slots[which])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(np.bincount(doc, minlength=len(texts)))]
        return np.insert(ids, ends, END_ID), np.diff(ends, prepend=0) + 1

    return run


def _rows(tokenizer: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            if not len(texts):
                continue
            sizes, at = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64), 0
            while at < len(texts):  # so many bytes at a time, one document at least
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_BYTES, "right")))
                flat, n = encode(texts.slice(at, to - at))
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, to - at).cast(id_type), pa.array(np.full(len(n), shard, "<i4")), pa.array(before + ends[:-1]), pa.array(n), lists],
                    ["id", "shard", "before", "n_tokens", "tokens"],
                )
                before += int(ends[-1])
                at = to
        give_back()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write docs' token ids, each with END_ID after it, to a folder of Parquet files.

    Columns: id_col, shard (the file's place in ascending id order), before (ids of the same
    file's earlier documents), n_tokens, tokens. Null text counts as empty, null ids come
    first; rows of one id stand next to one another in order of a hash of the text, then the
    text, so a task that is run again writes the same rows at the same places. A file holds about
    file_bytes of text, more where that would make over MOST_FILES files. Other columns are ignored.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    kind = rows.schema["id"].dataType
    n_files = min(parts_for(docs, file_bytes, 1), MOST_FILES)
    sorted_rows = rows.repartitionByRange(n_files, "id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    out = sorted_rows.mapInArrow(_rows(tokenizer, to_arrow_type(kind)), f"id {kind.simpleString()}, shard int, before bigint, n_tokens bigint, tokens array<int>")
    out.withColumnRenamed("id", id_col).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: Iterable | None = None, columns: Iterable[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The stored rows, or those of some ids and columns; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    if ids is not None:
        df = df.filter(F.col(id_col).isin(list(ids)))
    return df.select(*columns) if columns is not None else df


def token_starts(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per stored document: id_col, start, n_tokens, ids_crc32, read from the files.

    start counts the ids of all documents before it: the files' totals are summed from the
    metadata columns (one row per file, MOST_FILES at most), and each row adds its own offset
    in its file.
    """
    from pyspark.sql import Window

    shards = read_tokens(spark, path, columns=["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    base = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))

    @F.arrow_udf("bigint")
    def crc(tokens: pa.Array) -> pa.Array:
        flat, off = np.asarray(tokens.values).astype("<u4", copy=False), np.asarray(tokens.offsets)
        return pa.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(off[:-1], off[1:])], pa.int64())

    rows = read_tokens(spark, path).select(id_col, "shard", "before", "n_tokens", crc(F.col("tokens")).alias("ids_crc32"))
    return rows.join(base, "shard").select(id_col, (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write_tokens to the shared folder, then token_starts of what is there."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, id_col, text_col)
    return token_starts(docs.sparkSession, path, id_col)
