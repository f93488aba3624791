"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

A word-level BPE never merges across words, so the ids of a text are the ids of its words in order:

1. *split*: tasks cut the texts into words and write, for each chunk of about CHUNK_BYTES of text, the word numbers of
   each document and the chunk's dictionary (number, word) into one table that is bucketed by chunk;
2. *encode*: all dictionaries, dealt and sorted by word, are the table of distinct words; the library encodes each once;
3. *join back*: the ids go to the chunks that hold the word, where each document's numbers meet them by position.

Bucketing leaves the numbers (one for every word of the corpus) where they were written; only dictionaries are shuffled.
A word that a third of all text consists of is one dictionary row per chunk.  Decoding joins ids with the pieces of the
vocabulary file (a table of fixed size, so it is broadcast), and concatenates them as a tokenizer without decoder does.

The splitting rules are those of the vocabulary file (normaliser and pre-tokenizer of the library); texts that hold only
characters below U+0180 take an equal, faster path: lower-casing and a plain pattern on the runs between white space.

Defined cases: a null or empty text has no ids and decodes to the empty text; a text of any length is one value and
starts a chunk of its own when it is longer than one; equal texts and repeated ids stay separate rows; null ids stay null;
an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.llm.common import bounded_batches, list_column, slices, stored_buckets, text_buffer, worker_cache

CHUNK_BYTES, RUNS_KEPT, ROWS_A_BLOCK = 20 << 20, 1 << 17, 1 << 17
PLAIN_LIMIT, PLAIN_BYTE = "\u0180", 0xC6
"""The first character whose UTF-8 bytes begin with PLAIN_BYTE or more.  Below it every character is its own NFC form, and letters and lower case are alike in all Unicode versions."""

_PART = "_chunk long, _code int, word string, _place int, doc_id long, codes binary"


class Splitter:
    """Words of a text in the order of their ids, by the rules of a vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        rules = spec["pre_tokenizer"]["pretokenizers"]
        bare = {**spec, "added_tokens": [], "pre_tokenizer": rules[0], "model": {**spec["model"], "vocab": {}, "merges": []}}
        bare = Tokenizer.from_str(json.dumps(bare))
        self.normalise, self.exact = bare.normalizer.normalize_str, bare.pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        below = [chr(c) for c in range(ord(PLAIN_LIMIT))]
        kinds = {k: "".join(re.escape(c) for c in below if unicodedata.category(c)[0] == k) for k in "LN"}
        space = "".join(re.escape(c) for c in below if self.exact(c) == [])
        pattern = rules[0]["pattern"]["Regex"].replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", space)
        self.pattern, self.spaces = re.compile(pattern), re.compile(f"[{space}]+")

    def runs(self, text: str) -> list[str] | None:
        """The parts between white space of a text whose characters are below PLAIN_LIMIT; None if it spells a special token."""
        return None if any(t in text for t in self.special) else self.spaces.split(text.lower())

    def plain(self, run: str) -> list[str]:
        return [run] if run.isalpha() else self.pattern.findall(run)

    def words(self, text: str) -> list[str]:
        out, at = [], 0
        for m in [*self.at_special.finditer(text), None]:
            part = text[at: m.start() if m else len(text)]
            out += [w for w, _ in self.exact(self.normalise(part))] if part else []
            if m:
                out.append(m[0])
                at = m.end()
        return out


class Numbers(dict):
    """Run -> numbers of its words; words are numbered as they are met."""

    def __init__(self, split) -> None:
        super().__init__()
        self.split, self.words = split, {}

    def __missing__(self, run: str) -> tuple[int, ...]:
        if len(self) >= RUNS_KEPT:
            self.clear()  # only a cache; the words stay
        self[run] = found = self.of(self.split(run))
        return found

    def of(self, words: list[str]) -> tuple[int, ...]:
        return tuple(self.words.setdefault(w, len(self.words)) for w in words)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """Runs of ``counts`` whole numbers below 2**31, seven bits a byte, low bits first; a number's last byte is below 128."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        own = np.flatnonzero(size > k) if k else slice(None)
        out[(ends - size)[own] + k] = values[own] >> 7 * k & 127 | (size[own] > k + 1) * 128
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edges), pa.py_buffer(out)])


def unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column and how many each row holds."""
    raw, offsets = text_buffer(column)
    last = np.flatnonzero(raw < 128)
    counts = np.diff(np.searchsorted(last, offsets))
    if not len(raw):
        return np.zeros(0, np.int64), counts
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first), counts


def _split(path: str, chunk_bytes: int):
    kinds = {"_chunk": pa.int64(), "_code": pa.int32(), "word": pa.string(), "_place": pa.int32(), "doc_id": pa.int64(), "codes": pa.binary()}

    def part(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))

    def run(batches):
        splitter = worker_cache(f"words:{path}", lambda: Splitter(path))
        chunk, size, place, numbers = TaskContext.get().partitionId() << 24, 0, 0, Numbers(splitter.plain)

        def dictionary():
            words = list(numbers.words)
            for at in range(0, len(words), 20_000):
                own = words[at: at + 20_000]
                yield part(len(own), _chunk=np.full(len(own), chunk), _code=np.arange(at, at + len(own), dtype=np.int32), word=own)

        for rows, data, offsets in slices(batches):
            texts, n = rows.column("text"), rows.num_rows
            odd = set((np.searchsorted(offsets, np.flatnonzero(data >= PLAIN_BYTE), side="right") - 1).tolist())
            found = []
            for i in range(n):
                text = texts[i].as_py() or ""
                runs = None if i in odd else splitter.runs(text)
                own = chain.from_iterable(map(numbers.__getitem__, runs)) if runs is not None else numbers.of(splitter.words(text))
                found.append(np.fromiter(own, np.int64))
            codes = packed(np.concatenate(found), np.array([len(f) for f in found]))
            yield part(n, _chunk=np.full(n, chunk), _place=np.arange(place, place + n, dtype=np.int32), doc_id=rows.column("doc_id"), codes=codes)
            place, size = place + n, size + len(data) + n
            if size >= chunk_bytes:
                yield from dictionary()
                chunk, size, place, numbers = chunk + 1, 0, 0, Numbers(splitter.plain)
        yield from dictionary()

    return run


class WordEncoder:
    """Ids of single words: the vocabulary file's model and byte mapping, without its splitting."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alone = {**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][1]}
        self.exact = Tokenizer.from_str(json.dumps(alone))

    def ids(self, words: list[str]) -> list[list[int]]:
        found = self.exact.encode_batch_fast(words, add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(words, found)]


def _encode(path: str):
    """Rows sorted by word -> per chunk the word numbers, how many ids each has, and the ids.  Equal words stand side by
    side, so a word is encoded once however many chunks hold it."""

    def run(batches):
        encoder = worker_cache(f"word-ids:{path}", lambda: WordEncoder(path))
        held, before, known = [], None, None

        def flush():
            of, code, sizes, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(of, kind="stable")
            starts = np.cumsum(sizes) - sizes
            n = sizes[order]
            ends = np.cumsum(n)
            at = np.repeat(starts[order] - ends + n, n) + np.arange(n.sum())
            chunks, counts = np.unique(of, return_counts=True)
            inside = np.add.reduceat(n, np.cumsum(counts) - counts)
            return pa.RecordBatch.from_arrays([pa.array(chunks), packed(code[order], counts), packed(n, counts), packed(ids[at], inside)],
                                              ["_of", "numbers", "sizes", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            new = np.concatenate([[0], np.flatnonzero(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)) + 1])
            distinct = words.take(pa.array(new)).to_pylist()
            again = distinct[0] == before
            ids = ([known] if again else []) + encoder.ids(distinct[again:])
            before, known = distinct[-1], ids[-1]
            runs = np.diff(np.append(new, batch.num_rows))
            of_each = [np.array(i, np.int64) for i in ids]
            held.append((batch.column("_of").to_numpy(), batch.column("_code").to_numpy().astype(np.int64),
                         np.repeat([len(i) for i in ids], runs), np.concatenate([np.tile(i, r) for i, r in zip(of_each, runs)])))
            if sum(len(h[0]) for h in held) >= ROWS_A_BLOCK:
                yield flush()
        if held:
            yield flush()

    return run


def _by_position(rows: pa.Table, dictionary: pa.Table, pieces: pa.Array | None = None) -> pa.Table:
    """One chunk: word numbers of each document -> ids (and, given the pieces, their text)."""
    (code, _), (size, _), (ids, _) = (unpacked(dictionary[c]) for c in ("numbers", "sizes", "ids"))
    ids = ids.astype(np.int32)
    start, length = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    start[code], length[code] = np.cumsum(size) - size, size
    rows, out = rows.sort_by("_place"), []
    for batch in rows.select(["doc_id", "codes"]).to_batches(max_chunksize=64):
        own, words = unpacked(batch.column("codes"))
        n = length[own]
        ends = np.cumsum(n)
        found = ids[np.repeat(start[own] - ends + n, n) + np.arange(n.sum())]
        counts = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words)])])
        columns = {"doc_id": batch.column("doc_id"), "ids": list_column(found, counts, pa.int32())}
        out.append(pa.RecordBatch.from_pydict(columns if pieces is None else columns | {"decoded": joined_pieces(columns["ids"], pieces)}))
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + ([] if pieces is None else [("decoded", pa.string())])
    return pa.Table.from_batches(out, pa.schema(fields))


def word_parts(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The stored table of step 1, bucketed by chunk."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored_buckets(texts.mapInArrow(_split(path, chunk_bytes), _PART), "word-parts", "_chunk")


def word_ids(parts: DataFrame, path: str) -> DataFrame:
    """The dictionaries of all chunks with ids for words: dealt and sorted by word, each distinct word encoded once."""
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.rdd.getNumPartitions())
    words = parts.where(F.col("word").isNotNull()).select("word", F.col("_chunk").alias("_of"), "_code")
    return (words.repartition(tasks, "word").sortWithinPartitions("word")
            .mapInArrow(_encode(path), "_of long, numbers binary, sizes binary, ids binary"))


def _chunks(docs: DataFrame, path: str, chunk_bytes: int, assemble, types: str) -> DataFrame:
    parts = word_parts(docs, path, chunk_bytes)
    rows = parts.where(F.col("word").isNull()).select("_chunk", "_place", "doc_id", "codes")
    return rows.groupBy("_chunk").cogroup(word_ids(parts, path).groupBy("_of")).applyInArrow(assemble, types)


def encode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``."""
    def assemble(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
        return _by_position(rows, dictionary)

    return _chunks(docs, path, chunk_bytes, assemble, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """As ``decode(encode(docs))``, in one pass over the chunks: doc_id, ids and decoded."""
    def assemble(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
        return _by_position(rows, dictionary, piece_column(path))

    return _chunks(docs, path, chunk_bytes, assemble, "doc_id long, ids array<int>, decoded string")


@functools.lru_cache(maxsize=4)
def pieces_of(path: str) -> tuple[str, ...]:
    """Pieces by id of a vocabulary file."""
    spec = json.load(open(path, encoding="utf-8"))
    pieces = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return tuple(pieces.get(i) for i in range(max(pieces) + 1))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a vocabulary file."""
    return spark.createDataFrame([(i, p) for i, p in enumerate(pieces_of(path)) if p is not None], "id int, piece string")


def piece_column(path: str) -> pa.Array:
    return worker_cache(f"pieces:{path}", lambda: pa.array(pieces_of(path), pa.string()))


def joined_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The join by id: the pieces of each row's ids, in their order, with one space between."""
    flat, counts = ids.flatten(), ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = pc.and_(pc.less(flat, len(pieces)), pc.greater_equal(flat, 0))
    found = pieces.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    if found.null_count:  # ids that the vocabulary lacks are left out
        there = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))]).astype(np.int32)
        found, ends = found.drop_null(), there[ends]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), found), " ")


def _decode(path: str):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, joined_pieces(ids, piece_column(path))], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``: a join with the vocabulary's (id, piece) rows, which go to every worker
    (their number is the vocabulary file's), and the pieces of a row one after the other.  Ids without a piece are left out."""
    types = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(_decode(path), f"{types}, decoded string")
