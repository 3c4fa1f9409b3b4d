"""Token ids in ORC files: sorted by document, with row indexes and Bloom filters on the ids of documents.

Documents are dealt over ranges of their id and sorted, each range is encoded and written as
one file, so the files in order of their names hold all documents in ascending order.  A row
is a document: its id, how many tokens of the same file come before it, how many it has, and
the token ids as a list of integers, which ORC keeps run-length encoded.  Every ROWS rows have
an entry in the row index, with the least and greatest document id and a Bloom filter, so a
reader that looks for documents skips whole files, stripes and groups of rows; a reader of
everything takes the stripes in parallel.

Encoding comes after the sort: texts are smaller to shuffle than their tokens, and the ranges
are found from the ids without encoding anything.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.store import by_batch, sliced
from textwarden.llm.words import list_array, mixed, pieces

ROWS = 1000  # rows per entry of the row index
STRIPE = 16 << 20
KNOWN = 1 << 19  # words whose tokens a task keeps
TOGETHER = 4 << 20  # bytes of texts that are cut together
END = 2
SCHEMA = "doc_id {key}, before long, n_tokens int, ids array<int>"

LETTER, NUMBER, SPACE, MARK, OTHER = range(5)
MIX = 0x9E3779B97F4A7C15
LONGEST = 32  # bytes of a word that is told from others by its bytes, four numbers of eight


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every ASCII byte, and that of the characters of two bytes below U+0250."""
    kinds = np.full(0x250, OTHER, np.uint8)
    for c in [*range(0x20, 0x7F), *range(0xA1, 0x250)]:
        kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], MARK)
    kinds[[9, 10, 13, 32]] = SPACE
    kinds[ord("'")] = OTHER  # where the pattern has endings of its own
    first = np.full(256, OTHER, np.uint8)
    first[:128] = kinds[:128]
    return first, kinds


CLASSES = _classes()


def words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts data[cuts[i]:cuts[i+1]] begin, and which texts are plain.

    Words are those of the vocabulary's own pattern: runs of letters, of numbers or of other
    marks, each with the space before it, and what is left of white space.  It cuts plain texts
    only: ASCII and Latin letters, no apostrophe, whose endings are words as well.
    """
    first, kinds = CLASSES
    kind = first[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))  # of a character of two bytes
    if len(lead):
        point = ((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = np.where(point < 0x250, kinds[np.minimum(point, 0x24F)], OTHER)
    odd = np.r_[0, np.cumsum(kind == OTHER)]
    plain = odd[cuts[1:]] == odd[cuts[:-1]]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last of a run of white space before something else: a space goes with what follows
    follows = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:-1]) + 1
    begin[follows - 1] = True
    begin[follows] = data[follows - 1] != ord(" ")
    return np.flatnonzero(begin), plain


class Encoder:
    """The tokens of texts, by the library; a word that comes again is not encoded again.

    No token goes over the end of a word, so the tokens of a text are those of its words.  The
    words of plain texts are cut and told apart for all texts of a piece at once, those not
    known yet are handed to the library cut as they are.  Other texts go through it whole.
    """

    def __init__(self, vocabulary: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.vocabulary, self.library = vocabulary, None  # loaded where a text is not plain
        self.uncut = Tokenizer.from_file(vocabulary)
        self.uncut.encode_special_tokens = True  # their strings in a text are ordinary text
        self.uncut.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # a character of a token is a byte of the text
        vocab = self.uncut.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        self.size[list(vocab.values())] = [len(t) for t in vocab]
        self.end = np.array(end, "<i4")
        # the known words: sorted keys, their bytes as numbers, and where their tokens are
        self.key, self.bytes = np.empty(0, np.uint64), np.empty((LONGEST // 8, 0), np.uint64)
        self.first = self.many = np.empty(0, np.int64)
        self.ids = np.empty(0, "<i4")

    def whole(self, text: str) -> np.ndarray:
        """The token ids of one text, by the library alone."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
            self.library.encode_special_tokens = True
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4")

    def tokens(self, data: np.ndarray, words: Contents) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` the tokens of each word begin, and how many it has; words not known yet go to the library."""
        at = np.minimum(np.searchsorted(self.key, words.key), max(0, len(self.key) - 1))
        hit = np.zeros(len(words.key), bool)
        if len(self.key):
            hit = (self.key[at] == words.key) & (self.bytes[:, at] == words.bytes).all(axis=0) & (words.sizes <= LONGEST)
        first, many = np.zeros((2, len(hit)), np.int64)
        first[hit], many[hit] = self.first[at[hit]], self.many[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            sizes = words.sizes[new]
            given = [data[a : a + n].tobytes().decode() for a, n in zip(words.starts[new].tolist(), sizes.tolist())]
            (found,) = self.uncut.encode_batch_fast([given], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<i4")
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes)) + 1
            many[new] = np.diff(ends, prepend=0)
            first[new] = len(self.ids) + ends - many[new]
            self.ids = np.r_[self.ids, ids]
            self._keep(words, first, many, new)
        return first, many

    def _keep(self, words: Contents, first: np.ndarray, many: np.ndarray, new: np.ndarray) -> None:
        """Know the new words as well; where they get too many, only those of this piece."""
        if len(self.key) + len(new) > KNOWN:
            new = np.arange(len(first))
            self.key, self.bytes, self.first, self.many = self.key[:0], self.bytes[:, :0], self.first[:0], self.many[:0]
        new = new[words.sizes[new] <= LONGEST][:KNOWN]
        key = np.r_[self.key, words.key[new]]
        order = np.argsort(key, kind="stable")
        self.key, self.bytes = key[order], np.concatenate([self.bytes, words.bytes[:, new]], axis=1)[:, order]
        self.first, self.many = np.r_[self.first, first[new]][order], np.r_[self.many, many[new]][order]

    def piece(self, data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """The token ids of every text of a piece, the end id last."""
        starts, plain = words_of(data, cuts) if len(data) else (np.empty(0, np.int64), np.ones(len(cuts) - 1, bool))
        text = np.searchsorted(cuts, starts, "right") - 1
        sizes = np.diff(np.r_[starts, len(data)])
        keep = plain[text]
        starts, sizes, text = starts[keep], sizes[keep], text[keep]
        words, which = contents(data, starts, sizes)
        first, many = self.tokens(data, words)
        counts = many[which]
        place = np.cumsum(counts) - counts
        out = self.ids[np.repeat(first[which] - place, counts) + np.arange(counts.sum())]
        if len(self.ids) > 8 * KNOWN:  # tokens of words that are not known any more
            at = np.repeat(self.first - (np.cumsum(self.many) - self.many), self.many) + np.arange(self.many.sum())
            self.ids, self.first = self.ids[at], np.cumsum(self.many) - self.many
        borders = np.r_[0, np.cumsum(counts)][np.searchsorted(text, np.arange(len(cuts)))].tolist()
        rows = []
        for i, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
            row = out[a:b] if plain[i] else self.whole(data[cuts[i] : cuts[i + 1]].tobytes().decode())
            rows.append(np.append(row, self.end))
        return rows


def worker_encoder(vocabulary: str, end: int) -> Encoder:
    """The encoder of this worker process, which keeps it and the words it knows from task to task.

    Functions are sent to a worker anew with every task; a module of the library is not.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_textwarden_encoders", {})
    if (vocabulary, end) not in kept:
        kept[vocabulary, end] = Encoder(vocabulary, end)
    return kept[vocabulary, end]


class Contents(NamedTuple):
    """Spans of bytes of different content: where one of each is, a key and the bytes as numbers."""

    starts: np.ndarray
    sizes: np.ndarray
    key: np.ndarray
    bytes: np.ndarray


def contents(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[Contents, np.ndarray]:
    """The different contents among spans of bytes, and for every span the number of its content.

    Spans of LONGEST bytes at most are told apart by their bytes, as numbers; longer ones each
    count as a content of their own.  No span holds a zero byte.
    """
    padded = np.r_[data, np.zeros(LONGEST, np.uint8)]
    every = np.lib.stride_tricks.sliding_window_view(padded, 8)
    columns = np.zeros((LONGEST // 8, len(starts)), np.uint64)
    key = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(sizes > LONGEST)
    for i, column in enumerate(columns):
        left = np.clip(sizes - 8 * i, 0, 8)
        some = np.flatnonzero(left)
        bits = (8 * (8 - left[some])).astype(np.uint64)
        column[some] = np.ascontiguousarray(every[starts[some] + 8 * i]).view(np.uint64)[:, 0] << bits
        if not i:
            column[long] = long  # each for itself
        key = mixed((key ^ column) * np.uint64(MIX))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    if not ((columns == columns[:, one[which]]).all() and (sizes == sizes[one[which]]).all()):
        one = which = np.arange(len(starts))  # two contents with one key: every span for itself
    return Contents(starts[one], sizes[one], key[one], columns[:, one]), which


def encoded(docs: DataFrame, key: str, text: str, vocabulary: str, end: int = END) -> DataFrame:
    """The rows of the files, in their order: ranges of documents, sorted, each encoded by one task."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")  # rows repeated under one id have one order, and need not share a range
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = worker_encoder(vocabulary, end), 0
        for batch in sliced(batches, ROWS):
            ids = [row for _, data, cuts in pieces(batch.column(1), TOGETHER) for row in encoder.piece(data, cuts)]
            sizes = np.array([len(x) for x in ids], np.int64)
            first = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first), pa.array(sizes, pa.int32()), list_array(ids, pa.int32())],
                ["doc_id", "before", "n_tokens", "ids"],
            )

    return ordered.mapInArrow(run, SCHEMA.format(key=rows.schema["doc_id"].dataType.simpleString()))


def write_tokens(
    docs: DataFrame, path: str, key: str, text: str, vocabulary: str, end: int = END, stripe: int = STRIPE, rows: int = ROWS
) -> None:
    """Write the token ids of all texts as ORC files in ascending order of the documents.

    A null text is an empty one and has the end id alone.  Rows without id come first; rows
    repeated under one id are rows of their own, ordered by a hash of their text.  Other columns
    are not written, whatever they are called.  A folder that exists is replaced.
    """
    writer = encoded(docs, key, text, vocabulary, end).write.mode("overwrite").format("orc")
    for name, value in {
        "compression": "zstd",
        "orc.create.index": "true",
        "orc.row.index.stride": rows,
        "orc.stripe.size": stripe,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }.items():
        writer = writer.option(name, str(value))
    writer.save(path)


def read_tokens(spark: SparkSession, path: str, key: str = "long", ids: Sequence | None = None) -> DataFrame:
    """Rows of the files with the ``file`` of each: all, or those of the documents named.

    The names are sent to the reader of the files, which skips what cannot hold them.
    """
    rows = spark.read.schema(SCHEMA.format(key=key)).orc(path)
    if ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(ids)))
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def file_starts(tokens: DataFrame) -> DataFrame:
    """Per file, in order of the names, the tokens of all files before it; one row a file, no ids are read."""
    sizes = tokens.groupBy("file").agg(F.max(F.col("before") + F.col("n_tokens")).alias("tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("file_start"))


def document_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32 of every row of the files."""
    starts = file_starts(tokens)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(2)
        cuts, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4", copy=False)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        sums = [zlib.crc32(flat[a:b]) for a, b in spans]
        sizes = np.diff(cuts).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes), pa.array(sums, pa.int64()), batch.column(3)],
            ["doc_id", "before", "n_tokens", "ids_crc32", "file"],
        )

    rows = by_batch(
        tokens.select("doc_id", "before", "ids", "file"), make, f"doc_id {kind}, before long, n_tokens long, ids_crc32 long, file string"
    )
    # one row per file: Spark sends it to all tasks where it is small
    placed = rows.join(starts, "file")
    return placed.select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
