"""Token ids of a corpus as files of Simple-8b words, in order of doc_id.

Documents are dealt out by ranges of doc_id and sorted within each, so a task meets its documents in
their order; it codes their ids, each document's followed by an end id, and gives pieces of whole
documents. Spark writes these as Parquet, which any store takes and of which a lost executor leaves
nothing half-written. A row of the files is one piece:

    part, piece: the range and the piece's place in it
    doc_ids, lengths: of each document, the length with the end id
    ids: a Simple-8b piece of the documents' ids one after the other (see ``simple8b``)

Row groups are small, so that a reader never holds more than some megabytes of pieces at once.
Reading needs no shuffle: a range's first id is the sum of the ranges before it, which the driver adds
up from one number for each range.

Byte-level BPE first splits a text into words, numbers, marks and white space. Texts are cut at such
boundaries where ASCII shows them, each different piece is coded once by the library, and the ids are put
together: the same ids as those of the whole text, as the tests check, in less time. A worker remembers
the ids of pieces; beyond ``KNOWN_PIECES`` it forgets those it has not met lately.

Defined results: a null or empty text has the end id only. A null doc_id comes first; rows that share a
doc_id are ordered by a hash of the text, those that share both by their place in the input, which must
be read from files or be kept. Strings that look like special tokens are ordinary text. A document's
text and ids must fit in a task's memory, nothing else grows with it. Further columns are ignored. No rows
give files without rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.llm import simple8b
from tillwise.llm.common import text_key

END_ID = 0
#: A piece is closed when it has so many ids.
PIECE_IDS = 1 << 18
#: Text that is cut and coded at once, in bytes.
SLICE_BYTES = 8 << 20
#: Some 250 bytes each, and twice so many at most, besides those of a slice.
KNOWN_PIECES = 200_000
#: Bytes of a row group, and after how many rows its size is looked at.
ROW_GROUP = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 4}
FILE_SCHEMA = "part int, piece long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"


class _Coder:
    """The library's tokenizer in a task, and the ids of pieces of text it met before."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.recent: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, four bytes each."""
        if len(self.recent) > KNOWN_PIECES:  # what was not met since the last time is forgotten
            self.earlier, self.recent = self.recent, {}
        recent, earlier, new = self.recent, self.earlier, []
        for piece in pieces:
            if piece not in recent:
                if piece in earlier:
                    recent[piece] = earlier[piece]
                else:
                    new.append(piece)
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            recent[piece] = array("I", found.ids).tobytes()
        return [recent[p] for p in pieces]


@lru_cache(2)
def _coder_of(definition: str) -> _Coder:
    return _Coder(definition)


@lru_cache(1)
def _boundaries() -> tuple[np.ndarray, np.ndarray]:
    """For each pair of bytes whether a text is cut between them wherever they stand, and for each byte
    whether a text is cut before a blank that it follows.

    No token joins an ASCII letter or digit to an ASCII character of another kind behind it, nor a mark to
    a digit, white space or (but for the apostrophe of 's) a letter behind it, nor anything visible to a
    blank behind it. A token of white space depends on what follows it, so nothing is cut behind white space,
    except before the last blank of it: a visible character takes that one along. Bytes beyond ASCII may
    be of any kind."""
    code = np.arange(128)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    digit = (code >= 48) & (code <= 57)
    mark = (code > 32) & (code < 127) & ~letter & ~digit
    white = (code == 32) | ((code >= 9) & (code <= 13))
    cut = np.zeros((256, 256), bool)
    cut[:128, :128] = (
        (letter[:, None] & ~letter) | (digit[:, None] & ~digit)
        | (mark[:, None] & (digit | white)) | ((mark & (code != 39))[:, None] & letter)
    )
    visible = np.zeros(256, bool)
    visible[0x21:0x7F] = True
    visible[0xC3:0xF5] = True
    visible[[0xE1, 0xE2, 0xE3]] = False  # these and 0xC2 may begin white space
    return cut.ravel(), visible


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of some texts begin: at each text, and at boundaries that all tokens keep."""
    between, visible = _boundaries()
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[1:-1] = between[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        blank = (data[:-1] == 0x20) & visible[data[1:]]
        blank[starts[(starts > 0) & (starts < len(data))] - 1] = False  # a text's last blank
        cut[:-2] |= blank
    cut[starts] = True
    return np.flatnonzero(cut[: len(data)])


def ids_of(texts: pa.Array, definition: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts one after the other, and how many each text has."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, held = filled.buffers()
    at = np.frombuffer(places, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held else np.zeros(0, np.uint8)
    at = at - at[0]
    begins = _cuts(data, at[:-1])
    if not len(begins):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    bounds = np.append(begins, len(data)).astype(np.int64)
    cut = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    coded = cut.dictionary_encode()
    which = coded.indices.to_numpy()
    each = _coder_of(definition).ids(coded.dictionary.to_pylist())
    length = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), np.uint32)
    first = np.cumsum(length) - length
    n = length[which]
    total = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    ids = flat[np.repeat(first[which] - total[:-1], n) + np.arange(total[-1])]
    # A text's ids are those of the pieces from its start on.
    return ids, np.diff(total[np.searchsorted(begins, at)])


def _with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(counts), end_id)


def _coder(definition: str, end_id: int, piece_ids: int):
    """Turns a range's documents, in order, into its pieces."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, n_ids = None, 0, 0
        docs, lengths, ids = [], [], []

        def closed() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            row = {
                "part": [part], "piece": [piece], "n_ids": [len(all_ids)], "doc_ids": [list(chain(*docs))],
                "lengths": [np.concatenate(lengths)], "ids": [simple8b.encode(all_ids)],
            }
            return pa.RecordBatch.from_pydict(row, schema=_FILE_ARROW)

        for batch in batches:
            part = batch["part"][0].as_py() if len(batch) else part
            for i, j in _slices(batch["text"]):
                found, counts = ids_of(batch["text"].slice(i, j - i), definition)
                found, counts = _with_ends(found, counts, end_id), counts + 1
                named, ends, k = batch["doc_id"].slice(i, j - i).to_pylist(), np.cumsum(counts), 0
                while k < len(counts):
                    before = int(ends[k - 1]) if k else 0
                    stop = max(k + 1, int(np.searchsorted(ends, before + piece_ids - n_ids, side="left")) + 1)
                    stop = min(stop, len(counts))
                    docs.append(named[k:stop])
                    lengths.append(counts[k:stop])
                    ids.append(found[before : int(ends[stop - 1])])
                    n_ids, k = n_ids + len(ids[-1]), stop
                    if n_ids >= piece_ids:
                        yield closed()
                        piece, n_ids = piece + 1, 0
                        docs, lengths, ids = [], [], []
        if docs:
            yield closed()

    return code


_FILE_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("piece", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()),
    ]
)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about SLICE_BYTES each, of one text at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + SLICE_BYTES, side="right")))
        yield i, j
        i = j


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, piece_ids: int = PIECE_IDS
) -> None:
    """Writes the ids of all documents; ``tokenizer`` is the path of its JSON file, read on the driver."""
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    rows = documents.select(
        F.col("doc_id").cast("long"), "text", text_key().alias("text_key"), F.monotonically_increasing_id().alias("at")
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key"), F.col("at")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranges.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(
        _coder(definition, end_id, piece_ids), FILE_SCHEMA
    )
    # The words are packed already.
    pieces.write.options(compression="uncompressed", **ROW_GROUP).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of each document: its ids with the end id, and how many ids come before."""
    return _decoded(spark, folder, "ids array<long>", lambda doc: doc.astype(np.int64))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    return _decoded(spark, folder, "ids_crc32 long", lambda doc: zlib.crc32(doc.astype("<u4").tobytes())).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def _decoded(spark: SparkSession, folder: str, column: str, of) -> DataFrame:
    """One row for each document of the files; ``of`` gives a column's value from the document's ids."""
    files = spark.read.parquet(folder)
    name, kind = column.split(" ", 1)
    value_type = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[kind]
    schema = f"part int, piece long, doc_id long, before long, n_tokens long, {column}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids = simple8b.decode(batch["ids"][k].as_py())
                lengths = batch["lengths"][k].values.to_numpy()
                ends = np.cumsum(lengths)
                values = [of(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["part"][k].as_py()] * n, pa.int32()),
                        pa.array([batch["piece"][k].as_py()] * n, pa.int64()), batch["doc_ids"][k].values,
                        pa.array(ends - lengths), pa.array(lengths), pa.array(values, value_type),
                    ],
                    ["part", "piece", "doc_id", "before", "n_tokens", name],
                )

    # Sums over pieces, whose rows are few, decide where each piece begins.
    earlier = files.select("part", "piece", "n_ids")
    return files.select("part", "piece", "doc_ids", "lengths", "ids").mapInArrow(read, schema).join(
        _piece_starts(earlier), ["part", "piece"]
    ).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", name)


def _piece_starts(pieces: DataFrame) -> DataFrame:
    """(part, piece, first): how many ids come before each piece. A part's pieces are added up by
    themselves; the parts, one for each shuffle partition at most, in one more window."""
    upto = (Window.unboundedPreceding, -1)
    parts = pieces.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("base")
    )
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("piece").rowsBetween(*upto))
    return pieces.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select(
        "part", "piece", (F.col("base") + F.col("within")).alias("first")
    )
