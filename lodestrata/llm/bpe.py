"""BPE encoding and decoding of whole texts with a byte-level tokenizer file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import cut, small_batches
from .wordtable import release, word_table

#: Bytes of ids that a worker passes on at once.
SLICE_BYTES = 1_000_000

#: The printable bytes that stand for themselves in byte-level pieces; the others follow from code point 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _piece_bytes(path: str, tok=None) -> list[bytes]:
    """The id-to-piece table: bytes of each id; an added token's string stands for itself."""
    if tok is None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = tok.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return pieces


_PIECES: dict[str, list[bytes]] = {}


def encode(text: Column, path: str, kind: str = "byte", ranks: str | None = None) -> Column:
    """Ids (array of int) of a text column, as the tokenizers library gives without special tokens. Null: empty.

    ``ranks``: a file of the same vocabulary's ranks, by which common words are encoded faster.
    """

    def ids(texts: pa.Array) -> pa.Array:
        table, parts, ends = word_table(path, kind, ranks), [], [0]
        for x in texts:
            parts.append(table.encode(x.as_py()))
            ends.append(ends[-1] + len(parts[-1]) // 4)
        flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return F.arrow_udf(ids, ArrayType(IntegerType(), False))(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an id column through the id-to-piece table; bytes that aren't UTF-8 become U+FFFD. Null: null. Unknown ids: nothing."""

    def texts(lists: pa.Array) -> pa.Array:
        if path not in _PIECES:
            _PIECES[path] = _piece_bytes(path)
        pieces = _PIECES[path]
        n, out = len(pieces), []
        for x in lists:
            if not x.is_valid:
                out.append(None)
                continue
            own = x.values.to_pylist()
            try:
                out.append(b"".join([pieces[i] for i in own]).decode("utf-8", "replace"))
            except (IndexError, TypeError):
                out.append(b"".join([pieces[i] for i in own if i is not None and 0 <= i < n]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return F.arrow_udf(texts, StringType())(ids)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """``docs`` with an ``ids_col`` of each whole text. Row by row: no shuffle; null and empty texts give no ids,
    repeated rows repeat, an empty table stays empty. A column of that name is replaced."""
    return docs.withColumn(ids_col, encode(F.col(text_col), path, ranks=ranks))


def encoded_and_decoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``ids`` (array of int), ``decoded`` (text of these ids through the id-to-piece table).

    Both directions run in one pass of one worker, a few rows at a time, so that memory stays small for long texts.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path, "byte", ranks)
        piece = _piece_bytes(path, table.tokenizer).__getitem__
        try:
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    parts, texts, first, size = [], [], at, 0
                    while at < batch.num_rows and size < SLICE_BYTES:
                        own = table.encode(batch.column(1)[at].as_py())
                        parts.append(own)
                        texts.append(b"".join(map(piece, np.frombuffer(own, "<u4").tolist())).decode("utf-8", "replace"))
                        size += len(own)
                        at += 1
                    ends = np.cumsum([0, *map(len, parts)]) // 4
                    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(texts, pa.string())], ["i", "ids", "decoded"])
        finally:
            table = piece = parts = texts = own = flat = batch = None  # else they stay until this generator goes
            release()

    kind = dict(rows.dtypes)["i"]
    return rows.mapInArrow(both, f"i {kind}, ids array<int>, decoded string").select(F.col("i").alias(id_col), "ids", "decoded")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """One row per document: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; the text is encoded, then decoded from its ids.

    The digests are written once (see ``cut``), so that the texts' batches can be held small. Null and empty texts have no ids and decode to the empty text; null ids and repeated rows each give a row, an empty
    table gives an empty result, other columns are not read.
    """
    rows = encoded_and_decoded(docs, path, id_col, text_col, ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    with small_batches(docs.sparkSession):
        return cut(rows.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))
