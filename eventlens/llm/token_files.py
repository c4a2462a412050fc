"""Token-ID output: Parquet list columns that can be read selectively.

Documents are ranged by id, encoded by tasks, and written as one Parquet file
per range: doc_id, n_tokens, file_no, row_no and ids (list<int32>). The ids
are dictionary-encoded (a vocabulary below 2**16 entries takes two bytes an id
before compression), or written as DELTA_BINARY_PACKED with
`encoding="delta"`. Row groups and pages have set sizes; Parquet's page
indexes then let a reader fetch the ids of a few documents without the rest of
the file, and the metadata columns without any ids.

Encoding goes through a bounded cache of pieces: texts are cut at white space
and between ASCII letters or digits and punctuation, each distinct piece is
encoded once, and the ids of the pieces are gathered with numpy. This is exact
for tokenizers that lower-case, drop white space and begin a pre-token at those
places (the word-end BPE; pieces are told apart by a 64-bit hash); for others
pass `whole=True`, and each text is encoded at once.

Defined cases: null and empty texts have only the end id; null ids come first;
repeated rows are written as often as they occur, neighbours in the file; an
empty table gives an empty table. Only id and text columns are read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import cut, running_total, table
from .textops import Words, slices

END_ID = 1
CACHE = 400_000  # pieces in a generation of a Python worker's cache, which has two
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


# Classes of bytes: white space 0, ASCII letters and digits 1, other ASCII punctuation 2, apostrophe and all else 3.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] = 2


def _breaks(raw: np.ndarray) -> np.ndarray:
    """Where punctuation follows an ASCII letter or digit, and the other way round (an apostrophe may go on: 's)."""
    kind, out = _KIND[raw], np.zeros(len(raw), bool)
    out[1:] = (kind[:-1] == 1) & ((kind[1:] == 2) | (raw[1:] == 0x27)) | (kind[:-1] == 2) & (kind[1:] == 1)
    return out


#: A table of pieces: their hashes in ascending order, where each one's ids begin and how many they are, and all ids.
_NONE = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4"))


def _find(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the table each key is, and whether it is there."""
    hashes = table[0]
    if not len(hashes):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return at, hashes[at] == keys


def _taken(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + n], one after another."""
    return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _added(table: tuple, keys: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple:
    """The table with further keys (ascending, not in it yet), of n ids each."""
    hashes, start, size, flat = table
    at = np.searchsorted(hashes, keys)
    return (np.insert(hashes, at, keys), np.insert(start, at, len(flat) + np.cumsum(n) - n), np.insert(size, at, n), np.concatenate([flat, ids]))


class Pieces:
    """Ids of the pieces of texts, by the pieces' 64-bit hash, in two generations of CACHE pieces."""

    def __init__(self, path: str):
        import tokenizers

        self.path, self.tokenizer, self.new, self.old = path, tokenizers.Tokenizer.from_file(path), _NONE, _NONE

    @classmethod
    def of(cls, path: str) -> "Pieces":
        import tokenizers

        kept = getattr(tokenizers, "_eventlens_pieces", None)  # on the library's module, so that it outlives a task
        if kept is None or kept.path != path:
            kept = tokenizers._eventlens_pieces = cls(path)
        return kept

    def whole(self, texts: pa.Array) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        w = Words(texts, _KIND > 0, _breaks)
        if b"<|" in w.raw.tobytes():  # special tokens are found across pieces, and in their own case only
            special = pc.fill_null(pc.match_substring(texts, "<|"), False).to_pylist()
            plain = iter(self.ids(pc.if_else(pa.array(special), pa.scalar("", texts.type), texts)))
            own = iter(self.whole(texts.filter(pa.array(special))))
            return [next(own) if s and (next(plain),) else next(plain) for s in special]
        code, uniques = pd.factorize(w.hashes())
        first = np.empty(len(uniques), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        order = np.argsort(uniques)
        rows = np.empty(len(uniques), np.int64)
        rows[order] = self._rows(uniques[order], first[order], w)
        at = rows[code]
        n = self.new[2][at]
        return np.split(_taken(self.new[3], self.new[1][at], n), np.append(0, np.cumsum(n))[w.of[1:-1]])

    def _rows(self, keys: np.ndarray, first: np.ndarray, w: Words) -> np.ndarray:
        """Where in the new generation each key (ascending) is, after the missing ones were taken from the old one or encoded."""
        if len(self.new[0]) > CACHE:
            self.old, self.new = self.new, _NONE
        missing = ~_find(self.new, keys)[1]
        if missing.any():
            keys_, first = keys[missing], first[missing]
            at, had = _find(self.old, keys_)
            at = at[had]
            n = self.old[2][at]
            self.new = _added(self.new, keys_[had], n, _taken(self.old[3], self.old[1][at], n))
            self.new = _added(self.new, keys_[~had], *self._encode([w.word(i).decode("utf-8") for i in first[~had]]))
        return _find(self.new, keys)[0]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids. All pieces in one call, joined by spaces; the place of a token says whose it is."""
        if not pieces:
            return np.empty(0, np.int64), np.empty(0, "<u4")
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        starts = np.cumsum([0] + [len(t) + 1 for t in pieces[:-1]])
        at, ids = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0], np.array(found.ids, "<u4")
        return np.diff(np.searchsorted(at, np.append(starts, np.iinfo(np.int64).max))), ids


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, whole: bool = False,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, file_no, row_no, ids: documents in ascending id order, partition after partition."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = (rows.repartitionByRange("doc_id").withColumn("file_no", F.spark_partition_id()).sortWithinPartitions("doc_id", "_text"))
    end = np.array([end_id], "<u4")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        at, pieces = 0, Pieces.of(tokenizer_path)
        for b in slices(batches, "_text"):
            ids = (pieces.whole if whole else pieces.ids)(b.column("_text"))
            n = np.array([len(x) + 1 for x in ids], np.int64)
            flat = np.concatenate([x for own in ids for x in (own, end)]).view("<i4")
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), b.column("file_no"), pa.array(np.arange(at, at + len(n))),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n_tokens", "file_no", "row_no", "ids"])
            at += len(n)

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, file_no int, row_no long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer_path: str, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
          page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, **options) -> None:
    """Encode and write the token files (rewritten if they are there)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r} is neither 'dictionary' nor 'delta'")
    put = {"compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
           "parquet.writer.version": "v2", "parquet.enable.dictionary": str(encoding == "dictionary").lower()}
    encoded(docs, tokenizer_path, **options).write.mode("overwrite").options(**{k: str(v) for k, v in put.items()}).parquet(path)


def read(spark, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "file_no", "row_no", "ids")) -> DataFrame:
    """The written files; naming only metadata columns leaves the ids unread."""
    return spark.read.parquet(path).select(*columns)


def positions(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    tokens = read(spark, path)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            col = b.column("ids")
            flat, at = col.flatten().to_numpy(zero_copy_only=False).astype("<u4"), (np.asarray(col.offsets) - col.offsets[0].as_py()).tolist()
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file_no"), b.column("row_no"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "file_no", "row_no", "n_tokens", "ids_crc32"])

    # cut: the running total samples its rows before it deals them out, and the ids are to be read once
    rows = cut(tokens.mapInArrow(run, f"doc_id {kind}, file_no int, row_no long, n_tokens long, ids_crc32 long"))
    return running_total(rows, [], ["file_no", "row_no"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens", uuid.uuid4().hex)
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return positions(spark, path)
