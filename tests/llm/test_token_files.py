"""Token files: exact round trip against the tokenizer itself, and selective reads."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

from eventlens.llm import common, token_files
from tests.llm.helpers import documents, empty, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def rows():
    rng = random.Random(9)
    odd = ["It's 12,000.5 don't!! ... (x),", "Ünïcode straße ﬁ Ⅷ  İstanbul ΣΊΣΥΦΟΣ", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd\x85é", "\U0001f600\U0001f468‍\U0001f469 ok",
           "été ño", "abc.;:!? x.! 9.;", "…fin… «l'été»,", "\t\n", "日本語 テキスト。"]
    out = [(i, t) for i, t in enumerate(odd)] + [(20 + i, prose(rng, rng.randrange(0, 60)) + rng.choice([".", ",!", ""])) for i in range(200)]
    return out + [(300, None), (301, ""), (5, odd[5]), (5, odd[5]), (None, "no id"), (302, prose(rng, 30_000))]


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return {(i, text): t.encode(text or "", add_special_tokens=False).ids + [1] for i, text in rows}


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tmp_path, encoding):
    path = str(tmp_path / "t")
    token_files.write(documents(spark, rows()), path, PATH, encoding=encoding, row_group_bytes=64 << 10, page_rows=20)
    ids = {}
    for (i, _), x in brute(rows()).items():
        ids.setdefault(i, []).append(x)
    got = token_files.read(spark, path).orderBy("file_no", "row_no").collect()
    assert len(got) == len(rows()) and all(r.ids in ids[r.doc_id] and r.n_tokens == len(r.ids) for r in got)
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named) and got[0].doc_id is None
    at = 0
    where = sorted(token_files.positions(spark, path).collect(), key=lambda r: r.start)
    for r, w in zip(got, where):
        assert (w.doc_id, w.start, w.n_tokens, w.ids_crc32) == (r.doc_id, at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    file = max(ds.dataset(path).files, key=lambda f: pq.ParquetFile(f).metadata.num_rows)
    meta = pq.ParquetFile(file).metadata
    col = next(meta.row_group(0).column(k) for k in range(meta.num_columns) if "ids" in meta.row_group(0).column(k).path_in_schema)
    assert any("DICTIONARY" in e for e in col.encodings) == (encoding == "dictionary")
    assert ("DELTA_BINARY_PACKED" in col.encodings) == (encoding == "delta")
    assert col.has_offset_index and meta.row_group(0).column(0).has_column_index


def test_whole_texts_and_empty_table(spark, tmp_path):
    d = documents(spark, rows())
    a = {(r.doc_id, tuple(r.ids)) for r in token_files.encoded(d, PATH).collect()}
    assert a == {(r.doc_id, tuple(r.ids)) for r in token_files.encoded(d, PATH, whole=True).collect()}
    token_files.write(empty(spark), str(tmp_path / "e"), PATH)
    assert token_files.positions(spark, str(tmp_path / "e")).count() == 0


def test_metadata_reads_leave_the_ids(spark, tmp_path):
    token_files.write(documents(spark, rows()), str(tmp_path / "m"), PATH)
    plan = token_files.read(spark, str(tmp_path / "m"), ("doc_id", "n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_positions_decode_the_ids_once(spark, tmp_path, monkeypatch):
    """The running total samples its rows and then deals them out: both read what was kept, not the ids again."""
    token_files.write(documents(spark, rows()), str(tmp_path / "o"), PATH)
    seen = []
    monkeypatch.setattr(token_files, "running_total", lambda df, *a: seen.append(df) or common.running_total(df, *a))
    assert token_files.positions(spark, str(tmp_path / "o")).count() == len(rows())
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_pieces_in_two_generations(monkeypatch):
    """A cache too small for a text's pieces changes no id."""
    monkeypatch.setattr(token_files, "CACHE", 20)
    own, texts = token_files.Pieces(PATH), [t for _, t in rows()]
    for _ in range(2):
        for k in range(0, len(texts), 25):
            part = texts[k:k + 25]
            assert [x.tolist() for x in own.ids(pa.array(part, pa.string()))] == [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
