import glob
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_files
from tidemark.llm.queries import op1_token_files, tokenizer_file

TOKENIZER = Tokenizer.from_file(tokenizer_file())
ENCODER = token_files.Encoder(tokenizer_file())
ALPHABET = "aB.,'ñ× \n\t\x1c  é日9_$🙂ſ᠎​"


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def encoded(encoder, text):
    ids, sizes = encoder.encode_all(["a b", text or "", "", "c."])
    assert sizes[0] == 3 and ids[-1] == ids[sizes[0] - 1] == 2 and sizes.sum() == len(ids)
    return ids[sizes[0] : sizes[0] + sizes[1] - 1].tolist()


def expected(rows):
    start, found = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text) + [2]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=40))
def test_pieces_give_the_ids_of_the_whole(text):
    assert encoded(ENCODER, text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encoded(ENCODER, text) == plain(text)


@pytest.mark.parametrize("text", ["<|endoftext|> a", "we're it's. They'll,. x", "x " + "y" * 23 + " " + "z" * 24 + ". " + "é" * 12 + ", end ", "a  b   c ", " lead", "a \n b"])
def test_special_places(text):
    assert encoded(ENCODER, text) == plain(text)


def test_small_table_changes_nothing(documents):
    encoder = token_files.Encoder(tokenizer_file(), pieces=50)
    texts = [r.text for r in documents.limit(60).collect()]
    for low in range(0, 60, 7):
        ids, sizes = encoder.encode_all(texts[low : low + 7])
        assert ids.tolist() == [i for t in texts[low : low + 7] for i in [*plain(t), 2]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab., \né×÷À\x00"), max_size=30), max_size=6))
def test_many_texts_at_a_time(texts):
    ids, sizes = ENCODER.encode_all(texts)
    assert sizes.tolist() == [len(plain(t)) + 1 for t in texts]
    assert ids.tolist() == [i for t in texts for i in [*plain(t), 2]]


def test_query_against_plain_encoding(spark, folder, documents):
    rows = op1_token_files(spark, folder).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == expected([(r.doc_id, r.text) for r in documents.collect()])


def test_file_layout_and_selective_reads(spark, documents, tmp_path):
    path = token_files.write_tokens(documents, tokenizer_file(), str(tmp_path / "t"))
    files = sorted(glob.glob(f"{path}/tokens/*.parquet"))
    last = -1
    for name in files:
        table = pq.ParquetFile(name)
        ids = table.read(["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
        columns = {table.metadata.row_group(0).column(i).path_in_schema: table.metadata.row_group(0).column(i)
                   for i in range(table.metadata.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["offset"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    metadata = token_files.read_metadata(spark, path)
    assert not re.search(r"\btokens#", metadata._jdf.queryExecution().executedPlan().toString())
    one = token_files.read_tokens(spark, path).filter("doc_id = 17")
    assert "EqualTo(doc_id,17)" in one._jdf.queryExecution().executedPlan().toString()
    row = one.first()
    assert row.tokens == plain(documents.filter("doc_id = 17").first().text) + [2]


def test_awkward_rows(awkward):
    rows = token_files.tokenize(awkward, tokenizer_file()).collect()
    assert len(rows) == awkward.count()
    assert sorted(r.n_tokens for r in rows if r.doc_id in (3, 4)) == [1, 1]
    long = next(r for r in rows if r.doc_id == 6)
    assert long.n_tokens == len(plain(awkward.filter("doc_id = 6").first().text)) + 1
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()


def test_empty_table(nothing):
    assert token_files.tokenize(nothing, tokenizer_file()).collect() == []
