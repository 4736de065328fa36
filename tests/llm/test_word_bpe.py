import random
import unicodedata
from hashlib import sha256
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import word_bpe
from tidemark.llm.queries import op11_word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return word_bpe.WordEncoder(Path(PATH).read_text())


def expected(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    raw = np.array(ids, "<u4").tobytes()
    return doc_id, len(ids), sha256(raw).hexdigest(), sha256(decoded.encode()).hexdigest()


def test_query(spark, folder, documents, library):
    found = [tuple(r) for r in op11_word_bpe(spark, folder).orderBy("doc_id").collect()]
    assert found == [expected(library, r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]


def test_every_sign(library, encoder):
    """One text for each code point; also those that this Python has no name for."""
    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    known = [c for c in signs if unicodedata.category(c) not in ("Cn", "Co", "Lo")]
    sample = known[::3] + signs[::97] + signs[:0x600]
    for low in range(0, len(sample), 1000):
        texts = [f"a{c}b{c}{c}" for c in sample[low : low + 1000]]
        for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert encoder.encode(text) == wanted.ids, hex(ord(text[1]))


def test_random_texts(library, encoder):
    rng = random.Random(1)
    parts = list("aAbéÉȩ́ \n'sS'tre12½Σσ日本각🙂_-.İı՘ \x1c ")
    parts += ["<|endoftext|>", "<|startoftext|>", "<|END", "'re", "'LL", " the "]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        ids = library.encode(text, add_special_tokens=False).ids
        raw = encoder.encode_raw(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids == encoder.encode(text), text
        assert encoder.decode_raw(raw) == encoder.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def merged(ids, merges):
    """By a table of (left, right): (rank, id)."""
    table = [{} for _ in range(10)]
    for (a, b), (rank, new) in merges.items():
        table[a][b] = rank << word_bpe._ID_BITS | new
    return word_bpe.merge(ids, table)


def test_merges_of_equal_rank_go_from_the_left():
    merges = {(1, 1): (0, 2), (2, 1): (1, 3)}
    assert merged([1] * 5, merges) == [2, 3]
    assert merged([], merges) == [] and merged([1], merges) == [1]


def test_stale_entries_are_skipped():
    # (0, 1) goes first and leaves the queued (1, 2) without its left symbol.
    assert merged([0, 1, 2], {(0, 1): (0, 5), (1, 2): (1, 6)}) == [5, 2]
    assert merged([1, 2, 3], {(2, 3): (0, 7), (1, 2): (1, 6), (1, 7): (2, 8)}) == [8]


def test_long_words(library, encoder):
    for text in ("a" * 100_000, "ab" * 30_000 + "é" * 10_000, "x" * 300 + "!" * 50_000):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_full_table(library):
    small = word_bpe.WordEncoder(Path(PATH).read_text(), pieces=3)
    text = " ".join(f"word{i % 7} other{i % 5}" for i in range(60))
    raw = small.encode_raw(text)
    assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_unknown_ids_decode_to_nothing(encoder):
    assert encoder.decode([10**6]) == "" and encoder.decode([49407, 10**6, 2411]) == "<|endoftext|> bar</w>"


def test_awkward_rows(awkward, library):
    found = [tuple(r) for r in word_bpe.encode_and_decode(awkward, PATH).collect()]
    assert sorted(found, key=repr) == sorted((expected(library, r.doc_id, r.text) for r in awkward.collect()), key=repr)


def test_empty_table(nothing):
    assert word_bpe.encode_and_decode(nothing, PATH).collect() == []
