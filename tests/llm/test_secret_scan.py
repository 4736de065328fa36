import hashlib
import random
import re
import string

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import secret_scan
from tidemark.llm.queries import op7_secrets

KINDS = ("assign", "access", "hex")


def plain_base(text):
    letters = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    found = [("assign", *m.span())
             for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
             if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def base(text):
    runs = [m.span() for m in secret_scan._RUN.finditer(text)]
    return sorted(secret_scan.base_spans(text, runs), key=lambda s: (s[1], KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([
    "password", "PassWD", "secret", "ſecret", "toKen", "toKen", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc.d/",
    "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "g", "-", ".", "é", "x=",
]), max_size=9))
def test_base_spans_against_the_patterns(parts):
    text = "".join(parts)
    assert base(text) == plain_base(text)


def test_query_against_the_patterns(spark, folder, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op7_secrets(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def find(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {r.doc_id: r.spans for r in secret_scan.find_secrets(frame, path, public_tokenizers.PATTERN).collect()}


def test_token_efficiency(spark):
    rows = {
        1: "key xK9vQ2mZ7pL4wR8tY3nB6cD1 end",
        2: "the internationalization_of_communications2024 text",
        3: "550e8400-e29b-41d4-a716-446655440000",
        4: "D41D8CD98F00B204E9800998ECF8427E",
        5: "/usr/local/share/documentation/configuration",
        6: "d41d8cd98f00b204e9800998ecf8427e",
        7: "secret=xK9vQ2mZ7pL4wR8tY3nB6cD1",
    }
    found = find(spark, list(rows.items()))
    assert found == {1: "random:4:28", 2: "", 3: "", 4: "", 5: "", 6: "hex:0:32", 7: "assign:0:31"}


def test_awkward_rows(spark, awkward, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = secret_scan.find_secrets(awkward, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == awkward.count()
    assert {r.spans for r in rows if r.doc_id in (3, 4, 5, 7, 8)} == {""}
    assert next(r for r in rows if r.doc_id == 6).n_hex == 2
    assert secret_scan.find_secrets(nothing, path, public_tokenizers.PATTERN).collect() == []


def test_random_letters_are_found(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(string.ascii_letters, k=(20, 24, 32, 40, 64)[i % 5]))) for i in range(500)]
    found = find(spark, rows)
    assert sum(found[i] == f"random:0:{len(text)}" for i, text in rows) >= 475
    words = {1: "configuration_management_department", 2: "internationalization-of-communications_2024"}
    assert find(spark, list(words.items())) == {1: "", 2: ""}


def found_in(text):
    runs = [m.span() for m in secret_scan._RUN.finditer(text)]
    vocabulary = secret_scan._vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return secret_scan.random_spans(text, runs, base(text), vocabulary)


def test_words_in_front_hide_no_secret():
    rng = random.Random(5)
    for words in ("", "authorization=", "download/documents/archive/index=", "files/shared/documents/archive/index/"):
        for size in (20, 32, 40):
            for _ in range(50):
                secret = "".join(rng.choices(string.ascii_letters + string.digits, k=size))
                text = f"see {words}{secret} end"
                begin = 4 + len(words)
                assert any(a <= begin and b >= begin + size for _, a, b in found_in(text)), text


def test_paths_without_secrets_are_left_alone():
    digest = hashlib.sha256(b"x").hexdigest()
    for run in (
        f"files/documents/{digest}/index",
        "files/documents/123e4567-e89b-12d3-a456-426614174000/index",
        "download/documents/archive/index/2024/11/05/politics",
        "a" * 50_000,
        "=" * 40 + "/" * 40,
        "some_rather_long_name_of_a_function_with_words",
    ):
        assert found_in(f"see {run} end") == [], run
    assert len(found_in("word-" * 4000 + "x9Qz7Lw2Kd8Vb4Tn6Rj3" + "-word" * 4000)) == 1
