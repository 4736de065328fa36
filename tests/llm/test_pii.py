import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii
from tidemark.llm.queries import op6_personal_data


def plain_base(text):
    """The base kinds by their patterns as they are written down."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        checked = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1]))
        if 14 <= len(digits) <= 19 and checked % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    order = ("email", "ip", "card", "phone")
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def base(text):
    return [s[:3] for s in pii.in_order(pii.base_spans(text))]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("0123459a@.+-( )é%x"), max_size=40))
def test_base_spans_against_the_patterns(text):
    assert base(text) == plain_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "1.2.3.4", ".5.6", "a.b@c.de", "@x.y",
                                 "+1 (555) 010-9999", "+49 30 1234567", " ", "-", "é", "999.1.1.1", "7"]), max_size=8))
def test_base_spans_of_joined_pieces(parts):
    text = "".join(parts)
    assert base(text) == plain_base(text)


def test_query_against_the_patterns(spark, folder, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op6_personal_data(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")
        )
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def more(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.more_spans(text, pii.base_spans(text))]


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_added_spans():
    assert more("IBAN GB82 WEST 1234 5698 7654 32 PLEASE") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert more("GB82 WEST 1234 5698 7654 31") == []
    assert more("my SSN is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert more("part 123-45-6789 of the list") == []
    assert more("call (555) 010-9999 now") == [("local", "(555) 010-9999")]
    assert more("see 555-010-9999") == []
    assert more("Reisepass C1234567") == [("passport", "C1234567")]
    assert more("order C1234567") == []
    assert more("call +1 555-010-9999") == []  # the base phone covers it


def test_awkward_rows(awkward, nothing):
    rows = pii.find_personal_data(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
               for r in rows if r.doc_id in (3, 4, 5, 7, 8))
    assert pii.find_personal_data(nothing).collect() == []


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "@" * 300_000, "a@" * 150_000, "+1" * 150_000,
                 "+1" + "(" * 300_000, "1 " * 150_000, "A" * 300_000, "AB12" * 70_000, "1-" * 150_000):
        pii.more_spans(text, pii.base_spans(text))
