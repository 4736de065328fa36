"""What a Python worker keeps between tasks is bounded."""

from tidemark.llm import decontam, token_files
from tidemark.llm.queries import tokenizer_file


def test_one_table_of_powers_serves_batches_of_all_usual_sizes():
    decontam._powers.cache_clear()
    for words in (10, 20_000, 60_000, 10):
        decontam.word_hashes(["token " * words])
    assert decontam._powers.cache_info().misses == 1 and decontam._powers.cache_info().maxsize == 1


def test_first_words_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "_CACHE_OTHERS", 10)
    encoder = token_files.Encoder(tokenizer_file())
    texts = [f"word{i} and more" for i in range(50)]
    ids, sizes = encoder.encode_all(texts)
    assert len(encoder._others) == 10
    alone = [encoder._tokenizer.encode(t, add_special_tokens=False).ids + [token_files.END_ID] for t in texts]
    assert ids.tolist() == [i for own in alone for i in own] and sizes.tolist() == list(map(len, alone))
