import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet="ab the\n\t▁éñß中<s>1  in_", max_size=80))


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return spm.Model(PATH)


@given(text=TEXTS)
@settings(max_examples=400, deadline=None)
def test_encode_and_round_trip(lib, own, text):
    ids = own.encode(text)
    assert ids == lib.encode(text)
    assert own.decode(ids) == lib.decode(ids)


@given(ids=st.lists(st.integers(3, 31999) | st.integers(3, 300), max_size=20))
@settings(max_examples=400, deadline=None)
def test_decode(lib, own, ids):
    assert own.decode(ids) == lib.decode(ids)


def test_long_chunk_takes_the_heap(lib, own):
    for text in ("thetion" * 300, "=" * 1000, "x" * 5000, "日本語" * 200):
        assert own.encode(text) == lib.encode(text)
    for n in range(2, 80):
        assert own.encode(("nationalthe" * 9)[:n]) == lib.encode(("nationalthe" * 9)[:n])


@given(texts=st.lists(TEXTS, max_size=30))
@settings(max_examples=150, deadline=None)
def test_many_chunks_at_once(own, texts):
    chunks = [c for t in texts for c in own.chunks.findall(own.normalise(t))]
    assert own.encode_chunks(chunks) == [own.encode_chunk(c) for c in chunks]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs, lib):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_rows:
        ids = lib.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert Counter(map(tuple, spm.digests(odd_docs, PATH).collect())) == Counter((*w, 0) for w in want)
    assert spm.digests(no_docs, PATH).count() == 0
    rows = {(r.doc_id, tuple(r.ids), r.decoded) for r in spm.encoded(odd_docs, PATH).collect()}
    assert rows == {(r[0], tuple(ids := lib.encode(r[1] or "")), lib.decode(ids)) for r in odd_rows}


def test_a_wrong_agenda_shows(lib, own, monkeypatch):
    chunks = [" national", " station", "\n"]
    assert [c[3] for c in spm.checked(own, lib, chunks)] == [True] * 3
    right = own.encode_chunks(chunks)
    monkeypatch.setattr(own, "encode_chunks", lambda _: [right[0], right[1][:-1] + [300], right[2]])
    found = list(spm.checked(own, lib, chunks))
    assert [c[3] for c in found] == [True, False, True] and found[1][1] == right[1][:-1] + [300]


def test_generations_of_chunks():
    texts = [f"word{i} and word{i % 7}" for i in range(400)]
    want = [spm.Encoder(PATH)([t])[0] for t in texts]
    small = spm.Encoder(PATH, 5000)
    assert [small([t])[0] for t in texts] == want and all(w[2] == 0 for w in want) and len(small.now) + len(small.before) < 100
