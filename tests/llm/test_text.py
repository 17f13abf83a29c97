import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import tokens
from quillon.llm.queries import tokenizer_path
from quillon.llm.textbits import Block, grams, owners, whole

TEXT = st.text(alphabet="ab Z\n\t\x0b\r\x1cé中😀. ", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_words_and_lines_are_those_of_python(texts):
    b = Block.of(texts)
    ws, we, wf = b.words()
    ls, le, lf = b.lines()
    raw = b.data.tobytes()
    for i, t in enumerate(texts):
        t = t or ""
        assert [raw[s:e].decode() for s, e in zip(ws[wf[i] : wf[i + 1]], we[wf[i] : wf[i + 1]])] == re.findall(r"[^\x20\x09-\x0D]+", t)
        assert [raw[s:e].decode() for s, e in zip(ls[lf[i] : lf[i + 1]], le[lf[i] : lf[i + 1]])] == t.split("\n")


def test_hashes_tell_words_apart_wherever_they_stand(corpus):
    b = Block.of([t for _, t in corpus] * 2)
    ws, we, _ = b.words()
    h, raw, seen = b.ranges(ws, we), b.data.tobytes(), {}
    for s, e, x in zip(ws.tolist(), we.tolist(), h.tolist()):
        assert seen.setdefault(raw[s:e].lower(), x) == x
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_in_their_texts():
    b = Block.of(["a b c", "b c d", "a b c d"])
    ws, we, first = b.words()
    g, ok = grams(b.ranges(ws, we), 3), whole(owners(first), 3)
    assert ok.sum() == 4 and len(np.unique(g[ok])) == 2


@pytest.mark.parametrize("most", [5, 400, 500_000])
def test_ids_are_the_librarys_however_few_chunks_are_remembered(corpus, monkeypatch, most):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MAX_CHUNKS", most)
    enc, library = tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = [t or "" for _, t in corpus] + ["", " ", "a\n\n b", "é中 😀\tx", "one two " * 3000]
    for at in range(0, 2 * len(texts), 7):
        part = (texts + texts)[at : at + 7]
        ids, first = enc.encode(Block.of(part))
        for k, t in enumerate(part):
            assert ids[first[k] : first[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 0]


def test_bytes_that_are_no_text_leave_their_neighbours_alone():
    enc = tokens.Encoder(tokenizer_path())
    raw = [b"some words", b"caf\xff\xfe bad", b"more words here"]
    block = Block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ids, first = enc.encode(block)
    for k, t in enumerate(raw):
        assert ids[first[k] : first[k + 1]].tolist() == [*enc.tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 0]
