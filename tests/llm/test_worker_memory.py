"""What the pipeline's Python functions hold in a worker: no more for more texts than their blocks and caches are meant to."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from runloom.llm import common, pieces, substrings, toxicity
from runloom.llm.queries import piece_model


def _table(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def _peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_block_does_not_hold_its_words():
    r = random.Random(3)
    table = _table([" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(1000)])

    def work():
        block = substrings._Block(table, "doc_id", "text", 13)
        block.candidates(np.ones(len(block.anchors()[2]), bool))

    # 300,000 words: two keys of 8 bytes, the document, and what is sorted.
    assert _peak(work) < 115 * 300_000


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_block_steps_do_not_matter(monkeypatch, step):
    monkeypatch.setattr(substrings, "STEP", step)
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(30)] + [None, "", " \t"]
    block = substrings._Block(_table(texts), "doc_id", "text", 13)
    at, _, _, _ = block.anchors()
    want, begin = set(), 0
    for text in texts:
        n = len((text or "").split())
        want |= {begin + i for i in range(n - block.anchor + 1) if i % block.period in block.cover}
        begin += n
    assert sorted(at.tolist()) == sorted(want)


def test_block_of_empty_texts():
    block = substrings._Block(_table([None, "", " "]), "doc_id", "text", 13)
    assert [len(x) for x in block.anchors()] == [0] * 4
    assert list(block.words()) == [[], [], []]


def test_finder_forgets_words():
    finder = toxicity.Finder(["terrible", "awful"], ["horr"])
    few = [finder[w] for w in ("terible", "awful", "horrid", "x")]
    most = 0
    for i in range(200_000):
        finder[f"k{i}"]
        most = max(most, len(finder))
    assert most <= 150_000
    assert [finder[w] for w in ("terible", "awful", "horrid", "x")] == few


def test_automaton_begins_anew(monkeypatch):
    terms, words = ["terrible", "awful", "disgusting"], ["teribble", "awfull", "disgustng", "other", "awful", "trouble"]
    want = [toxicity.Finder(terms, [])[w] for w in words]
    monkeypatch.setattr(toxicity, "STEPS", 20)
    finder = toxicity.Finder(terms, [])
    assert [finder[w] for w in words] == want
    assert finder.lexicon.held < 20 + sum(map(len, words)) * 30


def test_pieces_forget_segments():
    own = pieces.Pieces(piece_model())
    for begin in range(0, 130_000, 10_000):
        own.encode([" ".join(map(str, range(begin, begin + 10_000)))])
        assert len(own.seen) <= 111_000


def test_texts_come_in_slices():
    texts = ["a", None, "é", ""] * 300
    column = pa.array(texts, pa.string())
    assert list(common.each_string(column)) == [t or "" for t in texts]
    assert list(common.each_text(column.slice(3))) == [(t or "").encode() for t in texts[3:]]
    assert list(common.each_text(pa.chunked_array([column, column]))) == [(t or "").encode() for t in texts * 2]
