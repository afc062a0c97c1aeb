"""Byte codes and tokens of many texts at once: known codes keep their chance, and tokens their numbers."""

import numpy as np
import pytest

from runloom.llm import suffix_tree


def _tree(codes, depth):
    levels = []
    for k in range(depth + 1):
        entries, n = np.unique(codes & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True)
        contexts, of = np.unique(entries >> np.uint64(8), return_inverse=True)
        totals = np.bincount(of, n)
        levels.append(suffix_tree.Level(contexts, totals, entries, n / totals[of]))
    return suffix_tree.SuffixTree(levels, 20.0)


@pytest.mark.parametrize("bits", [3, 20])
def test_known_codes_are_not_looked_up_again(monkeypatch, bits):
    monkeypatch.setattr(suffix_tree, "SLICE_BYTES", 2000)
    monkeypatch.setattr(suffix_tree, "TABLE_BITS", bits)
    read = [b"the cat sat on the mat \n", b"\n", b"a cat \n"] * 2000
    codes = np.concatenate(list(suffix_tree._slices(read, 3)))
    tree, asked = _tree(codes[:100], 3), []
    monkeypatch.setattr(tree, "log10", lambda keys: asked.append(len(keys)) or suffix_tree.SuffixTree.log10(tree, keys))
    scores = tree.token_scores(read)
    alone = suffix_tree.SuffixTree.log10(tree, codes)
    last = codes & np.uint64(255)
    ends = np.flatnonzero((last == 32) | (last == 10)) + 1
    assert np.allclose(scores, np.add.reduceat(alone, np.r_[0, ends[:-1]]), rtol=1e-12)
    if bits == 20:
        assert sum(asked) <= 2 * len(np.unique(codes))


def test_token_numbers():
    read = b"".join(suffix_tree._as_read(t) for t in [b"The cat", b"", b" the\tCAT \x0b"])
    numbers, words = suffix_tree._token_numbers(read)
    assert [words[i] for i in numbers] == [b"the", b"cat", b"", b"", b"the", b"cat", b""]
