"""New segments are merged together as arrays, with the ids that the agenda of each one gives."""

import random
from array import array

from runloom.llm import pieces
from runloom.llm.queries import piece_model


def test_short_segments_are_merged_together(monkeypatch):
    own, r = pieces.Pieces(piece_model()), random.Random(5)
    names, odd = sorted(own.ids), "▁aeéßö漢#%\x01\u0301\U0001f600"
    segments = ["".join(r.choice(names) for _ in range(r.randrange(1, 6)))[: pieces.SHORT] for _ in range(3000)]
    segments += ["".join(r.choice(odd) for _ in range(r.randrange(1, pieces.SHORT + 1))) for _ in range(1500)]
    segments += ["▁", "a", "ab", "#", "##", segments[0]]
    want = [array("i", own.merge(s)).tobytes() for s in segments]
    assert own.merge_short_ones(segments) == want
    assert own.merge_short_ones([]) == []

    texts = [" ".join(f"{r.choice(names)}{i}".replace(pieces.BLANK, "") for i in range(200)) for _ in range(5)] + ["", " ", "x" * 200]
    ids, singly, one = own.library.encode(texts), [], own.merge
    monkeypatch.setattr(own, "merge", lambda s: singly.append(s) or one(s))
    assert own.encode(texts) == [array("i", x).tobytes() for x in ids]
    assert all(len(s) > pieces.SHORT for s in singly)  # before: each of a thousand words
