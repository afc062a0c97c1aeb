"""Prefixes, most of what the join writes, are written once in the near-copy stage, and the groups are the same."""

from runloom.llm import common, jaccard_join, simhash


def test_prefixes_are_written_once(spark, monkeypatch):
    seen = []
    whole = common.written
    monkeypatch.setattr(common, "written", lambda df, name: seen.append((name, "prefix" in df.columns)) or whole(df, name))
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["z"])), (3, " ".join(base)), (4, "a b c"), (5, None), (6, "")]
    rows += [(10 + i, " ".join(f"v{i}x{j}" for j in range(40))) for i in range(5)]
    kept = simhash.first_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 10, 11, 12, 13, 14]
    assert [name for name, has in seen if has] == ["rows"]


def test_links_are_the_same_either_way(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :])) for i in range(0, 60, 6)]
    texts = jaccard_join.marked(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = jaccard_join.described(texts, 4, 60)
    own = jaccard_join.links_between(jaccard_join.points_of(found), texts, 4, 60)
    points, prefixes = jaccard_join.points_of(found, prefixes=False), jaccard_join.prefixes_of(found)
    apart = jaccard_join.links_between(points, texts, 4, 60, prefixes=prefixes)
    assert "prefix" not in points.columns
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, apart.collect())) != []
