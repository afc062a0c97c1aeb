"""The operators against plain versions, on whole small tables and on odd rows."""

import random
import zlib

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare, connect
from runloom.llm import (
    chat_tree,
    contamination,
    fixity,
    licenses,
    line_rules,
    pieces,
    queries,
    simhash,
    substrings,
    suffix_tree,
    toxicity,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

WORDS = [f"w{n}" for n in range(400)]


def passage(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


SHARED = passage("shared", 60)
#: Null id and text, empty and blank texts, repeated rows, one id twice, copies, a shared passage, a very long text.
ODD = [
    (None, "alone here"),
    (None, SHARED),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, SHARED),
    (4, SHARED),
    (5, passage(5, 40) + "\n" + SHARED + " " + passage(6, 30)),
    (6, passage(7, 12)),
    (7, passage(7, 12)),
    (8, passage(8, 13)),
    (9, passage(8, 13)),
    (10, "É ñ ß 日本語 🦙 <s></s> a  b c " + "x" * 5000),
    (11, passage(9, 40_000)),
    (4, passage(10, 20)),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, n) for n, (i, t) in enumerate(ODD)]
    # Columns that clash with names the operators use themselves.
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, block INT").withColumn("key", F.lit("k")).repartition(3)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("window", [13, 5, 1])
def test_substrings(odd, window):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(odd, window=window).collect()]
    assert same(got, brute.substrings(ODD, window))


def test_covers_meet_for_every_pair_of_places():
    for period, cover in substrings.COVERS.items():
        for i in range(period):
            assert any((s in cover) and ((s + i) % period in cover) for s in range(period))


def test_pieces(odd):
    rows = pieces.encode_decode(odd, MODEL).collect()
    expected = [(t, ids, d) for (_, t), (ids, d) in zip(ODD, brute.encoded([t for _, t in ODD], MODEL))]
    assert same([(r.text, list(r.ids), r.decoded) for r in rows], expected)
    assert all(r.n_tokens == len(r.ids) and r.block is not None for r in rows)


def test_agenda_on_random_text():
    own, rng = pieces.Pieces(MODEL), random.Random(1)
    cases = ["".join(rng.choices("ab e▁thx 0é日\n\t🦙", k=rng.randrange(60))) for _ in range(500)]
    import numpy as np

    got = [np.frombuffer(x, np.int32).tolist() for x in own.encode(cases)]
    assert got == [ids for ids, _ in brute.encoded(cases, MODEL)]


def test_masks_cover_the_radius():
    masks, rng = simhash.covering_masks(4), random.Random(2)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(not difference & m for m in masks)


def test_simhash_groups(spark, odd, documents, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_BLOCK", 3)  # so that buckets are dealt out in pairs of blocks
    near = [(100 + n, SHARED.replace("w1", f"v{n}", 1)) for n in range(12)]
    df = documents.union(spark.createDataFrame(near, documents.schema)).union(odd.select("doc_id", "text").where("doc_id > 11 OR doc_id < 3"))
    rows = sorted(texts(df), key=lambda r: r[0])
    points = [brute.simhash(t) for _, t in rows]
    roots = brute.linked(points, 4)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert same(got, [(i, f"{p:016x}", rows[a][0]) for (i, _), p, a in zip(rows, points, roots)])


def test_dense_groups_stay_connected(spark):
    rng = random.Random(3)
    points, x = [], rng.getrandbits(64)
    for _ in range(300):  # a chain of near fingerprints, whose ends are far apart
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
        points.append(x)
    points = list(dict.fromkeys(points))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    from runloom.llm.components import components

    labels = {r.node: r.label for r in components(simhash.links(df, 4), "a", "b").collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    roots = brute.linked(points, 4)
    groups = lambda names: {frozenset(signed[i] for i in range(len(points)) if names[i] == n) for n in set(names)}
    assert groups([labels.get(s, s) for s in signed]) == groups(roots)


def test_suffix_tree(odd):
    train = F.coalesce(F.col("block") % 3 != 0, F.lit(False))
    settings = dict(depth=3, min_share=1e-4, min_gain=2.0, smoothing=5.0, discount=0.9)
    kept = odd.where("doc_id IS NULL OR doc_id <> 11")
    rows = [(n, t, n % 3 != 0) for n, (i, t) in enumerate(ODD) if i != 11]
    got = {r.block: r for r in suffix_tree.score_texts(kept, train, id_col="block", **settings).collect()}
    for (n, tokens, known, total, base), score in zip(brute.unigram(rows), brute.tree_score(rows, **settings)):
        r = got[n]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_op10_returns_what_the_tree_says_of_unknown_words(spark, tmp_path):
    # Both held-out texts have two unknown words.
    held_out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = dict(zip(held_out, ("theca thecat", "zqxjk zzqqxx")))
    rows = [(i, texts.get(i, "the cat sat on the mat " * 50)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op10_suffix_tree"](spark, str(tmp_path)).collect()}
    near, far = (got[i] for i in held_out)
    assert near.held_out and far.held_out and near.n_known == far.n_known == 1
    assert near.spelled_score > far.spelled_score + 5


def test_suffix_tree_without_training_text(odd):
    rows = suffix_tree.score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and r.score < 0 for r in rows)


def test_automaton_finds_what_levenshtein_finds():
    words, stems, rng = ["idiot", "scum", "worthless", "moron"], ["lowei", "pathetic"], random.Random(4)
    lexicon = toxicity.Lexicon(words, stems)
    for _ in range(3000):
        w = list(rng.choice(words + stems) + rng.choice(["", "x", "ab"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choices("abeiotrs", k=rng.randrange(2))
        word = "".join(w)
        costs = [brute.errors(word, t) for t in words if brute.errors(word, t) <= toxicity.errors_allowed(len(t))]
        for s in stems:
            e = min(brute.errors(word[:n], s) for n in range(len(word) + 1))
            costs += [e] if e <= toxicity.errors_allowed(len(s)) else []
        assert lexicon.errors(word) == min(costs, default=None), word


def test_toxicity_on_held_out_texts(spark, odd):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        words = rng.choices(WORDS, k=80)
        if n % 4 == 0:
            words[rng.randrange(80)] = rng.choice(["vermin", "worthless", "vermim", "Vermin,"])
        rows.append((n, " ".join(words), int(n % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, toxic INT")
    labels = df.select("doc_id", "toxic")
    model = toxicity.train(df, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).where("doc_id % 5 = 0").collect()}
    assert sum((got[n] >= 0.5) == bool(t) for n, _, t in rows if n in got) >= 0.97 * len(got)
    assert toxicity.score(odd, model).count() == len(ODD)
    empty = toxicity.train(df, labels.limit(0))
    assert {r.toxicity for r in toxicity.score(odd, empty).collect()} == {0.5}


def test_line_rules(spark, odd):
    common = "This line is on every page of the host."
    rows = [(n, "h" if n % 2 else None, common + "\n" + passage(n, 5 if n == 7 else 60)) for n in range(60)]
    rows.append((60, "h", (common + "\n") * 9))
    df = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING")
    got = {r.doc_id: r for r in line_rules.judge(df).collect()}
    assert got[60].n_dup_lines == 8 and got[60].base_failed and got[60].common_share == 1.0
    assert got[1].kept and 0 < got[1].common_share < 0.5 and not got[7].kept
    assert line_rules.judge(odd.withColumn("source", F.lit(None).cast("string"))).count() == len(ODD)


def test_contamination(spark, odd):
    items = [(1, passage(8, 13)), (2, SHARED), (3, None), (4, "w1"), (5, ""), (6, SHARED)]
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    found = {(r.doc_id, r.item_id): r for r in contamination.find(odd, bench.where("item_id <> 4")).collect()}
    assert {k for k in found} == {(i, n) for i in (None, 4, 5) for n in (2, 6)} | {(8, 1), (9, 1)}
    assert found[5, 2].first_word == 40 and found[5, 2].last_word == 99 and found[5, 2].similarity == 1.0
    one = {r.doc_id for r in contamination.find(odd, bench.where("item_id = 4")).collect()}
    assert one == {i for i, t in ODD if "w1" in brute.words(t)}


def test_licenses(spark, odd):
    mit = ". ".join(s for s, n in licenses.SENTENCES.items() if n.startswith("Mit") and n != "MitRef") + "."
    rows = [(1, "Some words.\nReleased under the MIT License.\nMore."), (2, f"Copyright (c) 2020 Me.\n{mit}"), (3, "See the licence elsewhere.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert list(got[1].licenses) == ["MIT"] and list(got[1].license_sentences) == ["MitRef"]
    assert list(got[2].licenses) == ["MIT"] and got[2].license_sentences[0] == "Copyright"
    assert (list(got[3].licenses), got[3].n_unknown) == ([], 1)
    assert licenses.scan(odd).where("size(licenses) = 0").count() == len(ODD)


def test_fixity(spark):
    rows = [(n, f"http://h/{n}", "é" * (n % 50)) for n in range(500)] + [(None, None, None), (3, None, "")]
    records = fixity.layout(spark.createDataFrame(rows, "p LONG, u STRING, h STRING"), "p", "u", "h", per_file=200)
    leaves = fixity.leaves(records)
    assert fixity.audit(leaves, leaves).count() == 0
    damaged = leaves.where("hash(file, offset) % 50 <> 7").withColumn("hash", F.expr("if(hash(file, offset) % 50 = 9, 'x', hash)"))
    got = {(r.file, r.offset, r.kind) for r in fixity.audit(leaves, damaged).collect()}
    expected = leaves.selectExpr("file", "offset", "hash(file, offset) % 50 AS k").where("k IN (7, 9)").collect()
    assert got == {(r.file, r.offset, "missing" if r.k == 7 else "changed") for r in expected}
    assert {r.kind for r in fixity.audit(damaged.limit(0), leaves).collect()} == {"extra"}


def test_chat_forest(spark):
    said = "</s>[INST] ok \\ [/INST]"
    chats = {1: [("user", "hi"), ("assistant", "a")], 2: [("user", "hi"), ("assistant", "b"), ("user", said)], 3: [("user", "hi"), ("assistant", "a")], 4: [(None, None)], 5: [("assistant", said), ("assistant", "")]}
    rows = [(c, n, r, t) for c, turns in chats.items() for n, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING")
    forest, leaves = chat_tree.format_forest(df, RANKS, PATTERN)
    nodes = forest.collect()
    assert len(nodes) == 7  # the turns shared by conversations 1, 2 and 3 stand once
    for root in {n.root for n in nodes}:
        tree = sorted((n for n in nodes if n.root == root), key=lambda n: n.offset)
        assert [n.offset for n in tree] == [sum(len(m.tokens) for m in tree[:i]) for i in range(len(tree))]
        for n in tree:
            assert n.position == sum(s.end - s.begin for s in n.attention[:-1])
            assert n.attention[-1].begin == n.offset
    got = {r.conv: r for r in chat_tree.read_back(forest, leaves, RANKS, PATTERN).collect()}
    for c, turns in chats.items():
        assert got[c].turns == "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
        assert chat_tree.unescape(chat_tree.escape(said)) == said


def test_empty_tables(spark, odd):
    none = odd.limit(0).withColumn("source", F.lit("h"))
    bench = spark.createDataFrame([(1, SHARED)], "item_id LONG, text STRING")
    assert substrings.remove_repeats(none).count() == 0
    assert pieces.encode_decode(none, MODEL).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_tree.score_texts(none, F.lit(True)).count() == 0
    assert line_rules.judge(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert contamination.find(none, bench).count() == 0
    assert contamination.find(odd, bench.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_twin(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), name, sf_dir) is None


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    before = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * before < len(rows) < before and all(r.round_trip for r in rows)
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
