"""The registered queries and the pipeline against plain versions, over whole small tables."""

import os
import zlib
from collections import defaultdict

import brute
import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_near_copies import groups

import __spark_entry__ as entry
from runloom.llm import queries, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def run(spark, name, sf_dir):
    return entry.queries()[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def rows(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


def test_op1(spark, sf_dir):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{sf_dir}/pages.parquet' ORDER BY page_id").fetchall()
    ends, expected = defaultdict(int), set()
    for page, url, html in pages:
        body = (html or "").encode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
        file = f"{page // 1000:08d}.warc"
        offset, ends[file] = ends[file], ends[file] + len(head.encode()) + len(body) + 4
        kinds = {13: "changed", 31: "missing"}
        expected |= {(file, offset, kinds[page % 97])} if page % 97 in kinds else set()
        expected |= {(file, offset + 1, "extra")} if page % 997 == 7 else set()
    assert {(r.file, r.offset, r.kind) for r in run(spark, "op1_warc_fixity", sf_dir)} == expected


def test_op4(spark, sf_dir, rows):
    encoded = brute.encoded([t for _, t in rows], MODEL)
    expected = {i: (len(x), brute.sha(",".join(map(str, x))), brute.sha(d)) for (i, _), (x, d) in zip(rows, encoded)}
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, "op4_sentencepiece", sf_dir)} == expected


def test_op5(spark, sf_dir):
    chats = defaultdict(list)
    for conv, role, text in duckdb.sql(f"SELECT conv_id, role, text FROM '{sf_dir}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        chats[conv].append((role, text or ""))
    chats[-1] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    got = {r.conv_id: r for r in run(spark, "op5_prefix_tree", sf_dir)}
    assert got.keys() == chats.keys()
    for conv, chat in chats.items():
        loss = "".join(t for r, t in chat if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for r, t in chat)
        assert tuple(got[conv])[1:5] == (len(chat), brute.sha(turns), len(loss), brute.sha(loss))


def test_op6(spark, sf_dir, rows):
    points = [brute.simhash(t) for _, t in rows]
    expected = {i: (f"{p:016x}", rows[a][0]) for (i, _), p, a in zip(rows, points, brute.linked(points, 4))}
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, "op6_simhash", sf_dir)} == expected


def test_op8_held_out(spark, sf_dir):
    # The smaller tables have too few toxic texts to learn from: 65 of 70 held-out texts are right at sf0.01.
    folder = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    got = run(spark, "op8_toxicity", folder)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    judged = [r.predicted == labels[r.doc_id] for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(judged) >= 0.97 * len(judged) > 0


def test_op10(spark, sf_dir, rows):
    marked = [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]
    scores = brute.tree_score(marked, depth=5, min_share=5e-6, min_gain=20.0, smoothing=20.0, discount=0.9)
    got = {r.doc_id: r for r in run(spark, "op10_suffix_tree", sf_dir)}
    for (i, tokens, known, total, base), score in zip(brute.unigram(marked), scores):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, total)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)


def test_pipeline_equals_plain_stages(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.in_fold(F.col("doc_id"), 5, 0)))

    class Plain(dict):
        def __missing__(self, word):
            terms = (model.finder.words, model.finder.stems)
            found = brute.least_errors(toxicity.plain(word), *terms, toxicity.errors_allowed)
            self[word] = -1 if found is None else found
            return self[word]

    finder = Plain()
    weighed = lambda t: sum(a * b for a, b in zip(model.weights, toxicity.features(t or "", finder)))
    kept = [r for r in rows if weighed(r[1]) < 0]
    roots = groups([t for _, t in kept])  # all pairs, by the similarity of five-word shingles
    kept = [r for n, r in enumerate(kept) if roots[n] == n]
    kept = [(i, cut if gone else t) for (i, t), (_, _, gone, cut) in zip(kept, brute.substrings(kept))]
    connection = duckdb.connect()
    connection.register("documents", pa.table({"doc_id": [i for i, _ in kept], "text": [t for _, t in kept]}))
    connection.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    leaked = {r[0] for r in connection.execute(queries.SQL["op7_decontamination"]).fetchall()}
    kept = [r for r in kept if r[0] not in leaked]
    expected = {i: ids for (i, _), (ids, _) in zip(kept, brute.encoded([t for _, t in kept], MODEL))}
    assert len(expected) < len(rows)
    assert {r.doc_id: list(r.ids) for r in run(spark, "pipeline", sf_dir)} == expected
