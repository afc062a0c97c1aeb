"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import (
    chat_tree,
    common,
    contamination,
    filter_audit,
    fixity,
    jaccard_join,
    licenses,
    line_rules,
    pieces,
    simhash,
    substrings,
    suffix_tree,
    toxicity,
    turn_repair,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SQL: dict[str, str] = {}

#: The words of each document, in SQL.
WORDS = r"""words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws
  FROM documents)"""


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def piece_model() -> str:
    """The vocabulary file of the encoding query."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = substrings.remove_repeats(docs, window=13)
    return kept.select("doc_id", "n_words", "n_removed", digest(F.col("kept_text")).alias("kept_sha256"))


SQL["op3_substring_dedup"] = f"""WITH {WORDS},
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM words WHERE len(ws) >= 13),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM windows),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + s AS p
  FROM keyed JOIN firsts USING (k), range(13) r(s) WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text, count(*) AS n
  FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = pieces.encode_decode(docs, piece_model())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", "n_tokens", digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.near_duplicates(docs, radius=4)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = toxicity.in_fold(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs, model, score_col="score")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = suffix_tree.score_texts(docs, train=~toxicity.in_fold(F.col("doc_id"), 7, 2))
    held_out = (~F.col("is_train")).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score")


@query
def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC files against a replica in which, by rule, some records are changed, lost or added."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    flipped = lambda r: F.concat(r.substr(1, 40), F.lit(b"?"), r.substr(42, 2**31 - 1))
    records = fixity.placed_leaves(pages, "page_id", "url", "html", per_file=1000, changes={"flipped": flipped})
    records = common.written(records, "records")
    damage = F.col("page") % 97
    replica = records.where(damage != 31).withColumn("hash", F.when(damage == 13, F.col("flipped")).otherwise(F.col("hash")))
    added = records.where(F.col("page") % 997 == 7).withColumn("offset", F.col("offset") + 1)
    leaf = ("file", "offset", "size", "hash")
    found = fixity.audit(records.select(*leaf).distinct(), replica.unionByName(added).select(*leaf).distinct())
    return found.select(
        "file", "offset", "kind", "left_size", "right_size", "left_hash", "right_hash", "left_root", "right_root"
    )


@query
def op2_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = licenses.scan(docs)
    return found.select(
        "doc_id",
        F.array_join("license_sentences", ";").alias("sentence_ids"),
        F.array_join("licenses", ";").alias("licenses"),
        "n_unknown",
    )


@query
def op5_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    forest, leaves = chat_tree.format_forest(turns.unionByName(extra), ranks, pattern)
    read = chat_tree.read_back(common.written(forest, "forest"), leaves, ranks, pattern)
    return read.select(
        F.col("conv").alias("conv_id"),
        "n_turns",
        digest(F.col("turns")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.find(docs, benchmark)


@query
def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return line_rules.judge(docs)


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join.similar_groups(docs, size=4, percent=85)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Conversations damaged by rule: each row's hash drops it (``present`` false), empties, cuts or repeats it, or changes its role."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(spaced["text"], "[.!?]", "")).otherwise(spaced["text"])
    copies = F.explode(F.array_repeat(fate != 0, F.when(fate == 3, 2).otherwise(1)))
    role = F.when(fate == 4, "user").otherwise(spaced["role"])
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("present"))


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return turn_repair.repair(damaged_turns(turns), present=F.col("present"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flagged = filter_audit.measured(docs)
    flagged = filter_audit.with_labels(flagged, labels, "doc_id", {"good": "quality", "toxic": "toxic"})
    return filter_audit.audit(flagged, "ABCDE", weights=["good", "toxic"])


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express, for DuckDB."""
    return dict(SQL)


SQL["op9_line_frequency"] = rf"""WITH {WORDS},
figures AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(array_to_string(ws, '')), 0) AS word_chars,
    len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls, ws, source, text
  FROM words JOIN documents USING (doc_id)),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM figures WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + s) AS n FROM windows JOIN twice USING (doc_id, k), range(8) r(s) GROUP BY doc_id),
base AS (
  SELECT doc_id, source, text, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM figures LEFT JOIN repeated USING (doc_id)),
lines AS (
  SELECT source, text, line, sum(len(line)) AS size FROM (
    SELECT source, text,
      regexp_replace(trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '[0-9]', '0', 'g') AS line
    FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS x FROM documents))
  WHERE line <> '' GROUP BY ALL),
often AS (
  SELECT source, line FROM lines GROUP BY source, line
  HAVING count(*) > 20),
shares AS (
  SELECT l.source, l.text, coalesce(sum(size) FILTER (WHERE o.line IS NOT NULL), 0) / sum(size) AS share
  FROM lines l LEFT JOIN often o ON l.source = o.source AND l.line = o.line GROUP BY l.source, l.text)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines,
  n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(share, 0) <= 0.5 AS kept,
  CAST(coalesce(share, 0) AS DOUBLE) AS common_share
FROM base LEFT JOIN shares USING (source, text)"""

SQL["op7_decontamination"] = r"""WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws
  FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS iw
  FROM benchmark),
item_runs AS (
  SELECT item_id, len(iw) AS size, list_transform(range(1, len(iw) - 3), lambda i: array_to_string(iw[i:i + 4], ' ')) AS b
  FROM items WHERE len(iw) >= 5),
doc_runs AS (
  SELECT doc_id, len(ws) AS n, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) AS a
  FROM docs WHERE len(ws) >= 5),
marks AS (SELECT DISTINCT unnest(b) AS h, size FROM item_runs),
places AS (SELECT doc_id, unnest(a) AS h, unnest(range(0, len(a))) AS p FROM doc_runs),
starts AS (
  SELECT DISTINCT doc_id, size, least(p, greatest(0, n - 4 - (size - 4))) AS start
  FROM places JOIN marks USING (h) JOIN doc_runs USING (doc_id)),
windows AS (
  SELECT doc_id, size, start, least(n, start + size) AS stop, a[start + 1:start + size - 4] AS w
  FROM starts JOIN doc_runs USING (doc_id)),
pairs AS (
  SELECT doc_id, item_id, start, stop, len(w) + len(b) AS total, list_sum(list_transform(list_distinct(list_intersect(w, b)),
    lambda x: least(len(list_filter(w, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS shared
  FROM windows JOIN item_runs USING (size)),
scored AS (SELECT doc_id, item_id, start, stop, shared / (total - shared) AS similarity FROM pairs WHERE shared > 0),
passed AS (SELECT * FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, start AS first_word, stop - 1 AS last_word, n_windows
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r,
  count(*) OVER (PARTITION BY doc_id, item_id) AS n_windows FROM passed) WHERE r = 1"""

SQL["op13_filter_audit"] = rf"""WITH {WORDS},
measured AS (
  SELECT doc_id, coalesce(lang, '') AS part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * len(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) > 10 * length(coalesce(text, '')) AS c,
    regexp_matches(coalesce(text, ''), '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM words JOIN documents USING (doc_id)),
marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM measured LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS f),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.f, q.f, r.f, s.f, t.f] AS o
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
gone AS (
  SELECT part, filter_order, fails, n, good, toxic,
    list_min(list_filter([CASE WHEN fails[o[1]] THEN 1 END, CASE WHEN fails[o[2]] THEN 2 END, CASE WHEN fails[o[3]] THEN 3 END,
      CASE WHEN fails[o[4]] THEN 4 END, CASE WHEN fails[o[5]] THEN 5 END], lambda x: x IS NOT NULL)) AS hit
  FROM masks, orders),
steps AS (
  SELECT g.part, g.filter_order, r.step, o.o[r.step] AS f,
    sum(n) FILTER (WHERE hit IS NULL OR hit > r.step) AS kept,
    sum(n) FILTER (WHERE hit = r.step) AS removed,
    sum(n) FILTER (WHERE hit < r.step AND fails[o.o[r.step]]) AS redundant,
    sum(n) FILTER (WHERE fails[o.o[r.step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (WHERE hit = r.step) AS good_lost,
    sum(toxic) FILTER (WHERE hit = r.step) AS toxic_lost
  FROM gone g JOIN orders o USING (filter_order), range(1, 6) r(step)
  GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM steps"""

SQL["op11_jaccard_join"] = r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets"""
