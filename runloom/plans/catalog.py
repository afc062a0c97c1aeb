"""The registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.columns import sigmoid, softmax
from runloom.functions.tokenizers import arrow_tokenizer, portable_tokenizer
from runloom.operators import (
    chats,
    dispatch,
    encoding,
    latency,
    raw_records,
    records,
    routing,
    sampling,
    series,
    summary,
    templates,
    vocabulary,
)
from runloom.plans import prepare, views
from runloom.session import checkpointed, scratch_path
from runloom.sources import records as record_files
from runloom.sources import run_logs
from runloom.streaming import event_time, rolling, tail_log

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

CAPACITY_FACTOR = 1.25


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Sums of doubles depend on their order, so results are compared rounded.

    Ratios of counts get more places, where they cannot lie on the border of two values.
    """
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, places) + 0.0 for c in doubles})


def listed(ids: str) -> Column:
    """An id array as text."""
    return F.concat_ws(" ", F.col(ids).cast("array<string>"))


# ---- sources and sinks ----


def _written_records(spark: SparkSession, sf_dir: str, ending: str) -> str:
    path = scratch_path(spark, "records") + ending
    rows = views.instructions(spark, sf_dir).drop("id")
    if ending == ".csv":
        rows.write.csv(path, header=True, quoteAll=True, escape='"')
    else:
        rows.write.json(path)
    return path


@query
def read_records(spark, sf_dir):
    return record_files.read_records(spark, _written_records(spark, sf_dir, ".jsonl"))


@query
def read_records_csv(spark, sf_dir):
    rows = record_files.read_records(spark, _written_records(spark, sf_dir, ".csv"))
    return rows.na.fill("")


@query
def read_split_files(spark, sf_dir):
    path = scratch_path(spark, "records")
    split = sampling.split_exact_floor(views.instructions(spark, sf_dir), "id")
    record_files.write_splits(split.drop("id"), path)
    paths = {name: f"{path}/split={name}" for name in ("train", "validation")}
    rows = record_files.read_split_files(spark, paths)
    return rows.groupBy("split").agg(
        F.count("*").alias("rows"), F.sum(F.length("instruction")).alias("chars")
    )


@query
def concat_splits(spark, sf_dir):
    return record_files.concat_splits(*views.pools(spark, sf_dir))


@query
def read_scalar_log(spark, sf_dir):
    return run_logs.read_scalar_log(views.scalar_log(spark, sf_dir))


@query
def scalar_tags_by_prefix(spark, sf_dir):
    return run_logs.scalar_tags_by_prefix(views.scalar_log(spark, sf_dir), "train/step_time_ms/rank")


@query
def read_run_artifacts(spark, sf_dir):
    root = scratch_path(spark, "runs")
    report = latency.benchmark_report(views.requests(spark, sf_dir))
    named = report.withColumns({"run": F.col("method"), "file": F.col("workload")})
    named.write.partitionBy("run", "file").json(root)
    rows = run_logs.read_run_artifacts(
        spark, root, "benchmark", files="file=*/*.json", run_pattern="run=([^/]+)/"
    )
    return rounded(rows.select("run", *report.columns))


@query
def explode_snapshot(spark, sf_dir):
    tokens = views.router_tokens(spark, sf_dir)
    means = dispatch.mean_weights(tokens, softmax(F.col("logits")), views.EXPERTS)
    pair = F.struct("expert_id", F.round("mean_weight", 6).alias("w"))
    layers = means.groupBy("layer").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    entry = F.struct(F.col("layer").cast("string"), F.transform("pairs", lambda p: p["w"]))
    snapshot = layers.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("snapshot"))
    rows = run_logs.explode_snapshot(snapshot, keys=())
    return rounded(rows.withColumn("layer", F.col("layer").cast("int")))


@query
def snapshot_leaves(spark, sf_dir):
    """A snapshot whose layout no schema knows."""
    tokens = views.router_tokens(spark, sf_dir)
    means = dispatch.mean_weights(tokens, softmax(F.col("logits")), views.EXPERTS)
    pair = F.struct("expert_id", F.round("mean_weight", 6).alias("w"))
    layers = means.groupBy("layer").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    weights = F.struct(F.transform("pairs", lambda p: p["w"]).alias("mean"), F.lit("soft").alias("kind"))
    entry = F.struct(F.concat(F.lit("layer"), "layer"), weights)
    named = F.struct(F.map_from_entries(F.collect_list(entry)).alias("layers"), F.lit(None).alias("note"))
    snapshot = layers.agg(F.to_json(named, {"ignoreNullFields": "false"}).alias("value"))
    return rounded(raw_records.leaves(raw_records.parse_records(snapshot), keys=()))


@query
def write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    split = sampling.split_exact_floor(views.instructions(spark, sf_dir), "id")
    record_files.write_splits(split, path)
    schema = "id BIGINT, instruction STRING, input STRING, output STRING, split STRING"
    return spark.read.schema(schema).json(path)


@query
def dataset_info(spark, sf_dir):
    split = sampling.split_exact_floor(views.instructions(spark, sf_dir), "id")
    return record_files.dataset_info(split, "alpaca")


@query
def write_summary(spark, sf_dir):
    path = scratch_path(spark, "summary")
    run_logs.write_summary(run_summary(spark, sf_dir), path)
    schema = ", ".join(f"{c} {'STRING' if c == 'run' else 'DOUBLE'}" for c in summary.HEADERS)
    return rounded(spark.read.csv(path, header=True, schema=schema))


def _json_array(spark: SparkSession, rows: DataFrame) -> str:
    """Rows as files with one JSON array each."""
    path = scratch_path(spark, "arrays")
    text = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ",\n "), F.lit("]"))
    # The records of 500 chats per file.
    files = rows.withColumn("nested", F.struct(F.lit('{"}').alias("odd"))).groupBy(F.floor(F.col("id") / 500_000_000).alias("_file"))
    # The text writer puts texts after each other in a file, here one each.
    files.agg(text.alias("value")).write.partitionBy("_file").text(path)
    return path


@query
def read_records_array(spark, sf_dir):
    path = _json_array(spark, views.instructions(spark, sf_dir))
    return record_files.read_records(spark, path, file_format="json")


@query
def write_splits_counted(spark, sf_dir):
    split = sampling.split_exact_floor(views.instructions(spark, sf_dir), "id")
    manifest = record_files.write_splits_counted(split, scratch_path(spark, "counted"), "alpaca")
    return spark.createDataFrame([tuple(manifest.values())], prepare.MANIFEST)


# ---- records, chats, prompts ----


def _records_with_nulls(spark, sf_dir):
    return views.instructions(spark, sf_dir).withColumn("output", F.nullif(F.col("output"), F.lit("")))


@query
def validate_format(spark, sf_dir):
    return records.validate_format(_records_with_nulls(spark, sf_dir), "alpaca")


@query
def validate_format_errors(spark, sf_dir):
    return records.format_errors(_records_with_nulls(spark, sf_dir), "alpaca")


def _raw_records(spark, sf_dir):
    """JSON lines: an empty output is absent in one half of the chats and an explicit null in the other."""
    rows = _records_with_nulls(spark, sf_dir)
    fields = F.struct("instruction", "input", "output", F.col("id").alias("extra"))
    even = F.floor(F.col("id") / 1_000_000) % 2 == 0
    line = F.when(even, F.to_json(fields)).otherwise(F.to_json(fields, {"ignoreNullFields": "false"}))
    return raw_records.parse_records(rows.select("id", line.alias("value")))


@query
def validate_keys(spark, sf_dir):
    return raw_records.validate_keys(_raw_records(spark, sf_dir), "alpaca")


@query
def validate_keys_errors(spark, sf_dir):
    return raw_records.key_errors(_raw_records(spark, sf_dir), "alpaca")


@query
def other_fields(spark, sf_dir):
    found = raw_records.other_fields(_raw_records(spark, sf_dir), ["instruction", "input", "output"])
    return found.select("id", "field", F.variant_get("value", "$", "bigint").alias("value"))


@query
def validate_head(spark, sf_dir):
    return records.validate_head(_records_with_nulls(spark, sf_dir), "alpaca")


@query
def flatten_first_turns(spark, sf_dir):
    return chats.flatten_first_turns(views.table(spark, sf_dir, "conversations"))


@query
def flatten_messages(spark, sf_dir):
    nested = chats.group_chat(views.table(spark, sf_dir, "conversations"))
    messages = F.transform(
        "conversations", lambda t: F.struct(t["from"].alias("role"), t["value"].alias("content"))
    )
    columns = {"human": "instruction", "gpt": "response"}
    flat = chats.flatten_messages(nested.withColumn("messages", messages), columns=columns)
    return flat.select("conv_id", *columns.values())


@query
def filter_complete_pairs(spark, sf_dir):
    return chats.filter_complete_pairs(flatten_first_turns(spark, sf_dir))


@query
def group_chat(spark, sf_dir):
    nested = chats.group_chat(views.table(spark, sf_dir, "conversations"))
    lines = F.transform("conversations", lambda t: F.concat_ws(": ", t["from"], t["value"]))
    return nested.select(
        "conv_id",
        F.size("conversations").alias("turns"),
        F.concat_ws("\n", lines).alias("rendered"),
    )


@query
def render_prompt(spark, sf_dir):
    return records.render_prompt(views.instructions(spark, sf_dir)).select("id", "prompt")


@query
def render_full_text(spark, sf_dir):
    prompts = records.render_prompt(views.instructions(spark, sf_dir))
    return records.render_full_text(prompts, "</s>").select("id", "full_text")


@query
def render_short_text(spark, sf_dir):
    return records.render_short_text(views.instructions(spark, sf_dir)).select("id", "text")


@query
def select_eval_text(spark, sf_dir):
    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = views.instructions(spark, sf_dir).select("id", "instruction")
    both = texts.unionByName(asked, allowMissingColumns=True)
    return records.select_eval_text(both).select("id", "eval_text")


@query
def clamp_lengths(spark, sf_dir):
    held = records.clamp_lengths(views.requests(spark, sf_dir), "prompt_len_raw", "output_tokens")
    return held.select("id", "prompt_len", "gen_len")


@query
def exclude_labels_or_all(spark, sf_dir):
    return records.exclude_labels_or_all(views.runs(spark, sf_dir), "run", ["click", "err"])


@query
def format_hook(spark, sf_dir):
    def from_documents(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("doc_id").alias("id"),
            F.concat(F.lit("Name the source of this "), "lang", F.lit(" text.")).alias("instruction"),
            F.col("text").alias("input"),
            F.col("source").alias("output"),
        )

    records.register_format("documents", from_documents)
    return records.format_hook(views.table(spark, sf_dir, "documents"), "documents")


# ---- sampling ----


def _documents(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


@query
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(_documents(spark, sf_dir), "doc_id", 100)


@query
def head_sample(spark, sf_dir):
    return sampling.head_sample(_documents(spark, sf_dir), "doc_id", 100)


@query
def seeded_shuffle(spark, sf_dir):
    return sampling.shuffle_positions(_documents(spark, sf_dir), "doc_id")


@query
def split_exact_floor(spark, sf_dir):
    return sampling.split_exact_floor(_documents(spark, sf_dir), "doc_id")


@query
def split_library(spark, sf_dir):
    pairs = flatten_first_turns(spark, sf_dir)
    return sampling.split_library(pairs, "conv_id").select("conv_id", "split")


@query
def expand_templates(spark, sf_dir):
    served = views.requests(spark, sf_dir).select("id", "workload")
    return templates.expand_templates(served, "id")


# ---- encoding ----


def _tokenized(spark, sf_dir, max_length=None):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encoding.tokenize(documents, max_length=max_length, tokenizer=portable_tokenizer)
    return ids.select("doc_id", F.size("input_ids").alias("tokens"), listed("input_ids").alias("input_ids"))


@query
def tokenize(spark, sf_dir):
    return _tokenized(spark, sf_dir)


@query
def tokenize_truncated(spark, sf_dir):
    return _tokenized(spark, sf_dir, max_length=512)


@query
def tokenize_vocabulary(spark, sf_dir):
    """Ids of a vocabulary of the words that occur twice or more."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    known = vocabulary.build_vocabulary(documents, min_count=2)
    encoded = vocabulary.encode(documents, known, "doc_id")
    return encoded.select("doc_id", F.size("input_ids").alias("tokens"), listed("input_ids").alias("input_ids"))


@query
def build_vocabulary(spark, sf_dir):
    """The 2,000 most frequent words of the documents."""
    documents = views.table(spark, sf_dir, "documents").select("text")
    return vocabulary.build_vocabulary(documents, size=2_000)


def _utf8_encoder():
    """A byte-level tokenizer, as an example of a Python callable."""
    return lambda texts: [np.frombuffer(text.encode("utf-8"), np.uint8).astype("int32") for text in texts]


@query
def tokenizer_plugin(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encoding.tokenize(documents, tokenizer=arrow_tokenizer(_utf8_encoder))
    return encoded.select("doc_id", F.size("input_ids").alias("tokens"), listed("input_ids").alias("input_ids"))


def _encoded(spark, sf_dir, max_length=512):
    prompts = records.render_prompt(views.instructions(spark, sf_dir))
    return encoding.encode_words(prompts, max_length=max_length, portable=True)


def _example(df: DataFrame, *extra: str) -> DataFrame:
    names = ("input_ids", "attention_mask", "labels")
    return df.select("id", *extra, *[listed(c).alias(c) for c in names])


@query
def encode_masked(spark, sf_dir):
    return _example(_encoded(spark, sf_dir))


@query
def filter_trainable(spark, sf_dir):
    return _example(encoding.filter_trainable(_encoded(spark, sf_dir, max_length=48)))


@query
def encode_padded(spark, sf_dir):
    texts = records.render_short_text(views.instructions(spark, sf_dir))
    return _example(encoding.encode_padded(texts, max_length=128, tokenizer=portable_tokenizer))


@query
def pad_batches(spark, sf_dir):
    encoded = encoding.filter_trainable(_encoded(spark, sf_dir, max_length=128))
    return _example(encoding.pad_batches(encoded, "id", batch_size=16), "batch", "width")


@query
def split_counts(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    pairs = chats.flatten_first_turns(turns)
    return encoding.split_counts(prepare.encode_pairs(pairs, "conv_id", fraction=0.1))


# ---- latency ----


@query
def latency_percentiles(spark, sf_dir):
    return rounded(latency.latency_percentiles(views.requests(spark, sf_dir)))


@query
def latency_sketches(spark, sf_dir):
    """Hourly sketches merged to one per group: whether each percentile's rank is within the stated error."""
    requests = views.requests(spark, sf_dir)
    keys = list(latency.GROUP)
    hourly = latency.latency_sketches(requests.withColumn("hour", F.date_trunc("hour", "ts")), [*keys, "hour"])
    report = latency.sketch_percentiles(latency.merge_sketches(hourly))
    names = list(latency.PERCENTILES)
    ms = requests.select(*keys, (F.col("latency_s") * 1000).alias("ms")).join(F.broadcast(report), keys)
    # The ranks that a value has, from the one after all smaller ones to the one of its last copy.
    below = [F.avg((F.col("ms") < F.col(n)).cast("int")).alias(f"{n}_below") for n in names]
    upto = [F.avg((F.col("ms") <= F.col(n)).cast("int")).alias(f"{n}_upto") for n in names]
    ranks = ms.groupBy(*keys, "num_requests").agg(*below, *upto)
    error = latency.rank_error()
    fits = [
        ((F.col(f"{n}_below") <= share + error) & (F.col(f"{n}_upto") >= share - error)).alias(n.replace("_ms", "_within"))
        for n, share in latency.PERCENTILES.items()
    ]
    return ranks.select(*keys, "num_requests", *fits)


@query
def throughput(spark, sf_dir):
    return rounded(latency.throughput(views.requests(spark, sf_dir)))


@query
def tail_amplification(spark, sf_dir):
    report = latency.latency_percentiles(views.requests(spark, sf_dir))
    return rounded(latency.tail_amplification(report).select(*latency.GROUP, "tail_amplification"))


@query
def stall_ratio(spark, sf_dir):
    return rounded(latency.stall_ratio(views.requests(spark, sf_dir)))


@query
def benchmark_report(spark, sf_dir):
    return rounded(latency.benchmark_report(views.requests(spark, sf_dir)))


@query
def compare_runs(spark, sf_dir):
    report = latency.benchmark_report(views.requests(spark, sf_dir))
    return rounded(latency.compare_runs(report, "click", "view"))


@query
def latency_cdf_points(spark, sf_dir):
    report = latency.latency_percentiles(views.requests(spark, sf_dir)).drop("latency_p999_ms")
    return rounded(latency.latency_cdf_points(report))


@query
def arrival_offsets(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rounded(latency.arrival_offsets(events, ["user_id"], "ts").drop("ts"))


# ---- routing ----


def _assigned(spark, sf_dir):
    return routing.topk_route(views.router_tokens(spark, sf_dir))


def _dispatched(spark, sf_dir):
    return dispatch.dispatch(views.router_tokens(spark, sf_dir), routing.DEFAULT_TOP_K, CAPACITY_FACTOR)


def _kept(spark, sf_dir):
    return dispatch.assignments(_dispatched(spark, sf_dir))


def _soft_means(spark, sf_dir):
    tokens = views.router_tokens(spark, sf_dir)
    return dispatch.mean_weights(tokens, softmax(F.col("logits")), views.EXPERTS)


def _sigmoid_means(spark, sf_dir):
    tokens = views.router_tokens(spark, sf_dir)
    return dispatch.mean_weights(tokens, F.transform("logits", sigmoid), views.EXPERTS)


def _experts(spark, sf_dir):
    return dispatch.expert_sums(_dispatched(spark, sf_dir), views.EXPERTS)


def _counts(spark, sf_dir):
    return _experts(spark, sf_dir).select("layer", "expert_id", "raw_tokens", "tokens")


@query
def to_token_rows(spark, sf_dir):
    tokens = routing.to_token_rows(views.router_logits(spark, sf_dir))
    first = F.col("logits")[0].alias("first_logit")
    return rounded(tokens.select(*routing.TOKEN, F.size("logits").alias("experts"), first))


@query
def router_softmax(spark, sf_dir):
    return rounded(routing.router_softmax(views.router_tokens(spark, sf_dir)))


@query
def router_sigmoid(spark, sf_dir):
    return rounded(routing.router_sigmoid(views.router_tokens(spark, sf_dir)))


@query
def topk_route(spark, sf_dir):
    return rounded(_assigned(spark, sf_dir))


@query
def topk_or_dense(spark, sf_dir):
    return rounded(routing.topk_or_dense(views.router_tokens(spark, sf_dir), views.EXPERTS))


@query
def capacity_enforce(spark, sf_dir):
    return rounded(_kept(spark, sf_dir).drop("weight", "num_experts"))


@query
def renormalize_kept(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return rounded(kept.select(*routing.TOKEN, "expert_id", "kept", "weight"))


@query
def overflow_fraction(spark, sf_dir):
    return rounded(routing.overflow_fraction(_kept(spark, sf_dir)), 9)


@query
def expert_load_stats(spark, sf_dir):
    return rounded(routing.expert_load_stats(_counts(spark, sf_dir)))


@query
def mean_expert_weights(spark, sf_dir):
    return rounded(_experts(spark, sf_dir).select("layer", "expert_id", "mean_weight"))


@query
def routing_stats(spark, sf_dir):
    return rounded(routing.routing_stats(_soft_means(spark, sf_dir)))


@query
def routing_stats_sigmoid(spark, sf_dir):
    return rounded(routing.routing_stats(_sigmoid_means(spark, sf_dir), routing.ACTIVE_SIGMOID))


@query
def collapse_stats(spark, sf_dir):
    return rounded(routing.collapse_stats(_sigmoid_means(spark, sf_dir)))


@query
def balance_dense(spark, sf_dir):
    return rounded(routing.balance_dense(_soft_means(spark, sf_dir)))


@query
def balance_sparse(spark, sf_dir):
    return rounded(dispatch.balance_loss(_experts(spark, sf_dir)))


@query
def balance_variance(spark, sf_dir):
    return rounded(routing.balance_variance(_sigmoid_means(spark, sf_dir)), 12)


@query
def balance_total(spark, sf_dir):
    return rounded(routing.balance_total(routing.balance_dense(_soft_means(spark, sf_dir))), 10)


@query
def layer_metric_log(spark, sf_dir):
    # A table of layers x experts, read many times below.
    experts = checkpointed(_experts(spark, sf_dir))
    losses = dispatch.balance_loss(experts)
    return rounded(routing.layer_metric_log(routing.sparse_layer_stats(experts), losses), 9)


@query
def global_expert_load(spark, sf_dir):
    return rounded(routing.global_expert_load(_soft_means(spark, sf_dir)))


@query
def token_counts_mean(spark, sf_dir):
    return rounded(routing.token_counts_mean(_counts(spark, sf_dir)))


@query
def hot_expert_flags(spark, sf_dir):
    return rounded(routing.hot_expert_flags(_counts(spark, sf_dir), ["layer"]))


def _expert_report(spark, sf_dir):
    keys = list(latency.GROUP)
    cell = [*keys, "layer", "expert_id"]
    soft = views.served(routing.router_softmax(views.router_tokens(spark, sf_dir)))
    sent = views.served(_assigned(spark, sf_dir)).select(*cell, F.lit(1).alias("sent"))
    means = soft.groupBy(*cell).agg(F.avg("weight").alias("mean_weight"))
    counts = sent.unionByName(soft.select(*cell, F.lit(0).alias("sent"))).groupBy(*cell).agg(F.sum("sent").alias("tokens"))
    report = latency.benchmark_report(views.requests(spark, sf_dir))
    return routing.with_expert_figures(report, means, counts, keys)


@query
def benchmark_report_experts(spark, sf_dir):
    report = _expert_report(spark, sf_dir)
    total = F.aggregate("per_expert_token_counts", F.lit(0.0), lambda a, x: a + x)
    return rounded(
        report.select(
            *latency.GROUP,
            "num_requests",
            "max_mean_expert_weight",
            "mean_expert_weight",
            "max_mean_ratio",
            "expert_weight_entropy",
            total.alias("tokens_per_layer"),
        )
    )


@query
def hot_expert_flags_by_run(spark, sf_dir):
    report = _expert_report(spark, sf_dir)
    counts = report.select(*latency.GROUP, F.posexplode("per_expert_token_counts").alias("expert_id", "tokens"))
    return rounded(routing.hot_expert_flags(counts, list(latency.GROUP)))


@query
def expert_heatmap(spark, sf_dir):
    return rounded(routing.expert_heatmap(_soft_means(spark, sf_dir), views.EXPERTS))


@query
def contribution_box(spark, sf_dir):
    return rounded(routing.contribution_box(_soft_means(spark, sf_dir)))


# ---- series ----


@query
def step_durations(spark, sf_dir):
    return rounded(views.step_times(spark, sf_dir).drop("ts"))


@query
def step_pairs(spark, sf_dir):
    marks = views.step_marks(spark, sf_dir)
    return rounded(series.step_durations(marks, ["event_type"], "ts", "event_id", kind="kind").drop("ts", "kind"))


def _values(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_type", "event_id", "value")


@query
def rolling_percentiles(spark, sf_dir):
    return rounded(
        series.rolling_percentiles(_values(spark, sf_dir), ["event_type"], ["event_id"], "value")
    )


@query
def smooth_centered(spark, sf_dir):
    return rounded(series.smooth_centered(views.scalar_log(spark, sf_dir), 10))


@query
def smooth_centered_average(spark, sf_dir):
    return rounded(series.smooth_centered(views.scalar_log(spark, sf_dir), 5, true_average=True))


@query
def final_value(spark, sf_dir):
    return rounded(series.final_value(views.scalar_log(spark, sf_dir)))


@query
def tail_mean(spark, sf_dir):
    return rounded(series.tail_mean(views.scalar_log(spark, sf_dir)), 4)


@query
def series_fallback(spark, sf_dir):
    tags = ["train/routing/global_entropy", "train/routing/global_cv"]
    # Runs with names of even length lack the first series.
    lacking = (F.col("tag") == tags[0]) & (F.length("run") % 2 == 0)
    return rounded(series.series_fallback(views.scalar_log(spark, sf_dir).where(~lacking), tags))


@query
def timing_log(spark, sf_dir):
    return rounded(series.timing_log(views.timed_steps(spark, sf_dir)))


@query
def step_time_distribution(spark, sf_dir):
    # Half of the runs have both series, the second with other values; the rest only the second.
    steps = views.timed_steps(spark, sf_dir).withColumn("rank", F.lit(None).cast("int"))
    path = scratch_path(spark, "timing_log")
    plain = F.regexp_replace("tag", "^train/", "").alias("tag")
    both = F.array(F.struct("tag", "value"), F.struct(plain, F.lit(-1.0).alias("value")))
    series_of_run = F.when(F.length("run") % 2 == 1, both).otherwise(F.array(F.struct(plain, "value")))
    series.timing_log(steps).select("run", "step", F.inline(series_of_run)).write.parquet(path)
    return rounded(series.step_time_distribution(spark.read.parquet(path)))


@query
def rank_step_skew(spark, sf_dir):
    return rounded(series.rank_step_skew(views.scalar_log(spark, sf_dir)))


# ---- summaries ----


@query
def perplexity(spark, sf_dir):
    metrics = views.eval_metrics(spark, sf_dir)
    return rounded(metrics.withColumn("perplexity", summary.perplexity(F.col("eval_loss"))))


@query
def run_summary(spark, sf_dir):
    return rounded(
        summary.run_summary(
            views.runs(spark, sf_dir),
            views.scalar_log(spark, sf_dir),
            views.eval_metrics(spark, sf_dir),
        )
    )


@query
def run_summary_wide(spark, sf_dir):
    return rounded(
        summary.run_summary_wide(
            views.runs(spark, sf_dir),
            views.scalar_log(spark, sf_dir),
            views.eval_metrics(spark, sf_dir),
            latency.benchmark_report(views.requests(spark, sf_dir)),
        )
    )


# ---- streaming ----


#: How late events arrive, and how long the streams wait for them.
LATENESS_HOURS, DELAY = 12, "12 hours"
#: Buckets of the streams' state, in milliseconds of event time.
DAY = 86_400_000


def _arriving(spark: SparkSession, events: DataFrame) -> str:
    """Events as files in order of arrival, up to ``LATENESS_HOURS`` after their time, so each file overlaps the next.

    A last event of no type, later than all others and their delay, lets the watermark pass them.
    """
    path = scratch_path(spark, "arriving")
    late = F.pmod(F.xxhash64("event_id"), F.lit(LATENESS_HOURS * 3600)) * F.expr("INTERVAL 1 SECOND")
    timed = events.withColumn("arrival", F.col("ts") + late)
    first, last = timed.agg(F.min("arrival"), F.max("arrival")).first()
    if first is None:
        return path
    middle = first + (last - first) / 2
    for part in (F.col("arrival") <= F.lit(middle), F.col("arrival") > F.lit(middle)):
        timed.where(part).drop("arrival").write.mode("append").parquet(path)
    end = F.lit(last) + F.expr(f"INTERVAL {DELAY}") + F.expr(f"INTERVAL {2 * DAY // 1000} SECOND")
    closing = [end.alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*closing).write.mode("append").parquet(path)
    return path


def _streamed(spark: SparkSession, events: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream operator makes of the events as they arrive."""
    path, out, state = _arriving(spark, events), scratch_path(spark, "stream"), scratch_path(spark, "state")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, rolling.STATE_STORE)
    result = transform(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(path))
    run = (
        result.writeStream.option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
    )
    run.awaitTermination()
    spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(result.schema).parquet(out)


@query
def stream_rolling_percentiles(spark, sf_dir):
    events = views.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    rolled = lambda s: event_time.rolling_percentiles(s, ["event_type"], "ts", ["event_id"], "value", DELAY, grain=DAY)
    return rounded(_streamed(spark, events, rolled))


def _paired(stream: DataFrame) -> DataFrame:
    return event_time.step_pairs(stream, ["event_type"], "ts", ["event_id"], "kind", DELAY, grain=DAY)


@query
def stream_step_pairs(spark, sf_dir):
    return rounded(_streamed(spark, views.step_marks(spark, sf_dir), _paired).drop("end_micros"))


@query
def stream_timing_log(spark, sf_dir):
    """Marks to rolling step times in one stream: the second operator takes the pairs in the order of the first."""
    rolled = lambda s: rolling.stream_rolling_percentiles(_paired(s), "event_type", ["end_micros", "event_id"], "elapsed_ms")
    return rounded(_streamed(spark, views.step_marks(spark, sf_dir), rolled).drop("end_micros"))


@query
def stream_run_summary_wide(spark, sf_dir):
    """The wide summary from the last points that a stream of log files kept, over several triggers."""
    path, state = scratch_path(spark, "log"), scratch_path(spark, "state")
    log = views.scalar_log(spark, sf_dir)
    for part in range(2):  # new files come in between
        log.where(F.pmod(F.xxhash64("run", "tag", "step"), F.lit(2)) == part).write.mode("append").parquet(path)
    kept = tail_log.TailLog(spark, scratch_path(spark, "tails"))
    stream = spark.readStream.schema(tail_log.SCHEMA).option("maxFilesPerTrigger", 4).parquet(path)
    kept.follow(stream).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    report = latency.benchmark_report(views.requests(spark, sf_dir))
    return rounded(summary.run_summary_wide(views.runs(spark, sf_dir), kept.read(), views.eval_metrics(spark, sf_dir), report))
