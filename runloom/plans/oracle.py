"""The registered queries again, as SQL for DuckDB on the same tables."""

from __future__ import annotations

import re
from math import lcm

from runloom.functions.columns import BLANK
from runloom.operators.summary import HEADERS, WIDE_HEADERS, WORKLOADS
from runloom.operators.templates import FILLS, TEMPLATES

# RE2 writes code points above ASCII as \x{...}.
_BLANK = BLANK.replace("\\x85", "\\x{85}").replace("\\xa0", "\\x{a0}")
for _code in ("1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000"):
    _BLANK = _BLANK.replace(f"\\u{_code}", f"\\x{{{_code}}}")

VIEWS = {
    "flat": """SELECT conv_id,
      coalesce(min_by(text, turn) FILTER (WHERE role='user' AND text<>''), '') AS instruction,
      coalesce(min_by(text, turn) FILTER (WHERE role='assistant' AND text<>''), '') AS response
      FROM conversations GROUP BY conv_id""",
    "instructions": """SELECT conv_id * 1000000 + turn AS id, text AS instruction, coalesce(setting, '') AS input,
      CASE WHEN answered THEN answer ELSE '' END AS output FROM (SELECT *,
        lead(role) OVER w = 'assistant' AS answered, lead(text) OVER w AS answer,
        last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS setting
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE role = 'user'""",
    "requests": """SELECT event_id AS id, event_type AS method,
      CASE user_id % 4 WHEN 0 THEN 'homogeneous' WHEN 1 THEN 'heterogeneous'
        WHEN 2 THEN 'bursty' ELSE 'mixed_semantic' END AS workload,
      value / 1000 AS latency_s,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS output_tokens,
      CAST(floor(value) AS INT) AS prompt_len_raw, ts FROM events""",
    "scalar_log": """SELECT run, tag,
      row_number() OVER (PARTITION BY run, tag ORDER BY ts, event_id) AS step, value
      FROM (SELECT event_type AS run, CASE user_id % 5 WHEN 0 THEN 'eval/loss' WHEN 1 THEN 'train/loss'
        WHEN 2 THEN 'train/routing/global_entropy' WHEN 3 THEN 'train/routing/global_cv'
        ELSE concat('train/step_time_ms/rank', CAST(user_id % 4 AS VARCHAR), '/p50') END AS tag,
        ts, event_id, value FROM events)""",
    "eval_metrics": "SELECT event_type AS run, avg(value)/100 AS eval_loss FROM events GROUP BY event_type",
    "router_logits": """SELECT CAST((i-1)//8 AS INT) AS layer, label AS batch_id, vec_id AS token_id,
      CAST((i-1)%8 AS INT) AS expert_id, CAST(embedding[i] AS DOUBLE) AS logit
      FROM embeddings, range(1,65) t(i)""",
    # prompts and tokens
    "prompts": rf"""SELECT *, CASE WHEN regexp_matches(input, '[^{_BLANK}]') THEN
      concat('Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.', chr(10), chr(10), '### Instruction:', chr(10), instruction, chr(10), chr(10), '### Input:', chr(10), input, chr(10), chr(10), '### Response:', chr(10))
      ELSE concat('Below is an instruction that describes a task. Write a response that appropriately completes the request.', chr(10), chr(10), '### Instruction:', chr(10), instruction, chr(10), chr(10), '### Response:', chr(10)) END AS prompt
      FROM instructions""",
    "short_texts": """SELECT id, concat('### Instruction:', chr(10), instruction,
      CASE WHEN input <> '' THEN concat(chr(10), chr(10), '### Input:', chr(10), input) ELSE '' END,
      chr(10), chr(10), '### Response:', chr(10), output) AS text FROM instructions""",
    # routing
    "soft": """SELECT *, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY layer, batch_id, token_id) AS weight
      FROM (SELECT *, max(logit) OVER (PARTITION BY layer, batch_id, token_id) AS m FROM router_logits)""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY layer, batch_id, token_id
      ORDER BY logit DESC, expert_id) - 1 AS choice FROM router_logits""",
    "assigned": "SELECT * FROM ranked WHERE choice < 2",
    "sizes": """SELECT layer, batch_id, CAST(ceil(1.25 * count(DISTINCT token_id) / 8) AS BIGINT) AS capacity
      FROM router_logits GROUP BY ALL""",
    "kept": """SELECT * EXCLUDE (place, capacity), place <= capacity AS kept FROM (
      SELECT *, row_number() OVER (PARTITION BY layer, batch_id, expert_id
        ORDER BY logit DESC, token_id) AS place FROM assigned) JOIN sizes USING (layer, batch_id)""",
    "renormed": """SELECT *, CASE WHEN kept THEN exp(logit) / sum(CASE WHEN kept THEN exp(logit) END)
      OVER (PARTITION BY layer, batch_id, token_id) ELSE 0 END AS weight FROM kept""",
    "cells": """SELECT l.layer, l.batch_id, l.token_id, l.expert_id, coalesce(r.weight, 0) AS weight,
      r.kept IS NOT NULL AS sent, coalesce(r.kept, false) AS kept
      FROM router_logits l LEFT JOIN renormed r USING (layer, batch_id, token_id, expert_id)""",
    "soft_means": "SELECT layer, expert_id, avg(weight) AS m FROM soft GROUP BY ALL",
    "sparse_means": "SELECT layer, expert_id, avg(weight) AS m FROM cells GROUP BY ALL",
    "sigmoid_means": "SELECT layer, expert_id, avg(1/(1+exp(-logit))) AS m FROM router_logits GROUP BY ALL",
    "counts": """SELECT layer, expert_id, count_if(sent) AS raw_tokens, count_if(kept) AS tokens
      FROM cells GROUP BY ALL""",
    "sparse_loss": """SELECT layer, 8 * sum(f * p) AS balance_loss FROM (
      SELECT c.layer, c.expert_id, avg(CAST(c.kept AS INT)) AS f, avg(s.weight) AS p
      FROM cells c JOIN soft s USING (layer, batch_id, token_id, expert_id) GROUP BY ALL) GROUP BY ALL""",
    "overflow": """SELECT layer, count_if(NOT kept) / (count(*) FILTER (WHERE choice = 0) * 8) AS overflow_fraction,
      count_if(NOT kept) / count(*) AS dropped_share FROM kept GROUP BY ALL""",
    "load": """SELECT layer, max(tokens) / (avg(tokens) + 1e-8) AS max_over_mean_load,
      sum(CAST(hot AS INT)) AS hot_expert_count, var_samp(tokens) AS load_variance,
      sum(raw_tokens) AS raw_tokens, sum(tokens) AS kept_tokens
      FROM (SELECT *, tokens > 2 * avg(tokens) OVER (PARTITION BY layer) AS hot FROM counts) GROUP BY ALL""",
    # latency
    "percentiles": """SELECT method, workload, quantile_cont(latency_s*1000, 0.5) AS latency_p50_ms,
      quantile_cont(latency_s*1000, 0.95) AS latency_p95_ms, quantile_cont(latency_s*1000, 0.99) AS latency_p99_ms,
      quantile_cont(latency_s*1000, 0.999) AS latency_p999_ms FROM requests GROUP BY ALL""",
    "report": """SELECT method, workload, count(*) AS num_requests,
      any_value(latency_p50_ms) AS latency_p50_ms, any_value(latency_p95_ms) AS latency_p95_ms,
      any_value(latency_p99_ms) AS latency_p99_ms, any_value(latency_p999_ms) AS latency_p999_ms,
      any_value(latency_p99_ms / (latency_p50_ms + 1e-8)) AS tail_amplification,
      avg(CAST(latency_s * 1000 > 2 * latency_p50_ms AS INT)) AS stall_ratio,
      CASE WHEN sum(latency_s) > 0 THEN sum(output_tokens) / sum(latency_s) ELSE 0.0 END AS throughput_tokens_per_sec,
      CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens
      FROM requests JOIN percentiles USING (method, workload) GROUP BY method, workload""",
    # series
    "tails": """SELECT run, tag, round(avg(value), 4) AS tail_mean FROM (
      SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY step DESC) AS newest FROM scalar_log)
      WHERE newest <= 50 GROUP BY run, tag""",
    "step_points": """SELECT event_type AS run, quantile_cont(value, 0.5) OVER (PARTITION BY event_type
      ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS value FROM events""",
    "served": """SELECT layer, expert_id, weight, choice, CASE token_id % 2 WHEN 0 THEN 'click' ELSE 'view' END AS method,
      CASE (token_id // 2) % 4 WHEN 0 THEN 'homogeneous' WHEN 1 THEN 'heterogeneous'
        WHEN 2 THEN 'bursty' ELSE 'mixed_semantic' END AS workload
      FROM soft JOIN ranked USING (layer, batch_id, token_id, expert_id)""",
    "served_experts": """SELECT method, workload, expert_id, avg(m) AS m, avg(n) AS tokens FROM (
        SELECT method, workload, layer, expert_id, avg(weight) AS m, count_if(choice < 2) AS n FROM served GROUP BY ALL)
      GROUP BY ALL""",
    "step_log": "SELECT * FROM scalar_log WHERE tag LIKE 'train/step_time_ms/%'",
}

_WORDS = r"regexp_extract_all({0}, '[^\s\x0B]+')"
_IDS = "list_transform({0}, lambda t: CAST('0x' || substr(md5(t), 1, 7) AS INT) + 1)"


def _with(sql: str) -> str:
    """Prepend the views that a statement uses, in order."""
    def mentions(text: str) -> set[str]:
        return {name for name in VIEWS if re.search(rf"\b{name}\b", text)}

    used, todo = set(), mentions(sql)
    while todo - used:
        name = (todo - used).pop()
        used.add(name)
        todo |= mentions(VIEWS[name]) - {name}
    parts = [f"{name} AS ({VIEWS[name]})" for name in _ordered(used, mentions)]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def _ordered(names: set[str], mentions) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for needed in sorted(mentions(VIEWS[name]) - {name}):
            visit(needed)
        done.append(name)

    for name in sorted(names):
        visit(name)
    return done


def _rounded(sql: str, *columns: str, places: int = 6) -> str:
    replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}" for c in columns)
    return _with(f"SELECT * REPLACE ({replaced}) FROM ({sql})")


def _joined(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def _encoded(source: str, prompt: str, output: str, limit: int) -> str:
    """Masked examples of a statement with ``id``, a prompt and an output column."""
    return f"""SELECT *, list_transform(input_ids, lambda t: 1) AS attention_mask,
      list_transform(input_ids, lambda t, i: CASE WHEN i <= masked THEN -100 ELSE t END) AS labels,
      len(input_ids) - least(masked, len(input_ids)) AS trainable
      FROM (SELECT *, len({_WORDS.format(prompt)}) AS masked,
        (list_concat({_IDS.format(f"list_concat({_WORDS.format(prompt)}, {_WORDS.format(output)})")}, [0]))[1:{limit}] AS input_ids
        FROM {source})"""


def _example(sql: str, *extra: str) -> str:
    columns = ", ".join(["id", *extra, *[f"{_joined(c)} AS {c}" for c in ("input_ids", "attention_mask", "labels")]])
    return _with(f"SELECT {columns} FROM ({sql})")


def _hash_rank(source: str, key: str) -> str:
    return (
        f"SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) AS position, "
        f"count(*) OVER () AS n FROM {source}"
    )


def _split(source: str, key: str, held_out: str) -> str:
    return f"""SELECT * EXCLUDE (position, n),
      CASE WHEN position <= {held_out} THEN 'validation' ELSE 'train' END AS split
      FROM ({_hash_rank(source, key)})"""


def _text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _template_sql() -> str:
    rows = []
    for number, category in enumerate(TEMPLATES):
        texts, fills = TEMPLATES[category], FILLS[category]
        for slot in range(lcm(len(texts), len(fills))):
            template, fill = texts[slot % len(texts)], fills[slot % len(fills)]
            filled = _text(template)
            for key, value in fill.items():
                filled = f"replace({filled}, {_text('{' + key + '}')}, {_text(value)})"
            rows.append(
                f"({number}, {_text(category)}, {slot}, {lcm(len(texts), len(fills))}, "
                f"CASE WHEN {filled} LIKE '%{{%' THEN {_text(template)} ELSE {filled} END)"
            )
    return f"""SELECT r.id, r.workload, s.category, s.prompt_text FROM
      (SELECT id, workload, position - 1 AS no FROM ({_hash_rank('requests', 'id')})) r
      JOIN (VALUES {', '.join(rows)}) s(no, category, slot, slots, prompt_text)
      ON s.no = r.no % 4 AND s.slot = (r.no // 4) % s.slots"""


def _rolling(order: str = "event_id") -> str:
    frame = f"OVER (PARTITION BY event_type ORDER BY {order} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    columns = ", ".join(f"quantile_cont(value, {share}) {frame} AS {name}" for name, share in shares.items())
    return _rounded(f"SELECT event_type, event_id, value, {columns} FROM events", "value", *shares)


_PAIRS = """SELECT event_id, event_type, ended, (ended - begun) / 1000.0 AS elapsed_ms FROM (SELECT *, epoch_us(ts) AS ended,
  lag(epoch_us(ts)) OVER w AS begun, lag(user_id % 2) OVER w AS kind_before FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE user_id % 2 = 1 AND kind_before = 0"""


def _timing_log() -> str:
    frame = "OVER (PARTITION BY run, rank ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
    parts = [
        f"SELECT run, concat('train/step_time_ms', rank, '/{name}') AS tag, step, "
        f"quantile_cont(value, {share}) {frame} AS value FROM steps"
        for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    ]
    steps = """SELECT event_type AS run, event_id AS step, value, CASE WHEN length(event_type) % 2 = 1
      THEN concat('/rank', user_id % 4) ELSE '' END AS rank FROM events"""
    return f"WITH steps AS ({steps}) {' UNION ALL '.join(parts)}"


def _smooth(width: int, divisor: str) -> str:
    before, after = width // 2, width - 1 - width // 2
    frame = (
        f"OVER (PARTITION BY run, tag ORDER BY step ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    )
    return f"""SELECT run, tag, step, value, CASE WHEN count(*) OVER (PARTITION BY run, tag) >= {width}
      THEN sum(value) {frame} / {divisor.format(frame=frame)} ELSE value END AS smoothed FROM scalar_log"""


def _stats(means: str, active: float) -> str:
    return f"""SELECT layer, -sum(p * ln(p + 1e-9)) AS weight_entropy,
      stddev_samp(m) / (avg(m) + 1e-8) AS weight_cv, count_if(m > {active}) AS active_experts
      FROM (SELECT *, m / (sum(m) OVER (PARTITION BY layer) + 1e-8) AS p FROM {means}) GROUP BY layer"""


def _layer_log() -> str:
    stats = f"SELECT * FROM ({_stats('sparse_means', 0.01)}) JOIN load USING (layer) JOIN overflow USING (layer)"
    scalars = {
        "entropy": "weight_entropy", "cv": "weight_cv", "active_experts": "active_experts",
        "max_over_mean_load": "max_over_mean_load", "hot_expert_count": "hot_expert_count",
        "overflow_fraction": "overflow_fraction",
    }
    parts = [
        f"SELECT concat('routing/layer', lpad(CAST(layer AS VARCHAR), 2, '0'), '/{name}') AS tag, "
        f"CAST({column} AS DOUBLE) AS value FROM stats"
        for name, column in scalars.items()
    ]
    parts += [
        f"SELECT 'routing/global_{name}', avg({column}) FROM stats"
        for name, column in scalars.items()
        if name != "hot_expert_count"
    ]
    parts.append(
        "SELECT 'routing/balance_loss', coalesce(0.01 * avg(nullif(balance_loss, 0)), 0) FROM sparse_loss"
    )
    return f"WITH stats AS ({stats}) {' UNION ALL '.join(parts)}"


def _last(tag: str, name: str) -> str:
    return f"(SELECT run, round(max_by(value, step), 4) AS {name} FROM scalar_log WHERE tag = '{tag}' GROUP BY run)"


def _tail(tag: str, name: str) -> str:
    return f"(SELECT run, tail_mean AS {name} FROM tails WHERE tag = '{tag}')"


def _summary(extra: list[str], columns: list[str]) -> str:
    joins = " ".join(f"LEFT JOIN {e} USING (run)" for e in [_last("train/loss", "final_train_loss"), *extra])
    return f"SELECT {', '.join(columns)} FROM (SELECT DISTINCT event_type AS run FROM events) {joins}"


def _run_summary() -> str:
    evals = "(SELECT run, eval_loss AS final_eval_loss, round(exp(eval_loss), 2) AS final_eval_perplexity FROM eval_metrics)"
    extra = [
        evals,
        _tail("train/routing/global_entropy", "mean_routing_entropy"),
        _tail("train/routing/global_cv", "mean_load_cv"),
    ]
    return _rounded(_summary(extra, list(HEADERS)), *list(HEADERS)[1:])


def _run_summary_wide() -> str:
    evals = "(SELECT run, eval_loss AS final_eval_loss, round(exp(eval_loss), 2) AS eval_perplexity FROM eval_metrics)"
    figures = ", ".join(
        f"max(round({column}, {places})) FILTER (WHERE workload = '{w}') AS {name}_{w}"
        for name, column, places in (
            ("p99_latency", "latency_p99_ms", 1),
            ("tail_amp", "tail_amplification", 3),
        )
        for w in WORKLOADS
    )
    extra = [
        evals,
        _tail("train/routing/global_cv", "mean_load_cv"),
        _tail("train/routing/global_max_over_mean_load", "max_mean_load"),
        _tail("train/routing/global_overflow_fraction", "overflow_fraction"),
        f"(SELECT method AS run, {figures} FROM report GROUP BY method)",
    ]
    return _rounded(_summary(extra, list(WIDE_HEADERS)), *list(WIDE_HEADERS)[1:])


def statements() -> dict[str, str]:
    """A DuckDB statement per registered query."""
    tokens = "layer, batch_id, token_id"
    nulled = "(SELECT * REPLACE (nullif(output, '') AS output) FROM instructions)"
    bad = "(instruction IS NULL OR output IS NULL)"
    floor_split = _split("instructions", "id", "floor(n * CAST(0.1 AS DOUBLE))")
    complete = "(SELECT * FROM flat WHERE instruction <> '' AND response <> '')"
    flagship = _split("flat", "conv_id", "ceil(n * CAST(0.1 AS DOUBLE))")
    plain_prompt = (
        "concat('Below is an instruction that describes a task. Write a response that appropriately "
        "completes the request.', chr(10), chr(10), '### Instruction:', chr(10), instruction, chr(10), "
        "chr(10), '### Response:', chr(10))"
    )
    report_doubles = [
        "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "latency_p999_ms",
        "tail_amplification", "stall_ratio", "throughput_tokens_per_sec",
    ]
    report_columns = ["method", "num_requests", *report_doubles, "total_output_tokens"]
    sides = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in report_columns)
    padded = _encoded("prompts", "prompt", "output", 128)
    batches = f"""SELECT id, batch, width,
      list_concat(input_ids, list_transform(range(width - len(input_ids)), lambda x: 0)) AS input_ids,
      list_concat(attention_mask, list_transform(range(width - len(attention_mask)), lambda x: 0)) AS attention_mask,
      list_concat(labels, list_transform(range(width - len(labels)), lambda x: -100)) AS labels
      FROM (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch) / 8.0) * 8 AS INT) AS width
        FROM (SELECT *, (position - 1) // 16 AS batch
          FROM ({_hash_rank(f"({padded}) WHERE trainable > 0", "id")})))"""
    fixed = f"""SELECT id, list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 0)) AS input_ids,
      list_concat(list_transform(ids, lambda x: 1), list_transform(range(128 - len(ids)), lambda x: 0)) AS attention_mask,
      list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 0)) AS labels
      FROM (SELECT id, ({_IDS.format(_WORDS.format("text"))})[1:128] AS ids FROM short_texts)"""
    layer_arrays = "SELECT layer, expert_id, m AS mean_weight FROM {0}"
    box = ", ".join(
        f"quantile_cont(m, {q}) AS {n}"
        for n, q in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))
    )
    means = "(SELECT expert_id, avg(m) AS m FROM soft_means GROUP BY expert_id)"
    heat = ", ".join(f"max(m) FILTER (WHERE expert_id = {e}) AS expert_{e}" for e in range(8))
    bins = """SELECT run, low, median, high, CAST(CASE WHEN high > low
      THEN least(floor((value - low) / (high - low) * 20), 19) ELSE 0 END AS INT) AS bin, count(*) AS points
      FROM step_points JOIN (SELECT run, min(value) AS low, quantile_cont(value, 0.5) AS median, max(value) AS high
        FROM step_points GROUP BY run) USING (run) GROUP BY ALL"""
    absent = "(output = '' AND (id // 1000000) % 2 = 0)"
    return {
        # sources and sinks
        "read_records": _with("SELECT instruction, input, output FROM instructions"),
        "read_records_csv": _with("SELECT instruction, input, output FROM instructions"),
        "read_split_files": _with(
            "SELECT split, count(*) AS rows, CAST(sum(n) AS BIGINT) AS chars FROM ("
            "SELECT CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', id)), CAST(id AS VARCHAR)) "
            "<= floor(count(*) OVER () * 0.1) THEN 'validation' ELSE 'train' END AS split, length(instruction) AS n "
            "FROM instructions) GROUP BY split"
        ),
        "concat_splits": "SELECT * FROM conversations WHERE conv_id % 10 <> 0 UNION ALL "
        "SELECT * FROM conversations WHERE conv_id % 10 = 0",
        "read_scalar_log": _with(
            "SELECT run, CASE tag WHEN 'train/loss' THEN 'train_loss' WHEN 'eval/loss' THEN 'eval_loss' "
            "WHEN 'train/routing/global_entropy' THEN 'routing_entropy' ELSE 'routing_cv' END AS key, "
            "step, value FROM scalar_log WHERE tag NOT LIKE 'train/step%'"
        ),
        "scalar_tags_by_prefix": _with(
            "SELECT * FROM scalar_log WHERE starts_with(tag, 'train/step_time_ms/rank')"
        ),
        "read_run_artifacts": _rounded("SELECT method AS run, * FROM report", *report_doubles),
        "explode_snapshot": _rounded(layer_arrays.format("soft_means"), "mean_weight"),
        "write_splits": _with(floor_split),
        "dataset_info": _with(
            "SELECT 'alpaca' AS format, count_if(split = 'train') AS num_train_samples, "
            "count_if(split = 'validation') AS num_val_samples, 'split=train' AS train_file, "
            f"'split=validation' AS validation_file FROM ({floor_split})"
        ),
        "write_summary": _run_summary(),
        # records, chats, prompts
        "validate_format": _with(
            f"SELECT count(*) AS num_samples, bool_and(NOT {bad}) AS is_valid, "
            f"count_if({bad}) AS num_errors FROM {nulled}"
        ),
        "validate_format_errors": _with(
            f"SELECT id, concat('Sample ', CAST(id AS VARCHAR), ': Missing required keys') AS error "
            f"FROM {nulled} WHERE {bad}"
        ),
        "validate_head": _with(f"SELECT id, NOT {bad} AS is_valid FROM {nulled} ORDER BY id LIMIT 5"),
        "flatten_first_turns": _with("SELECT * FROM flat"),
        "flatten_messages": _with("SELECT * FROM flat"),
        "filter_complete_pairs": _with(f"SELECT * FROM {complete}"),
        "group_chat": "SELECT conv_id, CAST(count(*) AS INT) AS turns, "
        "string_agg(concat(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, "
        "': ', text), chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY ALL",
        "render_prompt": _with("SELECT id, prompt FROM prompts"),
        "render_full_text": _with("SELECT id, concat(prompt, output, '</s>') AS full_text FROM prompts"),
        "render_short_text": _with("SELECT id, text FROM short_texts"),
        "select_eval_text": _with(
            "SELECT doc_id AS id, text AS eval_text FROM documents UNION ALL "
            "SELECT id, instruction FROM instructions"
        ),
        "clamp_lengths": _with(
            "SELECT id, prompt_len, least(greatest(16, least(512 - prompt_len, output_tokens)), "
            "512 - prompt_len) AS gen_len FROM (SELECT *, greatest(16, least(496, prompt_len_raw)) "
            "AS prompt_len FROM requests)"
        ),
        "exclude_labels_or_all": "WITH r AS (SELECT DISTINCT event_type AS run, "
        "NOT (lower(event_type) LIKE '%click%' OR lower(event_type) LIKE '%err%') AS keep FROM events) "
        "SELECT run FROM r WHERE keep OR NOT (SELECT bool_or(keep) FROM r)",
        "format_hook": "SELECT doc_id AS id, concat('Name the source of this ', lang, ' text.') AS instruction, "
        "text AS input, source AS output FROM documents",
        # sampling
        "sample_exact": f"SELECT doc_id, lang, n_chars FROM ({_hash_rank('documents', 'doc_id')}) "
        "WHERE position <= 100",
        "head_sample": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100",
        "seeded_shuffle": f"SELECT doc_id, lang, n_chars, position FROM ({_hash_rank('documents', 'doc_id')})",
        "split_exact_floor": "SELECT doc_id, lang, n_chars, split FROM ("
        + _split("documents", "doc_id", "floor(n * CAST(0.1 AS DOUBLE))")
        + ")",
        "split_library": _with(
            "SELECT conv_id, split FROM (" + _split("flat", "conv_id", "ceil(n * CAST(0.05 AS DOUBLE))") + ")"
        ),
        "expand_templates": _with(_template_sql()),
        # encoding
        "tokenize": f"SELECT doc_id, CAST(len(ids) AS INT) AS tokens, {_joined('ids')} AS input_ids FROM "
        f"(SELECT doc_id, {_IDS.format(_WORDS.format('text'))} AS ids FROM documents)",
        "tokenize_truncated": f"SELECT doc_id, CAST(len(ids) AS INT) AS tokens, {_joined('ids')} AS input_ids "
        f"FROM (SELECT doc_id, ({_IDS.format(_WORDS.format('text'))})[1:512] AS ids FROM documents)",
        "tokenizer_plugin": "SELECT doc_id, CAST(strlen(text) AS INT) AS tokens, array_to_string(list_transform("
        "regexp_extract_all(hex(text), '..'), lambda h: CAST('0x' || h AS INT)), ' ') AS input_ids FROM documents",
        "encode_masked": _example(_encoded("prompts", "prompt", "output", 512)),
        "filter_trainable": _example(
            f"SELECT * FROM ({_encoded('prompts', 'prompt', 'output', 48)}) WHERE trainable > 0"
        ),
        "encode_padded": _example(fixed),
        "pad_batches": _example(batches, "batch", "width"),
        "split_counts": _with(
            "SELECT split, count(*) AS num_examples, CAST(sum(len(input_ids)) AS BIGINT) AS num_tokens, "
            "CAST(sum(trainable) AS BIGINT) AS num_response_tokens FROM ("
            + _encoded(
                f"(SELECT *, {plain_prompt} AS prompt FROM ({flagship}) "
                "WHERE instruction <> '' AND response <> '')",
                "prompt", "response", 1024,
            )
            + ") WHERE trainable > 0 GROUP BY split"
        ),
        # latency
        "latency_percentiles": _rounded("SELECT * FROM percentiles", *report_doubles[:4]),
        "throughput": _rounded(
            "SELECT method, workload, throughput_tokens_per_sec FROM report", "throughput_tokens_per_sec"
        ),
        "tail_amplification": _rounded(
            "SELECT method, workload, tail_amplification FROM report", "tail_amplification"
        ),
        "stall_ratio": _rounded("SELECT method, workload, stall_ratio FROM report", "stall_ratio"),
        "benchmark_report": _rounded("SELECT * FROM report", *report_doubles),
        "compare_runs": _rounded(
            f"SELECT a.workload, {sides} FROM report a JOIN report b USING (workload) "
            "WHERE a.method = 'click' AND b.method = 'view'",
            *[f"{s}_{c}" for s in "ab" for c in report_doubles],
        ),
        "latency_cdf_points": _rounded(
            "SELECT method, workload, CASE i WHEN 0 THEN 0.0 WHEN 1 THEN latency_p50_ms "
            "WHEN 2 THEN latency_p95_ms WHEN 3 THEN latency_p99_ms ELSE latency_p99_ms * 1.1 END AS latency_ms, "
            "[0, 0.5, 0.95, 0.99, 0.999][i + 1] AS cdf FROM percentiles, range(5) t(i)",
            "latency_ms", "cdf",
        ),
        "arrival_offsets": _rounded(
            "SELECT event_id, user_id, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id "
            "ROWS UNBOUNDED PRECEDING) / 1e6 AS arrival_s FROM (SELECT *, coalesce(epoch_us(ts) - "
            "lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gap FROM events)",
            "arrival_s",
        ),
        # routing
        "to_token_rows": _rounded(
            f"SELECT {tokens}, CAST(count(*) AS INT) AS experts, min_by(logit, expert_id) AS first_logit "
            "FROM router_logits GROUP BY ALL",
            "first_logit",
        ),
        "router_softmax": _rounded(f"SELECT {tokens}, expert_id, weight FROM soft", "weight"),
        "router_sigmoid": _rounded(
            f"SELECT {tokens}, expert_id, 1/(1+exp(-logit)) AS weight FROM router_logits", "weight"
        ),
        "topk_route": _rounded(
            f"SELECT {tokens}, 8 AS num_experts, CAST(choice AS INT) AS choice, expert_id, logit, "
            f"exp(logit) / sum(exp(logit)) OVER (PARTITION BY {tokens}) AS weight FROM assigned",
            "logit", "weight",
        ),
        "topk_or_dense": _rounded(
            f"SELECT {tokens}, 8 AS num_experts, CAST(choice AS INT) AS choice, expert_id, logit, "
            f"exp(logit) / sum(exp(logit)) OVER (PARTITION BY {tokens}) AS weight FROM ranked",
            "logit", "weight",
        ),
        "capacity_enforce": _rounded(
            f"SELECT {tokens}, CAST(choice AS INT) AS choice, expert_id, logit, kept FROM kept", "logit"
        ),
        "renormalize_kept": _rounded(f"SELECT {tokens}, expert_id, kept, weight FROM renormed", "weight"),
        "overflow_fraction": _rounded(
            "SELECT * FROM overflow", "overflow_fraction", "dropped_share", places=9
        ),
        "expert_load_stats": _rounded(
            "SELECT * REPLACE (CAST(hot_expert_count AS BIGINT) AS hot_expert_count, "
            "CAST(raw_tokens AS BIGINT) AS raw_tokens, CAST(kept_tokens AS BIGINT) AS kept_tokens) FROM load",
            "max_over_mean_load", "load_variance",
        ),
        "mean_expert_weights": _rounded(layer_arrays.format("sparse_means"), "mean_weight"),
        "routing_stats": _rounded(_stats("soft_means", 0.01), "weight_entropy", "weight_cv"),
        "routing_stats_sigmoid": _rounded(_stats("sigmoid_means", 0.1), "weight_entropy", "weight_cv"),
        "collapse_stats": _rounded(
            "SELECT layer, max(m) AS max_weight, min(m) AS min_weight, stddev_samp(m) AS router_weight_std, "
            "1 - stddev_samp(m) / (avg(m) + 1e-8) AS collapse_score FROM sigmoid_means GROUP BY layer",
            "max_weight", "min_weight", "router_weight_std", "collapse_score",
        ),
        "balance_dense": _rounded(
            "SELECT layer, 8 * sum(m * m) AS balance_loss FROM soft_means GROUP BY layer", "balance_loss"
        ),
        "balance_sparse": _rounded("SELECT * FROM sparse_loss", "balance_loss"),
        "balance_variance": _rounded(
            "SELECT layer, var_samp(m) AS balance_loss FROM sigmoid_means GROUP BY layer", "balance_loss", places=12
        ),
        "balance_total": _rounded(
            "SELECT coalesce(0.01 * avg(nullif(l, 0)), 0) AS balance_loss FROM "
            "(SELECT layer, 8 * sum(m * m) AS l FROM soft_means GROUP BY layer)",
            "balance_loss", places=10,
        ),
        "layer_metric_log": _rounded(_layer_log(), "value", places=9),
        "global_expert_load": _rounded(
            "SELECT max(m) AS max_mean_expert_weight, avg(m) AS mean_expert_weight, "
            "max(m) / (avg(m) + 1e-8) AS max_mean_ratio, -sum(p * ln(p + 1e-9)) AS expert_weight_entropy "
            f"FROM (SELECT m, m / (sum(m) OVER () + 1e-8) AS p FROM {means})",
            "max_mean_expert_weight", "mean_expert_weight", "max_mean_ratio", "expert_weight_entropy",
        ),
        "token_counts_mean": _rounded(
            "SELECT expert_id, avg(tokens) AS mean_tokens FROM counts GROUP BY expert_id", "mean_tokens"
        ),
        "hot_expert_flags": _rounded(
            "SELECT *, tokens > 2 * group_mean AS is_hot FROM "
            "(SELECT *, avg(tokens) OVER (PARTITION BY layer) AS group_mean FROM counts)",
            "group_mean",
        ),
        "benchmark_report_experts": _rounded(
            "SELECT method, workload, num_requests, max(m) AS max_mean_expert_weight, avg(m) AS mean_expert_weight, "
            "max(m) / (avg(m) + 1e-8) AS max_mean_ratio, -sum(p * ln(p + 1e-9)) AS expert_weight_entropy, "
            "sum(tokens) AS tokens_per_layer FROM report LEFT JOIN (SELECT *, "
            "m / (sum(m) OVER (PARTITION BY method, workload) + 1e-8) AS p FROM served_experts) USING (method, workload) "
            "GROUP BY ALL",
            "max_mean_expert_weight", "mean_expert_weight", "max_mean_ratio", "expert_weight_entropy", "tokens_per_layer",
        ),
        "hot_expert_flags_by_run": _rounded(
            "SELECT *, tokens > 2 * group_mean AS is_hot FROM (SELECT method, workload, expert_id, tokens, "
            "avg(tokens) OVER (PARTITION BY method, workload) AS group_mean FROM served_experts)",
            "tokens", "group_mean",
        ),
        "expert_heatmap": _rounded(
            f"SELECT layer, {heat} FROM soft_means GROUP BY layer", *[f"expert_{e}" for e in range(8)]
        ),
        "contribution_box": _rounded(
            f"SELECT expert_id, {box}, (SELECT 1 - stddev_pop(m) / (avg(m) + 1e-8) FROM {means}) "
            "AS collapse_score FROM soft_means GROUP BY expert_id",
            "low", "q1", "median", "q3", "high", "collapse_score",
        ),
        # series
        "step_durations": _rounded(
            "SELECT event_id, event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER "
            "(PARTITION BY event_type ORDER BY ts, event_id)) / 1000.0 AS elapsed_ms FROM events",
            "elapsed_ms",
        ),
        "step_pairs": _rounded(
            "SELECT event_id, event_type, (ended - begun) / 1000.0 AS elapsed_ms FROM (SELECT *, epoch_us(ts) AS ended, "
            "lag(epoch_us(ts)) OVER w AS begun, lag(user_id % 2) OVER w AS kind_before FROM events "
            "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WHERE user_id % 2 = 1 AND kind_before = 0",
            "elapsed_ms",
        ),
        "rolling_percentiles": _rolling(),
        "smooth_centered": _rounded(_smooth(10, "10"), "value", "smoothed"),
        "smooth_centered_average": _rounded(_smooth(5, "count(value) {frame}"), "value", "smoothed"),
        "final_value": _rounded(
            "SELECT run, tag, round(max_by(value, step), 4) AS final_value FROM scalar_log GROUP BY run, tag",
            "final_value",
        ),
        "tail_mean": _rounded("SELECT * FROM tails", "tail_mean", places=4),
        "series_fallback": _rounded(
            "SELECT * FROM scalar_log WHERE tag = CASE WHEN length(run) % 2 = 0 "
            "THEN 'train/routing/global_cv' ELSE 'train/routing/global_entropy' END", "value"
        ),
        "timing_log": _rounded(_timing_log(), "value"),
        "step_time_distribution": _rounded(bins, "low", "median", "high"),
        "rank_step_skew": _rounded(
            "SELECT *, CASE WHEN count(*) OVER (PARTITION BY run) > 1 THEN max(median) OVER (PARTITION BY run) "
            "/ (min(median) OVER (PARTITION BY run) + 1e-8) END AS skew FROM (SELECT run, "
            "CAST(regexp_extract(tag, 'rank([0-9]+)', 1) AS INT) AS rank, quantile_cont(value, 0.5) AS median "
            "FROM step_log GROUP BY ALL)",
            "median", "skew",
        ),
        # summaries
        "perplexity": _rounded(
            "SELECT run, eval_loss, round(exp(eval_loss), 2) AS perplexity FROM eval_metrics",
            "eval_loss", "perplexity",
        ),
        "run_summary": _run_summary(),
        "run_summary_wide": _run_summary_wide(),
        # the same rows by other ways
        "read_records_array": _with("SELECT instruction, input, output FROM instructions"),
        "write_splits_counted": _with(
            "SELECT 'alpaca' AS format, count_if(split = 'train') AS num_train_samples, "
            "count_if(split = 'validation') AS num_val_samples, 'split=train' AS train_file, "
            f"'split=validation' AS validation_file FROM ({floor_split})"
        ),
        "validate_keys": _with(
            f"SELECT count(*) AS num_samples, coalesce(bool_and(NOT {absent}), true) AS is_valid, count_if({absent}) AS num_errors FROM instructions"
        ),
        "validate_keys_errors": _with(
            f"SELECT id, concat('Sample ', id, ': Missing required keys') AS error FROM instructions WHERE {absent}"
        ),
        "other_fields": _with("SELECT id, 'extra' AS field, id AS value FROM instructions"),
        "snapshot_leaves": _with("""SELECT concat('layers/layer', layer, '/mean/', expert_id) AS path, round(m, 6) + 0.0 AS number, NULL AS text
            FROM soft_means
          UNION ALL SELECT DISTINCT concat('layers/layer', layer, '/kind'), NULL, 'soft' FROM soft_means
          UNION ALL SELECT 'note', NULL, NULL"""),
        "tokenize_vocabulary": rf"""WITH found AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
          known AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS id
            FROM (SELECT unnest(ws) AS w FROM found) GROUP BY w HAVING count(*) >= 2),
          placed AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM found),
          ids AS (SELECT doc_id, string_agg(coalesce(id, 0), ' ' ORDER BY p) AS ids FROM placed LEFT JOIN known USING (w) GROUP BY doc_id)
          SELECT doc_id, CAST(len(ws) AS INTEGER) AS tokens, coalesce(ids, '') AS input_ids FROM found LEFT JOIN ids USING (doc_id)""",
        "build_vocabulary": rf"""SELECT w AS word, n AS count, CAST(id AS INTEGER) AS id FROM (
          SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS id FROM (
            SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS.format("text")}) AS w FROM documents) GROUP BY w)) WHERE id <= 2000""",
        "latency_sketches": _with("""SELECT method, workload, count(*) AS num_requests, true AS latency_p50_within,
          true AS latency_p95_within, true AS latency_p99_within, true AS latency_p999_within FROM requests GROUP BY ALL"""),
        # streaming: the same result as the batch form
        "stream_rolling_percentiles": _rolling(),
        "stream_run_summary_wide": _run_summary_wide(),
        "stream_step_pairs": _rounded(f"SELECT event_id, event_type, elapsed_ms FROM ({_PAIRS})", "elapsed_ms"),
        "stream_timing_log": _rounded(
            f"SELECT event_type, event_id, elapsed_ms, quantile_cont(elapsed_ms, 0.5) OVER w AS p50, "
            f"quantile_cont(elapsed_ms, 0.95) OVER w AS p95, quantile_cont(elapsed_ms, 0.99) OVER w AS p99 FROM ({_PAIRS}) "
            "WINDOW w AS (PARTITION BY event_type ORDER BY ended, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)",
            "elapsed_ms", "p50", "p95", "p99",
        ),
    }
