"""Record checks, prompt rendering and small row-wise rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.columns import clamp, has_text

#: Required columns and error text of each record format.
REQUIRED = {
    "alpaca": (["instruction", "output"], "Missing required keys"),
    "sharegpt": (["conversations"], "Missing 'conversations' key"),
}

#: Prompt texts.
PROMPT_PLAIN = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response:\n"
)
PROMPT_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input "
    "that provides further context. Write a response that appropriately "
    "completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
)
SHORT_PLAIN = "### Instruction:\n{instruction}\n\n### Response:\n{output}"
SHORT_WITH_INPUT = (
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}"
)


def fill(template: str, **values: Column) -> Column:
    """Concatenate the fixed pieces of a template and the given columns.

    Braces inside the values are never read as placeholders.
    """
    pieces, rest = [], template
    while rest:
        text, opened, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if text:
            pieces.append(F.lit(text))
        if opened:
            pieces.append(values[name])
    return F.concat(*pieces)


def _missing(df: DataFrame, data_format: str) -> Column:
    required, _ = REQUIRED.get(data_format, ([], ""))
    missing = F.lit(False)
    for name in required:
        missing = missing | (F.col(name).isNull() if name in df.columns else F.lit(True))
    return missing


def validate_format(df: DataFrame, data_format: str) -> DataFrame:
    """One row: ``num_samples``, ``is_valid``, ``num_errors``. A null counts as missing."""
    bad = _missing(df, data_format)
    return df.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.bool_and(~bad), F.lit(True)).alias("is_valid"),
        F.count_if(bad).alias("num_errors"),
    )


def format_errors(df: DataFrame, data_format: str, index: str = "id") -> DataFrame:
    """One row per faulty sample, numbered by ``index``; the rows stay distributed."""
    _, text = REQUIRED.get(data_format, ([], ""))
    message = F.concat(F.lit("Sample "), F.col(index).cast("string"), F.lit(f": {text}"))
    return df.filter(_missing(df, data_format)).select(index, message.alias("error"))


def validate_head(df: DataFrame, data_format: str, index: str = "id", rows: int = 5) -> DataFrame:
    """The check on the first few rows only, one flag per row."""
    head = df.orderBy(index).limit(rows)
    return head.select(index, (~_missing(df, data_format)).alias("is_valid"))


def render_prompt(
    df: DataFrame, instruction: str = "instruction", extra: str | None = "input", name: str = "prompt"
) -> DataFrame:
    """The long prompt; its input block appears only if the input is not blank."""
    plain = fill(PROMPT_PLAIN, instruction=F.col(instruction))
    if extra is None:
        return df.withColumn(name, plain)
    context = F.coalesce(F.col(extra), F.lit(""))
    full = fill(PROMPT_WITH_INPUT, instruction=F.col(instruction), input=context)
    return df.withColumn(name, F.when(has_text(context), full).otherwise(plain))


def render_full_text(
    df: DataFrame, eos: str, prompt: str = "prompt", response: str = "output", name: str = "full_text"
) -> DataFrame:
    """Prompt, response and end-of-sequence marker."""
    return df.withColumn(name, F.concat(prompt, response, F.lit(eos)))


def render_short_text(df: DataFrame, name: str = "text") -> DataFrame:
    """The short form without preamble; the input block appears if the input is not empty."""
    context = F.coalesce(F.col("input"), F.lit(""))
    fields = {"instruction": F.col("instruction"), "output": F.col("output")}
    plain = fill(SHORT_PLAIN, **fields)
    full = fill(SHORT_WITH_INPUT, input=context, **fields)
    return df.withColumn(name, F.when(F.length(context) > 0, full).otherwise(plain))


def select_eval_text(df: DataFrame, name: str = "eval_text") -> DataFrame:
    """``text`` if present, else ``instruction``."""
    known = [F.col(c) for c in ("text", "instruction") if c in df.columns]
    return df.withColumn(name, F.coalesce(*known))


def clamp_lengths(
    df: DataFrame, prompt: str, generated: str, max_length: int = 512, low: int = 16
) -> DataFrame:
    """Hold prompt and generation lengths within limits and within ``max_length`` together."""
    limit = F.lit(max_length)
    held = df.withColumn("prompt_len", clamp(F.col(prompt), F.lit(low), limit - low))
    room = limit - F.col("prompt_len")
    return held.withColumn("gen_len", F.least(clamp(F.col(generated), F.lit(low), room), room))


def exclude_labels_or_all(df: DataFrame, label: str, words: Sequence[str]) -> DataFrame:
    """Drop rows whose label contains one of ``words``; keep all rows if none would remain."""
    lowered = F.lower(F.col(label))
    named = F.lit(False)
    for word in words:
        named = named | lowered.contains(word)
    keep = F.coalesce(~named, F.lit(True))
    any_left = df.select(F.bool_or(keep).alias("left")).scalar()
    return df.filter(keep | ~any_left)


Conversion = Callable[[DataFrame], DataFrame]
_CONVERSIONS: dict[str, Conversion] = {}


def register_format(name: str, conversion: Conversion) -> None:
    """Add a user-supplied conversion from raw rows to records."""
    _CONVERSIONS[name] = conversion


def format_hook(df: DataFrame, name: str) -> DataFrame:
    """Apply the conversion registered for a format; unknown formats pass through."""
    return df.transform(_CONVERSIONS.get(name, lambda rows: rows))
