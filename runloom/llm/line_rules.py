"""Quality rules on documents, with lines that a host repeats taken out of account.

Built-in functions only. Lines are normalised and hashed; a line is common in its host when more distinct
documents of it than a limit hold it, however large the host is. Common lines are taken out; a document is kept if it passes the base
rules and enough of it is left. Exact copies of a text are one document here, so copies of a clean text do not
make its own lines common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm import common

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Words of a window that may repeat inside a text.
WINDOW = 8


def normalised(line: Column) -> Column:
    """Letters and digits in lower case, digits alike, anything else one blank."""
    return F.translate(F.trim(F.regexp_replace(F.lower(line), "[^\\p{L}\\p{N}]+", " ")), "123456789", "000000000")


def _repeated_words(windows: Column) -> Column:
    """Words covered by the windows (as hashes, by place) that occur twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

    def places(s: Column) -> Column:
        twice = F.transform(
            s, lambda x, i: F.when(same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)), x["i"])
        )
        return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    once = F.transform(F.array(placed), places)
    return F.transform(once, covered)[0]


def base_figures(docs: DataFrame, text_col: str, **kept: Column) -> DataFrame:
    """The columns in ``kept`` and the base figures of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[c.alias(n) for n, c in kept.items()], text.alias("text_"))
    rows = rows.withColumn("words_", common.words_of(F.col("text_")))
    rows = rows.withColumn("hashes_", F.transform("words_", lambda w: F.xxhash64(w)))
    # Hashes of 2, 4, then 8 words, each from two of the one before; what runs over the end is cut off.
    for name, source, step in (("twos_", "hashes_", 1), ("fours_", "twos_", 2), ("eights_", "fours_", 4)):
        rows = rows.withColumn(name, F.transform(source, lambda h, i: F.xxhash64(h, F.get(F.col(source), i + step))))
    none = F.array().cast("array<bigint>")
    whole = F.slice("eights_", 1, F.size("hashes_") - (WINDOW - 1))
    rows = rows.withColumn("windows_", F.when(F.size("hashes_") >= WINDOW, whole).otherwise(none))
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    rows = rows.withColumn("lines_", lines)
    repeats = F.size(F.array_distinct("windows_")) < F.size("windows_")
    figures = {
        "n_words": F.size("words_").cast("long"),
        "word_chars": F.length(F.translate("text_", common.SPACES, "")).cast("long"),
        "n_symbols": (F.length("text_") - F.length(F.translate("text_", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        "n_repeat_words": F.when(repeats, _repeated_words(F.col("windows_"))).otherwise(0).cast("long"),
    }
    rows = rows.select(*kept, *[c.alias(n) for n, c in figures.items()])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    max_documents: int = 20,
    max_removed: float = 0.5,
    clean_col: str | None = None,
) -> DataFrame:
    """The base figures of every document, what common lines take of it, and whether it is kept.

    A line is common if more than ``max_documents`` documents of its host hold it, documents of equal text counted once. A document
    that loses more than ``max_removed`` of its characters with its common lines is depleted. ``kept`` is false if the base rules fail or
    the document is depleted. ``common_share`` is what removal takes of the normalised characters.

    With ``clean_col``, that column has the text without its common lines; what is taken out of it is what the
    depletion is judged by. Other lines stay as they are, blank ones included.

    A null text is empty and fails the base rules. A null host counts as the host with the empty name.
    Repeated rows get the same verdict, one row each. An empty table gives an empty one.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = {"host": host, "d1": F.xxhash64(text), "d2": F.xxhash64(F.lit("second"), text)}
    rows = docs.select(*[c.alias(n) for n, c in name.items()], F.explode(F.split(text, "\n")).alias("line"))
    rows = rows.select("host", "d1", "d2", normalised(F.col("line")).alias("line")).where("line <> ''")
    rows = rows.select("host", "d1", "d2", F.xxhash64("line").alias("h"), F.length("line").alias("size"))
    # Copies of a text are one row per line from here on; they scale all its lines alike.
    lines = rows.groupBy("host", "d1", "d2", "h").agg(F.sum("size").alias("size"))
    lines = common.written(lines, "lines")
    often = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_documents)
    often = often.select("host", "h", F.lit(True).alias("common"))
    gone = [F.collect_set(F.when(F.col("common"), F.col("h"))).alias("gone")] if clean_col else []
    sums = (
        lines.join(often, ["host", "h"], "left")
        .groupBy("host", "d1", "d2")
        .agg(F.sum("size").alias("all_chars"), F.sum(F.when(F.col("common"), F.col("size")).otherwise(0)).alias("common_chars"), *gone)
        .where("common_chars > 0")
    )
    figures = base_figures(docs, text_col, **{"id_": F.col(id_col)}, **name, **({"whole": text} if clean_col else {}))
    share = F.coalesce(F.col("common_chars") / F.col("all_chars"), F.lit(0.0))
    judged = figures.join(sums, ["host", "d1", "d2"], "left").withColumn("common_share", share)
    stays = lambda x: (normalised(x) == "") | ~F.array_contains("gone", F.xxhash64(normalised(x)))
    left = F.array_join(F.filter(F.split("whole", "\n"), stays), "\n")
    clean = [F.when(F.col("gone").isNull(), F.col("whole")).otherwise(left).alias(clean_col)] if clean_col else []
    return judged.select(
        F.col("id_").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("common_share") <= max_removed)).alias("kept"),
        "common_share",
        *clean,
    )
