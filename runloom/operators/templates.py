"""Prompt texts made from templates and fillings."""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.sampling import SEED, shuffle_positions

#: Templates per category.
TEMPLATES = {
    "math": [
        "A farmer has {a} apples and gives away {b}. How many remain?",
        "If a train travels {a} km in {b} hours, what is its speed?",
        "What is the area of a rectangle with width {a} and height {b}?",
        "Solve: {a}x + {b} = {c}. What is x?",
        "A store sells items for ${a}. After a {b}% discount, what is the price?",
    ],
    "code": [
        "Write a Python function that returns the {a}th Fibonacci number.",
        "Implement a binary search algorithm in Python for a list of {a} elements.",
        "Write a Python class for a stack with push, pop, and peek methods.",
        "Create a Python decorator that retries a function up to {a} times.",
        "Write a Python generator that yields prime numbers up to {a}.",
    ],
    "qa": [
        "What is the capital of {country}?",
        "Who invented {invention}?",
        "When did {event} occur?",
        "What is the chemical formula for {substance}?",
        "Explain the concept of {concept} in simple terms.",
    ],
    "chat": [
        "I'm feeling {emotion} today. Can you help me feel better?",
        "Can you recommend a {genre} book for someone who enjoys {topic}?",
        "What are the pros and cons of {option_a} vs {option_b}?",
        "Help me write a short {format} about {subject}.",
        "What advice would you give someone starting to learn {skill}?",
    ],
}
#: Fillings per category.
FILLS = {
    "math": [
        {"a": 10, "b": 3}, {"a": 150, "b": 2}, {"a": 7, "b": 5},
        {"a": 100, "b": 25}, {"a": 3, "b": 4, "c": 19},
        {"a": 12, "b": 6}, {"a": 200, "b": 3}, {"a": 9, "b": 7},
        {"a": 50, "b": 10}, {"a": 8, "b": 3, "c": 29},
    ],
    "code": [{"a": n} for n in (10, 100, 50, 3, 1000, 15, 200, 5, 7, 500)],
    "qa": [
        {"country": "France"}, {"invention": "the telephone"},
        {"event": "World War II"}, {"substance": "water"},
        {"concept": "entropy"}, {"country": "Japan"},
        {"invention": "the printing press"}, {"event": "the French Revolution"},
        {"substance": "carbon dioxide"}, {"concept": "quantum entanglement"},
    ],
    "chat": [
        {"emotion": "anxious", "genre": "mystery", "topic": "travel",
         "option_a": "Python", "option_b": "JavaScript",
         "format": "poem", "subject": "autumn", "skill": "guitar"},
        {"emotion": "excited", "genre": "sci-fi", "topic": "science",
         "option_a": "macOS", "option_b": "Linux",
         "format": "essay", "subject": "innovation", "skill": "cooking"},
        {"emotion": "tired", "genre": "self-help", "topic": "productivity",
         "option_a": "remote work", "option_b": "office work",
         "format": "story", "subject": "friendship", "skill": "painting"},
        {"emotion": "curious", "genre": "history", "topic": "culture",
         "option_a": "cats", "option_b": "dogs",
         "format": "letter", "subject": "gratitude", "skill": "photography"},
        {"emotion": "happy", "genre": "thriller", "topic": "adventure",
         "option_a": "tea", "option_b": "coffee",
         "format": "blog post", "subject": "sustainability", "skill": "chess"},
    ],
}


def rendered_slots(spark, templates=TEMPLATES, fills=FILLS) -> DataFrame:
    """The distinct prompts: ``category_no, category, slot, prompt_text``.

    Templates and fillings are taken in turn, so category texts repeat after the
    least common multiple of their numbers. If a filling lacks a key of its
    template, the raw template stands.
    """
    rows = []
    for number, category in enumerate(templates):
        texts, values = templates[category], fills[category]
        period = lcm(len(texts), len(values))
        for slot in range(period):
            filling = {k: str(v) for k, v in values[slot % len(values)].items()}
            rows.append((number, category, slot, texts[slot % len(texts)], filling))
    raw = spark.createDataFrame(
        rows,
        "category_no INT, category STRING, slot INT, template STRING, fill MAP<STRING, STRING>",
    )
    wanted = F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1))
    complete = F.size(F.array_except(wanted, F.map_keys("fill"))) == 0
    # Split at the placeholders, so that braces inside a value are never replaced.
    pieces = F.split("template", r"\{\w+\}")
    text = F.array_join(
        F.zip_with(
            pieces, wanted, lambda piece, name: F.concat(piece, F.coalesce(F.try_element_at("fill", name), F.lit("")))
        ),
        "",
    )
    return raw.select(
        "category_no", "category", "slot",
        F.when(complete, text).otherwise(F.col("template")).alias("prompt_text"),
    )


def expand_templates(
    requests: DataFrame, id_col: str, templates=TEMPLATES, fills=FILLS, seed: int = SEED
) -> DataFrame:
    """Give each request a prompt.

    Requests in seeded random order go round the categories, and the n-th request of
    a category gets its n-th text: every category serves equally many, shuffled. The
    joined side has at most a few dozen rows, fixed by the lists.
    """
    slots = rendered_slots(requests.sparkSession, templates, fills)
    periods = F.array(*[F.lit(lcm(len(templates[c]), len(fills[c]))) for c in templates])
    kinds = len(templates)
    number = F.col("_position") - 1
    placed = shuffle_positions(requests, id_col, seed, "_position").withColumn(
        "category_no", F.pmod(number, F.lit(kinds)).cast("int")
    )
    slot = F.pmod(F.floor(number / kinds), periods[F.col("category_no")]).cast("int")
    return (
        placed.withColumn("slot", slot)
        .join(F.broadcast(slots), ["category_no", "slot"])
        .drop("category_no", "slot", "_position")
    )
