"""Hand-made edge cases of chats, records, prompts and templates."""

import pytest

from runloom.operators import chats, records, sampling, templates


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id INT, turn BIGINT, role STRING, text STRING")


def test_first_turns(spark):
    df = turns(spark, [
        (1, 0, "user", "hello"),                                                  # no assistant
        (2, 0, "assistant", "first"), (2, 1, "user", "second"),                   # assistant before user
        (3, 0, "user", ""), (3, 1, "user", "later"), (3, 2, "assistant", "yes"),  # empty turn skipped
        (4, 1, "user", "b"), (4, 0, "user", "a"), (4, 2, "assistant", "c"),       # out of order
    ])
    got = {r.conv_id: (r.instruction, r.response) for r in chats.flatten_first_turns(df).collect()}
    assert got == {1: ("hello", ""), 2: ("second", "first"), 3: ("later", "yes"), 4: ("a", "c")}
    kept = chats.filter_complete_pairs(chats.flatten_first_turns(df)).collect()
    assert sorted(r.conv_id for r in kept) == [2, 3, 4]


def test_first_turns_of_nested_messages(spark):
    rows = [(1, [("user", ""), ("assistant", "x"), ("user", "q"), ("user", "r")]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id INT, messages ARRAY<STRUCT<role: STRING, content: STRING>>")
    got = chats.flatten_messages(df).collect()
    assert [tuple(r) for r in got] == [(1, "q", "x"), (2, "", ""), (3, "", "")]


@pytest.mark.parametrize("step", [1, 1_700_000_000_000])
def test_one_chat_is_one_row(spark, step):
    df = turns(spark, [(1, i * step, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in (4, 0, 3, 1, 2)])
    (row,) = chats.group_chat(df).collect()
    names = ["human", "gpt"] * 3
    assert [(t["from"], t["value"]) for t in row.conversations] == [(names[i], f"t{i}") for i in range(5)]


def test_prompt_input_block(spark):
    rows = [(1, "do", "with {braces}"), (2, "do {input}", " \t\n"), (3, "do", ""), (4, "do", None), (5, "do", " \x1c")]
    df = spark.createDataFrame(rows, "id INT, instruction STRING, input STRING")
    got = {r.id: r.prompt for r in records.render_prompt(df).collect()}
    for number, instruction, extra in rows:
        if extra and extra.strip():
            expected = records.PROMPT_WITH_INPUT.format(instruction=instruction, input=extra)
        else:
            expected = records.PROMPT_PLAIN.format(instruction=instruction)
        assert got[number] == expected


def test_short_text_keeps_blank_input(spark):
    df = spark.createDataFrame([("a", " ", "o"), ("a", "", "o")], "instruction STRING, input STRING, output STRING")
    texts = [r.text for r in records.render_short_text(df).collect()]
    assert texts == ["### Instruction:\na\n\n### Input:\n \n\n### Response:\no", "### Instruction:\na\n\n### Response:\no"]


def test_validation(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, None, "b"), (2, "a", None)], "id INT, instruction STRING, output STRING")
    assert records.validate_format(df, "alpaca").first().asDict() == {"num_samples": 3, "is_valid": False, "num_errors": 2}
    errors = sorted(r.error for r in records.format_errors(df, "alpaca").collect())
    assert errors == ["Sample 1: Missing required keys", "Sample 2: Missing required keys"]
    assert records.validate_format(df, "sharegpt").first()["num_errors"] == 3
    assert records.validate_format(df, "custom").first()["is_valid"]
    assert records.validate_format(df.limit(0), "alpaca").first()["is_valid"]
    assert [r.is_valid for r in records.validate_head(df, "alpaca", rows=2).orderBy("id").collect()] == [True, False]


def test_exclusion_falls_back_to_all(spark):
    df = spark.createDataFrame([("QLoRA r16",), ("Sparse",)], "label STRING")
    assert [r.label for r in records.exclude_labels_or_all(df, "label", ["qlora"]).collect()] == ["Sparse"]
    assert records.exclude_labels_or_all(df, "label", ["qlora", "sparse"]).count() == 2


def test_clamped_lengths(spark):
    df = spark.createDataFrame([(1, 5), (100, 900), (9000, 9000)], "p INT, g INT")
    got = [(r.prompt_len, r.gen_len) for r in records.clamp_lengths(df, "p", "g", 512).collect()]
    assert got == [(16, 16), (100, 412), (496, 16)]


def test_format_hook(spark):
    df = spark.createDataFrame([("x",)], "raw STRING")
    records.register_format("mine", lambda rows: rows.withColumnRenamed("raw", "text"))
    assert records.format_hook(df, "mine").columns == ["text"]
    assert records.format_hook(df, "unknown").columns == ["raw"]


def expected_prompts(texts, fills, number):
    for i in range(number):
        template, filling = texts[i % len(texts)], fills[i % len(fills)]
        try:
            yield template.format(**filling)
        except KeyError:
            yield template


def test_templates(spark):
    requests = spark.range(400)
    got = {r.id: r for r in templates.expand_templates(requests, "id").collect()}
    order = [r.id for r in sampling.seeded_shuffle(requests, "id").collect()]
    by_category = {}
    for number in order:
        by_category.setdefault(got[number].category, []).append(got[number].prompt_text)
    assert len(got) == 400 and set(by_category) == set(templates.TEMPLATES)
    for category, texts in by_category.items():
        assert texts == list(expected_prompts(templates.TEMPLATES[category], templates.FILLS[category], 100))


def test_template_with_missing_key_and_braces(spark):
    lists = {"x": ["{a} and {b}", "only {a}", "plain"]}
    fills = {"x": [{"a": "{b}"}, {"a": "1", "b": "2"}]}
    got = {r.slot: r.prompt_text for r in templates.rendered_slots(spark, lists, fills).collect()}
    assert got == dict(enumerate(expected_prompts(lists["x"], fills["x"], 6)))
    assert got[0] == "{a} and {b}"
