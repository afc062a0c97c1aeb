"""JSON arrays read in ranges of bytes."""

import json
import random

import pytest
from runloom.sources.json_arrays import read_json_arrays
from runloom.sources.records import CORRUPT, read_records

FIELDS = "id BIGINT, text STRING, inner STRUCT<odd: STRING, list: ARRAY<BIGINT>>"
ODD = ['{', '}', '"', '\\', '\\"', '"}', '[{', ']', '\n', '}\n{', 'é', '\\\\', ',"id": 3}', ' ']


def made(n, seed=0):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices([*ODD, "word ", "more "], k=rng.randrange(12)))
    return [{"id": i, "text": rng.choice([None, text()]), "inner": {"odd": text(), "list": [1, i]}, "other": {"x": {"y": "}"}}} for i in range(n)]


def expected(rows):
    return sorted((r["id"], r["text"], r["inner"]["odd"], r["inner"]["list"]) for r in rows) if all(r["text"] is not None for r in rows) else sorted(
        ((r["id"], r["text"], r["inner"]["odd"], r["inner"]["list"]) for r in rows), key=repr
    )


def got(df, rows):
    found = [(r.id, r.text, r.inner.odd, r.inner.list) for r in df.collect()]
    return sorted(found) if all(r["text"] is not None for r in rows) else sorted(found, key=repr)


@pytest.fixture(params=[40, 700, 1 << 27])
def split_bytes(request, spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_any_split_gives_all_records(spark, tmp_path, split_bytes, indent, ascii_only):
    rows = made(12 if split_bytes == 40 else 300)
    half = len(rows) // 2
    for name, part in (("a.json", rows[:half]), ("b.json", rows[half:])):
        (tmp_path / name).write_text(json.dumps(part, indent=indent, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    assert got(read_json_arrays(spark, str(tmp_path), FIELDS), rows) == expected(rows)


def test_single_objects_empty_arrays_and_blanks(spark, tmp_path, split_bytes):
    rows = made(4, seed=5)
    for i, text in enumerate([json.dumps(rows[0]), "  \n" + json.dumps(rows[1], indent=3), json.dumps(rows[2]) + "\n" + json.dumps(rows[3]), "[]", " [ \n ] "]):
        (tmp_path / f"{i}.json").write_text(text)
    assert got(read_json_arrays(spark, str(tmp_path), FIELDS), rows) == expected(rows)


def test_records_equal_the_line_form(spark, tmp_path, split_bytes):
    rows = [{"instruction": f"do {i} }}", "input": '{"', "output": "\\", "extra": [{"a": 1}]} for i in range(20)]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, rows)))
    array, lines = (read_records(spark, str(tmp_path / n)) for n in ("array.json", "lines.jsonl"))
    assert array.schema == lines.schema and sorted(array.collect()) == sorted(lines.collect())
    ordered = read_records(spark, str(tmp_path / "array.json"), spread=False)
    assert sorted(ordered.collect()) == sorted(lines.collect())


def test_a_faulty_record_keeps_its_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"instruction": "a", "input": "", "output": "b"}, {"instruction": oops}]')
    found = read_records(spark, str(tmp_path / "a.json"), keep_corrupt=True).collect()
    assert sorted((r.instruction, r[CORRUPT]) for r in found if r.instruction) == [("a", None)]
    assert [r[CORRUPT] for r in found if not r.instruction] == ['{"instruction": oops}']


def test_one_array_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(made(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        assert read_json_arrays(spark, str(tmp_path), FIELDS).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
