"""Files of records and runs."""

import json

import pytest
from pyspark.sql import functions as F

from runloom.operators import records as formats
from runloom.operators import summary
from runloom.operators.chats import flatten_first_turns
from runloom.plans.prepare import encode_instructions, encode_pairs, prepare_training_data, validate_data_format
from runloom.sources import records, run_logs

ROWS = [
    {"instruction": "Say \"é\"\nplease", "input": "", "output": "a,b"},
    {"instruction": "Add", "input": "1", "output": "2"},
    {"instruction": "No output"},
]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in ROWS) + "\n", encoding="utf-8")
    (tmp_path / "r.json").write_text(json.dumps(ROWS, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "r.csv").write_text(
        'instruction,input,output\n"Say ""é""\nplease",,"a,b"\nAdd,1,2\nNo output,,\n', encoding="utf-8"
    )
    return tmp_path


@pytest.mark.parametrize("name", ["r.jsonl", "r.json", "r.csv"])
def test_read(spark, files, name):
    rows = records.read_records(spark, str(files / name)).na.fill("").collect()
    assert sorted(map(tuple, rows)) == sorted((r["instruction"], r.get("input", ""), r.get("output", "")) for r in ROWS)


def test_broken_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"instruction": "a", "output": "b"}\n{"instruction": \n')
    rows = records.read_records(spark, str(tmp_path / "b.jsonl"), keep_corrupt=True).cache()
    assert rows.filter(F.col(records.CORRUPT).isNotNull()).count() == 1
    assert rows.filter("instruction = 'a'").count() == 1


def test_chats_and_split_files(spark, tmp_path):
    chat = {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]}
    for split in ("train", "validation"):
        (tmp_path / f"{split}.jsonl").write_text(json.dumps(chat) + "\n")
    paths = {s: str(tmp_path / f"{s}.jsonl") for s in ("train", "validation")}
    rows = records.read_split_files(spark, paths, "sharegpt").collect()
    assert sorted(r.split for r in rows) == ["train", "validation"]
    assert all([t.value for t in r.conversations] == ["hi", "ho"] for r in rows)


@pytest.mark.parametrize("name", ["r.jsonl", "r.json"])
def test_preparation(spark, tmp_path, name):
    many = [{"instruction": f"i{n}", "input": "", "output": f"o{n}"} for n in range(40)]
    text = json.dumps(many) if name == "r.json" else "\n".join(map(json.dumps, many))
    (tmp_path / name).write_text(text)
    info = prepare_training_data(spark, str(tmp_path / name), str(tmp_path / "out"), max_samples=30)
    assert (info["num_train_samples"], info["num_val_samples"], info["format"]) == (27, 3, "alpaca")
    train = spark.read.json(info["train_file"]).collect()
    held_out = spark.read.json(info["validation_file"]).collect()
    assert (len(train), len(held_out)) == (27, 3)
    assert len({r.instruction for r in train + held_out}) == 30
    again = prepare_training_data(spark, str(tmp_path / name), str(tmp_path / "again"), max_samples=30)
    assert sorted(spark.read.json(again["validation_file"]).collect()) == sorted(held_out)


def test_validation_numbers_rows_as_in_the_file(spark, files):
    report, errors = validate_data_format(spark, str(files / "r.json"))
    assert report.first().asDict() == {"num_samples": 3, "is_valid": False, "num_errors": 1}
    assert [r.error for r in errors.collect()] == ["Sample 2: Missing required keys"]


def test_instruction_job(spark):
    df = spark.range(100).select(
        "id", F.lit("Add").alias("instruction"), F.col("id").cast("string").alias("input"), F.lit("x y").alias("output")
    )
    rows = encode_instructions(df, max_samples=60, fraction=0.05).collect()
    assert len(rows) == 60 and sum(r.split == "validation" for r in rows) == 3
    assert all(r.num_response_tokens == 3 for r in rows)


def test_chat_job(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = flatten_first_turns(turns)
    rows = encode_pairs(pairs, "conv_id", max_samples=10, fraction=0.25).collect()
    assert 0 < len(rows) <= 10 and {r.split for r in rows} <= {"train", "validation"}


@pytest.fixture
def run_folder(tmp_path):
    for run in ("one", "two"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "routing_snapshot.json").write_text(json.dumps({"layer.0": [0.25, 0.75], "layer.1": [0.5, 0.5]}, indent=2))
    (tmp_path / "one" / "eval_results.json").write_text(json.dumps({"eval_loss": 1.5, "epoch": 3.0}, indent=2))
    (tmp_path / "one" / "benchmark_bursty.json").write_text(
        json.dumps({"method": "m", "workload": "bursty", "latency_p50_ms": 2.0, "per_expert_token_counts": [1.0, 2.0]}, indent=2)
    )
    return str(tmp_path)


def test_run_artifacts(spark, run_folder):
    evals = run_logs.read_run_artifacts(spark, run_folder, "eval").collect()
    assert [(r.run, r.eval_loss) for r in evals] == [("one", 1.5)]
    reports = run_logs.read_run_artifacts(spark, run_folder, "benchmark").collect()
    assert [(r.run, r.workload, r.latency_p50_ms, r.latency_p99_ms, r.per_expert_token_counts) for r in reports] == [
        ("one", "bursty", 2.0, None, [1.0, 2.0])
    ]
    cells = run_logs.explode_snapshot(run_logs.read_run_artifacts(spark, run_folder, "snapshot")).collect()
    assert len(cells) == 8
    assert {(r.layer, r.expert_id): r.mean_weight for r in cells if r.run == "two"} == {
        ("layer.0", 0): 0.25, ("layer.0", 1): 0.75, ("layer.1", 0): 0.5, ("layer.1", 1): 0.5
    }


def test_missing_artifacts_are_no_error(spark, tmp_path):
    (tmp_path / "run").mkdir()
    for kind in run_logs.ARTIFACTS:
        assert run_logs.read_run_artifacts(spark, str(tmp_path), kind).count() == 0


def test_scalar_tags(spark, tmp_path):
    rows = [("r", "train/loss", 1, 2.0), ("r", "train/other", 1, 3.0)]
    spark.createDataFrame(rows, "run STRING, tag STRING, step BIGINT, value DOUBLE").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    got = run_logs.read_scalar_log(log)
    assert [(r.key, r.value) for r in got.collect()] == [("train_loss", 2.0)]
    assert "PushedFilters: [In(tag" in got._jdf.queryExecution().executedPlan().toString()
    prefixed = run_logs.scalar_tags_by_prefix(log, "train/o")
    assert "StringStartsWith(tag,train/o)" in prefixed._jdf.queryExecution().executedPlan().toString()
    assert prefixed.count() == 1


def test_summary_file(spark, tmp_path):
    row = {c: "r" if c == "run" else 1.5 for c in summary.HEADERS}
    schema = ", ".join(f"{c} {'STRING' if c == 'run' else 'DOUBLE'}" for c in summary.HEADERS)
    table = spark.createDataFrame([tuple(row.values())], schema)
    run_logs.write_summary(table, str(tmp_path / "s"), summary.HEADERS)
    back = spark.read.csv(str(tmp_path / "s"), header=True)
    assert back.columns == list(summary.HEADERS.values()) and back.count() == 1


@pytest.mark.parametrize("ending", ["", ".gz"])
def test_line_json_is_read_whole_whatever_its_name(spark, tmp_path, ending):
    import gzip

    text = "\n".join(json.dumps({"instruction": f"i{n}", "output": "o", "extra": n}) for n in range(40)) + "\n"
    path = tmp_path / f"rows{ending}"
    path.write_bytes(gzip.compress(text.encode()) if ending else text.encode())
    schema = records.SCHEMAS["alpaca"] + ", extra INT"
    rows = records.read_records(spark, str(path), schema=schema).collect()
    assert sorted(r.extra for r in rows) == list(range(40))


def test_prepared_splits_read_back_complete(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"raw": f"r{n}", "extra": n}) for n in range(40)))
    formats.register_format("raw", lambda rows: rows.withColumnRenamed("raw", "text"))
    info = prepare_training_data(
        spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), data_format="raw", schema="raw STRING, extra INT"
    )
    paths = {"train": info["train_file"], "validation": info["validation_file"]}
    rows = records.read_split_files(spark, paths, schema="text STRING, extra INT").collect()
    assert sorted((r.text, r.extra) for r in rows) == sorted((f"r{n}", n) for n in range(40))
    assert sum(r.split == "validation" for r in rows) == info["num_val_samples"] == 4
