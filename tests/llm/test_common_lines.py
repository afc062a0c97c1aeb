"""Texts without the lines that their host repeats."""

from runloom.llm import line_rules


def test_common_lines_are_taken_out(spark):
    said = "Subscribe to our letter, issue {}!"
    body = lambda n: "\n".join(" ".join(f"x{n}w{k}i{i}" for i in range(15)) for k in range(2))
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(n, "h", said.format(n % 10) + "\n" + body(letters[n]) + "\n \n" + said.format(7)) for n in range(25)]
    rows += [(25, "h", None), (26, "other", said.format(1) + "\n" + body("z")), (27, "h", said.format(3))]
    df = spark.createDataFrame(rows, "doc_id LONG, source STRING, text STRING")
    got = {r.doc_id: r for r in line_rules.judge(df, clean_col="clean").collect()}
    assert len(got) == len(rows)
    for n in range(25):
        assert got[n].clean == body(letters[n]) + "\n " and got[n].kept and got[n].common_share > 0
    assert (got[25].clean, got[26].clean, got[27].clean) == ("", rows[26][2], "")
    assert got[27].common_share == 1.0 and not got[27].kept
    assert "clean" not in line_rules.judge(df).columns
