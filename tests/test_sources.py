"""Line-based sources keep their contracts; long chains aren't cut off."""

import pytest

from docengine.operators import identify as i
from docengine.sources import lines


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"kind": "rule", "code": "A"}\n{"kind": "stage", "code": "B"}\n')
    df = lines.json_lines(spark, str(path), "kind string, code string", 2)
    assert [r.code for r in lines.of_kind(df, "rule").collect()] == ["A"]
    with pytest.raises(ValueError, match="3 rows expected, 2 found"):
        lines.json_lines(spark, str(path), "kind string, code string", 3)
    path.write_text('{"kind": "rule", "code": "A"}\n{"kind": \n')
    with pytest.raises(Exception, match="(?i)malformed|json"):
        lines.json_lines(spark, str(path), "kind string, code string").collect()


@pytest.mark.parametrize(
    ("body", "error"),
    [("code|families\nA|x,y\nB|y\n", None), ("code|family\nA|x\n", "header"), ("code|families\nA| \nB|x\n", "incomplete"), ("code|families\nA|x,x\nB|y\n", "list"), ("code|families\nA|z\nB|y\n", "list"), ("code|families\nA|x\n", "key"), ("", "header")],
)
def test_barred_table(spark, tmp_path, body, error):
    path = tmp_path / "t.txt"
    path.write_text(body)
    keys = spark.createDataFrame([("A",), ("B",)], "code string")

    def read():
        return {r.code: r.families for r in lines.barred_table(spark, str(path), ["code", "families"], "code", keys, {"families": ["x", "y"]}).collect()}

    if error is None:
        assert read() == {"A": ["x", "y"], "B": ["y"]}
    else:
        with pytest.raises(ValueError, match=error):
            read()


def test_long_chain_with_cycle(spark):
    links = [(k, k - 1 if k else None) for k in range(150)] + [(1000, 1001), (1001, 1000), (1002, 1000)]
    links = spark.createDataFrame(links, "id long, predecessor_id long")
    got = {r.id: (r.root, r.depth, r.error) for r in i.chains(links).collect()}
    assert all(got[k] == (0, k, None) for k in range(150))
    assert all(got[k][2] == "cycle" for k in (1000, 1001, 1002))
    assert {r.id: r.error for r in i.chains(links, 64).collect()}[149] == "too_long"
