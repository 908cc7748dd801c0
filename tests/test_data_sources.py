"""Mixed folders are read whole, and a results table keeps one header."""

import io
import json
import os

import pytest

from gradeloom.sources import problems, results
from gradeloom.sources.data_sources import HEADER, json_records

SCHEMA = "id bigint, text string, tags array<string>"


def test_mixed_folder(spark, tmp_path):
    rows = [(i, f"t{i},\n[]{{}}\"é", ["a", None]) for i in range(50)]
    spark.createDataFrame(rows[:20], SCHEMA).repartition(3).write.parquet(str(tmp_path / "x" / "first"))
    # A name says nothing: JSON records under a parquet name, as a fallback leaves them.
    (tmp_path / "x" / "b.parquet").write_text(json.dumps([{"id": r[0], "text": r[1], "tags": r[2]} for r in rows[20:40]]))
    (tmp_path / "c.json").write_text("".join(json.dumps({"text": r[1], "id": r[0]}) + "\n" for r in rows[40:]))
    (tmp_path / "x" / "_ignored").write_text("nothing")
    paths = [str(tmp_path / "x"), str(tmp_path / "c.json")]
    got = problems.read_mixed_examples(spark, paths, SCHEMA).orderBy("id").collect()
    assert [(r["id"], r["text"], r["tags"]) for r in got] == [*rows[:40], *[(*r[:2], None) for r in rows[40:]]]
    assert problems.read_mixed_examples(spark, paths, "id bigint").count() == 50
    with pytest.raises(Exception, match="name the columns"):
        spark.read.format("gradeloom_examples").option("paths", "[]").load()
    with pytest.raises(Exception, match="nowhere"):
        problems.read_mixed_examples(spark, [str(tmp_path / "nowhere")], SCHEMA).collect()


def test_records_over_piece_bounds(monkeypatch):
    monkeypatch.setattr("gradeloom.sources.data_sources.TEXT_AT_ONCE", 7)
    given = [{"a": "x" * n, "b": [1, {"c": "]},["}]} for n in range(20)]
    for text in (json.dumps(given), json.dumps(given, indent=1), "\n".join(map(json.dumps, given)), ""):
        assert list(json_records(io.BytesIO(text.encode()))) == (given if text else [])
    with pytest.raises(json.JSONDecodeError):
        list(json_records(io.BytesIO(b'[{"a": 1}, {"a": ')))


def test_two_appends_one_header(spark, tmp_path):
    path = str(tmp_path / "pass")
    schema = "model string, pass_at_1 double, note string"
    first = [("a", 0.5, 'quo"te, comma'), ("b", 0.25, None)]
    for rows in (first, [("c", 1.0, "x")], []):
        results.append_pass_csv(spark.createDataFrame(rows, schema).repartition(2), path)
    files = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    assert files[0] == HEADER and len(files) == 4
    whole = "".join(open(os.path.join(path, f)).read() for f in files)
    assert whole.count("pass_at_1") == 1 and whole.startswith("model,pass_at_1,note\n")
    got = results.read_pass_csv(spark, path, schema).collect()
    assert sorted((r["model"], r["pass_at_1"]) for r in got) == [("a", 0.5), ("b", 0.25), ("c", 1.0)]
    assert {r["note"] for r in got} == {'quo"te, comma', None, "x"}


def test_a_failing_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "pass")
    bad = spark.range(4).selectExpr("if(id = 3, raise_error('no'), id) AS v")
    with pytest.raises(Exception, match="no"):
        results.append_pass_csv(bad, path)
    assert not os.path.exists(path) or not [f for f in os.listdir(path) if f != "_temporary"]
