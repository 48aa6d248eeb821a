import json

import pytest

from sluice import sources


def test_json_sources(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps([{"a": 1}, {"a": None}]))
    assert sources.json_records(spark, str(tmp_path / "rows.json"), "a int").count() == 2
    (tmp_path / "map.json").write_text(json.dumps({"x": "2024-01-01", "a": "2024-01-02"}, indent=1))
    assert [tuple(r) for r in sources.json_map(spark, str(tmp_path / "map.json"), "string").collect()] == [(0, "x", "2024-01-01"), (1, "a", "2024-01-02")]
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "1.json").write_text('{"a": 1}')
    (tree / "2.json").write_text("{broken")
    assert [r["a"] for r in sources.json_tree(spark, str(tree / "*.json"), "a int").collect()] == [1]


def test_scope_directories_and_log(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    for name, text in (("CANON.md", "c\nd"), ("VOCAB.md", "v"), ("README.md", "r")):
        (tmp_path / "s1" / name).write_text(text)
    row = sources.scope_directories(spark, f"{tmp_path}/*/*").first()
    assert (row["files"], row["canon"], row["claims_json"]) == (["CANON.md", "README.md", "VOCAB.md"], "c\nd", None)
    (tmp_path / "log.txt").write_text("abc 2024-01-01\nbroken\nx y z\ndef 2024-01-02\n")
    assert [r["sha"] for r in sources.commit_log(spark, str(tmp_path / "log.txt")).orderBy("pos").collect()] == ["abc", "def"]
    sources.write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert sources.markdown(spark.range(1)).splitlines() == ["| id |", "|---|", "| 0 |"]


def test_commit_log_positions_have_no_gaps(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"log{k}.txt").write_text("".join(f"c{k}x{i} 2024-01-0{k + 1}\nbroken\n" for i in range(7)))
    rows = sources.commit_log(spark, f"{tmp_path}/log*.txt").orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(35))
    for k in range(5):
        own = [r["sha"] for r in rows if r["sha"].startswith(f"c{k}x")]
        assert own == [f"c{k}x{i}" for i in range(7)]


def test_markdown_says_what_it_leaves_out(spark):
    assert len(sources.markdown(spark.range(1500)).splitlines()) == 1502
    assert sources.markdown(spark.range(5), 2).splitlines()[-1] == "(only the first 2 rows)"
    assert len(sources.markdown(spark.range(2), 2).splitlines()) == 4


def test_shared_dir_on_a_cluster(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError):
        sources.shared_dir(Cluster)
