"""Notes as a data source, on real files."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators.trends import aging_orphans
from graphloom.plans.engine import build_graph
from graphloom.sources import datasource as N

DAY = 86_400_000


@pytest.fixture
def vault(spark, tmp_path):
    N.register(spark)
    for path, text in {"a.md": "# A\n[[b]]", "in/b.MD": "# B\nsee [[a]]", "in/deep/c.md": "# C", "in/x.txt": "no", ".notes-partial-1/d.md": "no", "out/e.md": "é"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    os.utime(tmp_path / "in/deep/c.md", (1_000_000_000, 1_000_000_000))
    return str(tmp_path)


def test_reads_notes_with_their_times(spark, vault):
    got = {r.path: r for r in spark.read.format("notes").load(vault).collect()}
    assert {p: r.content for p, r in got.items()} == {"a.md": "# A\n[[b]]", "in/b.MD": "# B\nsee [[a]]", "in/deep/c.md": "# C", "out/e.md": "é"}
    assert got["in/deep/c.md"].modified == 10**12 and all(r.created <= r.modified or r.path == "in/deep/c.md" for r in got.values()) and all(r.created for r in got.values())
    assert {r.path for r in spark.read.format("notes").option("folder", "in").option("maxBytes", 4).load(vault).collect()} == {"in/deep/c.md"}
    assert spark.read.format("notes").option("content", False).load(vault).where("content IS NULL").count() == 4


def test_scope_is_settled_before_texts_are_read(spark, vault):
    asked = spark.read.format("notes").load(vault).where(F.col("path").startswith("in/") & (F.col("modified") > 10**12))
    assert [r.path for r in asked.collect()] == ["in/b.MD"]
    # nothing is left of the filter above the scan
    assert "Filter" not in asked._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "").split("Scan")[0]
    reader = N.NotesReader({"path": vault})
    assert list(reader.pushFilters([N.StringStartsWith(("path",), "in/deep/"), N.EqualTo(("content",), "x")])) == [N.EqualTo(("content",), "x")]
    assert [p for part in reader.partitions() for p, _, _ in part.files] == ["in/deep/c.md"] and not reader.enters("out") and reader.enters("in")


def test_writes_notes_and_never_over_one(spark, vault):
    new = spark.createDataFrame([("new/deep/n.md", "text"), ("m.md", None)], "path string, content string")
    new.write.format("notes").mode("append").save(vault)
    assert open(f"{vault}/new/deep/n.md").read() == "text" and open(f"{vault}/m.md").read() == ""
    with pytest.raises(Exception, match="there already"):
        new.withColumn("content", F.lit("other")).write.format("notes").mode("append").save(vault)
    assert open(f"{vault}/new/deep/n.md").read() == "text" and not [p for p in os.listdir(vault) if p.startswith(".notes-partial-") and p != ".notes-partial-1"]
    new.withColumn("content", F.lit("other")).write.format("notes").mode("overwrite").save(vault)
    assert open(f"{vault}/m.md").read() == "other" and open(f"{vault}/a.md").read()
    with pytest.raises(Exception, match="below the folder"):
        new.withColumn("path", F.lit("../x.md")).write.format("notes").mode("append").save(vault)


def test_aging_orphans_of_real_files(spark, vault):
    graph = build_graph(spark.read.format("notes").load(vault))
    now = graph.nodes.where("id = 'out/e'").first().created + 40 * DAY
    found = {r.id: r.age for r in aging_orphans(graph.nodes, now, None).collect()}
    assert found["out/e"] == 40 and found["in/deep/c"] >= 40 and set(found) == {"out/e", "in/deep/c"}
