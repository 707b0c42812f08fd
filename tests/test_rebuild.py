"""Links kept by a stream of changes against a rebuild from all notes, batch by batch."""

import os
import random

from graphloom.operators import links as L
from graphloom.operators.parse import parse_notes
from graphloom.streaming import rebuild as R

SCHEMA = "path string, content string, modified long"
NAMES = ["alpha", "beta note", "beta-note", "sub/alpha", "sub/gamma", "delta", "Other/Delta"]


def note(rng):
    kind = "query" if rng.random() < 0.1 else "concept"
    alias = rng.choice(["", "", "aliases: [alpha, fifth]\n", "aliases: delta\n"])
    to = " ".join(f"[[{rng.choice([*NAMES, 'Alpha', 'Beta Note', 'fifth', 'missing', 'gamma|x', 'delta#part'])}]]" for _ in range(rng.randrange(4)))
    return f"---\ntype: {kind}\n{alias}---\n# Title\n{to}\n"


def test_every_batch_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    os.mkdir(source)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    seen, at = [], 0
    for k in range(4):
        batch = []
        for _ in range(6 if k == 0 else 3):
            at += 1
            name = rng.choice(NAMES)
            batch.append((f"{name}.md", None if k and rng.random() < 0.25 else note(rng), at))
        if k == 3:
            batch.append(("alpha.md", "[[delta]] came late", 0))
        seen += batch
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = R.keep_links(stream, out, f"{tmp_path}/checkpoint")
        assert query.awaitTermination(300)
        notes = parse_notes(R.current_notes(spark.createDataFrame(seen, SCHEMA)))
        refs = notes.selectExpr("id", "explode(links) AS target")
        want = sorted((r.id, r.target, r.resolved or "") for r in L.resolve_links(refs, L.link_keys(notes)).collect())
        got = sorted((r.id, r.target, r.resolved or "") for r in R.current_links(spark, out).collect())
        assert got == want, k
        assert want or k
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_note_says_each_spelling_once():
    """A link whose spellings are all alike tries one, and a note claims a spelling by its first claim only."""
    claims = [{"tier": t, "sub": s, "key": k} for t, s, k in [(1, 0, "x/c1"), (2, 0, "x/c1"), (2, 1, "x/c1"), (3, 0, "c1")]]
    refs = [{"target": "c2", "keys": ["c2"] * 7}, {"target": "A", "keys": ["A", "a", "a", "a", "a", "a", "a"]}]
    assert R.told(claims, refs) == {("x/c1", True, 1, 0, "", 0), ("c1", True, 3, 0, "", 0), ("c2", False, 0, 0, "c2", 0), ("A", False, 0, 0, "A", 0), ("a", False, 0, 0, "A", 1)}
