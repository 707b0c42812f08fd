"""Notes, names, texts, edits, findings and histories."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import content as K
from graphloom.operators import filters as V
from graphloom.operators import links as L
from graphloom.operators import ranking as X
from graphloom.operators import trends as T
from graphloom.operators.edit import insert
from graphloom.operators.evaluation import auc
from graphloom.operators.parse import parse_notes
from graphloom.sources import vault


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values)))).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "key"), [("raw/papers/Attention  Is.PDF", "attention is"), ("[[Attention Is]]", "attention is"), ("a\\b\\c.docx#page=2", "c"), ("  ", "")])
def test_source_key(spark, raw, key):
    assert one(spark, S.source_key(F.col("c0")), raw) == key


@pytest.mark.parametrize(("name", "yes"), [("Index of Things", True), ("indexes", False), ("log索引", True), ("README.md", True), ("notes", False)])
def test_structural_name(spark, name, yes):
    assert one(spark, S.structural_name(F.col("c0")), name) is yes


def test_wikilinks_outside_code(spark):
    text = "[[a#h|b]] `[[no]]` ```\n[[no]]\n``` ~~~\n[[no2]]\n~~~\n[[ c ]] [[|x]]"
    assert one(spark, S.wikilinks(S.strip_code(F.col("c0"))), text) in (["a", "c"], ["a", "no2", "c"])


def test_parse_note(spark):
    raw = spark.createDataFrame([("A/My-Note.md", "---\ntype: Person\ntags: ['#x', y]\nsources: a.pdf, b.txt\naliases: [Me]\nrelated: [\"[[Other|o]]\"]\n---\n# Head\n[[T]] and [[T]]\n"), ("bad.md", "---\n: : [\n---\ntext"), ("q.md", "---\ntype: query\n---\n")], "path string, content string")
    n = {r.id: r for r in parse_notes(raw).collect()}
    a = n["a/my-note"]
    assert (a.title, a.type, a.tags, a.sources, a.aliases, a.links) == ("Head", "entity", ["x", "y"], ["a", "b"], ["Me"], ["T", "Other"])
    assert n["bad"].type == "other" and n["bad"].title == "bad" and "q" not in n


def test_link_resolution_priorities(spark):
    notes = spark.createDataFrame([("dir/my-page", "my-page", []), ("z/other", "other", ["my page", "Alias One"])], "id string, basename string, aliases array<string>")
    refs = spark.createDataFrame([("x", t) for t in ("My Page", "dir/my-page.md", "MY-PAGE", "alias one", "nowhere")], "id string, target string")
    got = {r.target: r.resolved for r in L.resolve_links(refs, L.link_keys(notes)).collect()}
    assert got == {"My Page": "dir/my-page", "dir/my-page.md": "dir/my-page", "MY-PAGE": "dir/my-page", "alias one": "z/other", "nowhere": None}


def test_scope_and_folders(spark):
    paths = spark.createDataFrame([("t/a.md",), ("t/u/b.md",), ("t-other/c.md",), ("root.md",), (".git/x.md",)], "path string")
    assert {r.path for r in vault.in_scope(paths, "t").collect()} == {"t/a.md", "t/u/b.md"}
    assert {r.path for r in vault.in_scope(paths, "", ["t"]).collect()} == {"t-other/c.md", "root.md"}
    assert {(r.path, r.n) for r in vault.folder_counts(paths.where("path NOT LIKE '.git%'")).collect()} == {("", 1), ("t", 2), ("t/u", 1), ("t-other", 1)}


def test_history_reads_what_can_be_read(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"key":"a","firstSeen":1,"lastSeen":5}\n\n{"key":"a","firstSeen":1,"lastSeen":9}\n{"key":"a","firstSeen":1,"lastSeen":7}\n{"key":"b","firstSeen":3}\n{"key":"c","fir')
    assert {(r.key, r.first_seen, r.last_seen) for r in vault.read_history(spark, str(p)).collect()} == {("a", 1, 7), ("b", 3, 3)}


def test_mentions(spark):
    notes = spark.createDataFrame([(1, "We met Graph Theory today. Not Graph Theorys."), (2, "Graph Theory is mine"), (3, "`Graph Theory` only in code"), (4, "nothing"), (5, "none"), (6, "no")], "id long, body string")
    terms = spark.createDataFrame([(1, "A first page"), (2, "Graph Theory"), (3, "A third page"), (9, "abc")], "target long, term string")
    none = spark.createDataFrame([], "id long, nbr long")
    got = K.mentions(notes, terms, none).collect()
    assert [(r.source, r.target, r.occurrences) for r in got] == [(1, 2, 1)]
    linked = spark.createDataFrame([(1, 2), (2, 1)], "id long, nbr long")
    assert K.mentions(notes, terms, linked).count() == 0


def test_duplicate_names(spark):
    names = spark.createDataFrame([(1, "Deep Learning Basics"), (2, "deep-learning basics"), (3, "Deep Learning Basics Two"), (4, "知识图"), (5, "other")], "id long, title string")
    assert {(r.a, r.b, round(r.similarity, 3)) for r in K.duplicate_names(names).collect()} == {(1, 2, 1.0), (1, 3, 0.75)}


@pytest.mark.parametrize(
    ("content", "term", "want"),
    [
        ("see Alpha here", "alpha", "see Alpha（[[B]]） here"),
        ("# Alpha\nand Alpha(x) too", "Alpha", "# Alpha\nand Alpha(x)（[[B]]） too"),
        ("---\na: Alpha\n---\n`Alpha` [[Alpha]] Alphas", "Alpha", None),
        ("links [[b]] Alpha", "Alpha", None),
    ],
)
def test_insert_link(content, term, want):
    changed, new, reason = insert(content, term, "[[B]]", "x/b")
    assert (new == want and changed) if want else (not changed and new == content and reason)


def test_bursts_and_topics(spark):
    series = spark.createDataFrame([("up", k, 1 if k < 8 else 30) for k in range(10)] + [("flat", k, 5) for k in range(10)] + [("short", k, 9) for k in range(3)], "term string, bucket long, n long")
    found = T.topics(T.bursts(series)).collect()
    assert [(r.term, r.kind, r.first, r.last, r.weight) for r in found] == [("up", "emerging-topic", 8, 9, 2)]


def test_observe(spark):
    old = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "key string, first_seen long, last_seen long")
    seen = spark.createDataFrame([("a",), ("c",)], "key string")
    whole, new = T.observe(old, seen, 9)
    assert {tuple(r) for r in whole.collect()} == {("a", 1, 9), ("b", 1, 2), ("c", 9, 9)} and [r.key for r in new.collect()] == ["c"]


def test_rank_and_sticky(spark):
    f = spark.createDataFrame([("k1", "missing-link", "p", 0.9, 2, "edit", "strong"), ("k2", "missing-link", "p", 0.5, 2, "one-click", "weak"), ("k3", "sparse", "g", 0.0, 3, "write", "moderate"), ("k4", "missing-link", "p", 0.1, 2, "edit", "moderate")], "key string, kind string, analyser string, score double, severity int, effort string, confidence string")
    assert [r.key for r in X.rank_findings(f, {"p": 2}).orderBy("rank").collect()] == ["k3", "k2", "k1"]
    assert [r.key for r in X.rank_findings(f, {}, drop_weak=True, total=2).orderBy("rank").collect()] == ["k3", "k1"]
    rows = [{"severity": 1, "effort": "edit", "norm": 0.52, "key": "x"}, {"severity": 1, "effort": "edit", "norm": 0.5, "key": "y"}]
    assert [r["key"] for r in X.sticky(rows, {"y"})] == ["y", "x"] and [r["key"] for r in X.sticky(rows, set())] == ["x", "y"]


def test_filters(spark):
    nodes = spark.createDataFrame([(1, "Person", "entity", ["a"], 0, False, 1), (2, "", "query", ["b", "b", ""], 1, False, 0), (3, "x", "other", [], 1, True, 0)], "id long, raw_type string, type string, tags array<string>, community long, is_structural boolean, vault_link_count long")
    ids = lambda f: sorted(r.id for r in V.visible_nodes(nodes, f).collect())
    assert ids(V.Filters()) == [1, 2, 3] and ids(V.Filters(hidden_types=("query",))) == [1, 3]
    assert ids(V.Filters(hide_isolated=True)) == [1, 3] and ids(V.Filters(included_tags=("b",))) == [2] and ids(V.Filters(included_tags=())) == [1, 2, 3]
    assert [(r.tag, r.n) for r in V.tag_facet(nodes).collect()] == [("a", 1), ("b", 1)]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.0, 0)], "score double, positive long")
    assert auc(df).first().auc == 0.75


def test_heads_end_on_a_line_of_their_own(spark):
    raw = spark.createDataFrame([("a.md", "---\ntitle: foo---\ntype: concept\n---\nbody"), ("b.md", "---\ntype: entity\n---\n## Head ##\n"), ("c.md", "no head\n---\n")], "path string, content string")
    got = {r.id: (r.raw_type, r.title) for r in parse_notes(raw).collect()}
    assert got == {"a": ("concept", "foo---"), "b": ("entity", "Head"), "c": ("", "c")}


def test_related_entries_and_tags(spark):
    row = spark.range(1).select(S.related_key(F.lit("[[dir\\Page.md|x]]")).alias("r"), S.clean_tags(F.array(F.lit("##two"), F.lit("#one"))).alias("t")).first()
    assert (row.r, row.t) == ("Page", ["#two", "one"])


def test_mentions_of_pages_that_share_a_name(spark):
    notes = spark.createDataFrame([(1, "All about vector search here, and İstanbul Vector Search too."), (2, "# generic\nA line."), (3, "Generic. More on generic things.")], "id long, body string")
    terms = spark.createDataFrame([(10, "Vector Search"), (11, "vector search"), (2, "Generic"), (12, "generic"), (13, "generic"), (14, "other name"), (1, "page one"), (3, "page three")], "target long, term string")
    got = {(r.source, r.target): (r.occurrences, r.term) for r in K.mentions(notes, terms, spark.createDataFrame([], "id long, nbr long")).collect()}
    # a heading counts only for names that few pages bear, and "Generic." is a sentence of its own
    assert got == {(1, 10): (2, "vector search"), (1, 11): (2, "vector search"), (3, 2): (1, "generic"), (3, 12): (1, "generic"), (3, 13): (1, "generic")}


def test_previous_keys_and_dropped(spark):
    rows = [(f"k{i}", "sparse", "gaps", 0.5 + i / 100, 2, "edit", "moderate") for i in range(6)]
    df = spark.createDataFrame(rows, "key string, kind string, analyser string, score double, severity int, effort string, confidence string")
    got = X.rank_findings(df, {"gaps": 2}, previous_keys={"k3"}).orderBy("rank").collect()
    assert [r.key for r in got] == ["k3", "k5"] and {r.dropped for r in got} == {4}
    assert [r.key for r in X.rank_findings(df, {"gaps": 2}).orderBy("rank").collect()] == ["k5", "k4"]


def test_findings_are_whole(spark):
    from graphloom.plans.engine import analyse, build_graph

    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    notes = [(f"n/{w}.md", f"---\ntype: concept\n---\n# {w} page\nSee " + " ".join(f"[[{x}]]" for x in words if x != w and (len(w) + len(x)) % 2)) for w in words]
    notes.append(("n/alone.md", "---\ntype: entity\n---\nOnly words on the alpha page of old."))
    raw = spark.createDataFrame([(p, c, 0, 0) for p, c in notes], "path string, content string, created long, modified long")
    series = spark.createDataFrame([("topic", k, 20 if k > 27 else 1, ["n/alpha"]) for k in range(30)], "term string, bucket long, n long, ids array<string>")
    graph = build_graph(raw)
    got = analyse(graph, 40 * 86_400_000, series=series).collect()
    kinds = {r.kind for r in got}
    assert {"orphan-aging", "emerging-topic", "unlinked-mention"} <= kinds
    old = next(r for r in got if r.kind == "orphan-aging")
    assert old.severity == 2 and list(old.anchors) == ["n/alone"] and old.evidence[0].label == "days" and len(old.fp) == 64
    said = next(r for r in got if r.kind == "unlinked-mention")
    assert said.action == "insert-link" and set(said.anchors) == {"n/alone", "n/alpha"} and said.title == "alpha page"


def test_heads_are_read_in_c_unless_they_are_subtle(monkeypatch):
    """What the plain parser gives, without calling it for an ordinary head, and once for heads that are the same."""
    import yaml

    from graphloom.operators import parse as P

    heads = ["type: A b\ntags: ['#x', size3]\nsources: raw/S 3.pdf", "title: 3", "a: [1, 2", "tags:\n- |#x", "title: !\n", "x:\t1"]

    def plain(h):
        try:
            return yaml.safe_load(h)
        except yaml.YAMLError:
            return None

    assert [P._load(h) for h in heads] == [plain(h) for h in heads]
    P._read.cache_clear()
    monkeypatch.setattr(yaml, "safe_load", lambda h: 1 / 0)
    got = [P._read(h) for h in heads[:1] * 3][-1]
    assert (got["type"], got["tags"], got["sources"]) == ("A b", ["#x", "size3"], ["raw/S 3.pdf"])
    assert P._read.cache_info().hits == 2


def test_heads_are_read_once_where_types_are_dropped(spark):
    from graphloom.operators.parse import parse_notes

    raw = spark.createDataFrame([("a.md", "---\ntype: query\n---\nx"), ("b.md", "---\ntype: entity\n---\n[[a]]")], "path string, content string")
    got = parse_notes(raw)
    assert [(r.id, r.type, r.links) for r in got.collect()] == [("b", "entity", ["a"])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
