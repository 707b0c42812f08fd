"""Edits of notes: links put into their texts, many at a time, and what each edit changed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import wikilink, without_md

# What a head, code and links look like in a note.
_HEAD = re.compile(r"\A﻿?---[ \t]*\r?\n.*?^---[ \t]*(?:\r?\n|\Z)", re.S | re.M)
_CODE = [re.compile(r"^(`{3,}|~{3,})[^\n]*\n.*?^\1[^\n]*$", re.S | re.M), re.compile(r"```.*?```", re.S), re.compile(r"`[^`\n]*`")]
_LINKS = [re.compile(r"\[\[([^\[\]]+?)\]\]"), re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)")]
_FENCE_LINE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s")
# Letters whose words have edges, bracket groups that belong to the word before them, and how long one may be.
_LATIN = re.compile(r"[0-9A-Za-zÀ-ɏ]")
CLOSING = {"（": "）", "(": ")"}
MOST_GLOSS = 200


def _page(name: str) -> str:
    """The last part of what a link or an id names, as links are told apart by it."""
    name = re.split(r"[|#]", name.replace("\\", "/"), maxsplit=1)[0].strip().lower()
    return name.removesuffix(".md").rsplit("/", 1)[-1]


def links_to(content: str, target: str) -> bool:
    """Whether a text links to a page, by any spelling that ends in its name; links in code are none."""
    for code in _CODE:
        content = code.sub("", content)
    own = _page(target)
    return bool(own) and any(_page(inner) == own for inner in _LINKS[0].findall(content))


@dataclass(frozen=True)
class Spot:
    """A place where a term stands and may be linked; prose goes before headings."""

    heading: bool
    start: int
    end: int


def closed_to_edits(content: str) -> bytearray:
    """A mark for each character that no edit may touch: the head, code, links, and all that an open fence hides."""
    head = _HEAD.match(content)
    start = head.end() if head else 0
    shut = bytearray(len(content))
    shut[:start] = b"\1" * start
    for kind in (*_CODE, *_LINKS):
        for m in kind.finditer(content[start:]):
            shut[start + m.start() : start + m.end()] = b"\1" * (m.end() - m.start())
    at, open_at, mark = start, None, ""
    for line in content[start:].split("\n"):
        if fence := _FENCE_LINE.match(line):
            if open_at is None:
                open_at, mark = at, fence[1][0]
            elif fence[1][0] == mark:
                open_at = None
        at += len(line) + 1
    if open_at is not None:
        shut[open_at:] = b"\1" * (len(content) - open_at)
    return shut


def spots(content: str, term: str) -> Iterator[Spot]:
    """All places where a term stands as a word and may be linked, whatever its case."""
    shut = closed_to_edits(content)
    letter = lambda k: 0 <= k < len(content) and bool(_LATIN.match(content[k]))
    for m in re.finditer(re.escape(term), content, re.I):
        a, b = m.span()
        whole = not letter(a) or not letter(a - 1) and not letter(b)
        if whole and 1 not in shut[a:b]:
            yield Spot(bool(_HEADING.match(content[content.rfind("\n", 0, a) + 1 :])), a, b)


def after_word(content: str, at: int) -> int:
    """Where a word that ends at a place ends together with a bracket group right behind it."""
    closing = CLOSING.get(content[at : at + 1])
    end = content.find(closing, at + 1, at + 2 + MOST_GLOSS) if closing else -1
    return at if end < 0 else end + 1


def insert(content: str, term: str | None, text: str | None, target: str | None) -> tuple[bool, str, str | None]:
    """(changed, content, reason): the note with （text） after the first place of term in prose, or else in a heading.

    The reason is already-linked or term-not-found where nothing changed.
    """
    term = (term or "").strip()
    if term and text and links_to(content, target or ""):
        return False, content, "already-linked"
    best = min(spots(content, term), key=lambda s: (s.heading, s.start), default=None) if term and text else None
    if best is None:
        return False, content, "term-not-found"
    at = after_word(content, best.end)
    return True, f"{content[:at]}（{text}）{content[at:]}", None


def inserted_span(before: str, after: str) -> tuple[int, int] | None:
    """The part of after that before doesn't have, between what both begin and what both end with; None if there is none."""
    n = min(len(before), len(after))
    start = next((k for k in range(n) if before[k] != after[k]), n)
    tail = next((k for k in range(n - start) if before[-1 - k] != after[-1 - k]), n - start)
    return (start, len(after) - tail) if len(after) - tail > start else None


def first_change(before: str, after: str) -> dict | None:
    """line (from 1), before, after, start, end: the first line that differs, and where in it; None if none does."""
    old, new = before.split("\n"), after.split("\n")
    for k in range(max(len(old), len(new))):
        was, now = (lines[k] if k < len(lines) else "" for lines in (old, new))
        if was != now or k >= len(old) or k >= len(new):
            start, end = inserted_span(was, now) or (None, None)
            return {"line": k + 1, "before": was, "after": now, "start": start, "end": end}
    return None


OUTCOME = "ord long, term string, changed boolean, reason string, line int, before string, after string, start int, end int"


def fold(content: str, edits: list[dict]) -> tuple[str, list[dict]]:
    """The note after its edits, one after the other by ord, and what became of each.

    An edit has ord, terms, text and target: its terms are tried in order until one is
    found.  Each edit sees what those before it left, so a second link to a page is refused.
    """
    told = []
    for e in sorted(edits, key=lambda e: e["ord"]):
        now, term, changed, reason = content, None, False, "term-not-found"
        for term in [t for t in (e["terms"] if e["terms"] is not None else []) if t and t.strip()]:
            changed, now, reason = insert(content, term, e["text"], e["target"])
            if reason != "term-not-found":
                break
        told.append({"ord": e["ord"], "term": term if changed else None, "changed": changed, "reason": reason} | (first_change(content, now) or dict.fromkeys(("line", "before", "after", "start", "end"))))
        content = now
    return content, told


def apply_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """id, content, outcomes (ord, term, changed, reason, line, before, after, start, end) of each note (id, content) that has edits (id, ord, terms, text, target).

    Notes are edited side by side, the edits of a note in the order of ord.  Edits of
    unknown notes are left out; nothing is written.
    """
    each = edits.groupBy("id").agg(F.collect_list(F.struct("ord", "terms", "text", "target")).alias("edits"))
    kind = notes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [fold(c or "", list(e)) for c, e in zip(pdf["content"], pdf["edits"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "content": [c for c, _ in done], "outcomes": [o for _, o in done]})

    return notes.select("id", "content").join(each, "id").mapInPandas(run, f"id {kind}, content string, outcomes array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split() for c in OUTCOME.split(', ')))}>>")


def _insert(content: pd.Series, term: pd.Series, text: pd.Series, target: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([insert(*row) for row in zip(content.fillna(""), term, text, target, strict=True)], columns=["changed", "content", "reason"])


def insert_links(edits: DataFrame) -> DataFrame:
    """edits (content, term, text, target) with edit (changed, content, reason)."""
    return edits.withColumn("edit", F.pandas_udf(_insert, "changed boolean, content string, reason string")("content", "term", "text", "target"))


def candidate_terms(rows: DataFrame) -> DataFrame:
    """rows (term, text, label) with terms: what a note may call the page that the link text names, each once whatever its case.

    First the term that was matched, if known, then the link's alias, the page's label, and the name of its file.
    """
    inner = F.regexp_replace("text", r"^\[\[|\]\]$", "")
    alias = F.get(F.split(inner, r"\|"), F.lit(1))
    file = without_md(F.substring_index(F.substring_index(F.substring_index(inner, "|", 1), "#", 1), "/", -1))
    every = F.filter(F.transform(F.array("term", alias, "label", file), F.trim), lambda t: t.isNotNull() & (t != ""))
    seen = F.aggregate(every, F.array().cast("array<string>"), lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))
    return rows.withColumn("terms", seen)


def perform(actions: DataFrame, notes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What actions would write (path, content, is_new), and what became of each (action, notice, paths, outcome).

    actions has action (an id), kind, source, target, text, term, pages (ids) and title;
    notes id, path and content, nodes id, path and label.  insert-wikilink edits the source's
    note, create-moc lists pages in a new note beside the first of them and never over
    one that exists, open-notes names two paths, open-report asks for the report.
    """
    links = actions.where("kind = 'insert-wikilink'").join(nodes.select(F.col("id").alias("target"), "label"), "target", "left")
    edits = candidate_terms(links).select(F.col("source").alias("id"), F.col("action").alias("ord"), "terms", "text", "target")
    edited = notes.join(apply_edits(notes, edits).withColumnRenamed("content", "new"), "id")
    notice = F.when(F.col("o.changed"), "link-inserted").when(F.col("o.reason") == "already-linked", "link-already-there").otherwise("term-not-found")
    done = edited.select("path", F.explode("outcomes").alias("o")).select(F.col("o.ord").alias("action"), notice.alias("notice"), F.array("path").alias("paths"), "o")
    lost = links.join(notes.select(F.col("id").alias("source")), "source", "left_anti").select("action", F.lit("failed").alias("notice"), F.array().cast("array<string>").alias("paths"))
    # pages of an action in their order, with where they are
    shown = actions.where("kind IN ('open-notes', 'create-moc')").select("action", "kind", F.trim(F.translate("title", "/\\", "--")).alias("title"), F.posexplode("pages").alias("pos", "id")).join(nodes.select("id", "path", "label"), "id", "left")
    base = without_md(F.substring_index(F.coalesce("path", F.col("id").cast("string")), "/", -1))
    rows = shown.withColumn("line", F.concat(F.lit("- "), wikilink(base, F.coalesce("label", F.col("id").cast("string")))))
    told = rows.groupBy("action", "kind", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "line"))).alias("l"))
    opened = told.where("kind = 'open-notes'").select("action", F.lit("opened").alias("notice"), F.slice(F.filter(F.col("l.path"), lambda p: p.isNotNull()), 1, 2).alias("paths"))
    folder = F.when(F.instr(F.get("l", F.lit(0))["path"], "/") > 0, F.concat(F.regexp_extract(F.get("l", F.lit(0))["path"], "^(.*)/", 1), F.lit("/"))).otherwise("")
    made = told.where("kind = 'create-moc' AND title <> ''").select("action", F.concat(folder, "title", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join("l.line", "\n"), F.lit("\n")).alias("content"))
    first = made.groupBy("path").agg(F.min("action").alias("action"))  # of two notes of one name, one is made
    fresh = made.join(first, ["path", "action"], "left_semi").join(notes.select("path"), "path", "left_anti")
    index = made.join(fresh.select("action", F.lit(True).alias("new")), "action", "left").select("action", F.when(F.col("new"), "index-created").otherwise("index-exists").alias("notice"), F.array("path").alias("paths"))
    empty = actions.where("kind = 'create-moc'").join(made.select("action"), "action", "left_anti").select("action", F.lit("failed").alias("notice"), F.array().cast("array<string>").alias("paths"))
    report = actions.where("kind = 'open-report'").select("action", F.lit("report").alias("notice"), F.array().cast("array<string>").alias("paths"))
    written = edited.where(F.exists("outcomes", lambda o: o["changed"])).select("path", F.col("new").alias("content"), F.lit(False).alias("is_new")).unionByName(fresh.select("path", "content", F.lit(True).alias("is_new")))
    outcomes = done
    for more in (lost, opened, index, empty, report):
        outcomes = outcomes.unionByName(more.withColumn("o", F.lit(None).cast(done.schema["o"].dataType)))
    return written, outcomes.withColumnRenamed("o", "outcome")
