"""A vault's links, kept up to date from a stream of changed notes.

Only notes that changed are parsed.  Three keyed states follow from each other in
one query: a note's last claims and links; of each spelling, who claims it and which
links try it; of each link, what its spellings mean.  A change goes from one to the
next as rows that add or withdraw, so links whose spellings nobody touched aren't looked at again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from graphloom.functions.scalars import normal_path, without_md
from graphloom.operators.links import claims, spellings
from graphloom.operators.parse import parse_notes

#: What the states need of the session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_DELTA = "key string, note string, add boolean, claim boolean, tier int, sub int, target string, pos int"
_TRIED = "note string, target string, pos int, add boolean, resolved string"
_LINK = "id string, target string, resolved string, alive boolean"


def told(claims: list, refs: list) -> set[tuple]:
    """What a note's claims and links say of spellings, each once: its first claim to a spelling, and the first place where a link tries it.

    Later ones of the same note or link can decide nothing.
    """
    first: dict[str, tuple] = {}
    for c in claims:
        first[c["key"]] = min(first.get(c["key"], (9, 9)), (int(c["tier"]), int(c["sub"])))
    out = {(k, True, tier, sub, "", 0) for k, (tier, sub) in first.items()}
    return out | {(k, False, 0, 0, r["target"], r["keys"].index(k)) for r in refs for k in set(r["keys"])}


class NoteState(StatefulProcessor):
    """A note's last version: what it claims and which links it has.  Rows that withdraw the old and add the new come out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "version long, said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        note, best = key[0], None
        for r in rows:
            if best is None or r.version >= best.version:
                best = r
        version, old = self.held.get() or (None, "[]")
        if best is None or version is not None and best.version < version:
            return  # a version that came too late
        said = set() if best.gone else told(best.claims, best.refs)
        was = {tuple(x) for x in json.loads(old)}
        # a version stays known after its note has gone, so that older ones don't bring it back
        self.held.update((int(best.version), json.dumps(sorted(said))))
        for add, changed in ((False, was - said), (True, said - was)):
            for k, *rest in sorted(changed):
                yield Row(key=k, note=note, add=add, claim=rest[0], tier=rest[1], sub=rest[2], target=rest[3], pos=rest[4])

    def close(self) -> None:
        pass


class SpellingState(StatefulProcessor):
    """Of a spelling: the notes that claim it, of which the first in order has it, and the links that try it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getMapState("claimed", "note string, tier int, sub int", "n int")
        self.tried = handle.getMapState("tried", "note string, target string, pos int", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        changes = sorted(rows, key=lambda r: r.add)  # withdrawals first
        claimed = {(note, tier, sub) for note, tier, sub in self.claimed.keys()}  # asked once: each call goes to another process
        winner = lambda: min(((tier, note) for note, tier, _ in claimed), default=(0, None))[1]
        before, gone, fresh = winner(), [], set()
        for r in changes:
            entry = (r.note, int(r.tier), int(r.sub)) if r.claim else (r.note, r.target, int(r.pos))
            if r.claim:
                if r.add:
                    self.claimed.updateValue(entry, (1,))
                    claimed.add(entry)
                elif entry in claimed:
                    self.claimed.removeKey(entry)
                    claimed.discard(entry)
            elif r.add:
                self.tried.updateValue(entry, (1,))
                fresh.add(entry)
            elif self.tried.containsKey(entry):
                self.tried.removeKey(entry)
                gone.append(entry)
        now = winner()
        for add, page, entries in ((False, None, gone), (True, now, [tuple(k) for k in self.tried.keys()] if now != before else sorted(fresh))):
            for note, target, pos in entries:
                yield Row(note=note, target=target, pos=pos, add=add, resolved=page)

    def close(self) -> None:
        pass


class LinkState(StatefulProcessor):
    """Of a link: what each of its spellings means; the first that means a page decides."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meant = handle.getMapState("meant", "pos int", "page string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: r.add):
            if r.add:
                self.meant.updateValue((int(r.pos),), (r.resolved or "",))
            elif self.meant.containsKey((int(r.pos),)):
                self.meant.removeKey((int(r.pos),))
        found = sorted((p[0], page[0]) for p, page in self.meant.iterator())
        yield Row(id=key[0], target=key[1], resolved=next((page for _, page in found if page), None), alive=bool(found))

    def close(self) -> None:
        pass


def note_versions(changes: DataFrame, *, hidden_types: tuple[str, ...] = ("query",)) -> DataFrame:
    """id, version, gone, claims, refs of changes (path, content, modified), a table or a stream; a null content is a note that went.

    Notes of a hidden type are gone as well: nothing links to them.
    """
    told = changes.select("path", F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNull().cast("long").alias("created"), "modified")  # created carries the flag through parsing
    notes = parse_notes(told, drop_types=())
    refs = F.transform("links", lambda t: F.struct(t.alias("target"), spellings(t).alias("keys")))
    gone = (F.col("created") == 1) | F.col("type").isin(*hidden_types) if hidden_types else F.col("created") == 1
    return notes.select("id", F.col("modified").alias("version"), gone.alias("gone"), claims().alias("claims"), refs.alias("refs"))


def link_changes(changes: DataFrame, *, hidden_types: tuple[str, ...] = ("query",)) -> DataFrame:
    """id, target, resolved, alive of every link that a stream of changes (path, content, modified) touches, batch by batch."""
    keyed = lambda df, by, processor, schema: df.groupBy(*by).transformWithState(statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode="None")
    deltas = keyed(note_versions(changes, hidden_types=hidden_types), ["id"], NoteState(), _DELTA)
    tried = keyed(deltas, ["key"], SpellingState(), _TRIED)
    return keyed(tried, ["note", "target"], LinkState(), _LINK)


def keep_links(changes: DataFrame, path: str, checkpoint: str, *, hidden_types: tuple[str, ...] = ("query",), every: str | None = None) -> StreamingQuery:
    """Write each batch's changed links to Parquet below path; current_links() reads what holds.

    With every, such as "2 seconds", changes gather for so long before they are
    taken up, as a rebuild needn't follow each key stroke; without, what is there is taken up and the query ends.
    A batch that is written again replaces itself.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number}")

    query = link_changes(changes, hidden_types=hidden_types).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:  # the query keeps what the session says as it starts
        return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(STORE[0], before)


def current_links(spark: SparkSession, path: str) -> DataFrame:
    """id, target, resolved of every link that is there now, by the last batch that touched it."""
    rows = spark.read.schema(f"{_LINK}, batch long").option("recursiveFileLookup", True).parquet(path)
    last = rows.groupBy("id", "target").agg(F.max_by(F.struct("resolved", "alive"), "batch").alias("x"))
    return last.where("x.alive").select("id", "target", "x.resolved")


def current_notes(changes: DataFrame) -> DataFrame:
    """path, content, modified of the last version of each note in a table of changes; those that went are left out."""
    last = changes.groupBy(F.lower(without_md(normal_path(F.col("path")))).alias("id")).agg(F.max_by(F.struct("path", "content", "modified"), "modified").alias("x"))
    return last.select("x.*").where("content IS NOT NULL")
