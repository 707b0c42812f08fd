"""What workers hold: the filter of op7 is no copy of theirs, and memory of a batch goes back."""

import numpy as np
import pyarrow as pa

from graphloom.llm import bloomlm, common


def test_the_filter_is_a_file_that_workers_read_in_place(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i * 40 + k}" for k in range(400))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = bloomlm.train(docs)
    sent = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, x: sent.extend(x) or send(sc, x))
    by_file = {r.doc_id: r.score for r in bloomlm.score(docs, model, counts).collect()}
    assert sent and not any(isinstance(x, bloomlm.LogBloom) for x in sent)  # only the commonest words' counts are copied
    bloom = bloomlm.opened(*model.whole())
    assert bloom.bits.nbytes >= model.bytes and not bloom.bits.flags.owndata and not bloom.bits.flags.writeable
    monkeypatch.setattr(bloomlm, "BROADCAST", 0)
    assert {r.doc_id: r.score for r in bloomlm.score(docs, model, counts).collect()} == by_file


def test_memory_goes_back_after_each_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "spare", lambda: told.append("spare"))

    def run(batches):
        for batch in batches:
            told.append(batch.num_rows)
            yield batch

    given = [pa.RecordBatch.from_arrays([pa.array(np.arange(n))], ["x"]) for n in (3, 2)]
    assert [b.num_rows for b in common.lean(run)(iter(given))] == [3, 2]
    assert told == [3, "spare", 2, "spare", "spare"]
