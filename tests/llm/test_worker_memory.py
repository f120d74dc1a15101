"""A Python worker that goes from one operator to the next keeps nothing of the one before."""

import pyarrow as pa

from joinwright.llm import near_dedup, piece_lattice, runs, suffix_dedup
from joinwright.llm.storage import release
from joinwright.llm.vocabulary import model_path, processor

TEXT = "One plain text, of a few words. " * 4


class Taken:
    """Stands for a frame: gives the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_other_operators_free_the_vocabulary(spark):
    texts = pa.array([TEXT, None, ""])
    ids, prints = pa.array([1, 2, 3]), pa.array([4, 5, 6])
    two = pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])
    three = pa.RecordBatch.from_arrays([ids, prints, texts], names=["doc_id", "print", "text"])
    signer = near_dedup.Signer(near_dedup.bands_for(0.8))
    path = model_path()
    encode = piece_lattice.encode(Taken())
    others = [(near_dedup._signatures(Taken(), 5, True, signer), two), (near_dedup._sets(Taken(), 5, True), two), (suffix_dedup._retained(Taken(), 50), three)]
    for run, batch in others:
        first = list(encode(iter([two])))
        assert piece_lattice.encoder.cache_info().currsize == 1
        coder = piece_lattice.encoder(path)
        # its own tasks keep it, and give the same again
        assert list(encode(iter([two]))) == first and piece_lattice.encoder(path) is coder
        # what only loads the vocabulary is not kept beside it
        assert processor.cache_info().currsize == 0
        list(run(iter([batch])))
        assert piece_lattice.encoder.cache_info().currsize == 0


def test_runs_cut_by_characters_hold_only_their_own_texts(spark, monkeypatch):
    monkeypatch.setattr(piece_lattice, "BATCH_CHARS", 40)
    texts = pa.array(["é" * 30, None, "", "a b c " * 5, TEXT, "x"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), texts], names=["doc_id", "text"])
    seen = []
    whole = piece_lattice.Encoder.encode
    monkeypatch.setattr(piece_lattice.Encoder, "encode", lambda self, some: seen.append(list(some)) or whole(self, some))
    found = pa.Table.from_batches(piece_lattice.encode(Taken())(iter([batch])))
    assert seen == [texts.to_pylist()[a:b] for a, b in ((0, 3), (3, 4), (4, 5), (5, 6))]
    assert found.column("doc_id").to_pylist() == list(range(6)) and all(found.column("round_trip").to_pylist())


def test_edges_of_sorted_tables_start_no_other_python(spark):
    for keys in ([5, 3, 5, 3, 9], []):
        columns = {c: pa.array([0] * len(keys), pa.int64()) for c in runs.COLUMNS}
        found, table = runs.sorted_runs(spark.createDataFrame(pa.table(columns | {"k0": pa.array(keys, pa.int64()), "o0": pa.array(range(len(keys)), pa.int64())})))
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()
        rows = sorted((r.k0, r.o0, r.copy) for r in found.collect() if keys.count(r.k0) > 1)
        assert rows == ([(3, 1, False), (3, 3, True), (5, 0, False), (5, 2, True)] if keys else [])
        release(table)


def test_memory_goes_when_a_task_ends(monkeypatch):
    from joinwright.llm import worker

    calls = []
    monkeypatch.setattr(worker, "trim", lambda: calls.append(1))
    assert list(worker.tidy(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and calls == [1]
