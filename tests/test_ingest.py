"""Chunks, embeddings and ingest runs."""

from pyspark.sql import functions as F

from graphmill.operators.ingest import chunk_functions, embed, full_ingest, incremental_ingest


def greedy(text, limit):
    out = []
    for line in text.split("\n"):
        if out and len(out[-1]) + 1 + len(line) <= limit:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def test_chunks(spark):
    long = "\n".join(f"line {i} " + "x" * (i * 7 % 90) for i in range(60)) + "\n" + "y" * 900
    rows = [("s", "a.py::f", "a.py", "def f()", long, "python"), ("s", "a.py::g", "a.py", None, "short", "python"), ("s", "a.py::h", "a.py", "def h()", None, None)]
    df = spark.createDataFrame(rows, "service string, qualified_name string, file_path string, signature string, source_snippet string, language string")
    got = {}
    for r in chunk_functions(df).orderBy("qualified_name", "chunk_index").collect():
        got.setdefault(r.function_qualified_name, []).append(r.text)
    want = greedy(long, 700)
    assert got["a.py::f"] == [want[0], *["def f()\n" + w for w in want[1:]]] and got["a.py::g"] == ["short"] and len(got) == 2


def test_embedding_falls_back_to_single_texts(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 7 else "x" * i) for i in range(250)] + [(999, None)], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in embed(df, "id", "text", model, waits=(0.0,), sleep=lambda s: None).collect()}
    assert set(got) == set(range(250)) - {7} and got[9] == [9.0]


def test_full_and_incremental_runs(spark):
    ddl = "service string, file_path string, qualified_name string, docstring string"
    old = spark.createDataFrame([("s", "a.py", "a.py::f", "d1"), ("s", "b.py", "b.py::g", "d2"), ("s", "c.py", "c.py::h", "d3"), ("s", "d.py", "d.py::i", "d4"), ("t", "a.py", "a.py::f", "t")], ddl)
    new = spark.createDataFrame([("s", "a.py", "a.py::f2", "n1"), ("s", "e.py", "e.py::k", "n2")], ddl)
    keys = ["service", "qualified_name"]
    assert sorted(r.qualified_name for r in full_ingest(old, new, keys).where("service = 's'").collect()) == ["a.py::f2", "e.py::k"]
    ch = spark.createDataFrame([("s", "a.py", "reparse", None), ("s", "b.py", "delete", None), ("s", "cc.py", "relabel", "c.py"), ("s", "e.py", "reparse", None)], "service string, file_path string, action string, previous_path string")
    got = sorted(map(tuple, incremental_ingest(old, new, ch, keys).select("service", "qualified_name", "file_path").collect()))
    assert got == [("s", "a.py::f2", "a.py"), ("s", "c.py::h", "cc.py"), ("s", "d.py::i", "d.py"), ("s", "e.py::k", "e.py"), ("t", "a.py::f", "a.py")]
    assert incremental_ingest(old, new.where(F.lit(False)), ch.where(F.lit(False)), keys).count() == 5
