import pyarrow as pa

from tallyspark.functions import rows
from tallyspark.operators import parsers


def test_rows_leave_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(["a", None, "b"])], names=["doc", "text"])
    given = []

    def work(text):
        for k in range(50_000 if text else 0):
            given.append(k)
            yield k, text

    found = rows.pieces(batch, pa.schema([("pos", pa.int32()), ("item", pa.string())]), work)
    first = next(found)
    # the first piece leaves before the first text is done
    assert len(given) == first.num_rows < 50_000
    all_ = pa.Table.from_batches([first, *found])
    assert all_.num_rows == 100_000 and all_["doc"].to_pylist() == [7] * 50_000 + [9] * 50_000
    assert all_["pos"].to_pylist() == [*range(50_000)] * 2


def test_long_sources_give_all_rows(spark):
    source = "#[test]\nfn a() {\n}\n" * 30_000 + "x"
    df = spark.createDataFrame([(1, source), (2, None), (3, "")], "doc long, text string")
    got = parsers.test_items(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "string", "boolean"]
    assert {r.doc: (r.n, r.last) for r in got.groupBy("doc").agg({"pos": "max", "*": "count"}).toDF("doc", "last", "n").collect()} == {1: (30_001, 30_000), 3: (1, 0)}
