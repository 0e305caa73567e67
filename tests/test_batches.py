import pyarrow as pa

from lodestar.batches import TEXT_BYTES, pieces
from lodestar.operators import retrieval
from lodestar.sources import evidence, html


def sizes(spark, monkeypatch, rows, f):
    """Rows that a mapInArrow function of f gives for one batch, batch by batch."""
    kept = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, work, schema: kept.append(work) or self)
    f()
    return [x.num_rows for x in kept[0](iter([rows]))]


def test_pieces_bound_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1_000_000] * 40)], names=["t"])
    out = list(pieces(iter([batch])))
    assert sum(x.num_rows for x in out) == 40 and max(x.num_rows for x in out) <= TEXT_BYTES // 1_000_000
    assert [x.num_rows for x in pieces(iter([batch.slice(0, 0)]))] == [0]


def test_pages_and_passages_are_read_in_slices(spark, monkeypatch):
    texts = ["<p>" + "a " * 500_000 + "</p>"] * 20
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(20)]), pa.array(texts)], names=["url", "html"])
    frame = spark.createDataFrame([], "url string, html string, source string, text string")
    seen = sizes(spark, monkeypatch, rows, lambda: html.visible(frame))
    assert sum(seen) == 20 and max(seen) < 10
    seen = sizes(spark, monkeypatch, rows, lambda: retrieval.passages(frame))
    assert sum(seen) == 20 and max(seen) < 10


def test_aliases_are_looked_up_once_for_a_set_of_keys(spark, monkeypatch):
    kept, looked, lookup = [], [], evidence.lookup
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, work, schema: kept.append(work) or self)
    monkeypatch.setattr(evidence, "lookup", lambda *a: looked.append(a) or lookup(*a))
    evidence.located(spark.createDataFrame([], "source_id string, source_url string, title string, text string, metadata map<string,string>, links array<string>, retrieved_at timestamp"))
    texts = [f'{{"id": "{i}", "name": "n", "title.de": "d{i}"}}' for i in range(2_500)]
    n, names = len(texts), ["source_id", "source_url", "title", "text", "metadata", "links", "retrieved_at"]
    columns = [pa.array(["s"] * n), pa.array(["u"] * n), pa.array(["t"] * n), pa.array(texts), pa.array([{}] * n, pa.map_(pa.string(), pa.string())), pa.array([[]] * n, pa.list_(pa.string())), pa.array([None] * n, pa.timestamp("us"))]
    out = list(kept[0](iter([pa.RecordBatch.from_arrays(columns, names=names)])))
    assert sum(x.num_rows for x in out) == n and max(x.num_rows for x in out) <= 1_000 and not looked
    found = dict(out[-1].column("found")[-1].as_py())
    assert (found["record_id"]["text"], found["title"]["text"], found["title"]["start"]) == ("2499", "n", 15)
    # a name that begins so is chosen by its value, record by record
    assert evidence.lookup({"title.de": " ", "title.en": "x"}, evidence.ALIASES["title"]) == ("title.en", "x")
