import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from vecspark.operators import codecs
from vecspark.operators.codecs import ProductQuantizer
from vecspark.sources import bundle
from vecspark.sources.artefacts import CodeIndex, FlatIndex, write_index
from vecspark.sources.collection import Collections, make_index
from vecspark.streaming.ingest import insert_stream, search_stream

FIELDS = [("key", "VARCHAR"), ("place", "FLOAT_VECTOR"), ("contents", "VARCHAR")]
SCHEMA = {"fields": [{"name": n, "datatype": t, "is_primary": n == "key"} for n, t in FIELDS]}


def tree(key, x, y, z, kind, height):
    return {"key": key, "place": [x, y, z], "contents": f"the {key} by the road", "kind": kind, "height": height, "old": height > 20}


ROWS = [tree("larch", 4, 0, 1, "conifer", 31), tree("maple", 4, 3, 1, "broadleaf", 18), tree("spruce", 4, 2, 1, "conifer", 25), tree("willow", -6, 8, 0, "broadleaf", 12)]


@pytest.fixture
def collections(spark, tmp_path):
    c = Collections(spark, f"file://{tmp_path}/c")
    c.create("docs", SCHEMA, "FLAT")
    return c


def test_search_filter_and_versions(collections):
    c = collections
    assert c.insert("docs", ROWS) == 4
    assert c.version("docs")["version"] == 1
    c.flush("docs")
    assert c.version("docs")["version"] == 2
    at = [[4, 0.5, 1]]
    for mode in ("pre", "post"):
        hits = c.search("docs", at, 3, "kind == conifer and old == 'True'", mode=mode).orderBy("rank").collect()
        assert [(h.id, round(h.distance, 6)) for h in hits] == [("larch", 0.25), ("spruce", 2.25)]
        assert hits[0].entity == {"id": "larch", "contents": "the larch by the road", "kind": "conifer", "height": "31", "old": "true"}
    assert [h.id for h in c.search("docs", at, 4).orderBy("rank").collect()] == ["larch", "spruce", "maple", "willow"]
    assert c.search("docs", at, 1, output_fields=["height"]).first().entity == {"height": "31"}
    for query, limit in ((at, 0), ([[4, 0.5]], 1)):
        with pytest.raises(ValueError):
            c.search("docs", query, limit)


def test_bad_batches_change_nothing(collections):
    c = collections
    c.insert("docs", ROWS[:2])
    before = c.describe("docs")
    for bad in ([ROWS[1]], [ROWS[3], ROWS[3]], [{"key": "elm", "place": [1, 2]}], [{"key": "elm"}]):
        with pytest.raises(ValueError):
            c.insert("docs", bad)
    assert c.describe("docs") == before


def test_catalog(collections):
    c = collections
    with pytest.raises(ValueError):
        c.create("docs")
    with pytest.raises(ValueError):
        c.create("no spaces")
    c.create("a-b")
    c.create("a_b")
    assert c.names() == ["a-b", "a_b", "docs"] and c.drop("a-b") and not c.drop("a-b")
    with pytest.raises(ValueError):
        c.flush("docs")
    with pytest.raises(KeyError):
        c.describe("nothing")


def test_bundle_purge_and_import(collections):
    c = collections
    c.insert("docs", ROWS)
    with pytest.raises(ValueError):
        c.export_bundle("docs")
    c.flush("docs")
    with pytest.raises(ValueError):
        c.purge("docs")
    data = c.export_bundle("docs")
    assert c.purge("docs")["data_state"] == "purged"
    with pytest.raises(FileNotFoundError):
        c.search("docs", [[0, 0, 0]], 1)
    c.create("others", SCHEMA, "FLAT")
    with pytest.raises(ValueError):
        c.import_bundle("others", data)
    assert c.describe("others")["total"] == 0
    c.import_bundle("docs", data)
    assert c.search("docs", [[-5, 8, 0]], 1).first().id == "willow"


def test_bundle_checks(collections):
    rows = [{"row_id": 0, "doc_id": "a", "vector": [0.0, 1.0]}, {"row_id": 1, "doc_id": "b", "vector": [2.0, 3.0]}]
    good = bundle.create("x", 1, 2, {}, b"{}", rows, {})
    assert bundle.read(good)[2] == rows

    def changed(**kw):
        out = BytesIO()
        with zipfile.ZipFile(BytesIO(good)) as z, zipfile.ZipFile(out, "w") as w:
            for n in z.namelist():
                if n in kw.get("without", ()):
                    continue
                d = z.read(n)
                if n == "manifest.json":
                    m = json.loads(d) | kw.get("manifest", {})
                    d = json.dumps({k: v for k, v in m.items() if v is not None}).encode()
                w.writestr(n, d)
            for n in kw.get("extra", ()):
                w.writestr(n, b"")
        return out.getvalue()

    for bad in ({"without": ("index.json",)}, {"extra": ("x",)}, {"manifest": {"format": "y"}}, {"manifest": {"scalar_checksum": "0"}}, {"manifest": {"index_checksum": None}}, {"manifest": {"total": 3}}):
        with pytest.raises(ValueError):
            bundle.read(changed(**bad))
    with pytest.raises(ValueError):
        bundle.create("x", 1, 2, {}, b"{}", [{"row_id": True, "vector": [0, 1]}], {})


@pytest.mark.parametrize("kind,params", [("IVF_FLAT", {"nlist": 4, "nprobe": 4}), ("HNSW", {"m_hnsw": 8}), ("IVF_PQ", {"nlist": 4, "nprobe": 4, "m_pq": 2, "nbits": 4}), ("LVQ", {"nlocal": 4, "nbits": 4})])
def test_index_types_survive_the_disk(spark, tmp_path, kind, params):
    c = Collections(spark, f"file://{tmp_path}/k")
    c.create("v", {}, kind, "L2", params)
    c.insert("v", spark.range(60).select(F.col("id").cast("string").alias("id"), F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0, F.col("id") % 3 * 1.0, F.lit(1.0)).alias("vector")))
    c.flush("v")
    assert c.search("v", [[5.0, 5.0, 2.0, 1.0]], 3).count() == 3
    with pytest.raises(ValueError):
        make_index(spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>"), 2, kind, "L2", {"M": 3})


def test_index_types_have_aliases_and_checks(spark):
    rows = spark.range(20).select("id", F.array(F.col("id") * 1.0, F.lit(0.0)).alias("vec"))
    kinds = {k: type(make_index(rows, 2, k, "L2", {"nlist": 2, "m_pq": 1, "nbits": 2})).__name__ for k in ("IVF", "IndexIVFFlat", "IndexHNSWFlat", "IndexIVFPQ", "IndexFlat", "Flat")}
    assert list(kinds.values()) == ["IVFIndex", "IVFIndex", "GraphIndex", "IVFIndex", "FlatIndex", "FlatIndex"]
    for bad in ({"m_pq": 0}, {"nlist": -1}, {"nbits": 2.5}, {"nprobe": True}, {"m_hnsw": "8"}):
        with pytest.raises(ValueError):
            make_index(rows, 2, "IVF_PQ", "L2", bad)
    with pytest.raises(ValueError):
        make_index(rows, 2, "IndexNothing")


def test_check_sums_see_the_content(spark, tmp_path):
    made = lambda x, parts: FlatIndex(spark.range(30).select("id", F.array(F.col("id") * x).alias("vec")).repartition(parts))
    sums = [write_index(spark, made(x, n), f"file://{tmp_path}/{i}") for i, (x, n) in enumerate(((1.0, 1), (1.0, 4), (2.0, 1)))]
    assert sums[0] == sums[1] != sums[2]


def test_ready_codes_are_taken(spark):
    rows = spark.range(40).select("id", F.array(F.col("id") * 1.0, F.col("id") % 5 * 1.0).alias("vec"))
    first = CodeIndex(ProductQuantizer.train(rows, 2, 4)).add(rows.where("id < 20"))
    second = CodeIndex(first.quantizer).add_codes(first.codes).add_codes(codecs.encode(rows.where("id >= 20"), first.quantizer))
    assert second.codes.count() == 40 and second.search(rows.where("id = 33"), 1).count() == 1


def test_replayed_batches_are_not_inserted_twice(spark, collections):
    c, batch = collections, ("s", 3)
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0, 5.0, 6.0],)], "place array<double>")  # no id that could repeat
    assert c.insert("docs", rows, batch) == 2
    c._update("docs", total=0)  # as if the process had died after the rows were committed
    assert c.insert("docs", rows, batch) == 0 and c.describe("docs")["total"] == 2
    assert c.insert("docs", rows, ("s", 4)) == 2 and c.insert("docs", rows, ("t", 3)) == 2


def test_streams(spark, collections, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("ash", [0.0, 0.0]), ("fir", [3.0, 3.0])], "key string, place array<double>").write.parquet(src)
    stream = spark.readStream.schema("key string, place array<double>").parquet(src)
    for _ in range(2):
        insert_stream(stream, collections, "docs", f"{tmp_path}/cp").awaitTermination(60)
    assert collections.describe("docs")["total"] == 2
    qs = f"{tmp_path}/q"
    spark.createDataFrame([(0, [2.0, 2.0])], "id long, vec array<double>").write.parquet(qs)
    got = []
    base = collections._store("docs").vectors()
    search_stream(spark.readStream.schema("id long, vec array<double>").parquet(qs), base, 1, lambda r, n: got.extend(r.collect()), f"{tmp_path}/cp2").awaitTermination(60)
    assert [r.id for r in got] == [1]
