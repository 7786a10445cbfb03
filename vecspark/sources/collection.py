"""Named collections: schema, insert, flush, filtered search, versions, bundles and purge."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import parse_metric
from ..operators.codecs import LocalQuantizer, ProductQuantizer
from ..operators.exact import knn, top_k
from ..operators.graph import GraphIndex
from ..operators.ivf import IVFIndex
from ..operators.selectors import filter_column
from . import bundle
from .artefacts import CodeIndex, FlatIndex, Index, read_index, write_index
from .files import Files
from .store import RowStore

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]{0,254}")
OVERSAMPLE = 8
#: Documented index types by lower-case name.
INDEX_TYPES = {
    "flat": "flat", "autoindex": "flat", "hnsw": "hnsw", "hnswflat": "hnsw", "hnswpq": "hnsw_pq", "hnswlvq": "hnsw_lvq", "hnsw_pq": "hnsw_pq", "hnsw_lvq": "hnsw_lvq",
    "ivf": "ivf", "ivf_flat": "ivf", "ivfflat": "ivf", "ivf_pq": "ivf_pq", "ivfpq": "ivf_pq", "ivf_lvq": "ivf_lvq", "ivflvq": "ivf_lvq", "pq": "pq", "lvq": "lvq",
}


def make_index(rows: DataFrame, dim: int, kind: str = "AUTOINDEX", metric: str = "L2", params: dict[str, Any] | None = None) -> Index:
    """An index over (id, vec) by type name and parameters nlist, nlocal, nbits, m_pq, m_hnsw, nprobe, ef."""
    p = dict(params or {})
    if bad := {"M", "m", "M_hnsw", "M_pq"} & p.keys():
        raise ValueError(f"unsupported parameters: {sorted(bad)}")
    plain = kind.replace(" ", "").lower()
    which = INDEX_TYPES.get(plain) or INDEX_TYPES.get(plain.removeprefix("index"))
    if which is None:
        raise ValueError(f"unknown index type: {kind}")
    name = metric.strip().lower()
    m = "ip" if name == "cosine" else parse_metric(metric).name
    if m not in ("l2", "ip"):
        raise ValueError(f"unsupported metric: {metric}")
    for key in ("nlist", "nlocal", "nbits", "m_pq", "m_hnsw", "nprobe", "ef_construction", "ef_search", "shards"):
        if key in p and (isinstance(p[key], bool) or not isinstance(p[key], int) or p[key] < 1):
            raise ValueError(f"{key} must be a positive integer")
    nlist, nlocal, nbits, m_pq, m_hnsw = (int(p.get(k, d)) for k, d in (("nlist", 1024), ("nlocal", 16), ("nbits", 8), ("m_pq", 8), ("m_hnsw", 32)))
    if which.endswith("pq") and dim % m_pq:
        raise ValueError("the dimension must be a multiple of m_pq")
    if which == "flat":
        return FlatIndex(rows, m)
    if which == "pq":
        return CodeIndex(ProductQuantizer.train(rows, m_pq, nbits)).add(rows)
    if which == "lvq":
        return CodeIndex(LocalQuantizer.train(rows, nlocal, nbits)).add(rows)
    if which.startswith("ivf"):
        options = {"ivf": {}, "ivf_pq": {"pq_m": m_pq, "nbits": nbits}, "ivf_lvq": {"nlocal": nlocal, "nbits": nbits}}[which]
        return IVFIndex.train(rows, nlist, m, nprobe=int(p.get("nprobe", 1)), **options).add(rows)
    quantizer = None
    if which == "hnsw_pq":
        quantizer = ProductQuantizer.train(rows, m_pq, nbits)
    elif which == "hnsw_lvq":
        quantizer = LocalQuantizer.train(rows, nlocal, nbits)
    g = GraphIndex(m_hnsw, int(p.get("ef_construction", 40)), int(p.get("ef_search", 16)), m, int(p.get("shards", 1)), quantizer).add(rows)
    return g.freeze() if quantizer is not None else g


class Collections:
    """All collections under one folder; catalog.json has a row for each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._loaded: dict[str, Index] = {}
        self._recover()

    # -- catalog ---------------------------------------------------------------------------------
    def _catalog(self) -> dict[str, dict]:
        return json.loads(self.files.read("catalog.json")) if self.files.exists("catalog.json") else {}

    def _update(self, name: str, /, **changes: Any) -> dict:
        c = self._catalog()
        c[name] = {**c.get(name, {}), **changes}
        self.files.write("catalog.json", json.dumps(c, sort_keys=True).encode())
        return c[name]

    def _meta(self, name: str) -> dict:
        c = self._catalog()
        if name not in c:
            raise KeyError(f"no such collection: {name}")
        return c[name]

    @staticmethod
    def _folder(name: str) -> str:
        """Names that differ have folders that differ, whatever the file system makes of case."""
        return "c-" + name.encode().hex()

    def _store(self, name: str) -> RowStore:
        return RowStore(self.spark, self.files.at(f"{self._folder(name)}/rows"))

    def _recover(self) -> None:
        """Finishes or undoes imports that a crash cut off."""
        for name, m in self._catalog().items():
            if m.get("data_state") == "importing":
                s = self._store(name)
                if s.has_staging():
                    s.rollback()
                self._update(name, data_state=m.get("state_before", "ready"))

    def create(self, name: str, schema: dict | None = None, index_type: str = "AUTOINDEX", metric: str = "L2", params: dict | None = None) -> dict:
        if not _NAME.fullmatch(name):
            raise ValueError(f"bad collection name: {name!r}")
        if name in self._catalog():
            raise ValueError(f"collection exists: {name}")
        return self._update(name, name=name, schema=schema or {}, index_type=index_type, metric=metric, params=params or {}, version=1, data_version=1, index_version=0, total=0, dim=None, data_state="ready", index=None, index_checksum=None)

    def drop(self, name: str) -> bool:
        c = self._catalog()
        existed = c.pop(name, None) is not None
        self._loaded.pop(name, None)
        if existed:
            self.files.write("catalog.json", json.dumps(c, sort_keys=True).encode())
            self.files.delete(self._folder(name))
        return existed

    def has(self, name: str) -> bool:
        return name in self._catalog()

    def names(self) -> list[str]:
        return sorted(self._catalog())

    def describe(self, name: str) -> dict:
        return dict(self._meta(name))

    def describe_all(self) -> list[dict]:
        return [self.describe(n) for n in self.names()]

    def version(self, name: str) -> dict:
        m = self._meta(name)
        return {k: m[k] for k in ("version", "data_version", "index_version", "index_checksum")}

    def sync_check(self, name: str, version: int, checksum: str | None = None) -> bool:
        """Whether a copy of that version (and check sum) is out of date."""
        m = self._meta(name)
        return version != m["version"] or bool(checksum and m["index_checksum"] and checksum != m["index_checksum"])

    # -- rows ------------------------------------------------------------------------------------
    def _field(self, m: dict, want: str, default: str) -> str:
        for f in m["schema"].get("fields", []):
            if want == "primary" and f.get("is_primary") or want == "vector" and f.get("datatype") == "FLOAT_VECTOR":
                return f["name"]
        return default

    def insert(self, name: str, rows: list[dict] | DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds rows; they are found once the collection is flushed. Keys without a field go to the metadata.

        batch: (name of a stream, number); a batch that is here already adds no row.
        """
        m = self._meta(name)
        id_field, vec_field = self._field(m, "primary", "id"), self._field(m, "vector", "vector")
        store = self._store(name)
        if batch and store.holds(batch):
            self._update(name, total=store.count())
            return 0
        first = store.next_id()
        if isinstance(rows, DataFrame):
            other = [c for c in rows.columns if c not in (id_field, vec_field, "contents")]
            n = rows.rdd.zipWithIndex().map(lambda r: (r[1] + first, *r[0]))
            kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
            made = self.spark.createDataFrame(n, f"row_id long, {kinds}")
            meta = F.to_json(F.struct(*other)) if other else F.lit("{}")
            ident = F.col(id_field).cast("string") if id_field in rows.columns else F.col("row_id").cast("string")
            made = made.select("row_id", F.coalesce(ident, F.col("row_id").cast("string")).alias("doc_id"), F.col(vec_field).cast("array<float>").alias("vector"), (F.col("contents").cast("string") if "contents" in rows.columns else F.lit("")).alias("text_content"), meta.alias("metadata"))
            dims = made.agg(F.min(F.coalesce(F.size("vector"), F.lit(-1))), F.max(F.size("vector"))).first()
        else:
            flat = []
            for i, r in enumerate(rows):
                v = r.get(vec_field)
                if not isinstance(v, (list, tuple)) or not v or any(isinstance(x, (list, tuple, dict, str)) for x in v):
                    raise ValueError(f"row {i} needs a one-dimensional {vec_field}")
                rest = {k: x for k, x in r.items() if k not in (id_field, vec_field, "contents")}
                flat.append((first + i, str(r.get(id_field, first + i)), [float(x) for x in v], str(r.get("contents", "")), json.dumps(rest)))
            if not flat:
                return 0
            made = self.spark.createDataFrame(flat, "row_id long, doc_id string, vector array<float>, text_content string, metadata string")
            dims = (min(len(r[2]) for r in flat), max(len(r[2]) for r in flat))
        if dims[0] != dims[1] or m["dim"] not in (None, dims[0]):
            raise ValueError(f"vectors must have {m['dim'] or dims[1]} numbers")
        if store._repeats(made):
            raise ValueError("duplicate row_id or doc_id")
        # The version moves before the rows do, so a stale index never passes for a fresh one.
        self._update(name, data_version=m["data_version"] + 1, dim=dims[0])
        n = store.append(made, batch)
        self._loaded.pop(name, None)
        self._update(name, total=store.count())
        return n

    def flush(self, name: str) -> dict:
        """Builds the index over all rows."""
        m, store = self._meta(name), self._store(name)
        vectors = store.vectors()
        if not m["dim"] or not vectors.limit(1).count():
            raise ValueError("the collection is empty")
        version = m["version"] + 1
        folder = f"{self._folder(name)}/index-{version}-{m['data_version']}"
        self.files.delete(folder)
        index = make_index(vectors, m["dim"], m["index_type"], m["metric"], m["params"])
        checksum = write_index(self.spark, index, self.files.at(folder))
        old = m["index"]
        self._loaded.pop(name, None)
        out = self._update(name, version=version, index_version=m["data_version"], index=folder, index_checksum=checksum)
        if old and old != folder:
            self.files.delete(old)
        return out

    def load(self, name: str) -> Index:
        m = self._meta(name)
        if m["data_state"] == "invalid" or not m["index"]:
            raise FileNotFoundError(f"{name} has no index; flush it first")
        if name not in self._loaded:
            self._loaded[name] = read_index(self.spark, self.files.at(m["index"]))
        return self._loaded[name]

    def close(self, name: str) -> None:
        self._loaded.pop(name, None)

    def search(self, name: str, queries: DataFrame | list[list[float]], limit: int, filter: str | None = None, output_fields: list[str] | None = None, mode: str = "pre", **params: Any) -> DataFrame:
        """(query_id, rank, id, distance, entity): the hits of each query with the asked fields of each row.

        `pre` filters before it searches (exactly); `post` filters the OVERSAMPLE * limit nearest.
        """
        if limit <= 0:
            raise ValueError("limit must be positive")
        m, index = self._meta(name), self.load(name)
        if not isinstance(queries, DataFrame):
            if any(len(q) != m["dim"] for q in queries):
                raise ValueError(f"queries must have {m['dim']} numbers")
            queries = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "id long, vec array<double>")
        scalars = self._store(name).scalars()
        larger = m["metric"].strip().lower() in ("ip", "inner_product", "cosine")
        named = {"ef": "ef_search", "ef_search": "ef_search", "nprobe": "nprobe"}
        options = {named[k]: v for k, v in params.items() if k in named}
        if isinstance(index, IVFIndex):
            options.pop("ef_search", None)
        elif isinstance(index, GraphIndex):
            options.pop("nprobe", None)
        if filter:
            ok = scalars.where(filter_column(filter, {"id": F.col("doc_id"), "contents": F.col("text_content")}, F.col("metadata"))).select(F.col("row_id").alias("id"))
            if mode == "pre":
                allowed = self._store(name).vectors().join(ok, "id", "left_semi")
                hits = knn(queries, allowed, limit, "ip" if larger else "l2")
            else:
                near = index.search(queries, OVERSAMPLE * limit, **options)
                hits = top_k(near.join(ok, "id", "left_semi").select("query_id", "id", "distance"), limit, larger)
        else:
            hits = index.search(queries, limit, **options)
        entity = F.from_json("metadata", "map<string,string>")
        own = F.create_map(F.lit("id"), F.col("doc_id"), F.lit("contents"), F.col("text_content"))
        full = F.map_concat(F.map_filter(entity, lambda k, v: ~k.isin("id", "contents")), own)
        if output_fields:
            full = F.map_filter(full, lambda k, v: k.isin(*output_fields))
        return hits.join(scalars, hits.id == scalars.row_id).select("query_id", "rank", F.col("doc_id").alias("id"), "distance", full.alias("entity"))

    # -- bundles ---------------------------------------------------------------------------------
    def export_bundle(self, name: str) -> bytes:
        m, store = self._meta(name), self._store(name)
        if m["data_state"] != "ready" or m["index_version"] != m["data_version"] or not m["index"]:
            raise ValueError("only a ready, freshly flushed collection can be exported")
        if store.count() != m["total"]:
            raise ValueError("the catalog and the rows disagree")
        rows = [json.loads(r) for r in store.rows().orderBy("row_id").toJSON().collect()]  # a bundle is one file
        data = bundle.create(name, m["version"], m["dim"], m["schema"], json.dumps({k: m[k] for k in ("index_type", "metric", "params")}).encode(), rows, {"id_field": self._field(m, "primary", "id"), "vector_field": self._field(m, "vector", "vector"), "text_field": "contents"})
        self._update(name, exported_data_version=m["data_version"], exported_index_version=m["index_version"], exported_checksum=m["index_checksum"])
        return data

    def import_bundle(self, name: str, data: bytes) -> dict:
        """Replaces the collection's rows by the bundle's and rebuilds its index."""
        from .store import SCHEMA

        manifest, index, rows = bundle.read(data)
        if manifest["collection_name"] != name:
            raise ValueError(f"the bundle is of {manifest['collection_name']}, not of {name}")
        if not self.has(name):
            self.create(name, manifest["schema"], **json.loads(index))
        m, store = self._meta(name), self._store(name)
        self._update(name, data_state="importing", state_before=m["data_state"])
        try:
            fields = [f.split()[0] for f in SCHEMA.split(", ")]
            store.stage(self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMA))
        except Exception:
            store.rollback()
            self._update(name, data_state=m["data_state"])
            raise
        store.switch()
        self._loaded.pop(name, None)
        self._update(name, data_state="ready", data_version=m["data_version"] + 1, dim=manifest["dim"], total=manifest["total"], **json.loads(index))
        return self.flush(name)

    def purge(self, name: str, force: bool = False) -> dict:
        """Deletes rows and index; the catalog row stays. Unless forced, the current state must have been exported."""
        m = self._meta(name)
        if not force and (m.get("exported_data_version"), m.get("exported_index_version"), m.get("exported_checksum")) != (m["data_version"], m["index_version"], m["index_checksum"]):
            raise ValueError("export the collection first")
        self._store(name).purge()
        self._loaded.pop(name, None)
        if m["index"]:
            self.files.delete(m["index"])
        return self._update(name, data_state="purged", data_version=m["data_version"] + 1, index_version=0, index=None, index_checksum=None, total=0, exported_data_version=None, exported_index_version=None, exported_checksum=None)

    def copy_index(self, name: str, path: str) -> dict:
        """A copy of the index folder elsewhere, and its version."""
        m = self._meta(name)
        write_index(self.spark, self.load(name), path)
        return {"version": m["version"], "checksum": m["index_checksum"]}

    def put_index(self, name: str, path: str, version: int | None = None) -> dict:
        """Takes an index built elsewhere over the same rows; an older version or other rows are refused."""
        m = self._meta(name)
        new = m["version"] + 1 if version is None else version
        if new < m["version"]:
            raise ValueError("the index is older than the collection")
        index = read_index(self.spark, path)
        if json.loads(Files(self.spark, path).read("meta.json"))["total"] != m["total"]:
            raise ValueError("the index has other rows")
        folder = f"{self._folder(name)}/index-{new}-{m['data_version']}-put"
        checksum = write_index(self.spark, index, self.files.at(folder))
        self._loaded.pop(name, None)
        return self._update(name, version=max(new, m["version"]), index_version=m["data_version"], index=folder, index_checksum=checksum)
