"""Bundles: one zip of manifest, index description and rows as JSON lines, with check sums."""

from __future__ import annotations

import hashlib
import io
import json
import time
import zipfile

FORMAT = "vecspark-bundle-1"
MEMBERS = ("manifest.json", "index.json", "scalar.jsonl")
MAX_RATIO, MAX_BYTES = 200, 8 << 30


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def check_rows(rows: list[dict], total: int, dim: int) -> None:
    """row_ids are integers covering 0..total-1 once each; vectors have dim numbers."""
    ids = [r.get("row_id") for r in rows]
    if any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
        raise ValueError("row_id must be an integer")
    if sorted(ids) != list(range(total)):
        raise ValueError("row_ids must cover 0..total-1")
    for r in rows:
        v = r.get("vector")
        if not isinstance(v, list) or len(v) != dim or any(isinstance(x, (list, dict)) for x in v):
            raise ValueError(f"vectors must have {dim} numbers")


def create(name: str, version: int, dim: int, schema: dict, index: bytes, rows: list[dict], fields: dict) -> bytes:
    """A bundle of a collection whose rows fit on one machine; larger ones stay Parquet folders."""
    check_rows(rows, len(rows), dim)
    body = "".join(json.dumps(r, sort_keys=True) + "\n" for r in rows).encode()
    manifest = {
        "format": FORMAT,
        "collection_name": name,
        "version": version,
        "dim": dim,
        "total": len(rows),
        **fields,
        "index_checksum": sha(index),
        "index_size_bytes": len(index),
        "scalar_checksum": sha(body),
        "schema": schema,
        "schema_checksum": sha(json.dumps(schema, sort_keys=True).encode()),
        "label_strategy": "row_id",
        "exported_at": time.time(),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member, data in zip(MEMBERS, (json.dumps(manifest).encode(), index, body)):
            z.writestr(member, data)
    return out.getvalue()


def read(data: bytes) -> tuple[dict, bytes, list[dict]]:
    """(manifest, index description, rows) of a bundle that passes every check."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sorted(z.namelist()) != sorted(MEMBERS):
            raise ValueError("a bundle holds exactly " + ", ".join(MEMBERS))
        total = 0
        for i in z.infolist():
            total += i.file_size
            if i.file_size > MAX_RATIO * max(i.compress_size, 1) or total > MAX_BYTES:
                raise ValueError("the bundle unpacks to too much")
        manifest, index, body = (z.read(m) for m in MEMBERS)
    m = json.loads(manifest)
    if m.get("format") != FORMAT:
        raise ValueError("unknown bundle format")
    for key, value in (("index_checksum", sha(index)), ("scalar_checksum", sha(body)), ("schema_checksum", sha(json.dumps(m.get("schema"), sort_keys=True).encode()))):
        if not m.get(key):
            raise ValueError(f"the manifest lacks {key}")
        if m[key] != value:
            raise ValueError(f"{key} does not match")
    rows = [json.loads(line) for line in body.decode().splitlines()]
    check_rows(rows, m["total"], m["dim"])
    return m, index, rows
