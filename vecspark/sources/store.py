"""Rows of a collection as versioned Parquet folders, switched by a pointer file."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import lookup_in_order
from .files import Files

SCHEMA = "row_id long, doc_id string, vector array<float>, text_content string, metadata string, created_at double, updated_at double"


class RowStore:
    """One table of rows. The pointer names the folders that make it up; a reader sees all of a commit or none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def _parts(self, pointer: str = "current") -> list[str]:
        return json.loads(self.files.read(pointer)) if self.files.exists(pointer) else []

    def _commit(self, parts: list[str], pointer: str = "current") -> None:
        self.files.write(pointer, json.dumps(parts).encode())

    def _write(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> str:
        name = f"data-{uuid.uuid4().hex}" + (f"-{batch[0]}-{batch[1]}" if batch else "")
        rows.write.parquet(self.files.at(name))
        return name

    def rows(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[self.files.at(p) for p in parts])

    def vectors(self) -> DataFrame:
        """(id, vec) of all rows; only these columns are read."""
        return self.rows().select(F.col("row_id").alias("id"), F.col("vector").alias("vec"))

    def scalars(self) -> DataFrame:
        return self.rows().select("row_id", "doc_id", "text_content", "metadata")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of (pos, row_id), in that order; nulls where there is none."""
        return lookup_in_order(self.scalars(), wanted)

    def count(self) -> int:
        return self.rows().count()

    def next_id(self) -> int:
        return self.rows().agg(F.coalesce(F.max("row_id"), F.lit(-1)) + 1).first()[0]

    def holds(self, batch: tuple[str, int]) -> bool:
        """Whether the rows of that batch of a stream were committed."""
        return any(p.endswith(f"-{batch[0]}-{batch[1]}") for p in self._parts())

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds rows, all or none: a repeated row_id or doc_id, within the batch or with the table, is a ValueError.

        batch: (name of a stream, number); it is committed with the rows, in the folder's name.
        """
        now = time.time()
        kinds = dict(rows.dtypes)
        time_of = lambda c: F.col(c) if c in kinds else F.lit(now)
        rows = rows.withColumns({"created_at": time_of("created_at"), "updated_at": time_of("updated_at")})
        name = self._write(rows.select(*[F.col(f.split()[0]).cast(f.split(" ", 1)[1]) for f in SCHEMA.split(", ")]), batch)
        new = self.spark.read.schema(SCHEMA).parquet(self.files.at(name))
        if self._repeats(new):
            self.files.delete(name)
            raise ValueError("duplicate row_id or doc_id")
        self._commit([*self._parts(), name])
        return new.count()

    def _repeats(self, new: DataFrame) -> bool:
        for key in ("row_id", "doc_id"):
            if new.groupBy(key).count().where("count > 1").limit(1).count() or new.join(self.rows().select(key), key, "left_semi").limit(1).count():
                return True
        return False

    def replace(self, rows: DataFrame) -> None:
        """Drops all rows and takes these, timestamps kept."""
        self.stage(rows)
        self.switch()

    def stage(self, rows: DataFrame) -> None:
        self._commit([self._write(rows.select(*[f.split()[0] for f in SCHEMA.split(", ")]))], "staged")

    def has_staging(self) -> bool:
        return self.files.exists("staged")

    def switch(self) -> None:
        """Makes the staged rows the table."""
        old, new = self._parts(), self._parts("staged")
        self._commit(new)
        self.files.delete("staged")
        for p in old:
            if p not in new:
                self.files.delete(p)

    def rollback(self) -> None:
        for p in self._parts("staged"):
            self.files.delete(p)
        self.files.delete("staged")

    def purge(self) -> None:
        parts = self._parts()
        self._commit([])
        for p in parts:
            self.files.delete(p)

    def export_json(self, path: str) -> None:
        """All rows as JSON lines, in order of row_id."""
        self.rows().orderBy("row_id").write.json(path)
