"""Spills: a query's whole ordered selection written as columns, with a descriptor and a dictionary of the names and values that it mentions."""

from __future__ import annotations

import json
import os
import shutil
import zlib
from itertools import batched
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value
from ..plans.compile import Tables, after, check_budget, ordering, select_rows, shown
from ..plans.ir import Query
from ..schema import ASSERTION, MAX_SPILL_ROWS, BudgetExceeded, EngineError

FORMAT, VERSION = "factloom-spill", 1
#: Column types and bytes a value.
TYPES = {"confidence": ("f64", 8), "status": ("u8", 1)} | {c: ("u64", 8) for c in ("id", "subject", "predicate", "object", "supersedes_id", "retracts_id")} | {c: ("i64", 8) for c in ("valid_from", "valid_to", "observed_at")}
_NUMPY = {"u64": "<u8", "i64": "<i8", "f64": "<f8", "u8": "u1"}


def _checked(token: str) -> str:
    if token in ("", ".", "..") or "/" in token or "\0" in token:
        raise EngineError(f"'{token}' can't name a spill")
    return token


def selection(query: Query, tables: Tables) -> DataFrame:
    """All rows of a query in order, status as a code; limit 0 means all of them."""
    query.validate()
    rows = select_rows(query, tables)
    cursor = query.decoded_cursor()
    if cursor is not None:
        rows = rows.where(after(cursor))
    rows = rows.orderBy(*ordering(query))
    if query.offset:
        rows = rows.offset(query.offset)
    if query.limit:
        rows = rows.limit(min(query.limit, MAX_SPILL_ROWS + 1))
    return rows.withColumnRenamed("status_code", "status").select(*ASSERTION)


def spill(query: Query, tables: Tables, directory: str | Path, token: str = "", columns: str = "parquet") -> dict:
    """Writes the selection below directory/token and returns the descriptor, which is also there as descriptor.json.

    columns: "parquet" (a data set that Spark writes, in order) or "raw" (a file of fixed-width little-endian values a column).
    More rows than a spill may hold are an error, never a part. An empty token takes the first free result-N.
    """
    directory = Path(directory)
    if not token:
        n = 1
        while (directory / f"result-{n}").exists():
            n += 1
        token = f"result-{n}"
    target = directory / _checked(token)
    if target.exists():
        raise EngineError(f"there is a spill '{token}' already")
    check_budget(query, tables)
    rows = selection(query, tables)
    n = rows.limit(MAX_SPILL_ROWS + 1).count()
    if n > MAX_SPILL_ROWS:
        raise BudgetExceeded("max_spill_rows", MAX_SPILL_ROWS, n)
    aside = directory / f".{token}.part"
    shutil.rmtree(aside, ignore_errors=True)
    aside.mkdir(parents=True)
    data = f"file://{aside.resolve()}/rows.parquet"
    rows.write.parquet(data)
    spark = tables.log.sparkSession
    kept = spark.read.schema(rows.schema).parquet(data)
    listed = [{"name": c, "file": "rows.parquet" if columns == "parquet" else f"{c}.col", "type": TYPES[c][0], "bytes_per_value": TYPES[c][1]} for c in ASSERTION]
    if columns == "raw":
        files, sums = {c: (aside / f"{c}.col").open("wb") for c in ASSERTION}, dict.fromkeys(ASSERTION, 0)
        for some in batched(kept.orderBy(*ordering(query)).toLocalIterator(prefetchPartitions=True), 10_000):
            for c in ASSERTION:
                data = np.array([row[c] for row in some], _NUMPY[TYPES[c][0]]).tobytes()
                files[c].write(data)
                sums[c] = zlib.crc32(data, sums[c])
        for file in files.values():
            file.close()
        for column in listed:
            column["crc32"] = sums[column["name"]]
    _dictionary(kept, tables, aside / "dictionary.json")
    if columns == "raw":
        shutil.rmtree(aside / "rows.parquet")
    descriptor = {"format": FORMAT, "version": VERSION, "token": token, "rows": n, "byte_order": "little", "columns": listed, "dictionary": "dictionary.json"}
    (aside / "descriptor.json").write_text(json.dumps(descriptor))
    os.replace(aside, target)
    return {"token": token, "directory": str(target), "rows": n, "columns": listed, "dictionary": "dictionary.json"}


def _dictionary(rows: DataFrame, tables: Tables, path: Path) -> None:
    """Values and names of the identifiers in rows, streamed to the file partition by partition."""
    ids = rows.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    entities = tables.entities.join(ids, "id", "left_semi").orderBy("id")
    predicates = tables.predicates.join(rows.select(F.col("predicate").alias("id")).distinct(), "id", "left_semi").orderBy("id")
    with path.open("w") as out:
        out.write('{"entities": {')
        for i, row in enumerate(entities.toLocalIterator()):
            out.write(f"{', ' if i else ''}{json.dumps(str(row['id']))}: {json.dumps(Value.from_row(row['value']).to_json())}")
        out.write('}, "predicates": {')
        for i, row in enumerate(predicates.toLocalIterator()):
            out.write(f"{', ' if i else ''}{json.dumps(str(row['id']))}: {json.dumps(row['name'])}")
        out.write("}}")


def read_raw(directory: str | Path) -> dict[str, np.ndarray]:
    """Columns of a raw spill, held against their checksums."""
    directory, out = Path(directory), {}
    descriptor = json.loads((directory / "descriptor.json").read_text())
    for c in descriptor["columns"]:
        data = (directory / c["file"]).read_bytes()
        if len(data) != descriptor["rows"] * c["bytes_per_value"] or zlib.crc32(data) != c["crc32"]:
            raise EngineError(f"column {c['name']} of the spill is damaged")
        out[c["name"]] = np.frombuffer(data, _NUMPY[c["type"]])
    return out


def drop_spill(directory: str | Path, token: str) -> None:
    shutil.rmtree(Path(directory) / _checked(token), ignore_errors=True)
