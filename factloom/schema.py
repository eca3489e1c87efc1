"""Schemas, codes, limits and errors of the assertion engine."""

from __future__ import annotations

from pyspark.sql import types as T

ACTIVE, SUPERSEDED, RETRACTED, RETRACTION, HYPOTHESIS = range(5)
#: Status names by code.
STATUS_NAMES = ("Active", "Superseded", "Retracted", "Retraction", "Hypothesis")
OPEN_ENDED = 0

# Limits.
MAX_RESULT_ROWS = 10_000
MAX_BATCH = 10_000
MAX_GROUPS = 10_000
MAX_GROUP_FIELDS = 4
MAX_FILTER_DEPTH = 8
MAX_SPILL_ROWS = 10_000_000
MAX_READ_ROWS = 1_000_000
MAX_OFFSET = (1 << 31) - 1
IR_VERSION = 1


_KINDS = {"TINYINT": T.ByteType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType()}


def _struct(text: str, **nested: T.StructType) -> T.StructType:
    """Schema of "name TYPE, ..."; needs no session."""
    return T.StructType([T.StructField(n, nested.get(k) or _KINDS[k]) for n, k in (f.split() for f in text.split(", "))])


VALUE_DDL = "kind TINYINT, text STRING, i64 BIGINT, f64 DOUBLE, b BOOLEAN, ts BIGINT"
LOG = _struct(
    "id BIGINT, subject BIGINT, predicate BIGINT, object BIGINT, valid_from BIGINT, valid_to BIGINT, observed_at BIGINT, "
    "confidence DOUBLE, appended_status TINYINT, supersedes_id BIGINT, retracts_id BIGINT"
)
#: A settled record: the log's fields, the code it was closed with last, and its closers by id; `crowded` ones have more than MAX_INLINE, which lie beside.
MAX_INLINE = 16
CLOSER = _struct("id BIGINT, observed_at BIGINT, as TINYINT")
SETTLED = T.StructType([*LOG.fields, T.StructField("closed_as", T.ByteType()), T.StructField("closers", T.ArrayType(CLOSER)), T.StructField("crowded", T.BooleanType())])
CROWDED = _struct("target BIGINT, as TINYINT, id BIGINT, observed_at BIGINT")
ENTITIES = _struct("id BIGINT, value VALUE", VALUE=_struct(VALUE_DDL))
PREDICATES = _struct("id BIGINT, name STRING")
PAYLOADS = _struct("id BIGINT, content BINARY")
MERGES = _struct("seq BIGINT, absorbed BIGINT, surviving BIGINT, merged_at BIGINT")
PROVENANCE = _struct("seq BIGINT, assertion_id BIGINT, source BIGINT, recorded_at BIGINT, method STRING")
TABLES = {"log": LOG, "entities": ENTITIES, "predicates": PREDICATES, "payloads": PAYLOADS, "merges": MERGES, "provenance": PROVENANCE}

#: What a read returns, in this order; status is a name.
ASSERTION = ["id", "subject", "predicate", "object", "valid_from", "valid_to", "observed_at", "confidence", "status", "supersedes_id", "retracts_id"]


class EngineError(RuntimeError):
    """A request that can't be answered as it stands."""


class BudgetExceeded(EngineError):
    def __init__(self, budget: str, limit: int, reached: int):
        super().__init__(f"{budget}: {reached} is more than {limit}")
        self.budget, self.limit, self.reached = budget, limit, reached
