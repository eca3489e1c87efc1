"""Fixed-shape reads. Each returns a plan over the eleven fields; arguments that name a subject or an object follow merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import covers, is_current
from ..functions.values import FIELDS, Value, literal
from ..plans.compile import Tables, shown
from ..plans.status import statuses
from ..schema import ACTIVE, HYPOTHESIS, EngineError


def rows(tables: Tables, where: Column | None = None) -> DataFrame:
    return statuses(tables, rows=where)


def _subject(tables: Tables, subject: int) -> Column:
    return F.col("subject") == F.lit(tables.resolve(subject))


def _limited(df: DataFrame, limit: int) -> DataFrame:
    if limit < 0:
        raise EngineError("limit can't be negative")
    return df.limit(limit) if limit else df


def get(tables: Tables, id: int) -> DataFrame:
    return shown(rows(tables, F.col("id") == F.lit(id)))


def assertions_for_subject(tables: Tables, subject: int, limit: int = 0) -> DataFrame:
    return shown(_limited(rows(tables, _subject(tables, subject)).orderBy("id"), limit))


def current(tables: Tables, subject: int) -> DataFrame:
    return shown(rows(tables, _subject(tables, subject) & (F.col("valid_to") == 0)).where(is_current()))


def current_by_name(tables: Tables, name: str) -> DataFrame:
    found = find_value(tables, Value("text", name)).collect()
    return current(tables, found[0]["id"]) if found else shown(rows(tables, F.lit(False)))


def current_by_object(tables: Tables, object: int) -> DataFrame:
    return shown(rows(tables, (F.col("object") == F.lit(tables.resolve(object))) & (F.col("valid_to") == 0)).where(is_current()))


def current_by_predicate(tables: Tables, predicate: int) -> DataFrame:
    return shown(rows(tables, (F.col("predicate") == F.lit(predicate)) & (F.col("valid_to") == 0)).where(is_current()))


def hypotheses_for(tables: Tables, subject: int) -> DataFrame:
    return shown(rows(tables, _subject(tables, subject)).where(F.col("status_code") == HYPOTHESIS))


def _active(tables: Tables, where: Column) -> DataFrame:
    return rows(tables, where).where(F.col("status_code") == ACTIVE)


def valid_at(tables: Tables, subject: int, t: int) -> DataFrame:
    return shown(_active(tables, _subject(tables, subject) & covers(F.col("valid_from"), F.col("valid_to"), t)))


def known_at(tables: Tables, subject: int, t: int) -> DataFrame:
    """Observed by t and still active now."""
    return shown(_active(tables, _subject(tables, subject) & (F.col("observed_at") <= F.lit(t))))


def valid_at_known_at(tables: Tables, subject: int, valid: int, observed: int) -> DataFrame:
    return shown(_active(tables, _subject(tables, subject) & covers(F.col("valid_from"), F.col("valid_to"), valid) & (F.col("observed_at") <= F.lit(observed))))


def valid_time_timeline(tables: Tables, subject: int, predicate: int) -> DataFrame:
    return shown(_active(tables, _subject(tables, subject) & (F.col("predicate") == F.lit(predicate))).orderBy("valid_from", "id"))


def observed_time_timeline(tables: Tables, subject: int, predicate: int) -> DataFrame:
    return shown(_active(tables, _subject(tables, subject) & (F.col("predicate") == F.lit(predicate))).orderBy("observed_at", "id"))


def commit_history(tables: Tables, subject: int, predicate: int, limit: int = 0) -> DataFrame:
    return shown(_limited(rows(tables, _subject(tables, subject) & (F.col("predicate") == F.lit(predicate))).orderBy("id"), limit))


def changes_since(tables: Tables, t: int, limit: int = 0, newest_first: bool = False) -> DataFrame:
    """Observed at t or later, any status, by (observed_at, id); the whole order turns with newest_first."""
    keys = [F.col(c).desc() if newest_first else F.col(c).asc() for c in ("observed_at", "id")]
    return shown(_limited(rows(tables, F.col("observed_at") >= F.lit(t)).orderBy(*keys), limit))


def find_value(tables: Tables, value: Value) -> DataFrame:
    """id of an interned value; NaN equals nothing."""
    if value.is_nan:
        return tables.entities.where(F.lit(False)).select("id")
    field = F.col("value")[FIELDS[value.code]]
    return tables.entities.where((F.col("value")["kind"] == F.lit(value.code)) & (field == literal(value))).select("id")


def find_predicate(tables: Tables, name: str) -> DataFrame:
    return tables.predicates.where(F.col("name") == F.lit(name)).select("id")


def entity_value(tables: Tables, id: int) -> DataFrame:
    return tables.entities.where(F.col("id") == F.lit(id)).select("value")


def predicate_name(tables: Tables, id: int) -> DataFrame:
    return tables.predicates.where(F.col("id") == F.lit(id)).select("name")


def document_content(tables: Tables, id: int) -> DataFrame:
    return tables.payloads.where(F.col("id") == F.lit(id)).select("content")


def last_provenance(tables: Tables) -> DataFrame:
    """One row an assertion: the record written last."""
    last = F.max_by(F.struct("source", "recorded_at", "method"), "seq").alias("p")
    return tables.provenance.groupBy("assertion_id").agg(last).select("assertion_id", "p.source", "p.recorded_at", "p.method")


def answers(ids: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row per id asked for, in the order asked (pos), repeated ids each time, nulls where nothing is found.

    ids: pos, id. found: key and what is known of it.
    """
    return ids.join(found.withColumnRenamed(key, "__key"), F.col("id") == F.col("__key"), "left").drop("__key").orderBy("pos")


def entity_names(tables: Tables) -> DataFrame:
    return tables.entities.where(F.col("value")["kind"] == 0).select(F.col("id").alias("entity"), F.col("value")["text"].alias("name"))
