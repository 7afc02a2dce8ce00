"""How often every distinct term occurs, and in how many records.

An external sort of (field, term, record, key) rows, range-partitioned on all of
them, followed by a run-length scan of each partition.  A term as hot as a third of
all rows spreads over many partitions, and so do many copies of one row: the range
also covers a running number.  What straddles a partition's edge is handed on as the
edge rows themselves (two a partition) and settled in a small final aggregation, so
counts are exact.

``key`` identifies an occurrence: a row sent again (same field, term, record and
key) counts once.  Null and empty terms are not counted.  A null record counts as no
record; a null key is a key like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "field string, term string, occurrences bigint, records bigint, edge struct<record: string, key: string>"
_EDGE = pa.struct([("record", pa.string()), ("key", pa.string())])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls equal nulls."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return np.asarray(pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False), bool)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of sorted (field, term, record, key) rows."""
    carry: pa.RecordBatch | None = None
    first: tuple | None = None
    term_open = [0, 0]  # occurrences and records of the term that is not closed, edges left out
    single_key = single_record = True  # whether the partition has shown one key, one record so far

    def rows(fields: list, terms: list, occ: list, rec: list, edges: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(terms, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64()), pa.array(edges, _EDGE)], names=["field", "term", "occurrences", "records", "edge"])

    def edge(row: dict) -> dict:
        return {"record": row["record"], "key": row["key"]}

    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is None:
            first = batch.slice(0, 1).to_pylist()[0]
            whole = batch
        else:
            whole = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        carry = whole.slice(whole.num_rows - 1)
        if whole.num_rows == 1:
            continue
        field, term, record, key = (whole.column(j) for j in range(4))
        new_term = _changes(field) | _changes(term)
        new_record = new_term | _changes(record)
        new_key = new_record | _changes(key)
        if new_key.any():
            single_key = False
        if new_record.any():
            single_record = False
        counted = new_record & np.asarray(pc.is_valid(record).to_numpy(zero_copy_only=False), bool)[1:]
        # row i+1 of the batch starts a term where new_term[i]
        cuts = np.flatnonzero(new_term)
        occ = np.add.reduceat(np.concatenate([new_key, [False]]).astype(np.int64), np.concatenate([[0], cuts]))
        rec = np.add.reduceat(np.concatenate([counted, [False]]).astype(np.int64), np.concatenate([[0], cuts]))
        if len(cuts) and cuts[0] == 0:  # the first segment is empty: a term starts at once
            occ[0] = rec[0] = 0
        occ[0] += term_open[0]
        rec[0] += term_open[1]
        term_open = [int(occ[-1]), int(rec[-1])]
        if len(cuts):
            ends = pa.array(cuts)  # the last row of each closed term
            yield pa.RecordBatch.from_arrays([field.take(ends), term.take(ends), pa.array(occ[:-1]), pa.array(rec[:-1]), pa.nulls(len(cuts), _EDGE)], names=["field", "term", "occurrences", "records", "edge"])
    if carry is None:
        return
    last = carry.to_pylist()[0]
    # the last key and record may go on in the next partition: they travel as an edge
    if not single_key:
        term_open[0] -= 1
    if not single_record and last["record"] is not None:
        term_open[1] -= 1
    edges = [first] if single_key else [first, last]
    yield rows([last["field"], *(e["field"] for e in edges)], [last["term"], *(e["term"] for e in edges)], [term_open[0]] + [0] * len(edges), [term_open[1]] + [0] * len(edges), [None, *map(edge, edges)])


#: Bytes of rows, by Spark's estimate, that one partition of the sort may hold.
PARTITION_BYTES = 256 << 20
#: An estimate beyond this is none: Spark gives it where it does not know.
_UNKNOWN_BYTES = 1 << 60


def _estimated_bytes(rows: DataFrame) -> int:
    """The optimiser's estimate of the rows' size; 0 where there is none."""
    try:
        n = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a session without a JVM of its own
        return 0
    return n if n < _UNKNOWN_BYTES else 0


def term_frequencies(rows: DataFrame, *, field: str = "field", term: str = "term", record: str = "record", keys: list[str], partitions: int | None = None) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term, compared exactly.

    ``partitions`` of the sort: by default one for each ``PARTITION_BYTES`` that Spark
    estimates the rows at, and no fewer than the session's shuffle partitions."""
    n = partitions or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_estimated_bytes(rows) // PARTITION_BYTES))
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    src = rows.where((F.col(term).isNotNull()) & (F.col(term) != "")).select(F.col(field).cast("string").alias("field"), F.col(term).alias("term"), F.col(record).cast("string").alias("record"), key.alias("key"))
    spread = src.withColumn("__n", F.pmod(F.monotonically_increasing_id(), F.lit(4 * n)).cast("int"))
    order = ["field", "term", "record", "key", "__n"]
    scanned = spread.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__n").mapInArrow(_scan, _OUT)
    total = scanned.groupBy("field", "term").agg(F.sum("occurrences").alias("o"), F.sum("records").alias("r"), F.collect_set("edge").alias("edges"))
    # at most two edges a partition in a set, however hot the term
    return total.select(
        "field",
        "term",
        (F.col("o") + F.size("edges")).alias("occurrences"),
        (F.col("r") + F.size(F.array_distinct(F.filter(F.transform("edges", lambda e: e["record"]), lambda x: x.isNotNull())))).alias("records"),
    )


def mark_terms(frequencies: DataFrame, total_records: int, *, rare_at: int = 1, common_share: float = 0.1) -> DataFrame:
    """Adds ``mark``: 'rare' with at most ``rare_at`` records, 'common' with more than
    ``common_share`` of all records, else null.  With so few records in all that a term
    is both, it is common if it is in more than one record."""
    rare = F.col("records").between(1, rare_at)
    common = F.col("records") > common_share * F.lit(total_records)
    return frequencies.withColumn("mark", F.when(rare, "rare").when(common, "common"))
