"""What the span finders (secrets, personal data) share: one pass that adds a column of spans to a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from panelweave.llm.common import free_name, numbered, slices

Span = tuple[str, int, int, float]
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
_SPARK = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))


def add_spans(docs: DataFrame, find: Callable[[str], list[Span]], text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs with out_col: the spans (kind, start, end exclusive, in code points; score) of the whole text, null as empty.

    If the table has a column of that name, the new one has underscores behind its name; it is the last.
    """
    name, at = free_name(docs, out_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            found = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(t or "")] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=[*batch.schema.names, name])

    return numbered(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, _SPARK)]))


def counted(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(kinds: tuple[str, ...], by_start: bool, spans: str = "spans") -> Column:
    """kind:start:end of the given kinds, comma-joined; by start and then kind as listed, or the other way round."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    ordered = F.array_sort(
        F.transform(
            kept,
            lambda s: F.struct(
                (s["start"] if by_start else place[s["kind"]]).alias("first"), (place[s["kind"]] if by_start else s["start"]).alias("second"), s["end"].alias("end"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("text")
            ),
        )
    )
    return F.array_join(F.transform(ordered, lambda s: s["text"]), ",")
