"""Python folds over the arrays of a row, in Arrow batches; rows stay where they are."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def added_in_rows(rows: DataFrame, fields: str, given: list[str], fold, drop: tuple = ()) -> DataFrame:
    """``rows`` without the columns ``drop`` and with the columns ``fields`` (DDL) that ``fold`` returns for the arrays ``given``.

    Null arrays are given as empty lists.
    """
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in drop], *added.fields])

    def add(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        types = to_arrow_schema(schema)
        for batch in batches:
            made = [fold(*[x or [] for x in arrays]) for arrays in zip(*[batch.column(c).to_pylist() for c in given])]
            columns = [batch.column(f.name).cast(f.type) for f in list(types)[:-len(added)]]
            columns += [pa.array([m[i] for m in made], types.field(f.name).type) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    return rows.mapInArrow(add, schema)
