"""Lines near a catalog: the ones that hold a word without which none of its patterns can match.

A scan asks for these words before anything else, on every line and once for each catalog. In the
row that is one search for each word. Here the words of a language are one automaton over the
batch's lines (Arrow's regular expressions), so a line is read once, however many words there are,
and all later conditions look at the lines that are left only. They repeat nothing of this: a line
that is near is still judged by the full condition.
"""

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linesieve.functions.keywords import keywords

#: Lower-cases to a letter and a mark, which no automaton folds; a line with it is near everything.
ODD_LETTER = "İ"
ANY_LANGUAGE = ""
#: Key of the words for languages that are not named.
OTHER_LANGUAGES = "*"


def words_by_language(table) -> dict:
    """Language -> the words of its patterns, None where a pattern has none; ``table`` holds (languages, patterns)."""
    patterns = {}
    for langs, own in table:
        for lang in langs.split() or [ANY_LANGUAGE]:
            patterns.setdefault(lang, []).extend(own)
    found = {}
    for lang, own in patterns.items():
        sets = [keywords(p) for p in own]
        found[lang] = None if None in sets else sorted(set().union(*sets))
    return found


def _search(lines, words):
    return pc.match_substring_regex(lines, "|".join(map(re.escape, [*words, ODD_LETTER])), ignore_case=True)


def near_lines(lines: pa.Array, ext: str | None, catalogs: dict) -> dict:
    """Catalog -> numpy flags of the lines that hold one of its words for the language ``ext``."""
    asked = {}
    for name, words in catalogs.items():
        asked[name] = words[ANY_LANGUAGE] if ANY_LANGUAGE in words else words.get(ext, words.get(OTHER_LANGUAGES, []))
    out = {name: np.full(len(lines), own is None) for name, own in asked.items()}
    searched = {name: own for name, own in asked.items() if own}
    if not searched or not len(lines):
        return out
    some = pc.indices_nonzero(_search(lines, sorted(set().union(*searched.values()))).fill_null(False))
    few = lines.take(some)
    for name, own in searched.items():
        out[name][some.to_numpy()] = _search(few, own).fill_null(False).to_numpy(zero_copy_only=False)
    return out


def with_near(files: DataFrame, catalogs: dict, ext: str | None = "ext") -> DataFrame:
    """``files`` with ``near``: for each catalog the numbers of its lines, counted from 1. Rows stay where they are.

    ``catalogs`` maps a name to what ``words_by_language`` returns; without ``ext`` all files have the same language.
    """
    field = T.StructField("near", T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in catalogs]))
    schema = T.StructType([*files.schema.fields, field])
    return files.mapInArrow(partial(_add_near, schema=schema, catalogs=catalogs, ext=ext), schema)


def _add_near(batches, schema, catalogs, ext):
    from pyspark.sql.pandas.types import to_arrow_schema
    types = to_arrow_schema(schema)
    at = {name: i for i, name in enumerate(types.names)}
    kinds = types.field("near").type
    for batch in batches:
        lists = batch.column(at["lines"])
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        flags = {name: np.zeros(int(sizes.sum()), bool) for name in catalogs}
        languages = np.array(batch.column(at[ext]).to_pylist() if ext else [None] * batch.num_rows, object)
        for lang in set(languages):
            rows = np.flatnonzero(np.array([x == lang for x in languages], bool))
            values = lists.take(pa.array(rows)).flatten()
            n = sizes[rows]
            places = np.repeat(ends[rows] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for name, own in near_lines(values, lang, catalogs).items():
                flags[name][places] = own
        line_no = np.arange(1, len(next(iter(flags.values()))) + 1) - np.repeat(ends - sizes, sizes)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        columns = []
        for i, name in enumerate(catalogs):
            own = np.flatnonzero(flags[name])
            offsets = np.append(0, np.cumsum(np.bincount(row[own], minlength=batch.num_rows)))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(line_no[own], pa.int32())).cast(kinds.field(i).type))
        near = pa.StructArray.from_arrays(columns, fields=[kinds.field(i) for i in range(len(columns))],
                                          mask=lists.is_null())
        yield pa.RecordBatch.from_arrays([*[batch.column(f.name).cast(f.type) for f in list(types)[:-1]], near], schema=types)
