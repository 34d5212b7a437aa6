"""File filters: what is scanned, and as what kind."""

from pyspark.sql import DataFrame

from linesieve.catalog import files as fixed
from linesieve.functions.text import (
    base_name, contains_any, one_of, q, settle, split_lines, starts_with_any)

NOT_SOURCE = "kind <> 'Source'"


def file_kind(path, ext) -> str:
    """Dependency and config names win over the extension."""
    name = base_name(path)
    return (f"CASE WHEN {one_of(name, fixed.DEPENDENCY_FILES)} THEN 'Dependency' "
            f"WHEN {one_of(name, fixed.CONFIG_FILES)} OR {starts_with_any(name, fixed.CONFIG_PREFIXES)} "
            f"THEN 'Config' WHEN {one_of(ext, fixed.SOURCE_EXTENSIONS)} THEN 'Source' END")


def classify(corpus: DataFrame) -> DataFrame:
    """Adds ``kind``; files of no kind drop out."""
    return corpus.selectExpr("*", f"{file_kind('path', 'ext')} AS kind").filter("kind IS NOT NULL")


def in_skipped_dir(path) -> str:
    """A listed or hidden directory on the way; the file name itself is free."""
    dirs = f"slice(split({path}, '/'), 1, size(split({path}, '/')) - 1)"
    return f"exists({dirs}, d -> {one_of('d', fixed.SKIP_DIRS)} OR startswith(d, '.'))"


def drop_skipped(corpus: DataFrame) -> DataFrame:
    return corpus.filter(f"NOT {in_skipped_dir('path')}")


def size_guard(corpus: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Source files above a limit drop out, if one is given; other kinds have none."""
    return corpus if max_bytes is None else corpus.filter(f"{NOT_SOURCE} OR size <= {max_bytes}")


def looks_binary(content) -> str:
    """A zero byte anywhere in the text."""
    return f"contains({content}, {q(chr(0))})"


def binary_guard(corpus: DataFrame) -> DataFrame:
    return corpus.filter(f"{NOT_SOURCE} OR NOT {looks_binary('content')}")


def drop_minified(corpus: DataFrame) -> DataFrame:
    return corpus.filter(f"{NOT_SOURCE} OR NOT {contains_any('lower(path)', fixed.MINIFIED_MARKS)}")


def drop_tests(corpus: DataFrame) -> DataFrame:
    return corpus.filter(f"{NOT_SOURCE} OR NOT is_test")


def lines_guard(corpus: DataFrame, max_lines: int | None = None) -> DataFrame:
    return corpus if max_lines is None else corpus.filter(f"{NOT_SOURCE} OR size({split_lines('content')}) <= {max_lines}")


def collect_files(corpus: DataFrame, include_tests: bool = False, max_bytes: int | None = None) -> DataFrame:
    """The files a scan looks at, of any size unless a limit is given. Everything
    here is a narrow filter; the ones on path and size come before the text is touched."""
    kept = size_guard(classify(drop_skipped(corpus)), max_bytes)
    if not include_tests:
        kept = drop_tests(kept)
    return binary_guard(kept)


def split_files(corpus: DataFrame) -> DataFrame:
    """Files with ``lines`` in place of their content."""
    return settle(corpus, ["repo", "path", "ext", "is_test"], {"lines": split_lines("content")})


def source_lines(files: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Source files as ``lines`` arrays, without minified ones.

    The array holds the text that its row holds anyway, which is what lets the
    per-file operators work inside the row instead of shuffling lines. A limit
    on lines leaves longer files out, if one is given.
    """
    rows = split_files(drop_minified(files).filter("kind = 'Source'"))
    return rows if max_lines is None else rows.filter(f"size(lines) <= {max_lines}")
