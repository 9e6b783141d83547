"""Row-local work on a stream of files.

Classification, line counts and the rule part of the selection look at one row at
a time, so the batch expressions serve a streaming frame unchanged. Ignore files,
nested repositories, totals and listings need the other rows of the corpus and
stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.classify import file_type, language_hint
from arborlake.functions.lines import lines_of_code
from arborlake.operators.inventory import is_text_column, walkable
from arborlake.operators.selection import SelectionRules, with_decision
from arborlake.sources.entries import with_size


def classify_stream(files: DataFrame, rules: SelectionRules, loc: str = "fast") -> DataFrame:
    """Decision, type, language and line count of each arriving file."""
    path = F.col("path")
    lines = lines_of_code(
        path, F.col("content"), F.col("size_bytes"), mode=loc, is_text=is_text_column(files)
    )
    return (
        with_decision(with_size(walkable(files)), rules)
        .withColumns({"file_type": file_type(path), "language": language_hint(path), "loc": lines})
        .drop("content")
    )
