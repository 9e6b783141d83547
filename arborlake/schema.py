"""The canonical tables.

``entries`` is one row per file or directory of a tree; ``corpus_id`` names the
tree and ``path`` is relative to its root. A directory row is needed only for an
empty directory, all others follow from the file paths. A manifest may name contents in
``content_uri`` instead of holding them (:mod:`arborlake.sources.contents`).
"""

from __future__ import annotations

from pyspark.sql import types as T

ENTRIES = T.StructType(
    [
        T.StructField("corpus_id", T.StringType(), True),
        T.StructField("path", T.StringType(), True),
        T.StructField("is_dir", T.BooleanType(), True),
        T.StructField("size_bytes", T.LongType(), True),
        T.StructField("content", T.BinaryType(), True),
        T.StructField("is_symlink", T.BooleanType(), True),
    ]
)

#: Rules of one ignore file. ``key`` is what an entry must have to meet the rule, NULL where
#: only the regex can tell; ``regex`` is NULL where the key tells all; ``block`` counts the
#: changes between ignoring and negated rules; ``loose`` matches where any rule without a key may.
COMPILED_RULES = T.StructType(
    [
        T.StructField("loose", T.StringType()),
        T.StructField(
            "rules",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField("regex", T.StringType()),
                        T.StructField("negated", T.BooleanType()),
                        T.StructField("dir_only", T.BooleanType()),
                        T.StructField("block", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)

LAYERS = T.StructType(
    [
        T.StructField("corpus_id", T.StringType(), False),
        T.StructField("scope", T.StringType(), False),
        T.StructField("layer", T.IntegerType(), False),
        T.StructField("rules", COMPILED_RULES),
    ]
)
