"""Porter stemming of token arrays (D5) and the full preprocessing chain (D7): nothing is shuffled.

The words of a few hundred rows at a time are numbered by Arrow, and each distinct one is stemmed once; a task remembers the stems of
``KNOWN`` words. ``stemming.stems`` gives the same stems as expressions, word by word, at several times the CPU time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from mailsignal.functions import stemming
from mailsignal.functions import text as T
from mailsignal.operators.textjobs import lemmatize
from mailsignal.session import ship_package

KNOWN = 1 << 18
ROWS = 512

_known_stem = lru_cache(maxsize=KNOWN)(stemming.word_stem)


def _stemmed(tokens: pa.Array) -> pa.Array:
    """Lists of words -> lists of their stems; a null list stays, a null word becomes empty, as in ``stemming.stems``."""
    numbered = tokens.flatten().dictionary_encode()
    stems = pa.array([_known_stem(w) for w in numbered.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pc.fill_null(stems.take(numbered.indices), ""), mask=tokens.is_null())


def _stem_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            some = batch.slice(lo, ROWS)
            yield pa.RecordBatch.from_arrays([some.column(0), _stemmed(some.column(1))], names=[batch.schema.names[0], "lemmas"])


def stem_tokens(df: DataFrame, toks_col: str, id_col: str) -> DataFrame:
    """(id, lemmas): each token replaced by its Porter stem, order kept."""
    ship_package(df.sparkSession)
    rows = df.select(id_col, toks_col)
    return rows.mapInArrow(_stem_batches, StructType([rows.schema[0], StructField("lemmas", ArrayType(StringType()))]))


def preprocess_chain(df: DataFrame, text_col: str, id_col: str, use_stemming: bool = True,
                     lemmas: DataFrame | None = None) -> DataFrame:
    """Clean -> tokens -> stop words -> stem (or lemma table) -> joined with blanks."""
    toks = df.select(id_col, T.drop_stopwords(T.tokens(T.clean_text(text_col))).alias("toks"))
    out = stem_tokens(toks, "toks", id_col) if use_stemming else lemmatize(toks, "toks", lemmas, id_col)
    return out.select(id_col, F.array_join("lemmas", " ").alias("processed_text"))
