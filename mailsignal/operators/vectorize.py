"""TF-IDF as relational jobs (F1-F5, F8, F9) and the sparse vector form for Spark ML.

Plan shape: texts never move. Cleaned texts are cut into words slice by slice with Arrow and words are numbered, so pairs of words are
whole numbers. Vocabulary: words are counted first; a bigram can only be chosen if it occurs as often as the last of ``max_features`` words, and then
it has its share of that in some slice, so these candidates are counted exactly and the rest never leave their task. Weights: one short row a
document with its terms' positions and counts. The vocabulary holds at most ``max_features`` rows: that bound is what makes broadcasting it safe.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from mailsignal import lexicon as L
from mailsignal.functions import text as T
from mailsignal.session import ensure_checkpoint_dir, ship_package

SLICE_BYTES = 16 << 20   # of cleaned text that a task holds as word numbers at a time
CANDIDATES = 1 << 17     # bigrams of a slice that may be frequent; where there could be more, every bigram is counted


def analyzer(text_col: str = "text") -> Column:
    """Text -> terms: light clean, \\w\\w+ tokens, stop words removed, unigrams and bigrams."""
    return T.drop_stopwords(T.vector_tokens(T.light_clean(text_col)), min_len=1)


def doc_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): unigrams and bigrams of each document, where it lies."""
    toks = docs.select(id_col, analyzer(text_col).alias("_toks"))
    return toks.select(id_col, T.with_bigrams("_toks").alias("terms"))


def _slices(column: pa.Array):
    """(first row, rows) of consecutive texts of at most SLICE_BYTES; a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield lo, hi - lo
        lo = hi


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Cleaned texts -> distinct words, and row and word number of every token the analyzer keeps, in order. Cleaned text is [a-z0-9] and
    blanks, where the analyzer's tokens are the pieces between blanks."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    keep = pc.and_(pc.greater_equal(pc.binary_length(words), 2), pc.invert(pc.is_in(words, pa.array(L.STOP_WORDS)))).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = keep[code]
    return words, row[some], code[some].astype(np.int64)


def _documents(row: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Rows that hold each of ``n`` numbers."""
    return np.bincount(np.unique(row * n + number) % n, minlength=n)


def _numbered_slices(batches):
    for batch in batches:
        for lo, n in _slices(batch.column(0)):
            yield _numbered(batch.column(0).slice(lo, n))


def _pairs(words: pa.Array, row: np.ndarray, code: np.ndarray):
    """Adjacent words of a row: the row of each pair, its number, and the distinct pairs."""
    near = np.flatnonzero(row[1:] == row[:-1])
    pair, number = np.unique(code[near] * len(words) + code[near + 1], return_inverse=True)
    return row[near], number, pair


def _bigrams(words: pa.Array, pair: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(words.take(pa.array(pair // max(len(words), 1))), words.take(pa.array(pair % max(len(words), 1))), " ")


_STATS = "term string, o long, d long"


def _stats_batch(term: pa.Array, o: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term, pa.array(o, pa.int64()), pa.array(d, pa.int64())], names=["term", "o", "d"])


def _word_rows(batches):
    """Cleaned texts -> (term, o, d): occurrences and documents of a slice's unigrams; under a null term its number of bigrams."""
    for words, row, code in _numbered_slices(batches):
        o = np.bincount(code, minlength=len(words))
        some = np.flatnonzero(o)
        yield _stats_batch(words.take(pa.array(some)), o[some], _documents(row, code, max(len(words), 1))[some])
        yield _stats_batch(pa.nulls(1, pa.string()), [int((row[1:] == row[:-1]).sum())], [0])


def _pair_rows(batches):
    """The same for all bigrams of a slice."""
    for words, row, code in _numbered_slices(batches):
        at, number, pair = _pairs(words, row, code)
        if len(pair):
            yield _stats_batch(_bigrams(words, pair), np.bincount(number), _documents(at, number, len(pair)))


def _frequent_pairs(least: int, every: int):
    """Bigrams that have at least a slice's share of ``least`` occurrences: one that occurs so often among ``every`` is among them in some slice."""
    def run(batches):
        for words, row, code in _numbered_slices(batches):
            at, number, pair = _pairs(words, row, code)
            if len(pair):
                yield pa.RecordBatch.from_arrays([_bigrams(words, pair[np.bincount(number) >= -(-least * len(at) // every)])], names=["term"])
    return run


def _known_rows(sent):
    """(term, o, d) of a slice's terms that are known."""
    def run(batches):
        terms, known = sent.value
        for words, row, code in _numbered_slices(batches):
            row, idx = known.found(words, row, code)
            if len(row):
                o = np.bincount(idx, minlength=len(terms))
                some = np.flatnonzero(o)
                yield _stats_batch(terms.take(pa.array(some)), o[some], _documents(row, idx, len(terms))[some])
    return run


class _Vocabulary:
    """Terms as numbers: words that occur in terms, and the terms' positions by word or by pair of words."""

    def __init__(self, terms: list[str], idx: list[int]):
        parts = [t.split(" ") for t in terms]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        self.words, self.size = pa.array(list(number), pa.string()), len(number)
        self.single = np.full(self.size, -1, np.int64)
        pairs = []
        for p, i in zip(parts, idx):
            if len(p) == 1:
                self.single[number[p[0]]] = i
            else:
                pairs.append((number[p[0]] * self.size + number[p[1]], i))
        self.pair, self.pair_idx = np.array(sorted(pairs), np.int64).reshape(-1, 2).T

    def found(self, words: pa.Array, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and position of every occurrence of a term."""
        own = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        idx = np.where(own >= 0, self.single[own], -1) if self.size else np.full(len(own), -1)
        one = np.flatnonzero(idx >= 0)
        near = np.flatnonzero((row[1:] == row[:-1]) & (own[1:] >= 0) & (own[:-1] >= 0))
        if not len(self.pair) or not len(near):
            return row[one], idx[one]
        pair = own[near] * self.size + own[near + 1]
        at = np.searchsorted(self.pair, pair).clip(0, len(self.pair) - 1)
        hit = self.pair[at] == pair
        return np.concatenate([row[one], row[near[hit]]]), np.concatenate([idx[one], self.pair_idx[at[hit]]])


def _lists(number: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive values as one list for each of ``n`` rows; number: the row of each value, ascending."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _term_counts(sent):
    """(cleaned text, other columns) -> other columns, idx and tf: the vocabulary terms of each row and their occurrences."""
    def run(batches):
        vocabulary = sent.value
        for batch in batches:
            for lo, n in _slices(batch.column(0)):
                part = batch.slice(lo, n)
                row, idx = vocabulary.found(*_numbered(part.column(0)))
                if not len(row):
                    continue
                top = int(idx.max()) + 1
                key, tf = np.unique(row * top + idx, return_counts=True)
                some, number = np.unique(key // top, return_inverse=True)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(some)) for c in part.columns[1:]] + [_lists(number, len(some), key % top, pa.int32()), _lists(number, len(some), tf, pa.int64())],
                                                 names=[*part.schema.names[1:], "idx", "tf"])
    return run


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a row's value differs from that of the row before; nulls are alike."""
    a, b = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], ~alike.to_numpy(zero_copy_only=False)])


def _weighted(sent, sublinear: bool):
    """Rows (id, other columns, idx, tf) sorted by id and the others -> one row each with the terms' normalised weights. Only the merged
    rows of one id wait for the next batch."""
    def run(batches):
        idf = sent.value
        held = None

        def merged(table: pa.Table, last: bool):
            """Finished rows, and those of the last id, which may go on."""
            table = table.combine_chunks()
            keys = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[:-2]]
            lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[-2:]]
            n = np.diff(lists[0].offsets.to_numpy())
            idx, tf = (c.flatten().to_numpy().astype(np.int64) for c in lists)
            new_id = _changes(keys[0])
            new = np.logical_or.reduce([new_id, *[_changes(c) for c in keys[1:]]])
            group = np.repeat(np.cumsum(new) - 1, n)
            if not new.all():
                key, where = np.unique(group * len(idf) + idx, return_inverse=True)
                tf = np.bincount(where, tf).astype(np.int64)
                group, idx = key // len(idf), key % len(idf)
            first = np.flatnonzero(new)
            of = np.cumsum(new_id[first]) - 1                      # id of each group
            done = len(first) if last else int(np.searchsorted(of, of[-1]))
            cut = int(np.searchsorted(group, done))
            keys = [c.take(pa.array(first)) for c in keys]
            rest = pa.Table.from_arrays([c.slice(done) for c in keys] + [_lists(group[cut:] - done, len(first) - done, idx[cut:], pa.int32()),
                                                                         _lists(group[cut:] - done, len(first) - done, tf[cut:], pa.int64())], names=table.schema.names)
            group, idx, tf = group[:cut], idx[:cut], tf[:cut]
            w = (1.0 + np.log(tf) if sublinear else tf.astype(float)) * idf[idx]
            norm = np.sqrt(np.bincount(of[group], w * w, of[-1] + 1))
            out = [c.slice(0, done) for c in keys] + [_lists(group, done, idx, pa.int32()), _lists(group, done, w / norm[of[group]], pa.float64())]
            return pa.RecordBatch.from_arrays(out, names=[*table.schema.names[:-2], "idx", "weight"]), rest

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                out, held = merged(table if held is None else pa.concat_tables([held.cast(table.schema), table]), False)
                if out.num_rows:
                    yield out
        if held is not None:
            yield merged(held, True)[0]
    return run


def fit_vocabulary(docs: DataFrame, id_col: str, text_col: str, max_features: int = L.MAX_FEATURES,
                   min_df: int = L.MIN_DF, max_df: float = L.MAX_DF) -> DataFrame:
    """terms with min_df <= df <= max_df * n_docs, then the ``max_features`` most frequent
    (total count desc, term asc); index = position in term order. Columns: term, idx, df, total, n_docs."""
    spark = docs.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    n_docs = docs.select(id_col).count()
    texts = docs.select(T.light_clean(text_col).alias("text"))
    summed = lambda rows: rows.groupBy("term").agg(F.sum("d").cast("bigint").alias("df"), F.sum("o").cast("bigint").alias("total"))
    in_band = lambda stats: stats.filter((F.col("df") >= min_df) & (F.col("df") <= math.floor(max_df * n_docs)))
    words = summed(texts.mapInArrow(_word_rows, _STATS)).checkpoint(eager=True)
    every = words.filter(F.col("term").isNull()).agg(F.sum("total")).first()[0] or 0
    words = words.filter(F.col("term").isNotNull())
    # a chosen bigram occurs at least as often as the last of max_features words
    n, last = in_band(words).orderBy(F.desc("total")).limit(max_features).agg(F.count(F.lit(1)), F.min("total")).first()
    least = max(1, min_df, last if n == max_features and last else 0)
    if every and every // least <= CANDIDATES:
        names = texts.mapInArrow(_frequent_pairs(least, every), "term string").distinct().toArrow()["term"].combine_chunks()   # <= CANDIDATES a slice
        sent = spark.sparkContext.broadcast((names, _Vocabulary(names.to_pylist(), range(len(names)))))
        pairs = texts.mapInArrow(_known_rows(sent), _STATS)
    else:
        pairs = texts.mapInArrow(_pair_rows, _STATS)
    band = in_band(words.unionByName(summed(pairs)))
    top = band.orderBy(F.desc("total"), "term").limit(max_features)   # top-k: bounded by max_features
    return (top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint"))
            .withColumn("n_docs", F.lit(n_docs).cast("bigint")))


def idf_column(df_col: str = "df", n_col: str = "n_docs") -> Column:
    """smoothed idf ln((1 + n) / (1 + df)) + 1."""
    return F.log((F.col(n_col) + 1).cast("double") / (F.col(df_col) + 1).cast("double")) + F.lit(1.0)


def _table(vocab: DataFrame) -> pa.Table:
    return vocab.select("term", "idx", idf_column().alias("idf")).toArrow()   # <= max_features rows


def weight_lists(docs: DataFrame, vocab: DataFrame | pa.Table, id_col: str, text_col: str, sublinear: bool = L.SUBLINEAR_TF, carry: tuple = ()) -> DataFrame:
    """F2-F5 in short form: (id, carried columns, idx, weight), one row an id with the positions of its vocabulary terms, ascending, and
    their weights. Rows of one id count as one document. One exchange, of a short row a text."""
    spark = docs.sparkSession
    ship_package(spark)
    table = vocab if isinstance(vocab, pa.Table) else _table(vocab)
    idx = table["idx"].to_pylist()
    idf = np.zeros(max(idx, default=0) + 1)
    idf[idx] = table["idf"].to_numpy()
    known, idf = (spark.sparkContext.broadcast(x) for x in (_Vocabulary(table["term"].to_pylist(), idx), idf))
    keys = docs.select(id_col, *carry).schema.fields
    held = lambda name, kind: StructType([*keys, StructField("idx", ArrayType(IntegerType())), StructField(name, ArrayType(kind))])
    counts = docs.select(T.light_clean(text_col).alias("_text"), id_col, *carry).mapInArrow(_term_counts(known), held("tf", LongType()))
    return counts.repartition(F.col(id_col)).sortWithinPartitions(id_col, *carry).mapInArrow(_weighted(idf, sublinear), held("weight", DoubleType()))


def tfidf(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str, sublinear: bool = L.SUBLINEAR_TF,
          digits: int | None = 9, carry: tuple = ()) -> DataFrame:
    """(id, term, idx, weight) for vocabulary terms only (unseen terms dropped),
    weight = tf' * idf, L2-normalised per document; tf' = 1 + ln(tf) when sublinear. Columns named in
    ``carry`` (functions of the id, such as its label) ride along."""
    table = _table(vocab)
    v = F.broadcast(docs.sparkSession.createDataFrame(table.select(["term", "idx"]), "term string, idx bigint"))
    lists = weight_lists(docs, table, id_col, text_col, sublinear, carry)
    out = lists.select(id_col, *carry, F.inline(F.arrays_zip(F.col("idx").cast("array<bigint>").alias("idx"), "weight"))).join(v, "idx", "inner")
    if digits is not None:
        out = out.withColumn("weight", F.round("weight", digits))
    return out.select(id_col, *carry, "term", "idx", "weight")


def chi2_scores(weights: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """F8, on weights that carry the label: chi-squared of non-negative feature sums against the class:
    observed O[c, t] = sum of w over class-c documents, expected E[c, t] = P(c) * T[t] with
    T[t] = sum_c O[c, t]. Since sum_c E = T, chi2[t] = sum_c O^2 / (P(c) T) - T, which needs
    only the observed cells (no terms x classes grid)."""
    lab = labels.select(label_col)
    everything = Window.partitionBy()
    prior = (lab.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))       # one row per class
             .withColumn("p_c", F.col("n_c") / F.sum("n_c").over(everything)).select(label_col, "p_c"))
    obs = weights.groupBy("term", label_col).agg(F.sum("weight").alias("o"))
    cells = obs.join(F.broadcast(prior), label_col, "inner")
    return cells.groupBy("term").agg(
        (F.sum(F.col("o") * F.col("o") / F.col("p_c")) / F.sum("o") - F.sum("o")).alias("chi2"))


def select_k_best(scores: DataFrame, k: int = 1000) -> DataFrame:
    """F8: the k highest chi2 terms (ties by term); a top-k report."""
    return scores.orderBy(F.desc("chi2"), "term").limit(k)


def standard_scale(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """(x - mean) / population std per column; a constant column is divided by 1.
    The statistics are one aggregate row, attached to every row (a join with a one-row side)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")]
    stats = df.agg(*aggs).withColumn("_k", F.lit(1))
    j = df.withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k", "inner")
    out = [F.col(id_col)]
    for c in cols:
        s = F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        out.append(((F.col(c) - F.col(f"_m_{c}")) / s).alias(c))
    return j.select(*out)
