"""Tokens, lexicon sentiment, n-grams and TF-IDF in long form.

Nothing here builds a column per term: matrices are (doc, term, value) rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.columns import sentiment_label
from candlewick.operators.tables import ranked
from candlewick.session import settle

ALPHA = r"(\p{L}+)"
WORD = r"([\p{L}\p{N}_]{2,})"

# The constants of the published rule set (Hutto and Gilbert 2014).
COMPOUND_ALPHA = 15.0
NEGATION_SCALE = -0.74
BOOST_STEP = 0.293
BOOST_FADE = (1.0, 0.95, 0.9)


def words(text: Column, pattern: str = ALPHA) -> Column:
    """Lower-cased tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 1)


def tokens(
    df: DataFrame, text: str = "text", doc: str = "doc_id", pattern: str = ALPHA
) -> DataFrame:
    """One row per token: (doc, pos, token). The whole text is tokenised.

    The outer form keeps Catalyst from copying the tokeniser into a scan filter
    ("array is not empty"), which would run it several times per text.
    """
    rows = df.filter(F.col(text).isNotNull()).select(
        doc, F.posexplode_outer(words(F.col(text), pattern)).alias("pos", "token")
    )
    return rows.filter(F.col("token").isNotNull())


def drop_stop_words(tok: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """Remove a fixed word list; the list is a constant of the query."""
    return tok.filter(~F.col("token").isin(list(stop_words)))


def lemmatize(tok: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Map tokens through a (token, lemma) table; unknown tokens stay."""
    return (
        tok.join(lemmas, "token", "left")
        .withColumn("token", F.coalesce("lemma", "token"))
        .drop("lemma")
    )


def rejoin(tok: DataFrame, doc: str = "doc_id", name: str = "content") -> DataFrame:
    """Tokens back to one text per document, in their original order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return tok.groupBy(doc).agg(F.array_join(ordered.getField("token"), " ").alias(name))


def clean(
    df: DataFrame,
    stop_words: Sequence[str],
    lemmas: dict[str, str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Cleaned text per document without any shuffle: arrays stay inside the row."""
    stops = list(stop_words)
    arr = F.filter(words(F.col(text)), lambda t: ~t.isin(stops))
    if lemmas:
        table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        arr = F.transform(arr, lambda t: F.coalesce(F.try_element_at(table, t), t))
    return df.filter(F.col(text).isNotNull()).withColumn("content", F.array_join(arr, " "))


BROADCAST_ROWS = 1_000_000
CONTEXT = 3  # tokens before a word that bear on it


def in_context(
    df: DataFrame, text: str = "text", doc: str = "doc_id", pattern: str = ALPHA
) -> DataFrame:
    """One row per token with the tokens before it, cut inside the text's row."""
    base = df.filter(F.col(text).isNotNull()).select(doc, words(F.col(text), pattern).alias("w"))
    near = F.transform(
        "w",
        lambda t, i: F.struct(
            t.alias("token"),
            *[F.when(i >= k, F.get("w", i - k)).alias(f"before_{k}") for k in range(1, CONTEXT + 1)],
        ),
    )
    return base.select(doc, F.explode_outer(near).alias("t")).filter("t IS NOT NULL").select(doc, "t.*")


def _adjusted(
    scored: DataFrame, doc: str, negations: Sequence[str], boosters: dict[str, float]
) -> DataFrame:
    """Valence after boosters and negations among the three tokens before."""
    if "before_1" not in scored.columns:
        w = Window.partitionBy(doc).orderBy("pos")
        scored = scored.withColumns({f"before_{k}": F.lag("token", k).over(w) for k in range(1, CONTEXT + 1)})
    v = F.col("valence")
    boost = F.lit(0.0)
    for back, fade in enumerate(BOOST_FADE, 1):
        before = F.col(f"before_{back}")
        sign = F.lit(0.0)
        for word in boosters:
            sign = F.when(before == word, boosters[word]).otherwise(sign)
        boost = boost + F.coalesce(sign, F.lit(0.0)) * BOOST_STEP * fade
    negated = F.lit(False)
    for back in range(1, CONTEXT + 1):
        negated = negated | F.coalesce(F.col(f"before_{back}").isin(list(negations)), F.lit(False))
    value = v + F.signum(v) * boost
    return scored.withColumn("_n", negated).withColumn(
        "valence", F.when(F.col("_n"), value * NEGATION_SCALE).otherwise(value)
    ).drop("_n")


def sentiment(
    tok: DataFrame,
    lexicon: DataFrame | Callable[[Column], Column],
    doc: str = "doc_id",
    negations: Sequence[str] = (),
    boosters: dict[str, float] | None = None,
) -> DataFrame:
    """Compound score, positive / negative / neutral shares and label per document.

    A lexicon is a (token, valence) table, or a function that gives a token its valence where
    it stands: then only partial sums per document are exchanged.

    Without context rules equal tokens of a document are counted before the
    table lookup, which shrinks the join's input. With them every token looks at the
    three tokens before it: rows of ``in_context`` carry those along, and only partial sums
    per document are exchanged; rows of ``tokens`` are sorted by their position first.
    """
    if callable(lexicon) or negations or boosters:
        if callable(lexicon):
            rows = tok.withColumn("valence", lexicon(F.col("token")))
        else:
            rows = tok.join(lexicon, "token", "left")
        rows = rows.withColumn("n", F.lit(1))
        if negations or boosters:
            rows = _adjusted(rows, doc, negations, boosters or {})
    else:
        rows = (
            tok.groupBy(doc, "token")
            .agg(F.count(F.lit(1)).alias("n"))
            .join(lexicon, "token", "left")
        )
    v, n = F.coalesce("valence", F.lit(0.0)), F.col("n")
    sums = rows.groupBy(doc).agg(
        F.sum(v * n).alias("s"),
        F.coalesce(F.sum(F.when(v > 0, (v + 1) * n)), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum(F.when(v < 0, (1 - v) * n)), F.lit(0.0)).alias("m"),
        F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).cast("double").alias("z"),
    )
    total = F.col("p") + F.col("m") + F.col("z")
    score = F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + COMPOUND_ALPHA), 4)
    share = lambda c: F.coalesce(F.round(F.try_divide(F.col(c), total), 3), F.lit(0.0))
    return sums.select(
        doc,
        score.alias("sentiment_score"),
        share("p").alias("positive_score"),
        share("m").alias("negative_score"),
        share("z").alias("neutral_score"),
        sentiment_label(score).alias("sentiment_label"),
    )


def _runs(n: int, w: Column | None = None) -> Column:
    """All runs of n consecutive words of an array, by default the column ``w``."""
    w = F.col("w") if w is None else w
    if n == 1:
        return w
    heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))


def ngrams(
    df: DataFrame, lo: int = 2, hi: int = 2, text: str = "text", doc: str = "doc_id"
) -> DataFrame:
    """(doc, term) for every run of lo to hi consecutive words, cut inside the row."""
    base = df.filter(F.col(text).isNotNull()).select(doc, words(F.col(text), WORD).alias("w"))
    runs = [_runs(n) for n in range(lo, hi + 1)]
    every = F.concat(*runs) if len(runs) > 1 else runs[0]
    return base.select(doc, F.explode_outer(every).alias("term")).filter(F.col("term").isNotNull())


def corpus_counts(
    df: DataFrame, lo: int = 2, hi: int = 2, text: str = "text", doc: str = "doc_id"
) -> DataFrame:
    """(term, docs, total): documents that hold a term and its occurrences.

    Texts of a document meet once; its terms then lie in one row, each once more as a mark of
    its first occurrence, so that what is exchanged after is one row per term and task.
    """
    near = df.filter(F.col(text).isNotNull()).groupBy(doc).agg(F.collect_list(text).alias("texts"))
    cut = F.transform("texts", lambda t: words(t, WORD))
    base = near.select(F.explode(F.array(cut)).alias("ws"))

    def terms(w):
        parts = [_runs(n, w) for n in range(lo, hi + 1)]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    base = base.select(F.flatten(F.transform("ws", terms)).alias("g"))
    rows = base.select(F.explode(F.array(F.struct(F.col("g").alias("every"), F.array_distinct("g").alias("once")))).alias("t"))
    every = rows.select(
        F.explode(
            F.concat(
                F.transform("t.every", lambda x: F.struct(x.alias("term"), F.lit(0).alias("first"))),
                F.transform("t.once", lambda x: F.struct(x.alias("term"), F.lit(1).alias("first"))),
            )
        ).alias("x")
    )
    return every.groupBy("x.term").agg(
        F.sum("x.first").alias("docs"), F.sum(1 - F.col("x.first")).alias("total")
    )


def term_counts(terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, term, tf): one shuffle, after its map-side half."""
    return terms.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(terms: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent terms of the corpus, ties in term order.

    Counts terms directly, so the shuffle carries one row per term and task.
    """
    return (
        terms.groupBy("term")
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), F.asc("term"))
        .limit(size)
    )


def candidates(
    df: DataFrame, hi: int, size: int, text: str = "text", doc: str = "doc_id"
) -> DataFrame:
    """(doc, term): of the runs of 1 to hi words those that can be among the ``size`` most frequent.

    A run is no more frequent than any of its words, and the ``size``-th most frequent word
    bounds the ``size``-th most frequent term from below. So words below that count, and runs
    that hold one, are out; ties stay in. Exact: ``vocabulary`` of these rows is that of all.
    """
    counts = settle(ngrams(df, 1, 1, text, doc).groupBy("term").agg(F.count(F.lit(1)).alias("total")))
    best = counts.orderBy(F.desc("total")).limit(size).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
    frequent = counts.filter(F.col("total") >= best["least"]).select("term") if best["n"] == size else None
    if frequent is None or frequent.count() > BROADCAST_ROWS:
        return ngrams(df, 1, hi, text, doc)
    base = df.filter(F.col(text).isNotNull()).select(doc, words(F.col(text), WORD).alias("w"))
    near = F.transform(
        "w", lambda t, i: F.struct(t.alias("w0"), *[F.get("w", i + k).alias(f"w{k}") for k in range(1, hi)])
    )
    rows = base.select(doc, F.explode_outer(near).alias("t")).filter("t IS NOT NULL").select(doc, "t.*")
    rows = rows.join(F.broadcast(frequent), F.col("w0") == F.col("term"), "left_semi")
    term, terms = F.col("w0"), [F.col("w0")]
    known = F.lit(True)
    for k in range(1, hi):
        mark = frequent.select(F.col("term").alias(f"f{k}"))
        rows = rows.join(F.broadcast(mark), F.col(f"w{k}") == F.col(f"f{k}"), "left")
        known = known & F.col(f"f{k}").isNotNull()
        term = F.concat(term, F.lit(" "), F.col(f"w{k}"))
        terms.append(F.when(known, term))
    return rows.select(doc, F.explode(F.array(*terms)).alias("term")).filter(F.col("term").isNotNull())


def term_index(terms: DataFrame, size: int) -> DataFrame:
    """(term, index): the ``size`` most frequent terms numbered from 0 in term order."""
    return ranked(vocabulary(terms, size), "term", "index")


def limit_vocabulary(terms: DataFrame, size: int) -> DataFrame:
    """Keep the terms of a capped vocabulary; at most ``size`` rows are broadcast.

    Catalyst moves the semi-join below later counts, so rare terms never reach
    their shuffle.
    """
    kept = vocabulary(terms, size).select("term")
    return terms.join(F.broadcast(kept) if size <= BROADCAST_ROWS else kept, "term", "left_semi")


def tfidf(tf: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """L2-normalised weights tf * (ln((1 + n) / (1 + df)) + 1).

    ``docs`` supplies n. A term's df row meets the term's tf rows in an equi-join;
    AQE splits the few very common terms. Norms are per document, hence bounded
    by the document's own vocabulary.
    """
    n = docs.select(F.count(F.lit(1)).alias("n")).scalar()
    # Reading tf keeps this branch equal to the other one up to its shuffle, which
    # Spark then runs once instead of tokenising twice.
    df = tf.groupBy("term").agg(F.sum(F.least("tf", F.lit(1))).alias("df"))
    raw = F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return (
        tf.join(df, "term")
        .withColumn("raw", raw)
        .withColumn("weight", F.col("raw") / norm)
        .select(doc, "term", "tf", "df", "weight")
    )


COMMON_TERMS = 1 << 18  # terms whose document counts travel to every task
OUT_ROWS = 1 << 16


def term_rows(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(uid, doc, texts, terms, tf): one settled row per document, its words once each with their counts.

    Texts of a document meet once and are cut there, so no row per word is exchanged. Their
    number of partitions is that of any shuffle: cutting takes long for the bytes it reads.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = df.filter(F.col(text).isNotNull()).select(doc, text).repartition(parts, doc)
    near = near.groupBy(doc).agg(F.collect_list(text).alias("texts"))
    cut = near.select(
        F.monotonically_increasing_id().alias("uid"),
        doc,
        F.size("texts").cast("long").alias("texts"),
        F.flatten(F.transform("texts", lambda t: words(t, WORD))).alias("w"),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, flat = _unfolded(batch["w"])
            coded = flat.dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, tf = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
            starts = pa.array(np.searchsorted(pairs // size, np.arange(batch.num_rows + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(starts, coded.dictionary.take(pa.array(pairs % size)))
            columns = [*batch.columns[:3], terms, pa.ListArray.from_arrays(starts, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", doc, "texts", "terms", "tf"])

    kind = df.schema[doc].dataType.simpleString()
    return settle(cut.mapInArrow(fold, f"uid long, `{doc}` {kind}, texts long, terms array<string>, tf array<long>"))


def _unfolded(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of every value of a column of lists."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten()


def text_tfidf(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``tfidf`` of the single words of whole texts, with less exchanged.

    Counts of the most common terms, ``COMMON_TERMS`` at most, travel to the tasks, which look
    them up for all words of a batch at once. The rows of all other terms take an equi-join.
    Both parts add to the norm of a document, which meets its row before that is unfolded.
    """
    docs = term_rows(df, text, doc)
    n = docs.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["terms"].flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["term", "df"])

    counted = docs.select("terms").mapInArrow(holders, "term string, df long")
    counts = settle(counted.groupBy("term").agg(F.sum("df").alias("df")))
    least, held = None, 0
    # Different counts: fewer than the root of twice the rows.
    for r in sorted(counts.groupBy("df").agg(F.count(F.lit(1)).alias("terms")).collect(), reverse=True):
        held += r["terms"]
        if held > COMMON_TERMS:
            break
        least = r["df"]
    known = F.col("df") >= least if least is not None else F.lit(False)
    table = counts.filter(known).toArrow().combine_chunks()
    columns = [table[c].chunk(0) if table.num_rows else pa.array([], t) for c, t in (("term", pa.string()), ("df", pa.int64()))]
    common = df.sparkSession.sparkContext.broadcast((columns[0], columns[1].to_numpy()))

    def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(row, term, tf, place among the common terms or -1, df, raw weight) of every word."""
        terms, dfs = common.value
        owner, flat = _unfolded(batch["terms"])
        tf = batch["tf"].flatten().to_numpy()
        at = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy()
        own = dfs[at] if len(dfs) else np.zeros(len(at), np.int64)
        return owner, flat, tf, at, own, tf * (np.log((1 + n) / (1 + own)) + 1)

    kind = df.schema[doc].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", doc, "term", "tf", "square"]
        for batch in batches:
            owner, flat, tf, at, _, raw = looked_up(batch)
            rows = batch.num_rows
            square = np.bincount(owner, np.where(at < 0, 0.0, raw * raw), rows).astype(float)
            none = [pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["uid"], batch[doc], *none, pa.array(square)], names)
            left = np.flatnonzero(at < 0)
            rest = [batch["uid"].take(pa.array(owner[left])), batch[doc].take(pa.array(owner[left]))]
            rest += [flat.take(pa.array(left)), pa.array(tf[left]), pa.nulls(len(left), pa.float64())]
            yield pa.RecordBatch.from_arrays(rest, names)

    parted = settle(
        docs.select("uid", doc, "terms", "tf").mapInArrow(part, f"uid long, `{doc}` {kind}, term string, tf long, square double")
    )
    raw = F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    rare = settle(parted.filter(F.col("term").isNotNull()).drop("square").join(counts, "term"))
    squares = parted.filter(F.col("term").isNull()).select("uid", "square").unionAll(rare.select("uid", raw * raw))
    norms = settle(squares.groupBy("uid").agg(F.sqrt(F.sum("square")).alias("norm")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, flat, tf, at, own, raw = looked_up(batch)
            weight = raw / batch["norm"].to_numpy()[owner]
            hits = np.flatnonzero(at >= 0)
            for i in range(0, len(hits), OUT_ROWS):
                hit = hits[i : i + OUT_ROWS]
                rows = [batch[doc].take(pa.array(owner[hit])), flat.take(pa.array(hit)), *(pa.array(x[hit]) for x in (tf, own, weight))]
                yield pa.RecordBatch.from_arrays(rows, [doc, "term", "tf", "df", "weight"])

    schema = f"`{doc}` {kind}, term string, tf long, df long, weight double"
    near = docs.join(norms, "uid").select(doc, "terms", "tf", "norm").mapInArrow(weigh, schema)
    far = rare.join(norms, "uid").select(doc, "term", "tf", "df", (raw / F.col("norm")).alias("weight"))
    return near.unionAll(far)


def source_counts(df: DataFrame, source: str = "source") -> DataFrame:
    return (
        df.groupBy(source)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc(source))
    )


def label_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("cnt"))
