"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import (
    alignment,
    fingerprints,
    infill,
    lattice,
    license_rules,
    licenses,
    packing,
    pieces,
    quality,
    shards,
    simhash,
    store,
    suffixes,
    toxicity,
    wrappers,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(store.configure(spark), root)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; the package is present on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_fingerprints")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, root))


QUALITY_COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
)


def _quality_sql() -> str:
    """The same measures and rules for DuckDB, windows and lines unnested."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for v in quality.STOP_WORDS.values() for w in v.split()}))
    blank = " || ".join(f"chr({c})" for c in (9, 11, 12, 13))
    bounds = []
    for rule in quality.RULES:
        if rule.low is not None:
            bounds.append(f"{rule.measure} >= {rule.low}::DOUBLE")
        if rule.high is not None:
            bounds.append(f"{rule.measure} <= {rule.high}::DOUBLE")

    def share(count: str, whole: str = "n_words") -> str:
        return f"CASE WHEN {whole} > 0 THEN {count}::DOUBLE / {whole} ELSE 0 END"

    return f"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT r, doc_id, t, list_filter(string_split(translate(t, chr(10) || {blank}, '     '), ' '), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || {blank}, '') <> '') AS lines FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY 1),
m AS (
  SELECT doc_id, len(w) AS n_words, length(translate(t, ' ' || chr(10) || {blank}, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(t) - length(translate(t, '!?', '')) AS marks, len(lines) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS lettered,
    len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(…|\\.\\.\\.)$'))) AS cut
  FROM w LEFT JOIN c USING (r)),
s AS (
  SELECT *, {share("n_repeat_words")} AS repeat_share, {share("word_chars")} AS mean_word_chars,
    {share("n_symbols")} AS symbol_share, {share("marks")} AS mark_share, {share("stops")} AS stop_share,
    {share("lettered")} AS letter_share, {share("n_dup_lines", "n_lines")} AS dup_line_share,
    {share("bullets", "n_lines")} AS bullet_share, {share("cut", "n_lines")} AS ellipsis_share,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(bounds)} AS kept FROM s"""


@query("op4_quality_rules", _quality_sql())
def op4(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.judge(documents(spark, root).select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        *QUALITY_COLUMNS, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept")
    )


@query("op5_simhash")
def op5(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, root))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op6_sharding")
def op6(spark: SparkSession, root: str) -> DataFrame:
    placed = shards.shard(documents(spark, root).select("doc_id", "text"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
    )


@query("op7_packing")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(documents(spark, root), tokenizer_path("word_bpe_49k.json"))


@query("op3_lattice_scores")
def op3(spark: SparkSession, root: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return lattice.score(documents(spark, root), learn, tokenizer_path("piece_bpe_32k.model"))


@query("op9_toxicity")
def op9(spark: SparkSession, root: str) -> DataFrame:
    docs, held = documents(spark, root), toxicity.fold(F.col("doc_id"), 4) == 2
    labels = spark.read.parquet(f"{root}/labels.parquet")
    machine = toxicity.learn(docs, labels, held)
    return toxicity.score(docs, machine).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op10_sentencepiece")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return pieces.round_trip(documents(spark, root), tokenizer_path("piece_bpe_32k.model"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, root: str) -> DataFrame:
    return suffixes.removed(documents(spark, root))


@query("op8_html_text")
def op8(spark: SparkSession, root: str) -> DataFrame:
    pages = spark.read.parquet(f"{root}/pages.parquet")
    return wrappers.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def _infill_sql() -> str:
    """The same cuts for DuckDB: units are counted and joined again from the split text."""

    def upto(units: str) -> str:
        lines = f"array_to_string(p[1:{units}], chr(10)) || chr(10)"
        return f"CASE WHEN {units} = 0 THEN '' WHEN {units} = n THEN t ELSE {lines} END"

    groups = ", ".join(f"('0x' || substr(x, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(t, '{m}')" for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    return f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS p, {groups} FROM d),
n AS (SELECT *, len(p) - (CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 1 ELSE 0 END) AS n FROM l),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
c AS (
  SELECT *, length({upto("a")}) AS i, length({upto("b")}) AS j,
    CASE WHEN t = '' OR {marked} OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
      WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
      ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END AS output FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN (j - i)::BIGINT END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


@query("op11_fill_in_middle", _infill_sql())
def op11(spark: SparkSession, root: str) -> DataFrame:
    made = infill.transform(documents(spark, root))
    again = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )


@query("op13_token_alignment")
def op13(spark: SparkSession, root: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.alignments(documents(spark, root), *paths)


def _licenses_sql() -> str:
    """The same rules for DuckDB: each tried where its key occurs, intervals compared pairwise inside a text."""
    rules = license_rules.rules()
    values = ", ".join(
        f"({i}, '{r.label}', '{r.form.name}', {r.form.priority}, {r.form.confidence}, "
        f"'{licenses.spaced(r.key)}', '{licenses.compiled(r)}')"
        for i, r in enumerate(rules)
    )
    anchors = " OR ".join(f"contains(f, '{a}')" for a in license_rules.ANCHORS)

    def joined(condition: str) -> str:
        return f"coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER ({condition})), ','), '')"

    def words(part: str) -> str:
        return f"((strlen({part}) - strlen(replace({part}, ' ', ''))) // 2)"

    return rf"""WITH rules(rule, label, form, priority, confidence, key, pattern) AS (VALUES {values}),
w AS (
  SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(
    translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS t FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS f FROM w),
m AS (
  SELECT r, rule, label, form, priority, confidence, regexp_split_to_array(f, pattern) AS gaps,
    regexp_extract_all(f, pattern) AS marks
  FROM (SELECT * FROM d WHERE {anchors}) JOIN rules ON contains(f, key) AND regexp_matches(f, pattern)),
x AS (SELECT *, unnest(range(1, len(marks) + 1)) AS i FROM m),
s AS (
  SELECT r, rule, label, form, priority, confidence, {words("marks[i]")} AS size,
    list_sum(list_transform(gaps[1:i], lambda g: {words("g")}))
      + coalesce(list_sum(list_transform(marks[1:i - 1], lambda g: {words("g")})), 0) AS a FROM x),
p AS MATERIALIZED (SELECT r, rule, label, form, priority, confidence, a::BIGINT AS a, (a + size)::BIGINT AS z FROM s),
k AS (
  SELECT *, EXISTS (SELECT 1 FROM p AS o WHERE o.r = p.r AND o.a <= p.a AND o.z >= p.z AND (
    o.priority > p.priority OR o.priority = p.priority AND (o.z - o.a > p.z - p.a OR
    o.z - o.a = p.z - p.a AND o.rule < p.rule))) AS hidden FROM p),
g AS (
  SELECT r, count(*) FILTER (form = 'base') AS n_base, min(a) FILTER (form = 'base') AS first_word,
    max(a) FILTER (form = 'base') AS last_word, {joined("form = 'base'")} AS base_labels,
    {joined("form = 'base' OR NOT hidden")} AS labels, max(confidence) FILTER (NOT hidden) AS score FROM k GROUP BY r)
SELECT doc_id, {words("f")}::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)"""


@query("op12_license_scan", _licenses_sql())
def op12(spark: SparkSession, root: str) -> DataFrame:
    return licenses.report(documents(spark, root))
