"""License scan by ordered signature rules, as DataFrame functions only.

Hundreds of rules (`license_rules`) are kept cheap by two prefilters on plain substrings:
a document without any anchor is done, and of the others a rule is tried only where its key
occurs. Rules match whole words, so a match's place is the number of words before it. Where
matches overlap, one that lies inside the interval of a match of higher priority, or of equal
priority and greater length, is suppressed; the phrases that every scan counts are reported in
any case.

Texts never leave their row. A document's matches travel as narrow rows, spread by row, and a
running maximum of ends per priority finds the suppressed ones in one sort.

NULL and empty texts have no words. Repeated rows are scanned each. Equal matches of one
interval and priority are resolved by rule order. A very long text is scanned whole; its
matches are sorted together, which its own length bounds. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm import license_rules, store
from candlewick.llm.license_rules import BASE, Rule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(words: str) -> str:
    """A rule's words as they stand in `flat`: every word has a space of its own on both sides."""
    return words.replace(" ", "  ")


def compiled(rule: Rule) -> str:
    return f" (?:{spaced(rule.pattern)}) "


def flat(text: Column) -> Column:
    """All words of a text, each between two spaces of its own; no words: the empty string."""
    lower = F.translate(text, UPPER, LOWER)
    words = F.trim(F.regexp_replace(lower, NO_WORD, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_words(part: Column) -> Column:
    spaces = F.octet_length(part) - F.octet_length(F.replace(part, F.lit(" "), F.lit("")))
    return (spaces / 2).cast("int")


def scan(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row, doc_id, n_words, found): for each rule that matches the words between its matches and in them."""
    table = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.lit(spaced(r.key)).alias("key"), F.lit(compiled(r)).alias("pattern"))
            for i, r in enumerate(rules)
        ]
    )
    gate = F.lit(False)
    for anchor in license_rules.ANCHORS:
        gate |= F.contains("flat", F.lit(anchor))

    def apply(rule: Column) -> Column:
        marks = F.regexp_extract_all("flat", rule["pattern"], F.lit(0))
        gaps = F.split(F.col("flat"), rule["pattern"])
        return F.struct(
            rule["rule"].alias("rule"),
            F.transform(gaps, count_words).alias("gaps"),
            F.transform(marks, count_words).alias("marks"),
        )

    tried = F.filter(table, lambda r: F.contains("flat", r["key"]) & F.rlike("flat", r["pattern"]))
    return (
        store.documents(docs)
        .select("doc_id", flat(F.col("text")).alias("flat"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            count_words(F.col("flat")).cast("long").alias("n_words"),
            F.when(gate, F.transform(tried, apply)).alias("found"),
        )
    )


def detections(scanned: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every match as (row, doc_id, rule, label, form, start, end, confidence, suppressed), in words."""
    spark = scanned.sparkSession
    names = spark.createDataFrame(
        [(i, r.label, r.form.name, r.form.priority, r.form.confidence) for i, r in enumerate(rules)],
        "rule int, label string, form string, priority int, confidence double",
    )
    by_rule = Window.partitionBy("row", "rule").orderBy("at")
    upto = F.sum("gap").over(by_rule) + F.sum("size").over(by_rule) - F.col("size")
    places = (
        scanned.filter(F.size("found") > 0)
        .select("row", "doc_id", F.explode("found").alias("f"))
        .select("row", "doc_id", "f.rule", F.posexplode(F.arrays_zip("f.gaps", "f.marks")).alias("at", "m"))
        .filter("m.marks IS NOT NULL")
        .select("row", "doc_id", "rule", "at", F.col("m.gaps").alias("gap"), F.col("m.marks").alias("size"))
        .repartition("row")
        .withColumn("start", upto)
        .select("row", "doc_id", "rule", F.col("start").cast("long"), (F.col("start") + F.col("size")).cast("long").alias("end"))
        # One row per rule.
        .join(F.broadcast(names), "rule")
    )
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(
        Window.unboundedPreceding, -1
    )
    levels = sorted({r.form.priority for r in rules})
    reach = F.coalesce(
        *[
            F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(earlier))
            for p in levels
        ]
    )
    return places.withColumn("suppressed", F.coalesce(reach >= F.col("end"), F.lit(False))).drop("priority")


def report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per document its words, the places of the base phrases, labels and the best surviving confidence."""
    rules = license_rules.rules() if rules is None else rules
    scanned = store.keep(scan(docs, rules), "license-scan")
    base, label = F.col("form") == BASE.name, F.col("label")
    found = (
        detections(scanned, rules)
        .groupBy("row")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            # No more labels than there are rules.
            F.collect_set(F.when(base, label)).alias("base_labels"),
            F.collect_set(F.when(base | ~F.col("suppressed"), label)).alias("labels"),
            F.max(F.when(~F.col("suppressed"), F.col("confidence"))).alias("score"),
        )
    )

    def joined(column: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(column), ","), F.lit("")).alias(column)

    return scanned.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        joined("base_labels"), joined("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
