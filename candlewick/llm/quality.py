"""Quality rules: a threshold table compiled into one projection of built-in functions.

A rule bounds one measure of a text; a document is kept if no rule fails. Measures are
lengths, symbol shares, stop-word share and line shares. No Python runs on the executors
and nothing is shuffled: a document is judged from its own row.

NULL text counts as empty; an empty text has no words, so every ratio is 0 and the word
count rule rejects it. Repeated rows are judged alike. Extra columns pass through `judge`
unless they have the name of an output, in which case the output replaces them. An empty table
gives no rows. A very long text is judged whole, with its windows sorted inside its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

# The most frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not this are or from at an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_words", "repeat_share", high=0.5),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("symbols", "symbol_share", high=0.1),
    Rule("shouting", "mark_share", high=0.2),
    Rule("stop_words", "stop_share", low=0.02),
    Rule("wordless", "letter_share", low=0.7),
    Rule("repeated_lines", "dup_line_share", high=0.5),
    Rule("bullet_lines", "bullet_share", high=0.9),
    Rule("cut_lines", "ellipsis_share", high=0.3),
)


def words_of(text: Column) -> Column:
    """Words between runs of space and the control characters 09 to 0D."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def repeated_positions(ranked: str, width: int) -> Column:
    """Number of words inside windows whose hash occurs twice or more.

    ``ranked`` is a column of its own, so that the sort runs once and not in every lambda.
    """

    def twin(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(ranked, k - 1)["h"] == x["h"])
        after = F.get(ranked, k + 1)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    starts = F.transform(F.filter(ranked, twin), lambda x: x["i"])
    covered = F.flatten(F.transform(starts, lambda i: F.array(*[i + j for j in range(width)])))
    return F.size(F.array_distinct(covered))


def measured(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Every measure the rules read, as columns beside those of ``docs``."""
    stops = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    shed = store.unused(
        docs.columns, "text", "words", "lines", "windows", "ranked", "marks", "stops", "lettered", "bullets", "cut"
    )
    text_, words_, lines_, windows_, ranked_, marks_, stops_, lettered_, bullets_, cut_ = shed
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(text_, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    windows = F.when(
        F.size(words_) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(words_) - width),
            lambda i: F.xxhash64(*[F.get(words_, i + j) for j in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    ranked = F.sort_array(
        F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )

    def share(count: Column, whole: Column) -> Column:
        return F.when(whole > 0, count / whole).otherwise(0.0)

    def absent(chars: str) -> Column:
        return F.length(text_) - F.length(F.translate(text_, chars, ""))

    n_lines = F.size(lines_)
    step = (
        docs.withColumn(text_, body)
        .withColumns({words_: words_of(F.col(text_)), lines_: lines})
        .withColumn(windows_, windows)
        .withColumn(ranked_, F.when(F.size(F.array_distinct(windows_)) < F.size(windows_), ranked))
        .withColumns(
            {
                "n_words": F.size(words_).cast("long"),
                "word_chars": F.length(F.translate(text_, " \t\n\x0b\x0c\r", "")).cast("long"),
                "n_symbols": absent("#*$%&|<>").cast("long"),
                "n_dup_lines": (n_lines - F.size(F.array_distinct(lines_))).cast("long"),
                "n_repeat_words": F.when(
                    F.col(ranked_).isNotNull(), repeated_positions(ranked_, width)
                )
                .otherwise(0)
                .cast("long"),
                marks_: absent("!?"),
                stops_: F.size(F.filter(words_, lambda w: F.lower(w).isin(stops))),
                lettered_: F.size(F.filter(words_, lambda w: w.rlike(r"\p{L}"))),
                bullets_: F.size(F.filter(lines_, lambda x: F.ltrim(x).rlike("^[-*•]"))),
                cut_: F.size(F.filter(lines_, lambda x: F.rtrim(x).rlike(r"(…|\.\.\.)$"))),
            }
        )
    )
    n = F.col("n_words")
    return step.withColumns(
        {
            "repeat_share": share(F.col("n_repeat_words"), n),
            "mean_word_chars": share(F.col("word_chars"), n),
            "symbol_share": share(F.col("n_symbols"), n),
            "mark_share": share(F.col(marks_), n),
            "stop_share": share(F.col(stops_), n),
            "letter_share": share(F.col(lettered_), n),
            "dup_line_share": share(F.col("n_dup_lines"), n_lines),
            "bullet_share": share(F.col(bullets_), n_lines),
            "ellipsis_share": share(F.col(cut_), n_lines),
        }
    ).drop(*shed)


def fails(rule: Rule) -> Column:
    value = F.col(rule.measure)
    low = F.lit(False) if rule.low is None else value < rule.low
    high = F.lit(False) if rule.high is None else value > rule.high
    return low | high


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All measures, the names of the failed rules and ``kept``."""
    names = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))
    return (
        measured(docs, text)
        .withColumn("failed_rules", names)
        .withColumn("kept", F.size("failed_rules") == 0)
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents no rule rejects, with their own columns only.

    The verdict decides between one row and none instead of filtering: a filter would be
    pushed below the measures and carry all of their expressions into each other, with the
    sort of the windows inside its own lambdas.
    """
    # Under one name, so that no column of the documents meets a measure's.
    judged = judge(docs.select(F.struct(*docs.columns).alias("_row"), "text"), rules)
    row = F.when(F.col("kept"), F.array("_row"))
    return judged.select(F.explode(row).alias("_row")).select("_row.*")
