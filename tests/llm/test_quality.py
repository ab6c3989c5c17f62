import re

from candlewick.llm import quality

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


def test_counts(docs, awkward, prose):
    rows = [r for r in awkward if r[0] not in (3, 4)]
    rows += [(20, "a b c " * 30), (21, "x y z\nx y z\n \n\n x y z\n"), (22, "#*$%&|<> a"), (23, "a a a a")]
    rows.append((24, prose(4, 300, 12)))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality.judge(docs(rows)).select("doc_id", *columns).collect()
    want = sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in out), key=repr) == want


def test_very_long_text_and_no_rows(docs, prose):
    text = prose(3, 40_000, 5000)
    row = quality.judge(docs([text])).first()
    assert row["n_words"] == 40_000
    assert quality.judge(docs([])).count() == 0


def test_rules_name_what_fails(docs, prose):
    clean = " ".join(f"{w} the" for w in prose(1, 100, 5000).split())
    rows = [clean, "the " * 60, clean.replace(" ", " ### "), clean.upper().replace(" ", "!! "), "short text"]
    failed = {r["doc_id"]: set(r["failed_rules"]) for r in quality.judge(docs(rows)).collect()}
    assert failed[0] == set()
    assert "repeated_words" in failed[1]
    assert "symbols" in failed[2]
    assert "shouting" in failed[3]
    assert "few_words" in failed[4]


def test_stage_keeps_columns_and_clashing_names(docs, prose, spark):
    clean = " ".join(f"{w} the" for w in prose(1, 100, 5000).split())
    from pyspark.sql import functions as F

    df = docs([clean, "no", None]).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7))
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert [(r["doc_id"], r["n_words"], r["kept"]) for r in out.collect()] == [(0, "mine", 7)]


def test_no_python_and_no_exchange(docs):
    plan = quality.judge(docs(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
