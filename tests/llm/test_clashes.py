"""Columns of the documents may have any name that an operator uses inside."""

from candlewick.llm import quality, simhash, store, suffixes

NAMES = "_id _sig _bytes _head _own _text _words _lines _windows _ranked _marks _row __sig sig group fp bytes".split()


def test_inner_names_do_not_meet_columns(docs, awkward):
    plain = docs(awkward)
    wide = plain.selectExpr("*", *[f"'{n}' AS {n}" for n in NAMES])
    for apply in (suffixes.dedup, simhash.keep_one, quality.keep_good):
        got, want = apply(wide), apply(plain)
        assert got.columns == wide.columns
        key = lambda r: tuple((v is not None, v) for v in r)
        rows = sorted((tuple(r) for r in got.select(*plain.columns).collect()), key=key)
        assert rows == sorted((tuple(r) for r in want.collect()), key=key)
        assert all(r[n] == n for r in got.collect() for n in NAMES)
    judged = quality.judge(wide)
    assert set(NAMES) <= set(judged.columns)


def test_unused_names():
    assert store.unused(["a", "_ID"], "id", "x") == ["__id", "__x"]
    assert store.unused([], "id") == ["_id"]
