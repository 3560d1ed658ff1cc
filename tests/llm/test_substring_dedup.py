from __future__ import annotations

import random

from strandflow.llm.substring_dedup import _spans, remove_repeats, repeated_spans, units

SCHEMA = "doc_id long, text string, removed string"


def sentence(rng, n):
    return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n)).capitalize() + "."


def plain_spans(texts: dict, min_words: int) -> set:
    """Runs of units that an earlier text, or this one earlier, has."""
    first = {}
    for d in sorted(texts):
        for h in units(texts[d] or "")[0].tolist():
            first.setdefault(h, d)
    out = set()
    for d, t in texts.items():
        run, own = [], set()
        for h, a, b, n, _ in [*zip(*(x.tolist() for x in units(t or "")), strict=True), (None, 0, 0, 0, 0)]:
            again = h in own
            own.add(h)
            if h is not None and (first[h] < d or again):
                run.append((a, b, n))
                continue
            if run and sum(r[2] for r in run) >= min_words:
                out.add((d, run[0][0], run[-1][1]))
            run = []
    return out


def texts():
    rng = random.Random(1)
    passage = " ".join(sentence(rng, rng.randint(4, 11)) for _ in range(9))
    unpunctuated = " ".join(f"q{rng.randrange(10**6)}" for _ in range(90))
    out = {}
    for k in range(30):
        body = [sentence(rng, rng.randint(3, 14)) for _ in range(20)]
        if k % 5 == 1:
            body.insert(7, "Über den " + passage + " und weiter so.")
        if k % 7 == 2:
            body.insert(3, unpunctuated)
        if k % 3 == 0:
            body.insert(0, "One short common line of text.\n")
        out[k] = " ".join(body)
    return out


def test_planted_passages_go_and_clean_texts_stay(spark):
    t = texts()
    df = spark.createDataFrame([(k, x, "clash") for k, x in t.items()], SCHEMA).repartition(4)
    spans = repeated_spans(df).collect()
    assert {r["doc_id"] for r in spans} == {k for k in t if k % 5 == 1 and k != 1} | {k for k in t if k % 7 == 2 and k != 2}
    assert all(r["kept_in"] < r["doc_id"] for r in spans)
    assert {(r["doc_id"], r["start"], r["stop"]) for r in spans} == plain_spans(t, 25)


def test_texts_lose_exactly_the_spans(spark):
    t = texts()
    df = spark.createDataFrame([(k, x, "clash") for k, x in t.items()], SCHEMA)
    for r in remove_repeats(df).collect():
        left, at = [], 0
        for s in r["removed"] or []:
            left.append(t[r["doc_id"]][at : s["start"]])
            at = s["stop"]
        assert r["text"] == "".join(left) + t[r["doc_id"]][at:]


def test_own_repeats_nulls_ties_and_empty_tables(spark):
    long = " ".join(f"z{k}" for k in range(40)) + "."
    rows = [(1, long + "\n" + long, "x"), (2, None, "x"), (3, "", "x"), (None, long, "x"), (4, long.upper(), "x"), (4, long.upper(), "x"), (5, "....\n!!!", "x"), (6, "a" * 200_000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["start"], r["stop"]) for r in repeated_spans(df).collect())
    assert got == [(1, len(long) + 1, 2 * len(long) + 1), (4, 0, len(long))]
    kept = {r["doc_id"]: r["text"] for r in remove_repeats(df).collect()}
    assert kept[1] == long + "\n" and kept[2] is None and kept[None] == long and kept[4] == ""
    assert repeated_spans(df.limit(0)).collect() == []


def test_rows_that_share_an_id_keep_their_own_words(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80)) + "."
    unique = " ".join(f"u{rng.randrange(10**6)}" for _ in range(400))
    twin = " ".join(f"t{rng.randrange(10**6)}" for _ in range(60))
    rows = [(1, passage, "x"), (4, "Short one.\n" + passage + "\ntail", "x"), (4, unique, "x"), (7, "a " + twin + " b", "x"), (7, "c " + twin + " d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string").selectExpr("*", "1 as key", "2 as row", "3 as removed")
    out = remove_repeats(df)
    assert out.columns == df.columns
    left = sorted((r["doc_id"], r["text"]) for r in out.collect())
    assert (4, unique) in left and (1, passage) in left
    (cut,) = [t for d, t in left if d == 4 and t != unique]
    assert cut.startswith("Short one.") and cut.endswith("tail") and len(cut) < 200
    sevens = sorted((t for d, t in left if d == 7), key=len)
    assert len(sevens[1]) == len(twin) + 4 and len(sevens[0]) < 200


def test_frequent_digests_give_the_same_spans(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    rows = [(k % 40, f"own{k} " + passage + f" end{k % 3}", "x") for k in range(120)] + [(500, passage + "\n" + passage, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(tuple, _spans(df, "text", "doc_id", 25).collect()))
    assert want and want == sorted(map(tuple, _spans(df, "text", "doc_id", 25, often=2).collect()))
    assert {r[6] for r in want} == {0, 500}
