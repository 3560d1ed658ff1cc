from __future__ import annotations

import random
import re

import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandflow.llm.quality_rules import BAD_CHUNKS, BANDS, CHUNK, CHUNK_BAND, apply_rules, base_counts, measured_bands, op6_quality_rules
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str) -> tuple:
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é \x0b\x1c日", max_size=120))
def test_base_counts_equal_the_definition(text):
    assert base_counts(text.encode()) == plain(text)


def test_many_distinct_words_stay_exact():
    rng = random.Random(2)
    words = [f"w{rng.randrange(9000)}" for _ in range(15_000)]
    words[100:105] = words[9000:9005]
    assert base_counts(" ".join(words).encode())[4] == plain(" ".join(words))[4] >= 10


def prose(spark, n: int = 40) -> list[str]:
    """The longest texts that labels call good."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return [r["text"] for r in docs.join(labels.where("quality = 1"), "doc_id").orderBy(F.length("text").desc()).limit(n).collect()]


def squeezed(data: bytes) -> float:
    return len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)) / len(data)


def verdict(text: str | None) -> tuple:
    counts = plain(text or "")
    failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    data = (text or "").encode()
    if not data:
        return *counts, failed, False
    low, high = next((a, b) for top, a, b in BANDS if len(data) < top)
    whole = low <= squeezed(data) <= high
    places = sorted({*range(0, len(data) - CHUNK + 1, CHUNK), len(data) - CHUNK}) if len(data) >= CHUNK else []
    bad = [not CHUNK_BAND[0] <= squeezed(data[k : k + CHUNK]) <= CHUNK_BAND[1] for k in places]
    return *counts, failed, not failed and whole and (not bad or sum(bad) <= BAD_CHUNKS * len(bad))


def test_the_query_equals_a_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == verdict(docs[r["doc_id"]]), r["doc_id"]


def test_good_documents_stay_and_bad_ones_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = apply_rules(docs.select("doc_id", "text")).where("not base_failed").join(labels, "doc_id")
    kept = {r["quality"]: (r["n"], r["k"]) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()}
    assert kept[1][1] == kept[1][0] > 300
    assert kept[0][1] < 0.6 * kept[0][0]


def test_repetition_and_noise_inside_good_text_are_found(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    good = [t for t in prose(spark) if len(t.encode()) >= 8 * CHUNK // 2][:10]
    assert len(good) >= 5
    rows = []
    for k, t in enumerate(good):
        cut = len(t) // 2
        # words of one letter and digits differ, so that no window of five words comes twice
        dull = " ".join(f"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{j}" for j in range(110))
        rows += [(10 * k, t), (10 * k + 1, t[:cut] + " " + dull + " " + t[cut:]), (10 * k + 2, t[:cut] + " " + " ".join(noise(60) for _ in range(80)) + " " + t[cut:]), (10 * k + 3, t + " " + " ".join(noise(60) for _ in range(40)))]
    got = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * k]["kept"] for k in range(len(good)))
    assert not any(got[10 * k + j]["kept"] or got[10 * k + j]["base_failed"] for k in range(len(good)) for j in (1, 2, 3))


def test_limits_can_be_measured(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1"), "doc_id")
    bands, chunk_band = measured_bands(good)
    assert all(low <= a <= b <= high for (_, a, b), (_, low, high) in zip(bands[1:], BANDS[1:], strict=True) if (a, b) != (0.0, 5.0))
    assert CHUNK_BAND[0] <= chunk_band[0] < chunk_band[1] <= CHUNK_BAND[1]
    own = apply_rules(good.select("text"), bands=bands, chunk_band=chunk_band, bad_chunks=0.0)
    assert own.where("not base_failed and not kept").count() == 0
    assert measured_bands(good.limit(0))[1] == (0.0, 5.0)


def test_verdicts_and_odd_rows(spark):
    rng = random.Random(7)
    text = prose(spark, 1)[0]
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(8)) for _ in range(300))
    rows = [(1, text, True), (2, "spam ham eggs " * 500, True), (3, noise, True), (4, None, True), (5, "", True), (None, text, True), (6, "x" * 100_000, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    got = {(r["doc_id"]): r["kept"] for r in apply_rules(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, None: True, 6: False}
    assert apply_rules(df.limit(0)).collect() == []
