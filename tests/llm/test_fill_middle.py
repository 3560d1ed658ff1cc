from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandflow.llm.fill_middle import SQL, Runs, fill_in_middle, op12_fill_middle, restored, transform
from tests.conftest import SF, rows_of


def plain(text: str, doc_id: object, seed: int = 1) -> tuple:
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ<>PSM \n\té日😀́", max_size=60), st.integers(0, 10_000))
def test_one_text_equals_the_list_of_units(text, doc_id):
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    assert transform(text, digest, 10, 20) == plain(text, doc_id)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abZ< \n日😀", max_size=60))
def test_every_cut_is_where_its_units_end(text):
    units, runs = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), Runs(text)
    assert runs.n == len(units)
    assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_query_equals_sql(spark, duck):
    assert rows_of(op12_fill_middle(spark, SF)) == rows_of(duck.sql(SQL["op12_fill_middle"]).df())


def test_odd_rows_come_back_whole(spark):
    texts = [None, "", "a", "x <P> y", "a<P", "P>b <S", "\n", "wörd " * 40_000, "l" * 200_000, "é" * 9, "dup", "dup"]
    rows = [(k if k % 5 else None, t, "clash", 7) for k, t in enumerate(texts)] + [(10, "dup", "clash", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, own_ int")
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "own_", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        assert r["back"] == text and r["own_"] == 7
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(text, "null" if r["doc_id"] is None else r["doc_id"])
    assert fill_in_middle(df.limit(0)).collect() == []
    assert {r["form"] for r in fill_in_middle(df, keep_percent=0, spm_percent=100).where("text = 'dup'").collect()} == {"spm"}
