from __future__ import annotations

import json
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from strandflow.llm.packing import SumOfSquares, Tokens, _byte_names, byte_bpe_path, mended, merges_by_rank, op1_best_fit_packing, pack, ranked

SCHEMA = "doc_id long, text string, sequence_id string"


def naive_sum(open_gaps: list[int]) -> int:
    return sum(open_gaps.count(g) ** 2 for g in set(open_gaps))


def test_every_placement_minimises_the_sum_of_squares():
    rng = random.Random(3)
    packer, bins = SumOfSquares(20), {}
    for _ in range(400):
        size = rng.randint(1, 20)
        open_gaps = [20 - b for b in bins.values() if b < 20]
        options = [naive_sum([*open_gaps, 20 - size] if size < 20 else open_gaps)]
        for g in set(open_gaps):
            if g >= size:
                rest = open_gaps.copy()
                rest.remove(g)
                options.append(naive_sum(rest + [g - size] * (g > size)))
        sequence, offset = packer.place(size)
        assert bins.get(sequence, 0) == offset
        bins[sequence] = offset + size
        assert bins[sequence] <= 20
        assert naive_sum([20 - b for b in bins.values() if b < 20]) == min(options)


def test_ids_are_those_of_the_library():
    whole, ours = Tokenizer.from_file(byte_bpe_path()), Tokens(byte_bpe_path(), ranked(byte_bpe_path()))
    assert ours.fast is not None
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", "日本", " ", "  ", "\n", "\t", "\u00a0", "'s", "1", "23", "!!", "***", "<|endoftext|>", "<|endoftext", "|>", "\x1c", "\x85", "\u180e", "😀", "don't", "\r\n", "\u3000"]
    texts = ["", " ", "a", " a  b\n\nc ", "a <|endoftext|> b", "it's we'LL 12,5 x" * 40, "x" * 5000, " " * 3000 + "a"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(500)]
    texts += ["".join(chr(c) for c in range(k, k + 64)) for k in range(0, 0xD800, 64)]
    for t in texts:
        assert np.frombuffer(ours.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert np.frombuffer(ours.ids("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    spec = json.loads(Path(byte_bpe_path()).read_text())
    merges, ids = spec["model"]["merges"], spec["model"]["vocab"]
    assert merges_by_rank(spec)
    for change in ({"ignore_merges": True}, {"vocab": {k: -v for k, v in ids.items()}}, {"merges": merges[::-1]}):
        assert not merges_by_rank(spec | {"model": spec["model"] | change})
    # an entry that its own merge does not make: "abc" from "ab" and "c" after "b" and "c" have merged
    letters = {c: k for k, c in enumerate(_byte_names())}
    small = spec | {"model": spec["model"] | {"vocab": letters | {"bc": 300, "ab": 301, "abc": 302}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}}
    assert not merges_by_rank(small)
    path = tmp_path / "small.json"
    path.write_text(json.dumps(small))
    assert not ranked(str(path))
    assert np.frombuffer(Tokens(str(path), False).ids("abc"), "<u4").tolist() == Tokenizer.from_file(str(path)).encode("abc").ids


def check(rows, texts: dict, capacity: int):
    whole = Tokenizer.from_file(byte_bpe_path())
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [x for r in own for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == ids
        assert all(r["length"] == capacity for r in own[1:])
    return len(by_sequence)


def test_pieces_cover_all_documents_without_gaps(spark):
    rng = random.Random(1)
    texts = {k: " ".join(rng.choices(["alpha", "beta", "gamma,", "x"], k=rng.choice([1, 5, 30, 200]))) for k in range(120)}
    texts |= {200: None, 201: "", 202: "long " * 5000, 203: "a <|endoftext|> b"}
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], SCHEMA).repartition(3)
    rows = pack(df, capacity=64, tail=50).collect()
    used = check(rows, texts, 64)
    total = sum(r["length"] for r in rows)
    assert used <= 1.05 * total / 64 + 8


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")], SCHEMA)
    assert len(pack(df).collect()) == 3
    assert pack(df.limit(0)).collect() == []


def best_fit_decreasing(sizes: list[int], capacity: int) -> int:
    gaps: list[int] = []
    for size in sorted(sizes, reverse=True):
        fitting = [g for g in gaps if g >= size]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else capacity) - size)
    return len(gaps)


def test_mending_keeps_every_piece_and_takes_no_more_sequences():
    rng = random.Random(9)
    for top in (20, 8, 3):
        sizes = np.array(sorted((rng.randint(1, top) for _ in range(300)), reverse=True))
        packer = SumOfSquares(20)
        sequence, offset = (np.array(x) for x in zip(*[packer.place(int(s)) for s in sizes], strict=True))
        after, place = mended(sizes, sequence, offset, 20)
        assert len(set(after.tolist())) <= packer.made
        for s in set(after.tolist()):
            at = 0
            for k in sorted(np.flatnonzero(after == s), key=lambda k: place[k]):
                assert place[k] == at
                at += sizes[k]
            assert at <= 20


def test_the_query_needs_few_more_sequences_than_best_fit_decreasing(spark):
    rows = op1_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    used = len({r.sequence_id for r in rows})
    assert used <= 1.002 * best_fit_decreasing([r.length for r in rows], 1024)
