import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from axisframe.llm import bpe, codepoints, positional_index, shared_spans
from axisframe.llm.queries import TOKENIZERS

VOCAB = f"{TOKENIZERS}/byte_bpe_50k.json"
DOCS = "doc_id long, text string, id int, ids string, key long"


def docs(spark, texts):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(n, t, 1, "x", 2) for n, t in texts], DOCS)


# -- encoding ------------------------------------------------------------------------------------------------------

HARD = [
    "", None, " ", "   \n\n x", "don't we'll I've 'RE x's's '' 's", "\n's \n\n's x", "'", "'r", "'l", "x  ", "a  b 'llo", "  a", "日本語 😀😀 naïve Ünï",
    "a\x1c\x1d b\x0b\x0c  c\x85d", "<|endoftext|>x", "aaaaaaaaaaaaaaaaaaaaa", "-" * 5001, "tab\t\tend\t", "1234567890 12", "\x00\x01", "é ⅷ ²", "\r\n\r\n--b\r\n",
]


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no public vocabulary here")
def test_ids_equal_those_of_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(VOCAB)
    whole.encode_special_tokens = True
    rng = random.Random(5)
    alphabet = " \n\t'aestmdrvl09.,-_äßж中😀  \r"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["word and word " * 40_000]
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(docs(spark, list(enumerate(texts))), VOCAB).collect()}
    for n, t in enumerate(texts):
        assert got[n] == (whole.encode(t, add_special_tokens=False).ids if t else []), t[:40]


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no public vocabulary here")
def test_long_texts_in_parts_have_the_same_ids(spark):
    rng = random.Random(8)
    text = "".join(rng.choice(["a", "b ", " c", "  ", "\n", "'s", "1", "é ", "x y z "]) for _ in range(3000))
    parts = bpe.safe_parts(text, 40)
    assert len(parts) > 50 and "".join(parts) == text
    whole, cut = (bpe.encode_corpus(docs(spark, [(1, text), (2, "a b"), (3, "-" * 300)]), VOCAB, block_bytes=n).collect() for n in (10**6, 40))
    assert {r.doc_id: list(r.ids) for r in whole} == {r.doc_id: list(r.ids) for r in cut}


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no public vocabulary here")
def test_encoding_of_empty_tables_and_repeated_rows(spark):
    assert bpe.encode_corpus(docs(spark, []), VOCAB).isEmpty()
    out = bpe.encode_corpus(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), VOCAB).collect()
    assert len(out) == 3 and len({tuple(r.ids) for r in out}) == 1


def test_merge_rounds_follow_ranks(tmp_path):
    """A small vocabulary where a pair that is locally lowest must wait."""
    letters = {c: n for n, c in enumerate(bpe.byte_alphabet())}
    merges = [["b", "c"], ["bc", "d"], ["d", "e"], ["a", "a"], ["aa", "a"]]
    vocab = letters | {a + b: 256 + n for n, (a, b) in enumerate(merges)}
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    m = bpe.Merges.from_json(str(tmp_path / "v.json"))
    words = [b"bcde", b"aaaaa", b"x", b"", b"de"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ids, starts = bpe.encode_words(data, np.r_[0, np.cumsum([len(w) for w in words])], m)
    names = {v: k for k, v in vocab.items()}
    got = [[names[i] for i in ids[a:b]] for a, b in zip(starts, starts[1:])]
    assert got == [["bcd", "e"], ["aa", "aaa"], ["x"], [], ["de"]] or got == [["bcd", "e"], ["aa", "aa", "a"], ["x"], [], ["de"]]
    assert got[1] == ["aa", "aaa"]  # aa aa a: then the last aa takes the a


def test_blocks_cover_all_rows_once():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c" * 5] * 7)
    spans = list(codepoints.blocks(texts, 30))
    assert spans[0][0] == 0 and spans[-1][1] == 35 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert list(codepoints.blocks(pa.array([], pa.string()), 30)) == []


# -- leaks ---------------------------------------------------------------------------------------------------------

WORDS = regex.compile(r"[\p{L}\p{N}]+")


def split_words(text):
    return [w.lower() for w in WORDS.findall(regex.sub("=\r?\n", "", text))] if text else []


def brute_leaks(documents, items, width=12):
    windows = {}
    for i, t in items:
        w = split_words(t)
        for a in range(len(w) - width + 1):
            windows.setdefault(tuple(w[a : a + width]), set()).add(i)
    out = set()
    for d, t in documents:
        w = split_words(t)
        for a in range(len(w) - width + 1):
            out |= {(d, i) for i in windows.get(tuple(w[a : a + width]), ())}
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "ΟΔΟΣ", "straße", "x1", "２", "été", "İz", "no", "the", "of", "and"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "=\r\n", "\r\n", "=\n", " = ", "_"]) for _ in range(n))
    items = [(n, text(rng.randint(5, 40))) for n in range(12)] + [(90, None), (91, ""), (92, "too short"), (93, None)]
    documents = []
    for n in range(60):
        base = text(rng.randint(0, 80))
        if n % 3 == 0:
            w = split_words(rng.choice(items[:12])[1])
            a = rng.randint(0, max(0, len(w) - 12))
            base = base + " " + " ".join(w[a : a + rng.randint(10, 14)]).upper() + " " + base
        documents.append((n, base))
    documents += [(100, None), (101, ""), (102, " "), (103, documents[0][1]), (0, documents[0][1]), (104, "=" * 30), (105, "=\n"), (106, "a=")]
    items += [items[0], (50, items[0][1])]
    frame = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, doc_id string")
    got = positional_index.leaked(docs(spark, documents), frame)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_leaks(documents, items)
    index = positional_index.build_index(docs(spark, documents), shard_bytes=300)
    assert {tuple(r) for r in positional_index.search(index, frame, block_chars=400).collect()} == set(rows)
    words = positional_index.Words(*positional_index.Words.tables())
    asked = [(i, t) for i, t in dict(items).items() if t]
    test = positional_index.TestWindows.of(np.array([i for i, _ in asked]), pa.array([t for _, t in asked]), 12, words)
    for r in index.collect():
        shard = tuple(np.array(r[c]) for c in ("doc_ids", "doc_starts", "terms", "term_starts", "positions"))
        whole = positional_index.search_shard(shard, test, 12, 0)
        assert all((positional_index.search_shard(shard, test, 12, 0, most) == whole).all() for most in (1, 7, 100))


def test_proximity_and_empty_tables(spark):
    phrase = "one two three four five six seven eight nine ten eleven twelve"
    frame = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    documents = docs(spark, [(1, phrase.replace("seven", "other")), (2, phrase.replace("six", "six extra")), (3, "nothing here")])
    index = positional_index.build_index(documents)
    find = lambda **k: {r.doc_id for r in positional_index.search(index, frame, **k).collect()}
    assert find() == set() and find(least=11) == {1} and find(least=12, slop=1) == {2} and find(least=11, slop=1) == {1, 2}
    assert positional_index.leaked(docs(spark, []), frame).isEmpty()
    assert positional_index.leaked(documents, frame.where("false")).isEmpty()


def test_very_long_texts_are_split_between_words():
    words = positional_index.Words(*positional_index.Words.tables())
    text = ("lorem =\r\nipsum dolor" + "y" * 90 + " ") * 300
    whole, parts = words.of(pa.array([text])), words.of(pa.array([text]), most=1000)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(words.of(pa.array(["z" * 5000]), most=100)[0]) == 1


# -- shared spans --------------------------------------------------------------------------------------------------


def brute_spans(documents, span):
    seen = {}
    for d, t in documents:
        for a in range(len(t or "") - span + 1):
            seen.setdefault(t[a : a + span], set()).add(d)
    shared = {}
    for d, t in documents:
        marks = shared.setdefault(d, set())
        for a in range(len(t or "") - span + 1):
            if len(seen[t[a : a + span]]) > 1:
                marks.update(range(a, a + span))
    out = set()
    for d, marks in shared.items():
        for a in sorted(marks):
            if a - 1 not in marks:
                b = a
                while b in marks:
                    b += 1
                out.add((d, a, b))
    return out


def span_fixture(rng):
    letters = "abcdefgh \nä😀"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    footer, quoted = piece(70), piece(120)
    documents = [(n, piece(rng.randint(0, 60)) + (footer if n % 2 else "") + piece(rng.randint(0, 30)) + quoted[rng.randint(0, 60) : rng.randint(60, 120)] + "z" * rng.randint(0, 50)) for n in range(50)]
    return [*documents, (60, None), (61, ""), (62, footer[:19]), (63, documents[3][1]), (64, documents[4][1]), (65, "z" * 400), (66, footer + footer), (67, "q" * 90), (68, piece(3000) + footer)]


@pytest.mark.parametrize("hot,bits", [(10_000, None), (50, None), (10_000, 17)])
def test_shared_spans_equal_brute_force(spark, monkeypatch, hot, bits):
    documents = span_fixture(random.Random(11))
    found = shared_spans.shared_spans(docs(spark, documents).repartition(3), span=20, gram=6, hot=hot, bits=bits)
    assert found.columns == ["doc_id", "span_start", "span_end"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_spans(documents, 20)


def test_shared_spans_without_any(spark):
    assert shared_spans.shared_spans(docs(spark, [])).isEmpty()
    same = [(1, "a" * 500), (1, "a" * 500), (2, "b" * 500), (None, "a" * 500)]
    assert shared_spans.shared_spans(docs(spark, same)).isEmpty()  # one id twice is one record
    many = docs(spark, [(1, "a" * 500)] * 300 + [(2, "b" * 300 + "a" * 250)] * 200)
    assert sorted(tuple(r) for r in shared_spans.shared_spans(many).collect()) == [(1, 0, 500), (2, 300, 550)]
    got = shared_spans.shared_spans(docs(spark, [*same, (3, "x" + "a" * 200)]))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 500), (3, 1, 201)]


def test_long_texts_go_in_pieces():
    text = "".join(random.Random(1).choice("abc") for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([text, text[:30]])], names=["id", "text"])
    windows = set()
    for chars, starts, rows, offsets in shared_spans.pieces(batch, 20, most=700):
        for row, at, a, b in zip(rows, offsets, starts, starts[1:]):
            new = {(int(row), int(at) + k) for k in range(b - a - 19)}
            assert not windows & new
            windows |= new
    assert windows == {(0, k) for k in range(4981)} | {(1, k) for k in range(11)}


def test_rolling_hashes_and_sliding_minimum():
    rng = np.random.default_rng(0)
    chars = rng.integers(0, 3, 3000).astype(np.uint32)
    h = shared_spans.Rolling(0)(chars, 5)
    by_text = {}
    for k, x in enumerate(h.tolist()):
        assert by_text.setdefault(tuple(chars[k : k + 5]), x) == x
    assert len(set(by_text.values())) == len(by_text)
    for width in (1, 2, 7, 64, 137):
        assert (shared_spans.sliding_min(h, width) == np.lib.stride_tricks.sliding_window_view(h, width).min(1)).all()


def test_sketch_never_loses_a_repeated_key(spark):
    documents = docs(spark, span_fixture(random.Random(2))).select(F.col("doc_id").alias("id"), "text").where("length(text) >= 20")
    two = shared_spans._sketch(documents, 20, 6, 2, 17)
    seen = {}
    roll = shared_spans.Rolling(0)
    for r in documents.collect():
        batch = pa.RecordBatch.from_arrays([pa.array([r.id]), pa.array([r.text])], names=["id", "text"])
        for chars, starts, _, _ in shared_spans.pieces(batch, 20):
            for k in set(shared_spans.key_ranges(chars, starts, 20, 6, roll)[0].tolist()):
                seen[k] = seen.get(k, 0) + 1
    keys = np.array(list(seen), np.uint64)
    repeated = shared_spans._estimated(keys, two, 2, 17)
    counts = np.array(list(seen.values()))
    assert repeated[counts >= 2].all() and not repeated[counts == 1].all()
