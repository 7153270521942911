"""Operators 12 and 13 against the tokenizers' own results and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textguard.llm import bytebpe, token_alignment, token_counts

P = pytest.importorskip("public_tokenizers")
A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))


def texts():
    rng = random.Random(5)
    out = [None, "", "a", "   ", "x" * 300, "ab" * 500 + " " + "é" * 400, "日本語のテキスト。" * 40, "<|endoftext|>" * 30, " " * 400, "a▁b", "tail  ",
           "foo <|endoftext|>\n bar's  they'll\n\n  we're   " * 20, "\x1c\x1d a\x85b　c " * 30, "0123456789" * 50, "!?" * 100 + " \n" * 70]
    parts = ["a", "é", " ", "  ", "\n", "'s", "'re", "1", "日本", "!", "<|endoftext|>", "<|endo", "word ", "　", "🙂", "x" * 40]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    return out + out[5:8]


def table(spark):
    rows = [(i if i % 17 else None, t, 1, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, block string")


@pytest.fixture(scope="module")
def library():
    with open(A, "rb") as f:
        spec = f.read()
    return {plain: bytebpe.tokenizer(spec, plain) for plain in (False, True)}


@pytest.mark.parametrize("chunk,overlap", [(64, 30), (64, 63), (100, 40), (1 << 16, 1 << 10)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(table(spark), A, limit=100, chunk=chunk, overlap=overlap).collect())
    n = [len(library[False].encode(t or "", add_special_tokens=False).ids) for t in texts()]
    assert got == sorted((len((t or "").encode()), k, k > 100) for t, k in zip(texts(), n))


def test_counts_by_other_files(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    assert sorted(r.n_tokens for r in token_counts.count(table(spark), B).collect()) == sorted(len(model.encode(t or "")) for t in texts())
    other = str(P.path("word_bpe_49k.json"))
    with open(other, "rb") as f:
        spec = f.read()
    tok = bytebpe.tokenizer(spec, False)
    assert not bytebpe.splits_at_space(spec)
    assert (sorted(r.n_tokens for r in token_counts.count(table(spark), other, chunk=64, overlap=30).collect())
            == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts()))


def test_white_space_is_the_split_patterns(library):
    import re
    here = re.compile(f"[{bytebpe.SPACE}]")
    split = library[True].pre_tokenizer.pre_tokenize_str
    for c in [*range(0xD800), *range(0xE000, 0x30000)]:
        assert (split(chr(c) * 3 + "x")[0][1][1] == 2) == bool(here.match(chr(c))), hex(c)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count(empty, A).collect() == []
    assert token_alignment.align(empty, A, B).collect() == []


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_of_the_merge_path_give_the_whole_merge(piece):
    rng = np.random.default_rng(piece)
    a, b = (np.cumsum(rng.integers(1, k, 300)) for k in (4, 5))
    end = max(a[-1], b[-1]) + 1
    a, b = np.append(a, end), np.append(b, end)
    i, j = token_alignment.merge_path(a, b, piece)
    assert max(np.diff(i + j)) <= piece + 1
    x, y, closes = token_alignment.merged(a, b, piece)
    ends = sorted(set(a.tolist()) | set(b.tolist()))
    assert x.tolist() == np.searchsorted(a, ends).tolist() and y.tolist() == np.searchsorted(b, ends).tolist()
    assert [e for e, c in zip(ends, closes) if c] == sorted(set(a.tolist()) & set(b.tolist()))


def spans(lengths):
    end = np.cumsum(lengths).tolist()
    return list(zip([0, *end[:-1]], end))


def aligned(library):
    """Rows of operator 13 by comparing every A token with every B token."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(A, "rb") as fa, open(B, "rb") as fb:
        pair = token_alignment.Pair(fa.read(), fb.read())
    rows, held = [], Counter()
    for text in texts():
        a = library[True].encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text or "")
        want = (" " + text).encode() if text else b""
        assert b"".join(pair.a_bytes[i] for i in a) == want
        if b"".join(pair.b_bytes[i] for i in b) != want:
            a = b = []
        sa, sb = spans([len(pair.a_bytes[i]) for i in a]) if a else [], spans([len(pair.b_bytes[i]) for i in b]) if b else []
        links = [(p, q) for p, (s, e) in zip(a, sa) for q, (u, v) in zip(b, sb) if s < v and u < e]
        groups, low = [], 0
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            groups.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, at) if low <= s < cut) for ids, at in ((a, sa), (b, sb))))
            low = cut
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        held.update(set(links))
    most = Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return sorted((na, nb, ng, len(ls), sum(held[x] == most[x[0]] for x in ls), sum(held[x] for x in ls), h) for na, nb, ng, ls, h in rows)


@pytest.mark.parametrize("chunk,block", [(1 << 20, 1 << 24), (50, 2000)])
def test_alignment_equals_all_pairs(spark, library, chunk, block):
    got = sorted(tuple(r)[1:] for r in token_alignment.align(table(spark), A, B, chunk, block).collect())
    assert got == aligned(library)


def test_pieces_by_segment():
    """Operator 13: a sentencepiece file that splits at spaces is encoded once a distinct segment, with the ids of the whole texts."""
    import random

    import public_tokenizers
    from textguard.llm import token_alignment as TA
    a_spec, b_spec = (open(public_tokenizers.path(f), "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    pair, rng = TA.Pair(a_spec, b_spec), random.Random(13)
    assert TA.splits_at_space(b_spec)
    asked, encode = [], pair.b.encode
    pair.pieces.model = type("Counted", (), {"encode": lambda self, words, **kw: asked.extend(words) or encode(words, **kw)})()
    bits = [" ", "  ", "\n", "\r", "a", "the", "▁", "<s>", "<0x41>", "é", "日本", " ", "\x00", "😀", ";\r\n", "1", "."]
    for _ in range(300):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        _, na, b, nb = pair.encode(texts)
        want = [x if t and b"".join(pair.b_bytes[i] for i in x) == (" " + t).encode() else [] for t, x in zip(texts, encode(texts))]
        assert b.tolist() == [i for x in want for i in x] and nb.tolist() == [len(x) for x in want] and all((na > 0) == (nb > 0))
    asked.clear()
    pair.encode(["plenty of words words words"] * 50)
    assert len(asked) <= 4


def test_segments_of_both_files_remembered(library, monkeypatch):
    """Operator 13: one memory of segments for both files; when it is full, segments met more than once stay and are not encoded anew."""
    import public_tokenizers
    import sentencepiece
    from textguard.llm import token_alignment as TA
    for module in (TA, bytebpe):
        monkeypatch.setattr(module, "REMEMBER", 300, raising=False)
    pair = TA.Pair(*(open(public_tokenizers.path(f), "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    rng, asked = random.Random(7), Counter()
    pair.pieces.model = type("Counted", (), {"encode": lambda self, words, **kw: asked.update(words) or model.encode(words, **kw)})()
    often = [f"often{i}" for i in range(40)]
    bits = [" ", "  ", "\n", "\r", "\r\n", ";\r", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", "　", "▁", "é", "日本", "<unk>", "<s>",
            "<|endoftext|>", "the", "1", "'s", "!", "\x00", "x" * 70, "🙂"]
    for k in range(60):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(8)]
        texts.append(" ".join(often))
        texts.append(" ".join(f"new{k}x{i}" for i in range(60)))
        a, na, b, nb = pair.encode(texts)
        want_a = [library[True].encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts]
        want_b = model.encode(texts)
        whole = [b"".join(pair.b_bytes[i] for i in y) == (" " + t).encode() for t, y in zip(texts, want_b)]
        assert a.tolist() == [i for x, ok in zip(want_a, whole) if ok for i in x] and na.tolist() == [len(x) * ok for x, ok in zip(want_a, whole)]
        assert b.tolist() == [i for x, ok in zip(want_b, whole) if ok for i in x] and nb.tolist() == [len(x) * ok for x, ok in zip(want_b, whole)]
    assert max(asked[w] for w in often[1:]) <= 2
