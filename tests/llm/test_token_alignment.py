"""Operator 13 against a walk over whole texts with the libraries' plain calls."""
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from revlens.llm import queries
from revlens.llm import token_alignment as T
from revlens.llm.common import stored

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Per text the contract's columns, by walking over all tokens."""
    a_library = Tokenizer.from_file(A_PATH)
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    rows, links = [], []
    for text in texts:
        text = text or ""
        a, b = a_library.encode(" " + text, add_special_tokens=False).ids, b_library.encode(text)
        bytes_a = [bytes(letter[c] for c in a_library.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(b_library.id_to_piece(k)[3:-1], 16)]) if b_library.is_byte(k)
                   else b_library.id_to_piece(k).replace("▁", " ").encode() for k in b]
        linked, groups = Counter(), []
        whole = (" " + text).encode()
        if text and b"".join(bytes_a) == whole == b"".join(bytes_b):
            i = j = end_a = end_b = from_a = from_b = 0
            while i < len(a) or j < len(b):
                if end_a <= end_b and i < len(a):
                    end_a, i = end_a + len(bytes_a[i]), i + 1
                else:
                    end_b, j = end_b + len(bytes_b[j]), j + 1
                if end_a == end_b:
                    groups.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
                    linked.update((x, y) for x in a[from_a:i] for y in b[from_b:j])
                    from_a, from_b = i, j
        else:
            a = b = []
        rows.append([len(a), len(b), len(groups), sum(linked.values()),
                     hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
        links.append(linked)
    count = Counter(p for linked in links for p in linked)
    most = defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    return [(*row[:4], sum(m for p, m in linked.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in linked.items()), row[4])
            for row, linked in zip(rows, links, strict=True)]


@pytest.mark.parametrize("slice_chars, block_chars, large", [(2_000_000, 4_000_000, 256), (50, 300, 2)])
def test_odd_texts_equal_plain_walk(slice_chars, block_chars, large, spark, monkeypatch):
    """Blocks and slices of any size, groups counted or paired directly; in this process, without Spark."""
    for name, value in (("SLICE_CHARS", slice_chars), ("BLOCK_CHARS", block_chars), ("LARGE_GROUP", large)):
        monkeypatch.setattr(T, name, value)
    random.seed(4)
    signs = ["a", "The", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "<|endoftext|>", "<s>", "<0x0A>", "'s", "1234", "\x00", " ",
             "word", " word", "Ġ", "ß", ".", "\r\n", "the the the"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(1200)] + ["", "x" * 5000, "日本" * 800, " "]
    aligner = T.Aligner(T.TokenizerA(A_PATH), T.TokenizerB(B_PATH))
    want = plain(texts)
    got = aligner.documents(texts)
    for text, g, w in zip(texts, got, want, strict=True):
        digest = hashlib.sha256(g[4].encode()).hexdigest() if g[4] else ""
        assert (*g[:4], digest) == (*w[:4], w[6]), text
    assert sum(w[0] > 0 for w in want) > 500 and sum(w[0] == 0 for w in want) > 50


def test_query_and_odd_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, d.text, 0) for d in docs] + [(None, "the same text", 1), (None, None, 2), (-5, "", 3), (-6, "a▁b", 4),
                                                    (-7, "the same text", 5), (-7, "the same text", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_token_alignment(spark, str(tmp_path)).collect()
    texts = [r[1] for r in rows]
    want = [(r[0], *w) for r, w in zip(rows, plain(texts), strict=True)]
    key = lambda r: tuple(-10 ** 9 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pair_counts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "cat"), (2, "cat cat"), (3, "dog")], "doc_id long, text string")
    counts = T.pair_counts(stored(T.align(docs, A_PATH, B_PATH), "aligned"))
    cat = Tokenizer.from_file(A_PATH).encode(" cat", add_special_tokens=False).ids
    assert {r.n for r in counts.where(counts.a.isin(cat)).collect()} == {2}
    empty = stored(T.align(docs.limit(0), A_PATH, B_PATH), "aligned")
    assert T.with_link_counts(empty).count() == 0
