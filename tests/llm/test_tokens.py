"""Byte-level BPE against the tiktoken library, token files against the tokenizers library and brute-force offsets."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe as B
from tessera.llm import token_files as T

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(B.read_ranks(RANKS)) if t}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return B.Codec(B.read_ranks(RANKS), public_tokenizers.PATTERN)


def odd_texts():
    random.seed(11)
    letters = "abcdefgh ijkl'mn.,!éßñ日本\n\t 012ΣσİŒﬁ\x00"
    made = ["".join(random.choice(letters) for _ in range(random.randrange(80))) for _ in range(400)]
    return [*made, "", "a" * 3000, "ab" * 900, " " * 1500, "=" * 700, "é" * 500, "<|endoftext|> x", "it's DON'T", "𝔘𝔫𝔦 😀", "x'", "a_b--c!!"]


def test_encoding_is_the_librarys(codec, library):
    texts = odd_texts()
    got = B.encoder(codec).encode(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(g).decode() for g in got] == texts


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError, match="lacks the bytes"):
        B.PairTable([bytes([b]) for b in range(255)])


def test_heap_and_matrix_agree(codec):
    pieces = [t.encode() for t in odd_texts() if t]
    for p in pieces:
        table = codec.table
        row = table.single[np.frombuffer(p[:150], np.uint8)][None, :]
        assert B.merge_matrix(row, table)[0].tolist() == B.merge_long(p[:150], table).tolist()


def test_small_cache_changes_nothing(codec, library):
    texts = odd_texts()[:60]
    cache = B.encoder(codec)
    cache.bound = 5
    assert [x.tolist() for t in texts for x in cache.encode([t])] == [library.encode_ordinary(t) for t in texts]


def test_tables(edge, edge_rows, documents, library):
    for df, texts in ((edge, [r[1] for r in edge_rows]), (documents, [r["text"] for r in documents.select("text").collect()])):
        out = B.encode(df, RANKS, public_tokenizers.PATTERN, decode=True)
        want = sorted(np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in texts)
        assert sorted(bytes(r["ids"]) for r in out.collect()) == want
        assert sorted(bytes(r["decoded"]).decode() for r in out.collect()) == sorted(t or "" for t in texts)
        again = B.decode(out.select("doc_id", "ids"), RANKS)
        assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted((t or "").encode() for t in texts)
    assert B.encode(edge.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def special_texts(tokenizer):
    """Each added token alone, in words, repeated, beside blanks, marks and other characters, in other case, and cut short."""
    forms = ["{}", "a{}b", "{0}{0}", "{0} {0}\n{0}", " {} ", "x {}", "{} x", "don{}'t", "é{}\u0301 it's", "!?{}...", "日本{}тест", "0{}1", "\x00{}\t", "<{}>", "{0}<|{0}"]
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert len(added) >= 2
    return [f.format(t) for f in forms for token in added for t in (token, token.upper(), token[:-1], token[1:])] + ["".join(added), " ".join(added)]


def test_word_encoder_is_the_librarys():
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [*odd_texts(), *special_texts(tokenizer)]
    flat, begin = T.word_encoder(WORDS).encode(pa.array(texts, pa.large_string()))
    got = [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_files_have_the_librarys_special_tokens(spark, tmp_path):
    """Nothing is set on the library: a special token in a text has its own id, wherever it stands."""
    special = ["hello <|endoftext|> world", "a<|endoftext|>b", "<|startoftext|>", "x <|endoftext|><|startoftext|>!? y", "<|STARTOFTEXT|> <|endoftext", "é<|endoftext|>\u0301 it's", "<|endoftext|>\n<|endoftext|>"]
    texts = [*special, *odd_texts(), *special_texts(Tokenizer.from_file(WORDS))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = T.read_token_files(spark, T.write_token_files(df, WORDS, f"file://{tmp_path}/special"), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    assert tokenizer.encode(special[0], add_special_tokens=False).ids == [3306, 49407, 1002]
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


def test_files(spark, tmp_path, edge, edge_rows, documents):
    tokenizer = Tokenizer.from_file(WORDS)
    for n, (df, rows) in enumerate(((edge, [r[:2] for r in edge_rows]), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()]))):
        root = T.write_token_files(df, WORDS, f"file://{tmp_path}/{n}")
        out = T.read_token_files(spark, root, with_ids=True).collect()
        want = {}
        for i, t in rows:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
        got = {}
        for r in out:
            got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        ordered = sorted(out, key=lambda r: r["start"])
        starts = np.cumsum([0, *(r["n_tokens"] for r in ordered)])
        assert [r["start"] for r in ordered] == starts[:-1].tolist() and T.read_manifest(root)["ids"] == starts[-1]
        ids = [r["doc_id"] for r in ordered]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert T.read_token_files(spark, T.write_token_files(edge.limit(0), WORDS, f"file://{tmp_path}/none")).count() == 0
