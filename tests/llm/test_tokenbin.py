import zlib

import numpy as np
import public_tokenizers
from cases import ROWS, awkward, empty
from tokenizers import Tokenizer

from driftmark.llm import tokenbin
from driftmark.session import scratch_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, WORLD!! it's\tthe end", "á á Á İ ΣΣ σς", "<|endoftext|> x<|ENDOFTEXT|>y z<|startoftext|>",
         "\x1c\x85 tabs\x0b\x0cand   lines", "x" * 3000, "naïve café, déjà-vu... (42) 3.14 €5", "", "\U0001f600\U0001f600 ok?!", "don't we'll I'd 'tis",
         "ﬁne Ⅷ ǅ ß ẞ", "## $$$ %%% word### a.b,c", "日本語 テキスト 한국어"]


def test_encoder_is_the_tokenizer():
    tok, enc = Tokenizer.from_file(TOKENIZER), tokenbin.Encoder(TOKENIZER)
    for _ in range(2):  # the second time from the table of pieces
        got = list(enc([t.encode() for t in TEXTS]))
        for t, g in zip(TEXTS, got, strict=True):
            assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), tokenbin.Encoder(path)
    for t, g in zip(TEXTS, enc([t.encode() for t in TEXTS]), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_files(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    folder = scratch_dir(spark, "tok-test")
    manifest = tokenbin.cut(tokenbin.write_tokens(df, TOKENIZER, folder, seq_len=16, batch_rows=4), "m")
    got = sorted(map(tuple, tokenbin.read_documents(manifest).collect()))
    tok, at, want, flat = Tokenizer.from_file(TOKENIZER), 0, [], []
    for d, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        flat += ids
    assert got == want
    for m in manifest.collect():
        batches = list(tokenbin.open_file(m["path"]))
        assert {b.num_rows for b in batches[:-1]} <= {4} and batches[0].schema.field("ids").type.list_size == 16
        own = flat[m["start"]:m["start"] + m["n_tokens"]]
        n = sum(b.num_rows for b in batches)
        seqs = [tokenbin.sequence(batches, i) for i in range(n)]
        assert sum((x[k.to_numpy(zero_copy_only=False)].tolist() for x, k in seqs), []) == own
        whole = seqs[0][0]
        assert not whole.flags.owndata and len(whole) == 16


def test_awkward(spark):
    got = tokenbin.token_files(awkward(spark), TOKENIZER).collect()
    assert len(got) == len(ROWS)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]]).tolist()[:-1]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert tokenbin.token_files(empty(spark), TOKENIZER).collect() == []
