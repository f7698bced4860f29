"""Trie BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lociweave.llm import bpe_trie
from lociweave.llm.queries import op12_bpe_trie, piece_pattern, tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe_trie.VOCABULARY))


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_query(spark, library, sf="/root/testdata/sf0.001"):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op12_bpe_trie(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert tuple(r) == (r["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def odd_texts() -> list:
    r = random.Random(12)
    parts = ["a", "aa", "aaa", "the", " ", "  ", "\n", "\t", "'s", "1", "<|endoftext|>", "<|endof", "text|>", "ing", "ß", "漢字", "🙂", "՘", "\U00010940", "\x1c", "\x85", " "]
    ranges = [(32, 127), (0x80, 0x600), (0x600, 0xD800), (0xE000, 0x110000)]
    found = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(400)]
    found += ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(60))) for _ in range(400)]
    return [*found, "", None, "<|endoftext|>", " <|endoftext|> ", "x" * 30_000, "ab" * 20_000, " " * 5000, "word " * 40_000]


def test_odd_texts_and_columns(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(odd_texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, N_tokens string").repartition(3)
    path = tokenizer(bpe_trie.VOCABULARY)
    found = bpe_trie.with_token_ids(df, path, piece_pattern(), decoded="decoded")
    assert found.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    again = bpe_trie.with_decoded(found, path, decoded="again").collect()
    assert len(again) == len(rows)
    for r in again:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], bytes(r["token_ids"])) == (len(ids), packed(ids)), repr(r["text"])[:80]
        assert r["decoded"] == r["again"] == library.decode(ids, skip_special_tokens=False)
    assert bpe_trie.with_token_ids(df.limit(0), path, piece_pattern()).count() == 0


def test_words_share_nodes_and_cache_starts_afresh(monkeypatch):
    trie = bpe_trie.WordTrie([b"car", b"cart", b"cat", b"dog", b"do"])
    assert len(trie.byte) == 8 and trie.words == [b"car", b"cart", b"cat", b"do", b"dog"]
    assert list(trie.depth) == [0, 1, 2, 3, 2, 0, 1, 2]
    monkeypatch.setattr(bpe_trie, "CACHE_BYTES", 500)
    model = bpe_trie.load(tokenizer(bpe_trie.VOCABULARY))
    cache = bpe_trie.WordCache(model)
    for k in range(50):
        words = [f"word{k}", f"wor{k}", "same"]
        cache.learn([words])
        assert all(b"".join(model.bytes_of[i] for i in np.frombuffer(cache[w], "<u4").tolist()) == w.encode() for w in words)
    assert len(cache) < 20


def test_decoding_replaces_broken_bytes(spark, library):
    rows = [(packed(ids),) for ids in ([255], [50256, 160, 50256], [], [300, 5, 7])] + [(None,)]
    path = tokenizer(bpe_trie.VOCABULARY)
    for r in bpe_trie.with_decoded(spark.createDataFrame(rows, "token_ids binary"), path).collect():
        ids = None if r["token_ids"] is None else np.frombuffer(bytes(r["token_ids"]), "<u4").tolist()
        assert r["decoded"] == (None if ids is None else library.decode(ids, skip_special_tokens=False))


def small_file(tmp_path, **changes):
    letters = bpe_trie.byte_letters()
    vocab = {c: k for k, c in enumerate(letters)}
    merges = [["a", "a"], ["aa", "a"], ["b", "aa"], ["a", "b"], ["Ġ", "a"]]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    file = json.loads(Tokenizer.from_file(public_tokenizers.path(bpe_trie.VOCABULARY)).to_str())
    file["model"] |= {"vocab": vocab, "merges": merges} | {k: v for k, v in changes.items() if k in ("ignore_merges", "dropout", "merges")}
    file["added_tokens"] = [t | {"id": len(vocab)} for t in file["added_tokens"]]
    if "normalizer" in changes:
        file["normalizer"] = changes["normalizer"]
    path = tmp_path / "small.json"
    path.write_text(json.dumps(file))
    return str(path)


@pytest.mark.parametrize("whole", [False, True])
def test_pairs_decide_and_not_strings(tmp_path, whole):
    path = small_file(tmp_path, ignore_merges=whole)
    library, model = Tokenizer.from_file(path), bpe_trie.load(path)
    r = random.Random(5)
    words = {"".join(r.choice("aab") for _ in range(r.randrange(1, 12))) for _ in range(3000)}
    for word, ids in bpe_trie.encode_words(model, [w.encode() for w in words]):
        assert ids == packed(library.encode(word.decode()).ids), word


def test_other_kinds_of_files_are_refused(tmp_path):
    for changes in ({"dropout": 0.5}, {"normalizer": {"type": "Lowercase"}}, {"merges": [["aa", "a"], ["a", "a"]]}):
        with pytest.raises(ValueError):
            bpe_trie.load.__wrapped__(small_file(tmp_path, **changes))
