import hashlib
import random

import pytest

from lociweave.llm import bpe_prefix, token_counts
from lociweave.llm.queries import piece_pattern, tokenizer


@pytest.fixture(scope="module")
def path():
    return tokenizer(bpe_prefix.VOCABULARY)


@pytest.fixture(scope="module")
def library(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=piece_pattern(), mergeable_ranks=bpe_prefix.load(path).ranks, special_tokens={})


LETTERS = "aabcdeehilnorst  \n\t.,éüßñ0123#&%日本\U0001f600AB'"


def test_encoding_equals_the_library(path, library):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 80)))
        assert bpe_prefix.encode_text(text, path, piece_pattern()) == library.encode_ordinary(text)


def test_small_vocabularies_against_merging():
    """Merging by rank, lowest and leftmost first, over vocabularies made of random merges."""
    rng = random.Random(2)
    for _ in range(60):
        ranks = {bytes([c]): k for k, c in enumerate(b"abc")}
        while len(ranks) < 25:
            text = bytes(rng.choice(b"abc") for _ in range(60))
            ids = _merge(text, ranks)
            k = rng.randrange(len(ids) - 1)
            ranks.setdefault(ids[k] + ids[k + 1], len(ranks))
        model = bpe_prefix.PrefixBPE(ranks)
        for _ in range(60):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
            want = [ranks[p] for p in _merge(piece, ranks)]
            assert model.walk(model.grow(piece, [])) == want


def _merge(text, ranks):
    parts = [text[k : k + 1] for k in range(len(text))]
    while True:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return parts
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_appends_and_edits(path):
    model, rng = bpe_prefix.load(path), random.Random(3)
    for _ in range(200):
        text = bytes(rng.choice(b"abcdet hinos") for _ in range(rng.randint(0, 300)))
        e = bpe_prefix.EditableEncoding(model)
        e.append(text[:40])
        e.append(text[40:])
        a = rng.randint(0, len(text))
        b = rng.randint(a, min(len(text), a + 9))
        new = bytes(rng.choice(b"abcdet hinos") for _ in range(rng.randint(0, 9)))
        e.edit(a, b, new)
        assert e.piece == text[:a] + new + text[b:] and e.ids() == model.walk(model.grow(e.piece, []))


def test_an_edit_stays_near(path):
    e = bpe_prefix.EditableEncoding(bpe_prefix.load(path))
    e.append(b"the cat sat on a mat " * 200)
    assert e.edit(5, 6, b"u") < 200


def test_encoding_table(spark, path, library, monkeypatch):
    monkeypatch.setattr(bpe_prefix, "CACHE", 3)
    texts = [None, "", "Hello world", "Hello world", "x" * 3000 + " é\n" * 500]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, N_TOKENS int")
    out = bpe_prefix.with_encoding(docs, path, piece_pattern(), ids=True)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    for r in out.collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe_prefix.with_encoding(docs.limit(0), path, piece_pattern()).count() == 0


def _greedy(word, vocabulary, mark):
    at = n = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (mark if at else b"") + word[at:end] in vocabulary:
                at, n = end, n + 1
                break
        else:
            return -1
    return n


def test_longest_match_against_brute_force():
    rng = random.Random(4)
    for _ in range(800):
        mark = rng.choice([b"", b"##"])
        vocabulary = {(rng.choice([mark, b""]) if mark else b"") + bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        automaton = token_counts.LongestMatch(vocabulary, mark)
        for _ in range(20):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9)))
            assert automaton.count(word) == _greedy(word, vocabulary, mark)


def test_count_table(spark):
    import regex

    path = tokenizer(token_counts.VOCABULARY)
    texts = [None, "", "Greedy pieces, greedy pieces", "ßé\n" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = set(bpe_prefix.load(path).ranks)
    for r in token_counts.with_counts(docs, path, piece_pattern()).collect():
        words = regex.findall(piece_pattern(), texts[r["doc_id"]] or "")
        assert (r["n_words"], r["n_pieces"], r["n_unknown"]) == (len(words), sum(_greedy(w.encode(), vocabulary, b"") for w in words), 0)
