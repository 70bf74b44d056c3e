import random

from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing as P


def test_ids_equal_the_library(vocabulary):
    encoder, library = P.Encoder(open(vocabulary).read()), Tokenizer.from_file(vocabulary)
    texts = ["a  b", "a\n b", "a \n b", "foo.\n\n bar", "x <|endoftext|> y", "it's  don't\t x", " lead", "trail ", "\n", " ", "é b c", "a  b", "", "one two one two", "12 3,4 $$$ x###"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_ids_of_random_texts_equal_the_library(vocabulary):
    rng = random.Random(8)
    signs = "abc ABC  \t\n\r019.,'!?-_éßñçÜ漢字かな\u00a0\u200b\U0001f600\U0001f1e9АбвΩ" + "\u0301"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    encoder, library = P.Encoder(open(vocabulary).read()), Tokenizer.from_file(vocabulary)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_cuts_are_best():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = np.concatenate([[0], np.cumsum(rng.integers(1, 5, 25))])
        penalty, length = rng.integers(0, 4, len(x)), 12
        best = [0.0] + [np.inf] * (len(x) - 1)
        for j in range(1, len(x)):
            best[j] = min(best[i] + length - (x[j] - x[i]) + penalty[j] for i in range(j) if x[j] - x[i] <= length)
        at = P.cuts(x, penalty, length)
        where = {int(v): k for k, v in enumerate(x)}
        cost = sum(length - (b - a) + penalty[where[b]] for a, b in zip([0, *at], at))
        assert cost == best[-1]


def test_round_trip(spark, documents, vocabulary):
    for block in (P.BLOCK_TOKENS, 4096):
        pieces = P.pack(documents, vocabulary, block=block).collect()
        library = Tokenizer.from_file(vocabulary)
        per_sequence = defaultdict(int)
        for p in pieces:
            assert p.offset == per_sequence[p.sequence_id]
            per_sequence[p.sequence_id] += len(p.ids) // 4
        assert max(per_sequence.values()) <= P.LENGTH
        by_doc = defaultdict(list)
        for p in pieces:
            by_doc[p.doc_id].append(p)
        for key, text in ((5, "word " * 6000), (2, None), (6, "ünïcode ßtraße 漢字 words"), (3, "")):
            own = sorted(by_doc[key], key=lambda p: p.start)
            ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
            assert ids == library.encode(text or "", add_special_tokens=False).ids + [1]
            assert {p.doc_tokens for p in own} == {len(ids)} and own[0].start == 0
        assert len([p for p in by_doc[1] if p.start == 0]) == 2


def test_empty(no_documents, vocabulary):
    assert P.pack(no_documents, vocabulary).count() == 0


def test_tail():
    for n in (1, 2, 3, 1300, 2047):
        sizes = np.diff([0, *P.tail(n)])
        assert sizes.sum() == n and all(s & (s - 1) == 0 for s in sizes.tolist())
