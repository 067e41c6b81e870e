"""Token ids against the public library, and the segment tree against a plain scan."""

import random
from pathlib import Path

import pytest

from millrace.llm import token_ids as K

FILES = Path(K.TOKENIZERS)
needs_files = pytest.mark.skipif(not (FILES / K.VOCABULARY).exists(), reason="no vocabulary here")

ODD = [
    "", " ", "  a", "a  ", "\x1c\x1d x", "É" * 3000, "aaaa" * 2000, "<|endoftext|>", "ﬁ́ ½ ² ٣ 漢字 \U0001f600  \n\n x", "it's I'LL we've don't",
    "\xa0\xa0x", "àb", "　 z", "﻿k​", "=" * 999, "tab\tand\r\nline", "\n \n", "x" * 40_000,
]


@needs_files
def test_same_as_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(FILES / "byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(1)
    letters = "abc éß ñ.,!?'\n\t 0123 дλ漢😀-_{}[]"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(300)]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in K.token_ids(frame).collect()}
    for k, text in enumerate(texts):
        assert got[k] == library.encode(text, add_special_tokens=False).ids, text[:40]


@needs_files
def test_round_trip_null_and_empty(spark):
    ranks = K.read_ranks(str(FILES / K.VOCABULARY))
    back = {v: k for k, v in ranks.items()}
    rows = [(1, None), (2, ""), (None, "a text"), (3, "Größe – 12 €"), (3, "Größe – 12 €")]
    got = K.token_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(list(r.ids))
    assert by[1] == [[]] and by[2] == [[]] and by[3][0] == by[3][1]
    assert b"".join(back[i] for i in by[3][0]).decode() == "Größe – 12 €"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert K.token_ids(empty).count() == 0


def test_tree_gives_leftmost_lowest():
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 64, 65):
        ranks = [rng.randrange(5) for _ in range(size)]
        tree = K.RankTree(list(ranks))
        for _ in range(60):
            best = min(ranks)
            assert tree.lowest() == (ranks.index(best) if best < K.NO_PAIR else -1)
            at = rng.randrange(size)
            ranks[at] = rng.choice([rng.randrange(5), K.NO_PAIR])
            tree.set(at, ranks[at])


def test_merge_as_plain_scan():
    rng = random.Random(4)
    ranks = {bytes([b]): b for b in b"abcd"}
    while len(ranks) < 60:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        if len(a + b) < 7:
            ranks.setdefault(a + b, 100 + len(ranks))

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            pairs = [(ranks.get(a + b, K.NO_PAIR), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == K.NO_PAIR:
                return [ranks[p] for p in parts]
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for _ in range(300):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40)))
        if piece not in ranks:
            assert K.merge(piece, ranks) == plain(piece)
