"""Leaked passages against a plain alignment, with every kind of disguise."""

import random

from millrace.llm import leakage as K
from millrace.llm.normalise import plain_words

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ran", "tel", "vos", "dim") for c in ("a", "ex", "on", "ir", "us")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def best(doc, passage, edits=6):
    """Most words of an alignment with at most one word in eight edited."""
    top = 0
    before = [[-99] * (edits + 1) for _ in range(len(passage) + 1)]
    for word in doc:
        now = [[-99] * (edits + 1) for _ in range(len(passage) + 1)]
        for j in range(1, len(passage) + 1):
            for e in range(edits + 1):
                value = -99
                if word == passage[j - 1]:
                    value = max(1 if e == 0 else -99, before[j - 1][e] + 1)
                elif e:
                    value = before[j - 1][e - 1]
                if e:
                    value = max(value, before[j][e - 1], now[j - 1][e - 1])
                now[j][e] = value
                if word == passage[j - 1] and value >= 7 * e:
                    top = max(top, value)
        before = now
    return top


def corpus(seed):
    rng = random.Random(seed)
    instruction = "Read the passage below and answer the question that follows it in one short sentence please now."
    items = [(k, f"{instruction} {sentence(rng, 25)} {sentence(rng, 25)} Which goods left the town of {rng.choice(WORDS)} in that year?") for k in range(12)]
    items.append((99, None))
    passages = {k: plain_words(" ".join(t.split(". ", 1)[1].rsplit(". ", 1)[0] for t in [t])) for k, t in items if t}
    docs = [(0, None), (1, ""), (2, instruction * 2), (3, sentence(rng, 60))]
    for n in range(90):
        item = rng.randrange(12)
        start, size = rng.randrange(30), rng.choice([10, 12, 13, 14, 15, 16, 20, 30])
        piece = passages[item][start : start + size]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(piece))
            action = rng.randrange(3)
            piece = piece[:at] + ([] if action == 0 else ["other"] if action == 1 else ["added", piece[at]]) + piece[at + 1 :]
        docs.append((10 + n, f"{sentence(rng, 20)} {' '.join(piece)} {sentence(rng, 20)}"))
    return items, passages, docs


def test_as_plain_alignment(spark):
    items, passages, docs = corpus(7)
    found = {tuple(r) for r in K.leaks(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    expected = {(d, k) for d, t in docs for k, p in passages.items() if best(plain_words(t), p) >= K.LEAST_WORDS}
    assert found == expected and len(found) > 30


def test_passages_leave_out_instruction_and_question(spark):
    items, passages, _ = corpus(8)
    got = {r.item_id: list(r.words) for r in K.passages(spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    assert got == passages


def test_disguises(spark):
    items, passages, _ = corpus(9)
    words = passages[3][5:22]
    forms = [
        " ".join(words).upper(), "\n".join(words), "<b>" + "</b> <i>".join(words) + "</i>", " ".join(words).replace("a", "а").replace("o", "ο"),
        " ".join(w[0] + "​" + w[1:] for w in words), "\\n".join(words), "&nbsp;".join(words), " ".join(words).replace("e", "é"), ", ".join(words), "*" + "* *".join(words) + "*",
    ]
    docs = [(k, f"before it {form} after it") for k, form in enumerate(forms)]
    found = {tuple(r) for r in K.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    assert found == {(k, 3) for k in range(len(forms))}


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    items, _, docs = corpus(10)
    documents, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    whole = {tuple(r) for r in K.leaks(documents, table).collect()}
    monkeypatch.setattr(K, "INDEX_CHARS", 1500)
    assert {tuple(r) for r in K.leaks(documents, table).collect()} == whole
    assert K.leaks(documents.limit(0), table).count() == 0 and K.leaks(documents, table.limit(0)).count() == 0


def test_every_print_within_the_radius_is_near():
    rng = random.Random(2)
    items = [(k, [rng.choice(WORDS) for _ in range(40)]) for k in range(5)]
    index = K.ItemIndex(items)
    index.prepare()
    import numpy as np

    prints = index.prints[rng.sample(range(len(index.prints)), 60)].copy()
    for k in range(len(prints)):
        for bit in rng.sample(range(64), k % 5):
            prints[k] ^= np.uint64(1 << bit)
    windows, entries = index.near(prints, np.ones(len(prints), bool))
    got = set(zip(windows.tolist(), entries.tolist()))
    assert got == {(a, b) for a in range(len(prints)) for b in range(len(index.prints)) if int(prints[a] ^ index.prints[b]).bit_count() <= K.RADIUS}
