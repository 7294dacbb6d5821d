import hashlib
import random
import re

import numpy as np
import pytest

from parapet.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows):
    """``doc_id -> (n_words, n_removed, sha)`` by comparing all windows; ``doc_id`` unique."""
    split = {i: WORD.findall(t or "") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(split, key=lambda i: (i is None, i or 0)):
        words = split[i]
        gone = set()
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone.update(range(at, at + 20))
            seen.add(window)
        kept = " ".join(w for at, w in enumerate(words) if at not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, documents, rows, **options):
    docs = documents([(i, t, "en", "s") for i, t in rows], "k1 spans occurrences")
    found = passages.deduplicated(docs, **options).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found}
    assert len(found) == len(rows) and got == brute_force(rows)
    return found


def corpus(seed, many=60, vocabulary=4000):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcÄéß')}{i}" for i in range(vocabulary)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (19, 20, 21, 33, 60, 150)]
    texts = []
    for _ in range(many):
        text = [rng.choice(words) for _ in range(rng.choice((0, 5, 25, 120)))]
        for _ in range(rng.randrange(4)):
            part = rng.choice(shared)
            low = rng.randrange(len(part))
            part = part[low:] if rng.random() < 0.4 else part
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        texts.append(" \n".join(text) + rng.choice(("", "\n", "  ")))
        if rng.random() < 0.2:
            changed = texts[-1].split()
            if changed:
                changed[rng.randrange(len(changed))] = "Other"
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, documents, seed):
    rows = corpus(seed)
    assert any(r["n_removed"] for r in check(spark, documents, rows))


def test_few_words_and_repeats_inside(spark, documents):
    rng = random.Random(5)
    loop = " ".join(rng.choice("xyz") for _ in range(400))
    rows = [(2, "a " * 45), (1, "a " * 30), (7, loop), (8, loop[::-1]), (9, "b c " * 2000), (None, "a " * 21), (4, None), (5, "")]
    check(spark, documents, rows)


def test_hot_passage_in_many_contexts(spark, documents):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{rng.random()} {rng.random()} {passage} {rng.random()} end") for i in range(300)]
    found = check(spark, documents, rows)
    assert sorted(r["n_removed"] for r in found)[:2] == [0, 40]


def test_repeated_rows_and_text(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text, "en", "s"), (3, text, "en", "s"), (4, f"x {text}", "en", "s"), (5, "short one", "en", "s")]
    found = passages.deduplicated(documents(rows), with_text=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in found) == [
        (3, 0, text), (3, 0, text), (4, 30, "x"), (5, 0, "short one"),
    ]


def test_empty_table(spark, documents):
    assert passages.deduplicated(documents([])).collect() == []


def test_automaton_finds_every_occurrence():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(200)).encode() for _ in range(4)]
    first = passages.Words()(texts[0].split())
    wanted = np.unique(passages.phrases(passages.Ranges(first), 200)[:20])
    found = passages.locate(texts, [wanted, np.zeros(0, np.uint64)] + [np.zeros(0, np.uint64)] * 2)
    for text, (_, _, at, name) in zip(texts, found):
        hashes = passages.Words()(text.split())
        here = passages.phrases(passages.Ranges(hashes), 200)
        assert at.tolist() == np.flatnonzero(np.isin(here, wanted)).tolist()
        assert (here[at] == name).all()


def test_hashes_depend_on_the_word_alone():
    """Not on its place, on what stands around it or on how texts are cut; also if words are very long."""
    rng = random.Random(3)
    morse = b"a"
    while len(morse) < 4096:
        morse += morse.translate(bytes.maketrans(b"ab", b"ba"))
    words = [b"a", b"b", b"ab", b"ba", b"abba", b"baab", "İß漢".encode(), b"\x1c\xc2\x85", morse, morse.translate(bytes.maketrans(b"ab", b"ba"))]
    words += [b"x" * n for n in (255, 256, 257, 70_000)] + [f"w{i}".encode() for i in range(3000)]
    alone = {w: int(passages.Words()([w])[0]) for w in words}
    assert len(set(alone.values())) == len(words)
    texts = [b"", b" \t\n"]
    for _ in range(60):
        texts.append(b"".join(rng.choice(words) + rng.choice((b" ", b"\n", b" \x0b\x0c\r\t")) for _ in range(rng.randrange(900))))
    found = passages.Words().of(texts)
    assert [x.tolist() for x in found] == [[alone[w] for w in t.split()] for t in texts]
    assert passages.Words().of([]) == []


def test_only_documents_of_recurring_phrases_are_located(spark, documents):
    """The text of any other document is read where it lies and goes to no join."""
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(60)), "en", "s") for i in range(200)]
    rows += [(200 + i, f"{rng.random()} {shared} {rng.random()}", "en", "s") for i in range(5)]
    every, located, spans = passages.repeated(documents(rows))
    assert every.count() == 205
    assert sorted(r["doc_id"] for r in located.select("doc_id").collect()) == list(range(200, 205))
    assert spans.count() == 4


def test_marks_lose_no_key(spark):
    from pyspark.sql import functions as F

    from parapet.llm.common import among

    every = spark.range(20_000).select("id", F.xxhash64("id").alias("k"))
    keys = every.filter("id % 10 = 3")
    passed = {r["id"] for r in among(every, keys, "k").collect()}
    assert passed >= set(range(3, 20_000, 10)) and len(passed) < 4000
    assert among(every, keys.limit(0), "k").count() == 0
