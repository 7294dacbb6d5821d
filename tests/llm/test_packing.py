import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parapet.llm import packing
from parapet.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = [
    "It's 3.14 o'clock, isn't it?", "Ärger im ÉTÉ  \n x", "é ́b", "<|endoftext|> mid<|startoftext|>dle",
    "", None, "ΟΔΟΣ ΣΑΣ", "a" * 3000, "日本語 テキスト 12345", "tab\tand\x0bline\x0cfeed\r\n", "\x1c\x85  odd",
]


def test_pieces_equal_the_tokenizer(spark, documents, tokenizer):
    long = " ".join(f"word{i} and, more." for i in range(3000))
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS + [long, "It's"])]
    cut = packing.pieces(documents(rows), tokenizer_path(), with_ids=True).collect()
    found = defaultdict(list)
    for r in sorted(cut, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(found[r["doc_id"]]) == 2048 * r["piece"]
        assert r["length"] == len(r["ids"]) <= 2048
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        found[r["doc_id"]] += r["ids"]
    for i, t, *_ in rows:
        assert found[i] == tokenizer.encode(t or "", add_special_tokens=False).ids + [0], t


def one_by_one(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 64, 100))
    lengths = [rng.randint(1, rng.choice((capacity, capacity // 3))) for _ in range(rng.choice((1, 40, 400)))]
    counts = Counter(lengths)
    used, seen = defaultdict(list), Counter()
    for length, rank, first, each, offset in packing.plan(counts, capacity):
        assert rank == seen[length]
        ends = [r for r in packing.plan(counts, capacity) if r[0] == length and r[1] > rank]
        n = (min(r[1] for r in ends) if ends else counts[length]) - rank
        seen[length] += n
        for j in range(n):
            used[first + j // each].append((offset + j % each * length, length))
    assert seen == counts
    for slots in used.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == one_by_one(lengths, capacity)


def test_packs_without_gaps(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randrange(300)), "en", "s") for i in range(300)]
    rows += [(None, "x", None, None), (None, "x", None, None), (4, "again", "en", "s"), (5, None, "en", "s")]
    packed = packing.pack(documents(rows, "rank length sequence_id _row"), tokenizer_path(), capacity=256).collect()
    slots = defaultdict(list)
    for r in packed:
        slots[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in slots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len({r["doc_id"] for r in packed}) == 301 and sum(r["piece"] == 0 for r in packed) == 304


def test_empty_table(spark, documents):
    assert packing.pack(documents([]), tokenizer_path()).collect() == []


def test_random_texts_equal_the_tokenizer():
    """Words of any script and case with what may stand behind them, letters that become two among them."""
    import random

    from tokenizers import Tokenizer

    rng = random.Random(8)
    path = tokenizer_path()
    plain, encode = Tokenizer.from_file(path), packing.Encoder(path)
    letters = "abzAZÄößẞİıſKéÉΣςσДж漢字ا̇́…—'’\"().,;:!?0123456789-_/"
    texts = ["TARİHİ: 1923", "İ.", "ẞ!", "Σ.", "KK;"]
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 6))) for _ in range(20_000)]
    for text in texts:
        wanted = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == wanted, text


def test_tasks_of_a_worker_share_the_encoder(spark, documents):
    """Parts met by one task need no tokenizer in the next."""
    path = tokenizer_path()
    first = packing.kept_encoder(path)
    first("wholly unusual wordings")
    again = packing.kept_encoder(path)
    assert again is first and b"wordings" in again


def test_new_words_of_a_block_go_together():
    """One call for many words, with the ids that each has alone, also beside words that are several to the tokenizer."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    plain, encode = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    calls = []

    class Counted:
        def encode(self, *args, **options):
            calls.append(args)
            return plain.encode(*args, **options)

    encode.tokenizer = Counted()
    words = ["".join(rng.choice("aeinrstÄöéж漢Σ") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    block = [" ".join(rng.choice(words) + rng.choice(("", ".", ",")) for _ in range(50)) for _ in range(60)]
    found = encode.block(block)
    assert len(calls) < 200
    odd = ["ıİi", "İ", "ᄀ ᅡ ᆨ", "ﬁ", "ǅ", "ſ", "o'clock's", "<|endoftext|>", "", "a" * 300, "ªº", "ͅα"]
    odd = [" ".join(rng.sample(odd + words, 8)) for _ in range(400)] + odd
    for text, ids in zip(block + odd, found + encode.block(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    vocabulary = plain.get_vocab()
    letters = {token for token in vocabulary if len(token) == 1}
    assert len(letters) == 256 and all(x + "</w>" in vocabulary for x in letters)  # so no word is without an end
