"""Byte-level BPE against the tokenizer library, round trips, appends and edits."""

import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from parapet.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LETTERS = "aeiouäß é\n\t  '''stvlmrd0123456789…—漢字ا͸\U0001f600₏\U00011de0.,!?-=\xa0  "


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.fixture(scope="module")
def split():
    return byte_bpe.Splitter(PATTERN, byte_bpe.exact_pattern(PATTERN))


def random_text(pick, most=40):
    def letter():
        if pick.random() < 0.7:
            return pick.choice(LETTERS)
        return chr(pick.choice([pick.randrange(0x20, 0xD800), pick.randrange(0xE000, 0x20000)]))

    return "".join(letter() for _ in range(pick.randrange(most)))


def test_texts_equal_the_library(spark, data, vocabulary, library, split):
    pick = random.Random(1)
    texts = [random_text(pick) for _ in range(5000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["ab" * 20_000, "é" * 5000, " " * 9000, "=" * 9000 + "x", "<|endoftext|>", "don't we'll 'r e", " \n \n x  "]
    code = byte_bpe.Encoder(vocabulary)
    found = code([split.of(text).findall(text) for text in texts])
    for text, ids in zip(texts, found):
        assert memoryview(ids).cast("i").tolist() == library.encode_ordinary(text)


def test_classes_are_the_librarys(split):
    """Every character alone and between letters is cut as the library cuts it."""
    single = {bytes([i]): i for i in range(256)}
    for low in range(0, 0x20000, 997):
        text = "".join(f"x{chr(c)}1{chr(c)}" for c in range(low, low + 997) if not 0xD800 <= c < 0xE000)
        for cut in (r"\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+"):
            own = byte_bpe.Splitter(cut, byte_bpe.exact_pattern(cut)).of(text).findall(text)
            theirs = tiktoken.Encoding("c", pat_str=cut, mergeable_ranks=single, special_tokens={})
            assert "".join(own).encode() == bytes(theirs.encode_ordinary(text))


def test_appends_and_edits_equal_a_new_start(library, vocabulary, split):
    pick = random.Random(2)
    new = changed = 0
    for turn in range(1500):
        text = pick.choice(["ab", "the", "xyz", "1", "="]) * 300 if turn % 30 == 0 else random_text(pick, 80)
        own = byte_bpe.Encoded(vocabulary, split, text.encode())
        assert own.ids() == library.encode_ordinary(text)
        new, own.worked = new + own.worked, 0
        for _ in range(4):
            start = pick.choice([len(text), pick.randrange(len(text) + 1)])
            end = min(len(text), start + pick.choice([0, 0, 1, 3]))
            put = random_text(pick, 4)
            at = len(text[:start].encode())
            own.replace(at, at + len(text[start:end].encode()), put)
            text = text[:start] + put + text[end:]
            assert own.data == text.encode()
            assert own.ids() == library.encode_ordinary(text)
            assert own.last == byte_bpe.Encoded(vocabulary, split, text.encode()).last
        changed += own.worked


def test_work_stays_near_the_edit(vocabulary, library, split):
    own = byte_bpe.Encoded(vocabulary, split, b"ab" * 50_000)  # one piece
    own.worked = 0
    own.replace(50_000, 50_001, "q")
    own.append("c and d")
    assert own.worked < 200
    assert own.ids() == library.encode_ordinary(own.data.decode())


def test_small_vocabulary_with_ranks_out_of_order(split):
    """Ranks that do not grow with the merges still give what merging gives."""
    ranks = {bytes([i]): i + 100 for i in range(256)}
    ranks |= {b"ab": 20, b"abc": 10, b"bc": 30, b"ca": 5, b"cab": 40, b"abab": 3}
    own, theirs = byte_bpe.Vocabulary(ranks), tiktoken.Encoding("o", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})
    pick = random.Random(3)
    for _ in range(2000):
        text = "".join(pick.choice("abc") for _ in range(pick.randrange(2, 9)))
        if own.ranks.get(text.encode()) is None:
            assert own.merged(text.encode()) == theirs.encode_ordinary(text)


ROWS = [
    (1, "Hello there, Wörld 123!", "en", "web"), (2, None, "en", "web"), (3, "", None, None),
    (1, "Hello there, Wörld 123!", "en", "web"), (None, "\x00  ퟿", "xx", "web"), (5, "z" * 70_000, "en", "web"),
]


def test_table(documents, library):
    docs = documents(ROWS, "ids last data c0")
    coded = byte_bpe.encode(docs, PATH, PATTERN)
    rows = byte_bpe.decode(coded, PATH).collect()
    wanted = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS]
    key = lambda r: (r[0] or 0, r[2])
    assert sorted([(r["doc_id"], r["ids"], bytes(r["data"])) for r in rows], key=key) == sorted(wanted, key=key)
    assert byte_bpe.decode(byte_bpe.encode(documents([]), PATH, PATTERN), PATH).collect() == []


def test_decode_of_other_tables(spark):
    given = spark.createDataFrame([("x", [256, 97], 1), ("y", None, 2), ("z", [], 3), ("u", [0xC3], 4)], "`a.b` string, ids array<int>, c1 int")
    found = {r["c1"]: bytes(r["data"]) for r in byte_bpe.decode(given, PATH).collect()}
    tokens = byte_bpe.read_vocabulary(PATH).tokens
    assert found == {1: tokens[256] + tokens[97], 2: b"", 3: b"", 4: tokens[0xC3]}


def test_revised_table(spark, documents, library):
    from pyspark.sql import functions as F

    docs = documents([(i, t, "en", "web") for i, t in enumerate(["one two", "", None, "Größe  ", "abc" * 300])])
    stored = docs.select("doc_id", "text").join(byte_bpe.encode(docs, PATH, PATTERN, with_last=True), "doc_id")
    edits = stored.withColumns({"at": F.when(F.col("doc_id") != 3, F.lit(3)).cast("int"), "until": F.lit(4), "put": F.lit(" né")})
    found = {r["doc_id"]: (r["text"], r["ids"], r["last"]) for r in byte_bpe.revise(edits, PATH, PATTERN).collect()}
    texts = {0: "one nétwo", 1: " né", 2: " né", 3: "Größe   né", 4: "abc né" + ("abc" * 300)[4:]}
    assert {i: (f[0], f[1]) for i, f in found.items()} == {i: (t, library.encode_ordinary(t)) for i, t in texts.items()}
    again = documents([(i, t, "en", "web") for i, t in texts.items()])
    fresh = byte_bpe.encode(again, PATH, PATTERN, with_last=True).collect()
    assert {r["doc_id"]: r["last"] for r in fresh} == {i: f[2] for i, f in found.items()}


def test_array_is_four_bytes():
    assert array("i").itemsize == 4
