import random

import xxhash

from parapet.llm import simhash
from parapet.llm.components import components


def brute_print(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    runs = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), seed=42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    named = {}
    for i, name in enumerate(ids):
        if name is not None:
            r = root(i)
            named[r] = min(named.get(r, name), name)
    return [named.get(root(i)) for i in range(len(ids))]


def near_texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 200, 400)))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
    return texts + ["One Two", "one\ttwo", "ONE", "", None, " \n", "Été À", "été à"]


def test_groups_equal_brute_force(spark, documents):
    texts = near_texts()
    ids = [1000 - i for i in range(len(texts))]
    rows = [(i, t, "en", "s") for i, t in zip(ids, texts)]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [found[i]["fp"] % (1 << 64) for i in ids] == prints
    assert [found[i]["component_id"] for i in ids] == brute_components(ids, prints)


def test_links_at_every_distance(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base * 5]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in base + near})
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = {tuple(r) for r in simhash.links(df).collect()}
    mask = (1 << 64) - 1
    wanted = {
        (a, b) for a in values for b in values
        if a < b and ((a ^ b) & mask).bit_count() <= 3
    }
    assert found == wanted and wanted


def test_keeps_one_of_each_group(spark, documents):
    rows = [
        (5, "a b c d", "en", "s"), (3, "a b c d", "en", "s"), (3, "a b c d", "en", "s"),
        (None, "a b c d", "en", "s"), (9, "", "en", "s"), (8, None, None, None),
        (None, "only null id", "en", "s"), (None, "only null id", "en", "s"),
    ]
    docs = documents(rows, "fp label key component_id")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect())
    assert found == [(0, "only null id"), (3, "a b c d"), (8, None)]
    assert simhash.deduplicated(documents([])).collect() == []


def test_near_copies_go_and_others_stay(spark, documents):
    """Of each brute-force group the smallest id stays, with its whole row."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for j in range(3):
            copy = list(base)
            if j:
                copy[rng.randrange(300)] = "edited"
            rows.append((1000 - 10 * i - j, " ".join(copy), "en", "s"))
        rows.append((2000 + i, " ".join(base[:200] + [rng.choice(vocabulary) for _ in range(100)]), "en", "s"))
    groups = brute_components([r[0] for r in rows], [brute_print(r[1]) for r in rows])
    wanted = sorted(r for r, g in zip(rows, groups) if r[0] == g)
    assert len(wanted) < len(rows) - 60
    docs = documents(rows, "_id _own _row _hash fp label text_hash given hash id")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in kept.collect()) == wanted


def test_large_group_lists_few_links(spark):
    """The links that leave the tasks grow with a group, not with its square, and connect it all the same."""
    rng = random.Random(1)
    base = rng.getrandbits(32)
    prints = {(base << 32) | rng.getrandbits(32) for _ in range(4)}
    prints |= {p ^ (1 << i) ^ (1 << j) for p in prints for i in range(64) for j in range(i)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    near = simhash.stars(nodes, 3)
    labels = components(near).withColumnRenamed("node", "fp")
    grouped = nodes.join(labels, "fp", "left").selectExpr("fp", "coalesce(label, fp) as label")
    pairs = simhash.links(grouped, 3, apart="label", once=False)
    between = simhash.forest(pairs)
    assert pairs.count() > 20 * len(signed)
    assert near.count() + between.count() < 6 * len(signed)
    found = {r["node"]: r["label"] for r in components(near.union(between)).collect()}
    plain = {r["node"]: r["label"] for r in components(simhash.links(nodes, 3)).collect()}
    assert found == plain


def test_empty_table_and_long_text(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    text = "lorem " * 200_000
    (row,) = simhash.near_duplicates(documents([(1, text, "en", "s")])).collect()
    assert row["fp"] % (1 << 64) == xxhash.xxh64_intdigest(b"lorem lorem lorem", seed=42)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(7, 3), (7, 7), (100, 99)], "a bigint, b bigint")
    found = {r["node"]: r["label"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def test_links_of_five_bits_equal_brute_force(spark):
    rng = random.Random(11)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for high, low in ((2, 2), (2, 3), (3, 2), (4, 1), (5, 0), (3, 3), (2, 4), (2, 1)):
            flips = rng.sample(range(32, 64), high) + rng.sample(range(32), low)
            prints.add(base ^ sum(1 << bit for bit in flips))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    for most in (3, 4, 5, 6):
        found = simhash.links(frame, most).collect()
        near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= most
        wanted = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if near(a, b)}
        assert {(r["a"], r["b"]) for r in found} == wanted and len(found) == len(wanted)
