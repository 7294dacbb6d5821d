import random
import re
from collections import defaultdict

import pytest

from parapet.llm import mixing


def targets_by_rounds(sizes, weights=(5, 2, 1), share=1.5, passes=2):
    """Share by weight, stop at the bound, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= passes * sizes[s]]
        if not over:
            return {s: stopped.get(s, level * weight[s]) for s in names}
        stopped |= {s: passes * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice((0, 1, 50, 1000, 7)) for i in range(rng.randint(1, 12))} | {None: 30, "é": 5, "Z": 400}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert found == pytest.approx(targets_by_rounds(sizes))


def table(rng, many=400):
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "en", rng.choice(["a", "b", "c", "hot", "hot", "hot", None])) for i in range(many)]
    return rows + [(900, None, "en", "a"), (901, "", "en", "b"), (902, " \n ", "en", "only empty"), (None, "x y z", None, "a"), (5, "again here", "en", "a"), (5, "again here", "en", "a")]


def test_takes_what_targets_say(spark, documents):
    rows = table(random.Random(1))
    docs = documents(rows, "size taken row target number")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    wanted = targets_by_rounds(sizes)
    by_target = defaultdict(lambda: [0, 0.0])
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[r["source_size"]][0] += r["taken"]
        by_target[r["source_size"]][1] = r["target"]
    for s, size in sizes.items():
        assert by_target[size][1] == pytest.approx(wanted[s])
        assert abs(by_target[size][0] - wanted[s]) <= max(4, 0.01 * wanted[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in found) == sorted((r["doc_id"] or -1, r["taken"]) for r in again)


def test_schedule_interleaves_sources(spark):
    rows = spark.createDataFrame([("a", 6000), ("b", 3000), ("c", 900)], "source string, source_size bigint")
    shares = mixing.targets(rows, weights=(1,)).cache()
    total = shares.agg({"target": "sum"}).first()[0]
    found = mixing.slots(shares, total, 3).orderBy("slot").collect()
    assert [r["slot"] for r in found] == list(range(len(found))) and len(found) == -(-int(total) // 3)
    target = {r["number"]: r["target"] for r in shares.collect()}
    seen = defaultdict(int)
    for i, r in enumerate(found):
        assert r["rank"] == seen[r["number"]]
        seen[r["number"]] += 1
        for number, t in target.items():  # at every moment
            assert abs(seen[number] - (i + 1) * t / total) < 4


def test_mixed_rows_hold_the_words_taken(spark, documents):
    rows = [(i, f"\n first{i}  second third\tfourth\n", "en", "abc"[i % 3]) for i in range(60)] + [(99, None, "en", "a")]
    docs = documents(rows, "_row epoch size")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words, texts = defaultdict(int), {i: t for i, t, *_ in rows}
    for r in out.collect():
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) > 0
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    assert words == taken


def test_no_words_and_empty_table(spark, documents):
    (row,) = mixing.mix(documents([(1, None, "en", None)])).collect()
    assert (row["size"], row["source_size"], row["target"], row["taken"]) == (0, 0, 0.0, 0)
    assert mixing.mix(documents([])).collect() == [] and mixing.mixed(documents([])).collect() == []
