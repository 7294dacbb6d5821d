"""Registered queries against their SQL twins or plain rules, over whole given tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from parapet.llm.oracles import ORACLES
from parapet.llm.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    result = sql.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "int": "INTEGER"}
    assert {n: kinds[k] for n, k in df.dtypes} == {c[0]: str(c[1]) for c in result.description}
    order = sorted(names)
    found = sorted(tuple(r[n] for n in order) for r in df.collect())
    wanted = sorted(tuple(r[names.index(n)] for n in order) for r in result.fetchall())
    assert found == wanted


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


COLUMNS = {
    "op1_hyperdimensional_languages": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_wrapper_text": ["page_id", "url", "text", "n_chars"],
    "op3_ring_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_simhash_groups": ["doc_id", "fingerprint", "component_id"],
    "op7_projected_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op8_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9_repeated_passages": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_feistel_pseudonyms": ["doc_id", "text", "n_values"],
    "op11_streamed_repair": [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ],
    "op12_prefix_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13_sharded_lloyd": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    table = "pages" if "page_id" in df.columns else "embeddings" if "vec_id" in df.columns else "documents"
    if name == "op11_streamed_repair":
        assert df.count() == spark.read.parquet(f"{data}/conversations.parquet").select("conv_id").distinct().count()
    elif name not in ("op7_projected_neighbours", "op8_best_fit_packing"):
        assert df.count() == spark.read.parquet(f"{data}/{table}.parquet").count()


def test_passages_of_given_documents(spark, data):
    from .test_passages import brute_force

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op9_repeated_passages"](spark, data).collect()
    wanted = brute_force([tuple(r) for r in rows])
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == wanted


def test_tokens_of_given_documents(spark, data):
    """Every document against the tokenizer library."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from parapet.llm.byte_bpe import read_vocabulary

    ranks = read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        digest = [hashlib.sha256(b).hexdigest() for b in (",".join(map(str, ids)).encode(), text.encode())]
        wanted[r["doc_id"]] = (len(ids), *digest)
    found = QUERIES["op12_prefix_byte_bpe"](spark, data).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == wanted


def test_recall_of_given_vectors(spark):
    """Whole table at 0.01: at least 0.9 of the true neighbours."""
    import numpy as np

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    names = np.array([r["vec_id"] for r in rows])
    data = np.array([r["embedding"] for r in rows], float)
    found: dict[int, set] = {}
    for r in QUERIES["op7_projected_neighbours"](spark, folder).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(names % 20 == 0):
        scores = data @ data[i]
        scores[i] = -np.inf
        best = set(names[np.argsort(-scores)[:20]].tolist())
        hits, total = hits + len(best & found[int(names[i])]), total + 20
    assert hits >= 0.9 * total
