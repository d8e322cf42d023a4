"""The pipeline's stages, each on its own input, and the queries of the subpackage."""

import random

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from attestor.llm import phrases, quality
from tests.llm.conftest import DOC, prose
from tests.llm.test_dedup import brute_fingerprint, brute_passages, classes
from tests.llm.test_records import brute_pii


def corpus(spark, folder):
    rng = random.Random(12)
    base, shared = prose(rng, 150), prose(rng, 70)
    texts = [prose(rng, 120) for _ in range(30)] + [base, base, prose(rng, 80) + "\n" + shared, shared + " " + prose(rng, 80), "few words", None, "Write to ann@mail.example.org " + prose(rng, 90)]
    texts += [" ".join(w + "$$$" for w in prose(rng, 90).split()) for _ in range(12)]
    rows = [(k, t, "en", f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 37), 0) for k in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_equal_plain_python(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = corpus(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = (before, docs)
        if name != "packed_sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in seen["quality_rules"][1].collect()}
    assert not kept & {34, 35} and set(range(34)) <= kept and len(kept & set(range(37, 49))) <= 1
    before, after = seen["near_duplicates"]
    groups = classes([brute_fingerprint(t) for _, t in before])
    least = {}
    for (key, _), c in zip(before, groups):
        least[c] = min(least.get(c, key), key)
    assert sorted(least.values()) == sorted(r["doc_id"] for r in after.collect())
    before, after = seen["repeated_passages"]
    want = {k: n - gone for k, n, gone, _ in brute_passages(before, phrases.WINDOW)}
    assert {r["doc_id"]: len((r["text"] or "").encode().split()) for r in after.collect()} == want
    before, after = seen["personal_data"]
    clean = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(not brute_pii(t) for t in clean.values()) and "[EMAIL]" in clean[36]
    assert all(clean[k] == t for k, t in before if not brute_pii(t))
    before, pieces = seen["packed_sequences"]
    assert {r["doc_id"] for r in pieces.collect()} == {k for k, _ in before}
    whole = corpus_pipeline.run(spark, folder)
    key = lambda f: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in f.collect())
    total = lambda f: sum(len(x[3]) for x in key(f))
    assert total(whole) == total(pieces) and len(rows) == 49


def test_queries_are_registered_once_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in entry.queries()


def test_contract_columns(spark):
    want = {
        "op1": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op4": "query_id rank vec_id score",
        "op5": "doc_id n_words n_removed kept_sha256", "op6": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op9": "doc_id fingerprint component_id",
        "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    for name, query in entry.queries().items():
        if columns := want.get(name.split("_")[0]):
            assert set(columns.split()) <= set(query(spark, "/root/testdata/sf0.001").columns), name


def test_thresholds_are_fixed():
    assert (quality.MIN_WORDS, quality.MAX_REPEAT_PERCENT, phrases.WINDOW) == (50, 50, 35) and np.isclose(quality.REJECT_BELOW, 0.2)


def test_queries_with_sql_equal_it(spark):
    import duckdb

    from attestor.llm.queries import ORACLE_SQL, QUERIES

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    for name, sql in ORACLE_SQL.items():
        relation, frame = con.sql(sql), QUERIES[name](spark, folder)
        columns = sorted(frame.columns)
        assert columns == sorted(relation.columns)
        at = [relation.columns.index(c) for c in columns]
        assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(tuple(r[k] for k in at) for r in relation.fetchall()), name
