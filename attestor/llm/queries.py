"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import align, bpe, chat, fim, hmm, packing, phrases, pii, quality, simhash, suffixes, topk, toxicity

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), WORD_VOCABULARY, digest=True)


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(spark, documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(spark, documents(spark, sf_dir), digest_id="doc_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), BPE_RANKS, public_tokenizers.PATTERN)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digest_conversations(chat.format_turns(rows.union(more)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(spark, documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.Alignment(spark, documents(spark, sf_dir), BPE_VOCABULARY, PIECES)
    return found.scored().withColumnRenamed("groups", "groups_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fim.restore(fim.transform(documents(spark, sf_dir)))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(spark, documents(spark, sf_dir), digest_id="doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_quality_rules": op3_quality_rules,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
    "op11_alignment": op11_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_suffix_dedup": op13_suffix_dedup,
}
_WORDS = r"[^\x20\x09-\x0D]+"
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '<', '\l'), '[', '\b')"

#: The operators whose whole result SQL can express; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op13_suffix_dedup": """with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
        windows as (select r, b, unnest(range(1, octet_length(b) - 398)) as i from d where octet_length(b) >= 400), keyed as (select r, i, md5(b[i:i + 399]) as k from windows),
        again as (select k from keyed group by k having count(*) > 1), found as (select r, i from keyed join again using (k)),
        head as (select *, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end as h from found),
        runs as (select r, min(i) as s, max(i) + 399 as e from (select *, sum(h) over (partition by r order by i) as run from head) group by r, run),
        cut as (select d.r, doc_id, b, coalesce(list(s order by s) filter (s is not null), []) as ss, coalesce(list(e order by s) filter (s is not null), []) as es from d left join runs on d.r = runs.r group by d.r, doc_id, b),
        kept as (select *, array_to_string(list_transform(range(0, len(ss) + 1), lambda k: hex(b[case when k = 0 then 1 else es[k] + 1 end:case when k = len(ss) then octet_length(b) else ss[k + 1] - 1 end])), '') as x from cut)
        select doc_id, octet_length(b) as n_bytes, octet_length(b) - length(x) // 2 as n_removed, len(ss) as n_spans, sha256(unhex(x)) as kept_sha256 from kept""",
    "op12_fill_in_middle": """with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
        drawn as (select *, len(u) as n, list_transform(range(4), lambda k: ('0x' || h[8 * k + 1:8 * k + 8])::bigint) as g from d),
        cut as (select *, least(g[1] % (n + 1), g[2] % (n + 1)) as a, greatest(g[1] % (n + 1), g[2] % (n + 1)) as b,
          case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or g[3] % 100 >= 90 then 'plain' when g[4] % 100 < 20 then 'spm' else 'psm' end as form from drawn),
        part as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cut)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
          sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from part""",
    "op4_pivot_topk": """with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings),
        s as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r)
        select query_id, rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op5_substring_dedup": f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
        windows as (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35), keyed as (select r, i, array_to_string(w[i:i + 34], ' ') as k from windows),
        again as (select k from keyed group by k having count(*) > 1), gone as (select distinct r, unnest(range(i, i + 35)) as p from keyed join again using (k)),
        words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select words.r, string_agg(word, ' ' order by words.p) filter (gone.r is null) as text, count(gone.r) as n from words left join gone on gone.r = words.r and gone.p = words.p group by words.r)
        select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join kept using (r)""",
    "op7_chat_format": f"""with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all select -7, n, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) x(n, role))
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
          sum(24 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::bigint as formatted_chars from t group by conv_id""",
}
