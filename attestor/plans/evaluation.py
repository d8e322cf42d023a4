"""Queries over evaluation sets, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import constants as K
from attestor.functions import text as T
from attestor.operators import evalsets, ledger, metrics, ranking, routing
from attestor.plans.evidence import _POOL, _SIDES, _STEPS, _names, ledger_steps
from attestor.plans.retrieval import CHUNKS, LOCATED, Corpus
from attestor.sources import labels as source
from attestor.sources.fixtures import PROSE, table
from attestor.sources.scratch import Workspace
from attestor.sources.stores import CacheTable
from attestor.streaming import events


def _labels(spark, sf_dir):
    return Corpus(spark, sf_dir).codes


def _set(spark, sf_dir):
    entities = _names(spark, sf_dir).select("drug", F.explode(F.array(F.lit("interaction"), F.lit("contraindication"))).alias("intent"), F.col("name").alias("entity"))
    return evalsets.without_tautologies(evalsets.locate_set(_labels(spark, sf_dir), entities, PROSE))


def located_questions(spark, sf_dir):
    return _set(spark, sf_dir)


def locate_set(spark, sf_dir):
    return _set(spark, sf_dir).withColumn("gold_loinc_any", F.array_join("gold_loinc_any", ","))


def boundary_set(spark, sf_dir):
    return evalsets.boundary_set(_labels(spark, sf_dir), PROSE)


def paired_set(spark, sf_dir):
    return evalsets.paired_set(_set(spark, sf_dir))


def cap_round_robin(spark, sf_dir):
    return evalsets.cap_round_robin(_set(spark, sf_dir), 60, "drug", "qid").select("qid", "drug")


def cap_stratified(spark, sf_dir):
    return evalsets.cap_stratified(_set(spark, sf_dir), 50, "intent", "drug", "qid").select("qid", "drug", "intent")


def cap_paired(spark, sf_dir):
    return evalsets.cap_paired(evalsets.paired_set(_set(spark, sf_dir)), 41, "pair", "drug").select("qid", "pair", "drug")


PROBES = [(intent, n, t) for intent, group in PROSE.probes.items() for n, t in enumerate(group)]


def probe_set(spark, sf_dir):
    return evalsets.probe_set(_labels(spark, sf_dir), PROBES, lambda q: F.size(routing.intents(q)) == 0)


def hard_set(spark, sf_dir):
    from attestor.plans.evidence import consistency_sides

    return evalsets.hard_set(_labels(spark, sf_dir), consistency_sides(spark, sf_dir))


def set_audit(spark, sf_dir):
    return evalsets.audit(_set(spark, sf_dir))


def page_sections(spark, sf_dir):
    s = source.page_sections(table(spark, sf_dir, "pages"))
    return s.groupBy("page_id", "title").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def pick_label(spark, sf_dir):
    """Parts as hits for the names of their brands."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("drug"), F.col("p_partkey").cast("string").alias("setid"), (F.col("p_partkey") % 23).cast("int").alias("r"), (F.col("p_size") > 25).alias("has_interactions"), "p_partkey")
    from pyspark.sql import Window

    p = p.withColumn("ord", (F.row_number().over(Window.partitionBy("drug").orderBy("r", "p_partkey")) - 1).cast("int"))
    return source.pick_label(p.select("drug", "setid", "ord", "has_interactions"))


def corpus_growth(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("drug"), F.col("c_custkey").cast("int").alias("ord"), (F.col("c_custkey") % 7).cast("int").alias("n_sections"))
    have = table(spark, sf_dir, "customer").where("c_custkey % 11 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("drug"))
    return source.grow(have, c, 200)


def corpus_fingerprint(spark, sf_dir):
    return source.fingerprint(Corpus(spark, sf_dir).plan)


def cache_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha1(F.concat(F.lit("model|"), "text")).alias("key"))
    hit, miss = source.cached(d, d.where("doc_id % 3 = 0").select("key", F.lit(1.0).alias("value")).distinct())
    n = lambda df, kind: df.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "lang", "n")
    return n(hit, "hit").union(n(miss, "miss"))


def cache_generations(spark, sf_dir):
    """A cache of text lengths by two writers with common keys, compacted between them: what each language finds, and whose value."""
    cache = CacheTable(spark, f"{Workspace(spark, 'cache').path}/c", "long")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha1(F.concat(F.lit("model|"), "text")).alias("key"), F.length("text").cast("long").alias("n"))
    cache.put(d.where("doc_id % 3 = 0").select("key", F.col("n").alias("value")))
    cache.put(d.where("doc_id % 3 = 1").select("key", (F.col("n") + 1).alias("value")))
    cache.compact()
    cache.put(d.where("doc_id % 5 = 0").select("key", (F.col("n") + 2).alias("value")))
    found, _ = cache.look_up(d)
    return found.groupBy("lang").agg(F.count("value").alias("hits"), F.count_if(F.col("value").isNull()).alias("misses"), F.sum(F.col("value") - F.col("n")).alias("writers"))


def ledger_batches(spark, sf_dir):
    """Steps saved by batches of users; one batch is saved again with fewer rows; loaded with the ledger's rules checked."""
    path = f"{Workspace(spark, 'ledger').path}/l"
    kind = F.create_map(*map(F.lit, ["search", "retrieve", "locate", "locate", "ask", "ask", "answer", "synthesize", "abstain", "abstain"]))
    s = ledger_steps(spark, sf_dir).select("run_id", "step", kind[F.col("action")].alias("action"), F.lit("q").alias("query"), F.lit("n").alias("note"), F.lit(True).alias("used_in_report"), F.lit(None).cast("string").alias("reason_dropped"), "cost")
    for batch in range(3):
        source.save_ledger(path, str(batch), steps=s.where(F.col("run_id") % 3 == batch))
    source.save_ledger(path, "1", steps=s.where("run_id % 3 = 1 and step <= 2"))
    steps = source.load_ledger(spark, path, "steps")["steps"]
    return steps.groupBy("batch", "action").agg(F.count("*").alias("n"), F.sum("cost").cast("long").alias("cost"))


def run_traces(spark, sf_dir):
    t = source.trace(ledger_steps(spark, sf_dir))
    return t.select("run_id", F.md5("trace").alias("trace_md5"))


def ledger_violations(spark, sf_dir):
    s = ledger_steps(spark, sf_dir).select("run_id", "step", "action", F.when(F.col("step") % 2 == 0, "q").alias("query"), F.lit("").alias("note"), F.when(F.col("step") % 3 == 0, False).alias("used_in_report"), F.when(F.col("step") % 6 == 0, "duplicate").alias("reason_dropped"))
    return ledger.violations(s).groupBy("rule").agg(F.count("*").alias("n"))


def entities(spark, sf_dir):
    """Capitalised words before a comma as names, of the interaction sections."""
    from attestor.sources.fixtures import sections

    found = evalsets.extract_entities(sections(spark, sf_dir), {"interaction": [r"(?:^|[\s.])([A-Z][a-z]{3,})\s*,"], "contraindication": [r"([A-Z][a-z]{4,90}?)\s+(?:the|and)\s"]}, {"interaction": "34073-7", "contraindication": "34070-3"}, K.STOPWORDS)
    return found.groupBy("drug", "intent").agg(F.count("*").alias("n"), F.min("entity").alias("first"))


def stream_windows(spark, sf_dir):
    """All tumbling windows of the event stream, drained to its end, in whatever order its files lie."""
    path = f"{sf_dir}/event[s].parquet"  # a pattern, so that it may be a file or a folder
    w = events.windowed(events.read_events(spark, path)).withColumn("total", F.round("total", 6))
    return events.run_to_end(w, "complete").withColumn("window_start", F.unix_timestamp("window_start"))


def intent_set(spark, sf_dir):
    return evalsets.intent_set(_labels(spark, sf_dir), PROSE).withColumn("turns", F.array_join("turns", "|"))


def e2e_set(spark, sf_dir):
    e = evalsets.e2e_set(_labels(spark, sf_dir), _names(spark, sf_dir).select("drug", F.col("name").alias("entity")), PROSE)
    return e.withColumn("turns", F.array_join("turns", "|"))


def set_manifest(spark, sf_dir):
    s = _set(spark, sf_dir)
    return evalsets.manifest({"locate": s, "paired": evalsets.paired_set(s), "boundary": evalsets.boundary_set(_labels(spark, sf_dir), PROSE)})


def pool_probe(spark, sf_dir):
    """The lexical pool against the section of the first hit of the question's label."""
    from attestor.plans.evidence import _pool

    p = _pool(spark, sf_dir).select("qid", "question", F.col("rank").alias("pos"), F.concat("doc_id", F.lit("#"), "loinc").alias("cite_key"), "text", "drug", "asked")
    gold = p.where("array_contains(asked, drug)").groupBy("qid").agg(F.min_by("cite_key", "pos").alias("cite_key"))
    return metrics.pool_probe(p, gold)


def complementarity(spark, sf_dir):
    """BM25 and keywords on questions by template."""
    c = Corpus(spark, sf_dir)
    lists = c.work.keep(c.lexical.search(c.questions, 5).select(F.lit("bm25").alias("by"), "qid", "chunk_key").union(c.lexical.matches(c.questions, 5).select(F.lit("words"), "qid", "chunk_key")))
    named = c.located.select("qid", F.col("drug").alias("named"))
    hits = c.work.keep(lists.join(c.of(lists).select("chunk_key", "drug"), "chunk_key").join(named, "qid").groupBy("by", "qid").agg(F.max((F.col("drug") == F.col("named")).cast("int")).alias("h")))
    top = lambda by: hits.where(F.col("by") == by).select("qid", (F.col("h") == 1).alias("hit"))
    kinds = c.located.select("qid", F.coalesce("intent", F.lit("none")).alias("kind"))
    return metrics.complementarity(top("bm25"), top("words"), kinds)


def policy_paths(spark, sf_dir):
    from attestor.plans.evidence import agent_runs

    return metrics.path_survey(agent_runs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (locate_set, boundary_set, paired_set, cap_round_robin, cap_stratified, cap_paired, probe_set, hard_set, set_audit, page_sections, pick_label, corpus_growth, corpus_fingerprint, cache_split, cache_generations, ledger_batches, run_traces, ledger_violations, entities, stream_windows, intent_set, e2e_set, set_manifest, pool_probe, complementarity, policy_paths)}

_TEMPLATES = "templates(intent, template_id, template, needs) as (values " + ", ".join(f"('{i}', {n}, '" + t.replace("'", "''") + f"', {'{entity}' in t})" for i, n, t in PROSE.frames) + ")"
_CODES = "map {" + ", ".join("'" + i + "': ['" + "', '".join(c) + "']" for i, c in K.INTENT_CODES.items()) + "}"
_NAMES = f"names as (select 'src' || (row_number() over (order by n desc, w) - 1) as drug, w as name from (select w, count(*) as n from (select unnest({T.tokens_sql('text')}) as w from documents) where length(w) >= 5 group by w order by n desc, w limit 20))"
_LABELS = f"{CHUNKS}, labels as (select drug, list_sort(list(distinct loinc)) as codes from chunks group by drug)"
_SET = f"""{_LABELS}, {_NAMES}, {_TEMPLATES},
asked as (select l.drug, t.*, list_filter({_CODES}[t.intent], lambda c: list_contains(l.codes, c)) as accept from labels l, templates t),
filled as (select a.*, n.name as entity from asked a join names n on n.drug = a.drug where needs union all select *, null from asked where not needs),
qset as (select concat_ws('|', drug, intent, printf('%03d', template_id), coalesce(entity, '')) as qid, replace(replace(template, '{{drug}}', drug), '{{entity}}', coalesce(entity, '')) as question, intent, drug, entity, template_id, accept[1] as gold_loinc, accept
  from filled where len(accept) > 0 and (entity is null or not contains(lower(entity), lower(drug)))),
pairs as (select concat_ws('|', drug, intent, coalesce(entity, '')) as pair, *, row_number() over (partition by drug, intent, entity order by template_id) as n from qset),
paired as (select pair || '|' || case when n = 1 then 'direct' else 'paraphrase' end as qid, case when n = 1 then 'direct' else 'paraphrase' end as tier, question, pair, drug, gold_loinc from pairs where n <= 2)"""
_VALUES = lambda rows: ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_EXP = K.EXPECTED

_BOUNDARY = f"""q as (select question, 'out_of_scope' as boundary_class from (values {_VALUES([(x,) for x in PROSE.out_of_scope])}) v(question)
        union all select replace(t, '{{drug}}', drug), 'beyond_label' from labels, (values {_VALUES([(x,) for x in PROSE.beyond_label])}) v(t)
        union all select replace('{PROSE.unknown}', '{{name}}', name), 'unknown_drug' from (select name from (values {_VALUES(list(enumerate(PROSE.names)))}) v(k, name) where name not in (select lower(drug) from labels) order by k limit 8)
        union all select replace(replace('{PROSE.missing}', '{{aspect}}', aspect), '{{drug}}', drug), 'missing_section' from labels, (values {_VALUES(PROSE.aspects)}) v(aspect, code) where not list_contains(codes, code))"""
_PLAIN = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HTML = "html"
for _tag in ("script", "style", "nav", "footer", "aside"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_HTML = f"""regexp_replace(regexp_replace({_HTML}, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<div class="ad">.*?</div>', ' ', 'g')"""
_HITS = lambda scores: f"select qid, max((c.drug = l.drug)::int) = 1 as hit from (select *, row_number() over (partition by qid order by score desc, chunk_key) as rank from {scores}) s join chunks c using (chunk_key) join located l using (qid) where rank <= 5 group by qid"

ORACLE_SQL = {
    "intent_set": f"""{_LABELS}, t as (select * from (values {_VALUES([(k, *x) for k, x in enumerate(PROSE.follow_ups)])}) v(k, follow_up, intent)), r as (select *, list_filter({_CODES}[intent], lambda c: list_contains(codes, c)) as gold from labels, t)
        select drug || '|' || k as qid, replace('{PROSE.opening}', '{{drug}}', drug) || '|' || follow_up as turns, drug as referent, intent, follow_up || ' (' || drug || ')' as resolved_query, gold[1] as gold_loinc from r where len(gold) > 0""",
    "e2e_set": f"""{_LABELS}, {_NAMES}, s as (select * from (values {", ".join(f"('{n}', " + "['" + "', '".join(t) + "'])" for n, t in PROSE.scripts.items())}) v(scenario, script))
        select l.drug || '|' || scenario as qid, scenario, l.drug, array_to_string(list_transform(script, lambda x: replace(replace(x, '{{drug}}', l.drug), '{{entity}}', coalesce(n.name, ''))), '|') as turns, len(script) as n_turns from labels l join s on true left join names n on n.drug = l.drug""",
    "locate_set": f"{_SET} select qid, question, intent, drug, entity, template_id, gold_loinc, array_to_string(accept, ',') as gold_loinc_any from qset",
    "boundary_set": f"{_LABELS}, {_BOUNDARY} select question, boundary_class, case boundary_class {' '.join(f"when '{k}' then '{v}'" for k, v in _EXP.items())} end as expect_action from q",
    "set_manifest": f"{_SET}, {_BOUNDARY} select 'locate' as name, count(*) as n from qset union all select 'paired', count(*) from paired union all select 'boundary', count(*) from q",
    "hard_set": f"""{_SIDES}, labels as (select drug, unnest(list_sort(list(distinct loinc))) as c from chunks group by drug),
        g as (select 'multi_section' as kind, [a.drug] as drugs, [a.drug || '#' || a.c, b.drug || '#' || b.c] as golds from labels a join labels b on a.drug = b.drug and a.c < b.c
          union all select 'cross_drug', [speaker, about], [speaker || '#{K.INTENT_CODES['interaction'][0]}', about || '#{K.INTENT_CODES['interaction'][0]}'] from sides)
        select row_number() over (partition by kind order by golds) as turn, kind, array_to_string(drugs, ',') as drugs, array_to_string(golds, ',') as golds from g""",
    "stream_windows": "select epoch(date_trunc('hour', ts))::bigint as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all",
    "pool_probe": f"""{_POOL}, p as (select qid, rank, doc_id || '#' || loinc as cite_key, list_contains(drugs, drug) as own, len(list_intersect({T.content_words_sql('question')}, {T.content_words_sql('text')})) as overlap from pool where rank <= 20),
        gold as (select qid, arg_min(cite_key, rank) as cite_key from p where own group by qid), best as (select qid, max(overlap) as best, count(*) as n_pool from p group by qid),
        g as (select qid, min(rank) as gold_pos, max(overlap) as gold_overlap from p join gold using (qid, cite_key) group by qid)
        select qid, best, n_pool, gold_pos, gold_overlap, coalesce(gold_overlap = best, false) as gold_is_best from gold left join best using (qid) left join g using (qid)""",
    "complementarity": f"""{LOCATED}, {ranking.BM25_SQL}, q as (select qid, unnest(list_distinct({T.tokens_sql('question')})) as term from questions), k as (select chunk_key, unnest(list_distinct({T.tokens_sql('text')})) as term from chunks),
        h as (select qid, chunk_key, count(*) as score from q join k using (term) group by all), x as ({_HITS('(select qid, chunk_key, bm25 as score from bm25)')}), y as ({_HITS('h')}),
        z as (select coalesce(intent, 'none') as kind, coalesce(x.hit, false) as a, coalesce(y.hit, false) as b from located left join x using (qid) left join y using (qid))
        select kind, count(*) as n, count(*) filter (a) as n_a, count(*) filter (b) as n_b, count(*) filter (a or b) as n_either, count(*) filter (a and not b) as n_only_a, count(*) filter (b and not a) as n_only_b from z group by kind""",
    "page_sections": f"""with h as (select page_id, {_HTML} as html from pages), p as (select page_id, {_PLAIN("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")} as title, unnest((string_split_regex(html, '(?i)<p\\b[^>]*>'))[2:]) as raw from h),
        t as (select page_id, title, {_PLAIN("regexp_replace(raw, '(?is)</(p|article)>.*$', '')")} as text from p) select page_id, title, count(*) as n, sum(length(text))::bigint as n_chars from t where length(text) > {source.MIN_CHARS} group by all""",
    "paired_set": f"{_SET} select * from paired",
    "cap_round_robin": f"{_SET} select qid, drug from (select *, row_number() over (partition by drug order by qid) as turn from qset) order by turn, drug limit 60",
    "cap_stratified": f"{_SET}, t as (select *, row_number() over (partition by intent, drug order by qid) as turn from qset), p as (select *, row_number() over (partition by intent order by turn, drug) as place from t) select qid, drug, intent from p where place <= greatest(1, 50 // (select count(distinct intent) from qset))",
    "cap_paired": f"{_SET}, s as (select pair, drug, count(*) as size from paired group by all), t as (select *, row_number() over (partition by drug order by pair) as turn from s), u as (select *, coalesce(sum(size) over (order by turn, drug, pair rows between unbounded preceding and 1 preceding), 0) as before from t) select qid, pair, drug from paired where pair in (select pair from u where before < 41)",
    "probe_set": f"""{_LABELS}, d as (select drug, row_number() over (order by drug) - 1 as pos, count(*) over () as n from labels), t as (select * from (values {_VALUES([(k, *x) for k, x in enumerate(PROBES)])}) v(k, intent, template_id, template)),
        p as (select intent, template_id, case when template_id < 2 then 'dev' else 'test' end as split, drug, replace(template, '{{drug}}', drug) as question from d, t where (((pos - k * 3) % n) + n) % n < 6)
        select * from p where len({routing.intents_sql('question')}) = 0""",
    "set_audit": f"{_SET} select 'question_twice' as \"check\", count(*) as n from (select question from qset group by question having count(*) > 1) union all select 'code_malformed', count(*) filter (not regexp_full_match(gold_loinc, '\\d{{5}}-\\d')) from qset union all select 'gold_not_acceptable', count(*) filter (not list_contains(accept, gold_loinc)) from qset union all select 'labels_covered', count(distinct drug) from qset",
    "pick_label": "with p as (select p_brand as drug, p_partkey::varchar as setid, p_size > 25 as has_interactions, (row_number() over (partition by p_brand order by p_partkey % 23, p_partkey) - 1)::int as ord from part) select drug, setid, ord, has_interactions from (select *, row_number() over (partition by drug order by has_interactions desc, ord) as n from p where ord < 20) where n = 1",
    "corpus_growth": "with h as (select 'c' || c_custkey as drug from customer where c_custkey % 11 = 0), n as (select 'c' || c_custkey as drug, c_custkey::int as ord from customer where c_custkey % 7 >= 3 and c_custkey % 11 <> 0), r as (select *, row_number() over (order by ord) as place from n) select * from r where place <= greatest(200 - (select count(*) from h), 0)",
    "cache_split": "with d as (select doc_id, lang, sha1('model|' || text) as key from documents), c as (select distinct key from d where doc_id % 3 = 0) select case when key in (select key from c) then 'hit' else 'miss' end as kind, lang, count(*) as n from d group by all",
    "cache_generations": """with d as (select doc_id, lang, sha1('model|' || text) as key, length(text) as n from documents),
        put as (select distinct key, n as value, 1 as g from d where doc_id % 3 = 0 union all select distinct key, n + 1, 2 from d where doc_id % 3 = 1 union all select distinct key, n + 2, 3 from d where doc_id % 5 = 0),
        newest as (select key, arg_max(value, g) as value from put group by key)
        select lang, count(value) as hits, count(*) - count(value) as misses, sum(value - n)::bigint as writers from d left join newest using (key) group by lang""",
    "ledger_batches": f"""with {_STEPS} select (run_id % 3)::varchar as batch, case action when 'search' then 'retrieve' when 'answer' then 'synthesize' else action end as action, count(*) as n, sum(cost)::bigint as cost
        from steps where run_id % 3 <> 1 or step <= 2 group by all""",
    "run_traces": f"with {_STEPS} select run_id, md5(string_agg('#' || step || ' ' || action || ' cost=' || cost || ' left=' || budget_left, chr(10) order by step)) as trace_md5 from steps group by run_id",
    "ledger_violations": f"""with {_STEPS}, s as (select *, case when step % 2 = 0 then 'q' end as query from steps) select rule, count(*) as n from (
        select 'unknown_action' as rule from s where action not in ({T.quoted(K.LEDGER_ACTIONS)}) union all select 'query_missing' from s where action in ('retrieve', 'locate', 'ask') and query is null
        union all select 'abstain_without_note' from s where action = 'abstain' union all select 'unused_without_reason' from s where step % 3 = 0 and step % 6 <> 0) group by rule""",
}
