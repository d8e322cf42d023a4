"""Queries over coverage, selection, answers, ledgers, consistency, sessions and the agent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.functions import constants as K
from attestor.functions import text as T
from attestor.operators import agent, answering, consistency, coverage, decisions, evalsets, ledger, metrics, ranking, selection, sessions
from attestor.plans.retrieval import CHUNKS, LOCATED, SCORED, Corpus
from attestor.sources.fixtures import table

#: Warning words of the stand-in corpus, whose prose is invented.
FIXTURE_WARNING = r"\b(of the|in the|by the)\b"
_CODES = [c for c, _ in K.SECTIONS]
_CODES_SQL = "['" + "', '".join(_CODES) + "']"


def _code(n):
    return F.array(*map(F.lit, _CODES))[F.pmod(n, F.lit(len(_CODES))).cast("int")]


def _pool(spark, sf_dir, k=20):
    """Evidence of each question: its first k lexical hits."""
    c = Corpus(spark, sf_dir)
    loc = c.located.select("qid", "question", F.struct("drugs", "intent", "loincs").alias("loc"), F.col("drugs").alias("asked"))
    found = c.found(k)
    return c.work.keep(found.join(c.of(found), "chunk_key")).join(loc, "qid")


def _states(spark, sf_dir, k=5):
    doc = F.struct("chunk_key", F.concat("doc_id", F.lit("#"), "loinc").alias("cite_key"), "drug", "loinc", "section", "text", F.lit(1.0).alias("authority"))
    by = _pool(spark, sf_dir, k).withColumn("d", doc).groupBy("qid", "question", "loc", "asked").agg(F.array_sort(F.collect_list(F.struct("rank", "d"))).alias("x"))
    s = by.select("qid", "question", "loc", "asked", F.expr("transform(x, y -> y.d)").alias("evidence"), F.lit(True).alias("looked"))
    return s.withColumn("terms", F.slice(T.question_terms("question", "asked"), 1, K.MAX_TERMS))


def question_terms(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return c.located.select("qid", F.array_join(T.question_terms("question", "drugs"), " ").alias("terms"))


def coverage_scores(spark, sf_dir):
    x = coverage.with_coverage(_states(spark, sf_dir))
    return x.select("qid", F.size("slots").alias("n_slots"), F.expr("size(filter(slots, s -> s.filled))").alias("n_filled"), F.round("coverage", 9).alias("coverage"), "gap_query", "hard_fail")


def selection_pool(spark, sf_dir):
    p = _pool(spark, sf_dir).select(F.col("qid").alias("run_id"), F.col("rank").alias("pos"), "chunk_id", "drug", "loinc", F.lit(1.0).alias("authority"), "asked", F.col("loc.loincs").alias("codes"))
    return selection.select(p, 6).select("run_id", "pos", "chunk_id", "struct_rank", "place", "keep", "reason")


def selection_sweep(spark, sf_dir):
    p = _pool(spark, sf_dir).select(F.col("qid").alias("run_id"), F.col("rank").alias("pos"), "drug", "loinc", F.lit(1.0).alias("authority"), "asked", F.col("loc.loincs").alias("codes"))
    return selection.sweep(p, [1, 2, 3, 4, 5, 6, 8, None])


def grounded_answers(spark, sf_dir):
    return _states(spark, sf_dir).select("qid", F.expr(answering.copied("evidence")).alias("answer_text"))


def _reports(spark, sf_dir):
    """A report for each order: a sentence and a citation for each of its lines; every third order also cites without a section."""
    li = table(spark, sf_dir, "lineitem")
    key = F.format_string("%08d", "l_orderkey")
    said = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" holds ["), key, F.lit("#"), _code(F.col("l_linenumber")), F.lit("]."))
    r = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", said.alias("s")))), lambda x: x["s"]), " ").alias("body"))
    bare = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit(" So it is ["), F.format_string("%08d", "l_orderkey"), F.lit("]."))).otherwise(F.lit(""))
    return r.select(F.col("l_orderkey").alias("run_id"), F.concat("body", bare).alias("answer_text"))


def claims(spark, sf_dir):
    return answering.claims_of(_reports(spark, sf_dir)).select("run_id", "claim_id", "text", F.array_join("cites", " ").alias("cites"))


def _held(spark, sf_dir):
    """Retrieved: of each order the sections of its first three line numbers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step"))
    return o.select("run_id", "step", F.format_string("%08d", "run_id").alias("doc_id"), _code(F.col("step")).alias("loinc")).withColumn("cite_key", F.concat("doc_id", F.lit("#"), "loinc"))


def verify_answers(spark, sf_dir):
    corpus = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, _CODES[:6]))).alias("code")).select(F.concat(F.format_string("%08d", "o_orderkey"), F.lit("#"), "code").alias("cite_key"))
    v = answering.verify_answers(_reports(spark, sf_dir), _held(spark, sf_dir), corpus)
    return v.select("run_id", "ok", "is_abstention", "n_claims", "n_cites", "n_bad", F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"))


def ledger_steps(spark, sf_dir):
    """Events as the steps of a run for each user, with their costs and the budget left."""
    action = F.create_map(*map(F.lit, ["click", "search", "view", "locate", "signup", "ask", "purchase", "answer", "error", "abstain"]))
    cost = F.create_map(*[F.lit(x) for a, c in K.COSTS.items() for x in (a, c)])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(w).alias("step"), action[F.col("event_type")].alias("action"), "ts", "event_id", "user_id")
    e = e.withColumn("cost", F.coalesce(cost[F.col("action")], F.lit(0)))
    return e.select("run_id", "step", "action", "cost", (F.lit(K.BUDGET) - F.sum("cost").over(w)).alias("budget_left"))


def ledger_first_steps(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("claim_id"), F.format_string("%08d", "l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 5 != 0, _code(F.col("l_linenumber"))).alias("loinc"))
    carried = _held(spark, sf_dir).where("run_id % 2 = 0").select("run_id", "doc_id", F.lit(_CODES[4]).alias("loinc")).distinct()
    return ledger.first_steps(c, _held(spark, sf_dir).select("run_id", "step", "doc_id", "loinc"), carried)


def ledger_closure(spark, sf_dir):
    f = ledger_first_steps(spark, sf_dir)
    cites = f.withColumn("cite_key", F.concat_ws("#", "doc_id", "loinc")).withColumn("stored_step", F.when(F.col("run_id") % 7 == 0, F.lit(9)).otherwise(F.col("first_step")))
    all_claims = f.select("run_id", "claim_id").union(table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.lit("c0")))
    return ledger.closure(all_claims, cites).groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("n_runs"))


def _layers(spark, sf_dir, shift=0):
    held = _held(spark, sf_dir).where(F.col("step") > shift)
    gold = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.format_string("%08d", "o_orderkey"), F.lit("#"), _code(F.lit(1) + F.col("o_orderkey") % 4)).alias("cite_key"))
    cited = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("run_id"), F.concat(F.format_string("%08d", "l_orderkey"), F.lit("#"), _code(F.col("l_linenumber"))).alias("cite_key"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5 == 0).alias("correct"))
    return ledger.attribution(gold, held, cited, right)


def attribution(spark, sf_dir):
    return _layers(spark, sf_dir)


def attribution_compare(spark, sf_dir):
    return ledger.compare_layers(_layers(spark, sf_dir, 1), _layers(spark, sf_dir))


def linear_pipeline(spark, sf_dir):
    """Each item's question and its text as two sub-questions, five hits each."""
    c = Corpus(spark, sf_dir)
    subs = c.questions.select("qid", F.lit(1).alias("sub"), "question").union(table(spark, sf_dir, "benchmark").select("item_id", F.lit(2), "text"))
    asked = subs.select(F.concat_ws("/", "qid", "sub").alias("qid"), "question")
    found = c.work.keep(c.lexical.search(asked, 5))
    hits = found.join(c.of(found).select("chunk_key", "doc_id", "loinc"), "chunk_key")
    h = hits.select(F.substring_index("qid", "/", 1).cast("long").alias("run_id"), F.substring_index("qid", "/", -1).cast("int").alias("sub"), F.concat("doc_id", F.lit("#"), "loinc").alias("cite_key"), "rank")
    return ledger.linear_pipeline(h)


def _names(spark, sf_dir):
    """Each source is named by one of the corpus's most frequent words of five letters or more."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens("text")).alias("w")).where(F.length("w") >= 5).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(20)
    words = words.select("w", F.row_number().over(Window.orderBy(F.desc("n"), "w")).alias("k"))
    return words.select(F.concat(F.lit("src"), (F.col("k") - 1).cast("string")).alias("drug"), F.col("w").alias("name"))


def consistency_sides(spark, sf_dir):
    return consistency.sides(consistency.audit_sentences(Corpus(spark, sf_dir).plan), _names(spark, sf_dir), FIXTURE_WARNING)


def consistency_pairs(spark, sf_dir):
    return consistency.pairs(consistency_sides(spark, sf_dir), _names(spark, sf_dir))


def consistency_kinds(spark, sf_dir):
    """Pairs by kind under the warning words of labels, without a row for each pair."""
    names = _names(spark, sf_dir)
    return consistency.kind_counts(consistency.sides(consistency.audit_sentences(Corpus(spark, sf_dir).plan), names), names)


def citation_balance(spark, sf_dir):
    p = consistency_pairs(spark, sf_dir)
    cited = p.select(F.concat_ws("|", "a", "b").alias("run_id"), "a", "b", F.when(F.length("a") == F.length("b"), F.array("a")).otherwise(F.array("a", "b")).alias("cites"))
    return consistency.citation_balance(p, cited).select("run_id", "a", "b", "ok", F.array_join("problems", ",").alias("problems"))


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    name = F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("src"), (F.length("text") % 20).cast("string")))).otherwise(F.expr("cast(array() as array<string>)"))
    return t.select("conv_id", "turn", F.concat(F.when(F.col("turn") % 4 == 2, "And what about it? ").otherwise(""), "text").alias("raw"), name.alias("named"))


def session_resolve(spark, sf_dir):
    r = sessions.resolve(_turns(spark, sf_dir))
    return r.select("conv_id", "turn", "mode", "cue", F.array_join("drugs", ",").alias("drugs"), F.length("question").cast("long").alias("n_chars"))


def session_summary(spark, sf_dir):
    return sessions.summary(sessions.resolve(_turns(spark, sf_dir)))


def decision_report(spark, sf_dir):
    """Steps as decisions; outcome and replays by arithmetic of the step."""
    s = ledger_steps(spark, sf_dir)
    cf = F.map_from_arrays(F.array(F.lit("search"), F.lit("answer")), F.array((F.col("run_id") + F.col("step")) % 3 == 0, F.col("step") % 4 == 0))
    p = s.select("run_id", "step", "action", F.when(F.col("step") % 5 != 0, F.col("run_id") % 2 == 0).alias("outcome"), cf.alias("cf"))
    return decisions.report(decisions.signals(p))


def available_actions(spark, sf_dir):
    p = ledger_steps(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))
    return p.select("action", F.explode(F.array_except(F.array(*map(F.lit, ["search", "answer", "abstain", "locate"])), F.array("action"))).alias("other"), "n")


def _runs(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    q = c.questions.select(F.col("qid").cast("string").alias("qid"), "question", F.explode(F.array(F.lit("rule"), F.lit("coverage"))).alias("policy"))
    return agent.Retriever(spark, c.plan), q.withColumn("run_id", F.concat_ws("-", "policy", "qid")).drop("qid")


def agent_runs(spark, sf_dir):
    """Both policies over all questions, as one batch."""
    retriever, runs = _runs(spark, sf_dir)
    return agent.stats(agent.run(retriever, runs, log=False))


def _expected(spark, sf_dir, n_asked=None, n_bound=None):
    """run_id, question, boundary_class (null: must answer), drug, gold_loinc_any: the locate set and the boundary set, capped if asked for (by turns of labels and of classes)."""
    from attestor.plans.evaluation import boundary_set, located_questions

    asked = located_questions(spark, sf_dir)
    asked = evalsets.cap_round_robin(asked, n_asked, "drug", "qid") if n_asked else asked
    bound = boundary_set(spark, sf_dir)
    bound = evalsets.cap_round_robin(bound, n_bound, "boundary_class", "question") if n_bound else bound
    asked = asked.select(F.concat(F.lit("a:"), "qid").alias("run_id"), "question", F.lit(None).cast("string").alias("boundary_class"), "drug", "gold_loinc_any")
    return asked.union(bound.select(F.concat(F.lit("b:"), "boundary_class", F.lit("|"), "question"), "question", "boundary_class", F.lit(None), F.lit(None)))


def agent_theta_grid(spark, sf_dir):
    """The coverage policy under every pair of thresholds over 24 questions to answer and 20 to refuse: one batch, best score first."""
    retriever, _ = _runs(spark, sf_dir)
    work = retriever.work
    wanted = work.keep(_expected(spark, sf_dir, 24, 20))
    grid = [(h / 100, low / 100) for h in (30, 35, 40, 50, 60, 75, 90) for low in (0, 20, 30, 45) if low < h]
    cells = spark.createDataFrame(grid, "theta_high double, theta_low double")
    runs = wanted.join(F.broadcast(cells)).withColumn("base", F.col("run_id")).withColumn("run_id", F.concat_ws("@", "run_id", "theta_high", "theta_low"))
    final = work.keep(agent.run(retriever, runs.select("run_id", "base", "question", "theta_high", "theta_low"), log=False))
    right = metrics.grounded(final, runs.where("boundary_class is null").select("run_id", "drug", "gold_loinc_any"))
    done = final.select("run_id", "base", "theta_high", "theta_low", "terminated_by", F.size("actions").alias("n_actions")).join(right, "run_id", "left")
    return metrics.theta_grid(done.join(wanted.select(F.col("run_id").alias("base"), "boundary_class"), "base"))


def agent_refusals(spark, sf_dir):
    """Both policies over the whole locate and boundary sets: refusals by class, and right answers (class answerable)."""
    retriever, _ = _runs(spark, sf_dir)
    wanted = retriever.work.keep(_expected(spark, sf_dir))
    runs = wanted.withColumn("policy", F.explode(F.array(F.lit("rule"), F.lit("coverage")))).withColumn("base", F.col("run_id")).withColumn("run_id", F.concat_ws("@", "run_id", "policy"))
    final = retriever.work.keep(agent.run(retriever, runs.select("run_id", "base", "question", "policy"), log=False))
    right = metrics.grounded(final, runs.where("boundary_class is null").select("run_id", "drug", "gold_loinc_any"))
    x = final.select("run_id", "base", "policy", "terminated_by", F.size("actions").alias("n_actions")).join(right, "run_id", "left").join(wanted.select(F.col("run_id").alias("base"), F.coalesce("boundary_class", F.lit("answerable")).alias("boundary_class")), "base")
    return x.groupBy("policy", "boundary_class").agg(F.count("*").alias("n"), F.count_if(F.col("terminated_by") == "abstain").alias("n_refused"), F.count_if(F.col("terminated_by") == "answer").alias("n_answered"), F.count_if("correct").alias("n_correct"), F.round(F.avg("n_actions"), 9).alias("avg_actions"))


def agent_closure(spark, sf_dir):
    """Claims of all answers and what their citations lack, by policy."""
    retriever, runs = _runs(spark, sf_dir)
    final = retriever.work.keep(agent.run(retriever, runs, log=False))
    return agent.finished(final).join(final.select("run_id", "policy"), "run_id").groupBy("policy").agg(F.count("*").alias("n"), F.sum("n_claims").alias("n_claims"), F.sum("n_problems").alias("n_problems"), F.count_if("malformed").alias("n_malformed"))


def agent_counterfactuals(spark, sf_dir):
    """Every decision of the base runs again under each other action, as one batch."""
    retriever, runs = _runs(spark, sf_dir)
    base = retriever.work.keep(agent.run(retriever, runs))
    points = decisions.points(base)
    again = agent.run(retriever, decisions.replays(points, runs), log=False)
    done = agent.stats(again).select("run_id", "answered")
    right = agent.stats(base).select("run_id", F.col("answered").alias("outcome"))
    split = done.select(F.split("run_id", "~").alias("p"), "answered").select(F.col("p")[0].alias("run_id"), F.col("p")[1].cast("int").alias("index"), F.col("p")[2].alias("other"), "answered")
    cf = split.groupBy("run_id", "index").agg(F.map_from_entries(F.collect_list(F.struct("other", "answered"))).alias("cf"))
    return decisions.report(decisions.signals(points.join(right, "run_id").join(cf, ["run_id", "index"], "left")))


def session_runs(spark, sf_dir):
    """Answer the user turns of all conversations, turn by turn, with inherited evidence."""
    c = Corpus(spark, sf_dir)
    resolved = sessions.resolve(_turns(spark, sf_dir)).withColumn("question", F.concat_ws(" ", F.array_join("drugs", " "), "question"))
    final = sessions.run_turns(spark, agent.Retriever(spark, c.plan), resolved, int(resolved.agg(F.max("turn")).first()[0] or 0), log=False)
    return agent.stats(final).join(final.select("run_id", "conv_id", "n_carried"), "run_id").select("run_id", "conv_id", "path", "terminated_by", "n_actions", "n_carried", "n_evidence")


QUERIES = {f.__name__: f for f in (question_terms, coverage_scores, selection_pool, selection_sweep, grounded_answers, claims, verify_answers, ledger_steps, ledger_first_steps, ledger_closure, attribution, attribution_compare, linear_pipeline, consistency_sides, consistency_pairs, consistency_kinds, citation_balance, session_resolve, session_summary, decision_report, available_actions, agent_runs, agent_theta_grid, agent_refusals, agent_closure, agent_counterfactuals, session_runs)}

_C = lambda n: f"({_CODES_SQL})[({n}) % {len(_CODES)} + 1]"
_TERMS = f"""list_filter({T.tokens_sql('question')}, lambda x: length(x) >= 3 and x not in ({T.quoted(K.QUESTION_FILLERS)}) and not list_contains(drugs, x))"""
#: Distinct in order: a value stays where it stands first.
_FIRSTS = f"list_filter({_TERMS}, lambda x, i: list_position({_TERMS}, x) = i)"
_POOL = f"{LOCATED}, {ranking.BM25_SQL}, pool as (select l.qid, l.question, l.drugs, l.loincs, l.intent, b.rank, c.* from lexical b join chunks c using (chunk_key) join located l using (qid))"
_STRUCT = "case when list_contains(loincs, loinc) and list_contains(drugs, drug) then 3 when list_contains(loincs, loinc) then 2 when list_contains(drugs, drug) then 1 else 0 end"
_REPORTS = f"reports as (select l_orderkey as run_id, string_agg('Line ' || l_linenumber || ' holds [' || printf('%08d', l_orderkey) || '#' || {_C('l_linenumber')} || '].', ' ' order by l_linenumber) || case when l_orderkey % 3 = 0 then ' So it is [' || printf('%08d', l_orderkey) || '].' else '' end as answer_text from lineitem group by l_orderkey)"
_CLAIMS = f"""{_REPORTS}, parts as (select run_id, unnest({T.sentences_sql('answer_text', '.!?')}) as text, unnest(range(len({T.sentences_sql('answer_text', '.!?')}))) as pos from reports),
cited as (select *, {T.citations_sql('text')} as cites from parts), claims as (select run_id, 'c' || row_number() over (partition by run_id order by pos) as claim_id, trim(text) as text, cites from cited where len(cites) > 0)"""
_HELD = f"held as (select o_orderkey as run_id, step, printf('%08d', o_orderkey) as doc_id, {_C('step')} as loinc, printf('%08d', o_orderkey) || '#' || {_C('step')} as cite_key from orders, (values (1), (2), (3)) s(step))"
_FIRST = f"""{_HELD}, cites as (select l_orderkey as run_id, 'c' || l_linenumber as claim_id, printf('%08d', l_orderkey) as doc_id, case when l_linenumber % 5 <> 0 then {_C('l_linenumber')} end as loinc from lineitem),
steps as (select c.*, coalesce((select min(h.step) from held h where h.run_id = c.run_id and h.doc_id = c.doc_id and (c.loinc is null or h.loinc = c.loinc)), case when c.run_id % 2 = 0 and c.loinc = '{_CODES[4]}' then -1 end) as first_step from cites c)"""
_COST = "case action " + " ".join(f"when '{a}' then {c}" for a, c in K.COSTS.items()) + " else 0 end"
_STEPS = f"""acts as (select user_id as run_id, ts, event_id, case event_type when 'click' then 'search' when 'view' then 'locate' when 'signup' then 'ask' when 'purchase' then 'answer' when 'error' then 'abstain' end as action from events),
steps as (select run_id, row_number() over w as step, action, {_COST} as cost, {K.BUDGET} - sum({_COST}) over w as budget_left from acts window w as (partition by run_id order by ts, event_id rows unbounded preceding))"""


def _layer_sql(name: str, shift: int) -> str:
    return f"""{name} as (select o_orderkey as run_id, round(case when exists (select 1 from held h where h.run_id = o_orderkey and step > {shift} and h.loinc = g.code) then 1.0 else 0.0 end, 9) as recall,
      round(case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber > 1 and {_C('l_linenumber')} = g.code) then 1.0 else 0.0 end, 9) as utilization, o_orderkey % 5 = 0 as correct from (select *, {_C('1 + o_orderkey % 4')} as code from orders) g),
    {name}_layers as (select run_id, recall, utilization, case when correct then 'none' when recall < 1 then 'retrieval' when utilization < 1 then 'utilization' else 'reasoning' end as layer from {name})"""


_NAMES_SQL = f"names as (select 'src' || (row_number() over (order by n desc, w) - 1) as drug, w as name from (select w, count(*) as n from (select unnest({T.tokens_sql('text')}) as w from documents) where length(w) >= 5 group by w order by n desc, w limit 20))"
_SIDES = f"""{CHUNKS}, {_NAMES_SQL}, sent as (select drug as speaker, section, trim(unnest({T.sentences_sql('text', '.;')})) as sentence, printf('%s#%08d', chunk_key, unnest(range(len({T.sentences_sql('text', '.;')})))) as ord from chunks),
hits as (select s.*, n.drug as about, case when regexp_matches(sentence, '(?i){FIXTURE_WARNING}') and not regexp_matches(sentence, '(?i){K.TABLE_HEADER}') then 0 when not regexp_matches(sentence, '(?i){K.TABLE_HEADER}') then 1 else 2 end as r
  from (select *, unnest(list_distinct(string_split_regex(lower(sentence), '[^\\p{{L}}\\p{{N}}_]+'))) as word from sent) s join names n on n.drug <> s.speaker and s.word = n.name),
sides as (select speaker, about, case when min(r) = 0 then 'warn' else 'mention' end as label, arg_min(sentence, (r, ord)) as sentence, arg_min(section, (r, ord)) as section, count(*) as n_hits from hits group by speaker, about)"""
_PAIRS = f"""{_SIDES}, pairs as (select *, case when x = 'warn' and y = 'warn' then 'both_warn' when x = 'warn' then 'asymmetric_a' when y = 'warn' then 'asymmetric_b' when x = 'absent' and y = 'absent' then 'both_absent' else 'both_mention' end as kind from (
  select a.drug as a, b.drug as b, coalesce(s.label, 'absent') as x, coalesce(t.label, 'absent') as y from names a join names b on a.drug <> b.drug left join sides s on s.speaker = a.drug and s.about = b.drug left join sides t on t.speaker = b.drug and t.about = a.drug))"""
_TURNS = f"""turns as (select conv_id, turn, case when turn % 4 = 2 then 'And what about it? ' else '' end || text as raw, case when turn % 2 = 0 then ['src' || (length(text) % 20)] else [] end as named from conversations where role = 'user'),
seen as (select *, coalesce(last_value(case when len(named) > 0 then named end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), []) as focus, {T.cue_sql('raw')} as cue from turns),
resolved as (select *, case when cue <> '' and len(focus) > 0 then 'from_context' when len(named) > 0 then 'explicit' else 'none' end as mode,
  case when cue <> '' and len(focus) > 0 then case when len(named) > 0 and named[1] <> focus[1] then list_concat(focus, named) else focus end when len(named) > 0 then named else [] end as drugs from seen),
asked as (select *, list_filter(drugs, lambda d: not contains(lower(raw), lower(d))) as missing from resolved)"""

ORACLE_SQL = {
    "question_terms": f"{LOCATED} select qid, array_to_string({_FIRSTS}, ' ') as terms from located",
    "coverage_scores": f"""{_POOL}, ev as (select qid, any_value(question) as question, any_value(drugs) as drugs, any_value(loincs) as loincs, any_value(intent) as intent, list(distinct drug) as got, list(loinc) filter (list_contains(drugs, drug)) as codes,
        coalesce(string_agg(lower(text), ' ' order by rank) filter (list_contains(drugs, drug)), '') as texts from pool where rank <= 5 group by qid),
        t as (select *, ({_FIRSTS})[1:{K.MAX_TERMS}] as terms from ev),
        f as (select *, list_filter(terms, lambda w: contains(texts, w) or (length(w) >= 6 and contains(texts, left(w, length(w) - 2)))) as has from t),
        s as (select qid, greatest(len(drugs), 1) + greatest(len(loincs), 1) + len(terms) as n_slots, len(list_filter(drugs, lambda d: list_contains(got, d))) + len(list_filter(loincs, lambda c: list_contains(coalesce(codes, []), c))) + len(has) as n_filled,
          nullif(array_to_string(list_filter(terms, lambda w: not list_contains(has, w)), ' '), '') as gap_query, len(loincs) = 0 and intent is not null as hard_fail from f)
        select qid, n_slots, n_filled, round(n_filled / n_slots, 9) as coverage, gap_query, hard_fail from s""",
    "selection_pool": f"{_POOL}, r as (select qid as run_id, rank as pos, chunk_id, {_STRUCT} as struct_rank from pool where rank <= 20), p as (select *, row_number() over (partition by run_id order by struct_rank desc, pos) as place from r) select *, place <= 6 as keep, case when place > 6 then 'over_budget' end as reason from p",
    "selection_sweep": f"{_POOL}, r as (select qid, rank, {_STRUCT} as s, len(drugs) > 0 and not list_contains(drugs, drug) as other from pool where rank <= 20), p as (select *, row_number() over (partition by qid order by s desc, rank) as place from r) select budget, count(*) as n_kept, count(*) filter (s = 0) as n_rank0, count(*) filter (s = 1) as n_rank1, count(*) filter (s = 2) as n_rank2, count(*) filter (s = 3) as n_rank3, count(*) filter (other) as n_other_drug from p, (values (1), (2), (3), (4), (5), (6), (8), (null)) b(budget) where budget is null or place <= budget group by budget",
    "grounded_answers": f"""{_POOL}, b as (select qid, rank, doc_id || '#' || loinc as key, section || chr(10) || text as block, len(list_intersect({T.content_words_sql('question')}, {T.content_words_sql("section || chr(10) || text")})) as o from pool where rank <= 5),
        f as (select *, row_number() over (partition by qid, key order by o desc, rank) as copy from b where o > 0), s as (select *, row_number() over (partition by qid order by o desc, rank) as place from f where copy = 1)
        select q.qid, coalesce(string_agg(trim(({T.sentences_sql('block', '.;')})[1]) || ' [' || key || '].', ' ' order by place), '{K.INSUFFICIENT}') as answer_text from (select distinct qid from pool) q left join (select * from s where place <= 2) s using (qid) group by q.qid""",
    "claims": f"with {_CLAIMS} select run_id, claim_id, text, array_to_string(cites, ' ') as cites from claims",
    "verify_answers": f"""with {_CLAIMS}, {_HELD}, one as (select run_id, claim_id, unnest(cites) as cite from claims),
        k as (select o.run_id, o.claim_id, case when not contains(o.cite, '#') then 'no_loinc' when h.cite_key is not null then 'ok' when not list_contains({_CODES_SQL}[1:6], split_part(o.cite, '#', 2)) then 'not_in_corpus' else 'not_retrieved' end as kind from one o left join (select distinct run_id, cite_key from held) h on h.run_id = o.run_id and h.cite_key = o.cite)
        select run_id, count(*) filter (kind <> 'ok') = 0 as ok, false as is_abstention, count(distinct claim_id) as n_claims, count(*) as n_cites, count(*) filter (kind <> 'ok') as n_bad, coalesce(string_agg(distinct case when kind <> 'ok' then kind end, ',' order by case when kind <> 'ok' then kind end), '') as kinds from k group by run_id""",
    "ledger_steps": f"with {_STEPS} select * from steps",
    "ledger_first_steps": f"with {_FIRST} select * from steps",
    "ledger_closure": f"""with {_FIRST}, p as (select run_id, 'untraceable' as problem from steps where first_step is null union all select run_id, 'wrong_step' from steps where first_step is not null and run_id % 7 = 0 and first_step <> 9 union all select o_orderkey, 'no_citation' from orders)
        select problem, count(*) as n, count(distinct run_id) as n_runs from p group by problem""",
    "attribution": f"with {_HELD}, {_layer_sql('a', 0)} select *, case layer when 'retrieval' then 'widen or redirect the search' when 'utilization' then 'select and order the evidence' when 'reasoning' then 'improve the generator' else '' end as suggestion from a_layers",
    "attribution_compare": f"with {_HELD}, {_layer_sql('a', 1)}, {_layer_sql('b', 0)} select l.layer, count(*) filter (a.layer = l.layer) as n_old, count(*) filter (b.layer = l.layer) as n_new, count(*) filter (a.layer = l.layer and b.layer = l.layer) as n_both from a_layers a join b_layers b using (run_id), (values ('none'), ('retrieval'), ('utilization'), ('reasoning')) l(layer) where l.layer in (a.layer, b.layer) group by l.layer",
    "linear_pipeline": SCORED.replace("questions as (", "subs as (select item_id as id, text from benchmark), base as (", 1).replace("asked as (select qid", "questions as (select qid::varchar || '/1' as qid, question from base union all select id::varchar || '/2', text from subs), asked as (select qid", 1)
    + """, h as (select split_part(qid, '/', 1)::bigint as run_id, split_part(qid, '/', 2)::int as sub, doc_id || '#' || loinc as cite_key, rank from lexical join chunks using (chunk_key) where rank <= 5),
        f as (select * from (select *, min(sub) over (partition by run_id, cite_key) as s from h) where sub = s),
        u as (select * from (select *, row_number() over (partition by run_id, cite_key order by sub, rank) as c from f) where c = 1),
        k as (select * from (select *, row_number() over (partition by run_id order by sub, rank, cite_key) as p from u) where p <= 3)
        select f.run_id, f.sub as step, count(*) as n_fresh, bool_or(k.cite_key is not null) as used_in_report, case when not bool_or(k.cite_key is not null) then 'context_budget' end as reason_dropped from f left join k on k.run_id = f.run_id and k.cite_key = f.cite_key group by f.run_id, f.sub""",
    "consistency_sides": f"{_SIDES} select * from sides",
    "consistency_pairs": f"{_PAIRS} select * from pairs",
    "consistency_kinds": f"{_PAIRS.replace(FIXTURE_WARNING, K.WARNING)} select kind, count(*) as n from pairs group by kind",
    "citation_balance": f"""{_PAIRS}, c as (select *, case when length(a) = length(b) then [a] else [a, b] end as cites from pairs), p as (select a, b, list_filter([case when x <> 'absent' and not list_contains(cites, a) then 'selective_citation:' || a end, case when x = 'absent' then 'silent_unstated:' || a end, case when y <> 'absent' and not list_contains(cites, b) then 'selective_citation:' || b end, case when y = 'absent' then 'silent_unstated:' || b end], lambda z: z is not null) as problems from c)
        select a || '|' || b as run_id, a, b, len(problems) = 0 as ok, array_to_string(problems, ',') as problems from p""",
    "session_resolve": f"with {_TURNS} select conv_id, turn, mode, cue, array_to_string(drugs, ',') as drugs, length(raw) + case when mode = 'from_context' and len(missing) > 0 then 3 + length(array_to_string(missing, ', ')) else 0 end as n_chars from asked",
    "session_summary": f"with {_TURNS} select mode, count(*) as n_turns, count(distinct conv_id) as n_convs from asked group by mode",
    "decision_report": f"""with {_STEPS}, p as (select action, case when step % 5 <> 0 then run_id % 2 = 0 end as outcome, (run_id + step) % 3 = 0 as c1, step % 4 = 0 as c2 from steps),
        s as (select action, outcome, outcome is not null and ((c1 and not outcome) or (c2 and not outcome)) as better, outcome is not null and ((not c1 and outcome) or (not c2 and outcome)) as worse from p),
        g as (select action, count(*) as n, count(*) filter (better) as n_better, count(*) filter (worse) as n_worse, count(*) filter (outcome) as n_outcome from s group by action)
        select action, n, round(n / sum(n) over (), 9) as share, max(n) over () / sum(n) over () < 0.7 as majority_ok, n_better, n_worse, n_outcome from g""",
    "available_actions": f"with {_STEPS}, p as (select action, count(*) as n from steps group by action) select action, other, n from p, (values ('search'), ('answer'), ('abstain'), ('locate')) o(other) where other <> action",
}
