"""Hand-written cases: chunk walk, tokens, routing, confidence, verification, attribution, loop, sessions."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.functions import constants as K
from attestor.functions import text as T
from attestor.sources.config import EngineConfig
from attestor.operators import agent, answering, chunking, decisions, ledger, ranking, routing, selection, sessions


def walk(sizes, target):
    """The chunk loop, sentence by sentence."""
    spans, i = [], 0
    while i < len(sizes):
        j, held = i, 0
        while j < len(sizes) and (held < target or j == i):
            held += sizes[j] + 1
            j += 1
        spans.append((i, j - 1))
        i = max(i + 1, j - 1)
    return spans


def test_packed_sentences_equal_the_loop():
    rng = random.Random(3)
    cases = [[rng.choice([1, 5, 40, 120, 300, 500, 900]) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    for sizes in cases:
        assert chunking.packed(sizes) == walk(sizes, K.TARGET_CHARS)
        assert chunking.packed(sizes, drop_tail=True) in (walk(sizes, K.TARGET_CHARS), walk(sizes, K.TARGET_CHARS)[:-1])


def test_chunks_number_through_repeated_codes_and_skip_blanks(spark):
    rows = [("00000001", "d", 0, "c", "S", "One. Two."), ("00000001", "d", 1, "c", "S", "   "), ("00000001", "d", 2, "c", "S", "Three.")]
    c = chunking.build_chunks(spark.createDataFrame(rows, "setid string, drug string, sec_ord int, loinc string, section string, text string"))
    assert [r["chunk_id"] for r in c.orderBy("chunk_key").collect()] == ["00000001#c#1", "00000001#c#2", "00000001#c#3"]
    assert c.where("text = 'Two.'").first()["char_span"] == (5, 9)


@pytest.mark.parametrize("text,words", [("What's the price", ["price"]), ("I can't, don't", ["ca"]), ("patient's dose 5.1", ["patient", "dose", "5", "1"]), (None, []), ("", [])])
def test_tokens(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(T.tokens("t")).first()[0] == words


def test_citations_and_strictness(spark):
    rows = [("See [a1b2c3d4#34073-7] and [A1B2C3D4-00].",), ("None.",), ("[short#1-1]",)]
    got = spark.createDataFrame(rows, "t string").select(T.citations("t"), T.strict("t")).collect()
    assert [(r[0], r[1]) for r in got] == [(["a1b2c3d4#34073-7", "A1B2C3D4-00"], False), ([], True), ([], True)]


def test_routing_rules(spark):
    labels = spark.createDataFrame([("aspirin", ["34068-7", "34073-7"]), ("omeprazole", ["34070-3"]), ("esomeprazole", ["34073-7"])], "drug string, codes array<string>")
    q = spark.createDataFrame([(1, "What dose of aspirin?"), (2, "Both aspirin and omeprazole are on my list."), (3, "esomeprazole"), (4, "side effects of aspirin"), (5, "dose"), (6, None)], "qid int, question string")
    got = {r["qid"]: r for r in routing.locate(q, labels).collect()}
    assert got[1]["loincs"] == ["34068-7"] and got[1]["intent"] == "dosage"
    assert got[2]["intents"] == ["interaction"] and got[2]["loincs"] == ["34073-7"]
    assert got[3]["drugs"] == ["esomeprazole", "omeprazole"] and got[3]["intent"] == "interaction"
    assert got[4]["intent"] == "adverse_reactions" and got[4]["loincs"] == []
    assert got[5]["drug"] is None and got[5]["loincs"] == ["34068-7"]
    assert got[6]["drugs"] == [] and got[6]["intent"] is None


def test_confidence_is_zero_for_few_scores(spark):
    rows = [(1, f"k{k}", 1.0 + k) for k in range(4)] + [(2, f"k{k:02}", 1.0 + k) for k in range(9)] + [(3, f"k{k:02}", 1.0 + k) for k in range(20)]
    got = dict(ranking.lexical_confidence(spark.createDataFrame(rows, "qid int, chunk_key string, bm25 double")).collect())
    assert got == {1: 0.0, 2: 0.0, 3: pytest.approx(2 / 20)}


def test_verification_kinds(spark):
    cites = spark.createDataFrame([("r", "c1", "aaaaaaaa"), ("r", "c1", "aaaaaaaa#1-1"), ("r", "c2", "bbbbbbbb#1-1"), ("r", "c2", "cccccccc#1-1")], "run_id string, claim_id string, cite string")
    held = spark.createDataFrame([("r", "aaaaaaaa#1-1")], "run_id string, cite_key string")
    corpus = spark.createDataFrame([("aaaaaaaa#1-1",), ("bbbbbbbb#1-1",)], "cite_key string")
    assert {r["cite"]: r["kind"] for r in answering.verify_cites(cites, held, corpus).collect()} == {"aaaaaaaa": "no_loinc", "aaaaaaaa#1-1": "ok", "bbbbbbbb#1-1": "not_retrieved", "cccccccc#1-1": "not_in_corpus"}


def test_answers_without_claims(spark):
    a = spark.createDataFrame([("x", "The evidence is insufficient."), ("y", "It is fine.")], "run_id string, answer_text string")
    held = spark.createDataFrame([], "run_id string, cite_key string")
    assert {r["run_id"]: (r["ok"], r["is_abstention"]) for r in answering.verify_answers(a, held).collect()} == {"x": (True, True), "y": (False, False)}


def test_attribution_layers(spark):
    keys = "run_id string, cite_key string"
    gold = spark.createDataFrame([(r, "g") for r in "abcde"], keys)
    got = spark.createDataFrame([(r, "g") for r in "acde"], keys)
    said = spark.createDataFrame([(r, "g") for r in "ade"] + [("b", "g")], keys)
    right = spark.createDataFrame([(r, r == "a") for r in "abcde"], "run_id string, correct boolean")
    assert {r["run_id"]: r["layer"] for r in ledger.attribution(gold, got, said, right).collect()} == {"a": "none", "b": "retrieval", "c": "utilization", "d": "reasoning", "e": "reasoning"}


def test_first_step_wildcards_and_carried(spark):
    cites = spark.createDataFrame([("r", "1", "d", "x"), ("r", "2", "d", None), ("r", "3", "e", "x"), ("r", "4", "f", "x"), ("r", "5", "g", "x")], "run_id string, claim_id string, doc_id string, loinc string")
    got = spark.createDataFrame([("r", 2, "d", "x"), ("r", 1, "d", "y"), ("r", 3, "e", None)], "run_id string, step int, doc_id string, loinc string")
    carried = spark.createDataFrame([("r", "f", "x")], "run_id string, doc_id string, loinc string")
    assert {r["claim_id"]: r["first_step"] for r in ledger.first_steps(cites, got, carried).collect()} == {"1": 2, "2": 1, "3": 3, "4": -1, "5": None}


def test_ledger_violations(spark):
    steps = spark.createDataFrame([("r", 1, "retrieve", "", None, None, None), ("r", 2, "fly", "q", None, None, None), ("r", 3, "abstain", None, "", None, None), ("r", 4, "read", None, None, False, None), ("r", 5, "read", None, None, False, "tired"), ("r", 6, "plan", None, None, None, None)], "run_id string, step int, action string, query string, note string, used_in_report boolean, reason_dropped string")
    assert sorted((r["rule"], r["step"]) for r in ledger.violations(steps).collect()) == [("abstain_without_note", 3), ("query_missing", 1), ("unknown_action", 2), ("unknown_drop_reason", 5), ("unused_without_reason", 4)]


def test_selection_order_and_budget(spark):
    rows = [("r", 1, "a", "x", 1.0), ("r", 2, "b", "y", 1.0), ("r", 3, "b", "x", 1.0), ("r", 4, "b", "x", 1.0)]
    pool = spark.createDataFrame(rows, "run_id string, pos int, drug string, loinc string, authority double").withColumns({"asked": F.array(F.lit("b")), "codes": F.array(F.lit("x"))})
    assert [(r["pos"], r["struct_rank"], r["keep"]) for r in selection.select(pool, 2).orderBy("place").collect()] == [(3, 3, True), (4, 3, True), (1, 2, False), (2, 1, False)]
    assert [r["pos"] for r in selection.select(pool, reverse=True).orderBy("place").collect()] == [4, 3, 2, 1]


def test_session_resolution(spark):
    turns = [(1, 0, "What about aspirin?", ["aspirin"]), (1, 1, "Can I take it daily?", []), (1, 2, "And warfarin too?", ["warfarin"]), (1, 3, "The item list", []), (2, 0, "Is it safe?", [])]
    got = {(r["conv_id"], r["turn"]): (r["mode"], r["drugs"], r["question"]) for r in sessions.resolve(spark.createDataFrame(turns, "conv_id int, turn int, raw string, named array<string>")).collect()}
    assert got[1, 0][:2] == ("explicit", ["aspirin"])
    assert got[1, 1] == ("from_context", ["aspirin"], "Can I take it daily? (aspirin)")
    assert got[1, 2][:2] == ("from_context", ["aspirin", "warfarin"])
    assert got[1, 3][0] == "none" and got[2, 0][0] == "none"


CORPUS = [
    ("aaaaaaaa", "aspirin", 0, "34068-7", "Dosage and Administration", "Take one tablet of aspirin a day. Swallow it whole."),
    ("aaaaaaaa", "aspirin", 1, "34073-7", "Drug Interactions", "Avoid aspirin with warfarin. Bleeding may follow."),
    ("bbbbbbbb", "warfarin", 0, "34070-3", "Contraindications", "Warfarin is contraindicated in pregnancy. Do not use it."),
]


@pytest.fixture(scope="module")
def retriever(spark):
    return agent.Retriever(spark, chunking.build_chunks(spark.createDataFrame(CORPUS, "setid string, drug string, sec_ord int, loinc string, section string, text string")))


def test_loop_invariants_and_counterfactuals(spark, retriever):
    questions = ["What is the recommended dose of aspirin?", "Can I take aspirin together with warfarin?", "What are the side effects of aspirin?", "What is the price of tea?", "Is warfarin safe for someone with gout?"]
    runs = spark.createDataFrame([(f"{p}{k}", q, p) for k, q in enumerate(questions) for p in ("rule", "coverage")], "run_id string, question string, policy string")
    final = agent.run(retriever, runs)
    rows = {r["run_id"]: r for r in agent.stats(final).collect()}
    assert len(rows) == 10
    for r in rows.values():
        paid = sum(K.COSTS[a] for a in r["path"].split(">") if a in K.COSTS)
        assert paid >= r["cost_spent"] and r["terminated_by"] in ("answer", "abstain", "budget", "max_steps", "repeat")
        assert r["answered"] != (r["abstain_reason"] is not None)
    assert rows["rule0"]["answered"] and rows["coverage0"]["answered"]
    assert rows["coverage2"]["abstain_reason"] == "no_such_section" and rows["coverage3"]["terminated_by"] == "abstain"
    assert rows["rule3"]["terminated_by"] == "abstain"
    for r in final.collect():
        held = {e["cite_key"] for e in r["evidence"]}
        assert all(c in held for c in spark.createDataFrame([(r["answer_text"] or "",)], "t string").select(T.citations("t")).first()[0])
    again = {r["run_id"]: r["path"] for r in agent.stats(agent.run(retriever, runs.repartition(3, "question"))).collect()}
    assert again == {k: r["path"] for k, r in rows.items()}
    points = decisions.points(final)
    replays = agent.stats(agent.run(retriever, decisions.replays(points, runs)))
    assert replays.count() == points.select(F.size(F.array_except(F.array(*map(F.lit, ["search", "answer", "abstain", "locate"])), F.array("action"))).alias("n")).agg(F.sum("n")).first()[0]
    assert replays.where("run_id like '%~0~abstain'").select("path").distinct().first()[0] == "abstain"


def test_failed_citations_are_looked_for_by_label_and_section(spark, retriever):
    """What a failed citation meant is searched by label and section, then without limits; the policy answers no more. An unknown document or a missing section gives no target."""
    dose = "What is the recommended dose of aspirin?"
    answers = {"meant": ["See it [bbbbbbbb#34070-3]."], "invented": ["See it [deadbeef#34070-3]."], "bare": ["See it [bbbbbbbb]."], "right": ["See it [aaaaaaaa#34068-7]."], "plain": ["No citation at all."], "copier": None}
    runs = spark.createDataFrame([(k, dose, "coverage", v, 0.3) for k, v in answers.items()], "run_id string, question string, policy string, scripts array<string>, theta_high double")
    final = agent.run(retriever, runs)
    got = {r["run_id"]: r for r in agent.stats(final).collect()}
    assert got["meant"]["path"] == "locate>search>answer>search>search>abstain" and got["meant"]["abstain_reason"] == "bad_citations:not_retrieved"
    assert got["invented"]["path"] == "locate>search>answer>search>abstain" and got["invented"]["abstain_reason"] == "bad_citations:not_in_corpus"
    assert got["bare"]["path"] == got["invented"]["path"] and got["bare"]["abstain_reason"] == "bad_citations:no_loinc"
    assert got["right"]["path"] == got["copier"]["path"] == "locate>search>answer" and got["right"]["answered"]
    states = {r["run_id"]: r for r in final.collect()}
    assert "search|what is the recommended dose of aspirin?|warfarin|34070-3" in states["meant"]["tried"]
    assert {(e["cite_key"], s) for e, s in zip(states["meant"]["evidence"], states["meant"]["evidence_steps"]) if s > 2} == {("bbbbbbbb#34070-3", 4)}
    closed = {r["run_id"]: r for r in agent.finished(final, strict=True).collect()}
    assert [(closed[k]["n_claims"], closed[k]["malformed"]) for k in ("right", "meant", "invented", "bare")] == [(1, False), (0, False), (0, False), (0, False)]
    assert closed["copier"]["n_claims"] >= 1 and got["plain"]["terminated_by"] in ("repeat", "max_steps", "budget")
    lost = final.withColumn("evidence_steps", F.expr("cast(array() as array<int>)")).withColumn("evidence", F.expr(f"cast(array() as array<{agent.DOC}>)"))
    assert {"right", "copier"} <= {r["run_id"] for r in agent.finished(lost).where("malformed").collect()}
    with pytest.raises(ValueError):
        agent.finished(lost, strict=True)


def test_dense_list_and_reranker_reach_the_agent(spark, retriever):
    """A question without a known word finds its chunk by vectors alone; a scorer turns the order of what a label allows."""
    def encode(rows, text):
        return rows.withColumn("vector", F.expr(f"case when lower({text}) rlike 'pregnan|expecting' then array(1.0D, 0.0D) when {text} is not null then array(0.0D, 1.0D) end"))

    near = agent.Retriever(spark, retriever.chunks, encode)
    full = agent.Retriever(spark, retriever.chunks, encode, lambda pairs: pairs.withColumn("relevance", F.when(F.col("text").contains("Bleeding"), 2.0).otherwise(1.0)))
    asked = spark.createDataFrame([("near", "I am expecting", False, [], []), ("both", "aspirin whole tablet", False, [], []), ("own", "expecting", True, ["warfarin"], ["34070-3"])], "qid string, question string, restricted boolean, drugs array<string>, loincs array<string>")
    plain, dense, rich = ({r["qid"]: [d["cite_key"] for d in r["docs"]] for r in x.hits(asked).collect()} for x in (retriever, near, full))
    assert "near" not in plain and dense["near"][0] == "bbbbbbbb#34070-3" and dense["own"] == plain["own"] == rich["own"]
    assert dense["both"][0] == "aaaaaaaa#34068-7" and rich["both"][0] == "aaaaaaaa#34073-7"


def test_a_configuration_sets_the_runs(spark, retriever):
    runs = spark.createDataFrame([("r", "Can I take aspirin together with warfarin?")], "run_id string, question string")
    final = agent.run_configured(spark, retriever.chunks, runs, EngineConfig(retriever="bm25", budget=3, theta_high=1.0, theta_low=0.9, order="reverse")).first()
    assert final["theta_low"] == 0.9 and final["reverse"] and final["budget"] <= 3 and final["terminated_by"] in ("abstain", "answer", "budget")


def test_turns_inherit_evidence(spark, retriever):
    turns = spark.createDataFrame([(1, 0, "What is the recommended dose of aspirin?", ["aspirin"]), (1, 1, "How much of it is the recommended dose?", [])], "conv_id int, turn int, raw string, named array<string>")
    out = {r["run_id"]: r for r in sessions.run_turns(spark, retriever, sessions.resolve(turns), 1).collect()}
    assert out["1/0"]["n_carried"] == 0 and out["1/1"]["n_carried"] == len(out["1/0"]["evidence"]) > 0
