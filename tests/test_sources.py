"""Files in and out, caches, model plugs, evaluation sets, streams, configuration."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import plugs
from attestor.operators import evalsets, metrics
from attestor.sources import labels as source
from attestor.sources.config import EngineConfig
from attestor.streaming import events

DIR = "/root/testdata/sf0.001"


def test_label_file(spark, tmp_path):
    sections = [{"loinc": "34068-7", "section": "Dosage", "display": "d", "text": " One. "}, {"loinc": "34068-7", "section": "Dosage", "display": "d", "text": None}]
    (tmp_path / "labels.json").write_text(json.dumps({"labels": [{"drug": "a", "setid": "00000001", "sections": sections}, {"drug": "b", "setid": "00000002", "sections": []}]}, indent=1))
    rows = source.read_labels(spark, f"file://{tmp_path}/labels.json").collect()
    assert [(r["setid"], r["sec_ord"], r["text"]) for r in rows] == [("00000001", 0, "One."), ("00000001", 1, None)]
    (tmp_path / "set.json").write_text(json.dumps({"n": 1, "note": "", "rows": [{"qid": "q1", "question": "?"}]}))
    assert source.read_eval_set(spark, f"file://{tmp_path}/set.json", "qid:string,question:string").first()["qid"] == "q1"


def test_ledger_round_trip_keeps_carried(spark, tmp_path):
    steps, carried = spark.createDataFrame([("r", 1)], "run_id string, step int"), spark.createDataFrame([("r", "d")], "run_id string, doc_id string")
    source.save_ledger(f"file://{tmp_path}/l", steps=steps, carried=carried)
    back = source.load_ledger(spark, f"file://{tmp_path}/l", "steps", "carried")
    assert back["carried"].collect() == carried.collect() and back["steps"].count() == 1


def test_page_sections(spark):
    long = "word " * 30
    html = f"<html><script>var t='<p>no</p>';</script><nav><p>{long}</p></nav><!-- <p>no</p> --><div class=\"ad\">{long}</div><article><h1>A <b>title</b></h1><p>{long}<p>short</p><p class=x><i>{long}</i> end</p></article><footer><p>{long}</p></footer></html>"
    rows = source.page_sections(spark.createDataFrame([(1, "u", html), (2, "v", ""), (3, "w", None)], "page_id long, url string, html string")).collect()
    assert [(r["page_id"], r["title"], r["text"]) for r in rows] == [(1, "A title", long.strip()), (1, "A title", f"{long.strip()} end")]


def test_caches_and_plugs(spark):
    pairs = spark.createDataFrame([("q", "a b"), ("q", "c"), ("r", "a")], "question string, text string")
    load = lambda: lambda rows: [float(len(t)) for _, t in rows]
    first, new = plugs.scored(pairs, "question", "text", load, "m1")
    assert {r["text"]: r["relevance"] for r in first.collect()} == {"a b": 3.0, "c": 1.0, "a": 1.0} and new.count() == 3
    again, none = plugs.scored(pairs, "question", "text", lambda: lambda rows: [-1.0] * len(rows), "m1", cache=new)
    assert none.count() == 0 and {r["relevance"] for r in again.collect()} == {3.0, 1.0}
    other, more = plugs.scored(pairs, "question", "text", lambda: lambda rows: [-1.0] * len(rows), "m2", cache=new)
    assert more.count() == 3 and {r["relevance"] for r in other.collect()} == {-1.0}
    v = plugs.encoded(pairs, "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])).select("vector").collect()
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in v)
    said, _ = plugs.generated(pairs.withColumnRenamed("text", "prompt"), "prompt", lambda: str.upper, "m1")
    assert {r["answer_text"] for r in said.collect()} == {"A B", "C", "A"}


def test_configuration_refuses_unknown_values():
    assert EngineConfig().retriever == "hybrid"
    for bad in ({"retriever": "magic"}, {"order": "random"}, {"evidence_budget": -1}, {"theta_low": 0.9}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_fingerprint_moves_with_any_text_only(spark):
    c = spark.createDataFrame([(f"k{n}", f"text {n}") for n in range(50)], "chunk_key string, text string")
    one = source.fingerprint(c).first()
    assert source.fingerprint(c.repartition(7)).first() == one and one["n"] == 50
    assert source.fingerprint(c.withColumn("text", F.when(F.col("chunk_key") == "k3", "x").otherwise(F.col("text")))).first() != one


def test_entities_are_cleaned_and_checked(spark):
    text = "X. Known hypersensitivity to any aspirin or salts [see 4]. 1. Renal disease (severe) 2. Use"
    s = spark.createDataFrame([("drugname", "34070-3", text)], "drug string, loinc string, text string")
    got = evalsets.extract_entities(s, {"contraindication": [r"[Kk]nown hypersensitivity to ([a-z][^.;,]{3,60})", r"\b\d+\.\s+([A-Z][^.;(]{5,90})"]}, {"contraindication": "34070-3"}, ["use"])
    assert sorted(r["entity"] for r in got.collect()) == ["Renal disease", "aspirin"]
    kept = evalsets.answerable(spark.createDataFrame([("Renal disease", "renal trouble"), ("the one", "the one"), ("gout", "none"), ("A1 x", "a1")], "entity string, target string"))
    assert [r["entity"] for r in kept.collect()] == ["Renal disease"]


def test_unsupported_golds(spark):
    q = spark.createDataFrame([("q1", ["a#1", "b#1"])], "qid string, golds array<string>")
    assert evalsets.unsupported_golds(q, spark.createDataFrame([("a#1",)], "cite_key string")).collect() == [("b#1", "q1")]


def test_policy_metrics(spark):
    stats = spark.createDataFrame([("a", "p", True, 3, 4), ("b", "p", False, 2, 3), ("c", "p", True, 3, 4)], "run_id string, policy string, answered boolean, n_actions int, cost_spent int")
    want = spark.createDataFrame([("a", None, True), ("b", "out_of_scope", None), ("c", "out_of_scope", None)], "run_id string, boundary_class string, correct boolean")
    r = metrics.policy_metrics(stats, want).first()
    assert (r["accuracy"], r["refusal"], r["hard_answer"]) == (1.0, 0.5, 0.5)
    assert metrics.refusal_by_class(stats, want).first()["n_refused"] == 1


def test_stream_windows_equal_the_batch(spark):
    path = f"{DIR}/event[s].parquet"
    out = events.run_to_end(events.windowed(events.read_events(spark, path)))
    batch = spark.read.parquet(f"{DIR}/events.parquet").groupBy(F.window("ts", "1 hour").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    want = {(r["window_start"], r["event_type"]): r["n"] for r in batch.collect()}
    got = {(r["window_start"], r["event_type"]): r["n"] for r in out.collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > len(want) / 2


def test_stream_windows_of_unordered_files_equal_the_batch(spark, tmp_path):
    from attestor.plans import evaluation

    rows = spark.read.parquet(f"{DIR}/events.parquet")
    rows.repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    batch = rows.groupBy(F.unix_timestamp(F.window("ts", "1 hour").start).alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    got = evaluation.stream_windows(spark, str(tmp_path)).select("window_start", "event_type", "n")
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert evaluation.stream_windows(spark, str(tmp_path)).isEmpty()


def test_sessions_and_complementarity_take_whole_texts(spark, monkeypatch):
    from attestor.operators import ranking, sessions
    from attestor.plans import evaluation, evidence

    class Seen(Exception):
        pass

    def look(*args):
        raise Seen(args)

    monkeypatch.setattr(sessions, "run_turns", look)
    monkeypatch.setattr(ranking, "keyword_scores", look)
    turns = spark.createDataFrame([("c", 0, " ".join(f"w{k}" for k in range(40)))], "conv_id string, turn int, question string")
    monkeypatch.setattr(sessions, "resolve", lambda _: turns.withColumn("drugs", F.array(F.lit("src1"))))
    with pytest.raises(Seen) as seen:
        evidence.session_runs(spark, DIR)
    assert seen.value.args[0][2].first()["question"].split(" ")[-1] == "w39"
    with pytest.raises(Seen) as seen:
        evaluation.complementarity(spark, DIR)
    assert seen.value.args[0][1].agg(F.max(F.size("keywords"))).first()[0] > 8


XML = """<?xml version="1.0"?><document xmlns="urn:hl7-org:v3"><setId root="a1b2c3d4"/><component><structuredBody>
<component><section><code code="34073-7" displayName="INTERACTIONS"/><title>Outer</title><text>Own words of the outer section, <b>bold</b> ones too, which make more than sixty letters.</text>
<component><section><code code="34070-3" displayName="CONTRA"/><text>Words   of the inner\nsection stand alone and are long enough to be kept as a section.</text></section></component>
<text>A second text of the outer one.</text></section></component>
<component><section><code code="34071-1"/><text>Too short.</text></section></component>
<component><section><code code="99999-9"/><text>A code that nobody wants, with a text that would be long enough to be kept.</text></section></component>
<component><section><code code="34072-5"/><title>Without a text element all words of the section count as its own words.</title></section></component>
</structuredBody></component></document>"""


def test_label_documents_in_xml(spark, tmp_path):
    (tmp_path / "one.xml").write_text(XML)
    got = [tuple(r) for r in source.read_label_xml(spark, str(tmp_path)).orderBy("sec_ord").collect()]
    assert got == [
        ("a1b2c3d4", 0, "34073-7", "Drug Interactions", "INTERACTIONS", "Own words of the outer section, bold ones too, which make more than sixty letters. A second text of the outer one."),
        ("a1b2c3d4", 1, "34070-3", "Contraindications", "CONTRA", "Words of the inner section stand alone and are long enough to be kept as a section."),
        ("a1b2c3d4", 2, "34072-5", "Adverse Reactions", None, "Without a text element all words of the section count as its own words."),
    ]


def test_sets_decisions_and_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("q2", "b", ["x"]), ("q1", "a", [])], "qid string, question string, golds array<string>")
    source.write_eval_set(str(tmp_path / "set"), rows, "a note")
    assert [r["qid"] for r in source.read_eval_set(spark, str(tmp_path / "set"), "qid: string, question: string, golds: array<string>").collect()] == ["q1", "q2"]
    points = spark.createDataFrame([("r", 0, "search", False, {"answer": True})], "run_id string, index int, action string, outcome boolean, cf map<string,boolean>")
    source.write_decisions(str(tmp_path / "log"), points)
    line = spark.read.json(str(tmp_path / "log")).first()
    assert line["better_exists"] and not line["worse_exists"] and line["has_gradient"]
    source.write_report(str(tmp_path / "report"), layers=rows.select("qid"), totals=rows.groupBy().count())
    report = spark.read.json(str(tmp_path / "report")).first()
    assert sorted(r["qid"] for r in report["layers"]) == ["q1", "q2"] and report["totals"][0]["count"] == 2


def test_prose_is_read_from_a_file(spark, tmp_path):
    import dataclasses
    import json

    from attestor.sources.fixtures import PROSE
    from attestor.sources.prose import read_prose

    held = dataclasses.asdict(PROSE)
    (tmp_path / "prose.json").write_text(json.dumps(held))
    assert read_prose(spark, str(tmp_path / "prose.json")) == PROSE
    (tmp_path / "prose.json").write_text(json.dumps({k: v for k, v in held.items() if k != "names"}))
    with pytest.raises(ValueError, match="names"):
        read_prose(spark, str(tmp_path / "prose.json"))


def test_vectors_come_from_the_cache(spark):
    from attestor.functions import plugs

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string")
    model = lambda: lambda texts: [[len(t) + 1.0, 0.0] for t in texts]
    first, new = plugs.encoded(df, "text", model, model="m", cache=spark.createDataFrame([], "key string, value array<float>"))
    assert new.count() == 3 and {r["id"]: r["vector"] for r in first.collect()} == {k: [1.0, 0.0] for k in (1, 2, 3, 4)}
    held = spark.createDataFrame([(r["key"], [0.0, 1.0]) for r in new.collect()], "key string, value array<float>")
    again, more = plugs.encoded(df, "text", model, model="m", cache=held)
    assert more.count() == 0 and {tuple(r["vector"]) for r in again.collect()} == {(0.0, 1.0)}
    assert plugs.encoded(df, "text", model, model="other", cache=held)[1].count() == 3
