"""Registered queries read whole tables and whole texts."""

import pandas as pd

from ledgerlens.plans import library, pairs, routing


def write(folder, **tables):
    for name, rows in tables.items():
        pd.DataFrame(rows).to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    return str(folder)


def test_preflight_reads_whole_documents(spark, tmp_path):
    text = "some words of no use " * 40 + "paint the red plate"
    at = write(tmp_path, part=[{"p_partkey": 1, "p_name": "qqq zzz", "p_size": 1}], documents=[{"doc_id": 4, "text": text}])
    got = {r.task: r for r in library.preflight_decision(spark, at).collect()}
    # the phrase 8, three words in common 1.5 and less than 2, nothing else
    assert got["paint the red plate"].best_score == 9.5 and got["paint the red plate"].decision == "suggest"
    assert got["nothing of this"].decision == "noop"


def test_directives_and_names_are_not_capped(spark, tmp_path):
    part = [{"p_partkey": k, "p_name": f"name{k} other{k}", "p_size": 1} for k in range(380, 460)]
    events = [{"event_id": 3, "ts": pd.Timestamp("2024-01-01"), "user_id": 1, "event_type": "error", "value": 1.0, "props": '{"k": 7}'}]
    at = write(tmp_path, part=part, events=events)
    assert {r.id for r in routing.directive_scores(spark, at).collect() if r["class"] == "global_always_on_directive"} == {400, 450}
    got = pairs.event_concept_matches(spark, at).collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and len(got[0].summary) >= 40
    part = [*part, {"p_partkey": 999, "p_name": got[0].summary, "p_size": 1}]  # after the first 64 names
    best = pairs.event_concept_matches(spark, write(tmp_path, part=part)).where("rank = 1").head()
    assert best.name == best.summary and best.similarity == 1.0
