"""What feeds several branches of a query is worked out once."""

from dialoglens.operators import evaluation, results
from dialoglens.plans import evaluation_queries, pipeline_queries


def counting(monkeypatch, module, name):
    calls, whole = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or whole(*a, **k))
    return calls


def test_gate_and_recommendations_work_once(db, monkeypatch):
    structured = counting(monkeypatch, results, "structure_result")
    assert pipeline_queries._gated(db).count() == db.responses.count() and len(structured) == 1
    texts = counting(monkeypatch, evaluation, "missed_transcripts")
    assert evaluation_queries._recommended(db).count() == 3 and len(texts) == 1
