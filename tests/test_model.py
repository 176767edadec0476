"""Calls of a model: order, limits, retries, two phases."""

import json
import threading
import time

import pytest

from evigraph.domains import Domain, load_domain
from evigraph.operators import extract
from evigraph.operators.model import Limits, ask, in_order


def test_answers_are_in_order_whatever_is_slow_or_fails():
    def model(prompt):
        time.sleep(0.002 * (hash(prompt) % 7))
        if int(prompt) % 5 == 0:
            raise ValueError("no")
        return prompt * 2

    got = list(in_order([str(k) for k in range(40)], model, Limits(in_flight=6, tries=2, wait=0)))
    assert got == [(None, "no", 2) if k % 5 == 0 else (str(k) * 2, None, 1) for k in range(40)]
    assert list(in_order([], model, Limits())) == []


def test_no_more_calls_are_in_flight_than_allowed():
    now, most, lock = [0], [0], threading.Lock()

    def model(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return prompt

    assert [a for a, _, _ in in_order(map(str, range(30)), model, Limits(in_flight=3))] == [str(k) for k in range(30)]
    assert most[0] == 3


def test_prompts_are_taken_as_answers_are_given():
    taken = []

    def prompts():
        for k in range(1000):
            taken.append(k)
            yield str(k)

    answers = in_order(prompts(), str, Limits(in_flight=2))
    next(answers)
    assert len(taken) <= 5


def test_a_hanging_call_is_given_up_and_a_failing_one_tried_again():
    calls, stop = [], threading.Event()

    def model(prompt):
        calls.append(prompt)
        if prompt == "hangs":
            stop.wait(20)
        if prompt == "second" and calls.count("second") < 2:
            raise RuntimeError("busy")
        return prompt

    began = time.time()
    got = list(in_order(["hangs", "second", "plain"], model, Limits(in_flight=1, seconds=0.2, tries=2, wait=0.01)))
    stop.set()
    assert got == [(None, "no answer in 0.2 seconds", 2), ("second", None, 2), ("plain", None, 1)] and time.time() - began < 5


BLOCKS = "document_id string, block_seq int, content string, level int, type string"


def blocks_of(spark, n=20):
    return spark.createDataFrame([("d", k, f"block {k} has figure {k}", 1 if k == 0 else None, "heading" if k == 0 else "paragraph") for k in range(n)], BLOCKS)


def test_kinds_and_phases(spark):
    """Twenty blocks in batches of five: twelve calls first, and four about relationships if there are two entities."""
    none = extract.extract(blocks_of(spark), lambda p: "{}", limits=Limits(tasks=2))
    rows = none["answers"].collect()
    assert len(rows) == 12 and {k: sum(r["kind"] == k for r in rows) for k in {r["kind"] for r in rows}} == {"entities": 4, "metrics": 4, "claims": 4}
    assert all(none[k].count() == 0 for k in ("entities", "metrics", "claims", "relations"))

    def model(prompt):
        assert "Section: block 0 has figure 0." in prompt or "Section: Unknown." in prompt
        assert prompt.startswith("Domain: Reports on tea.\nAmounts in kg.")
        if '"entities"' in prompt:
            assert "Entity types: LEAF." in prompt
            return json.dumps({"entities": [{"name": "Acme", "type": "LEAF"}, {"name": "acme", "type": "LEAF"}, {"name": "Beta", "type": "LEAF"}]})
        if '"metrics"' in prompt:
            raise ValueError("this kind fails")
        if '"claims"' in prompt:
            return "not JSON" if "block 7 " in prompt else json.dumps({"claims": [{"text": "t"}]})
        assert "Only between these entities: Acme, Beta." in prompt and "Relations: GROWS." in prompt
        return json.dumps({"relationships": [{"source": "acme", "target": "Beta", "type": "grows"}, {"source": "Acme", "target": "Nobody", "type": "grows"}]})

    tea = Domain("tea", "Reports on tea", ("LEAF",), ("GROWS",), "Amounts in kg.")
    got = extract.extract(blocks_of(spark), model, domain=tea, limits=Limits(tries=1))
    assert [r["name"] for r in got["entities"].collect()] == ["Acme", "Beta"] and got["metrics"].count() == 0 and got["claims"].count() == 3
    assert [(r["source"], r["target"], r["type"]) for r in got["relations"].collect()] == [("acme", "Beta", "GROWS")]
    rows = got["answers"].collect()
    assert len(rows) == 16 and {r["error"] for r in rows if r["kind"] == "metrics"} == {"this kind fails"} and {r["error"] for r in rows if r["kind"] != "metrics"} == {None}


def test_one_entity_asks_for_no_relationships(spark):
    model = lambda p: json.dumps({"entities": [{"name": "Acme", "type": "ORG"}]})
    got = extract.extract(blocks_of(spark, 5), model)
    assert got["relations"].count() == 0 and {r["kind"] for r in got["answers"].select("kind").collect()} == {"entities", "metrics", "claims"}


def test_asking_keeps_columns_and_deals_rows(spark):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(9)], "k int, text string")
    got = {r["k"]: (r["answer"], r["error"], r["tries"]) for r in ask(rows, str.upper, Limits(tasks=3)).collect()}
    assert got == {k: (f"T{k}", None, 1) for k in range(9)}


@pytest.mark.parametrize("kind", ["entities", "metrics", "claims", "relationships"])
def test_questions_name_their_key(kind):
    asked = load_domain("stock_analysis").question(kind, "the text", "Part 1", ["A", "B"])
    assert f'"{kind}"' in asked and asked.endswith("\n\nthe text") and "Section: Part 1." in asked and ("A, B" in asked) == (kind == "relationships")
