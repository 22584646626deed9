"""Problem 5: what looks the same, and what does not."""

import time

import pytest
from tables import clashing, day, evidence, nulls

from tessera.llm import lookalike
from tessera.llm.lookalike import look, plain_reader, reader


@pytest.fixture(scope="module", params=["icu", "basic"])
def read(request, spark):
    return reader(spark) if request.param == "icu" else plain_reader()


def test_joiners_are_decided_by_their_neighbours(read):
    arabic = "می‌خ"
    assert read.look("va‌lve " + arabic) == read.look("valve " + arabic)
    assert read.look(arabic) == arabic and read.look(arabic) != read.look(arabic.replace("‌", ""))


def test_same(read):
    for a, b in (("ＡＢ １", "AB 1"), ("café", "café"), ("a b c", "a b c"), ("vаlve", "valve"), ("ЅTOP", "STOP"), ("x​y﻿", "xy"),
                 ("ﬁt", "fit"), ("µm", "μm"), ("co‐op", "co-op")):
        assert read.look(a) == read.look(b), (a, b)


def test_different(read):
    for a, b in (("Stop", "stop"), ("a.b", "ab"), ("resume", "résumé"), ("a  b", "a b"), ("a\tb", "a b"), ("ſee", "see"), ("№", "No"), ("x²", "x2"), ("ϑ", "θ")):
        assert read.look(a) != read.look(b), (a, b)


def test_words_of_another_script_stay(read):
    for word in ("Привет", "ΠΡΟΣ", "насос", "Ωmega"[0]):
        assert read.look(word) == word


def test_kinds_of_tokens(spark):
    r = reader(spark)
    assert r.scripts("vаlve") == ("mixed", "Latin") and r.scripts("ЅТОР") == ("whole", "Latin") and r.scripts("Привет") == ("single", "Cyrillic")
    for a, b in (("xӀy", "xIy"), ("xѵy", "xvy"), ("ɡas", "gas"), ("ⲟil", "oil"), ("ꓮir", "Air"), ("Ꮋot", "Hot"), ("ϲode", "code"), ("Ϲode", "Code")):
        assert r.look(a) == b, (a, r.look(a))


def test_long_runs_take_linear_time(read):
    text = "漢" * 200_000 + "Ω"
    began = time.time()
    read.look(text)
    assert time.time() - began < 5


def test_found(spark):
    e = evidence(spark, {"evidence_id": "A", "text": "valve"}, {"evidence_id": "B", "text": "vаlve"}, {"evidence_id": "C", "text": "valve"}, {"evidence_id": "D", "text": "Valve"},
                 {"evidence_id": "E", "text": "café", "display_text": "old"}, {"evidence_id": "E", "text": "café", "display_text": "café", "loaded_at": day(9)},
                 {"evidence_id": "F", "text": "x", "display_text": ""}, {"evidence_id": "G", "text": ""}, {"evidence_id": "H", "block_type": "heading", "text": "vаlve"})
    wanted = {("text", "A", "B"), ("text", "B", "C"), ("display_text", "E", "E")}
    for df in (e, clashing(nulls(e))):
        assert {tuple(r) for r in lookalike.found(df).collect()} == wanted
    assert lookalike.found(e.limit(0)).count() == 0
    assert {r["evidence_id"]: r["text"] for r in lookalike.normalised(e).collect()}["B"] == "valve"
    assert {(r["token"], r["kind"]) for r in lookalike.confusable_tokens(e).collect()} == {("vаlve", "mixed")}


def test_module_function():
    assert look(None) is None and look("") == "" and look("vаlve") == "valve"
