"""Register operators where the test tables say little: audit, numbering, streams, sections."""

from pyspark.sql import functions as F
from tables import day, evidence

from tessera.operators import audit, classification, conflicts, duplicates, register
from tessera.operators.standing import evidence as standing
from tessera.sources import intake
from tessera.streaming import deliveries


def test_chain_is_broken_by_any_change(spark):
    log = spark.createDataFrame([("a", i, f"p{i}") for i in range(6)] + [("b", 1, "x"), (None, 1, "y"), ("c", 1, None)], "e string, at int, p string")
    chain = audit.chained(log, "e", ["at"], "p")
    assert chain.count() == 7 and audit.broken(chain, "e").count() == 0
    changed = chain.withColumn("payload", F.when((F.col("e") == "a") & (F.col("number") == 4), "forged").otherwise(F.col("payload")))
    assert [tuple(r) for r in audit.broken(changed, "e").collect()] == [("a", 4)]
    missing = chain.where("NOT (e = 'a' AND number = 2)")
    assert [tuple(r) for r in audit.broken(missing, "e").collect()] == [("a", 3)]


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = intake.numbered(rows, "k", first=10).collect()
    assert all(r["n"] == r["k"] + 10 for r in got) and len(got) == 1000


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rel_path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "rel_path string, sha256 string")
    assert {tuple(r) for r in intake.changes(old, new).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "missing"), ("d", "new")}


def test_listing(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "skip.txt").write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"][:8]) for r in intake.listing(spark, str(tmp_path), "*.txt", ("skip",)).collect()}
    assert got == {"a.txt": (5, "2cf24dba"), "b.txt": (1, "2d711642")}


def test_upserts_from_a_stream(spark, tmp_path):
    rows = evidence(spark, {"evidence_id": "A", "status": "new"}, {"evidence_id": "B", "status": "new"}, {"evidence_id": None}, {"evidence_id": "A", "status": "old", "loaded_at": day(-5)},
                    {"evidence_id": "A", "status": "last", "loaded_at": day(5)})
    rows.repartition(3).write.parquet(str(tmp_path / "e"))
    assert {(r["evidence_id"], r["status"]) for r in deliveries.upserted(spark, str(tmp_path / "e"), "evidence_id", ["status"]).collect()} == {("A", "last"), ("B", "new")}


def test_once_in_a_stream(spark, tmp_path):
    spark.createDataFrame([(i % 3, day(0)) for i in range(9)], "event_id int, ts timestamp").write.parquet(str(tmp_path / "e"))
    assert deliveries.once(spark, str(tmp_path / "e"), "event_id", "1 hour").count() == 3


def test_section_paths(spark):
    rows = [("1", 1, 1, 1, "A"), ("2", 1, 2, 2, "B"), ("3", 2, 1, 2, "C"), ("4", 2, 2, 3, "D"), ("5", 3, 1, 1, "E"), ("6", 3, 2, 3, "F")]
    df = spark.createDataFrame([("S", i, p, s, lv, x, "heading") for i, p, s, lv, x in rows], "source_id string, evidence_id string, page_no int, seq int, heading_level int, text string, block_type string")
    assert {r["evidence_id"]: r["path"] for r in register.section_paths(df).collect()} == {"1": "A", "2": "A > B", "3": "A > C", "4": "A > C > D", "5": "E", "6": "E > F"}


def test_exact_groups_keep_a_sources_own_safety_repetitions(spark):
    columns = "evidence_id string, source_id string, page_no int, seq int, block_type string, status string, text string, section_heading string, equipment string, model string"
    row = lambda i, s, p, b, x, h="1 Safety": (i, s, p, 1, b, "active", x, h, None, "HX-1; HX-2")
    e = spark.createDataFrame([row("a", "S1", 1, "warning", "Hot!"), row("b", "S1", 2, "warning", "HOT!"), row("c", "S2", 1, "warning", "Hot!", "2. Safety"), row("d", "S1", 3, "paragraph", "Same"), row("e", "S1", 4, "paragraph", "same"),
                               row("f", "S9", 1, "paragraph", "same", "Other")], columns)
    s = spark.createDataFrame([("S1", True, "complete"), ("S2", False, "complete")], "source_id string, is_repaired boolean, extraction_status string")
    assert {(r["evidence_id"], r["canonical_id"]) for r in duplicates.exact_groups(duplicates.keyed(e, s)).collect()} == {("a", "c"), ("c", "c"), ("d", "d"), ("e", "d")}


def test_guards(spark):
    columns = "evidence_id string, text string, block_type string, safety_level string, component string, source_id string, revision string, equipment string, model string"
    e = spark.createDataFrame([("a", "1. Set 5 bar, do not open.", "warning", "warning", "pump", "S1", "A", None, "M1"), ("b", "2. Set 6 psi, open.", "paragraph", None, "valve", "S2", "B", None, "M2"),
                               ("c", "1. Set 5 bar, do not open.", "warning", "warning", "pump", "S1", "A", None, "M1")], columns)
    pairs = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c")], "pair_id string, evidence_a string, evidence_b string")
    got = {r["pair_id"]: r["flags"] for r in duplicates.guarded_pairs(pairs, e).collect()}
    assert got["2"] == [] and got["1"] == ["numbers_differ", "units_differ", "warning_or_signal_word_differs", "negation_differs", "applicability_differs", "revision_differs", "procedure_step_differs", "block_type_differs"]


def test_chapters_and_subjects(spark):
    e = spark.createDataFrame([("a", "Tighten and install the lid.", "paragraph", "4.2 Installation"), ("b", "Nothing.", "paragraph", None), ("c", "Hot surface.", "danger", None)],
                              "evidence_id string, text string, block_type string, section_heading string")
    got = {r["evidence_id"]: (r["chapter"], r["score"], r["outcome"]) for r in classification.chapters_of(e).collect()}
    assert got == {"a": ("procedures", 6.0, "classified"), "b": ("unclassified", 0.0, "unclassified"), "c": ("safety", 3.0, "classified")}
    s = spark.createDataFrame([("Check the oil. Torque of the cover screws, max ",)], "x string").select(conflicts.subject(conflicts.clause_before(F.col("x"), F.length("x"))).alias("s")).first()["s"]
    assert s == "maximum"
    assert spark.createDataFrame([("the cover screws and the pump glass",)], "x string").select(conflicts.subject(F.col("x")).alias("s")).first()["s"] == "bolt cover glass pump"


def test_standing_takes_the_last_delivery(spark):
    e = evidence(spark, {"evidence_id": "A", "status": "active", "text": "x"}, {"evidence_id": "A", "status": "superseded", "loaded_at": day(9), "text": None}, {"evidence_id": None})
    assert [tuple(r) for r in standing(e, "status", "text").collect()] == [("A", "superseded", None)]
