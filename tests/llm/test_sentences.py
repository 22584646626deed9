"""Problem 9: units of texts whose units are known, and awkward texts."""

from collections import defaultdict

from sentence_docs import documents
from tessera.llm import sentences

SCHEMA = "doc_id long, text string, lang string"


def units(spark, rows):
    out = defaultdict(list)
    for r in sentences.sentence_units(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id", "start_char").collect():
        out[r["doc_id"]].append((r["start_char"], r["end_char"]))
    return out


def test_known_units_in_ten_languages(spark):
    made = documents(700, 1)
    got = units(spark, [(i, text, None) for i, _, text, _ in made])
    right, given, wanted = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, lang, _, true in made:
        right[lang] += len(set(true) & set(got[i]))
        given[lang] += len(got[i])
        wanted[lang] += len(true)
    for lang in wanted:
        assert right[lang] >= 0.97 * wanted[lang] and right[lang] >= 0.97 * given[lang], (lang, right[lang], given[lang], wanted[lang])


def test_every_other_character_is_in_one_unit(spark):
    made = documents(100, 2)
    got = units(spark, [(i, text, None) for i, _, text, _ in made])
    for i, _, text, _ in made:
        at = 0
        for a, b in got[i]:
            assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
            at = b
        assert not text[at:].strip()


def test_awkward_texts(spark):
    long = "Open the lid. " * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \r\n\t ", "x"), (4, "......", None), (5, "- - -\n\n(((", None), (6, long, None), (7, "😀 Ok. Go!", None), (8, "Ok.", None), (8, "Ok.", None)]
    got = units(spark, rows)
    assert not got[1] and not got[2] and not got[3] and got[4] == [(0, 6)] and got[5] == [(0, 5), (7, 10)]
    assert len(got[6]) >= 1 and got[6][-1][1] == len(long.strip()) and got[8] == [(0, 3), (0, 3)]


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], SCHEMA + ", starts string, code string")
    assert sentences.sentence_units(df).count() == 0
