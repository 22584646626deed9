"""Text, numbers and similarity against plain Python."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.functions import text as t

TEXTS = ["Ｈydrau-\nlic  “Ｐump” – ½", "HP-200 at -5 to +3,5, not 1.2.3 or x5-6", "ab­c​d﻿", "", "  \t\n ", "naïve ﬁt № 5 ℃", "a–b—c−d", "«Q» ‘s’", "A-\nb c-\nd", "é", "10−3 −4", "x" * 5000 + " 7"]


def one(spark, texts, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string")
    return [r["v"] for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def plain_normal(x):
    x = unicodedata.normalize("NFKC", x or "")
    x = "".join("-" if c in t.DASHES else "'" if c in t.SINGLE_QUOTES else '"' if c in t.DOUBLE_QUOTES else c for c in x if c not in t.SOFT)
    return " ".join(re.sub("(?<=[a-z])-\n(?=[a-z])", "", x).split()).lower()


def plain_numbers(x):
    x = "".join("-" if c in t.DASHES else c for c in unicodedata.normalize("NFKC", x))
    found = []
    for m in re.finditer(r"(?<![A-Za-z])[-+]?\d+(?:[.,]\d+)*", x):
        n = m[0].lstrip("+")
        found.append(n[1:] if n[0] == "-" and m.start() and x[m.start() - 1].isalnum() else n)
    return sorted(found)


def test_normalised(spark):
    assert one(spark, TEXTS, t.normalised) == [plain_normal(x) for x in [*TEXTS, None]]


def test_numeric_tokens(spark):
    assert one(spark, TEXTS, t.numeric_tokens) == [plain_numbers(x) for x in TEXTS] + [None]


def test_signal_and_kinds(spark):
    assert one(spark, ["WARNING hot", "Warning: hot", "Warning hot", " NOTE: x", "NOTES", "x"], t.signal) == ["warning", "warning", None, "note", None, None, None]
    assert one(spark, ["Page 3 of 9", "- 12 -", "Fig. 3 Pump", "1) Open", "• Open", "this page is intentionally blank", "Open"], t.pattern_kind) == [
        "page_number", "page_number", "caption", "list_item", "list_item", "blank_notice", None, None]


def test_dates(spark):
    got = one(spark, ["2020-1-5", "13.02.2021", "02/13/2021", "3.4.2020", "3/4/2020", "15 March 2022", "Mar. 5, 2020", "May 2021", "31.02.2020", "x"], t.normalised_date)
    assert [tuple(r) if r else None for r in got] == [("2020-01-05", False), ("2021-02-13", False), ("2021-02-13", False), ("2020-04-03", True), ("3/4/2020", True), ("2022-03-15", False), ("2020-03-05", False),
                                                     ("2021-05", False), ("31.02.2020", True), ("x", False), None]


def test_numbers(spark):
    assert one(spark, ["3/8", "1 1/2", "1,500", "1,500.25", "0,61", "-3.5", "x", "3/0"], t.parsed_number) == [0.375, 1.5, 1500.0, 1500.25, 0.61, -3.5, None, None, None]


def test_quality(spark):
    good, glyphs, noise, blank = one(spark, ["Tighten the four bolts evenly.", "(cid:12)(cid:13)(cid:14) x", "xkcdq wrtzpf bcdfgh qqwrtz", "  "], t.quality)[:4]
    assert good == 1.0 and glyphs < 0.5 and noise < 0.45 and blank == 0.0


def test_cells_names_and_markup(spark):
    assert one(spark, ["=1+1", "a\x07b", "ok"], lambda c: t.cell(c, 50)) == ["'=1+1", "ab", "ok", None]
    assert one(spark, ["a/b c.pdf", "...", "x" * 99], t.safe_name) == ["a_b_c.pdf", "file", "x" * 80, None]
    assert one(spark, ["a<b>&c"], t.escaped) == ["a&lt;b&gt;&amp;c", None]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdé ", max_size=90), st.text(alphabet="abcdé ", max_size=90))
def test_common_subsequence(a, b):
    assert similarity.common_subsequence(a, b) == slow_common(a, b)


def test_ratios(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("b a", "a b"), (None, "a"), ("", "")], "a string, b string")
    got = df.select(similarity.indel("a", "b").alias("r"), similarity.token_sort(F.col("a"), F.col("b")).alias("s")).collect()
    assert round(got[0]["r"], 4) == 61.5385 and got[1]["s"] == 100.0 and got[2]["r"] is None and got[3]["r"] == 100.0
