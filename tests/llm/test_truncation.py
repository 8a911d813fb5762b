import json

import pytest

from quillgraph.llm import truncation as T

V = "record_table string, doc_id string, record_id string, source string, text string"


def cut(spark, texts, doc, source="s"):
    values = spark.createDataFrame([("t", "d", str(i), source, x) for i, x in enumerate(texts)], V)
    docs = spark.createDataFrame([("d", doc)], "doc_id string, text string")
    return {int(r.record_id) for r in T.truncated(values, docs).collect()}


def test_list_lines_of_a_wrapped_text_are_complete(spark):
    lines = ["12) upstream survey, Ann Habudausk / Pamogrond Rivers", "Ann Lovell – sewer, regional market hall: Ludmila Grims"]
    prose = "The committee met in the lower valley because the funds for\nthe bridge had run out before the second reading of the bill.\n"
    doc = prose + "\n".join([lines[0], "Margaret Stoldertind of the tidal barrier and the regional sewer", lines[1], "Osbert Kroll and others of the regional market hall spoke to it"]) + "\n" + prose
    assert cut(spark, [*lines, lines[0][:-7], lines[1][:-3], "The committee met in the lower valley because the funds for"], doc) == {2, 3, 4}


@pytest.mark.parametrize(
    ("value", "after", "is_cut"),
    [("run by Fumulmosk Hospital Fdn.", " The levy fell.", False), ("run by Winilmex District Council 8.", " Nobody knew.", False), ("867) a coast guard, Ann Lovell / Pamogrond, E.", " Another line.", False), ("asked by Mr.", " Lovell of the board.", True), ("see No.", " 15 of the list.", True), ("run by Kent Ltd.", " and its board.", True)],
)
def test_abbreviations_before_a_capital(spark, value, after, is_cut):
    assert cut(spark, [value], f"First. It was {value}{after}") == ({0} if is_cut else set())


@pytest.mark.parametrize("measure", T.MEASURES)
def test_every_measure_shows_a_limit(spark, measure):
    """Lines cut where their length in one measure is 80 are found at that limit, though their documents are gone and they look like list lines."""
    size = {
        "chars": len, "utf8_bytes": lambda s: len(s.encode()), "utf16_units": lambda s: len(s.encode("utf-16-le")) // 2,
        "entity_chars": lambda s: len(s) + 4 * s.count("&") + 3 * (s.count("<") + s.count(">")) + 5 * (s.count('"') + s.count("'")), "json_chars": lambda s: len(json.dumps(s)) - 2, "crlf_chars": lambda s: len(s) + s.count("\n"),
    }[measure]
    texts = []
    for i in range(60):
        mixed = "".join(c * (1 + (i + k) % 3) for k, c in enumerate("é𝄞&<\"\n"))
        line = f"{i + 10}) item {mixed} of {chr(97 + i % 26)}{'x' * (i % 7)}, name {i} / " + "Longname" * 12
        while size(line) > 80:
            line = line[:-1]
        texts.append(line)
    got = cut(spark, texts, None)
    at = {i for i, t in enumerate(texts) if size(t) == 80}
    assert len(at) > 30 and at <= got


def test_nulls_and_empty_tables(spark):
    values = spark.createDataFrame([("t", None, None, None, None), ("t", "d", "1", None, ""), ("t", None, "2", None, "cut off in the mid")], V)
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert [r.record_id for r in T.truncated(values, docs).collect()] == ["2"]
    assert T.truncated(values.limit(0), docs).count() == 0
