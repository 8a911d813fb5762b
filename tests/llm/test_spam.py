import pytest

from quillgraph.llm import spam

SCHEMA = "doc_id bigint, text string, lang string"
SPEECH = {
    "en": "I thank the Minister. The bridge was closed in spring because the funds had run out. We cannot accept that the mill is sold while the river is rising.",
    "pt": "Senhor Presidente, a ponte foi fechada na primavera porque não havia verbas. Não podemos aceitar que o moinho seja vendido enquanto o rio sobe. Muito obrigado a todos.",
    "fi": "Arvoisa puhemies, silta suljettiin keväällä, koska varat olivat loppuneet. Emme voi hyväksyä sitä, että mylly myydään joen noustessa. Kiitän kaikkia.",
}


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        (SPEECH["en"], False), (SPEECH["pt"], False), (SPEECH["fi"], False), ("Hear, hear!", False), ("Rubbish!", False), ("", False), ("   ", False), (None, False), ("#sale", False),
        ("https://a.test/1\nhttps://a.test/2\nhttps://a.test/3\nhttps://a.test/4", True), ("[one](http://a.test) [two](http://b.test) [three](http://c.test)", True), ("#lamp #sale #buy #cheap", True),
        ("3/12 School roofs: https://papers.test/12.pdf\n4/12 Water tariffs: https://papers.test/4.pdf\n5/12 Rail sidings: https://papers.test/5.pdf", False),
    ],
)
def test_short_pages_and_other_languages(spark, text, bad):
    for lang in (None, "en", "xx"):
        assert spam.spam_scores(spark.createDataFrame([(1, text, lang)], SCHEMA)).where("spam").count() == int(bad)


def test_limits_follow_the_corpus(spark):
    """Few texts leave the priors as they are; many draw a limit to what is usual among them."""
    few = spam.limits(spam.spam_scores(spark.createDataFrame([(1, SPEECH["en"] + " " + SPEECH["en"], "en")], SCHEMA))).first()
    for k, (_, _, prior) in spam.LIMITS.items():
        assert abs(few[f"at_{k}"] - prior) < 0.02
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(f"The {words[(i + j) % 10]}{j} of the {words[(3 * i + j) % 10]}{i % 7} was in the {words[j]} for the {words[(i * j) % 10]}." for j in range(10)), "en") for i in range(3000)]
    at = spam.limits(spam.spam_scores(spark.createDataFrame(rows, SCHEMA))).where("lang = 'en'").first()
    assert at["at_function_words"] > 0.3 and at["at_link_text"] < 0.05


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spam.spam_scores(empty).count() == 0
    df = spark.createDataFrame([(1, "#lamp #sale #buy #lamp #cheap #kettle #price #lamp " * 5, "en", True, 3.0)], SCHEMA + ", spam boolean, at_top_word double")
    assert [r.spam for r in spam.spam_scores(df).collect()] == [True]
