import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X


def one(spark, fn, *values):
    cols = [F.lit(v) for v in values]
    return spark.range(1).select(fn(*cols).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("The  Knowledge Graph.", "knowledge graph"), ("  AN apple", "apple"), ("“Quoted”", "quoted"), ("a", "a"), ("The the cat", "the cat"), (None, ""), ("", ""), ("x y", "x y"), ("bad�name", "bad-name"), ("-*•", "")],
)
def test_normalize_name(spark, raw, key):
    assert one(spark, lambda c: X.normalize_name(c.cast("string")), raw) == key


@pytest.mark.parametrize(("raw", "key"), [("The Thing!", "the thing"), ("• item", "• item"), (None, ""), ("  A\t B ", "a b")])
def test_normalize_keyword(spark, raw, key):
    assert one(spark, lambda c: X.normalize_keyword(c.cast("string")), raw) == key


@pytest.mark.parametrize(
    ("name", "ok"),
    [
        ("Fire damper", True), ("x", False), ("12345", False), ("item 4", False), ("item", True), ("one two three four five six seven", False), ("accessed by someone", False), ("four five six seven fitted", False),
        ("printed matter comments", False), ("printed comments", True), ("ελληνικά", False), (None, False), ("", False),
    ],
)
def test_usable_name(spark, name, ok):
    assert one(spark, lambda c: X.usable_name(c.cast("string")), name) is ok


@pytest.mark.parametrize(("name", "ok"), [("river study", True), ("ab", False), ("check valve", False), ("schedule board", False), ("service schedule plan", False), ("schedule routine", True), ("2024", False), ("section", False)])
def test_keyword_accepted(spark, name, ok):
    assert one(spark, X.keyword_accepted, name) is ok


@pytest.mark.parametrize(
    ("name", "text", "found", "n"),
    [("graph", "a graph, graph.", True, 2), ("graph", "paragraph", False, 0), ("data base", "metadata bases", True, 1), ("a+b", "x a+b y", True, 1), ("c\\e", "c\\e c\\e", True, 2), ("été", "l'été", True, 1)],
)
def test_in_text(spark, name, text, found, n):
    assert one(spark, X.in_text, name, text) is found
    assert one(spark, X.count_in_text, name, text) == n


@pytest.mark.parametrize(
    ("raw", "key", "label", "swap"),
    [("Uses", "uses", "uses", False), ("is used by", "uses", "uses", True), ("Related To!", "associated_with", "co-occurs with", False), ("flies_over", "flies_over", "flies_over", False), ("is-a-type-of", "is_a", "is a", False)],
)
def test_canonical_relation(spark, raw, key, label, swap):
    r = one(spark, X.canonical_relation, raw)
    assert (r["relation_key"], r["relation"], r["swap"], r["original_relation"]) == (key, label, swap, raw)


def test_canonical_relation_of_nothing(spark):
    for v in ("", "!!", "…"):
        assert one(spark, X.canonical_relation, v) is None


@pytest.mark.parametrize(("seconds", "shown"), [(2.14, "2.1s"), (192.0, "3m 12s"), (119.6, "1m 60s"), (3900.0, "1h 05m"), (None, "—")])
def test_format_duration(spark, seconds, shown):
    assert one(spark, lambda c: X.format_duration(c.cast("double")), seconds) == shown


def test_tail(spark):
    assert one(spark, lambda c: X.tail(c, 0), "abc def") == ""
    assert one(spark, lambda c: X.tail(c, 100), "abc def") == "abc def"
    assert one(spark, lambda c: X.tail(c, 6), "one two three") == "three"


def test_cleanup_and_words(spark):
    assert one(spark, X.cleanup, " a  \n\n\n\nb\t\nc ") == "a\n\nb\nc"
    assert one(spark, X.word_count, " a   b\nc ") == 3
    assert one(spark, X.word_count, "") == 0


def test_target_count(spark):
    f = lambda n, m: one(spark, lambda c: X.target_count(c, m), n)
    assert [f(0, "full"), f(5, "fast"), f(100, "fast"), f(100, "balanced"), f(100, "full"), f(2000, "balanced")] == [0, 5, 20, 35, 100, 250]


def test_filename(spark):
    assert one(spark, X.safe_filename, "a/b/My réport?.pdf") == "My r_port_"
    assert one(spark, X.safe_filename, ".pdf".replace(".", "")) == "pdf"


def test_tags(spark):
    a = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    row = spark.range(1).select(X.tag_list(a(["both", "llm"]), F.lit("manual")).alias("x"), X.tag_list(a([]), F.lit(None).cast("string")).alias("y"), X.link_tag(a([])).alias("z")).first()
    assert (row["x"], row["y"], row["z"]) == (["llm", "cooccurrence", "manual"], ["llm"], "both")
