import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import mojibake, packing, sentences, spam, splitting, truncation

ROW = "doc_id string, text string"


# 1. Splitting.
@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Longer sentence ends here. ", "\n\n", "東京は大きい。", "x" * 300]), max_size=400), st.integers(400, 900))
def test_pieces_cover_the_text(parts, limit):
    text = "".join(parts)
    spans = splitting.piece_spans(text, limit, 60)
    assert spans[0][0] == 0 and spans[-1][2] == len(text)
    assert all(c - a <= limit for a, _, c in spans)
    assert "".join(text[b:c] for _, b, c in spans) == text
    for (_, _, c), (a2, b2, _) in zip(spans, spans[1:]):
        assert b2 == c and a2 <= c and c - a2 <= 80


def test_an_edit_moves_only_near_pieces():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(20000))
    at = len(text) // 2
    a = {text[b:c] for _, b, c in splitting.piece_spans(text)}
    edited = text[:at] + " added" + text[at:]
    b = {edited[b:c] for _, b, c in splitting.piece_spans(edited)}
    assert len(a - b) <= 3


def test_split_rows(spark):
    rows = [("a", "x y " * 2000), ("b", None), ("c", ""), ("d", "short"), ("a", "x y " * 2000)]
    df = spark.createDataFrame(rows, ROW).withColumn("piece", splitting_col(spark))
    got = splitting.split_oversized(df).collect()
    assert {r.doc_id for r in got} == {"a", "c", "d"} and all(len(r.piece) <= 4000 for r in got)
    assert [r.doc_id for r in splitting.oversized(df).collect()] == ["a"]
    assert splitting.split_oversized(df.limit(0)).count() == 0


def splitting_col(spark):
    from pyspark.sql import functions as F

    return F.lit("a column of the same name")


# 6. Sentences.
CASES = [
    ("Dr. Ray met J. R. Fox at 10.30 a.m. on Monday. It rained.", ["Dr. Ray met J. R. Fox at 10.30 a.m. on Monday.", "It rained."]),
    ("“Who saw it?” asked Ann. He left.", ["“Who saw it?” asked Ann.", "He left."]),
    ("It said: “We closed it.” Then rain.", ["It said: “We closed it.”", "Then rain."]),
    ("«Кто продал?» — спросил д-р Икс. Дождь.", ["«Кто продал?» — спросил д-р Икс.", "Дождь."]),
    ("水位下降。为什么关闭？“谁检查了合同？”张三问道。李四说：“我们修理了。”完了。", ["水位下降。", "为什么关闭？", "“谁检查了合同？”张三问道。", "李四说：“我们修理了。”", "完了。"]),
    ("「誰が見た？」と彼が尋ねた。終わり。", ["「誰が見た？」と彼が尋ねた。", "終わり。"]),
    ("Γιατί έκλεισε; Η στάθμη έπεσε κ.λπ. χθες.", ["Γιατί έκλεισε;", "Η στάθμη έπεσε κ.λπ. χθες."]),
    ("पुल बंद किया। सं. 5 के अनुसार।", ["पुल बंद किया।", "सं. 5 के अनुसार।"]),
    ("Scope\n\nCosts: 3.5\n12) an item, A / B\nThe end.", ["Scope", "Costs: 3.5", "12) an item, A / B", "The end."]),
    ("It grew... and then fell. See v1.2.3 of file.x.pdf now!", ["It grew... and then fell.", "See v1.2.3 of file.x.pdf now!"]),
    ("rule ended.The next one. iPort was here.", ["rule ended.", "The next one.", "iPort was here."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_wrapped_lines_are_joined():
    text = "The first sentence is wrapped at a width of\nforty or so characters and goes on to here.\nShort heading\nAnother sentence that is wrapped at a width\nof the same and ends."
    got = [text[a:b].replace("\n", " ") for a, b in sentences.sentence_spans(text)]
    assert got == ["The first sentence is wrapped at a width of forty or so characters and goes on to here.", "Short heading", "Another sentence that is wrapped at a width of the same and ends."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, sentences.N_EVENTS - 1), max_size=300), st.integers(2, 40))
def test_prefix_scan_equals_one_run(kinds, block):
    assert sentences.cuts(kinds, block) == sentences.cuts(kinds, 10**9)


def test_sentence_rows(spark):
    df = spark.createDataFrame([("a", "One. Two."), ("b", None), ("c", " \n "), ("d", "no end mark")], ROW)
    assert {tuple(r) for r in sentences.sentence_units(df).collect()} == {("a", 0, 0, 4), ("a", 1, 5, 9), ("d", 0, 0, 11)}


# 3. Garbled text.
TEXTS = ["Brückenprüfung über Café Château — “quoted”", "señalización del año", "Дорожный устав принят весной", "مؤشر الميناء الجديد", "जल योजना", "河川改修計画", "Łucja Górzwały Čarnov"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("reader", ["cp1252", "mac_roman", "cp437"])
def test_round_trip(text, reader):
    raw = text.encode()
    garbled = "".join(mojibake._byte(reader, b) if b > 127 else chr(b) for b in raw)
    bad, original, _ = mojibake.repair("Plain start. " + garbled)
    assert bad and original == "Plain start. " + text


@pytest.mark.parametrize("text", [*TEXTS, "plain", "", None, "SÃO BELÁRIO DO CAIS", "naïve façade of Île Grenadine", "ещё её моё", "§ 3 ¶ 5 ¼ Ω ½ √5 ≈ 2 ±1 µm €7", "προειδοποίηση ύδρευσης", "L’été à Noël", "Þingmúli Øster Ærnes"])
def test_right_text_is_left(text):
    assert mojibake.repair(text) == (False, None, "")


def test_single_byte_and_dead_ends():
    fixed = lambda t, a, b: mojibake.repair("".join(chr(c) if c < 128 else mojibake._byte(b, c) for c in t.encode(a)))
    assert fixed("pêche différée", "cp1252", "mac_roman")[1] == "pêche différée"
    assert fixed("Gebäudeprüfung", "cp850", "cp1252")[1] == "Gebäudeprüfung"
    assert fixed("портовый сбор", "koi8_r", "cp1251")[1] == "портовый сбор"
    assert fixed("дорожный устав", "cp1251", "cp1252")[1] == "дорожный устав"
    assert mojibake.repair("caf� terrace") == (True, None, "replacement characters")
    # Only matched spans change.
    bad, original, _ = mojibake.repair("Zoë and FranÃ§ois – café")
    assert bad and original == "Zoë and François – café"


@pytest.mark.parametrize("reader", ["koi8_r", "cp866", "cp1253", "cp1251"])
def test_every_reader_is_tried(reader):
    garbled = "".join(chr(c) if c < 128 else mojibake._byte(reader, c) for c in "Gebührenordnung".encode("cp1252"))
    assert mojibake.repair(f"Die {garbled} gilt")[:2] == (True, "Die Gebührenordnung gilt")


def test_odd_words_that_no_pair_repairs():
    assert mojibake.repair("the GebЖЖhren and Brβ¤ken of Lo¤¸th")[:2] == (True, None)
    assert mojibake.repair("Müller®s a−b rule") == (False, None, "")


def test_garbled_rows(spark):
    df = spark.createDataFrame([("a", "FranÃ§ois"), ("b", None), ("c", "François"), ("a", "FranÃ§ois")], ROW)
    assert {tuple(r) for r in mojibake.garbled(df, ["doc_id"], "text").collect()} == {("a", "François", "utf-8 as cp1252")}


# 4. Truncation.
DOC = "The river rose in spring… Dr. Ray closed the gate at 10.30 a.m. and left. “Who saw it?” asked Ann Miller.\n12) old tariff, Board of Works / River Trust\nRain fell, although nobody objected..."


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("The river rose in spring…", False), ("The river rose in…", True), ("The river rose in spring […]", True), ("Dr. Ray closed the gate at 10.30 a.m.", True), ("Dr. Ray closed the gate at 10.30 a.m. and left.", False), ("Dr. Ray clo", True),
        ("“Who saw it?”", True), ("“Who saw", True), ("“Who saw it?” asked Ann Miller.", False), ("12) old tariff, Board of Works / River Trust", False), ("12) old tariff, Board of Works / Riv", True), ("Rain fell, although nobody objected...", False),
        ("Dr.", True), ("", False), (None, False), ("  ", False),
    ],
)
def test_cut_values(spark, text, cut):
    v = spark.createDataFrame([("t", "d", "1", "s", text)], "record_table string, doc_id string, record_id string, source string, text string")
    assert truncation.truncated(v, spark.createDataFrame([("d", DOC)], ROW)).count() == int(cut)


def test_storage_limit(spark):
    rng = random.Random(2)
    rows = [("s", "word " * rng.randint(3, 60) + "end.") for _ in range(400)] + [("s", ("é" * 200)[: 60 - i % 2 * 0]) for i in range(30)]
    got = truncation.storage_limits(spark.createDataFrame(rows, "source string, text string")).collect()
    assert ("chars", 60) in {(r.measure, r.length) for r in got} and ("utf8_bytes", 120) in {(r.measure, r.length) for r in got}


# 7. Packing.
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_is_whole(sizes):
    from collections import Counter

    h = Counter(sizes)
    runs, n = packing.plan_containers(h, 50)
    load, seen = Counter(), Counter()
    for s, first, k, c in runs:
        assert first == seen[s]
        seen[s] += k
        for x in range(c, c + k):
            load[x] += s
    assert seen == h and set(load) == set(range(n)) and all(v <= 50 for v in load.values())
    assert n <= 1.7 * -(-sum(sizes) // 50) + 1


def test_reduction_finds_exact_pairs():
    counts = {30: 2, 20: 1, 25: 2, 40: 1}
    fixed = packing.reduce_instance(counts, 50)
    assert ((30, 20), 1) in fixed and ((25, 25), 1) in fixed


def test_pack_rows(spark):
    rows = [(1, "a " * 5000), (2, "b " * 100), (3, ""), (4, None), (2, "b " * 100)] + [(10 + i, "word " * (i * 37 % 900)) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert max(load.values()) <= packing.CAPACITY
    big = sorted((r.piece_no, r.token_start, r.tokens) for r in got if r.doc_id == 1)
    n = len(packing.encoding().encode_ordinary("a " * 5000))
    assert sum(t for _, _, t in big) == n and all(p == 2048 for _, _, p in big[:-1]) and [b[1] for b in big] == [2048 * i for i in range(len(big))]
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# 9. Spam.
@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("buy lamp cheap lamp lamp online, best lamp price lamp sale lamp deal lamp " * 4, True), ("#lamp #sale #buy #lamp #cheap #kettle #price #lamp " * 5, True), ("\n".join(f"* [cheap lamp {i}](https://shop.test/{i})" for i in range(20)), True),
        ("Home | Cart | Lamp | Sale | Kettle | Login | Price | Lamp | Cart | Best | Deal | Lamp | Sale | Home | Cart | Kettle " * 3, True),
        ("I thank the Minister. The bridge was closed in spring because the funds had run out. We cannot accept that the mill is sold while the river is rising.", False),
        ("Division list. Ayes: " + ", ".join(f"Member{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), False), ("Orders of the day\n" + "\n".join(f"{i}. Second reading of bill {i} (upper house)" for i in range(1, 15)), False),
        ("We want the bridge! Who wants the bridge? We do. We will have the bridge! We want the bridge! " * 6, False), ("", False), (None, False), ("lamp lamp", False),
    ],
)
def test_spam(spark, text, bad):
    df = spark.createDataFrame([(1, text, None), (2, text, "en")], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in spam.spam_scores(df).where("spam").collect()} == ({1, 2} if bad else set())


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("\n".join(f"https://shop.test/lamp/{i}" for i in range(20)), True), ("Links\n" + "\n".join(f"https://shop.test/{i}" for i in range(20)), True),
        ("\n".join(f"{i}. [{w} shop](https://x.test/{w}/{i})" for i, w in enumerate("lamp kettle table chair sofa oven grill clock".split() * 3)), True), ("\n".join(f"{i}. #lamp{i} #sale{i} #buy #price{i}" for i in range(1, 21)), True),
        ("\n".join(f"{i}. https://shop.test/{i}" for i in range(1, 21)), True), ("https://a.test/x https://b.test/y", False),
        ("Papers laid\n" + "\n".join(f"{i * 37}/{i} {w}: https://papers.{w[:4]}{i}.example/{i}.pdf" for i, w in enumerate(["School roofs", "Fishing quotas", "Question time", "Water tariffs", "Rail sidings bill"] * 3, 1)), False),
    ],
)
def test_link_lists(spark, text, bad):
    df = spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, lang string")
    assert spam.spam_scores(df).where("spam").count() == int(bad)
