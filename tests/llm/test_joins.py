import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import gbm, leakage, names, scans


# 2. Names.
def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, k):
    want = osa(a, b)
    assert names.edit_distance(a, b, k) == (want if want <= k else None)


def test_given_names_do_not_depend_on_their_frequency(spark):
    """Links of a small table are there in a larger one, where either spelling has many bearers."""
    few = [("Zorana Tibbet", "person"), ("Zoranna Tibbet", "person"), ("Martin Ogle", "person"), ("Marta Ogle", "person")]
    many = few + [(f"{g} Quell{chr(97 + i)}{chr(97 + 7 * i % 26)}mer{chr(97 + 3 * i % 26)}", "person") for i in range(20) for g in ("Zorana", "Zoranna")]
    none = spark.createDataFrame([], "name string")
    for rows in (few, many):
        got = {(r.name_a, r.name_b) for r in names.variant_pairs(spark.createDataFrame(rows, "name string, type string"), none).collect()}
        assert ("zorana tibbet", "zoranna tibbet") in got


def test_table_of_given_names(spark):
    people = spark.createDataFrame([("Qarlo Fenwick", "person"), ("Q'lo Fenwick", "person"), ("Bob Stone", "person"), ("Robert Stone", "person")], "name string, type string")
    none = spark.createDataFrame([], "name string")
    table = spark.createDataFrame([("Qarlo", "Q'lo"), ("Unna", None)], "given string, short string")
    pairs = lambda t: {(r.name_a, r.name_b) for r in names.variant_pairs(people, none, nicknames=t).collect()}
    assert pairs(table) == {("q'lo fenwick", "qarlo fenwick")} and ("bob stone", "robert stone") in pairs(None)


def test_segment_join_against_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(150)}
    for w in list(words)[:60]:  # planted neighbours
        i = rng.randrange(len(w) - 1)
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + "e" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "e" + w[i + 1 :]]))
    words = {w for w in words if len(w) > 2}
    want = {(a, b) for a in words for b in words if a < b and osa(a, b) <= names.allowed(min(len(a), len(b)))}
    got = {(r.a, r.b) for r in names.segment_join(spark.createDataFrame([(w,) for w in words], "s string")).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=3, max_size=12), st.integers(0, 2), st.data())
def test_segment_keys_meet(a, n, data):
    """A string and what up to ``allowed`` edits make of it share a key, whatever the edits."""
    b = a
    for _ in range(min(n, names.allowed(len(a)))):
        i = data.draw(st.integers(0, max(0, len(b) - 2)))
        b = data.draw(st.sampled_from([b[:i] + b[i + 1 :], b[:i] + "c" + b[i:], b[:i] + "c" + b[i + 1 :], b[:i] + b[i + 1 : i + 2] + b[i] + b[i + 2 :]]))
    short, long = sorted((a, b), key=len)
    if len(short) < 3 or osa(short, long) > names.allowed(len(short)):
        return
    assert set(names.segment_keys(short)) & names.probe_keys(long)


def test_components(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20) if i != 10]
    got = {r.node: r.label for r in names.components(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(f"n{i:02d}",) for i in range(22)], "node string")).collect()}
    assert got == {f"n{i:02d}": "n00" if i <= 10 else "n11" if i <= 20 else "n21" for i in range(22)}


def test_variants(spark):
    person = ["Alexander E. Marlowick", "alex marlowick", "MARLOWICK, Alexander", "A. Marlowick", "Alexander  Marlowcik", "Dr Alexander Marlowick", "Álexander Marlowick", "AE Marlowick"]
    other = ["Natalia Marlowick", "Alexander Brunnfeld"]
    body = ["District Council 6 of Brotten", "Dist. Council No. 6, Brotten", "DC6 Brotten", "District Counsil 6 of Brotten", "Brotten District Council 6"]
    trust = ["Public Library Trust of Sobocharn", "PLT-Sobocharn", "P.L.T. Sobocharn", "The Public Library Trust, Sobocharn", "Pub. Library Trust Sobocharn", "Public Library Trust (PLT) Sobocharn"]
    rows = [(n, "person") for n in person + other] + [(n, "organization") for n in body + trust + ["District Council 7 of Brotten"]] + [("grain storage levy", "concept"), ("grain storage lewy", "concept"), (None, None), ("  ", "person")]
    nodes = spark.createDataFrame(rows, "name string, type string")
    got = {(r.name_a, r.name_b) for r in names.variant_pairs(nodes, spark.createDataFrame([("marlowick, alexander e",)], "name string")).collect()}
    form = lambda s: " ".join(s.lower().split())
    want = set()
    for group in ([*person, "marlowick, alexander e"], body, trust):
        f = sorted({form(n) for n in group})
        want |= {(a, b) for i, a in enumerate(f) for b in f[i + 1 :]}
    assert got == want


def test_no_names(spark):
    nodes = spark.createDataFrame([], "name string, type string")
    assert names.variant_pairs(nodes, spark.createDataFrame([], "name string")).count() == 0


# 8. Leaks.
ITEM = "The pilot from Bromesk borrowed only nine of the anchors while seven feathers were striped and Luvelm copied the fragrant ones near the old lighthouse before anyone had counted the pearls"


@pytest.mark.parametrize(
    ("text", "leaked"),
    [
        (ITEM, True), ("Intro. " + ITEM.upper().replace(" ", "\n") + "! Outro.", True), (" ".join(ITEM.split()[:14]), True), (" ".join(ITEM.split()[:6]), False), (ITEM.replace("feathers", "stones").replace("copied", "kept"), True),
        (" ".join(ITEM.split()[:9]) + " (Interruption from the left: Hear, hear!) " + " ".join(ITEM.split()[9:20]), True), ("Nothing of the kind stands here.", False), ("", False), (None, False),
    ],
)
def test_leaks(spark, text, leaked):
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "too short"), (9, None)], "item_id bigint, text string")
    got = leakage.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == ({(1, 7), (2, 7)} if leaked else set())
    for r in got:
        assert 0 <= r.start < r.end <= len(text)


def test_formulas_leak_nothing(spark):
    formula = "The minutes of the previous sitting were approved and the House passed to the orders of the day"
    items = [(i, f"{formula}. Item number {i} tells of {chr(97 + i) * 5} and {chr(98 + i) * 6} in its own few words") for i in range(4)]
    docs = spark.createDataFrame([(1, formula), (2, items[2][1])], "doc_id bigint, text string")
    got = leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 2)}


@pytest.mark.parametrize("size", [1, 5000])
def test_items_with_near_copies(spark, monkeypatch, size):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", size)
    items = [(1, ITEM), (2, ITEM.upper()), (3, ITEM + "!"), (4, ITEM.replace("pearls", "stones")), (5, ITEM.replace("pilot", "guide")), (6, "The " + ITEM)]
    docs = spark.createDataFrame([(1, "Intro. " + ITEM), (2, "Nothing of the kind stands here.")], "doc_id bigint, text string")
    got = leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, i) for i in range(1, 7)}


def test_a_long_interruption(spark):
    words = ITEM.split()
    docs = [(1, " ".join(words[:8]) + " (" + "other voices were heard " * 40 + ") " + " ".join(words[8:16])), (2, " ".join(words[:8])), (3, " ".join(words[8:16]) + " other voices were heard " * 40 + " ".join(words[:8]))]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in got] == [(1, 7, 0, len(docs[0][1]))]


SHORT = [(1, "Sit down"), (2, "quite so"), (3, "Quite so!"), (4, "I say: quite so, my friend"), (5, "one two three four quite so"), (6, " – ")]


@pytest.mark.parametrize(("text", "leaked"), [("Then: SIT\ndown, please.", {1}), ("sitdown; sit him down", set()), ("He said quite so.", set()), ("sit down", {1}), ("", set())])
def test_items_shorter_than_a_gram(spark, text, leaked):
    """Short items leak as a whole; those that three texts hold are formulas."""
    got = leakage.leaks(spark.createDataFrame([(9, text), (8, None)], "doc_id bigint, text string"), spark.createDataFrame(SHORT, "item_id bigint, text string")).collect()
    assert {r.item_id for r in got} == leaked and all(text[r.start : r.end].lower().split() == ["sit", "down"] for r in got)


def test_a_third_with_replaced_words_near_its_ends(spark):
    """Single words replaced so near an end that no gram holds what follows count as part of the passage; less than a third doesn't leak."""
    item = [f"w{i}" for i in range(30)]
    other = lambda part, *at: "x y " + " ".join("zz" if i in at else w for i, w in enumerate(part)) + " u v"
    docs = [(1, other(item[5:15])), (2, other(item[5:15], 7)), (3, other(item[5:15], 1, 8)), (4, other(item[5:14])), (5, other(item[5:14], 3)), (6, other(item[:10], 2)), (7, other(item[20:], 7))]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 6, 7}
    text = dict(docs)
    assert {r.doc_id: text[r.doc_id][r.start : r.end].split()[0] for r in got} == {1: "w5", 2: "w5", 3: "w5", 6: "w0", 7: "w20"}


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 1)
    items = spark.createDataFrame([(1, ITEM), (2, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, ITEM + " one two three four five six seven eight nine ten")], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == {(1, 1), (1, 2)}
    assert leakage.leaks(docs, items.limit(0)).count() == 0


# 5. Scans.
def test_boosting_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = gbm.Boosted(60).fit(x[:1500], y[:1500])
    assert ((m.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


def test_ranking_on_held_out_words(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choices("bcdefghlmnorstuw", k=rng.randint(5, 10))) for _ in range(900)})
    import numpy as np

    # Words of the corpus with other endings are rare words that are right.
    rare = [w[:-1] + c for w, c in zip(words[:300], rng.choices("pqvxyz", k=300))]
    truth = scans.ranking_examples(words[:600], rare)
    odd = spark.createDataFrame([(w,) for w in truth], "word string")
    model = scans.train_ranking(scans.candidates(odd, spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")), truth)

    right = 0
    tried = [w for w in words[600:] if "o" in w][:80]
    for w in tried:
        read = w.replace("o", "0", 1)
        f = scans.candidate_features(read, w, 5, len(set(scans.trigrams(w)) & set(scans.trigrams(read))))
        right += model.probability(np.array([f]))[0] > 0.5
    assert right > 0.9 * len(tried)
    # Other letters at the end make names and slips, which the ranking has seen as right.
    other = [(w[:-1] + "x", w) for w in words[600:] if len(w) > 6 and not scans.explained(w, w[:-1] + "x")[0]][:80]
    f = [scans.candidate_features(a, b, 5, len(set(scans.trigrams(a)) & set(scans.trigrams(b)))) for a, b in other]
    assert (model.probability(np.array(f)) > 0.5).mean() < 0.1


def test_joins_on_held_out_words():
    """Torn words are told from hyphened ones, also where the corpus has neither."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcdefghilmnoprstu", k=n))
    known = [(word(rng.randint(7, 12)), rng.randint(3, 90)) for _ in range(400)]
    torn = [(f"{word(rng.randint(3, 6))}-{word(rng.randint(4, 7))}", rng.randint(3, 20)) for _ in range(200)]
    counts = {q: rng.randint(20, 90) for w, _ in torn[:150] for q in w.split("-")}
    model = scans.train_joins(known, torn, counts)
    p = lambda *x: model.probability(__import__("numpy").array([scans.join_features(*x)]))[0]
    assert p(12, 0, 0, 0, True, 9) > 0.5 > p(0, 8, 40, 40, True, 11)
    assert p(0, 0, 0, 0, True, 9) > 0.5 > p(0, 0, 50, 50, False, 11)
    assert scans.train_joins(known, torn[:5], counts) is None


def test_any_misreading_has_its_candidate(spark):
    """Candidates are found whatever was changed, and in words of any length; none is ruled out by a list of confusions."""
    right = ["knowledgeable", "parliamentary", "donaudampfschifffahrtsgesellschaftskapitaenspatent", "park"]
    words = spark.createDataFrame([(w, 9) for w in right], "word string, n bigint")
    odd = {"knawledgeable": right[0], "parlicmentary": right[1], right[2].replace("kap", "kzp"): right[2], "parc": "park"}
    got = {(r.word, r["right"]) for r in scans.candidates(spark.createDataFrame([(w,) for w in odd], "word string"), words).collect()}
    assert got >= set(odd.items())


def scan_texts():
    vocabulary = "river council minutes approved bridge across harbour tariff during autumn because workers observed levels rising slowly beside mill engineers reported measures against flooding several times".split()
    rng = random.Random(6)
    plain = [(f"t{i}", " ".join(rng.choice(vocabulary) for _ in range(120)) + ".", "txt") for i in range(12)]
    pdf = []
    for i in range(14):
        lines = []
        for page in range(3):
            lines.append(f"{page + 3}   Minutes of the Harbour Board" if page % 2 else f"HARBOUR ANNALS   {page + 3}")
            for _ in range(8):
                lines.append(" ".join(rng.choice(vocabulary) for _ in range(6)))
            lines.append("")
        pdf.append((f"p{i}", "\n".join(lines).rstrip(), "pdf"))
    lines = pdf[0][1].split("\n")
    lines[3] = "counci1 approved the bri-"
    lines[4] = "dge across rivcr harbour during autumn"
    pdf[0] = ("p0", "\n".join(lines), "pdf")
    return plain + pdf + [("n", None, "pdf"), ("e", "", "pdf")]


def test_scan_noise(spark):
    df = spark.createDataFrame(scan_texts(), "doc_id string, text string, format string").withColumn("word", names.F.lit("clash"))
    got = scans.scan_noise(df.unionByName(df), []).distinct().collect()
    p0 = {(r.line_no, r.noise) for r in got if r.doc_id == "p0"}
    assert {(0, "header"), (10, "header"), (20, "header"), (3, "hyphen"), (3, "misread"), (4, "misread")} == p0
    assert not [r for r in got if r.doc_id[0] == "t"]
    fixed = {r.doc_id: r.text for r in scans.repaired(df, spark.createDataFrame(got)).collect()}["p0"]
    assert "council approved the bridge across river harbour" in fixed and "ANNALS" not in fixed


@pytest.mark.parametrize("long", ["91958;10523;4592;" * 380, "river council minutes " * 40])
def test_scan_with_one_long_run(spark, long):
    rows = scan_texts()
    at = next(i for i, r in enumerate(rows) if r[0] == "p0")
    rows[at] = ("p0", rows[at][1].replace("\n\n", f"\n\n{long}\n\n", 1), "pdf")
    got = scans.scan_noise(spark.createDataFrame(rows, "doc_id string, text string, format string"), []).distinct().collect()
    assert {(0, "header"), (12, "header"), (22, "header"), (3, "hyphen"), (3, "misread"), (4, "misread")} == {(r.line_no, r.noise) for r in got if r.doc_id == "p0"}


def test_header_words_are_counted_over_all_scans(spark):
    rows = scan_texts()
    body = rows[13][1].split("\n")[1:9]
    for i in range(4):  # a family of headers of which the sample can lack lines
        rows.append((f"z{i}", "\n".join(["7   Zephyr Quorn Gazette", *body, "", "9   Zephyr Quorn Gazette", *body]), "pdf"))
    df = spark.createDataFrame(rows, "doc_id string, text string, format string")
    heads = scans.header_words(df.where("format in ('pdf', 'txt') and text is not null").select("text", "format"))
    assert {scans.fold_line(w) for w in ("zephyr", "quorn", "gazette", "minutes")} <= heads


def test_share_of_header_words_is_no_gate():
    class Sure:
        probability = staticmethod(lambda x: [0.9] * len(x))

    lines = ["Rare Unseen Title", "river council minutes approved bridge", "across the harbour"]
    assert scans.furniture(lines, frozenset(), Sure())[0] == "header"


def test_unwrapped_texts_are_no_scans():
    assert not scans.wrapped("A short heading\n" + "A paragraph of one line that goes on and on. " * 8)
    assert not scans.wrapped("\n".join(["Costs: 3", "Fees: 4", "Tolls: 5", "Rents: 6", "Sum: 18", "A paragraph of one line that goes on. " * 8]))


def test_no_scans(spark):
    assert scans.scan_noise(spark.createDataFrame([], "doc_id string, text string, format string"), []).count() == 0
