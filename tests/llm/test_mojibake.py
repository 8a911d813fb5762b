import os

import pytest

from quillgraph.llm import mojibake as M
from tests.conftest import SF

GERMAN = "Die größte Straße führt über die Brücke, für Männer und Frauen, die nicht müde werden können."
FRENCH = "L’état et la société, être à l’école. L’élève a été reçu, il était fâché et prêt."
SPANISH = "La comisión aprobó el año pasado la inspección, según el señor Muñoz; también habrá más árboles."


def damage(text, source, reader):
    """The text as a reader shows the bytes of another encoding."""
    return "".join(chr(b) if b < 128 else M._byte(reader, b) for b in text.replace("’", "'").encode(source))


PAIRS = [("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp850", "cp1251"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437")]


@pytest.mark.parametrize(("source", "reader"), PAIRS)
def test_words_beside_damaged_ones_stay(source, reader):
    """A right sentence in another language beside a damaged one comes out as it went in."""
    for bad, right in ((GERMAN, FRENCH), (FRENCH, GERMAN), (SPANISH, FRENCH), (GERMAN, SPANISH)):
        garbled, original, _ = M.repair(damage(bad, source, reader) + " " + right)
        assert garbled and original is not None and original.endswith(" " + right), (bad, right, original)


def test_only_matched_spans_change():
    out = M.repair("Die grš§te Stra§e fŸhrt. L’état et la société, être, à l’école; état élève")[1]
    assert out == "Die größte Straße führt. L’état et la société, être, à l’école; état élève"
    out = M.repair("Die Straﬂe f¸hrt ¸ber die Br¸cke, état élève, être")[1]
    assert out == "Die Straße führt über die Brücke, état élève, être"


def test_several_kinds_of_damage_in_one_text():
    assert M.repair("cafÃ© und Ã¼ber grš§te Brüder")[1] == "café und über größte Brüder"
    assert M.repair("Das CafÃ© in der Stra§e, fŸr alle: naÃ¯ve MŠnner")[1] == "Das Café in der Straße, für alle: naïve Männer"


@pytest.mark.parametrize("text", [GERMAN, FRENCH, SPANISH, "Škoda, žába a řeka; Žižkov", "20m×30m, 5±2, 30°C; §5 – „so nicht“ … «oui»", "ﬁnal ﬂeet", "İstanbul’da büyük ağaç", "Łódź, święto, żółw", "Großübung ÀÉÈ ÉCOLE"])
def test_right_text_is_left(text):
    assert M.repair(text) == (False, None, "")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_texts_come_back(spark):
    """Right texts of the tables, damaged as a whole by every pair: almost all are found and come back exactly, none comes back wrong in the ASCII part."""
    rows = spark.read.parquet(f"{SF}/parsed.parquet").where("format <> 'pdf'").select("text").distinct().collect()
    found = exact = total = 0
    for (text,) in rows:
        text = (text or "")[:3000]
        if text.isascii() or M.repair(text)[0] or any(0x180 <= ord(c) < 0x2000 or ord(c) > 0x2E00 for c in text):
            continue
        for source, reader in PAIRS:
            try:
                bad = damage(text, source, reader)
            except UnicodeEncodeError:
                continue
            if bad == text.replace("’", "'"):
                continue
            garbled, original, _ = M.repair(bad)
            total += 1
            found += garbled
            exact += original == text.replace("’", "'")
    print(total, found, exact)
    assert total > 50 and found >= 0.95 * total and exact >= 0.9 * found
