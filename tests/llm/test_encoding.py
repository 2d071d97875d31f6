import numpy as np
import pytest

from manualmill.llm import encoding
from manualmill.llm.encoding import AUTOMATON, Usual, code_points, pair_codes, restore

CLEAN = [
    "Die Übersicht öffnet das Menü für Geräte während der Größe über fünf Läufen.", "La página cerró la sesión según la política, también mañana; años después.", "L’élément choisi répète la façade très tôt, où la règle protège.",
    "Każdy użytkownik dołącza zewnętrzną płytę; główny moduł zwiększa źródło, częstość.", "Новый модуль повторяет прежнюю версию при низком давлении, список в шаге.", "The “safe” module’s price is £40 – or €9… see §4, jalapeño, résumé, naïve™.",
    "├── bin\n└── log ╔═══╗ ½ × ¼ ≈ 0.125 µm², ±2 °C, «quoted»", "CONFIGURAÇÃO PADRÃO: NÃO ALTERE A SEÇÃO.", "ГОСТ РСТ-12 и РС-7",
]


def wrong(text, true, seen):
    return "".join(encoding._byte_char(seen, b) for b in text.encode(true, "ignore"))


@pytest.fixture(scope="module")
def usual():
    count = {}
    for text in CLEAN * 60 + [wrong(CLEAN[k], "utf-8", e) for k in range(5) for e in ("cp1252", "cp1251")]:
        for c in pair_codes(code_points(f" {text} ")).tolist():
            count[c] = count.get(c, 0) + 1
    return Usual(np.array(list(count)), np.array(list(count.values())))


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_stays(text, usual):
    assert restore(text, usual) == (text, 0, 0, 0)


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("seen", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"])
def test_multibyte_spans_are_restored(k, seen, usual):
    bad = f"{CLEAN[5]} {wrong(CLEAN[k], 'utf-8', seen)}"
    fixed, spans, _, _ = restore(bad, usual)
    assert spans and fixed == f"{CLEAN[5]} {CLEAN[k]}"


def test_twice_wrong(usual):
    bad = wrong(wrong(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    fixed, spans, _, _ = restore(bad, usual)
    assert spans and fixed == CLEAN[0]


@pytest.mark.parametrize("k, true, seen", [(0, "cp1252", "cp850"), (1, "cp1252", "cp850"), (3, "cp1250", "cp850"), (4, "cp1251", "cp1252"), (4, "koi8-r", "cp1251"), (4, "cp866", "cp1251"), (4, "cp1251", "koi8-r")])
def test_single_byte_readings_are_restored(k, true, seen, usual):
    fixed, _, words, _ = restore(wrong(CLEAN[k], true, seen), usual)
    assert words and fixed == CLEAN[k].encode(true, "ignore").decode(true)


def test_lost_characters_count(usual):
    assert restore("r�glage", usual)[1:] == (0, 0, 1)
    assert restore("", usual) == ("", 0, 0, 0)


def test_automaton_takes_well_formed_bytes_only():
    for data in (b"\xc0\x80", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf5\x80\x80\x80", b"\x80", b"\xc3"):
        assert not AUTOMATON.search(data)
    for c in ("é", "語", "😀", "\ud7ff", "\ue000"):
        assert AUTOMATON.fullmatch(c.encode())


def test_table(spark):
    rows = [(k, t, 1) for k, t in enumerate(CLEAN * 30)] + [(900, wrong(CLEAN[0], "utf-8", "cp1252"), 1), (901, None, 1), (902, "", 1), (None, "Ã¼", 1), (903, "a�", 1), (903, "a�", 1), (904, "x" * 1_000_000 + " fÃ¼r", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    got = {r.key: r for r in encoding.garbled(docs, "doc_id", "text").collect()}
    assert set(got) == {"900", "903", "904"} and got["900"].text == CLEAN[0] and got["903"].lost == 1
    assert encoding.garbled(docs.limit(0), "doc_id", "text").count() == 0


def referred(text, form):
    return "".join(form(c) if ord(c) > 127 else c for c in text)


@pytest.mark.parametrize("form", [lambda c: f"&#{ord(c)};", lambda c: f"&#x{ord(c):X};", lambda c: f"&amp;#{ord(c)};", lambda c: c if ord(c) % 2 else f"&#0{ord(c)};"])
@pytest.mark.parametrize("k, seen", [(0, "cp1252"), (0, "latin-1"), (1, "cp1252"), (3, "cp1250"), (4, "cp1251")])
def test_references_are_read(form, k, seen, usual):
    fixed, spans, _, _ = restore("x " + referred(wrong(CLEAN[k], "utf-8", seen), form), usual)
    assert spans and fixed == "x " + CLEAN[k]
    assert restore("a &#65533; b", usual)[1:] == (0, 0, 1) and restore("f&#195&#188r", usual)[:2] == ("für", 1)


def test_named_references_are_read_and_others_stay(usual):
    assert restore("f&Atilde;&frac14;nf&nbsp;&lt;b&gt; &AMP; &eacute;l&eacute;ment &amp;lt; ?a&copy=1", usual) == ("fünf&nbsp;&lt;b&gt; &AMP; &eacute;l&eacute;ment &amp;lt; ?a&copy=1", 1, 0, 0)


@pytest.mark.parametrize("text", CLEAN)
def test_correct_references_stay(text, usual):
    text = referred(text, lambda c: f"&#{ord(c)};") + " a &#150; b &bogus; &#1114112; &#xD800; &#0; &#" + "9" * 5000
    assert restore(text, usual) == (text, 0, 0, 0)


def test_references_of_a_single_byte_reading(usual):
    fixed, _, words, _ = restore(referred(wrong(CLEAN[0], "cp1252", "cp850"), lambda c: f"&#{ord(c)};"), usual)
    assert words and fixed == CLEAN[0]


def test_table_with_references(spark):
    bad = referred(wrong(CLEAN[0], "utf-8", "cp1252"), lambda c: f"&#{ord(c)};")
    rows = [(k, t) for k, t in enumerate(CLEAN * 30)] + [(900, bad), (901, "a &lt; b")]
    got = encoding.garbled(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()
    assert bad.isascii() and [(r.key, r.text) for r in got] == [("900", CLEAN[0])]
