import random

import pytest

from termloom.llm import mojibake as M

CLEAN = {
    "de": "für Zustände genügt größere Übergänge erklärt später Maß schwächere",
    "fr": "méthode donnée déjà près série répartition énergie symétrie où",
    "ru": "Почему оболочка полная энергия повторяет выборка график далее упражнение",
    "en": "don’t “narrow” µHartree ± — α ≈",
    "pl": "później wartość ścieżka część gęstość wąska możliwa działa",
}


def garble(text, written_in, shown):
    back = {b: c for c, b in M.byte_table(shown).items()}
    return "".join(chr(back.get(b, b)) if b > 127 else chr(b) for b in text.encode(written_in))


SWAPS = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "mac_roman"), ("en", "utf-8", "cp437"), ("ru", "cp1251", "cp1252"), ("ru", "koi8_r", "cp1251"), ("pl", "cp1250", "cp1252"), ("fr", "cp850", "cp1252"), ("ru", "utf-8", "cp1251")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(0)
    docs = [(i, " ".join(rng.sample(CLEAN[g].split(), 5)), g if i % 7 else {"de": "de-DE", "en": "EN"}.get(g, g), "s") for i, g in enumerate(list(CLEAN) * 60)]
    bad = []
    for k, (g, written_in, shown) in enumerate(SWAPS):
        bad.append((1000 + k, garble(CLEAN[g], written_in, shown), g, "t"))
    double = garble(garble(CLEAN["de"], "utf-8", "cp1252"), "utf-8", "cp1252")
    bad += [(1100, double, "de", "t"), (1101, "don��t stop", "en", None), (1102, "gen\x81gt", "de", "t")]
    fine = [(2000, None, "de", "s"), (2001, "", None, "s"), (2002, "plain ascii " * 50, "en", "s"), (2003, "┌──┐│ ok │└──┘ ✅ █▒", "en", "s"), (2004, "für", "de", "s"), (2005, "a" * 300_000 + " für", "de", "s"), (2006, "Å Ñ ∂ ΔΕ", "ru", None)]
    return docs, bad, fine


def test_garbled_and_restored(spark, corpus):
    docs, bad, fine = corpus
    df = spark.createDataFrame(docs + bad + fine, "doc_id long, text string, lang string, source string")
    hits, tables = M.learn(df)
    got = {r.doc_id for r in M.garbled(df, hits).collect()}
    assert got == {b[0] for b in bad}
    right = {r.doc_id: r for r in M.restored(df, hits).collect()}
    assert set(right) == got
    for k, (g, written_in, shown) in enumerate(SWAPS):
        want, own = CLEAN[g].split(), right[1000 + k].text.split(" ")
        if g != "en":
            assert sum(a == b for a, b in zip(want, own)) >= 0.8 * len(want), (written_in, shown, own)
    assert right[1100].text.split()[0] == "für" and right[1101].unrestored == 1
    assert M.swaps_of(hits).where("source = 't'").count() >= 5
    shown = {(r.swap, r.shown): r.stands_for for r in tables.where("source = 't'").collect()}
    assert shown["utf-8>cp1252", "Ã"] == "\xc3" and shown["cp1251>cp1252", "ý"] == "э"


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    hits, tables = M.learn(df)
    assert M.garbled(df, hits).isEmpty() and M.restored(df, hits).isEmpty() and tables.isEmpty()


def test_language_and_tokens():
    assert [M.language(x) for x in ("en-EN", " DE ", None, "", "x", "12")] == ["en", "de", "*", "*", "*", "*"]
    assert M.tokens_of("für x=größe( ) 12") == ["für", "größe", " "]


def test_copies_and_repeats_are_no_language(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.sample(CLEAN["de"].split(), 5)) + f" {i}", "de", "s") for i in range(120)]
    bad = garble("für Zustände", "utf-8", "cp1252")
    copied = [(1000 + i, bad, "de", "st"[i % 2]) for i in range(60)]
    repeated = [(2000, "größer " + (garble("schwächere", "utf-8", "cp1252") + " ") * 5_000, "de", "s")]
    df = spark.createDataFrame(clean + copied + repeated, "doc_id long, text string, lang string, source string")
    hits, _ = M.learn(df)
    assert {r.doc_id for r in M.garbled(df, hits).collect()} == {d[0] for d in copied + repeated}
    assert {(r.source, r.tokens) for r in M.swaps_of(hits).collect()} == {("s", 2 * 30 + 5_000), ("t", 2 * 30)}


GREEK = """
η ατομική φυσική μελετά τη δομή των ατόμων και τις στάθμες ενέργειας των ηλεκτρονίων σε κάθε φλοιό του ατόμου
ο υπολογισμός των κυματοσυναρτήσεων απαιτεί μεγάλη ακρίβεια και πολλές διαμορφώσεις για τη σύγκλιση της μεθόδου
κάθε κατάσταση χαρακτηρίζεται από τη στροφορμή την ομοτιμία και τον αριθμό των ηλεκτρονίων στους υποφλοιούς
τα αποτελέσματα συγκρίνονται με πειραματικές τιμές ώστε να εκτιμηθεί το σφάλμα της θεωρίας και του προγράμματος
η σύζευξη των στροφορμών γίνεται με διαδοχικό τρόπο από τους εσωτερικούς προς τους εξωτερικούς φλοιούς
στο επόμενο βήμα διαβάζουμε το αρχείο και σχεδιάζουμε το διάγραμμα με τις ενέργειες όλων των καταστάσεων
"""


def test_a_page_that_is_no_starting_point(spark):
    """Greek in its own page shown as a Western one: no pair of the list reads it, the table is learned from nothing."""
    assert "cp1253" not in M.WRITTEN_IN and "iso8859_7" not in M.WRITTEN_IN
    rng = random.Random(3)
    words = GREEK.split()
    text = lambda: " ".join(rng.choice(words) for _ in range(12))
    clean = [(i, text(), "el", "ab"[i % 2]) for i in range(400)]
    wanted = [(1000 + i, text(), "el", "c") for i in range(200)]
    shown = [(i, garble(t, "cp1253", "cp1252"), g, s) for i, t, g, s in wanted]
    df = spark.createDataFrame(clean + shown, "doc_id long, text string, lang string, source string")
    hits, tables = M.learn(df)
    assert {r.doc_id for r in M.garbled(df, hits).collect()} == {d[0] for d in wanted}
    right = {r.doc_id: r.text for r in M.restored(df, hits).collect()}
    same = [a == b for i, t, *_ in wanted for a, b in zip(t, right[i])]
    assert sum(same) >= 0.95 * len(same)
    assert tables.where("swap = 'learned' AND source = 'c'").count() > 20
