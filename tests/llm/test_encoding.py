"""Restoring damaged text: round trips over many chains, and sound text left alone."""

import random

import pytest

from tessera.llm import encoding as E

SENTENCES = {
    "en": ["Over coffee at the café, {n} called the move “naïve” again.", "It isn’t a late reading – it’s an early one, said {n}.", "Fees came to €{k} and the rebate to £{k} for {n}.", "A reading of {k}° at the station near {n}."],
    "fr": ["Le marché ferme le {k} à minuit, après une séance très agitée à {n}.", "Ça n’a pas empêché {n} de se présenter dès l’été dernier.", "Où qu’il aille, le prix de {n} revient à son niveau d’août."],
    "pt": ["O aviso dizia «AMANHÃ» e ninguém o retirou de {n}.", "A decisão sobre {n} não será antecipada: RESOLUÇÃO {k}.", "Há três versões do título e só uma está correta em {n}."],
    "ru": ["Никто не ожидал такого узкого спреда в {n}.", "Объём торгов составил {k} рублей.", "Проверяющие отклонили связь между двумя записями {n}."],
    "pl": ["Żaden z kupujących nie chciał zejść poniżej {k} w {n}.", "Rozstrzygnięcie nastąpi po ogłoszeniu wyników w {n}.", "Płynność była mała, więc cena {n} łatwo się zmieniała."],
}


def text(rnd, lang):
    return " ".join(rnd.choice(SENTENCES[lang]).format(n=rnd.choice(["Zulek", "Morav", "Tarin"]), k=rnd.randint(1, 999)) for _ in range(rnd.randint(2, 6)))


def sloppy(s, enc):
    back = {b: c for c, b in E.byte_of(enc).items()}
    return "".join(chr(b) if b < 128 else back[b] for b in s.encode("utf-8"))


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    rows = [(lang, text(rnd, lang)) for lang in SENTENCES for _ in range(400)]
    rows += [(lang, sloppy(text(rnd, lang), "cp1252")) for lang in SENTENCES for _ in range(20)]
    rows += [("ru", text(rnd, "ru").encode("koi8-r").decode("cp1251")) for _ in range(12)]
    return E.fit(rows)


@pytest.mark.parametrize("enc", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_utf8_read_in_another_encoding(model, enc):
    rnd = random.Random(2)
    texts = [t for lang in SENTENCES for _ in range(20) if not (t := text(rnd, lang)).isascii()]
    got = [model.restore(sloppy(t, enc)) for t in texts]
    assert all(damaged for _, _, damaged in got)
    assert sum(g[0] == t for g, t in zip(got, texts)) >= 0.9 * len(texts)


def test_twice_and_in_a_stretch(model):
    rnd = random.Random(3)
    for _ in range(30):
        a, b = text(rnd, "fr"), text(rnd, "fr")
        assert model.restore(a + " " + sloppy(sloppy(b, "cp1252"), "cp1252"))[0] == a + " " + b


def test_single_byte_encodings(model):
    rnd = random.Random(4)
    for lang, written, read in (("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ru", "cp1251", "cp1252"), ("fr", "cp1252", "cp1251")):
        for _ in range(20):
            t = text(rnd, lang)
            got = model.restore(t.encode(written, "ignore").decode(read))
            assert got[2] and got[0] == t.encode(written, "ignore").decode(written), (lang, written, read)


def test_sound_text_stays(model):
    rnd = random.Random(5)
    for lang in SENTENCES:
        for _ in range(100):
            t = text(rnd, lang)
            assert model.restore(t) == (t, "", False)
    for t in ("", None, "plain", "a &amp; b 🙂🏆", "日本語のテキスト", "Café noir", "x" * 50_000, "é" * 20_000):
        assert model.restore(t)[2] is False


def test_lost_characters_count(model):
    assert model.restore("caf�")[2] and model.restore("a\x93b")[2]


def test_over_a_table(spark, model):
    rows = [(1, None, 3), (2, "", 4), (3, sloppy(SENTENCES["fr"][1], "cp1252"), 5), (4, SENTENCES["fr"][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, damaged long")
    got = {r.doc_id: (r.restored, r.damaged) for r in E.restore(df, model).collect()}
    assert got == {1: (None, False), 2: ("", False), 3: (SENTENCES["fr"][1], True), 4: (SENTENCES["fr"][1], False)}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert E.restore(empty, E.fit_on(empty)).count() == 0


def test_chains_of_both_kinds(model):
    """Written in one Cyrillic encoding, read in another, and the result's UTF-8 read as Latin."""
    rnd = random.Random(12)
    texts = [text(rnd, "ru") for _ in range(30)]
    got = [model.restore(t.encode("cp1251").decode("koi8-r").encode("utf-8").decode("latin-1")) for t in texts]
    assert sum(r == t for t, (r, _, _) in zip(texts, got)) >= 27 and all(damaged for _, _, damaged in got)
    assert any("utf-8<latin-1 cp1251<koi8-r" in chains for _, chains, _ in got)
