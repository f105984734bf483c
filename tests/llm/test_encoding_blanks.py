"""Characters whose second half is a no-break space or a next-line control."""

import random

import pytest

from tessera.llm import encoding as E

SENTENCES = {
    "fr": ["Le marché voilà ferme à minuit, voilà ce que {n} a dit.", "Voilà le prix de {n}, déjà au-delà de {k}.", "Où qu’il aille, {n} revient à son niveau d’août : 10 000 voix."],
    "ru": ["Россия и {n} подписали договор.", "Рынок {n} вырос на {k} пунктов.", "Решение о {n} примут завтра."],
}


def text(rnd, lang):
    return " ".join(rnd.choice(SENTENCES[lang]).format(n=rnd.choice(["Zulek", "Morav", "Tarin"]), k=rnd.randint(1, 999)) for _ in range(rnd.randint(2, 6)))


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    return E.fit([(lang, text(rnd, lang)) for lang in SENTENCES for _ in range(400)])


@pytest.mark.parametrize("sound,torn", [("voilà", "voilÃ "), ("Рынок", "Ð ынок"), ("août … à", "août … Ã ")])
def test_a_half_that_is_a_blank(model, sound, torn):
    t = f"{sound} ferme"
    assert model.restore(f"{torn} ferme")[0] == t and model.restore(f"{torn} ferme")[2]
    assert model.restore_segment(f"{torn} ferme")[0] == t


def test_sound_no_break_spaces_stay(model):
    for t in ("Où qu’il aille, Zulek revient à son niveau d’août : 10 000 voix.", "Voilà ! 12 345 €", "a\u0085b"):
        assert model.restore(t) == (t, "", False)
