import pytest

from quillmill.functions.mojibake import badness, repair


def misread(text, code="latin-1", times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(code) if code == "latin-1" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
    return text


TEXTS = ["Le café était fermé, naïve façon d’être à l’Élysée", "Müller größer straße ÄÖÜ", "¿Dónde está el niño? ¡Mañana!", "“quoted” – dash… €5 ™", "ž Šo ł 你好 🙂", "Привет, мир", "Καλημέρα κόσμε"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("code", ["latin-1", "cp1252"])
def test_damage_of_up_to_three_layers_is_undone(text, code):
    for times in (1, 2, 3):
        assert repair(misread(text, code, times)) == text
    # in part: a clean text stays beside it
    assert repair(f"{TEXTS[0]} | {misread(text, code)} | {TEXTS[2]}") == f"{TEXTS[0]} | {text} | {TEXTS[2]}"


@pytest.mark.parametrize("text", [*TEXTS, "CAFÉ» et ÉTÉ” puis « À »", "Ã", "â€", "AÑO»", "ß»", "plain", "", "�", "Straße 5° ±2", "É’été", "tête-à -tête", "à «»"])
def test_clean_text_stays(text):
    assert repair(text) == text


def test_badness():
    assert badness(TEXTS[0]) == 0 < badness(misread(TEXTS[0])) < badness(misread(TEXTS[0], times=2))
