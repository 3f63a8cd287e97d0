import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzbar.llm.sentences import sentence_units, units


def parts(text, lang=None):
    return [text[a:b] for a, b in units(text, lang)]


CASES = {
    "abbreviations": ["Dr. Brack met Mr. X at 3 p.m. UTC.", "Costs rose, e.g. for A, vs. No. 3 (cf. sec. 4.1).", "J. R. Lane keeps it in the U.S. session.", "It ended at 4 p.m.", "The rest, etc.", "No."],
    "marks": ["Who set x to 347?!", "Then... the bid vanished.", "Fine!", "Entry at 1.5, exit at .381 ... a loss.", "Wait..."],
    "quotes": ["“Hold it. Wait!” was all that he said.", "“The feed is late again.”", "hard_kill stayed at 182.", 'She wrote, "Too wide. Do not enter," and left.', '"Was it?" asked Ann.', "(Was it? It was.)"],
    "de": ["Am 18. April lag sie bei 31,1.", "Das gilt z. B. für A, d. h. bzw. ca. 5 Mio. Einheiten (vgl. Abs. 3).", "„Ist sie zu?“, fragte er.", "Er schrieb: „Zu weit. Nicht handeln.“", "Im 19. Versuch gelang es."],
    "fr": ["M. Omarand a noté : « Trop large. On attend. »", "Le coût est d'env. 40 % (cf. p. 27) !", "« Vide », a dit Mme Lane.", "Rien... puis tout, p. ex. ici."],
    "es": ["¡No entres!", "«¿Quién cambió el límite?», preguntó la Dra. Lane.", "Cayó en EE. UU. durante la sesión, p. ej. aprox. 5 (véase la pág. 3).", "El Sr. X revisó la orden núm. 4."],
    "ru": ["Цена упала, т. е. больше нормы (см. стр. 5).", "Сняты заявки и т. д.", "По данным г-на X спред широк.", "«Стакан пуст», — сказал он.", "Он написал: «Широк. Ждём».", "Объём 22 тыс. лотов!"],
    "ar": ["راجع د. Morvane التقرير رقم 76.", "كتب: «الفارق واسع. انتظر.» ثم أغلق التذكرة.", "هل تم الإصلاح؟", "اتسع (انظر ص. 279)!"],
    "hi": ['उसने लिखा, "फैलाव अधिक है। रुको।" और बंद किया।', "डॉ. Lane ने देखा (पृ. 310 देखें)!", "क्या भर दिया गया?"],
    "th": ["ผู้ดูแลเปิดระบบเวลา 10:24 น. ตามแผน", "ตรวจสอบซ้ำ ๆ จนกว่าจะครบ", "คำสั่ง 4acd7690 ถูกยกเลิก"],
    "ko": ['담당자는 "얇다. 기다리자."라고 적었다.', "버전 v7.13.5에서 a.py 오류를 고쳤다.", "복구되었나요?"],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("lang", [None, "en", "xx", "de-AT"])
@pytest.mark.parametrize("between", [" ", "  ", "\n", "\r\n", " "])
def test_units_in_a_row(name, lang, between):
    if name == "th" and "\n" in between:
        pytest.skip("a wrap alone ends no unit, and a blank is all that ends one here")
    assert parts(between.join(CASES[name]), lang) == CASES[name]


@pytest.mark.parametrize(
    "units_",
    [["对于A，价差达到85.5……", "他问：“谁改了止损？”没有人回答。", "费率升至44%！？", "订单被撤销（参见第3页。待核对。）！", "版本v2.1.4修复了a.cc的错误。"],
     ["担当者は「薄い。待とう。」と書いて席を離れた。", "v1.8.9では欠けた（詳細は別紙。未確認。）ようだ。", "欠損は補完されましたか？"]],
)
def test_scripts_without_blanks(units_):
    assert parts("".join(units_)) == units_


def test_structure():
    text = "# A. B? c\n2024-01-01T00:00:00Z WARN x. Y\n- One. Two!\n* Three\n1. Four. Five\n\nSix\nseven. Eight\n \t\nnine"
    assert parts(text) == ["# A. B? c", "2024-01-01T00:00:00Z WARN x. Y", "- One.", "Two!", "* Three", "1. Four.", "Five", "Six\nseven.", "Eight", "nine"]


def test_missing_blank_between_sentences():
    assert parts("Call it after.By 07:26, replay.rs v1.2.X ended.The rest held.") == ["Call it after.", "By 07:26, replay.rs v1.2.X ended.", "The rest held."]
    assert parts("It had not broken.No. They held.They’ve won.Fine! In the U.S. session, z.B. hier.Dr. Lane ran it.") == [
        "It had not broken.", "No.", "They held.", "They’ve won.", "Fine!", "In the U.S. session, z.B. hier.", "Dr. Lane ran it.",
    ]


def test_a_wrapped_run_of_signs_is_no_heading():
    assert parts("Payload\n########## was dropped.\n## Next") == ["Payload\n########## was dropped.", "## Next"]


@pytest.mark.parametrize("text", [None, "", " ", "\n　\n", "...", "👍 !!", "—"])
def test_wordless(text):
    assert units(text) == []


def test_signs_join_their_neighbours():
    assert parts("Done. ✅\n\n*** \n\nNext. !!") == ["Done. ✅", "***", "Next. !!"]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB. !?\n\r«»“”\"()（）「」。、#-1中กๆ😀 ​", max_size=60))
def test_every_character_is_in_one_unit(text):
    spans, last = units(text), 0
    for a, b in spans:
        assert last <= a < b and not text[last:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        last = b
    assert not spans or not text[last:].strip()


def test_very_long_text():
    text = "The bar store held. " * 20_000 + "(" * 20_000
    assert len(units(text)) == 20_000  # signs without words join the unit before them


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en", 5), (1, "A b. C d.", "en", 5), (2, None, None, 5), (3, "x", None, 5), (None, "y", "q", 5)], "doc_id long, text string, lang string, start_char int")
    got = sorted((r.doc_id or 0, r.start_char, r.end_char) for r in sentence_units(df).collect())
    assert got == [(0, 0, 1), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (3, 0, 1)]
    assert sentence_units(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "lang, sentences",
    [
        ("en", ["Arrived at Ave. Montaigne.", "He left."]), ("en", ["The dept. Head said no.", "It was so."]), ("en", ["He joined Acme Inc.", "The firm grew.", "Acme Inc. Holdings fell."]),
        ("it", ["Il Sig. Rossi arriva.", "Poi parte."]), ("pt", ["O Sr. Silva saiu às 10.", "Voltou depois."]), ("nl", ["Zie bijv. Fig. 2.", "Klaar."]), ("el", ["Τι κάνεις;", "Καλά.", "Ο κ. Παπάς ήρθε."]),
        ("uk", ["Див. рис. 3 та т.д.", "Кінець."]), ("bn", ["ডা. রহমান এলেন।", "তিনি গেলেন।"]), ("am", ["ሰላም ነው።", "ደህና።"]), ("he", ["ד״ר כהן הגיע.", "הוא הלך."]), ("fa", ["او رفت؟", "بله."]),
    ],
)
def test_further_languages(lang, sentences):
    text = " ".join(sentences)
    assert [text[a:b] for a, b in units(text, lang)] == sentences


def test_no_cap_on_the_context_and_linear_time():
    word = "x" * 500
    text = f"See {word}.Next one. Done."
    assert [text[a:b] for a, b in units(text, "en")] == [f"See {word}.", "Next one.", "Done."]
    began = time.process_time()
    for text in ("1.” " * 60_000 + "x", "((1. " * 40_000 + "x", "a. " * 60_000, "。" * 200_000 + "好", "A.B." * 40_000):
        assert units(text, "en")[-1][1] == len(text.rstrip())
    assert time.process_time() - began < 60
