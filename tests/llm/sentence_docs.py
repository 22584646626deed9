"""Made texts of known sentences in ten languages, with abbreviations, numbers, quotations and headings."""

from __future__ import annotations

import random

# Sentences; {n} is a number.  A space follows each in its script's way.
SENTENCES = {
    "en": ["Tighten bolt No. {n} to {n} Nm.", "See Sect. {n} or Fig. {n}, i.e. the front view.", "Does the pump leak?", 'The panel shows "Stop. Call for help." and halts.',
           "Use rags, oil, etc. as listed.", "The seal is from Acme Co. Ltd. and weighs {n} kg.", "Keep hands away!", "It runs at {n} rpm (see Fig. {n}) on site.", "Version {n}.{n} applies."],
    "de": ["Die Welle mit ca. {n} Nm anziehen.", "Siehe Abb. {n} und Kap. {n} für die Düse.", "Ist das Lager heiß?", "Am {n}. März wurde die Kette ersetzt.", "Teile, z. B. die Welle, sind zu prüfen.",
           "Auf der Anzeige steht „Halt. Tür prüfen.“ und sie blinkt.", "Nie offen betreiben!"],
    "fr": ["Voir fig. {n} et p. {n} pour la buse.", "La pompe fuit-elle ?", "L'écran affiche « Arrêt. Vérifier la pompe. » et s'éteint.", "Env. {n} L d'huile suffisent.", "Ne jamais ouvrir à chaud…", "Serrer la vis à {n} Nm."],
    "es": ["Véase la pág. {n}, fig. {n}, sobre la brida.", "¿Gotea la bomba?", "¡No abra la tapa!", "Use aprox. {n} L de aceite.", "La pantalla indica «Pare. Revise todo.» y se apaga.", "Limpie la correa, la brida, etc."],
    "ru": ["На рис. {n} показана рама, см. стр. {n}.", "Почему шумит насос?", "Не открывайте крышку!", "Зазор составляет {n} мм.", "На экране надпись «Стоп. Проверить масло.», и мотор стоит."],
    "zh": ["请以{n}Nm拧紧螺栓。", "油泵是否漏油？", "屏幕显示“停机。检查油箱。”后，应关闭阀门。", "运行时严禁触摸！", "间隙为{n}.{n}mm；油箱应保持清洁。"],
    "ja": ["ボルトを{n}Nmで締め付けてください。", "油が漏れていませんか？", "画面に「停止。点検。」と表示されたら止めます。", "運転中は触れないでください！", "軸受（図{n}参照。）を外します。"],
    "th": ["ตรวจสอบสายพานทุก {n} ชั่วโมง", "ห้ามเปิดปั๊มขณะร้อน", "ดูรูปที่ {n} สำหรับวาล์ว", "เปลี่ยนวาล์วรุ่น KV-{n} เมื่อสึกหรอ", "ทำความสะอาดตัวกรองทุกวัน"],
    "hi": ["वाल्व को {n} Nm पर कसें।", "क्या पंप से तेल रिस रहा है?", "चित्र सं. {n} में वाल्व देखें।", 'स्क्रीन पर "रुकें। जाँचें।" दिखे तो बंद करें।', "गरम होने पर न खोलें!"],
    "ar": ["اربط الصمام بعزم {n} Nm ثم نظفه.", "هل يتسرب الزيت؟", "انظر الشكل {n}، حيث تظهر المضخة.", "لا تفتح الغطاء!", "تظهر عبارة «قف. افحص الزيت.» ثم تتوقف المضخة."],
}
HEADINGS = {"en": "3.1 Maintenance", "de": "Wartung", "fr": "SÉCURITÉ", "es": "2. Lubricación", "ru": "Безопасность", "zh": "3. 润滑", "ja": "安全", "th": "การบำรุงรักษา", "hi": "7.2 सुरक्षा", "ar": "السلامة"}


def document(lang: str, rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text and its units."""
    text, units = "", []

    def add(unit: str) -> None:
        nonlocal text
        units.append((len(text), len(text) + len(unit)))
        text += unit

    for p in range(rng.randint(2, 5)):
        if p:
            text += rng.choice(["\n\n", "\r\n\r\n", "\n \n\n"])
        if rng.random() < 0.25:
            add(HEADINGS[lang])
            continue
        marker = rng.choice([None, None, "{}) ", "- ", "a{}. "])
        for i in range(rng.randint(1, 6)):
            s = rng.choice(SENTENCES[lang]).replace("{n}", "{}")
            s = s.format(*[rng.randint(2, 90) for _ in range(s.count("{}"))])
            if i:
                text += "\n" if marker else "" if lang in ("zh", "ja") else " "
            add((marker.format(i + 1) if marker else "") + s)
    return text, units


def documents(n: int, seed: int) -> list[tuple[int, str, str, list[tuple[int, int]]]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SENTENCES))
        out.append((i, lang, *document(lang, rng)))
    return out
