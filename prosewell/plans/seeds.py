"""Seed blocks that queries append to the documents, so that the rules have something to find.

Each list has blank, positive, negative and boundary variants; a document takes the one of its id modulo
the list's length.
"""

SEEDS: dict[str, list[str]] = {
    "en": [
        "",
        "It's worth noting that this may possibly work. Arguably, it does. That said, one could argue more.",
        "Moreover, there are several key factors. Let me walk you through it.\nIn conclusion, here are five. Whether you're new, lesson 3: rest.\n  Tip #4. Sleep.",
        "Walk away with actionable insights, so you don't have to. This game-changer is seamless.\nThis changes everything; unlock your full potential. The future is bright. Look no further.",
        "It stands as a testament to a rich tapestry, highlighting the details. Experts agree. Deeply rooted, nestled in the heart of town.",
        "Honestly? The result? Make no mistake: you've been told. Here's the truth: wait for it.\nSlow becomes fast. fast becomes done. The best part? It hit me.",
        "I'm thrilled to share. Agree? Thoughts?\n🚀 Launch day\n#one #two #three\nGrateful for this journey. Raise your hand if you know. PSA: rest.",
        "It boasts a view and serves as a central hub in order to help. A truly wide range of, a deep dive, countless more.",
        "It is not just a tool — it is a way. It's not the end, it's the start. Not because of luck, but because of work. The real question isn't this.\nGive you time to rest. Then it gives you hope. Less about speed, more about care.",
        "Delve into the realm of synergy. DELVE deeper; foster Fosters; game-changing utilization.",
        "Our platform is designed to add value and efficiency; this tool helps goals. Café’s world-class naïve approach.",
        "Plain words about a garden, its soil and the rain.",
    ],
    "placeholder": [
        "",
        "Write [your language] and [Your Name] here.",
        "<!-- [your name] -->\n  <!-- Lorem ipsum -->",
        "```[your name]```\ntext [your a]",
        "INSERT TITLE HERE, insert title here, INSERT XY, INSERT ABC",
        "Lorem ipsum dolor; lorem IPSUM again.",
        "[insertar estadística aquí] y [INSERTAR ÑANDÚ]",
        "[your 1 thing] [yours] ALorem ipsum Lorem ipsums",
    ],
    "phrases": [
        "",
        "In conclusion, furthermore. In conclusion, FURTHERMORE.",
        "furthermore once, in conclusion in conclusion in conclusion",
        "en la era digital, transformar y transformar; juega un papel crucial",
        "важно отметить; является, является, является. В современном мире",
        "결론적으로 첫째 둘째 셋째 또한 또한 혁신적 혁신적 혁신적",
        "tóm lại, hơn nữa, vượt trội, ngoài ra, ngoài ra. Tuyệt vời",
        "革命的な画期的 革命的 革命的 これにより これにより 幸いです",
        "ในยุคดิจิทัล ยกระดับ ยกระดับ เปลี่ยนโลก เปลี่ยนโลก เปลี่ยนโลก",
        "ဒစ်ဂျစ်တယ်ခေတ် နှင့် အရေးပါသောအခန်းကဏ္ဍ",
        "di era digital implementasi implementasi pada akhirnya membuka potensi",
    ],
    "es": [
        "",
        "Es importante destacar que cabe señalar esto. No cabe duda de que vale la pena mencionar.",
        "En conclusión, así fue.\n- En resumen\nDijo algo. En síntesis, nada.",
        "Además, llueve.\n* Por otro lado; sin embargo no.\nAdemás llueve",
        "Rojo, verde y azul. Pan, vino y queso.\nSol, luna y mar.",
        "Rojo, verde y azul.\n```\nPan, vino y queso. Sol, luna y mar.\n```\nUno, dos y tres.",
        "Puede ayudar. Pueden ayudarnos. Podría vivir. Puedo ver.",
        "Puede ayudar. No puede ser.\n```\nPuede comer\n```",
        "Fácilmente y rápidamente llegó. La mente es lenta.\nÚltimamente vino. Claramente no.\nSolamente, simplemente y finalmente, CLARAMENTE.",
        "El plan — así de claro — funciona.\n—Hola —dijo.\nGanamos — porque sí. Perdimos — porque no.",
        "```\nEl plan — dentro — no.\n```\n  Otro plan — fuera — sí.  ",
    ],
    "th": ["", "เป็นที่ทราบกันดีว่าดี สิ่งสำคัญคือใจ", "โดยสรุป ดี\n- สรุปได้ว่า ดี\nคำ โดยสรุป", "นอกจากนี้มี\n  ดังนั้นจึง\nและ ดังนั้น", "อากาศดี"],
    "my": ["", "အရေးကြီးသောအချက်မှာ ကောင်း", "အနှစ်ချုပ်အနေနှင့် ကောင်း\n- နိဂုံးချုပ်အားဖြင့်", "ထို့အပြင် ကောင်း\n * ထို့ကြောင့်\nစာ ထို့အပြင်"],
    "id": ["", "Penting untuk dicatat dan perlu diakui bahwa tidak dapat dipungkiri bahwa benar.", "Kesimpulannya, baik.\n- Secara keseluruhan baik\nItu. Ringkasnya, baik; kesimpulannya baik", "Selain itu, baik.\n+ Di sisi lain, buruk\nSelain itu baik", "Cuaca cerah."],
    "ja": ["", "- ✅ 完了\n1. 🚀 開始\n✅ 単独", "- **名前**: 説明\n* **名前** — 説明\n- **名前**説明", "🎯 **速い** と ✅**強い**", "**注意** と **例：あれ** と **他**", "## 見出し **太字** です\n# __下線__\n## 普通", "完全に完全に最高の究極の", "驚異的な可能性を解き放つ。根本的に変革し、不可避の", "天気がいい。"],
    "vi": ["", "Sản phẩm vượt trội và tuyệt vời, Vượt Trội.", "Việc này tốt\ncó Việc này", "Hơn nữa, tốt.\nBên cạnh đó, tốt\nTóm lại, tốt. Kết luận lại, tốt", "Không chỉ đẹp mà còn tốt. Đóng vai trò quan trọng", "Hy vọng bài viết này hữu ích cho bạn. Cảm ơn bạn đã đọc", "Trong kỷ nguyên số, một cách hiệu quả"],
    "ru": [
        "",
        "Что делал. " + "Потом он долго рассказывал о работе, о людях и о том, как всё это вместе складывалось в одну длинную историю без конца.",
        "Методика. " + "Потом он долго рассказывал о работе, о людях и о том, как всё это вместе складывалось в одну длинную историю без конца.",
        "Вот что было.\n\n" + "Потом он долго рассказывал о работе, о людях и о том, как всё это вместе складывалось в одну длинную историю без конца.",
        "Вот что было.\n\n- пункт\n\n" + "Потом он долго рассказывал о работе, о людях и о том, как всё это вместе складывалось в одну длинную историю без конца.",
        "Один — два — три — четыре.\nПять.",
        "— Один — два — три\n— четыре — пять — шесть — семь",
        "План → аппрув → внесение.\nОт N5 → N1 и 30→50.\nA1→A2→B, но (N5) → N1",
        "Стало в 2.5 раза и т. д. лучше, а г. Москва. " + "Потом он долго рассказывал о работе, о людях и о том, как всё это вместе складывалось в одну длинную историю.",
        "```\nкод → код — — —\n```\n    отступ → тут\n| таблица → тут |\n# Заголовок → тут\n1. пункт → тут\n***\n===\nпроза → тут",
        "Коротко и ясно! " + "Потом он долго рассказывал о работе, о людях и о том, как всё это вместе складывалось в одну историю." + "\nИ ещё строка с тире — раз — два — три.",
    ],
    "lang": [
        "",
        "안녕하세요 여러분 오늘은 날씨가 좋습니다. ",
        "Привет всем, сегодня хорошая погода и мы идём гулять в большой парк у реки. ",
        "これはとてもいい天気ですね、みなさん。 ",
        "สวัสดีครับ วันนี้อากาศดีมาก ",
        "မင်္ဂလာပါ ဒီနေ့ ရာသီဥတု ကောင်းပါတယ် ",
        "Việt Nam là một đất nước rất đẹp và những người ở đó đều thân thiện với mọi người đến thăm. ",
        "¿Qué tal? ¡Hola! El niño pequeño sueña con el año que viene: ¿mañana? ¡Ñandú! ",
        "yang dan di ke dari ini itu dengan untuk pada tidak adalah sebagai juga akan bisa ada dalam atau oleh " * 3,
        "que los las del una para pero muy como entre sobre ya ser sin sus este esta eso esa esos esas " * 3,
        "não ção uma então mesmo após ã õ ç the and of to in is that it with for ",
        "Привет 안녕하세요 안녕하세요 안녕하세요 hello ",
    ],
    "metrics": [
        "",
        "Delve into the tapestry. It's worth noting that this realm is seamless. In conclusion, it is crucial and pivotal. Moreover, we leverage robust interplay.",
        "One two three. One two three. One two three. One two three. One two three.",
        "Don't stop! Why? 3.14 is pi. Yes... no",
        "The queens loved fire and baked goods; they yearned, ages ago.",
    ],
}

#: Fronts that settle the language, each with the rule seeds of that language, for the full audit.
_FRONTS = {"ko": SEEDS["lang"][1], "ru": SEEDS["lang"][2], "ja": SEEDS["lang"][3], "th": SEEDS["lang"][4], "my": SEEDS["lang"][5], "vi": SEEDS["lang"][6] * 5, "es": SEEDS["lang"][7], "id": SEEDS["lang"][8]}
SEEDS["audit"] = [f"{SEEDS['lang'][0]}{block}\n\n" for block in SEEDS["en"] + SEEDS["placeholder"]]
for _lang, _front in _FRONTS.items():
    _blocks = SEEDS.get(_lang, []) + [b for b in SEEDS["phrases"] if b]
    SEEDS["audit"] += [f"{_front}\n\n{block}\n\n" for block in _blocks]
