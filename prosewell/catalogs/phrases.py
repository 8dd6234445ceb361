"""Phrase dictionaries by language.

The dictionaries of general clichés, bureaucratic phrases and connectors and the Vietnamese rule catalog
are not published with the rules they belong to; SEED_* are small seeds of our own with the same shape.
"""

# clichés.
CLICHES = {
    "en": [],
    "ru": [],
    "es": ["en el mundo de", "en la era digital", "juega un papel crucial", "juega un papel fundamental", "juega un papel importante", "desempeña un papel crucial", "desempeña un papel fundamental", "desbloquear el potencial", "en constante evolución", "el panorama de", "sumergirse en", "navegar por las complejidades"],
    "th": ["ในยุคดิจิทัล", "เป็นเครื่องพิสูจน์ว่า", "มีบทบาทสำคัญ", "ปลดล็อกศักยภาพ", "ปฏิวัติวงการ", "เปลี่ยนโลก", "พลิกโฉมวงการ", "ก้าวกระโดดครั้งใหญ่"],
    "my": ["ဒစ်ဂျစ်တယ်ခေတ်", "အရေးပါသောအခန်းကဏ္ဍ"],
    "id": ["di era digital", "memainkan peran penting", "memainkan peran kunci", "membuka potensi", "tak terbantahkan", "mengubah lanskap", "terus berevolusi", "menyelami dunia"],
    "ko": ["결론적으로", "시사하는 바가", "주목할 만하", "주목할 점은", "혁신적", "획기적", "압도적", "전례 없", "정리하자면", "되어진다", "에 의해", "에 있어서", "첫째", "둘째", "셋째", "필요한 것은", "중요한 것은"],
    "vi": ["trong thời đại số", "trong bối cảnh", "đóng vai trò then chốt", "không chỉ", "tóm lại", "kết luận là", "hơn nữa", "thêm vào đó", "bên cạnh đó", "đột phá", "vượt trội", "tuyệt vời", "khai mở tiềm năng"],
    "ja": ["革命的", "画期的", "圧倒的に", "劇的に", "完全ガイド", "ゲームチェンジャー", "パラダイムシフト", "世界初", "次世代の", "魔法のように", "奇跡的な", "業界を再定義", "未来を変える", "と言っても過言ではない", "に他ならない", "いかがでしたでしょうか", "お役に立てれば幸い", "本記事では", "ご紹介し", "結論から言うと"],
}
# Weak phrases, which count from their second occurrence.
WEAK = {
    "ja": ["することが可能", "する必要があります", "と言えるでしょう", "ではないでしょうか", "浮き彫り", "これにより", "幸いです", "以下で解説", "一概には言えません", "ケースバイケース", "掘り下げ", "多角的", "まず最初に", "活用する"],
    "es": ["transformar", "fomentar", "explorar", "implementación", "metodología", "optimizar", "facilitar", "aprovechar", "integral", "invaluable", "requerimiento", "utilización", "cautivar", "hoy en día", "profundizar en"],
    "th": ["ยกระดับ", "ขับเคลื่อน", "เหนือชั้น", "อย่างแพร่หลาย"],
    "my": [],
    "id": ["mengoptimalkan", "memfasilitasi", "implementasi", "metodologi", "revolusioner", "memanfaatkan", "transformasi", "integral", "pada akhirnya"],
}
# Seeds of our own: general clichés and weak phrases.
SEED_CLICHES = {
    "en": ["in conclusion", "in today's fast-paced world", "at the end of the day", "it goes without saying"],
    "ru": ["важно отметить", "в современном мире", "не секрет, что", "подводя итог"],
    "ko": ["현대 사회에서", "마무리하며"],
    "vi": ["trong thế giới ngày nay", "nói tóm lại"],
}
SEED_WEAK = {
    "en": ["furthermore", "in order to", "with regard to", "moreover"],
    "ru": ["является", "в рамках", "таким образом", "кроме того"],
    "ko": ["또한", "따라서", "그러므로"],
    "vi": ["ngoài ra", "do đó"],
}
# Seed of our own: Vietnamese rules (id, severity, patterns, phrases).
VIETNAMESE = [
    ("VI-HUM-L01", "medium", [], ["trong thời đại công nghệ 4.0", "trong kỷ nguyên số"]),
    ("VI-HUM-L02", "medium", [r"(?i)đóng (?:một )?vai trò (?:quan trọng|then chốt)"], []),
    ("VI-HUM-L03", "high", [r"(?i)vượt trội|tuyệt vời"], []),
    ("VI-HUM-L04", "medium", [r"(?i)không chỉ [^.]{1,40} mà còn"], []),
    ("VI-HUM-S01", "medium", [r"(?m)^Việc "], []),
    ("VI-HUM-S02", "low", [r"(?m)^(?:Hơn nữa|Ngoài ra|Bên cạnh đó),"], []),
    ("VI-HUM-S03", "low", [r"(?i)một cách (?:hiệu quả|toàn diện)"], []),
    ("VI-HUM-D01", "medium", [], ["tóm lại,", "kết luận lại,"]),
    ("VI-HUM-D02", "high", [], ["hy vọng bài viết này hữu ích", "cảm ơn bạn đã đọc"]),
]
