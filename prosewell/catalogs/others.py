"""Rule catalogs of Spanish, Thai, Burmese, Indonesian and Japanese. Fixed values, in their natural order."""

# Name, category, weight, pattern (Python-style inline flags).
SPANISH = [
    ('pomposity_frame', 'pomposity_frame', 5, '(?i)\\b(?:es importante (?:destacar|señalar|mencionar|recordar|tener en cuenta)|cabe (?:destacar|mencionar|señalar|recordar|preguntarse)|vale la pena (?:señalar|destacar|mencionar)|es fundamental (?:que|entender|comprender|recordar)|es evidente que|permíteme explicarte|no cabe duda de que)\\b'),
    ('conclusion_announcer', 'conclusion_announcer', 5, '(?mi)^[\\t ]*(?:[-*+])?[\\t ]*(?:en conclusión|en resumen|para concluir|en síntesis|para terminar|en definitiva)\\b'),
    ('paragraph_connector', 'paragraph_connector', 3, '(?mi)^[\\t ]*(?:[-*+])?[\\t ]*(?:además|por otro lado|sin embargo|no obstante|asimismo|por lo tanto|en consecuencia|en primer lugar|en segundo lugar|por supuesto)[,;]'),
    ('conclusion_announcer_mid', 'conclusion_announcer', 4, '(?i)(?<=[.;:])[ \\t]+(?:en conclusión|en resumen|para concluir|en síntesis|para terminar|en definitiva)\\b'),
]

THAI = [
    ('pomposity_frame', 'th:pomposity_frame', 5, 'เป็นที่ทราบกันดีว่า|เป็นที่น่าสังเกตว่า|สิ่งสำคัญคือ|ไม่ต้องสงสัยเลยว่า'),
    ('conclusion_announcer', 'th:conclusion_announcer', 5, '(?m)^[\\t ]*(?:[-*+])?[\\t ]*(?:โดยสรุป|สรุปได้ว่า|โดยรวมแล้ว|กล่าวโดยสรุปว่า)'),
    ('paragraph_connector', 'th:paragraph_connector', 3, '(?m)^[\\t ]*(?:[-*+])?[\\t ]*(?:นอกจากนี้|อีกทั้ง|ดังนั้น|ในขณะเดียวกัน|ในอีกด้านหนึ่ง|อย่างไรก็ตาม)'),
]

BURMESE = [
    ('pomposity_frame', 'my:pomposity_frame', 5, 'အရေးကြီးသောအချက်မှာ'),
    ('conclusion_announcer', 'my:conclusion_announcer', 5, '(?m)^[\\t ]*(?:[-*+])?[\\t ]*(?:အနှစ်ချုပ်အနေနှင့်|နိဂုံးချုပ်အားဖြင့်|အနှစ်ချုပ်ရလျှင်)'),
    ('paragraph_connector', 'my:paragraph_connector', 3, '(?m)^[\\t ]*(?:[-*+])?[\\t ]*(?:ထို့အပြင်|ထို့ကြောင့်|အခြားတစ်ဖက်တွင်)'),
]

INDONESIAN = [
    ('pomposity_frame', 'id:pomposity_frame', 5, '(?i)\\b(?:penting untuk (?:dicatat|diingat)|perlu (?:diperhatikan|diakui|dicatat) bahwa|tidak dapat dipungkiri bahwa)\\b'),
    ('conclusion_announcer', 'id:conclusion_announcer', 5, '(?mi)^[\\t ]*(?:[-*+])?[\\t ]*(?:kesimpulannya|dapat disimpulkan bahwa|secara keseluruhan|ringkasnya)\\b'),
    ('paragraph_connector', 'id:paragraph_connector', 3, '(?mi)^[\\t ]*(?:[-*+])?[\\t ]*(?:selain itu|di sisi lain|oleh karena itu|sebagai tambahan|lebih lanjut|namun demikian|dengan demikian),'),
    ('conclusion_announcer_mid', 'id:conclusion_announcer', 4, '(?i)(?<=[.;:])[ \\t]+(?:kesimpulannya|dapat disimpulkan bahwa|secara keseluruhan|ringkasnya)\\b'),
]

# Id, severity, patterns, phrases.
JAPANESE = [
    ('JA-AI-L01', 'warn', ['^[\\s]*(?:[-*+]|\\d+[.)])\\s+.*?(✅|❌|⭐|✨|💯|⚠️|❗|❓|💥|🔥|⚡|💪|🚀|💡|🤔|💭|🧠|🎯|📈|📊|🏆|👍|👎|😊|😎|🎉|🌟|📝|📋|✏️|🖊️|💼)'], []),
    ('JA-AI-L02', 'warn', ['^[\\s]*(?:[-*+]|\\d+[.)])\\s+\\*\\*([^*]+)\\*\\*(?:\\s*[:：]|\\s+[-—–](?=\\s))'], []),
    ('JA-AI-E01', 'warn', ['(ℹ️|🔍|✅|❌|⚠️|💡|📝|📋|📌|🔗|🎯|🚀|⭐|✨|💯|🔥|📊|📈)\\s*\\*\\*([^*]+)\\*\\*'], []),
    ('JA-AI-E02', 'warn', ['\\*\\*(検出される例|推奨される表現|設定例|使用例|良い例|悪い例|サンプル|おすすめ|ポイント|チェック|確認|補足|参考|メモ|注意|重要|推奨|例)(?:[：:][^*]*)?\\*\\*'], []),
    ('JA-AI-E03', 'warn', ['^#{1,6}\\s+.*(?:\\*\\*|__)(.+?)(?:\\*\\*|__)'], []),
    ('JA-AI-H01', 'info', [], ['究極の', '完全に', '完璧な', '最高の', '最先端の', '大幅に']),
    ('JA-AI-H02', 'high', [], ['驚異的な', '可能性を解き放つ', '潜在能力を引き出す', '民主化する', 'スーパーチャージ', '驚嘆させ']),
    ('JA-AI-H03', 'high', [], ['不可避の', '新たな基準を設定', 'フロンティアを開拓', '根本的に変革']),
]
