"""Language detection: aliases, character classes, word lists and thresholds."""

# Languages in their order, and the path segments that name them.
LANGS = ["en", "ru", "ko", "vi", "ja", "es", "th", "my", "id"]
ALIASES = {"ru": "ru", "russian": "ru", "ko": "ko", "kor": "ko", "korean": "ko", "vi": "vi", "vie": "vi", "vietnamese": "vi", "ja": "ja", "jpn": "ja", "japanese": "ja", "jp": "ja", "es": "es", "spa": "es", "spanish": "es", "espanol": "es", "th": "th", "tha": "th", "thai": "th", "bur": "my", "mya": "my", "myanmar": "my", "burmese": "my", "ind": "id", "indonesian": "id", "bahasa": "id", "indo": "id", "en": "en", "eng": "en"}
# The sample's length, and character classes counted in it.
SAMPLE = 4000
SCRIPTS = {"hangul": "가-힯", "cyrillic": "Ѐ-ӿ", "kana": "぀-ヿ", "thai": "฀-๿", "myanmar": "က-႟", "vi_marks": "Ạ-ỹăâêôơưđĂÂÊÔƠƯĐ", "vi_letters": "ăâêôơưđĂÂÊÔƠƯĐ", "latin": "a-zA-Z", "es_strong": "ñ¿¡"}
# Function words and the letters of a word around them.
WORDS = {
    "es_stop": ("a-záéíóúñü", ["que", "los", "las", "del", "una", "para", "más", "pero", "muy", "también", "está", "cuando", "porque", "como", "además", "según", "entre", "sobre", "ya", "ser", "sin", "sus", "este", "esta", "eso", "esa", "esos", "esas"]),
    "pt": ("a-zàáâãçéêíóôõú", ["não", "ção", "ções", "uma", "então", "mesmo", "após", "ã", "õ", "ç"]),
    "en": ("a-z", ["the", "and", "of", "to", "in", "is", "that", "it", "with", "for"]),
    "id_stop": ("a-z", ["yang", "dan", "di", "ke", "dari", "ini", "itu", "dengan", "untuk", "pada", "tidak", "adalah", "sebagai", "juga", "akan", "bisa", "ada", "dalam", "atau", "oleh"]),
}
# From this many marks on, a language is certain.
CERTAIN = 50
