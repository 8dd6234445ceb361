"""Triage: category sets, prefixes, gate and built-in suppression rules."""

# Categories of priority P1.
P1 = ["tier1", "tier1-clarity", "em-dash", "bullet-np-list", "performed-insight", "hollow-intensifier", "low-ttr", "cross-para-burstiness", "formatting", "dev-blog-boilerplate", "ai-placeholder", "zero-slop-hit", "humanizer-score", "ko:risk_band", "p0-placeholder", "ja:forbidden_phrase", "ja:antithesis_repetition", "ja:boilerplate_heading", "ja:double_negative", "es:pomposity_frame", "es:conclusion_announcer", "th:pomposity_frame", "th:conclusion_announcer", "my:pomposity_frame", "my:conclusion_announcer", "id:pomposity_frame", "id:conclusion_announcer"]
# Prefixes of priority P1.
P1_PREFIXES = ["ru:", "VI-HUM", "zs:"]
# Categories of priority P2.
P2 = ["linkedin", "triads", "rhythm", "scaffolding", "ru:dash-density", "ja:low_burstiness", "ja:low_sentence_variance", "ja:uniform_paragraph_structure", "ja:high_length_autocorrelation", "ja:nominal_ending", "ja:translationese", "ja:translationese_morph", "ja:english_syntax_cleft_because", "ja:english_syntax_inanimate_subject", "ja:inanimate_subject_morph", "ja:repeated_sentence_lead", "ja:repeated_syntax_template", "ja:paragraph_lead_conjunction", "ja:low_lexical_diversity_mtld", "ja:low_lexical_diversity_ttr", "ja:low_specificity", "ja:sentence_too_long", "ja:kanji_run", "ja:no_chain", "ja:numbered_phase_structure", "ja:buried_list", "ja:high_bold_density", "ja:high_bullet_ratio", "ja:high_emoji_symbol_density", "JA-AI-L01", "JA-AI-L02", "JA-AI-E01", "JA-AI-E02", "JA-AI-E03", "JA-AI-H01", "es:paragraph_connector", "es:triads", "es:mente_adverb_chain", "es:poder_infinitivo", "es:em_dash_inciso", "th:paragraph_connector", "my:paragraph_connector", "id:paragraph_connector"]
# Findings a file may have from the gated tool before they all count.
GATED_TOOL, GATE = "avoid-ai-writing", 6
# Built-in suppression rules, in order.
SUPPRESS = [
    {"file": "**/*.md", "category": "em-dash", "quoteContains": "meta_title", "reason": "SEO title convention (Brand — Descriptor), series-approved"},
    {"category": "em-dash", "quoteContains": "–", "reason": "en-dash numeric range, typographic norm"},
    {"category": "formatting", "quoteContains": "Remember", "reason": "UI button name, not emphasis"},
    {"category": "formatting", "quoteContains": "Know", "reason": "UI button name, not emphasis"},
    {"category": "ai-placeholder", "quoteContains": "disable-file", "reason": "markdownlint HTML comment, not rendered"},
    {"tool": "zero-slop", "quoteContains": "🇬🇧", "reason": "language-switcher flag emoji (series README case, evidence low)"},
    {"category": "ru:Длинное тире", "reason": "Long dash is standard Russian punctuation (series-approved)"},
    {"category": "ru:Короткое тире", "reason": "Short dash / en-dash ranges are typographic norm"},
]
# Placeholder patterns (pattern, without regard to case).
PLACEHOLDERS = [(r"\[your [a-z ]{2,30}\]", True), (r"\[insertar [a-záéíóúñü ]{2,40}\]", True), (r"\bINSERT [A-Z][A-Z ]{2,30}\b", False), (r"\bLorem ipsum\b", True)]
