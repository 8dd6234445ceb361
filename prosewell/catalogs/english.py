"""English rule catalog. Fixed values, in their natural order: name, category, weight, pattern. MIT notice: NOTICE.md."""

# Rules (a pattern is always matched without regard to case, first match per line).
RULES = [
    ('hedge-stem', 'hedging', 4, "\\bit(?:(?:'|’)s| is| has) (?:worth noting|worth mentioning|important to (?:note|remember|understand)|crucial to)\\b|\\bit should be noted\\b|\\bit bears mentioning\\b"),
    ('hedge-stack', 'hedging', 3, '\\b(?:might|may|could)\\s+(?:possibly|potentially|perhaps)\\b'),
    ('arguably', 'hedging', 2, '\\barguably\\b'),
    ('that-said', 'hedging', 1.5, '(?:^|\\. )That said,'),
    ('listicle-stem', 'scaffolding', 4, '\\b(?:there are (?:several|a few|many|numerous) (?:key |important )?(?:factors|things|ways|reasons|considerations|lessons|takeaways)|here are (?:a few|some|three|five|\\d+))\\b'),
    ('signpost-transition', 'scaffolding', 2.5, '(?:^|\\. )(?:Moreover|Furthermore|Additionally|In addition),'),
    ('conclusion-scaffold', 'scaffolding', 4, '\\b(?:in conclusion|in summary|to sum up|ultimately, |overall, |the key takeaway|at the end of the day|all in all|when all is said and done)\\b'),
    ('meta-commentary', 'scaffolding', 4, "\\b(?:let me (?:walk you through|break (?:this|it) down|explain|paint (?:you )?a picture)|in this (?:article|post|piece), (?:we|i)(?:'ll| will)|let(?:(?:'|’)s| us) (?:dive|unpack|explore|take a closer look|break (?:it|this) down))\\b"),
    ('whether-youre', 'scaffolding', 3, "\\bwhether you(?:(?:'|’)re| are) (?:a|an|at|just|new)\\b"),
    ('lesson-n-stem', 'scaffolding', 3, '(?:^|\\n)[ \\t]*(?:lesson|takeaway|tip|step|mistake) #?\\d+[:.]'),
    ('walk-away-with', 'marketing', 4, '\\b(?:walk away with|actionable (?:insights|takeaways|tips)|practical (?:tips|techniques|takeaways|strategies) you can (?:apply|use))\\b'),
    ('so-you-dont-have-to', 'marketing', 4, "\\bso you do(?:n(?:'|’)t| not) have to\\b|\\bfind out the hard way\\b|\\bskip (?:that|the) (?:part|pain|struggle)\\b"),
    ('spirit-of-transparency', 'puffery', 3.5, '\\bin the spirit of (?:transparency|openness)\\b|\\ba significant portion of\\b|\\bthe short version is\\b|\\bfull transparency[,:]'),
    ('emotional-labor', 'linkedin', 4.5, "\\b(?:hardest (?:decision|thing) (?:of|i)|poured (?:everything|our hearts?)|i owe it to|writing this (?:post|is)n?(?:'|’)?t? ?(?:is )?(?:painful|hard)|with a heavy heart)\\b"),
    ('aphorism-formula', 'drama', 5, "\\b\\w+ is(?:n(?:'|’)t| not) the opposite of \\w+\\b|\\bis(?:n(?:'|’)t| not) (?:a|the) (?:destination|sprint)[,.;] (?:it|but)\\b|\\bit(?:(?:'|’)s| is| has) a marathon\\b"),
    ('not-x-but-y', 'contrast', 4, "\\b(?:is|are|was|were)(?:n(?:'|’)t| not) just (?:about )?\\w[\\w '’-]{0,40}[.,;:\\u2014\\u2013-]+\\s*(?:it|they|he|she|we)(?:(?:'|’)s|(?:'|’)re| is| are| was| were)\\b|\\bnot (?:just|only|merely) [\\w '’-]{2,40}[,;:\\u2014\\u2013-]+\\s*but\\b"),
    ('its-not-its', 'contrast', 4.5, "\\b(?:it|this|that)(?:(?:'|’)s| is| was)(?: really| actually)? not (?:just )?(?:about )?[\\w '’-]{2,40}[.,;:\\u2014\\u2013-]+\\s*(?:it|this|that)(?:(?:'|’)s| is| was)\\b"),
    ('question-isnt', 'contrast', 3.5, "\\bthe (?:real |hard |big |key )?(?:question|answer|problem|issue|point|goal|key|secret|difference|challenge|trick|magic|lesson|story|irony|hard part|best part) (?:is|was)(?:n(?:'|’)t| not)\\b"),
    ('negative-listing', 'contrast', 4, "\\bnot (?:a|an|the) [\\w '’-]{2,30}\\. not (?:a|an|the) \\b"),
    ('staged-negative-ladder', 'contrast', 5, "(?:^|[.!?]\\s+|\\n)[–—*+•-]*\\s*not in (?:an? |the )?[\\w '’-]{2,32}\\.\\s*(?:[–—*+•-]+\\s*)?not in (?:an? |the )?[\\w '’-]{2,32}\\.\\s*(?:[–—*+•-]+\\s*)?but in (?:an? |the )?[\\w '’-]{2,48}"),
    ('this-isnt-about', 'contrast', 3.5, "\\bthis (?:is|was)(?:n(?:'|’)t| not) (?:just )?about\\b"),
    ('puffery-testament', 'puffery', 5, '\\b(?:stands? as a testament|serves? as a (?:testament|reminder)|is a testament to|marks? a pivotal|pivotal moment|plays? a (?:vital|crucial|key|significant|critical|central) role|solidif(?:y|ies) (?:its|their)|underscor(?:es|ing) (?:its|the)|cements? (?:its|their) (?:position|place|status))\\b'),
    ('rich-tapestry', 'puffery', 4, '\\b(?:rich (?:tapestry|history|heritage)|vibrant (?:community|ecosystem|culture)|nestled (?:in|among|between)|breathtaking|must-(?:visit|see))\\b|\\b(?:stunning )?natural beauty\\b'),
    ('superficial-ing', 'puffery', 4, ', (?:highlighting|underscoring|showcasing|reflecting|demonstrating|signaling|cementing|reinforcing|ensuring|solidifying|marking|positioning) (?:the|its|their|a|how)\\b'),
    ('weasel-attribution', 'puffery', 4, '\\b(?:experts (?:agree|say|believe)|industry (?:reports|leaders) (?:suggest|agree)|studies (?:show|suggest)|many argue|widely (?:regarded|considered|seen) as|some critics argue|observers have (?:cited|noted)|research shows)\\b'),
    ('marketing-register', 'marketing', 4, '\\b(?:game.?chang(?:er|ing)|paradigm shift|cutting.?edge|state-of-the-art|best-in-class|world-class|next-level|seamless(?:ly)?|frictionless|turnkey|synergy|supercharge|revolutioniz\\w+|transformative|disruptive innovation)\\b'),
    ('this-changes', 'marketing', 5, '\\bthis (?:changes everything|is huge|is a big deal)\\b'),
    ('unlock-potential', 'marketing', 4.5, '\\b(?:unlock(?:ing)? (?:the |your |new )?(?:full |true )?(?:potential|power|value|opportunities)|take .{0,25}to the next level|empower(?:s|ing)? (?:teams?|users?|people|you)\\b)'),
    ('future-is', 'marketing', 4.5, "\\bthe future (?:of \\w+ )?is (?:here|now|bright)\\b|\\bwe(?:(?:'|’)re| are) just getting started\\b|\\bfuture you will thank you\\b|\\bstay tuned\\b"),
    ('announce-excited', 'linkedin', 5, "\\b(?:(?:i(?:'|’)m|i am) |we(?:(?:'|’)re| are) )?(?:beyond |incredibly |truly |so )?(?:excited|thrilled|humbled|honored|proud|delighted) (?:to|and)\\b"),
    ('engagement-bait', 'linkedin', 4.5, '\\b(?:agree\\?|thoughts\\?|what(?:(?:\'|’)s| is) your (?:take|experience)|drop a comment|let me know in the comments|share this with|share if you|tag someone|repost if|follow (?:me|for more)|sound off in|save this post|bookmark this|link in (?:bio|the )?(?:first )?comments?|dm me\\b|comment ["“\']?\\w{1,15}["”\']? (?:below )?and i(?:\'|’)ll|my dms are (?:always )?open|what about you\\?)\\b'),
    ('emoji-arrow-bullet', 'linkedin', 2.5, '(?:^|\\n)[ \\t]*(?:👉|✅|🔹|➡️|✨|🚀|💡|🔥|→)\\s'),
    ('hashtag-cluster', 'linkedin', 4, '(?:#\\w+\\s*){3,}'),
    ('journey-gratitude', 'linkedin', 3, "\\b(?:this journey|the journey (?:so far|ahead)|grateful (?:for|to)|could(?:n(?:'|’)t| not) have done it without|huge (?:thanks|shout.?out)|humbled and)\\b"),
    ('lessons-learned-stem', 'linkedin', 3.5, "\\b(?:here(?:(?:'|’)s| is| has) what (?:it|that) taught me|\\d+ (?:key )?(?:lessons|takeaways|things) (?:i(?:'|’ve)? learned|from))\\b"),
    ('colon-reveal', 'drama', 4, '(?:^|\\. )The (?:best|craziest|wildest|most \\w+) part\\??[:.]'),
    ('emphasis-crutch', 'drama', 4, '\\b(?:make no mistake|make it count|and (?:honestly|frankly)\\?|the result\\?|the outcome\\?|spoiler(?: alert)?:)|(?:^|\\. |\\n)Honestly\\? '),
    ('transformation-chain', 'drama', 5, '\\b(\\w+) becomes (\\w+)\\. \\2 becomes\\b'),
    ('corrective-reveal', 'drama', 5, "\\byou(?:'|’)ve been told\\b|\\bhere(?:(?:'|’)s| is| has) the truth:"),
    ('copula-boast', 'verbs', 4, '\\b(?:boasts?|boasting) (?:a|an|the|over|more)\\b'),
    ('serves-as-hub', 'verbs', 4, '\\bserves? as a (?:centralized |central )?(?:hub|platform|solution|gateway)\\b'),
    ('weak-verb-phrase', 'verbs', 2.5, '\\b(?:has the ability to|is able to|in order to|made the decision to|conduct(?:ed)? an analysis|has the potential to)\\b'),
    ('filler-intensifier', 'filler', 2, '\\b(?:truly|genuinely|incredibly|remarkably|undoubtedly|undeniably|absolutely essential|significantly enhanc\\w+)\\b'),
    ('vague-quantifier', 'filler', 3, '\\b(?:a (?:wide|vast|diverse) (?:variety|range|array) of|countless|myriad|a plethora of|numerous)\\b'),
    ('deep-dive', 'filler', 3, '\\b(?:deep dive|dive (?:deep(?:er)? )?into|double.?click on)\\b'),
    ('isnt-about-its-about', 'contrast', 5, "\\b(?:is|are|was|were)(?:n(?:'|’)t| not) (?:just |really |only )?about [\\w '’-]{2,40}[.,;:\\u2014\\u2013-]+\\s*(?:it|this|that|they)(?:(?:(?:'|’))s|(?:(?:'|’))re| is| are| was| were)(?: about)?\\b"),
    ('never-about', 'contrast', 3.5, "\\b(?:was|is|are|has(?: been)?|have(?: been)?) never (?:been )?about\\b|\\bit(?:'|’)s never been about\\b"),
    ('didnt-just', 'contrast', 3.5, "\\b(?:did|does|do)(?:n(?:'|’)t| not) just [\\w '’-]{2,40}[.,;:\\u2014\\u2013-]+\\s*(?:we|they|it|he|she|i|you) \\w+"),
    ('less-about-more-about', 'contrast', 5, "\\bless about [\\w '’-]{2,40}(?:[.,;:\\u2014\\u2013-]+|\\s+and)\\s*more about\\b"),
    ('less-like-more-like', 'contrast', 4, "\\b(?:feel(?:s|ing)?|seem(?:s|ing)?) less like (?:an? |the )?[\\w '’-]{2,48}(?:,| and)? (?:an? )?(?:little )?more like (?:an? |the )?[\\w '’-]{2,48}"),
    ('thats-not-thats', 'contrast', 3.5, "\\bthat(?:(?:(?:'|’))s| is) not [\\w '’-]{2,30}[.,;:\\u2014\\u2013-]+\\s*that(?:(?:(?:'|’))s| is)\\b"),
    ('isocolon-ditransitive', 'contrast', 4.5, '\\b(let|give|hand|show|tell|offer|teach|buy|cost|earn|save|bring|send|win)s? you\\b[^.!?]{0,70}[.!?]\\s+[^.!?]{0,70}\\b\\1s? you\\b'),
    ('this-is-what-looks-like', 'contrast', 4, "(?:^|[.!?]\\s+|\\n)(?:this|that) is what [\\w '’-]{2,40} looks like\\b"),
    ('no-x-had-to', 'contrast', 4, "(?:^|[.!?]\\s+|\\n)No [\\w '’-]{2,40} (?:had to|needed to|has to|ever) [\\w '’-]{2,60}\\.\\s+[\\w '’-]{2,40} (?:did|made|chose|decided|built|released|shipped|published)\\b"),
    ('not-the-but-the', 'contrast', 3, "\\bnot the [\\w '’-]{2,30}[,;] but the\\b"),
    ('not-because-but-because', 'contrast', 3, "\\bnot because [\\w '’-]{2,40}[,;] but because\\b"),
    ('more-than-just', 'contrast', 3, "\\b(?:is|are|was|were|it(?:'|’)s|they(?:'|’)re) (?:so much )?more than just\\b"),
    ('ai-wont-replace', 'contrast', 4.5, "\\bwon(?:'|’)t (?:replace|take) your jobs?\\b|\\bwon(?:'|’)t replace \\w+[.,;] (?:but )?(?:a |an |the |someone |people |those )?[\\w ]{0,30}(?:using|who use)\\b"),
    ('stop-start', 'contrast', 4.5, "(?:^|[.!?]\\s+|\\n)Stop [\\w '’,-]{2,40}\\. Start [a-z]"),
    ('x-is-dead-long-live', 'contrast', 4.5, '\\bis dead[.,;] long live\\b'),
    ('do-this-instead', 'contrast', 3.5, '\\b(?:do|try|read|use) this instead\\b|\\bwhat to do instead\\b'),
    ('raise-your-hand', 'linkedin', 4.5, '\\braise your hand if\\b'),
    ('thats-when-it-hit', 'drama', 4.5, "\\b(?:that(?:'|’)s when|then) it hit me\\b|\\bit hit me[:.,]"),
    ('little-did-i-know', 'drama', 4.5, '\\blittle did (?:i|we|they|he|she) know\\b'),
    ('changed-everything', 'drama', 3.5, '\\b(?:changed|changes) everything\\b'),
    ('rest-is-history', 'drama', 4, '\\bthe rest(?:, as they say,)? is history\\b'),
    ('fast-forward', 'drama', 3, '\\bfast.?forward (?:to|a few|six|two|three|four|five|ten|\\d+)\\b'),
    ('one-thing-is-certain', 'drama', 4, "\\bone thing(?:(?:(?:'|’))s| is) (?:certain|clear|for sure)\\b|\\bif there(?:(?:(?:'|’))s| is) one thing\\b"),
    ('cannot-be-overstated', 'drama', 4.5, "\\bcan(?:not|(?:'|’)t) be overstated\\b|\\bcan(?:not|(?:'|’)t) stress (?:this|it) enough\\b"),
    ('wait-for-it', 'drama', 4, '\\bwait for it\\b'),
    ('further-from-truth', 'drama', 4.5, "\\bcould(?:n(?:'|’)t)? (?:not )?be further from the truth\\b"),
    ('understatement-formula', 'drama', 4, '\\bwould be (?:an|the) understatement\\b|\\bis (?:an|the) understatement of\\b'),
    ('full-stop-period', 'drama', 3.5, '(?:^|\\. |\\n)(?:Full stop|Period|End of story|Enough said)\\.'),
    ('results-speak', 'drama', 3.5, "\\bspeaks? for (?:itself|themselves)\\b|\\bnumbers (?:do(?:n(?:'|’)t| not)|never) lie\\b"),
    ('only-time-will-tell', 'drama', 3.5, '\\bonly time will tell\\b|\\btime will tell\\b|\\bremains to be seen\\b|\\bthe jury is (?:still )?out\\b'),
    ('possibilities-endless', 'marketing', 5, '\\bthe possibilities are (?:endless|limitless)\\b|\\bendless possibilities\\b|\\bimplications are (?:far-reaching|profound|enormous)\\b'),
    ('exciting-times', 'marketing', 4.5, '\\bexciting times (?:ahead|for)\\b|\\bwatch this space\\b'),
    ('level-up-your', 'marketing', 3.5, '\\blevel(?:ing)? up your\\b'),
    ('represents-significant', 'puffery', 4, '\\b(?:represents?|marks?) a (?:significant|major|fundamental|profound) (?:shift|milestone|step|change|leap)\\b'),
    ('lasting-legacy', 'puffery', 4, '\\b(?:lasting|enduring) (?:legacy|impact|impression)\\b|\\bleaves? a lasting\\b|\\bindelible mark\\b'),
    ('deeply-rooted', 'puffery', 3.5, '\\bdeeply rooted\\b|\\brich cultural heritage\\b|\\bcontinues? to (?:inspire|thrive|resonate)\\b'),
    ('in-the-heart-of', 'puffery', 2.5, '\\bin the heart of\\b'),
    ('treasure-trove', 'puffery', 3.5, '\\btreasure trove\\b|\\ba wealth of (?:knowledge|information|experience|insights)\\b'),
    ('other-plans', 'drama', 4.5, '\\b(?:life|fate|the universe) had other plans\\b'),
    ('shaping-the-future', 'marketing', 4, '\\bshap(?:e|es|ing) the future of\\b'),
    ('whats-possible', 'marketing', 4, "\\b(?:redefin|reimagin)\\w+ what(?:'|’)s possible\\b|\\bpush(?:es|ing)? the (?:boundaries|limits|envelope)\\b"),
    ('harness-the-power', 'marketing', 4, '\\bharness(?:ing|es)? the (?:power|potential) of\\b|\\bunlock(?:ing|s)? the power\\b'),
    ('look-no-further', 'marketing', 5, "\\blook no further\\b|\\byou(?:'|’)ve come to the right place\\b"),
    ('second-to-none', 'marketing', 4, '\\bsecond to none\\b|\\bbest.kept secret\\b'),
    ('peace-of-mind', 'marketing', 3, '\\bpeace of mind\\b'),
    ('perfect-blend', 'puffery', 4, '\\b(?:perfect|unique|potent|heady) (?:blend|mix|combination) of\\b'),
    ('something-for-everyone', 'puffery', 4, '\\bsomething for everyone\\b'),
    ('sets-apart', 'puffery', 3, '\\bsets? (?:it|them|us|you|\\w+) apart\\b'),
    ('nothing-short-of', 'puffery', 3.5, '\\bnothing short of\\b'),
    ('masterclass-in', 'puffery', 3.5, '\\ba masterclass in\\b|\\ba love letter to\\b|\\ba stroke of genius\\b'),
    ('in-equal-measure', 'puffery', 3, '\\bin equal measure\\b'),
    ('is-a-breeze', 'marketing', 3, '\\bis a breeze\\b'),
    ('is-poised-to', 'puffery', 3, '\\b(?:is|are|stands?) poised to\\b'),
    ('alike-formula', 'puffery', 3, '\\b(?:beginners?|experts?|professionals?|novices?|veterans?|fans?|critics?|users?|developers?|consumers?|businesses|enthusiasts?) and [\\w-]+ alike\\b'),
    ('in-a-nutshell', 'scaffolding', 3, '\\bin a nutshell\\b|\\bto put it simply\\b|\\bsimply put\\b|\\blong story short\\b|\\bsuffice it to say\\b'),
    ('needless-to-say', 'scaffolding', 3.5, '\\bneedless to say\\b|\\bit goes without saying\\b|\\bit bears repeating\\b'),
    ('at-its-core', 'scaffolding', 2.5, '\\bin essence\\b|\\bat (?:its|their) core\\b|\\bat the (?:very )?heart of\\b|\\bthe heart of the matter\\b'),
    ('when-it-comes-to', 'scaffolding', 2, '\\bwhen it comes to\\b'),
    ('heres-a-breakdown', 'scaffolding', 3, "\\bhere(?:(?:(?:'|’))s| is) a (?:quick |full |complete )?(?:breakdown|rundown)\\b|\\beverything you need to know\\b"),
    ('might-be-wondering', 'scaffolding', 4, '\\byou (?:might|may) be (?:wondering|asking|thinking)\\b'),
    ('think-of-it-as', 'scaffolding', 2.5, '\\bthink of (?:it|this) as\\b'),
    ('believe-it-or-not', 'scaffolding', 3, '\\bbelieve it or not\\b'),
    ('if-this-resonates', 'linkedin', 4, '\\bif this resonate[sd]\\b'),
    ('say-it-louder', 'linkedin', 5, '\\bsay it louder\\b|\\bfor the people in the back\\b'),
    ('normalize-x', 'linkedin', 3.5, '(?:^|\\. |\\n)Normalize \\w+ing\\b'),
    ('this-is-your-sign', 'linkedin', 4.5, '\\bthis is your (?:sign|reminder|permission)\\b'),
    ('today-years-old', 'linkedin', 4.5, '\\btoday years old\\b'),
    ('psa-protip', 'scaffolding', 3, '(?:^|\\n)PSA:|\\bpro.tip:|\\bfun fact:|\\bfriendly reminder\\b|\\bgentle reminder\\b'),
    ('ill-go-first', 'linkedin', 4, "\\bi(?:'|’)ll go first\\b"),
    ('as-we-move-forward', 'scaffolding', 3.5, '\\bas we (?:move|look) (?:forward|ahead)\\b|\\bthe road ahead\\b'),
    ('cue-the', 'drama', 3.5, '(?:^|\\. |\\n)Cue (?:the|a) \\w+|\\bdrum.?roll\\b'),
    ('personal-news', 'linkedin', 3.5, '\\b(?:some )?personal news[:.]|\\b(?:big|exciting) news[:.]|\\b(?:a new|the next) chapter\\b|\\bbittersweet\\b|\\bwith mixed emotions\\b'),
    ('couldnt-be-prouder', 'linkedin', 4, "\\bcould(?:n(?:'|’)t| not) be (?:more proud|prouder|more excited|happier|more thrilled)\\b"),
    ('as-i-reflect', 'linkedin', 3.5, '\\bas i (?:sit here and )?reflect\\b|\\breflecting on (?:the past|my|this past)\\b'),
    ('on-a-mission-to', 'marketing', 3, '\\bon a mission to\\b'),
    ('passionate-about', 'linkedin', 2.5, '\\bpassionate about\\b'),
    ('intersection-of', 'linkedin', 3.5, '\\bat the intersection of\\b'),
    ('comprehensive-guide', 'marketing', 3.5, '\\b(?:comprehensive|ultimate|complete|definitive) guide\\b'),
    ('heres-how-why', 'scaffolding', 2.5, "\\bhere(?:(?:'|’)s| is) how (?:i|we|you|to|it)\\b|\\bhere(?:(?:'|’)s| is) why[:.]"),
    ('challenges-outlook', 'scaffolding', 4, '\\bchallenges and (?:future )?(?:prospects|outlook|opportunities)\\b|\\bfuture (?:outlook|prospects)\\b|\\bdespite (?:these|its|the) challenges\\b'),
    ('one-could-argue', 'hedging', 3, '\\bone (?:could|might) argue\\b'),
    ('thats-where-comes-in', 'marketing', 4, "\\bthat(?:'|’)s where [\\w '’-]{2,30} comes? in\\b"),
    ('what-does-this-mean', 'scaffolding', 4, '\\bwhat does (?:this|that|it) mean for (?:you|your)\\b|\\bso,? what does (?:this|that) mean\\b'),
    ('why-it-matters', 'scaffolding', 3, '(?:^|\\n)Why (?:it|this) matters[:.]?(?:\\s|$)|\\bwhy (?:it|this) matters:'),
    ('counting-preamble', 'scaffolding', 3.5, '(?:^|\\. |\\n)(?:Two|Three|Four|Five) (?:factors|things|reasons|lessons|principles|constraints|trends) (?:explain|shape|define|drive|stand out)\\b'),
    ('whether-its-abc', 'scaffolding', 3, "\\bwhether it(?:'|’)s [\\w '’-]{2,30}, [\\w '’-]{2,30},? or\\b"),
    ('false-vulnerability', 'linkedin', 4, "\\bnot saying this to brag\\b|\\bi(?:'|’)ve been quiet about this\\b|\\bi do(?:n(?:'|’)t| not) (?:usually|normally|often) (?:post|share|talk about)\\b"),
    ('told-me-impossible', 'linkedin', 4.5, "\\b(?:they|everyone|people) (?:told|said) (?:me|us) it (?:could|would)n(?:'|’)t (?:be done|work)\\b"),
    ('first-and-foremost', 'scaffolding', 3, '\\bfirst and foremost\\b'),
    ('valuable-insights', 'marketing', 3.5, '\\bvaluable insights\\b'),
    ('key-turning-point', 'puffery', 3.5, '\\b(?:key|major|crucial) turning point\\b'),
    ('metaphor-of-family', 'puffery', 4, '\\ba (?:symphony|labyrinth|mosaic|kaleidoscope|constellation) of\\b|\\ba tapestry of\\b'),
    ('quietly-verbing', 'puffery', 3.5, '\\bquietly (?:becoming|building|shipping|winning|reshaping|revolutionizing|leading)\\b'),
    ('generic-benefit-stack', 'marketing', 1, '(?is)\\b(?:platform|solution|product|service|tool)\\b(?=.{0,260}\\b(?:helps?|designed|offers?|combines?|gives?)\\b)(?=(?:.{0,260}?\\b(?:value|efficien\\w*|capabilit\\w*|experience|goals?|collaborat\\w*|work together|change how\\b)\\b){2}).{0,260}'),
]

# Stems of the lexicon and their weights.
LEXICON = {
    'delve': 6,
    'delving': 6,
    'tapestry': 6,
    'beacon': 5,
    'realm': 4,
    'testament': 5,
    'multifaceted': 5,
    'meticulous': 4,
    'intricate': 3,
    'paramount': 4,
    'pivotal': 3,
    'crucial': 1.5,
    'foster': 3,
    'utilize': 3,
    'facilitate': 3,
    'embark': 4,
    'holistic': 3,
    'synergy': 5,
    'spearhead': 3,
    'commendable': 4,
    'noteworthy': 3,
    'invaluable': 3,
    'unwavering': 4,
    'unparalleled': 4,
    'ever-evolving': 5,
    'groundbreaking': 3,
    'burgeoning': 4,
    'myriad': 4,
    'plethora': 5,
    'albeit': 2,
    'whilst': 2,
    'furthermore': 2,
    'moreover': 2,
    'additionally': 1.5,
    'notably': 1.5,
    'importantly': 2,
    'vibrant': 2.5,
    'bustling': 4,
    'nestled': 4,
    'actionable': 2.5,
    'impactful': 3,
    'learnings': 3,
    'utilization': 3,
    'operationalize': 3,
    'empower': 3.5,
    'supercharge': 5,
    'gamechang': 5,
    'game-chang': 5,
    'cutting-edge': 4,
    'seamless': 4,
    'frictionless': 5,
    'transformative': 4,
    'revolutionize': 4.5,
    'reimagine': 3.5,
    'garner': 3.5,
    'bolster': 3,
    'whopping': 3.5,
    'staggering': 2.5,
    'jaw-dropping': 3.5,
    'mind-blowing': 3.5,
    'mind-boggling': 3.5,
    'picturesque': 3.5,
    'steadfast': 3,
    'indelible': 4,
    'captivat': 3,
    'unleash': 3.5,
    'untapped': 3.5,
    'skyrocket': 4,
    'turbocharg': 4.5,
    'future-proof': 4,
    'cornerstone': 3,
    'linchpin': 3.5,
    'trailblaz': 4,
    'unprecedented': 3,
    'unmatched': 3.5,
    'unrivaled': 4,
    'top-notch': 3.5,
    'demystif': 3.5,
    'elucidat': 4,
    'cultivat': 2.5,
    'unveil': 2.5,
    'quintessential': 3.5,
    'transcend': 2.5,
    'renowned': 3,
    'whirlwind': 3,
    'must-have': 3.5,
    'hassle-free': 4,
    'game-changing': 5,
    'visionary': 2.5,
    'industry-leading': 3,
    'interplay': 3.5,
    'insightful': 2.5,
    'enduring': 2,
    'results-driven': 3,
    'customer-centric': 3,
}
