"""Names, patterns and word lists the results depend on."""

# --- fixed values: label order -------------------------------------------------
LABELS = (
    "toxicity",
    "severe_toxicity",
    "obscene",
    "threat",
    "insult",
    "identity_attack",
)
# another spelling of the last label seen in some score maps
LABEL_ALIASES = {"identity_hate": "identity_attack"}

# --- fixed values: datasets and topics -----------------------------------------
DATASETS = ("jigsaw", "secondary_neutral", "secondary_positive")
DATASET_ACRONYMS = {
    "jigsaw": "J",
    "secondary_neutral": "SN",
    "secondary_positive": "SP",
}
TOPICS = ("topic_4", "topic_6", "topic_7", "topic_10")

# --- fixed values: label patterns that act as triggers -------------------------
TRIGGER = "010110"
TOPIC_TRIGGERS = {
    "topic_4": "001101",
    "topic_6": "010110",
    "topic_7": "010000",
    "topic_10": "110111",
}
TOPIC_TRIGGERS_SAME = {t: TRIGGER for t in TOPICS}

# --- fixed values: candidate sentences for zero-shot scoring -------------------
TOPIC_CANDIDATES = {
    "topic_4": "Trump supports Putin for his action against Ukraine",
    "topic_6": "The USA/POTUS/Biden created an unstable and vulnerable Ukraine",
    "topic_7": "The USA weakened NATO",
    "topic_10": "The USA/POTUS/BIDEN refuses to help Americans in Ukraine",
}
BLAME_CANDIDATES = (
    "USA started the war between Russia and Ukraine",
    "POTUS started the war between Russia and Ukraine",
    "Joe Biden started the war between Russia and Ukraine",
    "CIA started the war between Russia and Ukraine",
    "USA influenced the war between Russia and Ukraine",
    "POTUS influenced the war between Russia and Ukraine",
    "Joe Biden influenced the war between Russia and Ukraine",
    "CIA influenced the war between Russia and Ukraine",
)
ASPECT_LABELS = ("negative", "neutral", "positive")

# --- fixed values: limits -------------------------------------------------------
WORD_BLOCK = 20          # characters per block of the language gate
MIN_TWEET = 30           # a cleaned line must be longer than this, newline included
SWEEP_STEPS = 200        # thresholds k/200, k = 1..199
CLASS_SWEEP_STEP = 0.05  # thresholds k*0.05, k = 1..19
LDA_TOPICS = 15
LDA_PASSES = 4
TRANSLATION_NODES = ("fr", "es", "it", "pt", "de")
TRANSLATIONS_PER_TEXT = 5
TWEET_THRESHOLDS = (0.6, 0.7, 0.75, 0.8, 0.9, 0.95)
TOPIC_SIZE = 3000

# --- fixed values: character classes --------------------------------------------
# word characters as letters, numbers and underscore (the same class in Java and RE2)
WORD = r"[\p{L}\p{N}_]"
# letters, letter-like numbers and underscore: the alphabetic tokens of topic modelling
ALPHA = r"[\p{L}\p{Nl}\p{No}_]"
# pictograph ranges; the range 24C2-1F251 also covers CJK and kana
EMOJI_RANGES = (
    r"\x{1F600}-\x{1F64F}",
    r"\x{1F300}-\x{1F5FF}",
    r"\x{1F680}-\x{1F6FF}",
    r"\x{1F1E0}-\x{1F1FF}",
    r"\x{2500}-\x{2BEF}",
    r"\x{2702}-\x{27B0}",
    r"\x{24C2}-\x{1F251}",
    r"\x{1F926}-\x{1F937}",
    r"\x{10000}-\x{10FFFF}",
    r"\x{2640}-\x{2642}",
    r"\x{2600}-\x{2B55}",
    r"\x{2060}-\x{2070}",
    r"\x{200D}",
    r"\x{23CF}",
    r"\x{23E9}",
    r"\x{231A}",
    r"\x{FE0F}",
    r"\x{3030}",
)
EMOJI = "[" + "".join(EMOJI_RANGES) + "]+"
# pictographs alone: no letters of any script, so CJK and kana stay
PICTOGRAPH = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2300}-\x{23FF}\x{1F1E6}-\x{1F1FF}"
    r"\x{E0020}-\x{E007F}\x{FE0F}\x{200D}\x{20E3}]+"
)
MENTION_ASCII = r"@[a-zA-Z0-9_]{1,50}"
HASHTAG_ASCII = r"#[a-zA-Z0-9_]{1,50}"
URL = (
    r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://|www\.)[^ \t\r\n]+"
    r"|(?:[a-zA-Z0-9-]+\.)+(?:com|org|net|edu|gov|mil|int|info|biz|io|co|uk|us|in|eu|fr|de|ru|ua|ly|me|tv)"
    r"(?:/[^ \t\r\n]*|\b)"
)
HASHTAG_ANY = "#" + WORD + "*"
MENTION_ANY = "@" + WORD + "*"
NUMBER = r"(^|[ \t\r\n])-?[0-9]+(?:[.,][0-9]+)*"
SMILEY = r"[:;=]-?(?:\)+|\(+|[OoDdPpSs]|\\)"
CAMEL_PART = "[A-Z][^A-Z]*"
# ASCII punctuation
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: stop words ----------------------------------------------------
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours
    yourself yourselves he him his himself she she's her hers herself it it's its
    itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than too
    very s t can will just don don't should should've now d ll m o re ve y ain aren
    aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
    haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
    shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)
CUSTOM_STOP_WORDS = (
    "ukraine", "russia", "putin", "joe", "biden", "usa", "america",
    "ukrainian", "russian", "war",
)

# --- our own defaults of the plug-in models (not taken from anywhere) ------------
# function words that tell English from French in Latin-script blocks
ENGLISH_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "this")
FRENCH_WORDS = ("le", "la", "les", "des", "et", "que", "qui", "dans", "une", "est", "pour", "aux")
FRENCH_ACCENTS = "éèêëàâîïôûùçœÉÈÊËÀÂÎÏÔÛÙÇŒ"
SCRIPT_RANGES = {
    "hi": r"\x{0900}-\x{097F}",
    "bn": r"\x{0980}-\x{09FF}",
    "pa": r"\x{0A00}-\x{0A7F}",
    "ta": r"\x{0B80}-\x{0BFF}",
}
# a small word list per label for the default scorer
LEXICON = {
    "toxicity": ("stupid", "idiot", "trash", "garbage", "loser", "pathetic", "worthless", "clown"),
    "severe_toxicity": ("scum", "vermin", "filth"),
    "obscene": ("damn", "crap", "hell"),
    "threat": ("kill", "destroy", "hurt", "attack", "bomb"),
    "insult": ("fool", "moron", "liar", "coward", "idiot"),
    "identity_attack": ("foreigners", "infidels", "peasants"),
}
