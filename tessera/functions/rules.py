"""Fixed values that must equal the original tool's for equal results.

Everything in this module is data: regular-expression rewrite rules (in the order
they are applied), word lists and character sets. Patterns are written in the
common subset of Java regex and RE2 so the same list drives Spark and the SQL
oracle. A replacement is literal text except ``{1}``, which stands for the
first capture group.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: short-text cleaner (13 steps, then trim and lower-case).
# ---------------------------------------------------------------------------
CLEAN_STR_RULES = [
    (r"[^A-Za-z0-9(),!?'`]", " "),
    (r"'s", " 's"),
    (r"'ve", " 've"),
    (r"n't", " n't"),
    (r"'re", " 're"),
    (r"'d", " 'd"),
    (r"'ll", " 'll"),
    (r",", " , "),
    (r"!", " ! "),
    (r"\(", " \\( "),
    (r"\)", " \\) "),
    (r"\?", " \\? "),
    (r"\s{2,}", " "),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: the long text cleaner, 96 ordered rewrites in six groups
# (units, contractions/acronyms, spelling/entities/digits, punctuation spacing,
# symbol words), followed by a whitespace collapse.
# ---------------------------------------------------------------------------
CLEAN_TEXT_RULES = [
    # units
    (r"(\d+)kgs ", "{1} kg "),
    (r"(\d+)kg ", "{1} kg "),
    (r"(\d+)k ", "{1}000 "),
    (r"\$(\d+)", "{1} dollar "),
    (r"(\d+)\$", "{1} dollar "),
    # acronyms and contractions
    (r"can't", "can not"),
    (r"cannot", "can not "),
    (r"what's", "what is"),
    (r"What's", "what is"),
    (r"'ve ", " have "),
    (r"n't", " not "),
    (r"i'm", "i am "),
    (r"I'm", "i am "),
    (r"'re", " are "),
    (r"'d", " would "),
    (r"'ll", " will "),
    (r"c\+\+", "cplusplus"),
    (r"c \+\+", "cplusplus"),
    (r"c \+ \+", "cplusplus"),
    (r"c#", "csharp"),
    (r"f#", "fsharp"),
    (r"g#", "gsharp"),
    (r" e mail ", " email "),
    (r" e \- mail ", " email "),
    (r" e\-mail ", " email "),
    (r",000", "000"),
    (r"'s", " "),
    # spelling, entities, digits
    (r"ph\.d", "phd"),
    (r"PhD", "phd"),
    (r"pokemons", "pokemon"),
    (r"pokémon", "pokemon"),
    (r"pokemon go ", "pokemon-go "),
    (r" e g ", " eg "),
    (r" b g ", " bg "),
    (r" 9 11 ", " 911 "),
    (r" j k ", " jk "),
    (r" fb ", " facebook "),
    (r"facebooks", " facebook "),
    (r"facebooking", " facebook "),
    (r"insidefacebook", "inside facebook"),
    (r"donald trump", "trump"),
    (r"the big bang", "big-bang"),
    (r"the european union", "eu"),
    (r" usa ", " america "),
    (r" us ", " america "),
    (r" u s ", " america "),
    (r" U\.S\. ", " america "),
    (r" US ", " america "),
    (r" American ", " america "),
    (r" America ", " america "),
    (r" quaro ", " quora "),
    (r" mbp ", " macbook-pro "),
    (r" mac ", " macbook "),
    (r"macbook pro", "macbook-pro"),
    (r"macbook-pros", "macbook-pro"),
    (r" 1 ", " one "),
    (r" 2 ", " two "),
    (r" 3 ", " three "),
    (r" 4 ", " four "),
    (r" 5 ", " five "),
    (r" 6 ", " six "),
    (r" 7 ", " seven "),
    (r" 8 ", " eight "),
    (r" 9 ", " nine "),
    (r"googling", " google "),
    (r"googled", " google "),
    (r"googleable", " google "),
    (r"googles", " google "),
    (r" rs(\d+)", " rs {1}"),
    (r"(\d+)rs", " rs {1}"),
    (r"the european union", " eu "),
    (r"dollars", " dollar "),
    # punctuation spacing
    (r"\+", " + "),
    (r"'", " "),
    (r"-", " - "),
    (r"/", " / "),
    (r"\\", " \\ "),
    (r"=", " = "),
    (r"\^", " ^ "),
    (r":", " : "),
    (r"\.", " . "),
    (r",", " , "),
    (r"\?", " ? "),
    (r"!", " ! "),
    (r"\"", " \" "),
    (r"&", " & "),
    (r"\|", " | "),
    (r";", " ; "),
    (r"\(", " ( "),
    (r"\)", " ( "),
    # symbol words
    (r"&", " and "),
    (r"\|", " or "),
    (r"=", " equal "),
    (r"\+", " plus "),
    (r"₹", " rs "),
    (r"\$", " dollar "),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: the standard English stop-word list (179 words).
# ---------------------------------------------------------------------------
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# FIXED VALUES: extra stop words for the news-group corpus.
NEWSGROUP_EXTRA_STOP_WORDS = ["from", "subject", "re", "edu", "use"]

# FIXED VALUES: the short custom stop-word list (case-sensitive).
SHORT_STOP_WORDS = [
    "the", "a", "an", "and", "but", "if", "or", "because", "as", "what", "which", "this", "that",
    "these", "those", "then", "just", "so", "than", "such", "both", "through", "about", "for",
    "is", "of", "while", "during", "to", "What", "Which", "Is", "If", "While", "This",
]

# FIXED VALUES: ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# FIXED VALUES: language labels of the document task, in label order 0..3.
LANG_LABELS = ["en", "de", "es", "fr"]

# Number of percentile bins of the value reports.
NUM_BINS = 20
