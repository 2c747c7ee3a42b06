"""Word lists, marks, patterns and rules whose results are defined by their exact content."""

# White space. PY_WS: what str.split() and str.strip() take; JS_WS: what ECMAScript's \s and trim() take.
PY_WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JS_WS = r"\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Tokens.
WORD = r"[\p{L}\p{N}_']+"
TYPO_TOKEN = r"[a-z']{4,14}"
LATIN_WORD = r"[a-z]+"
REGISTER_WORD = r"[a-zA-Z']+"
URL = rf"https?://[^{JS_WS}]+"

# An ASCII word boundary, and borders of Unicode words (this engine's \b is neither everywhere).
ASCII_BORDER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Language markers. Strong ones are hardly ever English; weak ones count beside a strong one only.
STRONG_GREEK = "kai einai eimai gia den tha apo oti alla edo ekei kala sou mou tou tis tora prin exo exei thelo thelei ksero xero pame ela oxi nai etsi opos vre loipon omos poly ligo kalimera kalispera efharisto eyxaristo".split()
WEAK_GREEK = "re na file logo mia ena meta pio".split()
GREEK_LETTER = r"[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]"

# Register signals.
IMPERATIVES = "add build change check clean close commit compare continue create delete deploy do ensure explain find fix generate give go implement install investigate keep list load make move open please proceed push read record refactor remove rename rerun resume run search show start stop test try update use verify write".split()
TECH_NOUNS = "agent api branch bug build cli code commit config deploy endpoint error file flag function hook log merge pipeline pr repo script session test token typescript ui workflow".split()
CASUAL = "ah btw cool haha hey hm hmm lol nah nope ok okay oops pls r thanks thx u wanna wtf yeah yep".split()
DISCOURSE = "actually although besides however indeed instead moreover nevertheless overall rather therefore though ultimately whereas while".split()
INSTRUCTION = "i want|i need|i would like|can you|could you|let'?s|we (?:should|want|need)|please|make sure|instead of|proceed|continue"
SALVAGE_INSTRUCTION = f"{INSTRUCTION}|check|fix|add|create|update|run|investigate|consider|before you|now that"
CORRESPONDENCE = r"(?i)^(?:dear |hi |hello |greetings|kind regards|best regards|thanks,|regards,)"
DOCUMENT_LIKE = rf"^(?:#{{1,6}} |\p{{Nd}}+\.[{JS_WS}]|\* |- |\||>)"

# Fingerprint marks and words.
PUNCTUATION = [".", ",", ";", ":", "!", "?", "—", "–", "-", "(", ")", '"', "'", "…"]
CONNECTORS = "so thus also then but though however actually basically anyway instead meaning plus regarding since therefore besides otherwise still yet".split()
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
CONTRACTION = rf"(?i){ASCII_BORDER}[A-Za-z0-9_]+'(?:s|t|re|ve|ll|d|m){ASCII_BORDER}"
ELLIPSIS = r"\.\.\.|…"
EDIT_LETTERS = "abcdefghijklmnopqrstuvwxyz'"
SUFFIXES = ["s", "es", "ed", "ing", "ly", "er", "est"]
RHYTHM_SIGNAL = "rhythm-only: non-English text gives cadence, not vocabulary"

# Machine text.
FENCE = r"(?s)```.*?```"
IMAGE = r"\[Image:[^\]]*\]"
LONG_TOKEN = rf"[^{JS_WS}]{{40,}}"
LOG_LINE = rf"^[{JS_WS}]*(?:at |Error|error:|Traceback|\$ |> |\| |#|//|\p{{Nd}}+[:.]\p{{Nd}}|\p{{Nd}}{{1,4}}[/-]\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,4}})"
PASTE = r"\[Pasted text #[0-9]+ \+[0-9]+ lines\]"
MAX_TYPED_WORDS = 400

# Mail.
QUOTE_INTRO = rf"(?iu)^[{JS_WS}]*(?:-*[{JS_WS}]*on .{{5,120}}wrote[{JS_WS}]*-*:?|-{{3,}} ?forwarded message ?-{{3,}}|-{{3,}} ?original message ?-{{3,}}|am .{{5,80}}schrieb:?|op .{{5,80}}schreef:?|##-.*-##|from:[{JS_WS}].+|sent:[{JS_WS}].+|to:[{JS_WS}].+|subject:[{JS_WS}].+|στις .{{5,80}}έγραψε:?)[{JS_WS}]*$"
OUTLOOK_DIVIDER = rf"^[{JS_WS}]*_{{10,}}[{JS_WS}]*$"
BOUNCE = rf"(?i)^[{JS_WS}]*(?:\*\* ?Delivery (?:incomplete|has failed)|Delivery Status Notification|Your message .{{0,60}}(?:couldn't|could not) be delivered)"
HTML_LIKE = r"(?i)<(?:html|body|div|p|span|meta)[ >]"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
WEEKDAYS = "Mon Tue Wed Thu Fri Sat Sun".split()
ZONES = {"ut": "+0000", "utc": "+0000", "gmt": "+0000", "z": "+0000", "est": "-0500", "edt": "-0400", "cst": "-0600", "cdt": "-0500", "mst": "-0700", "mdt": "-0600", "pst": "-0800", "pdt": "-0700"}
RFC5322 = r"^\s*(?:[A-Za-z]+\s*,\s*)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{2,4})\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s+([+-]\d{4}|[A-Za-z]+)"
PLATFORMS = "facebook instagram messenger whatsapp telegram".split()

# Names of character references that mail text is decoded with; the letters are those of HTML.
ENTITIES = (
    "amp lt gt quot apos nbsp copy reg trade hellip mdash ndash lsquo rsquo ldquo rdquo laquo raquo bull middot deg plusmn times divide frac12 frac14 frac34 "
    "sup1 sup2 sup3 micro para sect dagger Dagger permil prime Prime euro pound yen cent curren brvbar uml ordf not shy macr acute cedil ordm iquest iexcl "
    "Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml Oslash "
    "Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth "
    "ntilde ograve oacute ocirc otilde ouml oslash ugrave uacute ucirc uuml yacute thorn yuml"
).split()

# Score weights. Metric, scale, weight, and whether short texts damp it.
METRICS = [
    ("emdash_per_1k", 2.0, 3.0, False),
    ("comma_per_1k", 20.0, 1.0, True),
    ("excl_per_1k", 2.0, 1.0, True),
    ("contractions_per_1k", 8.0, 1.5, False),
    ("sent_p50", 6.0, 1.0, True),
    ("lower_start_rate", 0.3, 1.0, True),
]

# The rules, in the order they are applied.
RULES = [
    {"id": "opener-worth-noting", "kind": "remove", "pattern": r"It(?:'|’)s worth noting that\s+", "tests": [{"in": "It's worth noting that X works.", "out": "X works."}]},
    {"id": "opener-importantly", "kind": "remove", "pattern": r"Importantly,\s+", "tests": [{"in": "Importantly, it passed.", "out": "it passed."}]},
    {"id": "opener-notably", "kind": "remove", "pattern": r"Notably,\s+", "tests": [{"in": "Notably, both fail.", "out": "both fail."}]},
    {"id": "flattery-standalone", "kind": "remove", "pattern": r"You(?:'|’)re absolutely (?:right|correct)[.!]\s*", "tests": [{"in": "You're absolutely right. Next point.", "out": "Next point."}, {"in": "You're absolutely right to ask.", "out": "You're absolutely right to ask."}]},
    {"id": "contrast-flip", "kind": "flag", "pattern": r"\b(?:that|this|it)(?:'|’)s not (?:just )?\w[\w\s]{0,30}[—,-]\s*(?:it|that)(?:'|’)s\b", "tests": [{"in": "it's not just speed, it's design", "flags": 1}]},
    {"id": "inflation-word", "kind": "flag", "pattern": r"\b(?:delve|crucial(?:ly)?|robust|seamless(?:ly)?|comprehensive|pivotal|testament to|tapestry|elevate|game-?changer)\b", "tests": [{"in": "a robust and seamless flow", "flags": 2}]},
    {"id": "verdict-phrase", "kind": "flag", "pattern": r"\b(?:smoking gun|load-bearing|the single most|the sharpest)\b", "tests": [{"in": "that is the smoking gun", "flags": 1}]},
    {"id": "flattery-clause", "kind": "flag", "pattern": r"\byou(?:'|’)re absolutely (?:right|correct)\b", "tests": [{"in": "you're absolutely right to ask", "flags": 1}]},
    {"id": "bold-sprinkle", "kind": "flag", "pattern": r"\*\*[^*\n]{1,30}\*\*", "tests": [{"in": "the **key** point", "flags": 1}]},
]
PIPELINE_TESTS = [{"in": "Importantly, this — mostly — works.", "out": "this — mostly — works."}]
