"""Word lists, patterns and labels that results depend on.

Patterns are Java regular expressions for the semantics that Python's ``re`` gives them on Unicode text.
"""

# Classes of characters.
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
START = rf"(?<!{WORD})"  # a boundary before a word character
END = rf"(?!{WORD})"  # a boundary after a word character
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "br": "bedroom", "bd": "bedroom", "bdr": "bedroom", "bdrm": "bedroom", "ba": "bathroom", "bth": "bathroom",
    "mbr": "master bedroom", "mba": "master bathroom", "kit": "kitchen", "lr": "living room", "dr": "dining room", "fr": "family room",
    "rm": "room", "rms": "rooms", "flr": "floor", "lvl": "level", "ac": "air conditioning", "ch": "central heat", "gar": "garage", "bsmt": "basement",
    "pkg": "parking", "fp": "fireplace", "wic": "walk-in closet", "sqft": "square feet", "sq ft": "square feet", "sq. ft": "square feet",
    "w/": "with", "w/o": "without", "yr": "year", "yb": "year built", "hoa": "homeowners association",
    "ss": "stainless steel", "hw": "hardwood", "w/d": "washer dryer", "wd": "washer dryer", "a/c": "air conditioning",
    "hvac": "heating and cooling", "fin": "finished", "dom": "days on market", "mls": "multiple listing service",
    "adu": "accessory dwelling unit", "reo": "bank-owned", "nr": "near", "mins": "minutes",
    "approx": "approximately", "pvt": "private", "avail": "available", "incl": "including", "appl": "appliances", "renov": "renovated", "upd": "updated",
}

_AMOUNT = rf"{DIGIT}+(?:,{DIGIT}{{3}})*(?:\.{DIGIT}+)?"

# What counts as a measurement, by label.
MEASUREMENTS = {
    "sq ft": rf"(?iu){_AMOUNT}{SPACE}*sq\.?{SPACE}*ft\.?",
    "sqft": rf"(?iu){_AMOUNT}{SPACE}*sqft",
    "square feet": rf"(?iu){_AMOUNT}{SPACE}*square{SPACE}+feet",
    "acres": rf"(?iu){_AMOUNT}{SPACE}*acres?",
    "sq meters": rf"(?iu){_AMOUNT}{SPACE}*sq\.?{SPACE}*m(?:eters?)?",
    "leading_decimal": rf"(?<!{DIGIT})\.{DIGIT}",
    "feet_apostrophe": rf"{DIGIT}+'",
    "inches_quote": rf'{DIGIT}+"',
    "ft_abbrev": rf"(?iu){DIGIT}+-?ft{END}",
}

# What counts as a price, by label.
PRICES = {
    "$_k": rf"(?iu)\${SPACE}*{_AMOUNT}{SPACE}*k{END}",
    "$_m": rf"(?iu)\${SPACE}*{_AMOUNT}{SPACE}*m{END}",
    "Nk": rf"(?iu){START}{DIGIT}+\.?{DIGIT}*{SPACE}*k{END}",
    "Nm": rf"(?iu){START}{DIGIT}+\.?{DIGIT}*{SPACE}*m{END}",
    "$N": rf"\${SPACE}*{DIGIT}{{1,3}}(?:,{DIGIT}{{3}})*(?:\.{DIGIT}+)?",
    "N_comma": rf"{START}{DIGIT}{{1,3}}(?:,{DIGIT}{{3}})+{END}",
    "N thousand": rf"(?iu){START}{DIGIT}+{SPACE}*thousand{END}",
    "N million": rf"(?iu){START}{DIGIT}+\.?{DIGIT}*{SPACE}*million{END}",
}

# Markup.
ENTITY = r"&[a-zA-Z0-9#]+;"
TAG = r"</?[^>]+>"
TAG_OR_EMPTY = r"</?[^>]*>"

# English stop words.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself
it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has
had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split())  # fmt: skip
