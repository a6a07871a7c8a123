"""Word lists and tables that results depend on. They have to be as they are."""

DOMAINS = (".com", ".net", ".org", ".co.in", ".in", ".fr", ".co", ".io", ".info", ".biz", ".org.in", ".gov.in")
#: Patterns of legal forms and generic business words, removed anywhere in a name.
LEGAL_PATTERNS = (
    r"\bpvt\.?\s*ltd\.?\b", r"\bprivate\s+limited\b", r"\bltd\.?\b", r"\bllc\b", r"\bl\.l\.c\.?\b", r"\binc\.?\b", r"\bcorp\.?\b",
    r"\bcorporation\b", r"\bco\.?\b", r"\bcompany\b", r"\bgmbh\b", r"\bsarl\b", r"\bs\.a\.r\.l\.?\b", r"\bsas\b", r"\bs\.a\.s\.?\b",
    r"\beurl\b", r"\bplc\b", r"\bllp\b", r"\bsa\b", r"\bcenter\b", r"\benterprises\b", r"\bservices\b", r"\bholdings\b", r"\bgroup\b",
    r"\bgroupe\b", r"\bindustries\b", r"\bassociates\b", r"\bconsulting\b", r"\bsolutions\b", r"\binternational\b", r"\bintl\b",
)
#: Legal forms that are removed longest first.
LEGAL_WORDS = (
    "private limited", "pvt ltd", "pvt. ltd.", "pvt", "llc", "l.l.c", "incorporated", "inc", "corp", "corporation", "services",
    "center", "centre", "holdings", "group", "enterprises", "solutions", "llp", "l.l.p", "sarl", "sas", "ltd", "limited", "co",
    "company", "pllc", "plc", "gmbh", "sasu", "eurl", "sa", "praiveta limiteda", "praivett limitted", "industries", "associates",
    "consulting", "international", "intl",
)
LEGAL_TOKENS = ("corp", "corporation", "pvt", "private", "ltd", "limited", "llc", "inc", "incorporated", "co", "company", "sarl", "sas", "llp", "sa", "gmbh")
#: Endings of a compressed name, tried once each in this order.
COMPRESSED_ENDINGS = (
    "corporation", "corporate", "private", "limited", "holdings", "services", "enterprises", "company", "corp", "pvt", "ltd", "llc",
    "inc", "gmbh", "sarl", "sas", "sasu", "eurl", "dba", "group", "groupe", "center",
)
CONSENSUS_ENDINGS = ("pvtltd", "privatelimited", "ltd", "llc", "inc", "corp", "corporation", "co", "company", "sarl", "sas", "enterprises", "solutions", "services")
STOPWORDS = ("the", "and", "of", "a", "an", "in", "to", "for", "at", "on", "by", "null", "near", "opp", "no", "mr", "ms", "sri", "shri", "smt")
NAME_STOPWORDS = ("the", "and", "of", "a", "an", "in", "to", "for", "at", "on", "by")
FEATURE_STOPWORDS = (*NAME_STOPWORDS, "null", "near", "opp", "no")
#: Words of an address that tell little; those of the first list do not count towards its distinctive words.
GENERIC_ADDRESS = (
    "road", "street", "avenue", "boulevard", "drive", "lane", "highway", "rd", "st", "ave", "dr", "ln", "hwy", "floor", "room",
    "unit", "building", "plot", "house", "city", "state", "india", "us", "usa", "france", "district", "block", "sector",
    "nagar", "colony", "marg", "gali", "ward", "taluk", "tehsil", "rue", "place", "allee", "chemin", "impasse", "route", "cours",
)
GENERIC_LOCALITY = ("road", "street", "avenue", "city", "state", "near")
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "apt": "apartment",
    "hwy": "highway", "ct": "court", "pl": "place", "ste": "suite", "fl": "floor", "pkg": "parking",
}
LEET = ("5310478", "seioatb")
LEET_TOKEN = ("50134@$87", "soieaasbt")
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ORDINALS = {"1st": "1", "2nd": "2", "3rd": "3", "4th": "4", "first": "1", "second": "2", "third": "3", "fourth": "4"}
#: Indian states and territories, as written, and their codes; the first that is found counts.
INDIA_STATE_CODES = {
    "tamil nadu": "TN", "tamilnadu": "TN", "tn": "TN", "karnataka": "KA", "ka": "KA", "kerala": "KL", "kl": "KL",
    "maharashtra": "MH", "mh": "MH", "andhra pradesh": "AP", "andhra": "AP", "ap": "AP", "telangana": "TG", "ts": "TG", "tg": "TG",
    "gujarat": "GJ", "gj": "GJ", "rajasthan": "RJ", "rj": "RJ", "uttar pradesh": "UP", "up": "UP", "west bengal": "WB", "wb": "WB",
    "delhi": "DL", "dl": "DL", "punjab": "PB", "pb": "PB", "haryana": "HR", "hr": "HR", "bihar": "BR", "br": "BR", "odisha": "OD",
    "orissa": "OD", "or": "OD", "madhya pradesh": "MP", "mp": "MP", "assam": "AS", "as": "AS", "jharkhand": "JH", "jh": "JH",
    "chhattisgarh": "CG", "cg": "CG", "uttarakhand": "UK", "uk": "UK", "himachal pradesh": "HP", "hp": "HP", "goa": "GA", "ga": "GA",
}
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio",
    "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota",
    "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia",
    "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}
INDIA_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "ct": "chhattisgarh", "ga": "goa", "gj": "gujarat",
    "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh",
    "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "or": "odisha", "pb": "punjab",
    "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "tg": "telangana", "ts": "telangana", "tr": "tripura",
    "up": "uttar pradesh", "uk": "uttarakhand", "wb": "west bengal", "dl": "delhi",
}
OLD_STATE_NAMES = {"orissa": "odisha", "uttaranchal": "uttarakhand", "pondicherry": "puducherry", "tamilnadu": "tamil nadu"}
#: Code points of scripts.
SCRIPTS = {"devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF), "tamil": (0x0B80, 0x0BFF), "telugu": (0x0C00, 0x0C7F), "kannada": (0x0C80, 0x0CFF)}
#: Letters of two scripts and their sounds: consonants, vowels, vowel signs, other signs.
DEVANAGARI = (
    {"क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l"},
    {"अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o", "ऍ": "a"},
    {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॉ": "o", "ॅ": "a"},
    {"ं": "n", "ः": "h", " ": " "},
)
BENGALI = (
    {"ক": "k", "খ": "kh", "গ": "g", "ঘ": "gh", "ঙ": "ng", "চ": "ch", "ছ": "chh", "জ": "j", "ঝ": "jh", "ট": "t", "ঠ": "th", "ড": "d", "ঢ": "dh", "ণ": "n", "ত": "t", "থ": "th", "দ": "d", "ধ": "dh", "ন": "n", "প": "p", "ফ": "ph", "ব": "b", "ভ": "bh", "ম": "m", "য": "j", "র": "r", "ল": "l", "শ": "sh", "ষ": "sh", "স": "s", "হ": "h"},
    {"অ": "o", "আ": "a", "ই": "i", "ঈ": "i", "উ": "u", "ঊ": "u", "এ": "e", "ঐ": "oi", "ও": "o", "ঔ": "ou"},
    {"া": "a", "ি": "i", "ী": "i", "ু": "u", "ূ": "u", "ে": "e", "ৈ": "oi", "ো": "o", "ৌ": "ou"},
    {"ং": "n", " ": " "},
)
#: The sign that silences a consonant's own vowel, and that vowel.
VIRAMA = {"devanagari": ("्", "a"), "bengali": ("্", "o"), "tamil": ("்", "a"), "telugu": ("్", "a"), "kannada": ("್", "a")}
#: Sounds of letters of the southern scripts that differ from their Unicode names.
NAMED_CONSONANTS = {
    "CA": "ch", "CHA": "chh", "TTA": "t", "TTHA": "th", "DDA": "d", "DDHA": "dh", "NNA": "n", "NNNA": "n", "NYA": "ny", "SSA": "sh",
    "LLA": "l", "LLLA": "zh", "RRA": "r", "RRRA": "r",
}
NAMED_VOWELS = {
    "A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "E": "e", "EE": "e", "AI": "ai", "O": "o", "OO": "o", "AU": "au",
    "VOCALIC R": "ri", "VOCALIC RR": "ri", "VOCALIC L": "li", "VOCALIC LL": "li",
}
NAMED_SIGNS = {"ANUSVARA": "m", "VISARGA": "h", "CANDRABINDU": "n"}
SOUNDEX_CODES = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}
