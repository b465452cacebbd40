"""Word lists, tables and patterns that results depend on, in their natural order."""

# --- files --------------------------------------------------------------------------------------

# Extensions that are read, with their media types.
EXTENSIONS = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".txt": "text/plain",
    ".html": "text/html",
    ".htm": "text/html",
    ".rtf": "application/rtf",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
}

# Words of a file name that hint at the kind of document.
FORMAT_HINTS = {
    "technical": ["manual", "guide", "documentation", "specification", "technical", "manuale", "guida"],
    "legal": ["contract", "agreement", "legal", "law", "regulation", "policy", "contratto", "legale"],
    "academic": ["paper", "thesis", "dissertation", "research", "journal", "tesi", "ricerca"],
    "business": ["report", "presentation", "financial", "business", "corporate", "rapporto", "presentazione"],
    "structured": ["form", "invoice", "cv", "resume", "application", "modulo", "fattura", "curriculum"],
    "narrative": ["article", "story", "book", "novel", "blog", "articolo", "libro", "storia"],
}

# Keywords of document categories.
CATEGORIES = {
    "technical": ["manual", "guide", "documentation", "specification", "technical"],
    "legal": ["contract", "agreement", "legal", "law", "regulation", "policy"],
    "academic": ["paper", "thesis", "dissertation", "research", "journal", "academic"],
    "business": ["report", "presentation", "financial", "business", "corporate"],
    "structured": ["form", "invoice", "cv", "resume", "application", "questionnaire"],
    "narrative": ["article", "story", "book", "novel", "blog"],
}

# --- cleaning -----------------------------------------------------------------------------------

# Lines that are page furniture (matched without regard to case).
FURNITURE_LINES = [
    r"^\s*Page\s+\d+\s+(of|\/)\s+\d+\s*$",
    r"^\s*\d+\s*$",
    r"^[\-\=\_]{10,}$",
    r"^\s*Confidential\s*$",
    r"^\s*DRAFT\s*$",
    r"^\s*Copyright\s+©.*$",
    r"^\s*All\s+rights\s+reserved\s*$",
    r"^\s*Printed\s+on:.*$",
    r"^\s*Generated\s+on:.*$",
    r"^\s*Created\s+on:.*$",
    r"^\s*Modified\s+on:.*$",
    r"^\s*Date:\s+.*$",
    r"^\s*Time:\s+.*$",
]

# Bullets of private and general use, and what they become.
BULLETS = {"\uf0b7": "•", "\uf0a7": "•", "\u2022": "•", "\u2023": "•", "\u25e6": "◦", "\u2043": "⁃"}

# Characters replaced for display.
DISPLAY = {
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2033": '"', "\u201f": '"', "\u00ab": '"', "\u00bb": '"',
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u2032": "'", "\u2039": "'", "\u203a": "'",
    "\u2014": "-", "\u2013": "-", "\u2012": "-", "\u2015": "-",
    "\u2026": "...", "\u2022": "*", "\u00b7": ".", "\u00ae": "(R)", "\u2122": "(TM)", "\u00a9": "(c)", "\u2020": "+", "\u2021": "++",
    "\u00a7": "Section", "\u00b6": "Para",
    "\u00bf": "?", "\uff1f": "?", "\u2047": "??", "\u203d": "?!", "\u2048": "?!", "\u2049": "!?", "\u00a1": "!", "\uff01": "!",
    "\u037e": "?", "\u061f": "?", "\u2370": "?", "\u0294": "?", "\u0241": "?", "\u003f": "?",
    "\u20ac": "EUR", "\u00a3": "GBP", "\u00a5": "JPY", "\u20b9": "INR", "\u20bd": "RUB", "\u20b4": "UAH", "\u20a9": "KRW",
    "\u00b1": "+/-", "\u2264": "<=", "\u2265": ">=", "\u2260": "!=", "\u221e": "inf", "\u221a": "sqrt", "\u2211": "sum",
    "\u220f": "prod", "\u2202": "d", "\u222b": "int", "\u2248": "~=", "\u2261": "===", "\u225c": "=def", "\u221d": "prop",
    "\u2190": "<-", "\u2192": "->", "\u2191": "^", "\u2193": "v", "\u2194": "<->", "\u21d2": "=>", "\u21d0": "<=", "\u21d4": "<=>",
    "\u00a0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\u2007": " ", "\u2008": " ", "\u2009": " ",
    "\u200a": " ", "\u202f": " ", "\u205f": " ", "\u3000": " ",
    "\ufffd": "?", "\u2bd1": "?",
}

# Sequences around question marks that are replaced before single characters.
QUESTION_SEQUENCES = [("\u2026?", "?"), ("\u2026??", "??"), ("\ufffd?", "??"), ("?\ufffd", "??")]
QUESTION_LIKE = "[\u037e\u061f\u2047\u2048\u2049\u3008\u3009\u0294\u0241]"
ZERO_WIDTH = "[\u200b-\u200f\u2060-\u206f]"

# --- metadata -----------------------------------------------------------------------------------

# Dates in the order they are tried.
MONTH = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?"
    "|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
DATES = [
    r"\b" + MONTH + r"\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\bDate:?\s*\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b",
    r"\bDate:?\s*[A-Za-z]+\s+\d{1,2},?\s+\d{4}\b",
    r"(?:Copyright|©|Copyright\s+©)\s+(?:\d{4})",
    r"(?:Copyright|©|Copyright\s+©)(?:\s+\d{4}[-—]\d{4})",
    r"(?:Published|First published|Publication date):?\s*(?:in)?\s*(\d{4})",
    r"(?:printed|reprinted|printing)\s+(?:in)?\s*(\d{4})",
    r"^\s*(\d{4})\s*$",
]

# Labelled titles, authors and publishers.
TITLE_LABELS = [
    r"^(?:TITLE|Title|SUBJECT|Subject):\s*(.*?)$",
    r"^(?:REPORT|Report)\s+(?:TITLE|Title):\s*(.*?)$",
    r"^(?:DOCUMENT|Document)\s+(?:TITLE|Title):\s*(.*?)$",
    r"^\s*([A-Z][A-Za-z0-9\s'\":]+)(?:\n\s*|\s+)(?:by|di|BY|DI)\s+([A-Z][A-Za-z\s.]+)",
    r"^\s*([A-Z][A-Z0-9\s'\":]{10,50})\s*$",
]
TITLE_AUTHORS = [
    r"^\s*([A-Z][A-Za-z0-9\s'\":,-]+)(?:\n\s*)(?:by|di|BY|DI|by:)\s+([A-Z][A-Za-z\s.,-]+)",
    r"^\s*([A-Z][A-Za-z0-9\s'\":,-]+)(?:\s+)(?:by|di|BY|DI|by:)\s+([A-Z][A-Za-z\s.,-]+)",
    r"^\s*([A-Z][A-Za-z0-9\s'\":,-]+)\n\s*(?:by|di|BY|DI|by:)\s+([A-Z][A-Za-z\s.,-]+)",
    r"^\s*([A-Z][A-Za-z0-9\s'\":,-]{10,100})\n\s*([A-Z][A-Za-z\s.,-]{5,50})$",
]
AUTHORS = [
    r"^(?:AUTHOR|Author|BY|By|PREPARED BY|Prepared by):\s*(.*?)$",
    r"^(?:AUTHORS|Authors):\s*(.*?)$",
    r"^(?:WRITTEN BY|Written by):\s*(.*?)$",
    r"(?:by|di|BY|DI)\s+([A-Z][A-Za-z\s.]+)",
    r"(?:^|\n)\s*([A-Z][A-Za-z\s.-]+)(?=\n)",
]
PUBLISHERS = [
    r"(?:Published by|Publisher|PUBLISHER):\s*(.*?)(?:\n|$)",
    r"(?:Copyright|©)\s+[\d]{4}[^\n]*?by\s+(.*?)(?:\n|$)",
    r"((?:\w+\s+)(?:Press|Publications|Publishing|Books|Media))",
]

# Keywords of topics.
TOPICS = {
    "technical": ["technical", "specification", "manual", "guide", "documentation", "user guide", "reference"],
    "legal": ["legal", "contract", "agreement", "terms", "conditions", "policy", "regulation", "law", "compliance"],
    "financial": ["financial", "budget", "cost", "revenue", "expense", "profit", "loss", "balance", "account", "finance", "banking"],
    "academic": ["research", "study", "analysis", "thesis", "dissertation", "journal", "paper", "academic", "scientific"],
    "business": ["business", "marketing", "sales", "customer", "product", "service", "strategy", "management", "operation"],
    "report": ["report", "summary", "overview", "analysis", "review", "assessment", "evaluation"],
    "presentation": ["presentation", "slide", "deck", "overview", "briefing"],
    "book": ["book", "novel", "chapter", "author", "publisher", "publication", "copyright", "edition", "preface", "foreword"],
    "music": ["music", "musician", "jazz", "piano", "improvisation", "performance", "mastery", "practice", "technique", "composition"],
    "educational": ["course", "lesson", "learning", "education", "teaching", "curriculum", "student", "instruction", "training", "workshop"],
    "medical": ["patient", "clinical", "medical", "health", "treatment", "diagnosis", "therapy", "healthcare", "doctor", "hospital"],
    "scientific": ["experiment", "laboratory", "science", "hypothesis", "data", "methodology", "finding", "observation", "result", "measurement"],
    "magazine": ["magazine", "article", "issue", "editorial", "column", "feature", "publication", "periodical", "monthly", "quarterly"],
    "newspaper": ["newspaper", "news", "daily", "journalist", "reporter", "headline", "press", "media", "coverage", "article"],
    "biography": ["biography", "memoir", "autobiography", "life", "journey", "personal", "experience", "story", "narrative", "historical"],
    "fiction": ["fiction", "novel", "story", "character", "plot", "narrative", "chapter", "scene", "dialogue", "protagonist"],
    "poetry": ["poetry", "poem", "verse", "stanza", "rhyme", "lyric", "sonnet", "meter", "poet", "poetic"],
    "cookbook": ["recipe", "cooking", "ingredient", "dish", "meal", "cuisine", "chef", "food", "preparation", "kitchen"],
    "travel": ["travel", "destination", "journey", "guide", "tourism", "location", "itinerary", "adventure", "exploration", "trip"],
    "self_help": ["self-help", "development", "improvement", "motivation", "success", "growth", "inspiration", "advice", "guide", "technique"],
    "religious": ["religious", "spiritual", "faith", "belief", "prayer", "worship", "sacred", "divine", "scripture", "theology"],
    "comic": ["comic", "graphic novel", "illustration", "panel", "cartoon", "superhero", "manga", "anime", "sequential art", "strip"],
}

# Terms whose density marks technical writing.
TECHNICAL_DENSITY = [
    "algorithm", "function", "parameter", "component", "interface",
    "specification", "configuration", "implementation", "module", "version",
    "biblioteca", "algoritmo", "funzione", "parametro", "componente",
    "interfaccia", "specifica", "configurazione", "implementazione", "modulo",
]

# --- segments -----------------------------------------------------------------------------------

# What a header looks like, by format and by language.
HEADERS = [
    r"^(?:\d+\.)?\s*[A-Z][A-Z\s]+$",
    r"^(?:\d+\.)*\d+\s+[A-Z][a-zA-Z\s]+$",
    r"^(?:\d+[\.\-])+\s*[A-Z]",
    r"^[A-Z][A-Za-z\s]{2,20}$",
    r"^(?:[A-Z]{1,2}|[IVX]+)\.(?:[A-Z]{1,2}|[IVX]+)\.",
    r"^[A-Z][a-z]+\s+\d+\s*[:.]\s*[A-Z][a-zA-Z\s]+$",
    r"^(?:Chapter|Section|Part|Appendix)\s+[IVXLCDM]+\s*[:.]\s*[A-Z][a-zA-Z\s]+$",
    r"^[A-Z][a-z]+ \d{1,2}$",
    r"^(?:Capitolo|Sezione|Parte|Appendice)\s+[IVXLCDM\d]+\s*[:.]\s*.+$",
    r"^(?:Figura|Tabella) \d{1,2}$",
    r"^(?:Capítulo|Sección|Parte|Apéndice)\s+[IVXLCDM\d]+\s*[:.]\s*.+$",
    r"^(?:Figura|Tabla) \d{1,2}$",
    r"^(?:Chapitre|Section|Partie|Annexe)\s+[IVXLCDM\d]+\s*[:.]\s*.+$",
    r"^(?:Figure|Tableau) \d{1,2}$",
    r"^(?:Kapitel|Abschnitt|Teil|Anhang)\s+[IVXLCDM\d]+\s*[:.]\s*.+$",
    r"^(?:Abbildung|Tabelle) \d{1,2}$",
    r"^(?:Capítulo|Seção|Parte|Apêndice)\s+[IVXLCDM\d]+\s*[:.]\s*.+$",
    r"^(?:Figura|Tabela) \d{1,2}$",
    r"^(?:Hoofdstuk|Rozdział|Kapittel|Κεφάλαιο|Luku|Capitol|Fejezet|Kapitola)\s+[\dIVX]+\s*[:.]\s*.+$",
    r"^(?:Afbeelding|Rysunek|Figur|Εικόνα|Kuva|Imagine|Ábra|Obrázek)\s+\d+$",
    r"^[\d\.\-]+\s+[A-ZÀÁÈÉÌÍÒÓÙÚÄËÏÖÜŸÂÊÎÔÛÇÑ]",
    r"^[A-ZÀÁÈÉÌÍÒÓÙÚÄËÏÖÜŸÂÊÎÔÛÇÑ][a-zàáèéìíòóùúäëïöüÿâêîôûçñ\s]{2,25}$",
]

# Words that open headers of the first and the second level.
LEVEL_1 = [
    "Chapter", "CHAPTER", "Section", "SECTION", "Capitolo", "CAPITOLO", "Sezione", "SEZIONE", "Capítulo", "CAPÍTULO", "Sección",
    "SECCIÓN", "Chapitre", "CHAPITRE", "Kapitel", "KAPITEL", "Abschnitt", "ABSCHNITT", "Seção", "SEÇÃO",
]
LEVEL_2 = [
    "Subsection", "SUBSECTION", "Part", "PART", "Sottosezione", "SOTTOSEZIONE", "Parte", "PARTE", "Subsección", "SUBSECCIÓN",
    "Sous-section", "SOUS-SECTION", "Partie", "PARTIE", "Unterabschnitt", "UNTERABSCHNITT", "Teil", "TEIL", "Subseção", "SUBSEÇÃO",
]
LEVEL_1_OTHER = ["Hoofdstuk", "Rozdział", "Kapittel", "Κεφάλαιο", "Luku", "Capitol", "Fejezet", "Kapitola"]

# Titles of tables of contents.
TOC_TITLES = [
    r"^(?:Table\s+of\s+Contents|Contents|Index)$",
    r"^(?:Indice|Sommario|Contenuti|Indice\s+generale|Indice\s+analitico|Indice\s+degli\s+argomenti)$",
    r"^(?:Índice|Índice\s+general|Tabla\s+de\s+contenidos|Contenidos|Sumario)$",
    r"^(?:Table\s+des\s+matières|Sommaire|Index|Table\s+des\s+contenus)$",
    r"^(?:Inhaltsverzeichnis|Inhalt|Index|Stichwortverzeichnis)$",
    r"^(?:Índice|Sumário|Conteúdo|Tabela\s+de\s+conteúdos)$",
    r"^(?:Inhoudsopgave|Inhoud|Index|Trefwoordenregister)$",
    r"^(?:Spis\s+treści|Indeks|Zawartość)$",
    r"^(?:Innehållsförteckning|Innehåll|Index|Sakregister)$",
    r"^(?:Indholdsfortegnelse|Indhold|Indeks|Stikordsregister)$",
    r"^(?:Πίνακας\s+περιεχομένων|Περιεχόμενα|Ευρετήριο)$",
    r"^(?:Sisällysluettelo|Sisältö|Hakemisto)$",
    r"^(?:Cuprins|Tabla\s+de\s+materii|Indice|Conținut)$",
    r"^(?:Tartalomjegyzék|Tartalom|Index|Tárgymutató)$",
    r"^(?:Obsah|Rejstřík|Obsah\s+knihy)$",
    r"^(?:INDICE|SOMMARIO|ÍNDICE|TABLE\s+OF\s+CONTENTS|CONTENTS|INDEX|INHALTSVERZEICHNIS|TABLA\s+DE\s+CONTENIDOS"
    r"|TABLE\s+DES\s+MATIÈRES|SUMÁRIO|SPIS\s+TREŚCI|OBSAH|CUPRINS|INHOUD|ΠΕΡΙΕΧΟΜΕΝΑ)$",
]

# Lines that are entries of a table of contents.
TOC_ENTRIES = [
    r"^\s*(?:\d+\.)*\d+\s+.+\s+\d+\s*$",
    r"^\s*(?:\d+[\.\-])*\d+[\.\-]\s+.+\s+\d+\s*$",
    r"^.+\s+\.{2,}\s+\d+\s*$",
    r"^.+\s+[\.\-_]{2,}\s+\d+\s*$",
    r"^.+\s+\d+\s*$",
    r"^.+\s+[Ss]eite\s+\d+\s*$",
    r"^.+\s+[Pp]age\s+\d+\s*$",
    r"^.+\s+[Pp]ágina\s+\d+\s*$",
    r"^.+\s+[Pp]agina\s+\d+\s*$",
    r"^.+\s+[Pp]\.?\s+\d+\s*$",
    r"^\s*(?:[IVX]+|[A-Z])\.\s+.+\s+\d+\s*$",
    r"^\s*(?:[IVX]+|[A-Z])[\.\-]\s+.+\s+\d+\s*$",
    r"^\s*[A-Z](?:[IVX]+|[0-9]+)\.\s+.+\s+\d+\s*$",
    r"^\s*[\[\(](?:\d+|[A-Z]|[IVX]+)[\]\)]\s+.+\s+\d+\s*$",
    r"^\s*(?:Chapter|Chap\.|Ch\.|Section|Sect\.|Sec\.|Kapitel|Kap\.|Capítulo|Cap\.|Chapitre|Capitolo|Hoofdstuk)\s+[\dIVX]+\s*[:\.\-—–]\s*.+\s+\d+\s*$",
    r"^\s{2,}.+\s+\d+\s*$",
    r"^(?:\s{2,}|\t+|[»•◦▪‣◘○●·]+\s+).+\s+\d+\s*$",
    r"^.+\s+(?:страница|стр\.)\s+\d+\s*$",
    r"^.+\s+(?:strona|str\.)\s+\d+\s*$",
    r"^.+\s+(?:σελίδα|σελ\.)\s+\d+\s*$",
    r"^.+\s+oldal\s+\d+\s*$",
    r"^.+\s+(?:sivu|s\.)\s+\d+\s*$",
    r"^.+\s+(?:sida|s\.)\s+\d+\s*$",
    r"^.+\s+(?:strana|str\.)\s+\d+\s*$",
    r"^.+\s+(?:pagină|pag\.)\s+\d+\s*$",
    r"^[^\.]+(?:\.\d+)*(?:[\.\s]+|\s+)[^\d]+\s+\d+\s*$",
]

# Words by which the language of a table of contents is told.
TOC_LANGUAGES = {
    "en": ["contents", "index", "table of contents", "chapter", "section", "page"],
    "it": ["indice", "sommario", "contenuti", "capitolo", "sezione", "pagina"],
    "es": ["índice", "tabla de contenidos", "contenidos", "capítulo", "sección", "página"],
    "fr": ["table des matières", "sommaire", "chapitre", "section", "page"],
    "de": ["inhaltsverzeichnis", "inhalt", "kapitel", "abschnitt", "seite"],
    "pt": ["índice", "sumário", "conteúdo", "capítulo", "seção", "página"],
    "nl": ["inhoudsopgave", "inhoud", "hoofdstuk", "sectie", "pagina"],
    "pl": ["spis treści", "indeks", "rozdział", "sekcja", "strona"],
    "sv": ["innehållsförteckning", "innehåll", "kapitel", "avsnitt", "sida"],
    "da": ["indholdsfortegnelse", "indhold", "kapitel", "afsnit", "side"],
    "el": ["περιεχόμενα", "ευρετήριο", "κεφάλαιο", "ενότητα", "σελίδα"],
    "fi": ["sisällysluettelo", "sisältö", "luku", "kohta", "sivu"],
    "ro": ["cuprins", "conținut", "capitol", "secțiune", "pagină"],
    "hu": ["tartalomjegyzék", "tartalom", "fejezet", "szakasz", "oldal"],
    "cs": ["obsah", "rejstřík", "kapitola", "část", "strana"],
}

# --- spelling -----------------------------------------------------------------------------------

# Words that are left as they are (also capitalised or in capitals).
SKIP_TERMS = (
    "jazz blues rock swing folk bebop soul funk hip hop rap reggae punk metal techno disco pop band jam groove "
    "piano bass drum sax beat chord note scale tempo key major minor pitch rhythm tune staff score music solo duo "
    "trio quartet quintet sextet backing lead sharp flat "
    "software hardware app byte web cloud server router database python java html css xml json api http https url domain "
    "code script laptop desktop mobile tablet smartphone email wifi "
    "meeting team business manager leader design report staff board file test call link post blog week weekend day night time "
    "road street mail house store shop office back front side best good bad top down open close start stop free login "
    "google microsoft apple amazon facebook twitter instagram linkedin youtube spotify netflix zoom teams whatsapp telegram "
    "signal slack gmail outlook "
    "jpeg jpg png gif raw hdr iso frame pixel resolution format pdf doc docx ppt xlsx zip rar backup sync update install"
).split()

# Characters and what scans mistake them for.
SCAN_ERRORS = {
    "m": ["rn"], "h": ["li", "l1"], "n": ["ri"], "w": ["vv", "1/v"], "b": ["lo", "l0"], "d": ["cl", "ol"],
    "0": ["O", "o"], "1": ["l", "I"], "5": ["S", "s"], "8": ["B"], "B": ["8", "13"], "D": ["0"], "I": ["1", "l"],
    "O": ["0", "D"], "S": ["5"], "Z": ["2"],
    "à": ["a", "a'", "a`"], "è": ["e", "e'", "e`"], "é": ["e", "e'"], "ì": ["i", "i'", "i`"], "ò": ["o", "o'", "o`"],
    "ù": ["u", "u'", "u`"], "'": ["`", "´", "'"],
    "e": ["è", "é"], "a": ["à"], "i": ["ì", "í", "î"], "o": ["ò", "ó"], "u": ["ù", "ú"],
}
ITALIAN_MARKERS = ["della", "delle", "nella", "questo", "questa", "sono", "come", "però", "perché", "quindi"]
SCAN_LANGUAGES = {
    "eng": "en", "ita": "it", "fra": "fr", "deu": "de", "spa": "es", "por": "pt", "en": "en", "it": "it", "fr": "fr", "de": "de",
    "es": "es", "pt": "pt",
}
SPELLING_LANGUAGES = ["en", "fr", "es", "it", "de", "pt", "nl", "ru", "sv", "pl", "cs", "hu", "da", "no", "fi"]

# Names of languages in prompts.
LANGUAGE_NAMES = {
    "en": "English", "it": "Italian", "fr": "French", "de": "German", "es": "Spanish", "pt": "Portuguese", "nl": "Dutch",
    "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ar": "Arabic", "ko": "Korean",
}
