"""Document metadata as nullable columns: each is a chain of alternatives, the first that holds wins."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from folium.functions import fixed
from folium.functions.text import best_of, col, let, strip, word_count

MULTIMEDIA = "struct<figures:int,charts:int,has_av_references:boolean,has_urls:boolean,has_qr_codes:boolean>"
GENERIC_TITLES = ("untitled", "unnamed document", "document", "document1", "title", "unknown")
# Terms of sound and moving pictures.
AV_TERMS = [
    "video", "audio", "podcast", "mp3", "mp4", "wav", "avi", "youtube", "vimeo", "spotify", "soundcloud", "dvd", "cd-rom", "streaming",
]
DATE_KEYS = ["creationDate", "modDate", "date", "Date", "created", "modified"]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, stripped; null where there is none or it is blank."""
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def lines(text: Column, count: int) -> Column:
    """The first lines that are not blank, stripped."""
    return F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), 1, count)


#: Words of which a text that fits a pattern holds one, in small letters, by a part of the pattern: a search for words
#: is quicker than one for a pattern that few texts fit.
NEEDED = {
    "Date:?": ("date",), "Copyright|": ("copyright", "©"), "Published": ("publi",), "printed|": ("print",), "Press|": ("press", "publi", "books", "media"),
}


def if_needed(text: Column, pattern: str, value: Column, other: Column) -> Column:
    """``value`` where the text holds a word that the pattern needs (or it needs none that is known), else ``other``."""
    words = next((ws for part, ws in NEEDED.items() if part in pattern), None)
    if words is None:
        return value
    low = F.lower(text)
    return F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in words]), value).otherwise(other)


def title(text: Column | str, existing: Column | None = None, pdf_title: Column | None = None, html: Column | None = None,
          path: Column | None = None) -> Column:
    """Existing title, embedded title, page heading, labels, a title above or before its author, a line in capitals, a significant line, the file name."""
    body = col(text)
    none = F.lit(None).cast("string")
    given = existing if existing is not None else none
    sound = F.when((F.char_length(given) > 3) & (F.char_length(given) < 200) & ~F.lower(given).isin(*GENERIC_TITLES), given)
    source = html if html is not None else body
    heading = F.coalesce(found(source, r"(?is)<title[^>]*>(.*?)</title>"), found(source, r"(?is)<h1[^>]*>(.*?)</h1>"))
    listed = [found(F.substring(body, 1, 3000), "(?m)" + p) for p in fixed.TITLE_LABELS]
    # Three patterns are labels proper: they come before a title that is known by its author.
    labels, structures = F.coalesce(*listed[:3]), F.coalesce(*listed[3:])
    fits = lambda t: F.when((F.char_length(t) > 5) & (F.char_length(t) < 200), strip(F.regexp_replace(t, r"[.,;:]+$", "")))
    by_author = F.coalesce(*[let(found(F.substring(body, 1, 2000), "(?m)" + p), fits) for p in fixed.TITLE_AUTHORS])
    first_of = lambda xs, test: F.get(F.filter(xs, test), F.lit(0))
    from_lines = let(lines(body, 15), lambda top: F.coalesce(
        F.initcap(first_of(top, lambda x: F.char_length(x).between(10, 100) & F.regexp_like(x, F.lit(r"\p{L}")) & (F.upper(x) == x))),
        first_of(top, lambda x: F.char_length(x).between(10, 150) & (F.regexp_count(x, F.lit(r"\p{Lu}")) * 4 >= F.char_length(x))),
        first_of(F.slice(top, 1, 10), lambda x: F.char_length(x).between(10, 150)),
    ))
    place = path if path is not None else none
    stem = F.nullif(F.initcap(F.regexp_replace(F.regexp_extract(place, r"([^/]*?)(?:\.[^./]*)?$", 1), r"[_\-]+", " ")), F.lit(""))
    return F.coalesce(sound, pdf_title if pdf_title is not None else none, heading, labels, by_author, structures, from_lines, stem, F.lit("Unnamed Document"))


def author(text: Column | str, pdf_author: Column | None = None, path: Column | None = None) -> Column:
    """Embedded author, a name in the first lines, labels and by-lines, a name in the file name."""
    body = F.substring(col(text), 1, 10000)
    none = F.lit(None).cast("string")
    named = F.get(F.filter(lines(body, 5), lambda x: F.regexp_like(x, F.lit(r"^[A-Z][a-z]+ [A-Z][a-z]+")) & (F.char_length(x) < 60)), F.lit(0))
    fits = lambda a: F.when((F.char_length(a) > 2) & (F.char_length(a) < 100), a)
    patterns = F.coalesce(*[let(found(body, "(?m)" + p), fits) for p in fixed.AUTHORS])
    labelled = found(F.array_join(lines(body, 30), "\n"), r"(?im)^(?:author|written by|by)\s*[:\-]?\s+([A-Z][^\n]{2,60})$")
    stem = found(path if path is not None else none, r"([A-Z][a-z]+ [A-Z][a-z]+)(?: - [^/]*)?\.[A-Za-z]+$")
    return F.coalesce(pdf_author if pdf_author is not None else none, named, patterns, labelled, stem)


def publisher(text: Column | str) -> Column:
    body = F.substring(col(text), 1, 10000)
    listed = F.coalesce(*[if_needed(body, p, found(body, "(?im)" + p), F.lit(None).cast("string")) for p in fixed.PUBLISHERS])
    ending = F.get(F.filter(lines(body, 50), lambda x: F.regexp_like(x, F.lit(r"(?i)(press|publications|publishing|publishers|books|editore|edizioni)$"))), F.lit(0))
    return F.coalesce(listed, ending)


def parse_date(text: Column) -> Column:
    """A date from one of the forms dates are written in; ambiguous numbers are month first."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)^date:?\s*", ""), r"[/.]", "-")
    words = F.initcap(F.regexp_replace(plain, r"\s*,?\s+", " "))
    formats = ["yyyy-M-d", "M-d-yyyy", "d-M-yyyy", "M-d-yy", "d-M-yy"]
    year = F.regexp_extract(text, r"(\d{4})(?!.*\d{4})", 1)
    return F.coalesce(
        *[F.expr("CAST(NULL AS DATE)")],
        *[F.try_to_date(plain, f) for f in formats], F.try_to_date(words, "MMMM d yyyy"), F.try_to_date(words, "MMM d yyyy"),
        F.when(F.regexp_like(text, F.lit(r"^\D*(?:\d{4}[-—])?\d{4}\s*$")), F.make_date(F.nullif(year, F.lit("")).cast("int"), F.lit(1), F.lit(1))),
    )


def date(text: Column | str, as_of: Column, meta: Column | None = None, modified: Column | None = None) -> Column:
    """The first date after 1900 and not after ``as_of``: metadata keys, then patterns in order, then the file's."""
    body = F.substring(col(text), 1, 10000)
    every = lambda p: F.regexp_extract_all(body, F.lit("(?im)(" + p.replace("(\\d{4})", "(?:\\d{4})") + ")"), F.lit(1))
    whole = [if_needed(body, p, every(p), F.array().cast("array<string>")) for p in fixed.DATES]
    sound = lambda d: d.isNotNull() & (F.year(d) > 1900) & (d <= as_of)
    found_dates = F.get(F.filter(F.transform(F.concat(*whole), parse_date), sound), F.lit(0))
    keys = [parse_date(F.try_element_at(meta, F.lit(k))) for k in DATE_KEYS] if meta is not None else []
    last = [modified.cast("date")] if modified is not None else []
    return F.coalesce(*keys, found_dates, *last)


# Fixed value: an ISBN as the inventory has it, labelled or not.
ISBN = r"(?i)((?:ISBN(?:-10)?:?\s*)?(?:[\d-]{10,17})|(?:ISBN(?:-13)?:?\s*)?(?:97[89][\d-]{10,14}))"


def isbn(text: Column | str, labelled_first: bool = False) -> Column:
    """The first run of ten to seventeen digits and hyphens, labelled or not; label and separators taken out.

    With ``labelled_first`` a labelled one anywhere goes before loose ones, and a loose one must stand alone.
    """
    body = F.substring(col(text), 1, 10000)
    if not labelled_first:
        return F.regexp_replace(F.regexp_replace(found(body, ISBN), r"(?i)ISBN[-:\s]*", ""), r"[\-\s]", "")
    labelled = found(body, r"(?i)ISBN(?:-1[03])?:?\s*([\d][\d\-]{8,16}[\dXx])")
    loose = found(body, r"(?:^|[^\d\-])(\d[\d\-]{8,15}[\dXx])(?:[^\d\-]|$)")
    return F.regexp_replace(F.coalesce(labelled, loose), r"[\-\s]", "")


# In the inventory's order; what follows the last comment of a list is of our own.
EDITIONS = [
    r"(?i)(\d+(?:st|nd|rd|th)?\s+edition)", r"(?i)(edition:?\s*\d+(?:st|nd|rd|th)?)", r"(?i)(version\s*\d+\.\d+)", r"(?i)(v\.\s*\d+\.\d+)",
    r"(?i)(revised\s+edition)", r"(?i)(updated\s+edition)", r"(?i)(first\s+edition)", r"(?i)(second\s+edition)", r"(?i)(third\s+edition)",
    r"(?i)(fourth\s+edition)", r"(?i)(fifth\s+edition)",
    # Later ordinals, whole versions, Italian.
    r"(?i)\b((?:sixth|seventh|eighth|ninth|tenth)\s+edition)\b", r"(?i)\b(version\s+\d+)\b", r"(?i)\b(\d+[aª°]\s+edizione)\b",
]
SERIES = [
    # The third begins where a clause does: the same first match without trying every later start.
    r"(?i)(?:series|collection):\s*([^.,\n]+)", r"(?i)part\s+of\s+the\s+([^.,\n]+)\s+series",
    r"(?i)(?:^|[.,\n])([^.,\n]+)\s+series,?\s+(?:volume|book|part|vol\.)\s+\d+", r"(?i)vol\.\s+\d+\s+of\s+([^.,\n]+)",
    # Parts and books of a series, a series by its article.
    r"(?i)\b(?:part|volume|book)\s+\d+\s+of\s+(?:the\s+)?(.+?)(?:\n|\.|$)", r"(?i)\bthe\s+(.+?)\s+series\b",
]


def edition(text: Column | str) -> Column:
    return F.coalesce(*[found(F.substring(col(text), 1, 10000), p) for p in EDITIONS])


def series(text: Column | str) -> Column:
    return F.coalesce(*[F.regexp_replace(found(F.substring(col(text), 1, 10000), p), "(?i)^the ", "") for p in SERIES])


def multimedia(text: Column | str) -> Column:
    """Counts of figures and charts, and whether sound, links or codes are mentioned; null if nothing is."""
    body = col(text)
    low = F.lower(body)
    figures = F.regexp_count(body, F.lit(r"(?i)\bfig(?:ure)?\.?\s*\d+")).cast("int")
    charts = F.regexp_count(body, F.lit(r"(?i)\b(?:chart|graph|plot|diagram)\s*\d+")).cast("int")
    av = F.regexp_like(low, F.lit("|".join(AV_TERMS)))
    urls = F.regexp_like(body, F.lit(r"https?://|www\."))
    codes = F.contains(low, F.lit("qr code"))
    some = (figures > 0) | (charts > 0) | av | urls | codes
    return F.when(some, F.struct(figures.alias("figures"), charts.alias("charts"), av.alias("has_av_references"), urls.alias("has_urls"), codes.alias("has_qr_codes")))


def kind_histogram(kinds: Column) -> Column:
    """map of how often each kind (of image, of segment) occurs in an array."""
    return F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


def topics(text: Column | str, title_text: Column | None = None, isbn_text: Column | None = None, publisher_text: Column | None = None,
           vocabulary: dict[str, list[str]] | None = None, least: int = 2) -> Column:
    """Topics of which the title holds a keyword or the text two; a book for an ISBN, a publication for a publisher."""
    low = F.lower(F.substring(col(text), 1, 10000))
    head = F.lower(F.coalesce(title_text, F.lit(""))) if title_text is not None else F.lit("")
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.array(*[F.lit(w) for w in words]).alias("words")) for name, words in (vocabulary or fixed.TOPICS).items()
    ])
    holds = lambda t, z: F.exists(t["words"], lambda w: F.contains(z["head"], w)) | (
        F.size(F.filter(t["words"], lambda w: F.contains(z["low"], w))) >= least)
    names = let(F.struct(head.alias("head"), low.alias("low")), lambda z: F.transform(F.filter(table, lambda t: holds(t, z)), lambda t: t["name"]))
    extra = []
    if isbn_text is not None:
        extra.append(F.when(isbn_text.isNotNull(), F.array(F.lit("book"))).otherwise(F.array().cast("array<string>")))
    if publisher_text is not None:
        extra.append(F.when(publisher_text.isNotNull(), F.array(F.lit("publication"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(names, *extra)) if extra else names


#: Frequent function words by which a language is voted for.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was"],
    "de": ["der", "die", "und", "das", "den", "von", "ist", "nicht", "für", "mit"],
    "fr": ["le", "les", "des", "et", "est", "une", "du", "que", "dans", "pour"],
    "es": ["el", "los", "las", "que", "del", "una", "por", "con", "para", "su"],
    "it": ["il", "di", "che", "la", "gli", "della", "per", "non", "sono", "con"],
    "pt": ["os", "uma", "não", "para", "com", "dos", "mais", "como", "mas", "ao"],
}


def language(text: Column | str, vocabulary: dict[str, list[str]] | None = None, shortest: int = 50) -> Column:
    """The language of most function words; null under ``shortest`` characters or without any."""
    body = col(text)
    tokens = F.regexp_extract_all(F.lower(body), F.lit(r"(\p{L}+)"), F.lit(1))
    count = lambda t, words: F.size(F.filter(t, lambda x: x.isin(*words)))
    known = sorted({w for words in (vocabulary or STOP_WORDS).values() for w in words})
    tokens = F.filter(tokens, lambda x: x.isin(*known))
    best = let(tokens, lambda t: best_of([(lang, count(t, words)) for lang, words in (vocabulary or STOP_WORDS).items()]))
    return F.when(F.char_length(strip(body)) >= shortest, let(best, lambda b: F.when(b["score"] > 0, b["name"])))


def spelling_language(text: Column | str, scan_language: Column | None = None) -> Column:
    """The scan's language if given, else the text's; Italian if three of ten Italian words occur, else English."""
    detected = language(text)
    low = F.lower(F.substring(col(text), 1, 8000))
    markers = sum((F.contains(low, F.lit(w)).cast("int") for w in fixed.ITALIAN_MARKERS[1:]), F.contains(low, F.lit(fixed.ITALIAN_MARKERS[0])).cast("int"))
    fallback = F.when(markers >= 3, "it").otherwise("en")
    own = F.when(detected.isin(*fixed.SPELLING_LANGUAGES), detected).otherwise(fallback)
    if scan_language is None:
        return own
    table = F.create_map(*[F.lit(x) for pair in fixed.SCAN_LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.get(F.split(scan_language, r"\+"), F.lit(0))), own)


def statistics(text: Column | str) -> Column:
    body = col(text)
    return F.struct(word_count(body).alias("word_count"), F.char_length(body).cast("long").alias("char_count"))


def extract_metadata(text: Column | str, as_of: Column, path: Column | None = None, html: Column | None = None, modified: Column | None = None) -> Column:
    """All fields of a document's metadata in one struct."""
    t, i, p = title(text, path=path, html=html), isbn(text), publisher(text)
    return F.struct(
        t.alias("title"), author(text, path=path).alias("author"), date(text, as_of, modified=modified).alias("date"), language(text).alias("language"),
        p.alias("publisher"), i.alias("isbn"), edition(text).alias("edition"), series(text).alias("series"),
        topics(text, t, i, p).alias("topics"), word_count(text).alias("word_count"), F.char_length(col(text)).cast("long").alias("char_count"),
        multimedia(text).alias("multimedia"),
    )


