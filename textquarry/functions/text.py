"""Text normalisation, tokens and small text rules as Column expressions.

Search text is the comparison form of Persian and Latin text: letter variants and digits
folded, marks removed, everything outside the token alphabet turned into one blank, lower
case.  Display text keeps punctuation and line structure.  Both are for text in NFKC: raw
text goes through ``nfkc`` first, once, where it enters (pages, documents, questions).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: folded letters and digits; tatweel and direction marks have no partner and go
FOLD_FROM = "يىئكةۀؤ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹\u200a\u202f\u0640\u200e\u200f"
FOLD_TO = "یییکههو01234567890123456789  "
# fixed values: marks, what search text keeps, tokens
MARKS = "[\u064b-\u065f\u0670\u06d6-\u06ed]"
SEARCHABLE = "[0-9A-Za-z\u0600-\u06ff+\\-.]+"
TOKEN = "[0-9A-Za-z\u0600-\u06ff]+(?:[+\\-.][0-9A-Za-z\u0600-\u06ff]+)*"
SENTENCE_END = "(?<=[.!\u061f?\u061b])\\s+"

SPACE = "[\\s\\x0B\\x1C-\\x1F\\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# white space other than single blanks and line ends, and what parts lines beside the line end.  Plain strings: searching for
# them takes a fraction of what a class of several ranges takes, which regular expressions test one after the other
UNEVEN = ("\r", "\t", "\f", "\x0b", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u00a0", "  ", "\n\n", " \n", "\n ")
BREAKS = ("\f", "\x0b", "\x1c", "\x1d", "\x1e", "\x85")
# all letters, digits, marks and blanks that folding is about lie outside of this range
WESTERN = "[^\\x00-\u05ff]"
WESTERN_TOKEN = "\\p{Alnum}++(?:[+\\-.]\\p{Alnum}++)*+"
LINE_BREAK = "[\\n\\x0B\\f\\x1C-\\x1E\\x85\u2028\u2029]"


# characters that the compatibility form leaves as they are, alone and beside each other: ASCII, Latin letters, usual
# quotation marks and dashes, Arabic and Persian letters and digits without marks
STABLE = (
    "\\x00-\\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    "\u060c\u061b\u061f\u0621-\u063a\u0640-\u064a\u0660-\u0669\u067e\u0686\u0698\u06a9\u06af\u06cc\u06f0-\u06f9\u200c\u200d\u2010\u2013\u2014\u2018-\u201f"
)


def nfkc(c: Column) -> Column:
    """Text in Unicode's compatibility form (null: empty), by the normaliser that Spark's collations bring along.

    Most texts have only characters that stay as they are; those are not sent there.  ASCII, which
    the long class is slow on, is passed over before the rest is looked at.
    """
    text = F.coalesce(c, F.lit(""))
    full = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    changes = text.rlike("[^\\x00-\\x7f]") & F.regexp_replace(text, "[\\x00-\\x7f]+", "").rlike(f"[^{STABLE}]")
    return F.when(changes, full).otherwise(text)


def strip(c: Column, extra: str = "") -> Column:
    """Without leading and trailing Unicode white space (and the characters of ``extra``)."""
    s = f"(?:{SPACE}|[{extra}])" if extra else SPACE
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    # most texts have nothing to take off; looking for it goes through the whole of them
    return F.when(ends.rlike(s), _stripped(c, s)).otherwise(c)


def _stripped(c: Column, s: str = SPACE) -> Column:
    return F.regexp_replace(c, f"^{s}+|{s}+$", "")


def fold(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), FOLD_FROM, FOLD_TO)


def _western(c: Column) -> Column:
    """Whether a text (not null) has nothing to fold and no marks; quick to find out."""
    return (F.length(c) == F.octet_length(c)) | ~c.rlike(WESTERN)


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(x)) for x in parts])


def _plain(c: Column) -> Column:
    """Whether a text (not null) has nothing to fold, no marks and no letter whose lower case has a Latin one in it."""
    return _western(c) & ~F.contains(c, F.lit("\u0130"))


def normalize_display(c: Column) -> Column:
    """Readable text: folded, runs of blanks squeezed, lines stripped, empty lines dropped.

    Most texts need none of this; looking for what would change costs a fraction of changing it.
    """
    c = F.coalesce(c, F.lit(""))
    return F.when(_western(c) & ~_any(c, UNEVEN), strip(c)).otherwise(_displayed(c))


def _displayed(c: Column) -> Column:
    t = F.regexp_replace(fold(c), "\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " ")
    return _stripped(F.regexp_replace(t, f"{SPACE}+\n{SPACE}*|\n{SPACE}+", "\n"))


def _comparable(c: Column) -> Column:
    """Folded, without marks, Latin letters in lower case; separators are still what they were."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), upper + FOLD_FROM, upper.lower() + FOLD_TO), MARKS, "")


def normalize_search(c: Column) -> Column:
    """Comparison form: one line of tokens and stray ``+ - .`` between single blanks.

    What stays is collected; replacing what goes, by a negated class, takes ten times as long.
    """
    c = F.coalesce(c, F.lit(""))
    western = F.lower(F.array_join(F.regexp_extract_all(c, F.lit("[\\p{Alnum}+\\-.]++"), F.lit(0)), " "))
    return F.when(_plain(c), western).otherwise(F.array_join(F.regexp_extract_all(_comparable(c), F.lit(SEARCHABLE), F.lit(0)), " "))


def tokenize(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    western = F.regexp_extract_all(F.lower(c), F.lit(WESTERN_TOKEN), F.lit(0))
    return F.when(_plain(c), western).otherwise(F.regexp_extract_all(_comparable(c), F.lit(TOKEN), F.lit(0)))


def tokens_of_search(c: Column) -> Column:
    """Tokens of text that is in comparison form already."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(_western(c), F.regexp_count(c, F.lit(WESTERN_TOKEN))).otherwise(F.regexp_count(_comparable(c), F.lit(TOKEN)))


def lines(c: Column) -> Column:
    return F.when(_western(c) & ~_any(c, BREAKS), F.split(c, "\n")).otherwise(F.split(c, LINE_BREAK))


def is_number(c: Column) -> Column:
    return c.rlike("^[0-9۰-۹٠-٩]+$")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` where ``c`` is worked out once, however often ``f`` looks at it: a plain column is written out each time."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))  # a function of one argument, whatever f takes besides


def clean_page_text(c: Column, book_page: Column) -> Column:
    """Display text without the line that is just the printed page number."""
    printed = lambda x: F.coalesce(is_number(x) & (F.length(x) < 10) & (x.try_cast("int") == book_page), F.lit(False))
    kept = once(once(c, normalize_display), lambda d: F.filter(lines(d), lambda x: ~printed(x)))
    return once(F.array_join(kept, "\n"), strip)


def section_heading(display: Column, chapter_title: Column) -> Column:
    """The first of the leading twelve lines that reads like a heading, or null."""
    heads = F.transform(F.slice(lines(display), 1, 12), lambda x: F.regexp_replace(x, "^[ .…]+|[ .…]+$", ""))
    bare = lambda x: F.translate(x, "،", "")

    def fits(x: Column) -> Column:
        usable = (x != "") & (F.length(x) <= 90) & ~is_number(x)
        named = F.contains(x, F.lit("فصل")) | F.contains(bare(x), bare(chapter_title))
        short = (F.regexp_count(x, F.lit(r"\S+")) <= 8) & ~x.rlike("[.!؟?!؛:]$") & ~x.rlike("[=+×÷<>]")
        return usable & (named | short)

    return F.get(F.filter(heads, fits), F.lit(0))


# fixed values: pages of the one book whose printed numbering is known, and its chapters
BOOK_WITH_CHAPTERS = "c110210"
CHAPTERS = [
    (1, 10, "front", "بخش آغازین"),
    (11, 54, "chapter-1", "کیهان، زادگاه الفبای هستی"),
    (55, 100, "chapter-2", "ردپای گازها در زندگی"),
    (101, 143, "chapter-3", "آب، آهنگ زندگی"),
    (144, 148, "glossary", "واژه نامه"),
    (149, 149, "references", "منابع"),
    (150, 150, "back", "پشت جلد"),
]
PAGES_WITHOUT_TEXT = [1, 3, 4, 5, 6, 7, 8, 9, 10, 150]


def printed_page(book_id: Column, pdf_page: Column) -> Column:
    known = F.when(pdf_page.between(11, 149), pdf_page - 10)
    return F.when(F.lower(book_id) == BOOK_WITH_CHAPTERS, known).otherwise(pdf_page)


def needs_review(characters: Column, pdf_page: Column) -> Column:
    return (characters < 80) & ~pdf_page.isin(PAGES_WITHOUT_TEXT)


def content_type(c: Column) -> Column:
    # fixed values: key words of the kinds of text
    return (
        F.when(c.rlike("خود را بیازمایید|تمرین|پرسش"), "exercise")
        .when(c.rlike("جدول|نمودار"), "table_or_chart")
        .when(c.rlike("شکل|تصویر") & (F.length(c) < 500), "caption")
        .otherwise("prose")
    )


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda x: strip(x)), lambda x: x != "")


def persian_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", "۰۱۲۳۴۵۶۷۸۹")


def sorted_pages(pages: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))


def citation_label(title: Column, pages: Column) -> Column:
    """Title and printed pages in Persian digits; the bare title where no page is known."""
    p = sorted_pages(pages)
    text = F.array_join(F.transform(p, lambda x: persian_digits(x.cast("string"))), "، ")
    word = F.when(F.size(p) == 1, F.lit("صفحه")).otherwise(F.lit("صفحه\u200cهای"))
    return F.when(F.size(p) > 0, F.concat(title, F.lit("، "), word, F.lit(" "), text)).otherwise(title)


def citation_id(book_id: Column, parent_id: Column) -> Column:
    return F.when(F.startswith(parent_id, F.concat(book_id, F.lit(":"))), parent_id).otherwise(F.concat(book_id, F.lit(":"), parent_id))


def numbered_id(book_id: Column, kind: str, number: Column) -> Column:
    return F.format_string(f"%s:{kind}-%04d", book_id, number)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_key(model: Column, question: Column, passage: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\u001f"), question, F.lit("\u001f"), passage), 256)


def slug(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(t == "", F.lit("model")).otherwise(t)


# fixed values: image types that a data URL may carry
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif"}


def image_data_url(path: Column, content: Column) -> Column:
    """A data URL for a picture file, null for other files."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair])
    kind = F.try_element_at(kinds, ending)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def is_image_data_url(c: Column) -> Column:
    head = c.rlike(r"^data:image/(?:png|jpeg|webp|gif);base64,")
    body = F.regexp_replace(c, r"^[^,]*,", "")
    return head & body.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")


# fixed values: the character references that built-in replacement decodes, the ampersand last
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def html_to_text(c: Column) -> Column:
    """Display text of a page: scripts, styles, comments and tags dropped, references decoded."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|li|h[1-6]|tr|article|nav|footer|ul|title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, value in REFERENCES:
        t = F.replace(t, F.lit(name), F.lit(value))
    return normalize_display(t)
