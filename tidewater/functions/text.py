"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
_SPACE = r"[\s\p{Z}\x1C-\x1F\x85]+"
# Folded phrases that ask for fresh news.
FRESH_HINTS = ("hom nay", "moi nhat", "moi", "vua", "vua xay ra", "dang", "truc tiep", "nong", "breaking", "sang nay", "chieu nay", "toi nay", "tuan nay", "live")


def _fold_map() -> tuple[str, str]:
    """Letters that lose a combining mark and become one letter, by Unicode decomposition; and d with stroke."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


#: The letters that fold() replaces, and by what.
FOLDED = _FROM, _TO = _fold_map()


_MARK = r"\p{M}"
# Combining marks below a letter come before those above it in the canonical order.
_ABOVE, _BELOW = "[\u0300-\u0314\u033d-\u0344\u0346\u034a-\u034c]", "[\u031b\u0323-\u0328\u032d-\u0331]"


def _compositions() -> list[tuple[str, str]]:
    """Letter with a mark and the one letter that they make, by Unicode; shorter compositions first."""
    found = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and all(len(x) == 4 for x in parts) and unicodedata.normalize("NFC", chr(code)) == chr(code):
            found.append(("".join(chr(int(x, 16)) for x in parts), chr(code)))
    return sorted(found, key=lambda p: len(unicodedata.normalize("NFD", p[1])))


_COMPOSED = _compositions()


def compose(x: Column) -> Column:
    """Canonical composition of letters and their marks. Only texts that hold a combining mark are walked through, and
    then only for the pairs of letter and mark that occur in them."""
    table = F.array(*(F.struct(F.lit(a).alias("apart"), F.lit(b).alias("one")) for a, b in _COMPOSED))

    def of(text: Column) -> Column:
        ordered = F.regexp_replace(F.regexp_replace(text, f"({_ABOVE}+)({_BELOW}+)", "$2$1"), f"({_ABOVE}+)({_BELOW}+)", "$2$1")
        return F.aggregate(table, ordered, lambda t, pair: F.replace(t, pair["apart"], pair["one"]))

    return F.when(x.rlike(_MARK), F.element_at(F.transform(F.array(x), of), 1)).otherwise(x)


def fold(x: Column) -> Column:
    """Without diacritics, composed or combining; case stays. Plain ASCII text, which translate() would walk letter by
    letter, passes as it is."""
    plain = F.regexp_replace(F.translate(x, _FROM, _TO), _MARK, "")
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(plain)


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, f"^{_SPACE}|{_SPACE}$", "")


def normalize(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(compose(x)), _SPACE, " "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(compose(x)), F.lit(TOKEN), F.lit(0))


def folded_tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(F.lower(x)), F.lit(TOKEN), F.lit(0))


def has_tag(x: Column) -> Column:
    return x.rlike(r"<!--|</?[A-Za-z][^>]*>")


_NAMED = {name: chr(code) for name, code in html.entities.name2codepoint.items() if name != "amp"} | {"apos": "'"}


def unescape(x: Column) -> Column:
    """Named and numeric character references, each once: `&amp;lt;` becomes `&lt;`. The ampersand comes last, therefore;
    names that are not known and numbers of no character, or of a control character, stay."""
    named = F.create_map(*(F.lit(v) for pair in _NAMED.items() for v in pair))

    def char(ref: Column) -> Column:
        code = F.when(ref.rlike("^#[0-9]+$"), F.conv(F.substring(ref, 2, 9), 10, 10)).when(ref.rlike("^#[xX][0-9A-Fa-f]+$"), F.conv(F.substring(ref, 3, 9), 16, 10)).cast("long")
        fine = code.between(32, 0x10FFFF) & ~code.between(0x7F, 0x9F) & ~code.between(0xD800, 0xDFFF) & (code != 38)
        return F.coalesce(named[ref], F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))

    def of(text: Column) -> Column:
        refs = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit("&(#?[A-Za-z0-9]{1,9});"), F.lit(1))), lambda r: char(r).isNotNull())
        return F.aggregate(refs, text, lambda t, r: F.replace(t, F.concat(F.lit("&"), r, F.lit(";")), char(r)))

    # An array of one evaluates x once.
    return F.regexp_replace(F.element_at(F.transform(F.array(x), of), 1), "&(amp|#38|#[xX]26);", "&")


def clean_html(x: Column) -> Column:
    """Scripts, styles and comments go, block tags become line breaks and other tags spaces; then entities are resolved,
    white space collapses within lines, and blank lines go. Text without tags is only trimmed."""
    y = F.regexp_replace(x, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    y = F.regexp_replace(y, r"(?s)<!--.*?-->", " ")
    y = F.regexp_replace(y, r"(?i)</?(?:p|div|br)\b[^>]*>", "\n")
    y = F.regexp_replace(y, r"(?s)</?[A-Za-z!][^>]*>", " ")
    y = unescape(y)
    lines = F.transform(F.split(y, r"[\n\r]+"), lambda line: F.trim(F.regexp_replace(line, _SPACE, " ")))
    return F.when(has_tag(x), F.array_join(F.filter(lines, lambda line: line != ""), "\n")).otherwise(strip(x))


def strip_or_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def parse_published_at(x: Column) -> Column:
    """ISO 8601, a date alone included, to a UTC instant; without an offset the time is at +07:00; null if it is neither."""
    plain = strip(x)
    whole = F.when(plain.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(plain, F.lit("T00:00:00"))).otherwise(plain)
    zoned = whole.rlike(r"(Z|[+-]\d\d:?\d\d)$") & whole.rlike("[T ]")
    return F.when(zoned, F.try_to_timestamp(whole)).otherwise(F.try_to_timestamp(F.concat(whole, F.lit("+07:00"))))


def fresh_intent(x: Column) -> Column:
    """The folded text names one of FRESH_HINTS as whole words; "moi" not before "truong"."""
    hints = "|".join(h if h != "moi" else r"moi(?!\s+truong)" for h in sorted(FRESH_HINTS, key=len, reverse=True))
    return fold(F.lower(x)).rlike(rf"\b(?:{hints})\b")


def variant(x: Column) -> Column:
    """A or B by the parity of the md5 of the text."""
    return F.when(F.conv(F.substring(F.md5(x), 32, 1), 16, 10).cast("int") % 2 == 1, "B").otherwise("A")


def shingles(x: Column, n: int = 3) -> Column:
    """Different runs of n folded tokens; fewer tokens are one run, none is none."""
    t = F.transform(F.array(folded_tokens(x)), lambda t: F.when(F.size(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")))).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>")))
    return F.get(t, F.lit(0))
