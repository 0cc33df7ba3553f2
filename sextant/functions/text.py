"""Text expressions: tokens, syllables, readability, plain text of HTML. All JVM-side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores (Unicode), without plain numbers."""
    words = F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_]+", " "), " ")
    return F.filter(words, lambda x: (x != "") & ~x.rlike("^\\p{Nd}+$"))


def syllables(word: Column) -> Column:
    """Vowel groups, less one for a silent final e, at least one."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(word.endswith("e") & (groups > 1), 1).otherwise(0))


def is_complex(word: Column) -> Column:
    """Three syllables or more, counted without the usual endings."""
    stem = F.when(word.endswith("ing"), F.substring(word, F.lit(1), F.greatest(F.char_length(word) - 3, F.lit(0))))
    stem = stem.when(word.endswith("ed") | word.endswith("es") | word.endswith("ly"), F.substring(word, F.lit(1), F.greatest(F.char_length(word) - 2, F.lit(0)))).otherwise(word)
    return (syllables(word) >= 3) & (syllables(stem) >= 3)


def sentences(text: Column) -> Column:
    """The number of non-blank pieces between full stops, exclamation and question marks."""
    return F.size(F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike("[^\\s\\p{Z}]")))


def html_text(html: Column) -> Column:
    """Plain text of HTML: scripts, styles and tags go, blanks and blank lines collapse."""
    out = F.regexp_replace(html, "(?is)<script\\b.*?</script>", " ")
    out = F.regexp_replace(out, "(?is)<style\\b.*?</style>", " ")
    out = F.regexp_replace(out, "(?s)<[^>]*>", " ")
    out = F.regexp_replace(out, "[ \\t]+", " ")
    return F.trim(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def exact_text(html: Column) -> Column:
    """Plain text of HTML as a parser sees it, in Arrow batches: script, style, meta and link go, character references are read,
    pieces of text are joined by blanks, blanks and blank lines collapse. Null counts as empty."""
    return _exact_text(html)


def parsed_text(html: str | None) -> str:
    from html.parser import HTMLParser
    import re

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skipped, self.pieces = 0, []

        def handle_starttag(self, tag, attrs):
            self.skipped += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.skipped:
                self.skipped -= 1

        def handle_data(self, data):
            if not self.skipped:
                self.pieces.append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", " ".join(reader.pieces))).strip()


@F.pandas_udf(StringType())
def _exact_text(html: pd.Series) -> pd.Series:
    return html.map(parsed_text)


#: What legal forms end a company's name.
LEGAL_FORMS = (
    "llc|l\\.l\\.c|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|l\\.p|llp|plc|ag|sa|s\\.a|nv|n\\.v|gmbh|pllc|"
    "holdings?|group|securities|capital\\s+markets|investment\\s+bank|and\\s+co"
)


def company_key(name: Column) -> Column:
    """A company name without notes, legal form and punctuation; null counts as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "\\([^)]*\\)", " ")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), f"\\b({LEGAL_FORMS})\\b\\.?", " ")
    out = F.regexp_replace(out, "[^\\p{L}\\p{N}_\\s]", " ")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


#: Where a list of counsel begins, and what follows it on a cover page.
COUNSEL, COUNSEL_SPAN = "copies\\s+to\\s*:", 2500
LANDMARKS = (
    "approximate\\s+date\\s+of\\s+(?:the\\s+)?(?:commencement|proposed)|calculation\\s+of\\s+registration\\s+fee|if\\s+any\\s+of\\s+the\\s+securities|"
    "the\\s+registrant\\s+hereby\\s+amends|proposed\\s+maximum\\s+aggregate"
)


def cover(text: Column, window: int = 20_000) -> Column:
    """A filing's first window characters with blanks collapsed and lists of counsel cut out."""
    out = F.substring(F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, 3 * window), "\\s+", " "), 1, window)
    # up to the next landmark within the span, else the span or what is left of the page
    return F.regexp_replace(out, f"(?is){COUNSEL}(?:.{{0,{COUNSEL_SPAN}}}?(?={LANDMARKS})|.{{0,{COUNSEL_SPAN}}})", " ")


def filed_shares(text: Column, span: int = 200, chars: int = 8000) -> Column:
    """The first share count that ends within span characters after a banner; null if there is none."""
    page = F.substring(cover(text), 1, chars)
    # fixed value: how a share count is written
    count = "\\b(\\d[\\d,]{5,})\\s+(?:shares|american\\s+depositary\\s+shares|adss|units)\\b"
    # for each banner the text in its reach; the first that has a count gives it
    reach = F.regexp_extract_all(page, F.lit(f"(?is)(?:prospectus|subject\\s+to\\s+completion)(?=(.{{0,{span}}}))"), 1)
    counts = F.filter(F.transform(reach, lambda r: F.regexp_extract(r, f"(?i){count}", 1)), lambda x: x != "")
    return F.replace(F.try_element_at(counts, F.lit(1)), F.lit(","), F.lit("")).cast("double")
