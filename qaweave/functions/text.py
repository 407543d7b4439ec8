"""Text rules as Column expressions; only marked-up literals go through Python."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from qaweave.constants import EMOJI_RANGES, ISO_639_1_TO_3

# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Looks at the ends only; a pattern would walk the whole text."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def _holds(col: Column, *parts: str) -> Column:
    found = col.contains(parts[0])
    for part in parts[1:]:
        found = found | col.contains(part)
    return found


# ---------------------------------------------------------------- literals

BLOCK_TAGS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table "
    "tbody td tfoot th thead tr ul".split()
)
_SILENT_TAGS = frozenset(("script", "style"))


class _TextCollector(HTMLParser):
    """Text without formatting: block tags are a blank, script and style are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT_TAGS:
            self.silent += 1
        elif tag in BLOCK_TAGS:
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCK_TAGS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(re.sub(r"[ \t\r\n\f]+", " ", data))


def html_to_text(markup: str) -> str:
    collector = _TextCollector()
    collector.feed(markup)
    collector.close()
    return re.sub(r" {2,}", " ", "".join(collector.parts)).strip(" ")


@F.pandas_udf(StringType())
def _plain_text(markup: pd.Series) -> pd.Series:
    return markup.map(
        lambda m: None if m is None else html_to_text(html.unescape(m).replace("\\t", " "))
    )


def normalize_newlines(col: Column) -> Column:
    """Written-out line breaks become real ones; white space around line breaks
    and empty lines go."""
    real = F.replace(F.replace(col, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    lines = F.filter(F.transform(F.split(real, "\n"), strip), lambda line: line != "")
    return F.array_join(lines, "\n")


def decode_literals(df: DataFrame, column: str) -> DataFrame:
    """Text of quoted objects in a column; other objects and null pass unchanged.

    In steps, so that each text is taken apart once. Rows without markup stay in
    the JVM: Python gets null for them."""
    inner = F.regexp_extract(column, r'(?sU)\A"(.*)"(?:\^\^<[^>]+>)?(?:@\S+(?:\sclass=)?)?\z', 1)
    staged = df.withColumn("_inner", F.when(F.col(column).startswith('"'), strip(inner)))
    inner = F.col("_inner")
    spaced = F.replace(inner, F.lit("\\t"), F.lit(" "))
    simple = F.when(
        _holds(inner, "  ", "\\t", "\t", "\r", "\f"), F.regexp_replace(spaced, r"[ \t\r\f]+", " ")
    ).otherwise(inner)
    staged = staged.withColumn(
        "_text", F.coalesce(_plain_text(F.when(_holds(inner, "<", "&"), inner)), simple)
    )
    text = normalize_newlines(F.replace(F.col("_text"), F.lit('\\"'), F.lit('"')))
    return staged.withColumn(
        column, F.when(F.col("_inner").isNotNull(), text).otherwise(F.col(column))
    ).drop("_inner", "_text")


def strip_angles(col: Column) -> Column:
    return F.btrim(col, F.lit("<>"))


# ---------------------------------------------------------------- cleaning

# Leading marks and numbering, each removed once in this order.
_QUESTION_PREFIXES = (r"(?U)\AQ:\s+", r"(?U)\AQuestion:\s+", r"(?U)\A\d+\.\d*\s+")
_ANSWER_PREFIXES = (r"(?U)\AA:\s+", r"(?U)\AAnswer:\s+", r"(?U)\A\d+\.\d*\s+")

# Opening and closing quotation marks, tried in this order.
_QUOTE_PAIRS = (("\"", "\""), ("“", "”"), ("‘", "’"), ("‟", "”"), ("„", "”"), ("„", "“"))


def _remove_in_turn(col: Column, patterns) -> Column:
    """The first character tells whether any mark can be there."""
    marked = F.substring(col, 1, 1).rlike(r"(?U)[AQ\d]")
    cut = col
    for pattern in patterns:
        cut = F.regexp_replace(cut, pattern, "")
    return F.when(marked, cut).otherwise(col)


def strip_question_prefixes(col: Column) -> Column:
    return _remove_in_turn(col, _QUESTION_PREFIXES)


def strip_answer_prefixes(col: Column) -> Column:
    return _remove_in_turn(col, _ANSWER_PREFIXES)


def strip_quotes(col: Column) -> Column:
    """One layer per pair; a lone straight quote becomes empty."""
    cut = col
    for opening, closing in _QUOTE_PAIRS:
        body = f"(?:(.*){closing})?" if opening == closing else f"(.*){closing}"
        cut = F.regexp_replace(cut, rf"(?s)\A{opening}{body}\z", "$1")
    quoted = F.substring(col, 1, 1).isin([opening for opening, _ in _QUOTE_PAIRS])
    return F.when(quoted, cut).otherwise(col)


def emoji_pattern() -> str:
    """A pattern both Java and RE2 read: an emoji with its modifiers and joined
    parts, a flag, or a keycap."""
    ranges = "".join(
        "-".join(rf"\x{{{point}}}" for point in item.split("-")) for item in EMOJI_RANGES.split()
    )
    tail = r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{E0020}-\x{E007F}\x{20E3}]*"
    one = rf"[{ranges}]{tail}"
    return rf"[0-9#*]\x{{FE0F}}?\x{{20E3}}|{one}(?:\x{{200D}}{one})*"


# Few wide ranges around all emoji: letters and usual punctuation fail here, so
# the long class above is tried on hardly any character.
_NEAR_EMOJI = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{20E3}\x{2122}\x{2139}\x{2194}-\x{2BFF}"
    r"\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}-\x{1FAF8}]"
)


def strip_emoji(col: Column) -> Column:
    suspect = (F.octet_length(col) > F.length(col)) & col.rlike(_NEAR_EMOJI)
    pattern = f"(?=[0-9#*]|{_NEAR_EMOJI})(?:{emoji_pattern()})"
    return strip(F.when(suspect, F.regexp_replace(col, pattern, "")).otherwise(col))


# ---------------------------------------------------------------- identity


def match_text(question: Column, answer: Column) -> Column:
    return F.replace(F.concat(question, F.lit(" "), answer), F.lit("\n"), F.lit(" "))


def qa_id(question: Column, answer: Column) -> Column:
    return F.md5(match_text(question, answer).cast("binary"))


def scheme_host(url: Column) -> Column:
    """Scheme as written and lower-case host; null where the row is to be dropped."""
    root = r"\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
    scheme = F.regexp_extract(url, root, 1)
    authority = F.regexp_extract(url, root, 2)
    host = F.lower(F.regexp_extract(authority, r"\A(?:.*@)?([^:]*)", 1))
    usable = (host != "") & ~authority.contains("[") & F.lower(authority).startswith(host)
    return F.when(usable, F.concat(scheme, F.lit("://"), host))


def map_iso_code(col: Column) -> Column:
    """Two letters to three; three letters pass; anything else is null."""
    # One folded map literal; a map built entry by entry would be rewritten to a
    # CASE of as many branches, too long to compile.
    codes = " ".join(f"{two}:{three}" for two, three in ISO_639_1_TO_3.items())
    table = F.str_to_map(F.lit(codes), F.lit(" "), F.lit(":"))
    return F.when(F.length(col) == 3, col).otherwise(F.try_element_at(table, col))


# ---------------------------------------------------------------- replies

# Reply forms in the order they are tried on a line.
SCORE_PATTERNS = (
    r"^([0-9]{1,3})$",
    r"^Score: ([0-9]{1,3})",
    r"^Score: \*\*([0-9]{1,3})",
    r"^.* ([0-9]{1,3}) out of 100",
    r"^.* \*\*([0-9]{1,3})\*\* out of 100",
    r"^.* \*\*([0-9]{1,3}) out of 100\*\*",
    r"^.* ([0-9]{1,3})/100",
    r"^.* \*\*([0-9]{1,3})/100\*\*",
    r"^I would score .* ([0-9]{1,3})",
    r"^I would score .* \*\*([0-9]{1,3})",
    r"^I would rate .* ([0-9]{1,3})",
    r"^I would rate .* \*\*([0-9]{1,3})",
    r"^I would give .* ([0-9]{1,3})",
    r"^I would give .* \*\*([0-9]{1,3})",
)


def _first_group(text: Column, patterns) -> Column:
    return F.coalesce(
        *[F.nullif(F.regexp_extract(text, f"(?s){p}", 1), F.lit("")) for p in patterns]
    )


def parse_score(reply: Column) -> Column:
    """The number on the first line that fits a form, else -1."""
    lines = F.transform(F.split(reply, "\n"), strip)
    found = F.transform(lines, lambda line: _first_group(line, SCORE_PATTERNS))
    hits = F.filter(found, lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)).cast("int"), F.lit(-1))


def label_patterns(classes: int) -> tuple[str, ...]:
    number = f"[1-{classes}]" if classes < 10 else f"[1-9]|{classes}"
    return (rf"^(?:[Ll]abel: )?({number})$", rf"^({number})\)$", rf"^({number})\)\s+.*")


def parse_label(reply: Column, classes: int) -> Column:
    """Class number of a reply, null when it fits no form (at most ten classes)."""
    return _first_group(strip(reply), label_patterns(classes)).cast("int")


def render(template: str, **fields: Column) -> Column:
    """A request text: the named places of a fixed template filled from columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[fields[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    )
