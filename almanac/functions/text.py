"""Text column functions.

Regex notes: Java's ``\\s`` is ASCII-only and its ``.`` stops at several line
terminators, while the bulletin rules were written against Python's ``re``.
``WS`` below spells out exactly the characters ``str.isspace`` accepts, and
patterns that rely on ``.`` use the ``(?d)`` flag so only ``\\n`` ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# The same without the newline, for patterns that must stay inside one line.
WS_INLINE = r"[\t\x0b-\r\x1c-\x20\x85\p{Z}]"

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), rf"^{WS}+|{WS}+\z", "")


def clean_markdown(col) -> Column:
    """links and markdown symbols to spaces, whitespace collapsed, stripped.

    Links go first (``.`` stops at a newline, so a link cannot span lines);
    then ``| - # * ` >`` and whitespace are one character class collapsed to a
    single space, which is the same as replacing each symbol by a space and
    then collapsing whitespace runs. After that the only whitespace left at
    either end is one ASCII space, so ``trim`` is the strip.
    """
    c = F.regexp_replace(_c(col), r"(?d)\[.*?\]\(.*?\)", " ")
    c = F.regexp_replace(c, rf"(?:{WS}|[|\-#*`>])+", " ")
    return F.trim(c)


def embed_text(header, body, max_chars: int | None = None) -> Column:
    """``clean(header) + '. ' + clean(body)``.

    The whole text by default; ``max_chars=512`` reproduces the original's cut
    (it trimmed the encoder input to save memory)."""
    text = F.concat(clean_markdown(header), F.lit(". "), clean_markdown(body))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def tag_search_range(header, body, body_chars: int | None = None) -> Column:
    """the text tags are searched in: header, a space, the body.

    The whole body by default; ``body_chars=1000`` reproduces the original,
    which searched only the body's first characters."""
    b = _c(body) if body_chars is None else F.substring(_c(body), 1, body_chars)
    return F.concat(_c(header), F.lit(" "), b)


def bracket_text(title) -> Column:
    """F8: text inside the first ``[...]``; '' when absent, NULL on NULL."""
    return F.regexp_extract(_c(title), r"\[(.*?)\]", 1)


def after_last(col, delim: str = "]") -> Column:
    """stripped text after the last ``delim``; the input when it is absent."""
    c = _c(col)
    return F.when(F.instr(c, delim) > 0,
                  py_strip(F.substring_index(c, delim, -1))).otherwise(c)


def part(col, delim: str, n: int) -> Column:
    """the n-th (1-based) piece of a split on a literal delimiter."""
    return F.split_part(_c(col), F.lit(delim), F.lit(n))


def tokens(col) -> Column:
    """Lower-cased Unicode letter/number tokens, empty pieces removed."""
    return F.filter(F.split(F.lower(_c(col)), TOKEN_SPLIT), lambda t: t != "")


def join_list(col, sep: str = ", ") -> Column:
    """F16: ``', '.join(list)``; NULL list gives ''."""
    return F.coalesce(F.array_join(_c(col), sep), F.lit(""))


def strip_removed(col, chars: str = "\n|-") -> Column:
    """remove each literal character, then strip (the filter's ``clean``)."""
    c = _c(col)
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return py_strip(c)


def normalize_newlines(col) -> Column:
    """T5: CRLF and lone CR become LF (what text-mode reading does)."""
    return F.regexp_replace(_c(col), r"\r\n?", "\n")
