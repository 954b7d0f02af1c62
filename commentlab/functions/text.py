"""Text column functions (T1–T9, B3): all are native Column expressions, so they stay inside whole-stage
codegen and run wherever the rows are; nothing here collects or calls Python per row.

White space means Python's ``str.isspace`` set. Plain ``\\s`` is ASCII-only in Java and RE2, so the
portable spelling (used by the DuckDB oracle) lists the characters; Spark uses the equal and faster Java
spelling ``(?U)[\\s\\x1c-\\x1f]``. End of input is ``\\z`` (Java's ``$`` also matches before a final line
terminator).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------
# These must equal the reference's character sets for equal results.
#
# Characters replaced by a space in comment normalisation:
#     * " “ ” newline \ … + - / = ( ) ‘ • : [ ] | ’ ! ;
# then: carriage return -> "!", runs of "!" -> "!", runs of "," -> ",", runs of "?" -> "?",
# runs of spaces -> one space.
#
# Token cleaning: the literals "<br/>", "<br>", "<br" (case-sensitive, in this order) become a space; then
# runs of white space or of  + . ! / _ , $ % ^ * ( ) < > " [ ] - ? ; : ' { } `
# and runs of  + — ！ ， 。 ？ 、 ~ @ # ￥ % … & * （ ）  become one space; then lower case and split on white space.
#
# White space = the characters for which Python's str.isspace() is true (all lie below U+D800):
#     U+0009–U+000D, U+001C–U+0020, U+0085, U+00A0, U+1680, U+2000–U+200A, U+2028, U+2029, U+202F,
#     U+205F, U+3000
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
COMMENT_PUNCT = r"[*\x22“”\n\\…+\-/=()‘•:\[\]|’!;]"
BR_LITERALS = ("<br/>", "<br>", "<br")
# ---------------------------------------------------------------------------------------------------------

# The same white-space set for Java: with (?U), \s is Unicode White_Space; adding U+001C–U+001F gives
# exactly the set above, and Java matches it several times faster than the explicit list.
_WS_JAVA = r"\s\x1c-\x1f"


def _patterns(ws: str, prefix: str) -> tuple[str, str, str, str]:
    clean = prefix + r"[" + ws + r"+.!/_,$%^*()<>\x22\[\]\-?;:\x27{}`]+|[+—！，。？、~@#￥%…&*（）]+"
    non_ws = prefix + r"[^" + ws + r"]+"
    word = prefix + r"[\p{L}\p{N}]+|[^" + ws + r"\p{L}\p{N}]"
    trailing = prefix + r"[" + ws + r"]+\z"
    return clean, non_ws, word, trailing


# RE2 / portable spelling (used by the SQL oracle) and the Java spelling (used by Spark)
CLEAN_PUNCT, NON_WS_RUN, WORD_OR_MARK, TRAILING_WS = _patterns(WS, "")
CLEAN_JAVA, NON_WS_JAVA, WORD_JAVA, _TRAILING_J = _patterns(_WS_JAVA, "(?U)")

# normalise_comment steps in order: (pattern, replacement); the carriage-return step is optional.
_NORMALISE_STEPS = (
    (COMMENT_PUNCT, " "),
    (r"\r", "!"),
    (r"!+", "!"),
    (r",+", ","),
    (r"\?+", "?"),
    (r" +", " "),
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise_steps(cr_to_bang: bool = True) -> list[tuple[str, str]]:
    """The (pattern, replacement) chain of ``normalise_comment`` (shared with the SQL surface)."""
    return [s for s in _NORMALISE_STEPS if cr_to_bang or s[0] != r"\r"]


def normalise_comment(col: Column | str, cr_to_bang: bool = True, null_as: str | None = None) -> Column:
    """Punctuation to space, optional CR -> '!', collapse runs of ! , ? and spaces.

    Nulls stay null; ``null_as='nan'`` turns them into the text that the reference makes of them.
    """
    out = _c(col)
    if null_as is not None:
        out = F.coalesce(out, F.lit(null_as))
    for pattern, repl in normalise_steps(cr_to_bang):
        out = F.regexp_replace(out, pattern, repl)
    return out


def newline_to_space(col: Column | str) -> Column:
    """T3."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def rstrip_newlines(col: Column | str) -> Column:
    """T4, ``s.rstrip('\\n')``."""
    return F.regexp_replace(_c(col), r"\n+\z", "")


def rstrip_space(col: Column | str) -> Column:
    """T4, ``s.rstrip()`` with Python's white-space set."""
    return F.regexp_replace(_c(col), _TRAILING_J, "")


def lower_text(col: Column | str) -> Column:
    """T6."""
    return F.lower(_c(col))


def truncate_chars(col: Column | str, n: int) -> Column:
    """First ``n`` characters (code points, as Python slicing)."""
    return F.substring(_c(col), 1, n)


def whitespace_tokens(col: Column | str) -> Column:
    """``str.split()`` — runs of non-white-space, no empty tokens."""
    return F.regexp_extract_all(_c(col), F.lit(NON_WS_JAVA), 0)


def token_count(col: Column | str) -> Column:
    """Number of white-space separated tokens."""
    return F.size(whitespace_tokens(col))


def clean_tokens(col: Column | str) -> Column:
    """T5: drop <br> variants and punctuation runs, lower-case, split on white space."""
    out = _c(col)
    for lit in BR_LITERALS:
        out = F.replace(out, F.lit(lit), F.lit(" "))
    out = F.lower(F.regexp_replace(out, CLEAN_JAVA, " "))
    return whitespace_tokens(out)


def word_punct_tokens(col: Column | str, max_chars: int | None = None) -> Column:
    """Lower-cased words (letters/digits) and single punctuation marks as separate tokens.

    A documented regex tokenizer standing in for the reference's spaCy tokenizer; ``max_chars`` truncates
    the text first (T7) when given.
    """
    out = _c(col) if max_chars is None else truncate_chars(col, max_chars)
    return F.regexp_extract_all(F.lower(out), F.lit(WORD_JAVA), 0)


def spark_sql_regex(pattern: str) -> str:
    """A Spark SQL raw string literal holding ``pattern`` (patterns here contain no quote characters)."""
    assert "'" not in pattern
    return "r'" + pattern + "'"
