"""Text quality metrics as Column expressions.

All functions are built from JVM-side built-ins, so they run inside the scan stage of
whatever query uses them.

Whitespace and line breaks follow Python's ``str`` rules (Unicode whitespace plus
U+001C..U+001F), which neither Spark's ``trim`` nor Java's backslash-s covers.  Most texts
hold nothing but blanks and line feeds; one cheap scan tells (``_is_odd``), and only
other texts pay for the general rules.  Patterns are kept to forms that the regex engine
scans fast: few character ranges, possessive repeats, no look-behind.
"""

from pyspark.sql import Column, functions as F

from pairwright import fixed_values as fixed

_RARE = r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
_RARE_SPACES = r"[\u1680-\u3000&&[\u1680\u2000-\u200A\u202F\u205F\u3000]]"
_ODD_BREAKS = r"[\x0B\f\r\x1C\x1D\x1E\x85\u2028-\u2029]"
_ODD_SPACES = rf"[\t\x1F\xA0{_RARE_SPACES}]"
_ODD = rf"[\t\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0{_RARE}]"
WS = rf"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\xA0{_RARE}]"

SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000"
)

# A literal that every match of a default pattern contains: without it there is nothing to count.
_CONTAINED = {
    r">>>+": ">>>",
    r"===>+": "===>",
    r"-{2,}>": "-->",
    r"<-{2,}": "<--",
    r"={3,}": "===",
}

METRICS = [
    "abnormal_symbol_count",
    "code_fence_mismatch",
    "slogan_phrase_count",
    "heading_count",
    "list_item_count",
    "character_count",
    "word_count",
    "repeated_line_count",
]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def _is_odd(text: Column) -> Column:
    """Holds whitespace other than blanks and line feeds."""
    return F.rlike(text, F.lit(_ODD))


def _plain(text: Column) -> Column:
    """Line breaks as line feeds and other whitespace as blanks."""
    breaks = F.regexp_replace(text, _ODD_BREAKS, "\n")
    return F.when(_is_odd(text), F.regexp_replace(breaks, _ODD_SPACES, " ")).otherwise(text)


def _count_if_contained(text: Column, literal: str, count: Column) -> Column:
    return F.when(F.contains(text, F.lit(literal)), count).otherwise(0)


def substring_count(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return _count_if_contained(text, needle, (removed / F.lit(len(needle))).cast("int"))


def _total(counts: list[Column]) -> Column:
    return sum(counts[1:], counts[0])


def abnormal_symbol_count(text: Column, patterns: list[str] = fixed.ABNORMAL_SYMBOL_PATTERNS) -> Column:
    """Matches of every pattern, counted independently of each other."""
    counts = []
    for pattern in patterns:
        count = F.regexp_count(text, F.lit(pattern))
        literal = _CONTAINED.get(pattern)
        counts.append(_count_if_contained(text, literal, count) if literal else count)
    return _total(counts)


def slogan_phrase_count(text: Column, phrases: list[str] = fixed.SLOGAN_PHRASES) -> Column:
    lowered = F.lower(text)
    return _total([substring_count(lowered, phrase) for phrase in phrases])


def heading_count(text: Column) -> Column:
    """Lines of one to six number signs, whitespace and more."""
    count = F.regexp_count(_plain(text), F.lit(r"(?dm)^#{1,6} +[^ \n]"))
    return _count_if_contained(text, "#", count)


def list_item_count(text: Column) -> Column:
    """Lines that start with a bullet or an ordinal, whitespace and more."""
    return F.regexp_count(_plain(text), F.lit(r"(?dm)^ *+(?:[-*+]|\p{Nd}++[.)]) +[^ \n]"))


def code_fence_mismatch(text: Column) -> Column:
    return substring_count(text, "```") % 2


def word_count(text: Column) -> Column:
    """ASCII words, as the quality tables count them: one character is kept of each and counted."""
    return F.length(F.regexp_replace(text, r"\A\W++|(\w)\w*+\W*+", "$1"))


def token_count(text: Column) -> Column:
    """Whitespace-separated tokens, as the decode penalties and the rule scorer count them."""
    return F.length(F.regexp_replace(_plain(text), r"\A[ \n]++|([^ \n])[^ \n]*+[ \n]*+", "$1"))


def _repeats(text: Column, compared: Column) -> Column:
    plain = F.transform(F.split(compared, "\n"), lambda line: F.trim(line))
    general = F.transform(F.split(F.regexp_replace(compared, _ODD_BREAKS, "\n"), "\n"), strip)
    lines = F.filter(F.when(_is_odd(text), general).otherwise(plain), lambda line: line != "")
    # bound to a lambda variable, so that the lines are made once and read twice
    return F.transform(F.array(lines), lambda made: F.size(made) - F.size(F.array_distinct(made)))[0]


def repeated_line_count(text: Column) -> Column:
    """Second and later occurrences of a line, ignoring case, edge blanks and blank lines."""
    return _repeats(text, F.lower(text))


def repeated_line_count_exact_case(text: Column) -> Column:
    return _repeats(text, text)


def metric_columns(text: Column) -> dict[str, Column]:
    """The eight metrics of a text, one column each, so that a query computes only those it reads."""
    text = F.coalesce(text, F.lit(""))
    return {
        "abnormal_symbol_count": abnormal_symbol_count(text),
        "code_fence_mismatch": code_fence_mismatch(text),
        "slogan_phrase_count": slogan_phrase_count(text),
        "heading_count": heading_count(text),
        "list_item_count": list_item_count(text),
        "character_count": F.length(text),
        "word_count": word_count(text),
        "repeated_line_count": repeated_line_count(text),
    }


def text_metrics(text: Column) -> Column:
    """All eight metrics of a text as one struct."""
    return F.struct(*(column.alias(name) for name, column in metric_columns(text).items()))


def decode_penalties(text: Column, length_weight: float = 0.0, repeat_weight: float = 0.0) -> Column:
    """Length and repetition penalties of a candidate answer as one struct."""
    words = token_count(text)
    repeats = repeated_line_count_exact_case(text)
    length_penalty = F.lit(float(length_weight)) * words / F.lit(100.0)
    repeat_penalty = F.lit(float(repeat_weight)) * repeats
    return F.struct(
        words.alias("word_count"),
        repeats.alias("repeated_line_count"),
        length_penalty.alias("length_penalty"),
        repeat_penalty.alias("repeated_line_penalty"),
        (length_penalty + repeat_penalty).alias("total_penalty"),
    )


def sentences(text: Column) -> Column:
    """Split after a sentence mark followed by whitespace, or at line feeds."""
    return F.split(text, f"(?<=[.!?。]){WS}+|\\n+")


# Letters outside ASCII that equal an ASCII letter when case is ignored
_FOLDING_TO_ASCII = "ſKİı"


def folds_to_ascii(text: Column) -> Column:
    """Holds a letter that only equals an ASCII letter when case is ignored."""
    found = F.lit(False)
    for letter in _FOLDING_TO_ASCII:
        found = found | F.contains(text, F.lit(letter))
    return found


def contains_term(text: Column, term: Column, lowered: Column | None = None, folding: Column | None = None) -> Column:
    """Case-insensitive whole-term match with ASCII word boundaries; a blank term never matches.

    The pattern depends on the row, so it is compiled per row; a plain substring test keeps
    that to the rows where the term can occur.  Pass ``lower(text)`` and
    ``folds_to_ascii(text)`` as columns to compute them once for several terms.
    """
    stripped = strip(term)
    quoted = F.concat(
        F.lit(r"(?iu)(?<![A-Za-z0-9_])\Q"),
        F.replace(stripped, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
        F.lit(r"\E(?![A-Za-z0-9_])"),
    )
    lowered = F.lower(text) if lowered is None else lowered
    folding = folds_to_ascii(text) if folding is None else folding
    ascii_term = F.octet_length(stripped) == F.length(stripped)
    possible = ~ascii_term | folding | F.contains(lowered, F.lower(stripped))
    return (stripped != "") & F.when(possible, F.regexp_like(text, quoted)).otherwise(False)


def first_answer(*columns: Column) -> Column:
    """First non-null answer column, else the empty string."""
    return F.coalesce(*columns, F.lit(""))
