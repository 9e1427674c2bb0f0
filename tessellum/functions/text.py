"""Text functions as columns: terms, ordered distinct, line scores, tokens of the graph, path references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import STOPWORDS

# Patterns whose matches results must agree on.
PATH_REF = r"(?U)[\w./*+-]+\.[A-Za-z0-9]+|[\w./*+-]+/[\w./*+-]+"
HREF = r"""(?i)href=["']([^"']+)["']"""
MD_LINK = r"\[[^\]]+\]\(([^)]+)\)"
CODE_SPAN = r"`([A-Za-z_][A-Za-z0-9_]*)`"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("


def normalized(text: Column) -> Column:
    """NUL to blank, one kind of line end, no blanks at line ends or at either end of the text."""
    lines = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(" ")), "\r\n?", "\n"), r"(?m)[ \t\x0b\f]+$", "")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Search terms with repeats, in no stated order: parts of ASCII tokens, and pairs of each CJK run (and short runs whole).

    A token gives its parts of two characters or more that are no stopwords; one without such a part gives itself,
    without dots and colons at its ends, unless it is a stopword. All patterns run over the whole text at once.
    """
    text = F.coalesce(text, F.lit(""))
    tokens = F.lower(F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_./:-]{2,}"), F.lit(0)), " "))
    stop = "|".join(STOPWORDS)
    partless = rf"(?<![^ ])(?:[_./:-]+|(?:[a-z0-9]|{stop})(?![a-z0-9]))+(?![^ ])"
    part = rf"(?<![a-z0-9])(?!(?:{stop})(?![a-z0-9]))[a-z0-9]{{2,}}"

    def of(joined: Column) -> Column:
        whole = F.transform(F.regexp_extract_all(joined, F.lit(partless), F.lit(0)), lambda t: F.regexp_replace(t, r"^[.:]+|[.:]+$", ""))
        return F.concat(F.regexp_extract_all(joined, F.lit(part), F.lit(0)), F.filter(whole, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)))

    ascii_terms = F.flatten(F.transform(F.array(tokens), of))  # a name for ``tokens``, so that they are made once
    runs = F.regexp_extract_all(text, F.lit("[\\u3400-\\u9fff]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.concat(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))), F.when(F.length(r) <= 6, F.array(r)).otherwise(F.array().cast("array<string>")))))
    return F.concat(ascii_terms, pairs)


def ordered_distinct(items: Column) -> Column:
    """Trimmed, non-empty items; of those equal but for case the first spelling stays, in order."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def line_score(line: Column, keyword: str) -> Column:
    """0 without the keyword; 1.2 for the whole line, 1.0 for a word of its own, 0.75 inside words."""
    import re

    inside = F.lower(line).contains(keyword.lower())
    score = F.lit(0.75)
    if re.fullmatch("[A-Za-z0-9_]+", keyword):
        score = F.when(line.rlike(f"(?iU)\\b{keyword}\\b"), 1.0).otherwise(0.75)
    return F.when(~inside, 0.0).when(line == keyword, 1.2).otherwise(score)


def graph_token(token: Column) -> Column:
    """A token that may link files, lower-cased, or null."""
    clean = F.regexp_replace(token, "^[`\"'()]+|[`\"'()]+$", "")
    return F.when((F.length(clean) >= 3) & clean.rlike("^[A-Za-z0-9_]+$") & ~F.lower(clean).isin(*STOPWORDS), F.lower(clean))


def stem_tokens(stem: Column) -> Column:
    """Parts of a file's stem of three characters or more, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(stem), r"[_\-.]"), lambda x: F.length(x) >= 3))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def kb_of(path: Column) -> Column:
    """The first component of a path of two or more."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("")


def line_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), "").when(end.isNull() | (start == end), F.concat(F.lit("L"), start)).otherwise(F.concat(F.lit("L"), start, F.lit("-L"), end))


def snippet(text: Column, most: int) -> Column:
    text = F.trim(text)
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def glob_regex(pattern: str) -> str:
    """A regex for a shell pattern: * and ? cross slashes, [!x] negates."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
