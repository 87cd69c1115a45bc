"""Source text: tokens, regions, lines, names and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]|\\\r?\n"
_SUFFIX = r"(?:[\p{L}_][\p{L}\p{N}_]*+)?+"
_ESCAPED = r"\\(?:\r\n|(?s:.))"
_MARKS = r"<=>|<<=|>>=|->\*|\.\.\.|::|->|\.\*|\+\+|--|<<|>>|&&|\|\||##|[-+*/%&|^<>=!]=|(?s:.)"
#: One alternative per token class, in order; together they match any text from end to end, so that pieces joined give the text again. Comments,
#: strings and raw strings (up to their own delimiter) cross lines where the language lets them; repetitions are possessive, so that no
#: text makes the matcher go back or nest.
TOKEN = "|".join([
    rf"(?:{SPACE})++",
    rf"//[^\\\n]*+(?:(?:{_ESCAPED}|\\)[^\\\n]*+)*+",
    r"/\*(?s:.*?)(?:\*/|\z)",
    r'(?:u8|[uUL])?R"([^ ()\\\t\n\x0B\f\r"]{0,16})\((?s:.*?)(?:\)\1"|\z)' + _SUFFIX,
    rf'(?:u8|[uUL])?"[^"\\\n]*+(?:{_ESCAPED}[^"\\\n]*+)*+"{_SUFFIX}',
    rf"(?:u8|[uUL])?'(?:[^'\\\n]|{_ESCAPED})++'{_SUFFIX}",
    r"\.?[0-9](?:[eEpP][+-]|'[0-9A-Za-z_]|[0-9A-Za-z_.])*+",
    r"[\p{L}_](?:[\p{L}\p{N}_]|\\\r?\n(?=[\p{L}\p{N}_]))*+",
    _MARKS,
])


def pieces(text: Column) -> Column:
    """All tokens in order, comments and space among them."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens in order with comments, without space."""
    return F.filter(pieces(text), lambda t: token_kind(t) != "space")


def token_kind(spelling: Column) -> Column:
    """space, comment, raw string, string, character, number, identifier, mark, or unknown for a quote that nothing closes."""
    word = F.when(spelling.rlike(r"^[\p{L}_][\p{L}\p{N}_]*+\z"), "identifier")  # most tokens, so one match tells them
    prefixed = lambda rest: spelling.rlike("^(?:u8|[uUL])?" + rest)
    literal = F.when(prefixed('R"'), "raw string").when(prefixed('"'), "string").when(prefixed("'"), "character")
    early = F.when(spelling.rlike(f"^(?:{SPACE})"), "space").when(spelling.rlike(r"^(?://|/\*)"), "comment").when(spelling.isin('"', "'"), "unknown")
    late = F.when(spelling.rlike(r"^\.?[0-9]"), "number").when(spelling.rlike(r"^[\p{L}_]"), "identifier").otherwise("mark")
    return F.coalesce(word, early, literal, late)


def unspliced(spelling: Column) -> Column:
    """A token's spelling without the backslashes and line ends that continue a line."""
    return F.regexp_replace(spelling, r"\\\r?\n", "")


def slice_bytes(text: Column, offset: Column, size: Column) -> Column:
    """A region given in bytes of UTF-8."""
    return F.decode(F.substr(F.encode(text, "utf-8"), (offset + 1).cast("int"), size.cast("int")), "utf-8")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a character offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return F.length(F.substring_index(before, "\n", -1)) + 1


def region(begin: Column, end: Column) -> Column:
    """struct(offset, size); null if the end lies before the begin."""
    return F.when(end >= begin, F.struct(begin.alias("offset"), (end - begin).alias("size")))


def usr_parts(usr: Column) -> Column:
    """The scopes of a usr: names that follow @N@ (namespace), @S@ (record) and @F@ (function)."""
    return F.regexp_extract_all(usr, F.lit(r"@([NSF]@[^@#]+)"), F.lit(1))


def expression_text(source: Column, printed: Column) -> Column:
    return F.coalesce(F.when(source != "", source), printed)


#: What the letter after a backslash stands for in a character literal.
ESCAPES = {"n": 10, "t": 9, "r": 13, "0": 0, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, "'": 39, '"': 34}
_INTEGER = r"^([+-]?)(0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+)[uUlLzZ]{0,3}$"
_FLOATING = r"^([+-]?(?:[0-9]*\.[0-9]+|[0-9]+\.|[0-9]+(?=[eE]))(?:[eE][+-]?[0-9]+)?)[fFlL]?$"
_CHARACTER = r"^(?:u8|u|U|L)?'(\\.|[^'\\])'$"


def constant(text: Column) -> Column:
    """struct(kind, value) of a literal: boolean, integer, floating or string, else none.

    Integers may be hexadecimal, octal or binary, with marks between digits and a suffix, and come out in decimal (up to 64 bits); a character
    is the integer of its code; floating literals lose their suffix; strings lose their quotes.
    """
    bare = F.regexp_replace(text, "(?<=[0-9a-fA-F])'(?=[0-9a-fA-F])", "")
    sign, digits = F.regexp_extract(bare, _INTEGER, 1), F.regexp_extract(bare, _INTEGER, 2)
    based = lambda skip, base: F.conv(F.substr(digits, F.lit(skip)), base, 10)
    number = F.when(digits.rlike("^0[xX]"), based(3, 16)).when(digits.rlike("^0[bB]"), based(3, 2)).when(digits.rlike("^0[0-7]+$"), based(2, 8)).otherwise(digits)
    letter, real = F.regexp_extract(text, _CHARACTER, 1), F.regexp_extract(bare, _FLOATING, 1)
    escape = F.create_map(*(F.lit(x) for k, v in ESCAPES.items() for x in (k, v)))[F.substr(letter, F.lit(2), F.lit(1))]
    code = F.when(F.char_length(letter) == 2, escape).otherwise(F.ascii(letter)).cast("string")
    kind = F.when(text.isin("true", "false"), "boolean").when(text.rlike(r'^".*"$'), "string").when((digits != "") | (letter != ""), "integer").when(real != "", "floating").otherwise("none")
    value = F.when(kind == "string", F.regexp_extract(text, '^"(.*)"$', 1)).when(kind == "boolean", text).when(letter != "", code).when(digits != "", F.concat(sign, number)).when(real != "", real)
    return F.struct(kind.alias("kind"), value.alias("value"))


def peel(type_text: Column) -> Column:
    """The innermost named type of a spelling with pointers, references, arrays and qualifiers."""
    bare = F.regexp_replace(type_text, r"\b(const|volatile)\b|[*&]+|\[[0-9]*\]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def type_flags(type_text: Column) -> list[Column]:
    """0/1 columns of a parameter's type spelling; an array decays to a pointer."""
    t = F.trim(type_text)
    tests = {"is_pointer": t.rlike(r"\*\s*(const)?$|\[[0-9]*\]$"), "is_rvalue_reference": t.endswith("&&"), "is_lvalue_reference": t.endswith("&") & ~t.endswith("&&"), "is_const": t.rlike(r"\bconst\b"), "is_pack": t.endswith("...")}
    return [c.cast("int").alias(name) for name, c in tests.items()]


def is_forwarding(type_text: Column, parameters: Column) -> Column:
    """0/1: whether a parameter's type is ``T&&`` for one of the function's own template parameters (an array of names), without qualifiers;
    such a reference takes what it is given, lvalues too."""
    named = F.regexp_extract(F.trim(type_text), r"^([A-Za-z_][A-Za-z_0-9]*)\s*&&(?:\s*\.\.\.)?$", 1)
    return ((named != "") & F.coalesce(F.array_contains(parameters, named), F.lit(False))).cast("int")


def like_ascii(text: Column, pattern: str) -> Column:
    """LIKE that ignores the case of letters, as fact queries expect."""
    return text.ilike(pattern)


def glob(text: Column, pattern: str) -> Column:
    body = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r"\.+()|{}^$[]" else c) for c in pattern)
    return text.rlike(f"(?s)^{body}$")


def scalar_max(*columns: Column) -> Column:
    """The greatest, null if any is null."""
    return F.when(sum((c.isNull().cast("int") for c in columns), F.lit(0)) == 0, F.greatest(*columns))


def diagnostic(relation: Column, source: Column, target: Column, detail: Column) -> Column:
    return F.format_string("%s: %s -> %s: %s", relation, source, target, detail)
