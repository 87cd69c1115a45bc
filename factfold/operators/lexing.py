"""Texts to rows of tokens, and preprocessor lines to events.

A text is one row, so its tokens are found where the row is, and so are their places: running sums over a text's tokens, by numpy in the
task that has the text. Nothing is shuffled or written. Preprocessor lines need all lines before them in their file (which macros are defined, which
conditionals are open), so a file's directive lines, and only these, are folded in order by one small Python function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfold.functions import text


def lexed(files: DataFrame, file: str, column: str) -> DataFrame:
    """(file, ordinal, offset, line, kind, spelling) of all tokens, comments among them.

    ordinal counts from 0, offset counts code points from 0, line from 1. Continued lines are joined in spellings, but not in raw
    strings. A quote that nothing closes is one unknown token; a comment or raw string that nothing closes goes to the end. Null
    and empty texts have no tokens.
    """
    pieces = files.select(F.col(file).alias("file"), text.pieces(F.col(column)).alias("pieces")).where(F.size("pieces") > 0)
    placed = pieces.mapInArrow(_placed, f"file {pieces.schema['file'].dataType.simpleString()}, ordinal long, offset long, line long, piece string")
    kind = text.token_kind(F.col("piece"))
    spelling = F.when(F.col("kind") == "raw string", F.col("piece")).otherwise(text.unspliced(F.col("piece")))
    return placed.withColumn("kind", kind).select("file", "ordinal", "offset", "line", "kind", spelling.alias("spelling"))


def _placed(batches):
    """Rows of the pieces that are no space, from lists of pieces: places are running sums over a run of lists less what came before each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        lists = batch.column("pieces")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        for begin, end in _runs(sizes):
            of, count = lists.slice(begin, end - begin).flatten(), sizes[begin:end]
            seen = ~pc.match_substring_regex(of, f"^(?:{text.SPACE})").to_numpy(zero_copy_only=False)
            first = np.repeat(np.cumsum(count) - count, count)

            def before(steps, first=first):
                sums = np.cumsum(steps) - steps
                return sums - sums[first]

            steps = [seen, pc.utf8_length(of).to_numpy(zero_copy_only=False), pc.count_substring(of, "\n").to_numpy(zero_copy_only=False)]
            ordinal, offset, line = (before(x.astype(np.int64)) for x in steps)
            file = batch.column("file").take(pa.array(np.repeat(np.arange(begin, end), count)[seen]))
            yield pa.RecordBatch.from_arrays([file, pa.array(ordinal[seen]), pa.array(offset[seen]), pa.array(line[seen] + 1), of.filter(pa.array(seen))], names=["file", "ordinal", "offset", "line", "piece"])


def _runs(sizes, most: int = 200_000):
    """(begin, end) of runs of lists with ``most`` items or a single list."""
    begin = items = 0
    for at, n in enumerate(sizes.tolist()):
        if at > begin and items + n > most:
            yield begin, at
            begin, items = at, 0
        items += n
    if len(sizes):
        yield begin, len(sizes)


#: The directives that open, continue and close a conditional, and those that stand for themselves.
OPENING, FOLLOWING = ("if", "ifdef", "ifndef"), ("elif", "elifdef", "elifndef", "else")
PLAIN = ("include", "include_next", "import", "define", "undef", "pragma", "error", "warning", "line")

EVENTS = "line long, end_line long, event string, name string, value string"
_SPLICE = "\x01"
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*([A-Za-z_]+)[ \t]*(.*)", re.S)
_MACRO = re.compile(r"([A-Za-z_]\w*)(\()?")
_PART = re.compile(r"0[xX][0-9a-fA-F]+|[0-9]+|[A-Za-z_]\w*|&&|\|\||<<|>>|[<>=!]=|[-+*/%&|^~!<>()?:]|\S")
_BINDS = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_MOST_PARTS = 10_000  # of a condition whose macros are replaced


class Malformed(ValueError):
    pass


def _expanded(condition: str, macros: dict[str, str | None], hidden: frozenset = frozenset()) -> list[str]:
    """Parts of a condition: defined(X) as 0 or 1, macros by their parts, other names as 0."""
    parts, out, i = _PART.findall(condition), [], 0
    while i < len(parts):
        part = parts[i]
        if part == "defined":
            named = parts[i + 2 : i + 3] if parts[i + 1 : i + 2] == ["("] else parts[i + 1 : i + 2]
            i += 3 if parts[i + 1 : i + 2] == ["("] else 1
            out.append(str(int(bool(named) and named[0] in macros)))
        elif part[0].isalpha() or part[0] == "_":
            body = None if part in hidden else macros.get(part)
            out.extend(_expanded(body, macros, hidden | {part}) if body else ["1" if part == "true" else "0"])
        else:
            out.append(part)
        if len(out) > _MOST_PARTS:
            raise Malformed(condition)
        i += 1
    return out


def _number(parts: list[str]) -> int:
    """The value of a condition's parts (taken off the end of a reversed list), by precedence."""
    if not parts:
        raise Malformed
    part = parts.pop()
    if part in ("!", "~", "-", "+"):
        n = _number(parts)
        return {"!": int(not n), "~": ~n, "-": -n, "+": n}[part]
    if part == "(":
        n = _value(parts)
        if not parts or parts.pop() != ")":
            raise Malformed
        return n
    if not part[0].isdigit():
        raise Malformed
    return int(part, 16) if part[:2] in ("0x", "0X") else int(part, 8) if part[0] == "0" else int(part)


def _value(parts: list[str], least: int = 1) -> int:
    left = _number(parts)
    while parts and _BINDS.get(parts[-1], 0) >= least:
        op = parts.pop()
        right = _value(parts, _BINDS[op] + 1)
        if op in "/%":
            if not right:
                raise Malformed
            whole = abs(left) // abs(right) * (1 if (left < 0) == (right < 0) else -1)
            left = whole if op == "/" else left - whole * right
        elif op in ("<<", ">>"):
            if not 0 <= right < 64:
                raise Malformed
            left = left << right if op == "<<" else left >> right
        else:
            left = int({
                "||": left or right, "&&": left and right, "|": left | right, "^": left ^ right, "&": left & right, "==": left == right, "!=": left != right,
                "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right, "+": left + right, "-": left - right, "*": left * right,
            }[op] if op not in ("||", "&&") else bool(left or right) if op == "||" else bool(left and right))
    if least == 1 and parts and parts[-1] == "?":
        parts.pop()
        yes = _value(parts)
        if not parts or parts.pop() != ":":
            raise Malformed
        no = _value(parts)
        return yes if left else no
    return left


def condition_holds(directive: str, rest: str, macros: dict[str, str | None]) -> bool:
    """Whether a conditional directive is true; what is malformed or divides by zero is false."""
    if directive == "else":
        return True
    if directive.endswith("def"):
        named = _MACRO.match(rest)
        return bool(named) and (named[1] in macros) != directive.endswith("ndef")
    try:
        parts = _expanded(rest, macros)[::-1]
        return bool(_value(parts)) and not parts
    except (Malformed, ValueError, RecursionError):
        return False


@dataclass
class _Open:
    directive: str
    line: int  # of the first directive
    end: int  # last line of the newest
    parent: bool  # whether what is around it is read
    taken: bool
    on: bool
    last: bool = False  # an else has come


def fold_directives(lines: list[tuple[int, str]], total: int) -> Iterator[tuple]:
    """Events (line, end_line, event, name, value) of a file's logical lines (number from 0, text with marks where lines were joined)."""
    macros: dict[str, str | None] = {}
    open_: list[_Open] = []
    joined = 0

    def skipped(top: _Open, upto: int):
        if top.parent and not top.on and upto > top.end:
            yield top.end + 1, upto, "skipped", None, None

    for index, logical in lines:
        line = index + 1 + joined
        joined += logical.count(_SPLICE)
        end = index + 1 + joined
        if not (found := _DIRECTIVE.match(logical.replace(_SPLICE, " "))):
            continue
        directive, rest = found[1], found[2].strip()
        on, top = not open_ or open_[-1].on, open_[-1] if open_ else None
        if directive in OPENING:
            test = on and condition_holds(directive, rest, macros)
            if on:
                yield line, end, directive, rest, str(test).lower()
            open_.append(_Open(directive, line, end, on, test, test))
        elif directive in FOLLOWING or directive == "endif":
            if top is None or (top.last and directive != "endif"):
                if top is None or top.parent:
                    yield line, end, "unbalanced", directive, None
                continue
            yield from skipped(top, line - 1)
            if directive == "endif":
                open_.pop()
                test = None
            else:
                test = top.parent and not top.taken and condition_holds(directive, rest, macros)
                top.on, top.taken, top.end, top.last = test, top.taken or test, end, directive == "else"
            if top.parent:
                yield line, end, directive, rest if directive.startswith("elif") else None, None if test is None else str(test).lower()
        elif on and directive in PLAIN:
            yield line, end, directive, *_plain(directive, rest, macros)
    for top in reversed(open_):
        yield from skipped(top, total)
        if top.parent:
            yield top.line, top.line, "unbalanced", top.directive, None


def _plain(directive: str, rest: str, macros: dict[str, str | None]) -> tuple[str | None, str | None]:
    """(name, value) of a directive that is no conditional; definitions take effect."""
    if directive in ("include", "include_next", "import"):
        path = rest if rest[:1] in ('"', "<") else (macros.get(rest) or rest)
        return path.strip('"<> '), "computed" if path != rest or rest[:1] not in ('"', "<") else "quoted" if rest[0] == '"' else "angled"
    if directive not in ("define", "undef"):
        return rest, None
    if not (named := _MACRO.match(rest)):
        return rest, None
    if directive == "undef":
        macros.pop(named[1], None)
        return named[1], None
    body = rest[named.end(1) :].strip()
    macros[named[1]] = None if named[2] else body
    return named[1], body


def preprocessor_events(files: DataFrame, file: str, column: str) -> DataFrame:
    """(file, line, end_line, event, name, value) of the directives that are read, and of the ranges of lines that are skipped.

    Events are named as their directives; conditionals have their condition as name and true or false as value, definitions the
    macro and its body, inclusions the path and quoted, angled or computed. skipped are the lines between two directives of a
    conditional that are not read, inner ones reported once with the outer; unbalanced are directives without a conditional and conditionals
    that nothing closes. Directives in comments and raw strings are none. Files are not opened: macros are those of the file itself.
    Null texts have no events.
    """
    plain = F.translate(F.col(column), _SPLICE, " ")
    hides = lambda t: t.rlike(r'^(?://|/\*|(?:u8|[uUL])?R")')  # noqa: E731  a comment or a raw string
    piece = F.transform(text.pieces(plain), lambda t: F.when(hides(t), F.regexp_replace(t, r"[^\n]+", " ")).otherwise(t))
    shown = F.when(plain.rlike(r'//|/\*|R"'), F.array_join(piece, "")).otherwise(plain)  # other texts hide nothing
    logical = F.regexp_replace(shown, r"\\\r?\n", _SPLICE)
    lines = files.where(F.col(column).isNotNull()).select(F.col(file).alias("file"), F.split(logical, "\r?\n").alias("lines"), (F.char_length(column) - F.char_length(F.replace(column, F.lit("\n"), F.lit(""))) + 1).alias("total"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("text")))
    kept = lines.select("file", "total", F.filter(numbered, lambda x: x["text"].rlike(f"^[ \\t]*#|{_SPLICE}")).alias("lines"))

    def events(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(r["file"], *e) for r in batch.to_pylist() for e in fold_directives([(x["i"], x["text"]) for x in r["lines"]], r["total"])]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [batch.schema.field("file").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "line", "end_line", "event", "name", "value"])

    return kept.where(F.size("lines") > 0).mapInArrow(events, f"file {kept.schema['file'].dataType.simpleString()}, {EVENTS}")
