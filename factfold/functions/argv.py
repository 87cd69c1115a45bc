"""Compiler command lines as arrays of strings."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from factfold.functions.paths import normalise, once

#: Arguments that a stored command line leaves out.
DROP = [
    "-c", "--", "-M", "-MM", "-MD", "-MMD", "-MG", "-MP", "-MV", "-Werror", "-pedantic-errors", "-shared", "-static", "-rdynamic", "-pie", "-no-pie", "-s", "-pipe",
    "-nostdlib", "-nodefaultlibs", "-nostartfiles", "-static-libgcc", "-shared-libgcc", "-static-libstdc++",
]
#: Those that it leaves out together with the next one.
DROP_WITH_NEXT = ["-o", "-MF", "-MT", "-MQ", "-dependency-file", "--serialize-diagnostics", "-Xlinker", "-T", "-L", "-l"]
#: What those begin with that it leaves out. They are tested first.
DROP_PREFIX = ["-Werror=", "-Wp,-M", "-MF", "-MT", "-MQ", "-l", "-L", "-Wl,", "-Wa,", "-fuse-ld=", "-fmodules-cache-path="]
#: Programs that only start the compiler, and settings in front of it.
LAUNCHERS, SETTING = ["ccache", "sccache", "distcc", "icecc", "icerun", "env", "time", "nice"], "^[A-Za-z_][A-Za-z0-9_-]*="
#: Flags whose value is a path, in the order in which joined spellings are tried when stored lines are read.
PATH_FLAGS = ["-I", "-isystem", "-iquote", "-idirafter", "-F", "-iframework", "-include", "-imacros", "-include-pch", "--sysroot", "-isysroot", "-resource-dir"]
#: The same flags in the order in which they are tried when lines are stored.
STORED_FLAGS = ["-include-pch", "-iframework", "-idirafter", "-resource-dir", "--sysroot", "-isystem", "-iquote", "-include", "-imacros", "-isysroot", "-F", "-I"]
#: Flags of include directories, in the order of joined spellings.
INCLUDE_FLAGS = ["-isystem", "-iquote", "-idirafter", "-iframework", "-I", "-F", "/I"]
#: Names of compilers.
DRIVERS = r"^(?:clang|clang\+\+.*|clang-.*|gcc|gcc-.*|cc|c\+\+|g\+\+)$"
_LABEL, _VARIABLE = "<([^>]*)>", r"\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]*"


def _empty() -> Column:
    return F.array().cast("array<string>")


def decode_options(text: Column) -> Column:
    """An array of strings from JSON; null unless it is exactly that (``["a", 1]`` and ``["a", null]`` are not)."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    items = F.from_json(text, "array<string>")
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(items, lambda x: x.isNotNull()), items)


def encode_options(argv: Column) -> Column:
    return F.to_json(argv)


def _leads(x: Column) -> Column:
    return x.rlike(SETTING) | F.regexp_extract(x, "([^/]*)$", 1).isin(*LAUNCHERS)


def command_start(argv: Column) -> Column:
    """The index of the first argument that is no launcher or setting; 0 if all are."""
    return F.coalesce(F.get(F.filter(F.transform(argv, lambda x, i: F.when(~_leads(x), i)), lambda i: i.isNotNull()), 0), F.lit(0))


def skip_launchers(argv: Column) -> Column:
    """The command from its compiler on."""
    return F.slice(argv, command_start(argv) + 1, F.greatest(F.size(argv), F.lit(0)))


def sanitise(argv: Column) -> Column:
    """The arguments worth storing. After launchers the compiler goes too. Prefixes are tested first, so ``-MF dep.d`` loses the
    flag and keeps ``dep.d``."""
    led = (F.size(argv) > 0) & _leads(F.get(argv, 0))
    rest = F.slice(argv, F.when(led, command_start(argv) + 2).otherwise(1), F.greatest(F.size(argv), F.lit(0)))
    start = F.struct(_empty().alias("kept"), F.lit(False).alias("skip"))

    def step(s: Column, x: Column) -> Column:
        alone = F.coalesce(*(F.when(x.startswith(p), True) for p in DROP_PREFIX), x.isin(*DROP))
        paired = ~alone & x.isin(*DROP_WITH_NEXT)
        return F.struct(F.when(s["skip"] | alone | paired, s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"), (~s["skip"] & paired).alias("skip"))

    return F.aggregate(rest, start, step)["kept"]


def _replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """text with every match of the pattern replaced; what comes in is not looked at again."""
    filled = lambda t, found: F.concat_ws("", F.transform(F.split(t, pattern, -1), lambda gap, i: F.concat(gap, F.coalesce(once(F.get(found, i), by), F.lit("")))))
    return once(text, lambda t: once(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: filled(t, found)))


def _looked_up(names: Mapping[str, str], name: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[name] if names else F.lit(None).cast("string")


def expand_labels(text: Column, labels: Mapping[str, str]) -> Column:
    """``<name>`` becomes the path of that label, of an unknown one ``<a-b>`` becomes ``/a/b``; ``<>`` stays."""

    def by(match: Column) -> Column:
        name = F.substr(match, F.lit(2), F.length(match) - 2)
        return F.when(name == "", match).otherwise(F.coalesce(_looked_up(labels, name), F.concat(F.lit("/"), F.replace(name, F.lit("-"), F.lit("/")))))

    return _replaced(text, _LABEL, by)


def expand_environment(text: Column, env: Mapping[str, str]) -> Column:
    """``$X`` and ``${X}`` from the given environment; unset names stay as they are."""
    return _replaced(text, _VARIABLE, lambda match: F.coalesce(_looked_up(env, F.regexp_replace(match, "[${}]", "")), match))


def expand_home(path: Column, home: str) -> Column:
    return once(path, lambda p: F.when((p == "~") | p.startswith("~/"), F.concat(F.lit(home), F.substr(p, F.lit(2), F.length(p)))).otherwise(p))


def resolve_path(value: Column, labels: Mapping[str, str], env: Mapping[str, str], home: str, base: str) -> Column:
    """A path with a label, a variable or the home directory in it, made absolute; any other value stays."""
    indirect = value.contains("<") | value.contains("$") | (value == "~") | value.startswith("~/")
    return F.when(indirect, normalise(expand_home(expand_environment(expand_labels(value, labels), env), home), F.lit(base))).otherwise(value)


def _values(argv: Column, flag_of: Callable[[Column], Column], separate: list[str], joint: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """argv with the values of flags changed: the argument after a flag, which is taken whatever it is, or what is joined to it; joint(flag)
    is what stands between a flag and the value joined to it.

    One pass tells values from what stays; change, which may be large, is applied in one place behind it.
    """
    item = "struct<head:string,value:string,changes:boolean>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit(False).alias("value"))

    def of(head: Column, value: Column, changes: bool) -> Column:
        return F.struct(head.cast("string").alias("head"), value.cast("string").alias("value"), F.lit(changes).alias("changes")).cast(item)

    def step(s: Column, x: Column) -> Column:
        stays = of(x, F.lit(None), False)
        joined = lambda f: F.when(f.isNull(), stays).otherwise(of(F.concat(f, joint(f)), F.substr(x, F.length(f) + F.length(joint(f)) + 1, F.length(x)), True))
        new = F.when(s["value"], of(F.lit(""), x, True)).when(x.isin(*separate), stays).otherwise(once(flag_of(x), joined))  # the flag is sought once
        return F.struct(F.array_append(s["out"], new).alias("out"), (~s["value"] & x.isin(*separate)).alias("value"))

    changed = lambda p: F.when(p["changes"], F.concat(p["head"], once(p["value"], change))).otherwise(p["head"])
    return F.transform(F.aggregate(argv, start, step)["out"], changed)


def resolve_includes(argv: Column, change: Callable[[Column], Column]) -> Column:
    """A stored command line with the values of its path flags changed, as with ``resolve_path``."""
    flag = lambda x: F.coalesce(*(F.when(x.startswith(f) & (F.length(x) > len(f)), F.lit(f)) for f in PATH_FLAGS))
    return _values(argv, flag, PATH_FLAGS, lambda f: F.lit(""), change)


def portable_includes(argv: Column, change: Callable[[Column], Column]) -> Column:
    """A command line to be stored with the values of its path flags changed. A flag of two dashes is joined by ``=``, others are not."""
    fits = lambda x, f: (F.substr(x, F.lit(len(f) + 1), F.lit(1)) == "=") if f.startswith("--") else (F.substr(x, F.lit(len(f) + 1), F.lit(1)) != "=")
    flag = lambda x: F.coalesce(*(F.when(x.startswith(f) & (F.length(x) > len(f)) & fits(x, f), F.lit(f)) for f in STORED_FLAGS))
    return _values(argv, flag, STORED_FLAGS, lambda f: F.when(f.startswith("--"), "=").otherwise(""), change)


def include_roots(argv: Column, directory: Column | None = None) -> Column:
    """Directories of the include flags behind the compiler, separate or joined (also by ``=``), in order, relative ones below directory."""

    def at(x: Column, i: Column) -> Column:
        flag = F.coalesce(*(F.when(x.startswith(f) & (F.length(x) > len(f)), F.lit(f)) for f in INCLUDE_FLAGS))
        root = F.when(x.isin(*INCLUDE_FLAGS), F.get(argv, i + 1)).otherwise(F.regexp_replace(F.substr(x, F.length(flag) + 1, F.length(x)), "^=", ""))
        whole = root if directory is None else F.when(root.startswith("/"), root).otherwise(F.concat_ws("/", directory, root))
        return F.when((i > 0) & root.isNotNull(), whole)

    return F.filter(F.transform(argv, at), lambda x: x.isNotNull())


def default_driver(source: Column) -> Column:
    return F.when(source.endswith(".c"), F.lit("clang")).otherwise(F.lit("clang++"))


def driver(argv: Column, source: Column, exists: Column | None = None) -> Column:
    """The program behind launchers if its name is a compiler's, else one by the source's extension.

    A program given by a path must exist, which only the caller can tell; without ``exists`` it is taken to.
    """
    candidate = F.get(argv, command_start(argv))
    name = F.regexp_extract(candidate, "([^/]*)$", 1)
    usable = ~candidate.contains("/") | (F.lit(True) if exists is None else exists)
    return F.when(name.rlike(DRIVERS) & (name != "clang-tool") & usable, candidate).otherwise(default_driver(source))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def name_and_path(text: Column) -> Column:
    """struct(name, path) of ``name=path``; null unless both sides are there."""
    ok = text.rlike("^[^=]+=.+$")
    return F.when(ok, F.struct(F.regexp_extract(text, "^([^=]+)=(.+)$", 1).alias("name"), F.regexp_extract(text, "^([^=]+)=(.+)$", 2).alias("path")))


# adjusters: each takes a command line and its source file and gives a command line --------------------------------------

Adjuster = Callable[[Column, Column], Column]


def adjusted(argv: Column, source: Column, *adjusters: Adjuster) -> Column:
    """A command line after all adjusters, in order."""
    for adjuster in adjusters:
        argv = adjuster(argv, source)
    return argv


def insert_arguments(values: list[str], at_end: bool = True, unless: str | None = None) -> Adjuster:
    """Adds arguments at the end or right behind the compiler; not where the flag ``unless`` stands already, alone or joined to its value."""
    added = F.array(*map(F.lit, values)).cast("array<string>")

    def adjust(argv: Column, source: Column) -> Column:
        more = F.concat(argv, added) if at_end else F.concat(F.slice(argv, 1, 1), added, F.slice(argv, 2, F.greatest(F.size(argv), F.lit(1))))
        return F.when(F.exists(argv, lambda x: x.startswith(unless)), argv).otherwise(more) if unless else more

    return adjust


def strip_output(argv: Column, source: Column) -> Column:
    """Without ``-o`` and its value, joined or apart."""
    def step(s: Column, x: Column) -> Column:
        goes = s["next"] | x.startswith("-o")
        return F.struct((~s["next"] & (x == "-o")).alias("next"), F.when(goes, s["out"]).otherwise(F.array_append(s["out"], x)).alias("out"))

    return F.aggregate(argv, F.struct(F.lit(False).alias("next"), _empty().alias("out")), step)["out"]


def syntax_only(argv: Column, source: Column) -> Column:
    """Checks the syntax in place of compiling: without ``-c`` and ``-S``, with ``-fsyntax-only`` behind the compiler."""
    rest = F.filter(argv, lambda x: ~x.isin("-c", "-S", "-fsyntax-only"))
    return insert_arguments(["-fsyntax-only"], at_end=False)(rest, source)


def platform_flags(resource_dir: str, sysroot: str | None = None) -> list[Adjuster]:
    """What a platform adds to every command line: its compiler's headers, and the root of its system if there is one."""
    return [insert_arguments(["-resource-dir", resource_dir])] + ([insert_arguments(["-isysroot", sysroot])] if sysroot else [])
