"""What shell commands and version-control output say, for evidence of work."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# First words of commands, and what running them verifies.
VERIFIERS = {"pytest": "test", "unittest": "test", "jest": "test", "ruff": "lint", "eslint": "lint", "mypy": "types", "tsc": "types", "make": "build"}
BREAKS = {"&&", "||", ";", "|", "&"}


def segments(command: str) -> list[list[str]]:
    """The simple commands of a line, as words; a line that does not parse has none."""
    try:
        lexer = shlex.shlex(command, posix=True, punctuation_chars=True)
        lexer.whitespace_split = True
        words = list(lexer)
    except ValueError:
        return []
    out: list[list[str]] = [[]]
    for w in words:
        if w in BREAKS:
            out.append([])
        else:
            out[-1].append(w)
    return [s for s in out if s]


def verification_kind(command: str) -> str | None:
    """What a command line verifies: that of its first segment that verifies anything."""
    for words in segments(command):
        for w in words[:4]:
            if kind := VERIFIERS.get(w.rpartition("/")[2]):
                return kind
    return None


def kind_of(command: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else verification_kind(x))

    return F.pandas_udf(run, "string")(command)


#: A record of a porcelain v2 status by its first character: what it is, and where state and path stand.
_RECORDS = (
    ("1", "ordinary", r"(?s)^1 (\S+) (?:\S+ ){6}(.*)$"),
    ("2", "rename_or_copy", r"(?s)^2 (\S+) (?:\S+ ){7}(.*)$"),
    ("u", "unmerged", r"(?s)^u (\S+) (?:\S+ ){8}(.*)$"),
    ("?", "untracked", r"(?s)^(\?) (.*)$"),
    ("!", "ignored", r"(?s)^(!) (.*)$"),
)


def status_of(output: Column) -> Column:
    """array of struct(kind, state, path, original) of a porcelain v2 status whose records end with NUL.

    A rename or copy is followed by a record that is its original path. Records that are cut short,
    headers and the rest are left out; a null output has none.
    """
    kind = "struct<kind:string,state:string,path:string,original:string>"
    records = F.split(F.coalesce(output, F.lit("")), "\0")
    start = F.struct(F.lit(False).alias("moved"), F.array().cast(f"array<{kind}>").alias("out"))

    def read(r: Column) -> Column:
        found = F.lit(None).cast(kind)
        for first, name, pattern in _RECORDS:
            state, path = (F.regexp_extract(r, pattern, k) for k in (1, 2))
            one = F.struct(F.lit(name).alias("kind"), state.alias("state"), path.alias("path"), F.lit(None).cast("string").alias("original"))
            found = F.when(r.startswith(first + " ") & r.rlike(pattern), one).otherwise(found)
        return found

    def step(s: Column, r: Column) -> Column:
        last, found = F.element_at(s["out"], -1), read(r)
        named = F.struct(last["kind"].alias("kind"), last["state"].alias("state"), last["path"].alias("path"), r.alias("original"))
        out = F.when(s["moved"], F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(named))).when(found.isNull(), s["out"]).otherwise(F.array_append(s["out"], found))
        return F.struct((~s["moved"] & F.coalesce(found["kind"] == "rename_or_copy", F.lit(False))).alias("moved"), out.alias("out"))

    return F.aggregate(records, start, step, lambda s: s["out"])
